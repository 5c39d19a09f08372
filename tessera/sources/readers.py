"""Readers: text, JSON, CSV, office documents, archives, folders, dictionaries and tagged corpora."""

from __future__ import annotations

import csv
import io
import json
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings tried on bytes, in order.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")
TEXT_TYPES = ("txt", "text", "corpus", "md", "net")
FILES = "path string, text string"


def decode(raw: bytes) -> str:
    """Bytes as text in the first encoding that fits; byte-order marks of UTF-16 are heeded."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def json_strings(value: object) -> Iterator[str]:
    """All strings at the leaves of a JSON value, in order."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from json_strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from json_strings(v)


def _xml_text(raw: bytes, paragraph: str, breaks: dict[str, str]) -> str:
    """Text of an XML part: paragraphs on lines of their own; some elements stand for characters."""
    out = []
    for p in ElementTree.fromstring(raw).iter():
        if p.tag.rpartition("}")[2] in paragraph.split():
            parts = []
            for e in p.iter():
                name = e.tag.rpartition("}")[2]
                parts += [breaks.get(name, ""), e.text or "" if name in ("t", "p", "h", "span", "a") else ""]
                if e is not p and name in ("span", "a", "s", "tab", "line-break"):
                    parts.append(e.tail or "")
            out.append("".join(parts))
    return "\n".join(out)


def extract(path: str, raw: bytes) -> list[tuple[str, str]]:
    """``(path, text)`` of a file's documents by its extension; an archive gives one a member. Unknown types and damaged files raise ``ValueError``."""
    kind = path.rpartition(".")[2].lower()
    try:
        if kind in TEXT_TYPES:
            return [(path, decode(raw))]
        if kind == "json":
            return [(path, "\n".join(json_strings(json.loads(decode(raw)))))]
        if kind in ("docx", "odt", "xlsx", "zip"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                if kind == "docx":
                    return [(path, _xml_text(z.read("word/document.xml"), "p", {"tab": "\t", "br": "\n"}))]
                if kind == "odt":
                    return [(path, _xml_text(z.read("content.xml"), "p h", {"tab": "\t", "line-break": "\n", "s": " "}))]
                if kind == "xlsx":
                    return [(path, "\n".join("\t".join(r) for r in sheet(z)))]
                return [d for name in sorted(z.namelist()) if not name.endswith("/") and name.rpartition(".")[2].lower() in (*TEXT_TYPES, "json", "docx", "odt") for d in extract(f"{path}!{name}", z.read(name))]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, json.JSONDecodeError) as e:
        raise ValueError(f"{path} can't be read as {kind}: {e}") from e
    raise ValueError(f"files of type {kind!r} aren't read")


def sheet(z: zipfile.ZipFile) -> list[list[str]]:
    """Rows of the first sheet of a spreadsheet, as text."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
    first = min(n for n in z.namelist() if n.startswith("xl/worksheets/") and n.endswith(".xml"))
    rows = []
    for row in ElementTree.fromstring(z.read(first)).iter(f"{ns}row"):
        cells: list[str] = []
        for c in row.iter(f"{ns}c"):
            letters = "".join(x for x in c.get("r", "") if x.isalpha())
            at = 0
            for x in letters:
                at = at * 26 + ord(x) - 64
            cells += [""] * (at - 1 - len(cells))
            value = c.find(f"{ns}v")
            inline = "".join(t.text or "" for t in c.iter(f"{ns}t"))
            cells.append(shared[int(value.text)] if c.get("t") == "s" and value is not None else (value.text if value is not None else inline) or "")
        rows.append(cells)
    return rows


def read_documents(spark: SparkSession, path: str, kinds: tuple[str, ...] = (*TEXT_TYPES, "json", "docx", "odt", "xlsx", "zip")) -> DataFrame:
    """``path, text`` of a file or, recursively, of all files of a folder with these extensions; any number of files."""
    pattern = "*.{" + ",".join(kinds) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([d for p, raw in zip(batch.path, batch.content) for d in extract(p, bytes(raw))], columns=["path", "text"])

    return files.mapInPandas(run, FILES)


def read_table(spark: SparkSession, path: str, sep: str | None = None, infer: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A CSV or TSV table with a header; the delimiter is the one most frequent in the first line if none is given. Repeated column names get a number."""
    first = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    line = first[0][0] if first else ""
    sep = sep or max((";", ",", "\t", "|"), key=line.count)
    df = spark.read.option("header", True).option("sep", sep).option("inferSchema", infer).option("encoding", encoding).option("multiLine", True).option("escape", '"').csv(path)
    header = next(csv.reader([line.lstrip("\ufeff")], delimiter=sep), [])
    seen: dict[str, int] = {}
    names = []
    for c in header if len(header) == len(df.columns) else df.columns:
        bare = c.strip()
        seen[bare] = seen.get(bare, 0) + 1
        names.append(bare if seen[bare] == 1 else f"{bare}_{seen[bare]}")
    return df.toDF(*names)


#: Names of columns that are identifiers.
ID_HINTS = ("id", "codigo", "cod", "code", "uuid", "pk", "key", "registro", "indice", "index", "protocolo", "matricula")


def variable_columns(df: DataFrame, text: tuple[str, ...] = (), least: int = 10) -> list[str]:
    """Columns that can be metadata variables: with values, no text column, and neither identifiers (by name, with nearly unique values or nearly all of digits) nor nearly
    unique numbers. Blank values don't count. One aggregation over all columns."""
    parts = []
    for k, c in enumerate(df.columns):
        value = F.trim(F.col(f"`{c}`").cast("string"))
        value = F.when(value != "", value)
        parts += [F.count(value).alias(f"n{k}"), F.count_distinct(value).alias(f"d{k}"), F.count_if(value.rlike(r"^\d+$")).alias(f"g{k}")]
    r = df.agg(*parts).first()

    def usable(k: int, c: str) -> bool:
        n = r[f"n{k}"]
        name = fold_name(c)
        ident = name in ID_HINTS or name.endswith("_id") or name.startswith("id_")
        unique = n >= least and r[f"d{k}"] / n >= 0.9
        digits = n and r[f"g{k}"] / n >= 0.8
        return bool(n) and c not in text and not (ident and (unique or digits)) and not (unique and digits)

    return [c for k, c in enumerate(df.columns) if usable(k, c)]


def fold_name(name: str) -> str:
    """A column's name without accents, in small letters, blanks as underscores."""
    bare = "".join(c for c in unicodedata.normalize("NFD", name.strip().lower()) if not unicodedata.combining(c))
    return "_".join(bare.split())


def documents_from_table(df: DataFrame, text: list[str], variables: list[str], source: str = "") -> DataFrame:
    """``text, etoiles``: a document a row, with ``*fonte_x *col_value`` tokens."""
    from tessera.functions.text import slug

    tokens = [F.lit(f"*fonte_{source}")] if source else []
    tokens += [F.when(slug(F.col(c).cast("string")) != "", F.concat(F.lit(f"*{c.lower()}_"), slug(F.col(c).cast("string")))) for c in variables]
    return df.select(F.concat_ws("\n", *text).alias("text"), F.concat_ws(" ", *tokens).alias("etoiles"))


def parse_tagged(files: DataFrame, key: str = "path") -> DataFrame:
    """``key, doc_no, header, text, themes`` of texts in the tagged format: a ``****`` line opens a document, ``-*`` lines name its themes.

    Text before any header is a document of its own with the header ``**** *doc_1``; a header without text gives an empty document. Each text is cut inside its row, so its
    lines never leave it.
    """
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    lead = F.when(norm.startswith("****") | (F.trim(norm) == ""), norm).otherwise(F.concat(F.lit("**** *doc_1\n"), norm))
    parts = files.select(key, F.posexplode(F.filter(F.split(lead, r"(?m)^(?=\*\*\*\*)"), lambda p: F.trim(p) != "")).alias("doc_no", "part"))
    lines = F.split("part", "\n")
    body = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~F.ltrim(x).startswith("-*"))
    themes = F.transform(F.filter(lines, lambda x: F.ltrim(x).startswith("-*")), lambda x: F.split(F.ltrim(x), r"\s+")[0])
    return parts.select(key, "doc_no", F.trim(lines[0]).alias("header"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("text"), themes.alias("themes"))


def validate_tagged(files: DataFrame, key: str = "path") -> DataFrame:
    """``key, what, n``: issues of tagged texts: empty documents, headers with a wrong number of stars, malformed metadata tokens, characters of a wrong encoding, and very unequal
    documents (largest at least ten times the mean)."""
    docs = parse_tagged(files, key)
    words = F.filter(F.split("header", r"\s+"), lambda t: t != "****")
    bad = F.size(F.filter(words, lambda t: ~t.rlike(r"^\*[^*_\s]+_\S+$")))
    per = docs.select(key, F.length("text").alias("len"), (F.col("text") == "").alias("empty"), bad.alias("bad"), F.col("text").rlike("Ã[\x80-¿]|�").alias("garbled"))
    sums = per.groupBy(key).agg(
        F.count("*").alias("documents"), F.count_if("empty").alias("empty_documents"), F.sum("bad").alias("bad_tokens"), F.count_if("garbled").alias("garbled_documents"),
        F.coalesce((F.max("len") >= 10 * F.avg("len")).cast("bigint"), F.lit(0)).alias("unequal_documents"),
    )
    stars = files.select(key, F.size(F.regexp_extract_all("text", F.lit(r"(?m)^(\*{1,3}|\*{5,})(?=\s)"), F.lit(1))).alias("bad_markers"))
    wide = sums.join(stars, key)
    names = ["documents", "empty_documents", "bad_tokens", "garbled_documents", "unequal_documents", "bad_markers"]
    return wide.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("bigint").alias("n")) for c in names])).alias("i")).select(key, "i.*")


def repeated_lines(pages: DataFrame, share: float = 0.6, least: int = 4) -> DataFrame:
    """Pages ``doc, page, text`` without the header and footer lines that stand on at least ``share`` of a document's pages (two at least) and have ``least`` characters."""
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("bare", F.trim("line"))
    sizes = pages.groupBy("doc").agg(F.count_distinct("page").alias("pages"))
    seen = lines.where(F.length("bare") >= least).select("doc", "page", "bare").distinct().groupBy("doc", "bare").agg(F.count("*").alias("k"))
    drop = seen.join(sizes, "doc").where(F.col("k") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share))).select("doc", "bare")
    kept = lines.join(drop, ["doc", "bare"], "left_anti").groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("x"))
    return kept.select("doc", "page", F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("text"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``pos, word, lemma, gram`` of a tab-separated dictionary; lines of fewer than three fields are skipped."""
    parts = spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), F.split("value", "\t").alias("p")).where("size(p) >= 3")
    return parts.select("pos", F.trim(F.col("p")[0]).alias("word"), F.trim(F.col("p")[1]).alias("lemma"), F.trim(F.col("p")[2]).alias("gram"))


def read_expressions(spark: SparkSession, path: str) -> DataFrame:
    """``source, target`` separated by a tab or two blanks; lines opening with # are comments."""
    lines = spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '#%'").select(F.split("value", r"\t|\s{2,}", 2).alias("p")).where("size(p) = 2")
    return lines.select(F.trim(F.col("p")[0]).alias("source"), F.trim(F.col("p")[1]).alias("target"))


def read_polarity(spark: SparkSession, path: str) -> DataFrame:
    """``form, polarity`` of a CSV ``word, type, polarity``: 1 and +1 are positive, -1 negative, anything else neutral."""
    df = spark.read.schema("form string, kind string, p string").csv(path)
    return df.select(F.lower(F.trim("form")).alias("form"), F.when(F.trim("p").isin("1", "+1"), 1).when(F.trim("p") == "-1", -1).otherwise(0).alias("polarity"))


def semantic_pairs(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``a < b``: distinct unordered pairs of a two-column resource, folded to small letters; the first ``most`` in order if a budget is given."""
    first, second = rows.columns[:2]
    pair = F.array_sort(F.array(F.lower(F.trim(first)), F.lower(F.trim(second))))
    pairs = rows.select(pair[0].alias("a"), pair[1].alias("b")).where("a is not null and b is not null and a <> b and a <> ''").distinct()
    return pairs.orderBy("a", "b").limit(most) if most else pairs

