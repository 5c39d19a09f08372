"""Concordances, windows over positions, dispersion and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.functions.tokenizers import tokenize
from tessera.operators.corpus import numbered
from tessera.session import written


def kwic(docs: DataFrame, query: str, context: int = 5, regex: bool = False, rule: str = "kwic", case_sensitive: bool = False, stream: bool = True) -> DataFrame:
    """``doc_id, pos, left_tokens, keyword, right_tokens`` of every hit.

    Tokens and query are compared without accents and case, or as they stand if ``case_sensitive``; a regular expression with whole tokens. With ``stream`` the context goes
    on into the documents before and after, in the order of ``doc_id``; else it ends with its document, without a shuffle. Null texts give no hit.
    """
    words = docs.select("doc_id", tokenize(F.col("text"), rule).alias("w")).where("w is not null")
    seen = (lambda w: w) if case_sensitive else fold
    sought = query if case_sensitive else F.lit(query) if regex else fold(F.lit(query))
    hit = (lambda w: seen(w).rlike(f"{'' if case_sensitive else '(?i)'}^(?:{query})$")) if regex else (lambda w: seen(w) == sought)
    # the token array is searched before it is exploded, so only hits become rows
    at = F.filter(F.transform("w", lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    hits = words.select("doc_id", "w", F.explode(at).alias("pos"))
    left = F.slice("w", F.greatest(F.col("pos") + 1 - context, F.lit(1)), F.least(F.col("pos"), F.lit(context)))
    found = hits.select("doc_id", "pos", left.alias("left_tokens"), F.get("w", F.col("pos")).alias("keyword"), F.slice("w", F.col("pos") + 2, context).alias("right_tokens"))
    if not stream:
        return found
    around = _edges(words, context)
    joined = found.join(around, "doc_id", "left")
    tail, head = F.coalesce("before", F.array().cast("array<string>")), F.coalesce("after", F.array().cast("array<string>"))
    missing_left, missing_right = context - F.size("left_tokens"), context - F.size("right_tokens")
    return joined.select(
        "doc_id", "pos", F.concat(F.slice(tail, F.greatest(F.size(tail) - missing_left + 1, F.lit(1)), missing_left), "left_tokens").alias("left_tokens"), "keyword",
        F.concat("right_tokens", F.slice(head, F.lit(1), missing_right)).alias("right_tokens"),
    )


def _edges(words: DataFrame, context: int, bucket: int = 1000) -> DataFrame:
    """``doc_id, before, after``: the last ``context`` tokens before each document and the first after it. Only the edges of documents travel: documents with tokens are numbered,
    and each goes to its bucket of numbers and, near the bucket's end, to the neighbour too."""
    slim = words.where(F.size("w") > 0).select("doc_id", F.slice("w", 1, context).alias("head"), F.slice("w", F.greatest(F.size("w") - context + 1, F.lit(1)), context).alias("tail"))
    placed = numbered(slim, "doc_id", "idx")
    home = F.floor(F.col("idx") / bucket)
    near = F.array_distinct(F.array(F.floor((F.col("idx") - context) / bucket), home, F.floor((F.col("idx") + context) / bucket)))
    rows = placed.withColumn("home", home).withColumn("bucket", F.explode(near))
    order = Window.partitionBy("bucket").orderBy("idx")
    before = F.flatten(F.collect_list("tail").over(order.rowsBetween(-context, -1)))
    after = F.flatten(F.collect_list("head").over(order.rowsBetween(1, context)))
    return rows.select("doc_id", "home", "bucket", before.alias("before"), after.alias("after")).where("home = bucket").select("doc_id", "before", "after")


def concordance(docs: DataFrame, pattern: str, width: int = 50) -> DataFrame:
    """``doc_id, hit, left_text, match, right_text, cut_left, cut_right``: character contexts of every match of a regular expression, whatever the case."""
    parts = docs.where("text is not null").select("doc_id", "text", F.split(F.col("text"), f"(?i){pattern}", -1).alias("between"), F.regexp_extract_all("text", F.lit(f"(?i)({pattern})"), F.lit(1)).alias("found"))
    hits = parts.where("size(found) > 0").select("doc_id", "between", F.posexplode("found").alias("hit", "match"))
    before, after = F.get("between", F.col("hit")), F.get("between", F.col("hit") + 1)
    return hits.select(
        "doc_id", "hit", F.expr(f"right(get(between, hit), {width})").alias("left_text"), "match", F.substring(after, 1, width).alias("right_text"),
        (F.length(before) > width).alias("cut_left"), (F.length(after) > width).alias("cut_right"),
    )


def distribution(hits: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """``variable, value, n``: hits by metadata token; those of documents without metadata under ``sem_metadata``."""
    counts = hits.groupBy(key).agg(F.count("*").alias("n"))
    joined = counts.join(meta, key, "left").withColumn("variable", F.coalesce("variable", F.lit("sem_metadata")))
    return joined.groupBy("variable", "value").agg(F.sum("n").alias("n"))


def dispersion(counts: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``form, freq, docs_with, juilland_d``: Juilland's D = max(0, 1 - CV / sqrt(n - 1)) over all documents, those without the form counting 0.

    Sums and sums of squares are enough, so the zeros are never made rows.
    """
    n = docs.select(key).distinct().agg(F.count("*")).scalar()
    sums = counts.groupBy("form").agg(F.sum("n").alias("freq"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.count("*").alias("docs_with"))
    mean = F.col("freq") / n
    deviation = F.sqrt(F.greatest(F.col("squares") / n - mean * mean, F.lit(0.0)))
    d = F.when((n > 1) & (F.col("freq") > 0), F.greatest(F.lit(0.0), 1 - deviation / mean / F.sqrt(n - 1))).otherwise(0.0)
    return sums.select("form", "freq", "docs_with", F.round(d, 4).alias("juilland_d"))


def global_positions(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``gpos``, the position in the whole token stream in the order of (key, pos): sizes per document, offsets by ranges of documents, then one join."""
    sizes = toks.groupBy(key).agg(F.count("*").alias("size"))
    ranged = written(sizes.repartitionByRange(toks.sparkSession.sparkContext.defaultParallelism, key).withColumn("_part", F.spark_partition_id()), "sizes")
    base, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in ranged.groupBy("_part").agg(F.sum("size")).collect()):  # a row a partition
        base += [F.lit(part), F.lit(total)]
        total += n
    before = F.coalesce(F.sum("size").over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.select(key, (before + (F.create_map(*base)[F.col("_part")] if base else F.lit(0))).alias("_offset"))
    return toks.join(offsets, key).withColumn("gpos", F.col("pos") + F.col("_offset")).drop("_offset")


def rolling(toks: DataFrame, hit: Column, size: int = 500, step: int = 100, metric: str = "ratio", key: str = "doc_id") -> DataFrame:
    """``center, value``: a term's hits in full windows over the whole token stream, across documents; windows start at multiples of ``step``.

    Hits are counted by blocks of ``step`` positions, and a window is made of whole blocks where ``size`` is a multiple of ``step``; else of single positions. Each
    hit goes to the windows that hold it, so no global sort is needed.
    """
    placed = global_positions(toks, key)
    total = placed.agg(F.coalesce(F.max("gpos") + 1, F.lit(0))).scalar()
    hits = placed.where(hit).groupBy("gpos").agg(F.count("*").alias("n"))
    first = F.greatest(F.ceil((F.col("gpos") - size + 1) / step), F.lit(0))
    starts = hits.select("n", F.explode(F.sequence(first, F.floor(F.col("gpos") / step))).alias("k")).groupBy("k").agg(F.sum("n").alias("n"))
    windows = toks.sparkSession.range(1).select(F.explode(F.when(total >= size, F.sequence(F.lit(0).cast("bigint"), F.floor((total - size) / step)))).alias("k"))
    counts = windows.join(starts, "k", "left").fillna(0, ["n"])
    value = {"raw_count": F.col("n").cast("double"), "ratio": F.col("n") / size, "presence": (F.col("n") > 0).cast("double")}[metric]
    return counts.select((F.col("k") * step + size // 2).alias("center"), value.alias("value"))


def xray(docs: DataFrame, patterns: list[str], rule: str = "alpha3") -> DataFrame:
    """``doc_id, pattern, rel_pos``: relative positions (1-based index / length) of tokens that match a pattern; ``a*`` matches beginnings, the first pattern wins."""
    words = docs.select("doc_id", tokenize(F.col("text"), rule).alias("w"))
    at = words.select("doc_id", F.size("w").alias("n"), F.posexplode("w").alias("pos", "form"))
    which = F.coalesce(*(F.when(F.col("form").startswith(p[:-1]) if p.endswith("*") else F.col("form") == p, p) for p in patterns))
    return at.select("doc_id", which.alias("pattern"), ((F.col("pos") + 1) / F.col("n")).alias("rel_pos")).where("pattern is not null")


def document_bins(toks: DataFrame, terms: list[str], bins: int = 10, key: str = "doc_id") -> DataFrame:
    """``key, form, bin, n``: hits of terms in equal bins of each document's tokens, bin = floor(pos x bins / length); bins without a hit aren't rows."""
    sized = toks.join(toks.groupBy(key).agg(F.count("*").alias("len")), key)
    hits = sized.where(F.col("form").isin(*terms))
    return hits.groupBy(key, "form", F.least(F.floor(F.col("pos") * bins / F.col("len")), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def trends(toks: DataFrame, terms: list[str], order: DataFrame, bins: int = 10, key: str = "doc_id") -> DataFrame:
    """``form, bin, n, per_thousand`` over bins of the document sequence; ``order`` numbers the documents ``key, idx`` from 0."""
    n = order.agg(F.count("*")).scalar()
    binned = toks.join(order.select(key, F.least(F.floor(F.col("idx") * bins / n), F.lit(bins - 1)).alias("bin")), key)
    sizes = binned.groupBy("bin").agg(F.count("*").alias("size"))
    hits = binned.where(F.col("form").isin(*terms)).groupBy("form", "bin").agg(F.count("*").alias("n"))
    return hits.join(sizes, "bin").select("form", "bin", "n", (F.col("n") * 1000.0 / F.col("size")).alias("per_thousand"))


def trend_codes(binned: DataFrame, bins: int = 10, key: str = "doc_id") -> DataFrame:
    """``key, form, n, code``: a document's term with its distribution over bins as digits 0-9 relative to its largest bin, rounded half to even."""
    packed = binned.groupBy(key, "form").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    digits = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")), lambda b: F.bround(F.coalesce(F.try_element_at("m", b), F.lit(0)) * 9 / F.col("most")).cast("int").cast("string"))
    return packed.select(key, "form", "n", F.array_join(digits, "").alias("code"))


def collocates(toks: DataFrame, term: str, window: int = 5, most: int = 50, key: str = "doc_id") -> DataFrame:
    """``form, n``: forms within ``window`` positions of a term in the same document, the most frequent first (ties by form). An equi join with a range residual."""
    near = toks.where(F.col("form") == term).select(key, F.explode(F.sequence(F.col("pos") - window, F.col("pos") + window)).alias("pos"), F.col("pos").alias("at"))
    found = toks.join(near, [key, "pos"]).where((F.col("pos") != F.col("at")) & (F.col("form") != term))
    return found.groupBy("form").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "form").limit(most)


def evocation(docs: DataFrame, rule: str = "alpha") -> DataFrame:
    """``form, freq, mean_rank``: frequency and mean position (from 1) among a document's tokens of more than two letters. No join; the rank is the array position."""
    words = F.filter(tokenize(F.col("text"), rule), lambda w: F.length(w) > 2)
    ranked = docs.select(F.posexplode(words).alias("pos", "form"))
    return ranked.groupBy("form").agg(F.count("*").alias("freq"), F.avg(F.col("pos") + 1).alias("mean_rank"))


def prototypical(evoked: DataFrame, min_freq: int = 2) -> DataFrame:
    """Adds ``quadrant`` by the mean frequency and the frequency-weighted mean rank of the forms kept; ranks are rounded to one decimal after the thresholds are taken."""
    kept = evoked.where(F.col("freq") >= min_freq)
    sums = kept.agg(F.avg("freq").alias("f"), (F.sum(F.col("freq") * F.col("mean_rank")) / F.sum("freq")).alias("r"))
    often, early = F.col("freq") >= sums.select("f").scalar(), F.round("mean_rank", 1) <= sums.select("r").scalar()
    quadrant = F.when(often & early, "core").when(often, "first_periphery").when(early, "contrast").otherwise("second_periphery")
    return kept.select("form", "freq", F.round("mean_rank", 1).alias("mean_rank"), quadrant.alias("quadrant"))
