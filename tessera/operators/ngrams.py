"""N-grams, phrase candidates, word trees and repeated segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.measures import signed_chi2
from tessera.functions.tokenizers import tokenize
from tessera.session import written

#: Bits, as a power of two, in which frequent n-grams are noted by their hash: 8 MB. More of them than bits cost time, not results.
SLOT_BITS = 26


def ngrams(words: DataFrame, n: int, key: str = "doc_id", column: str = "w") -> DataFrame:
    """``key, pos, gram``: the n-grams (arrays) of each row's token array. No shuffle."""
    last = F.size(column) - n
    grams = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col(column), i + 1, n)))
    return words.select(key, F.posexplode(grams).alias("pos", "gram"))


def ngram_counts(docs: DataFrame, n: int, min_freq: int = 2, stopwords: list[str] | None = None, rule: str = "alpha3") -> DataFrame:
    """``w1..wn, freq, doc_count`` of n-grams over the documents' tokens without stop words."""
    w = tokenize(F.col("text"), rule)
    w = F.filter(w, lambda x: ~x.isin(*stopwords)) if stopwords else w
    grams = ngrams(docs.select("doc_id", w.alias("w")), n)
    parts = [F.col("gram")[k].alias(f"w{k + 1}") for k in range(n)]
    per_doc = grams.select("doc_id", *parts).groupBy("doc_id", *[f"w{k + 1}" for k in range(n)]).agg(F.count("*").alias("n"))
    return per_doc.groupBy(*[f"w{k + 1}" for k in range(n)]).agg(F.sum("n").alias("freq"), F.count("*").alias("doc_count")).where(F.col("freq") >= min_freq)


def top_ngrams(counts: DataFrame, most: int = 120, least: int = 20) -> DataFrame:
    """The ``most`` (``least`` at least) most frequent n-grams, ties by their words."""
    words = [c for c in counts.columns if c[0] == "w" and c[1:].isdigit()]
    return counts.orderBy(F.desc("freq"), *words).limit(max(least, most))


def bigram_edges(bigrams: DataFrame) -> DataFrame:
    """``src, dst, weight``: undirected edges of ordered bigrams; of (a, b) and (b, a) the smaller frequency holds, as the later one overwrites."""
    pairs = bigrams.where("w1 <> w2").select(F.least("w1", "w2").alias("src"), F.greatest("w1", "w2").alias("dst"), "freq")
    return pairs.groupBy("src", "dst").agg(F.min("freq").alias("weight"))


def trigram_edges(trigrams: DataFrame) -> DataFrame:
    """``src, dst, weight``: edges w1-w2 and w2-w3, trigram frequencies adding up."""
    sides = trigrams.select(F.explode(F.array(F.struct(F.col("w1").alias("a"), F.col("w2").alias("b")), F.struct(F.col("w2").alias("a"), F.col("w3").alias("b")))).alias("e"), "freq")
    pairs = sides.where("e.a <> e.b").select(F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst"), "freq")
    return pairs.groupBy("src", "dst").agg(F.sum("freq").alias("weight"))


def multiword_candidates(docs: DataFrame, min_freq: int = 3, min_docs: int = 2, stopwords: list[str] | None = None) -> DataFrame:
    """``expr, n, freq, doc_count, line_starts, score, norm``: bigrams and trigrams of lines as phrase candidates.

    score = freq x density x sum of log1p(N / freq of each token) x n, with N the number of tokens and density freq / the largest token frequency; norm is the share of
    the largest score. Kept: ``min_freq``, ``min_docs``, no stop word at an edge, trigrams that start a line at least once.
    """
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", tokenize(F.col("line"), "alpha2").alias("w"))
    # counts and the scored union are read several times, so each is written once
    singles = written(lines.select(F.explode("w").alias("form")).groupBy("form").agg(F.count("*").alias("f")), "singles")
    total = singles.agg(F.coalesce(F.sum("f"), F.lit(0))).scalar()
    out = None
    for n in (2, 3):
        cols = [f"w{k + 1}" for k in range(n)]
        grams = ngrams(lines, n).select("doc_id", "pos", *[F.col("gram")[k].alias(c) for k, c in enumerate(cols)])
        if stopwords:
            grams = grams.where(~F.col(cols[0]).isin(*stopwords) & ~F.col(cols[-1]).isin(*stopwords))
        per_doc = grams.groupBy("doc_id", *cols).agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 0).alias("starts"))
        counts = per_doc.groupBy(*cols).agg(F.sum("n").alias("freq"), F.count("*").alias("doc_count"), F.sum("starts").alias("line_starts"))
        kept = counts.where((F.col("freq") >= min_freq) & (F.col("doc_count") >= min_docs) & (F.lit(n < 3) | (F.col("line_starts") > 0)))
        for k, c in enumerate(cols):
            kept = kept.join(singles.select(F.col("form").alias(c), F.col("f").alias(f"f{k}")), c)
        rarity = sum((F.log1p(total / F.col(f"f{k}")) for k in range(1, n)), F.log1p(total / F.col("f0")))
        density = F.col("freq") / F.greatest(*[F.col(f"f{k}") for k in range(n)])
        part = kept.select(F.concat_ws(" ", *cols).alias("expr"), F.lit(n).alias("n"), "freq", "doc_count", "line_starts", (F.col("freq") * density * rarity * n).alias("score"))
        out = part if out is None else out.unionByName(part)
    out = written(out, "scored")
    return out.withColumn("norm", F.col("score") / out.agg(F.max("score")).scalar())


def word_tree(docs: DataFrame, keyword: str, depth: int = 4, min_freq: int = 2, most: int = 120, rule: str = "compound") -> DataFrame:
    """``side, path, freq``: paths of up to ``depth`` tokens left and right of a keyword, frequent ones with all their beginnings. Left paths read outward."""
    words = docs.select(tokenize(F.col("text"), rule).alias("w"))
    hits = words.select("w", F.posexplode("w").alias("pos", "form")).where(F.col("form") == keyword)
    right = F.expr(f"slice(w, pos + 2, {depth})")
    left = F.expr(f"reverse(slice(w, greatest(pos + 1 - {depth}, 1), least(pos, {depth})))")
    sides = hits.select(F.explode(F.array(F.struct(F.lit("left").alias("side"), left.alias("p")), F.struct(F.lit("right").alias("side"), right.alias("p")))).alias("s")).select("s.*")
    paths = sides.where(F.size("p") > 0).select("side", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k")).select("side", F.array_join(F.slice("p", 1, F.col("k")), " ").alias("path"))
    counts = paths.groupBy("side", "path").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)
    # a path is never more frequent than its beginnings, so the most frequent ones come with their ancestors
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("freq"), F.size(F.split("path", " ")), "path"))
    return counts.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _mixed(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each place on, of the hashes of the words."""
    m = max(len(words) - n + 1, 0)
    out = words[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + m]
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _noted(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _slots(hashes)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _places(lists: pa.ListArray, n: int, shorter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams of arrays of words' hashes their row, place in it and hash; only those whose (n-1)-grams are both noted."""
    begin = lists.offsets.to_numpy().astype(np.int64)
    words, row = lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), np.diff(begin))
    if len(words) < n:
        return row[:0], row[:0], words[:0]
    keep = row[: len(row) - n + 1] == row[n - 1 :]
    if shorter is not None:
        hit = _noted(shorter, _mixed(words, n - 1))
        keep &= hit[:-1] & hit[1:]
    at = np.flatnonzero(keep)
    return row[at], at - (begin[row[at]] - begin[0]), _mixed(words, n)[at]


def _frequent(hashed: DataFrame, n: int, shorter: np.ndarray | None, min_freq: int) -> np.ndarray:
    """Bits noted for every n-gram met ``min_freq`` times or more (and some others): an n-gram is that frequent only if its (n-1)-grams are. What is shuffled are hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_places(batch.column("h"), n, shorter)[2].view(np.int64))], ["g"])

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << SLOT_BITS, dtype=bool)
        for batch in batches:
            flags[_slots(batch.column("g").to_numpy().view(np.uint64))] = True
        yield pa.RecordBatch.from_pydict({"bits": [np.packbits(flags).tobytes()]})

    often = hashed.mapInArrow(emit, "g bigint").groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") >= min_freq).select("g")
    bits = np.zeros(1 << (SLOT_BITS - 3), dtype=np.uint8)
    for r in often.coalesce(8).mapInArrow(note, "bits binary").collect():  # at most eight rows of 8 MB
        bits |= np.frombuffer(r.bits, dtype=np.uint8)
    return bits


def repeated_segments(words: DataFrame, classes: DataFrame, key: str = "uce_id", least: int = 2, longest: int = 5, min_freq: int = 3, most: int = 20) -> DataFrame:
    """``class_id, gram, freq, chi2``: n-grams of 2 to 5 tokens over-used in a class of segments (``key, w``), at most ``most`` a class.

    Only n-grams met ``min_freq`` times can be kept, so the others count in the margins alone, which follow from the sizes of the segments, and are never written out."""
    held = written(words.where(F.col("w").isNotNull()).join(classes.select(key, F.col("class_id").alias("grp")), key).select("grp", "w"), "classed")
    hashed = held.select("grp", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    often: dict[int, np.ndarray] = {}
    for n in range(least, longest + 1):
        often[n] = _frequent(hashed.select("h"), n, often.get(n - 1), min_freq)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, codes = [], []
            for n, bits in often.items():
                row, at, g = _places(batch.column("h"), n, often.get(n - 1))
                hit = _noted(bits, g)
                rows.append(row[hit])
                codes.append(at[hit] * 64 + n)
            row = np.concatenate(rows)
            starts = np.concatenate(([0], np.bincount(row, minlength=batch.num_rows).cumsum()))
            found = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.concatenate(codes)[np.argsort(row, kind="stable")], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("w"), found], ["grp", "w", "codes"])

    placed = hashed.mapInArrow(place, f"grp {held.schema['grp'].dataType.simpleString()}, w array<string>, codes array<bigint>")
    forms = F.transform("codes", lambda c: F.array_join(F.slice("w", F.shiftright(c, 6).cast("int") + 1, c.bitwiseAND(63).cast("int")), " "))
    table = written(placed.select("grp", F.explode(forms).alias("form")).groupBy("form", "grp").agg(F.count("*").alias("n")), "table")
    grams = sum((F.greatest(F.size("w") - n + 1, F.lit(0)).cast("bigint") for n in range(least + 1, longest + 1)), F.greatest(F.size("w") - least + 1, F.lit(0)).cast("bigint"))
    sizes = written(held.groupBy("grp").agg(F.sum(grams).alias("grp_total")), "sizes")
    totals = table.groupBy("form").agg(F.sum("n").alias("form_total"))
    full = table.where(F.col("n") >= min_freq).join(totals, "form").join(sizes, "grp").withColumn("total", sizes.agg(F.sum("grp_total")).scalar())
    scored = full.withColumn("score", signed_chi2(F.col("n"), F.col("form_total"), F.col("grp_total"), F.col("total"))).where(F.col("score") > 0)
    placed = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), "form"))
    return scored.withColumn("place", placed).where(F.col("place") <= most).select(F.col("grp").alias("class_id"), F.col("form").alias("gram"), F.col("n").alias("freq"), F.col("score").alias("chi2"))
