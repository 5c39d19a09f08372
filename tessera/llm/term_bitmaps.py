"""Frequency of every distinct value or term, by compressed record bitmaps in a vertical layout.

Layout: one row per (term, 2^16 record ids), a container of the records' low 16 bits: sorted ids while there are at most ``SPARSE``, else 1024 words of bits. Beside it
stand its cardinality and an occurrence counter. Containers of several partitions, spellings or deliveries merge by union, counters by addition; document frequency
is the sum of a term's cardinalities.

Containers are built in two steps. Rows first fold into 64-bit words, (term, word of 64 ids), by bit-or: fixed-width buffers that stay inside whole-stage code and combine
before the shuffle, so a hot term is many groups and its rows never meet in one task before they are 64 times fewer. The words of a container then meet, at most
1024 of them, and become ids or bits. A reader that needs no more than counts prunes ids and bits and takes the cardinality from the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.terms import has_term, with_term


#: Containers with at most this many records hold sorted ids, others bits.
SPARSE = 4096


def _containers(words: DataFrame, sums: list[str]) -> DataFrame:
    """``term, high, cardinality, ids, bits, occurrences, *sums`` of ``term, block, word, occurrences, *sums``, a row for each word."""
    slot = F.expr("int(block & 1023)")
    grouped = words.groupBy("term", F.shiftright("block", 10).alias("high")).agg(
        F.coalesce(F.sum(F.bit_count("word")), F.lit(0)).cast("bigint").alias("cardinality"),
        F.array_sort(F.collect_list(F.when(F.col("word") != 0, F.struct(slot.alias("slot"), F.col("word").alias("word"))))).alias("words"),
        *(F.sum(c).alias(c) for c in ("occurrences", *sums)),
    )
    ids = F.expr("flatten(transform(words, w -> transform(filter(sequence(0, 63), b -> shiftright(w.word, b) & 1L = 1L), b -> w.slot * 64 + b)))")
    bits = F.expr("transform(sequence(0, 1023), s -> coalesce(get(filter(words, w -> w.slot = s), 0).word, 0L))")
    sparse = F.col("cardinality") <= SPARSE
    return grouped.select("term", "high", "cardinality", F.when(sparse, ids).alias("ids"), F.when(~sparse, bits).alias("bits"), "occurrences", *sums)


def _words(containers: DataFrame, sums: list[str]) -> DataFrame:
    """The words of containers again; counters stay with one row of each container."""
    from_ids = F.expr("transform(ids, i -> named_struct('slot', int(i div 64), 'word', shiftleft(1L, i % 64)))")
    from_bits = F.expr("filter(transform(bits, (w, s) -> named_struct('slot', s, 'word', w)), w -> w.word <> 0)")
    parts = containers.select("term", "high", F.explode(F.coalesce(from_ids, from_bits)).alias("w")).select("term", (F.shiftleft("high", 10) + F.col("w.slot")).alias("block"), F.col("w.word").alias("word"))
    counted = containers.select("term", F.shiftleft("high", 10).alias("block"), F.lit(0).cast("bigint").alias("word"), "occurrences", *sums)
    return counted.unionByName(parts, allowMissingColumns=True)


def _folded(rows: DataFrame, sums: list[str]) -> DataFrame:
    return rows.groupBy("term", "block").agg(F.bit_or("word").alias("word"), *(F.sum(c).alias(c) for c in ("occurrences", *sums)))


def term_bitmaps(df: DataFrame, term: Column, record: Column, occurrences: Column | None = None, **sums: Column) -> DataFrame:
    """The vertical layout ``(term, high, cardinality, ids, bits, occurrences, *sums)`` of ``df``; ``high`` is the record id without its low 16 bits.

    ``term`` is brought to its common spelling (``with_term``); null and blank terms give no row. ``record`` is a bigint of any sign; rows without a record
    keep their occurrences under a null ``high`` in an empty container. A null occurrence count adds nothing. Repeated rows set the same bit again and add their
    occurrences again. An empty table gives an empty result; other columns of ``df``, whatever their names, are not read.
    """
    rows = df.select(
        term.alias("text"),
        record.cast("bigint").alias("record"),
        F.coalesce((F.lit(1) if occurrences is None else occurrences).cast("bigint"), F.lit(0)).alias("occurrences"),
        *(F.coalesce(c.cast("bigint"), F.lit(0)).alias(k) for k, c in sums.items()),
    )
    bit = F.expr("coalesce(shiftleft(1L, cast(record & 63 as int)), 0L)")
    words = with_term(rows, F.col("text"), "term").withColumns({"block": F.shiftright("record", 6), "word": bit})
    return _containers(_folded(words, list(sums)), list(sums))


def record_count(df: DataFrame, term: Column, record: Column) -> DataFrame:
    """``n``, one row: the number of distinct records with at least one term, by one bitmap over all terms."""
    rows = df.where(record.isNotNull() & has_term(term)).select(record.cast("bigint").alias("record"))
    blocks = rows.groupBy(F.shiftright("record", 6).alias("block")).agg(F.expr("bit_or(shiftleft(1L, cast(record & 63 as int)))").alias("records"))
    return blocks.agg(F.coalesce(F.sum(F.bit_count("records")), F.lit(0)).cast("bigint").alias("n"))


def merge_bitmaps(first: DataFrame, *more: DataFrame) -> DataFrame:
    """The union of layouts with the same columns: records by union, counters by sum."""
    for df in more:
        first = first.unionByName(df)
    sums = [c for c in first.columns if c not in ("term", "high", "cardinality", "ids", "bits", "occurrences")]
    return _containers(_folded(_words(first, sums), sums), sums)


def term_frequencies(bitmaps: DataFrame, total: DataFrame, min_records: int = 3, max_share: float = 0.5) -> DataFrame:
    """``term, frequency, n_records, *sums, mark``: the whole vocabulary with its counts.

    ``total`` is a ``record_count``. ``mark`` is ``'rare'`` below ``min_records`` records, ``'common'`` above ``max_share`` of all records (those with at least one term), else ``'useful'``.
    A term met only in rows without a record has no records and is rare.
    """
    sums = [c for c in bitmaps.columns if c not in ("term", "high", "cardinality", "ids", "bits", "occurrences")]
    counts = bitmaps.groupBy("term").agg(
        F.sum("occurrences").alias("frequency"), F.sum("cardinality").alias("n_records"), *(F.sum(c).alias(c) for c in sums)
    )
    mark = F.when(F.col("n_records") < min_records, "rare").when(F.col("n_records") > max_share * total.scalar(), "common").otherwise("useful")
    return counts.withColumn("mark", mark)
