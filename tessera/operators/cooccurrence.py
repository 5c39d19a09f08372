"""Co-occurrence in windows and in segments, PPMI, association indices and concept pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.indices import ALIASES, FULL, index
from tessera.session import paired, spread, written


def windowed(words: DataFrame, window: int = 5, column: str = "w") -> DataFrame:
    """``term_a < term_b, n_pairs, n_ref``: unordered pairs of different tokens at most ``window`` positions apart within a row's token array.

    ``n_ref`` counts every pair from both its ends. Pairs are made inside the row, so only counts are shuffled.
    """
    first = words.select(column, F.posexplode(column).alias("pos", "a"))
    pairs = first.select("a", F.explode(F.expr(f"slice({column}, pos + 2, {window})")).alias("b")).where("a <> b")
    return pairs.groupBy(F.least("a", "b").alias("term_a"), F.greatest("a", "b").alias("term_b")).agg(F.count("*").alias("n_pairs")).withColumn("n_ref", F.col("n_pairs") * 2)


def presence(units: DataFrame, vocabulary: DataFrame, unit: str = "uce_id", form: str = "form", block: int = 256) -> DataFrame:
    """``term_a < term_b, n``: units that hold both terms, for terms of ``vocabulary``. ``units`` has distinct (unit, form) rows.

    A unit with at most ``block`` terms expands its pairs where it is. A larger one is cut into chunks by a hash of the term, and each pair of chunks is shuffled on its own key,
    so a unit of any size spreads over all tasks and no row grows with it.
    """
    kept = units.join(vocabulary.select(form), form, "left_semi").select(F.col(unit).alias("u"), F.col(form).alias("x"))
    large = kept.groupBy("u").agg(F.count("*").alias("size")).where(F.col("size") > block)
    chunks = F.coalesce(F.ceil(F.col("size") / block), F.lit(1))
    placed = kept.join(large, "u", "left").select("u", "x", chunks.alias("chunks"), F.pmod(F.xxhash64("x"), chunks).cast("int").alias("chunk"))
    packed = written(placed.groupBy("u", "chunks", "chunk").agg(F.collect_list("x").alias("xs")), "chunks")
    several = packed.where("chunks > 1").select("u", "chunk", "xs", F.explode(F.expr("sequence(0, int(chunks) - 1)")).alias("other"))
    spark = units.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = several.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).repartition(tasks, "u", "i", "j")
    cells = keyed.groupBy("u", "i", "j").agg(F.collect_list("xs").alias("sides"))
    met = cells.where("i = j or size(sides) = 2").select(F.expr("sides[0]").alias("l"), F.expr("sides[size(sides) - 1]").alias("r"), F.expr("i = j").alias("same"))
    alone = spread(packed.where("chunks = 1")).select(F.col("xs").alias("l"), F.col("xs").alias("r"), F.lit(True).alias("same"))
    first = alone.unionByName(met).select("r", "same", F.posexplode("l").alias("pos", "a"))
    pairs = first.select("a", F.explode(F.expr("if(same, slice(r, pos + 2, size(r)), r)")).alias("b"))
    return pairs.groupBy(F.least("a", "b").alias("term_a"), F.greatest("a", "b").alias("term_b")).agg(F.count("*").alias("n"))


def ppmi(pairs: DataFrame, alpha: float = 0.75, min_cooc: int = 1, most: int | None = 200) -> DataFrame:
    """``term_a, term_b, n, ppmi``: positive PMI with a smoothed context distribution over the symmetric matrix of ``pairs`` (``term_a < term_b, n``), the strongest
    first (ties by n, then terms), or all if ``most`` is None; the value read is that of row term_a, column term_b."""
    both = pairs.select(F.col("term_a").alias("t"), "n").unionAll(pairs.select(F.col("term_b").alias("t"), "n"))
    rows = both.groupBy("t").agg(F.sum("n").cast("double").alias("row"))
    sums = rows.agg(F.sum("row").alias("total"), F.sum(F.pow("row", F.lit(alpha))).alias("smooth"))
    total, smooth = sums.select("total").scalar(), sums.select("smooth").scalar()
    joined = pairs.join(rows.select(F.col("t").alias("term_a"), F.col("row").alias("ra")), "term_a").join(rows.select(F.col("t").alias("term_b"), F.col("row").alias("rb")), "term_b")
    value = F.greatest(F.lit(0.0), F.log2(F.col("n") / total / (F.col("ra") / total * (F.pow("rb", F.lit(alpha)) / smooth))))
    scored = joined.where(F.col("n") >= min_cooc).select("term_a", "term_b", "n", value.alias("ppmi"))
    return scored if most is None else scored.orderBy(F.desc("ppmi"), F.desc("n"), "term_a", "term_b").limit(most)


def contingency(units: DataFrame, vocabulary: DataFrame, unit: str = "uce_id", form: str = "form", full: bool = False, most: int = 5000) -> DataFrame:
    """``term_a < term_b, a, b, c, d, n``. b, c and d come from the terms' totals. ``full`` adds the pairs that never meet: all pairs of a vocabulary, which is refused above
    ``most`` terms."""
    meets = presence(units, vocabulary, unit, form)
    totals = units.join(vocabulary.select(form), form, "left_semi").groupBy(form).agg(F.count("*").alias("k"))
    n = units.agg(F.count_distinct(unit)).scalar()
    if full:
        if vocabulary.count() > most:
            raise ValueError(f"indices over all pairs need a vocabulary of at most {most} terms")
        left, right = totals.select(F.col(form).alias("term_a"), F.col("k").alias("ka")), totals.select(F.col(form).alias("term_b"), F.col("k").alias("kb"))
        every = paired(left, right).where("term_a < term_b")
        cells = every.join(meets, ["term_a", "term_b"], "left").fillna(0, ["n"])
    else:
        cells = meets.join(totals.select(F.col(form).alias("term_a"), F.col("k").alias("ka")), "term_a").join(totals.select(F.col(form).alias("term_b"), F.col("k").alias("kb")), "term_b")
    a = F.col("n")
    return cells.select("term_a", "term_b", a.alias("a"), (F.col("ka") - a).alias("b"), (F.col("kb") - a).alias("c"), (n - F.col("ka") - F.col("kb") + a).alias("d"), n.alias("n"))


def similitude(units: DataFrame, vocabulary: DataFrame, coefficient: str, unit: str = "uce_id", form: str = "form") -> DataFrame:
    """``term_a, term_b, value`` of a named association index; indices that differ from 0 for pairs that never meet are given for all pairs."""
    cells = contingency(units, vocabulary, unit, form, full=ALIASES[coefficient] in FULL)
    return cells.select("term_a", "term_b", index(coefficient)(*(F.col(x) for x in "abcdn")).alias("value"))


def validate_contingency(cells: DataFrame) -> DataFrame:
    """One row of counts of cells that break a rule: a sum other than n, a negative count, a pair out of order."""
    return cells.agg(
        F.count("*").alias("pairs"), F.count_if(F.expr("a + b + c + d <> n")).alias("bad_sum"), F.count_if(F.expr("least(a, b, c, d) < 0")).alias("negative"),
        F.count_if(F.expr("term_a >= term_b")).alias("bad_order"),
    )


def concept_pairs(words: DataFrame, concepts: DataFrame, window: int = 10, column: str = "w", key: str = "doc_id") -> DataFrame:
    """``concept_a < concept_b, windows``: full windows of a row's tokens that hold both concepts (``form, concept``).

    Each occurrence stands for the run of windows it lies in; a concept's windows in a row are distinct starts, so a join on (row, start) replaces looking at every window.
    """
    hits = words.select(key, F.size(column).alias("len"), F.posexplode(column).alias("pos", "form")).join(concepts, "form")
    starts = hits.where(F.col("len") >= window).select(key, "concept", F.explode(F.expr(f"sequence(greatest(pos - {window - 1}, 0), least(pos, len - {window}))")).alias("start")).distinct()
    per = starts.groupBy(key, "start").agg(F.array_sort(F.collect_set("concept")).alias("cs")).where(F.size("cs") > 1)
    first = per.select("cs", F.posexplode("cs").alias("i", "concept_a"))
    pairs = first.select("concept_a", F.explode(F.expr("slice(cs, i + 2, size(cs))")).alias("concept_b"))
    return pairs.groupBy("concept_a", "concept_b").agg(F.count("*").alias("windows"))


def labbe(dtm: DataFrame, key: str = "doc_id", most: int = 5000) -> DataFrame:
    """``text_1 < text_2, distance``: Labbé's intertextual distance of every pair of texts of a long matrix ``key, form, n``.

    The larger text is scaled to the smaller; forms only in the larger count from a scaled frequency of 1. In the denominator scaled frequencies count from 1 if text 1 is
    the larger, above 1 otherwise. All pairs of texts come out, so more than ``most`` texts are refused. Empty texts have no rows and take no part.
    """
    dtm, key = written(dtm.select(F.col(key).alias("_text"), "form", "n"), "dtm"), "_text"
    sizes = dtm.groupBy(key).agg(F.sum("n").alias("size"))
    if sizes.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} texts")
    left, right = sizes.select(F.col(key).alias("text_1"), F.col("size").alias("n1")), sizes.select(F.col(key).alias("text_2"), F.col("size").alias("n2"))
    pairs = paired(left, right).where("text_1 < text_2")
    scale1, scale2 = F.when(F.col("n1") > F.col("n2"), F.col("n2") / F.col("n1")).otherwise(1.0), F.when(F.col("n1") > F.col("n2"), 1.0).otherwise(F.col("n1") / F.col("n2"))
    scaled = pairs.withColumn("u1", scale1).withColumn("u2", scale2)
    # forms in both: one equi join; what is in one text only follows from that text's totals per scale
    a, b = dtm.select(F.col(key).alias("text_1"), "form", F.col("n").alias("x")), dtm.select(F.col(key).alias("text_2"), "form", F.col("n").alias("y"))
    common = a.join(b, "form").where("text_1 < text_2").join(scaled, ["text_1", "text_2"])
    x, y = F.col("x") * F.col("u1"), F.col("y") * F.col("u2")
    first_larger = F.col("n1") > F.col("n2")
    large, small = F.when(first_larger, x).otherwise(y), F.when(first_larger, y).otherwise(x)
    shared = common.groupBy("text_1", "text_2").agg(F.sum(F.abs(x - y)).alias("diff"), F.sum(small).alias("small_common"), F.sum(F.when(large >= 1, large).otherwise(0.0)).alias("large_common"))
    spectrum = dtm.groupBy(key, "n").agg(F.count("*").alias("forms"))  # frequencies of a text: few distinct ones
    big = scaled.select("*", F.when(first_larger, F.col("text_1")).otherwise(F.col("text_2")).alias(key), F.when(first_larger, F.col("u1")).otherwise(F.col("u2")).alias("u"))
    v = F.col("n") * F.col("u")
    least = F.when(first_larger, v >= 1).otherwise(v > 1)
    sums = big.join(spectrum, key).groupBy("text_1", "text_2", "n1", "n2").agg(F.sum(F.when(v >= 1, v * F.col("forms")).otherwise(0.0)).alias("large_from_1"), F.sum(F.when(least, v * F.col("forms")).otherwise(0.0)).alias("large_kept"))
    out = sums.join(shared, ["text_1", "text_2"], "left").fillna(0.0, ["diff", "small_common", "large_common"])
    n_small = F.least("n1", "n2")
    distance = F.col("diff") + (n_small - F.col("small_common")) + (F.col("large_from_1") - F.col("large_common"))
    return out.select("text_1", "text_2", (distance / (n_small + F.col("large_kept"))).alias("distance"))


