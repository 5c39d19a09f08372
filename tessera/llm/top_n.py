"""Top N items within every group, by a hot-cold split.

1. Repeats of an item are reduced to its best place before any row is ranked (partial aggregation, keyed by group and item, so no group is one task), and the result is
   written once, as all that follows reads it.
2. Exact counts of distinct items split the groups: hot ones have more than ``hot_rows`` items and more than 1/1000 of all, so there are fewer than
   1000 of them, whatever the input; that list is the only thing broadcast.
3. Cold groups go to an ordinary window.
4. A hot group is range-sorted by score: its percentiles cut it into ranges; counts tell how many of the highest ranges hold the first N; only those are
   salted, ranked within (group, salt) and then ranked again over at most N x salts rows.
Both parts are exact and unite to the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written


def _ranked(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def top_n(df: DataFrame, group: Column, item: Column, score: Column, frequency: Column, n: int = 10, hot_rows: int = 10_000, salts: int = 32) -> DataFrame:
    """``grp, item, score, frequency, place``: the first ``n`` distinct items of each group.

    Order: score descending, frequency descending (null last), item ascending by code point. A repeated item counts once, at its best place. Null and NaN
    scores, null groups and null items take no part; infinity is the greatest score and -0.0 equals 0.0. Groups with fewer items give all of them, an empty
    table gives none. Other columns of ``df`` are not read.
    """
    rows = df.select(group.cast("string").alias("grp"), item.alias("item"), (score.cast("double") + F.lit(0.0)).alias("score"), frequency.cast("bigint").alias("frequency"))
    rows = rows.where("grp is not null and item is not null and score is not null and not isnan(score)")
    best = written(rows.groupBy("grp", "item").agg(F.max(F.struct("score", "frequency")).alias("best")).select("grp", "item", "best.score", "best.frequency"), "best")
    order = [F.desc("score"), F.desc_nulls_last("frequency"), F.asc("item")]
    counts = best.groupBy("grp").agg(F.count("*").alias("size"))
    total = counts.agg(F.coalesce(F.sum("size"), F.lit(0)))
    hot = F.broadcast(counts.where((F.col("size") > hot_rows) & (F.col("size") * 1000 > total.scalar())).select("grp"))
    cold = _ranked(best.join(hot, "grp", "left_anti"), ["grp"], order, n)
    heavy = best.join(hot, "grp", "left_semi")
    cuts = heavy.groupBy("grp").agg(F.percentile_approx("score", [0.5, 0.75, 0.9, 0.95, 0.98, 0.99, 0.995, 0.999], 10_000).alias("cuts"))
    ranged = heavy.join(F.broadcast(cuts), "grp").select("grp", "item", "score", "frequency", F.size(F.filter("cuts", lambda c: F.col("score") >= c)).alias("range"))
    sizes = ranged.groupBy("grp", "range").agg(F.count("*").alias("size"))
    above = F.sum("size").over(Window.partitionBy("grp").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1))
    needed = sizes.withColumn("above", F.coalesce(above, F.lit(0))).where(F.col("above") < n).groupBy("grp").agg(F.min("range").alias("lowest"))
    first = ranged.join(F.broadcast(needed), "grp").where("range >= lowest").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    hottest = _ranked(_ranked(first, ["grp", "salt"], order, n).drop("place"), ["grp"], order, n)
    columns = ["grp", "item", "score", "frequency", "place"]
    return cold.select(*columns).unionByName(hottest.select(*columns))
