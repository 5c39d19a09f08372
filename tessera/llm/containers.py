"""Filling fixed-capacity containers by exact-complement hashing on a histogram of lengths.

Items of one length are interchangeable, so the packing is planned on the histogram: at most ``capacity`` lengths with their counts, whatever the number of
items. Single, pair and triple sums of lengths are indexed: a slot for each sum holds a combination, checked against the counts left when it is asked for and replaced
when it is used up. Counts only fall, so a sum whose last combination is gone is never searched again. The plan takes the longest remaining length and fills the gap: where
the index holds an exact complement it is consumed, else the longest length that fits (best fit). The pattern found is repeated as often as the counts allow, so it uses
up a length and the number of patterns follows the number of lengths. Items then get their containers by their rank within their length: ranks are counted per
(length, salt) with prefix offsets, so a hot length isn't one task, and a binary search in the plan gives the container.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.token_sizes import RANKS, token_size
from tessera.session import spread, written

_PLAN = "kind int, length int, start bigint, uses int, first bigint"
#: Container specs beyond this number are refused: the plans are collected.
MOST_SPECS = 1000


class _Lengths:
    """Remaining counts by length, and the index of sums: of one length (its count), of two and of three (a slot a sum, 0 unknown, -1 none left)."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        self.left[lengths] = counts
        self.sorted = np.unique(lengths)
        self.two = np.zeros(capacity + 1, dtype=np.int64)  # the longer of the two
        self.three = np.zeros(capacity + 1, dtype=np.int64)  # the longest of the three
        for a in self.sorted:
            fits = self.sorted[(self.sorted <= a) & (self.sorted <= capacity - a)]
            if len(fits) and fits[-1] == a and self.left[a] < 2:
                fits = fits[:-1]
            self.two[fits + a] = a
        self.two[self.two == 0] = -1

    def compact(self) -> None:
        self.sorted = self.sorted[self.left[self.sorted] > 0]

    def longest(self, most: int) -> int:
        """The longest remaining length up to ``most``, 0 if none."""
        k = int(np.searchsorted(self.sorted, most, "right")) - 1
        while k >= 0 and self.left[self.sorted[k]] <= 0:
            k -= 1
        return int(self.sorted[k]) if k >= 0 else 0

    def _have(self, *lengths: int) -> bool:
        return all(x > 0 and self.left[x] >= lengths.count(x) for x in lengths)

    def _search(self, gap: int) -> int:
        """The longer of two remaining lengths that sum to ``gap``, the most even ones last; -1 if there are none."""
        a = self.sorted[(self.sorted * 2 >= gap) & (self.sorted < gap)]
        b = gap - a
        k = np.flatnonzero((self.left[a] > 0) & (self.left[b] > 0) & ((a != b) | (self.left[a] > 1)))
        return int(a[k[-1]]) if len(k) else -1

    def pair(self, gap: int) -> tuple[int, int] | None:
        """Two remaining lengths that sum to ``gap``."""
        a = int(self.two[gap])
        if a > 0 and not self._have(a, gap - a):
            a = self.two[gap] = self._search(gap)
        return (a, gap - a) if a > 0 else None

    def triple(self, gap: int) -> tuple[int, int, int] | None:
        """Three remaining lengths that sum to ``gap``, the longest one as long as may be."""
        a = int(self.three[gap])
        if a < 0:
            return None
        top = self.sorted[(self.sorted * 3 >= gap) & (self.sorted < gap)]
        if a > 0:
            top = top[top <= a]  # longer ones have been used up
        for a in top[(self.left[top] > 0) & (self.two[gap - top] > 0)][::-1].tolist():
            rest = self.pair(gap - a)
            if rest and not self._have(a, *rest):  # the slot's pair needs the same items
                self.left[a] -= 1
                b = self._search(gap - a)
                self.left[a] += 1
                rest = (b, gap - a - b) if b > 0 else None
            if rest:
                self.three[gap] = a
                return a, *rest
        self.three[gap] = -1
        return None

    def complement(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three remaining lengths that sum exactly to ``gap``."""
        return (gap,) if self.left[gap] > 0 else self.pair(gap) or self.triple(gap)


def pack(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(repeats, [(length, uses)])`` that use every item once; each pattern's sum is at most ``capacity``."""
    have = _Lengths(lengths, counts, capacity)
    out: list[tuple[int, list[tuple[int, int]]]] = []
    while longest := have.longest(capacity):
        pattern: dict[int, int] = {}
        gap = capacity

        def take(length: int, n: int = 1) -> None:
            pattern[length] = pattern.get(length, 0) + n
            have.left[length] -= n

        take(longest)
        gap -= longest
        while gap and (most := have.longest(gap)):
            # three lengths of at most ``most`` sum to no more than 3 * most, so nothing is left unsearched
            if gap <= 3 * most and (exact := have.complement(gap)):
                for length in exact:
                    take(length)
                gap = 0
                break
            # best-fit steps in one go, as long as no exact complement is possible
            n = max(1, min(int(have.left[most]), gap // most - 3))
            take(most, n)
            gap -= n * most
        more = min(int(have.left[x]) // n for x, n in pattern.items())
        for x, n in pattern.items():
            have.left[x] -= more * n
        out.append((1 + more, sorted(pattern.items(), reverse=True)))
        if len(out) % 64 == 0:
            have.compact()
    return out


def _plan(key: tuple, histogram: pd.DataFrame) -> pd.DataFrame:
    kind, capacity = key
    rows, first, used = [], 0, {}
    for repeats, pattern in pack(histogram.length.to_numpy(), histogram.n.to_numpy(), int(capacity)):
        for length, uses in pattern:
            start = used.get(length, 0)
            rows.append((kind, length, start, uses, first))
            used[length] = start + uses * repeats
        first += repeats
    return pd.DataFrame(rows, columns=["kind", "length", "start", "uses", "first"])


def fill_containers(docs: DataFrame, specs: DataFrame, ranks: str = RANKS, salts: int | None = None) -> DataFrame:
    """``container_kind, capacity_tokens, container_id, doc_id, piece, start_token, n_tokens``.

    Every document is assigned once for every kind; one longer than the capacity is cut into pieces of the capacity and a remainder, no other is split. Null and
    empty texts have no tokens: they take no space and come out in container 0. Rows with a null ``doc_id`` are items like others. Kinds with a null or non-positive
    capacity give no rows; an empty table gives none. ``salts`` is the number of tasks that share a length, by default that of shuffle partitions. Of ``docs`` only ``doc_id`` and ``text`` are read. The plan joined is bounded by the capacities.
    """
    kinds = [(k, r[0], r[1]) for k, r in enumerate(specs.where("capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().orderBy("capacity_tokens", "container_kind").limit(MOST_SPECS + 1).collect())]
    if len(kinds) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container specs")
    salts = salts or max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sizes = written(spread(docs.select("doc_id", "text")).select("doc_id", token_size(F.col("text"), ranks).alias("size")), "sizes")
    array = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("container_kind"), F.lit(c).alias("capacity")) for k, n, c in kinds))
    each = sizes.select("doc_id", "size", F.explode(array).alias("s")).select("doc_id", "size", "s.*") if kinds else sizes.limit(0).selectExpr("doc_id", "size", "0 as kind", "'' as container_kind", "1 as capacity")
    cut = each.select("*", F.explode(F.expr("sequence(0, greatest(0, int((size - 1) div capacity)))")).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    items = cut.select("*", start.alias("start_token"), F.least(F.col("capacity"), F.col("size") - start).alias("length"))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    # how many items each (kind, length, salt) has: at most capacity x salts rows a kind
    cells = written(salted.where("length > 0").groupBy("kind", "capacity", "length", "salt").agg(F.count("*").alias("n")), "cells")
    histogram = cells.groupBy("kind", "capacity", "length").agg(F.sum("n").alias("n"))
    plan = written(histogram.groupBy("kind", "capacity").applyInPandas(_plan, _PLAN), "plan")
    before = F.sum("n").over(Window.partitionBy("kind", "length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cells.select("kind", "length", "salt", F.coalesce(before, F.lit(0)).alias("offset"))
    within = Window.partitionBy("kind", "length", "salt").orderBy("doc_id", "piece")
    ranked = salted.where("length > 0").withColumn("row", F.row_number().over(within) - 1).join(offsets, ["kind", "length", "salt"])
    placed = ranked.withColumn("container_id", _container(plan, [c for *_, c in kinds])(F.col("kind"), F.col("length"), F.col("row") + F.col("offset")))
    empty = salted.where("length <= 0").withColumn("container_id", F.lit(0).cast("bigint"))
    columns = ["container_kind", F.col("capacity").alias("capacity_tokens"), "container_id", "doc_id", "piece", "start_token", F.col("length").alias("n_tokens")]
    return placed.select(*columns).unionByName(empty.select(*columns))


def _container(plan: DataFrame, capacities: list[int]):
    """A function (kind, length, rank) -> container, by binary search in the broadcast plan."""
    rows = plan.orderBy("kind", "length", "start").toPandas()  # bounded: patterns follow the number of lengths, that is the capacity
    base = np.concatenate(([0], np.cumsum(np.array(capacities, dtype=np.int64) + 1)))
    place = base[rows.kind.to_numpy()] + rows.length.to_numpy()
    lengths, at = np.unique(place, return_index=True)
    shared = plan.sparkSession.sparkContext.broadcast((base, lengths, np.append(at, len(rows)), *(rows[c].to_numpy().astype("int64") for c in ("start", "uses", "first"))))

    @F.pandas_udf(T.LongType())
    def container(kind: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
        base, lengths, at, start, uses, first = shared.value
        rank = rank.to_numpy(dtype="int64")
        group = np.searchsorted(lengths, base[kind.to_numpy()] + length.to_numpy())
        out = np.empty(len(rank), dtype="int64")
        for g in np.unique(group):
            mine = group == g
            lo, hi = at[g], at[g + 1]
            k = lo + np.searchsorted(start[lo:hi], rank[mine], "right") - 1
            out[mine] = first[k] + (rank[mine] - start[k]) // uses[k]
        return pd.Series(out)

    return container


def fill_report(assigned: DataFrame) -> DataFrame:
    """Of each kind: number of containers and items, tokens, and the share of the space used."""
    used = assigned.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"))
    total = used.groupBy("container_kind", "capacity_tokens").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
