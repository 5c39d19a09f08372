"""Items that appear together: an incremental pair table.

State: the baskets as last seen, each item's marginal, and the pair counts, all hash-bucketed Parquet below one folder, with a small file that names the current version;
``open`` finds a table again, and files that no version needs any more are removed. A batch brings whole baskets (new or changed; one with no items deletes its
basket). For every basket that changed the old content emits -1 and the new content +1 for each pair and each item; the signed deltas are summed before and after one
shuffle and merged into the buckets they fall in. Buckets without a delta are neither read nor written. Scores are recomputed from the counts.

Pruning is exact: with ``min_together`` and ``min_lift`` (shared x all / (a x b)) a pair can qualify only if both items are met in at least
``min_together`` and at most all / ``min_lift`` baskets, since shared <= min(a, b). Only items within those bounds take part; when a batch moves an item across a
bound, the unchanged baskets that hold it emit that item's pairs, so the table is always what a full count would give.

A basket is kept as chunks of about ``block`` items, by a hash of the item, so no row grows with its basket. A basket of one chunk emits its pairs where it is. For
a basket of c chunks the c(c+1)/2 pairs of chunks are shuffled on their own keys, so its pairs are made by many tasks, each about block^2 at a time.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch, spread

#: Pairs that a bucket holds at most, by the upper bound known before they are made, when the number of buckets is chosen.
PAIRS_A_BUCKET = 1_000_000
#: Name of the file that names the current version, and steps of a batch that no version keeps.
CURRENT, STEPS = "current.json", ("rows", "incoming", "touched", "flags", "chunks", "deltas")
_BASKETS = "basket bigint, chunk int, items array<bigint>"
_PAIRS = "a bigint, b bigint, together bigint"
_ITEMS = "item bigint, term string, n_before bigint, n_baskets bigint"


@dataclass
class PairState:
    """Paths of the current version: one per bucket for pairs and baskets, one for marginals. ``total`` is the number of baskets, ``version`` that of batches."""

    pairs: dict[int, str] = field(default_factory=dict)
    baskets: dict[int, str] = field(default_factory=dict)
    items: str | None = None
    total: int = 0
    version: int = 0
    buckets: int | None = None
    block: int = 256
    min_together: int = 1
    min_lift: float = 0.0

    def paths(self) -> set[str]:
        return {*self.pairs.values(), *self.baskets.values(), *([self.items] if self.items else [])}


class PairTable:
    """Pair counts kept up to date by batches of changed baskets.

    With ``path`` the table lies there and lasts (``PairTable.open``); without, it lies in the shared folder until the JVM ends. ``buckets`` is by default chosen at the
    first batch from the number of pairs its baskets can have. Frames read from the table are good until the next batch.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, block: int = 256, min_together: int = 1, min_lift: float = 0.0, path: str | None = None):
        self.spark, self.root = spark, path.rstrip("/") if path else scratch(spark, "pairs")
        self.state = PairState(buckets=buckets, block=block, min_together=min_together, min_lift=min_lift)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PairTable:
        """The table at ``path`` as its last finished batch left it."""
        found = cls(spark, path=path)
        kept = json.loads(spark.read.text(f"{found.root}/{CURRENT}", wholetext=True).first()[0])
        found.state = PairState(**(kept | {k: {int(b): p for b, p in kept[k].items()} for k in ("pairs", "baskets")}))
        return found

    # files ---------------------------------------------------------------------------------------------------------------------------------

    def _place(self, path: str) -> tuple:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _new(self, name: str) -> str:
        return f"{self.root}/v{self.state.version + 1}/{name}"

    def _save(self, before: PairState) -> None:
        """Name the new version in one step, then remove what only the former one needed."""
        system, current = self._place(f"{self.root}/{CURRENT}")
        _, fresh = self._place(f"{self.root}/{CURRENT}.{self.state.version}")
        out = system.create(fresh, True)
        out.write(json.dumps(asdict(self.state)).encode())
        out.close()
        system.delete(current, False)
        system.rename(fresh, current)
        for old in [*(before.paths() - self.state.paths()), *(f"{self.root}/v{self.state.version}/{x}" for x in STEPS)]:
            self._drop(old)

    def _drop(self, path: str) -> None:
        system, place = self._place(path)
        system.delete(place, True)

    def _write(self, df: DataFrame, name: str, key: Column) -> dict[int, str]:
        """Write by bucket, a task for each; a path for each bucket written. The result is bounded by the number of buckets."""
        path, n = self._new(name), self.state.buckets
        df.withColumn("bucket", F.pmod(key, F.lit(n)).cast("int")).repartitionById(n, F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)
        system, place = self._place(path)
        names = [s.getPath().getName() for s in system.listStatus(place)]
        return {int(x.split("=")[1]): f"{path}/{x}" for x in names if x.startswith("bucket=")}

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """A step of this batch, written once."""
        path = self._new(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _baskets(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read([p for b, p in self.state.baskets.items() if buckets is None or b in buckets], _BASKETS)

    def _pairs(self, buckets: list[int] | None = None) -> DataFrame:
        return self._read([p for b, p in self.state.pairs.items() if buckets is None or b in buckets], _PAIRS)

    def items(self) -> DataFrame:
        """``item, term, n_baskets`` of every item."""
        return self._read([self.state.items] if self.state.items else [], _ITEMS).select("item", "term", "n_baskets")

    # a batch -------------------------------------------------------------------------------------------------------------------------------

    @property
    def _bounded(self) -> bool:
        return self.state.min_together > 1 or self.state.min_lift > 0

    def _within(self, n: str, total: int) -> Column:
        least = F.col(n) >= max(1, self.state.min_together)
        return least & (F.col(n) * F.lit(float(self.state.min_lift)) <= F.lit(float(total))) if self._bounded else least

    def _chunked(self, rows: DataFrame) -> DataFrame:
        """``basket, chunk, items`` (sorted, distinct) of rows ``basket, item``; a basket without items gives one empty chunk. Sizes are counted first, so that the
        rows of a large basket go to as many groups as it needs."""
        size = rows.groupBy("basket").agg(F.count("item").alias("size")).where(F.col("size") > self.state.block)
        chunks = F.ceil(F.col("size") / F.lit(self.state.block))
        chunk = F.when(F.col("size").isNull() | F.col("item").isNull(), 0).otherwise(F.pmod(F.xxhash64("item"), chunks)).cast("int")
        return rows.join(size, "basket", "left").groupBy("basket", chunk.alias("chunk")).agg(F.array_sort(F.collect_set("item")).alias("items"))

    def apply(self, changed: DataFrame) -> PairTable:
        """Merge a batch ``basket bigint, term string``: the whole new content of each changed basket.

        A row with a null term says that its basket changed and adds nothing, so a basket with null terms only is deleted. Null baskets are ignored, repeated rows
        and an empty batch change nothing. Items are keyed by a 64-bit hash of the term; two terms with one hash raise an error instead of mixing their counts.
        """
        before = self.state
        keyed = changed.where("basket is not null").select(F.col("basket").cast("bigint").alias("basket"), "term", F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("item"))
        keyed = self._kept(keyed, "rows")
        incoming = self._kept(self._chunked(keyed.select("basket", "item")), "incoming")
        sizes = incoming.groupBy("basket").agg(F.sum(F.size("items")).alias("m"))
        n, most = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("m").cast("double") * (F.col("m") - 1) / 2), F.lit(0.0))).first()
        if not n:
            for step in ("rows", "incoming"):
                self._drop(self._new(step))
            return self
        self.state = state = PairState(**(asdict(before) | {"buckets": before.buckets or max(8, min(8192, int(most // PAIRS_A_BUCKET) + 1))}))
        touched, state.baskets = self._replaced(incoming, before)
        state.items, state.total = self._marginals(keyed, touched, before)
        deltas = self._deltas(touched, before)
        state.pairs = self._merge(deltas, before)
        state.version += 1
        self._save(before)
        return self

    def _replaced(self, incoming: DataFrame, before: PairState) -> tuple[DataFrame, dict[int, str]]:
        """The chunks of the baskets that changed, ``basket, chunk, items, sign``, and the baskets' buckets with the new content in place."""
        key = F.xxhash64("basket")
        fresh = incoming.where(F.size("items") > 0)
        if not before.baskets:
            return fresh.withColumn("sign", F.lit(1)), self._write(fresh, "baskets", key)
        hit = [r[0] for r in incoming.select(F.pmod(key, F.lit(self.state.buckets)).cast("int")).distinct().collect()]  # a row a bucket
        old = self._baskets(hit)
        named = incoming.select("basket").distinct()
        ours = old.join(named, "basket", "left_semi")
        both = ours.withColumn("sign", F.lit(-1)).unionByName(fresh.withColumn("sign", F.lit(1)))
        # a chunk that is there alike before and after cancels out; a basket with any other chunk changed
        differs = both.groupBy("basket", "chunk", "items").agg(F.sum("sign").alias("sign")).where("sign <> 0").select("basket").distinct()
        touched = self._kept(both.join(differs, "basket", "left_semi"), "touched")
        after = old.join(named, "basket", "left_anti").unionByName(fresh)
        return touched, {b: p for b, p in before.baskets.items() if b not in hit} | self._write(after, "baskets", key)

    def _marginals(self, keyed: DataFrame, touched: DataFrame, before: PairState) -> tuple[str, int]:
        """Write ``item, term, n_before, n_baskets`` of all items; its path, and the number of baskets now."""
        signed = touched.select(F.explode("items").alias("item"), "sign").groupBy("item").agg(F.sum("sign").alias("delta"))
        named = keyed.where("term is not null").groupBy("item").agg(F.min("term").alias("least"), F.max("term").alias("greatest"))
        known = self._read([before.items] if before.items else [], _ITEMS).select("item", F.col("term").alias("known"), "n_baskets")
        joined = signed.join(named, "item", "full_outer").join(known, "item", "full_outer")
        clash = F.expr("coalesce(least <> greatest, false) or coalesce(least <> known, false)")
        out = joined.select(
            "item", F.when(clash, F.raise_error(F.lit("two terms share a hash"))).otherwise(F.coalesce("known", "least")).alias("term"),
            F.expr("coalesce(n_baskets, 0L)").alias("n_before"), F.expr("coalesce(n_baskets, 0L) + coalesce(delta, 0L)").alias("n_baskets"),
        )
        path = self._new("items")
        out.write.mode("overwrite").parquet(path)
        grown = touched.select("basket", "sign").distinct().agg(F.coalesce(F.sum("sign"), F.lit(0))).first()[0]
        return path, before.total + int(grown)

    def _deltas(self, touched: DataFrame, before: PairState) -> DataFrame:
        """``a, b, delta``: signed pair deltas of changed baskets, and of unchanged ones for items that crossed a bound."""
        if not self._bounded:
            return self._emitted(touched.withColumn("fresh", F.lit(None).cast("array<bigint>")))
        marginals = self._read([self.state.items], _ITEMS)
        flags = self._kept(
            marginals.select("item", self._within("n_before", before.total).alias("was"), self._within("n_baskets", self.state.total).alias("now")).where("was or now"), "flags"
        )
        eligible = touched.select("basket", "chunk", "sign", F.explode("items").alias("item")).join(flags, "item").where("if(sign > 0, now, was)")
        out = eligible.groupBy("basket", "chunk", "sign").agg(F.array_sort(F.collect_list("item")).alias("items")).withColumn("fresh", F.lit(None).cast("array<bigint>"))
        if before.baskets:
            crossed = flags.where("was <> now")
            still = self._baskets().join(touched.select("basket").distinct(), "basket", "left_anti")
            items = still.select("basket", "chunk", F.explode("items").alias("item"))
            again = items.join(items.join(crossed, "item", "left_semi").select("basket").distinct(), "basket", "left_semi").join(flags, "item")
            each = again.select("basket", "chunk", "item", "was", "now", F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")).where("if(sign > 0, now, was)")
            new = F.when(F.col("was") != F.col("now"), F.col("item"))
            out = out.unionByName(each.groupBy("basket", "chunk", "sign").agg(F.array_sort(F.collect_list("item")).alias("items"), F.array_sort(F.collect_list(new)).alias("fresh")))
        return self._emitted(out)

    def _emitted(self, chunks: DataFrame) -> DataFrame:
        """``a, b, delta`` of chunks ``basket, chunk, items, sign, fresh``: every pair of a basket's items, where ``fresh`` isn't null only those with an item in it."""
        chunks = spread(self._kept(chunks, "chunks"))
        several = chunks.groupBy("basket", "sign").agg(F.count("*").alias("n"), F.max("chunk").alias("last")).where("n > 1")
        alone = chunks.join(several, ["basket", "sign"], "left_anti").select("items", "items", "fresh", "fresh", "sign", F.lit(True))
        parts = chunks.join(several, ["basket", "sign"]).select("basket", "sign", "chunk", "items", "fresh", F.explode(F.expr("sequence(0, last)")).alias("other"))
        # each pair of chunks meets under its own key: a basket spreads over all tasks, whose number is fixed here, as few bytes become many pairs
        tasks = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        keyed = parts.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).repartition(tasks, "basket", "i", "j")
        cells = keyed.groupBy("basket", "i", "j", "sign").agg(F.array_sort(F.collect_list(F.struct("chunk", "items", "fresh"))).alias("sides"))
        met = cells.where("i = j or size(sides) = 2").select(
            F.expr("sides[0].items"), F.expr("sides[size(sides) - 1].items"), F.expr("sides[0].fresh"), F.expr("sides[size(sides) - 1].fresh"), "sign", F.expr("i = j")
        )
        names = ["left", "right", "new_left", "new_right", "sign", "same"]
        return self._expanded(alone.toDF(*names).unionAll(met.toDF(*names))).groupBy("a", "b").agg(F.sum("delta").alias("delta")).where("delta <> 0")

    @staticmethod
    def _expanded(cells: DataFrame) -> DataFrame:
        """The pairs of two sorted lists, or of one with itself; a < b."""
        first = cells.where("new_left is null").select("right", "same", "sign", F.posexplode("left").alias("pos", "a"))
        whole = first.select("a", "sign", F.explode(F.expr("if(same, slice(right, pos + 2, size(right)), right)")).alias("b"))
        # fresh items of either side with all of the other; two fresh ones are a pair once
        fresh = cells.where("new_left is not null")
        one = fresh.select(F.explode("new_left").alias("a"), "right", "new_right", "sign", "same")
        ahead = one.select("a", "sign", F.explode(F.expr("if(same, filter(right, y -> y <> a and (y > a or not array_contains(new_right, y))), right)")).alias("b"))
        two = fresh.where("not same").select(F.explode("new_right").alias("b"), F.expr("array_except(left, new_left)").alias("left"), "sign")
        behind = two.select(F.explode("left").alias("a"), "sign", "b")
        both = whole.unionByName(ahead).unionByName(behind)
        return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("sign").cast("bigint").alias("delta"))

    def _merge(self, deltas: DataFrame, before: PairState) -> dict[int, str]:
        key = F.xxhash64("a", "b")
        if not before.pairs:
            return self._write(deltas.withColumnRenamed("delta", "together"), "pairs", key)
        staged = self._write(deltas, "deltas", key)
        new = self._read(list(staged.values()), "a bigint, b bigint, delta bigint").withColumnRenamed("delta", "together")
        merged = self._pairs(list(staged)).unionByName(new).groupBy("a", "b").agg(F.sum("together").alias("together")).where("together <> 0")
        return {b: p for b, p in before.pairs.items() if b not in staged} | self._write(merged, "pairs", key)

    # results -------------------------------------------------------------------------------------------------------------------------------

    def scores(self, min_together: int | None = None, min_lift: float | None = None) -> DataFrame:
        """``term_a < term_b, cooccurrence, lift, ppmi``: shared baskets, shared x all / (a x b), and its base-2 logarithm, 0 at least."""
        least, lift_least = self.state.min_together if min_together is None else min_together, self.state.min_lift if min_lift is None else min_lift
        items = self.items().select("item", "term", "n_baskets")
        pairs = self._pairs().where(F.col("together") >= max(1, least))
        first = pairs.join(items.select(F.col("item").alias("a"), F.col("term").alias("ta"), F.col("n_baskets").alias("na")), "a")
        both = first.join(items.select(F.col("item").alias("b"), F.col("term").alias("tb"), F.col("n_baskets").alias("nb")), "b")
        lift = F.col("together") * F.lit(float(self.state.total)) / (F.col("na") * F.col("nb").cast("double"))
        enough = F.col("together").cast("double") * F.lit(float(self.state.total)) >= F.lit(float(lift_least)) * F.col("na") * F.col("nb")
        return both.where(enough).select(
            F.least("ta", "tb").alias("term_a"), F.greatest("ta", "tb").alias("term_b"), F.col("together").alias("cooccurrence"),
            lift.alias("lift"), F.greatest(F.lit(0.0), F.log2(lift)).alias("ppmi"),
        )
