"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u) / w, with u a hash of its id and a seed and w its quality weight; ascending keys are a weighted sample without
replacement. A source's token budget is spent on complete epochs first; the rest is a prefix of the source in key order. The prefix is found without sorting a
source as a whole: keys are mapped to ``bins`` equal shares of [0, 1), token sums per (source, bin) are prefix-summed, whole bins below the budget are in, and only the
one bin that the budget ends in is sorted. So a source may hold any share of all rows.

A document longer than what is left of the rest is passed over, and the prefix goes on behind it with those that fit; if none is left, documents already in the
fractional selection are taken once more, up to the cap. Every such step is a threshold (level, length, key) for each source, so a document's repeats are a
function of its own row and of a few rows for its source; nothing is written a step. If documents are too long for their source's budget to be met all the same,
the size of the mixture is lowered to what the source that falls shortest can give, so the shares hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from math import inf

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.token_sizes import RANKS, token_size
from tessera.session import spread, written


def source_key(source: Column) -> Column:
    """The common spelling of a source: lower case, outer blanks removed, hyphens and blanks as underscores; null if blank."""
    key = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")
    return F.when(key != "", key)


def quality_weight(text: Column) -> Column:
    """A weight in (0, 1] from the text's form: the share of letters, less for texts under some 200 characters."""
    size = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    return F.greatest(F.lit(0.01), letters / F.greatest(size, F.lit(1)) * F.least(F.lit(1.0), (size + 20) / F.lit(220.0)))


def current_targets(targets: DataFrame) -> DataFrame:
    """``source, share, cap`` with shares that sum to 1. Rows with a null source or a share not above 0 are left out; a null cap means any number of repeats, one below 1 none;
    a source named twice keeps its larger share."""
    rows = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap"))
    rows = rows.where("source is not null and share > 0 and not isnan(share)").groupBy("source").agg(F.max_by(F.struct("share", "cap"), F.struct("share", "cap")).alias("r")).select("source", "r.*")
    return rows.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))


#: Targets beyond this number are refused: their budgets and thresholds pass through the driver.
MOST_TARGETS = 10_000
#: A share this near to its target is met.
NEAR = 0.005
_STAGES = "source string, trial int, gap bigint, level int, epochs bigint, stages array<struct<single boolean, level int, most bigint, edge int, key double, doc_id bigint, n_tokens bigint, row bigint>>"
#: A document's place in its source's order.
_ORDER = ("key", "doc_id", "n_tokens", "row")


@dataclass
class _Source:
    """What is asked of a source and what has been chosen from it so far."""

    name: str
    share: float
    even: float
    cap: int | None
    available: int
    docs: int
    weights: float
    trial: int = 0
    budget: int = 0
    epochs: int = 0
    gap: int = 0
    level: int = 0
    levels: int = 0
    open: bool = False
    stages: list[tuple] = field(default_factory=list)

    @property
    def most(self) -> float:
        """Tokens that the cap allows."""
        return inf if self.cap is None else max(self.cap, 0) * self.available

    @property
    def got(self) -> int:
        return self.budget - self.gap

    def start(self, total: float, tolerance: float, passes: int) -> None:
        self.budget = int(min(total * self.even, self.most))
        self.epochs, self.gap = divmod(self.budget, self.available) if self.available else (0, 0)
        self.levels = passes if self.cap is None else min(passes, self.cap - self.epochs)
        self.level, self.stages = 0, []
        self.open = self.levels > 0 and self.gap > tolerance * self.budget

    def take(self, tokens: int, stage: tuple, tolerance: float) -> None:
        self.stages.append(stage)
        self.gap -= tokens
        self.open = self.gap > tolerance * self.budget

    def rise(self) -> None:
        """All that fits at this level is taken: go on with the documents taken at it, if the cap lets them come once more."""
        taken = any(s[1] == self.level for s in self.stages)
        self.level += 1
        self.open = self.open and taken and self.level < self.levels


class Mixture:
    """A mixture of ``docs`` (``doc_id, text, source``) by ``targets`` (``source, target_share, max_repeats``).

    ``total_tokens`` is the size asked for, or ``"all"`` for the tokens of all targeted sources; by default the largest size, up to one token of mixture for each token
    of the targeted sources, at which every source with documents keeps its share within its cap. Shares of sources without documents go to the others in proportion. If a
    size is asked for that a source can't reach, the source gives all its cap allows and ``report`` shows the difference. Documents without tokens, without id, with a
    null source or of a source without target take no part. Repeated rows with one ``doc_id`` are one item each time.

    A budget counts as met within ``tolerance`` of it. The fractional rest may take a document up to ``passes`` times (within the cap) where longer documents don't fit.
    Where a share misses its target, lower sizes are tried, at last ``trials`` shares of the largest size together; the one whose shares come nearest to the targets holds.
    """

    def __init__(
        self, docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = 7, bins: int = 4096, ranks: str = RANKS, tolerance: float = 0.002, passes: int = 4, trials: int = 24
    ):
        self.spark, self.seed, self.bins, self.tolerance, self.passes, self.trials = docs.sparkSession, seed, bins, tolerance, passes, trials
        self.targets = written(current_targets(targets), "targets")
        columns = docs.select("doc_id", source_key(F.col("source")).alias("source"), "text")
        wanted = columns.where("doc_id is not null").join(F.broadcast(self.targets.select("source")), "source", "left_semi")
        sized = spread(wanted).select("doc_id", "source", token_size(F.col("text"), ranks).alias("n_tokens"), quality_weight(F.col("text")).alias("weight"))
        self.sized = written(sized.where("n_tokens > 0").withColumn("row", F.monotonically_increasing_id()), "sized")
        have = self.sized.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.count("*").alias("docs"), F.sum("weight").alias("weights"))
        rows = self.targets.join(have, "source", "left").orderBy("source").limit(MOST_TARGETS + 1).collect()
        if len(rows) > MOST_TARGETS:
            raise ValueError(f"more than {MOST_TARGETS} targets")
        here = sum(r.share for r in rows if r.available)
        self.sources = [_Source(r.source, r.share, r.share / here if r.available else 0.0, r.cap, r.available or 0, r.docs or 0, r.weights or 1.0) for r in rows]
        self._settle(total_tokens)

    # budgets -------------------------------------------------------------------------------------------------------------------------------

    def _settle(self, total_tokens: int | str | None) -> None:
        """Choose the size of the mixture and the thresholds of every source."""
        everything = sum(s.available for s in self.sources)
        live = self._live(self.sources)
        if total_tokens is not None or not live:
            self.sources = self._chosen([float(everything if total_tokens == "all" else total_tokens or 0)])[0]
            return
        largest = min([float(everything), *(s.most / s.even for s in live)])
        tried = self._chosen([largest])
        # as much as the source that falls shortest gives; then shares of the largest size
        for more in (lambda: [min(s.got / s.even for s in self._live(tried[0]))], lambda: [largest * k / (self.trials + 1) for k in range(1, self.trials + 1)]):
            if min(map(self._off, tried)) > NEAR:
                tried += self._chosen([x for x in more() if x >= 1])
        self.sources = min(tried, key=self._off)

    @staticmethod
    def _live(sources: list[_Source]) -> list[_Source]:
        return [s for s in sources if s.available and (s.cap is None or s.cap >= 1)]

    def _off(self, sources: list[_Source]) -> float:
        """The greatest distance of a share from its target."""
        live = self._live(sources)
        every = sum(s.got for s in live)
        return max(abs(s.got / every - s.even) for s in live) if every else inf

    def _chosen(self, totals: list[float]) -> list[list[_Source]]:
        """The sources with budgets and thresholds for each size; all sizes go through the same passes."""
        out = [[replace(s, trial=k, stages=[]) for s in self.sources] for k in range(len(totals))]
        states = {(s.name, s.trial): s for sources in out for s in sources}
        for s in states.values():
            s.start(totals[s.trial], self.tolerance, self.passes)
        while open_ := {k: s for k, s in states.items() if s.open}:
            self._step(open_)
        short = {k: s for k, s in states.items() if s.levels > 0 and s.gap > self.tolerance * s.budget}
        if short:  # the shortest document beyond the gap, if that comes nearer
            rest = self._placed(list(short.values())).where("extra < levels and n_tokens > gap")
            for r in rest.groupBy("source", "trial").agg(F.min(F.struct("n_tokens", "key", "doc_id", "row")).alias("m")).select("source", "trial", "m.*").collect():
                s = short[r.source, r.trial]
                if r.n_tokens - s.gap < s.gap:
                    s.take(r.n_tokens, (True, 0, 0, 0, r.key, r.doc_id, r.n_tokens, r.row), self.tolerance)
        return out

    def _placed(self, sources: list[_Source]) -> DataFrame:
        """The documents of some sources with key, bin, complete epochs and what the thresholds so far add; the table joined has a row a source."""
        rows = [(s.name, s.trial, s.gap, s.level, s.epochs, s.stages, s.levels, s.docs / s.weights) for s in sources]
        few = F.broadcast(self.spark.createDataFrame(rows, _STAGES + ", levels int, rate double"))
        uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(self.seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))
        keyed = self.sized.join(few, "source").withColumn("n_tokens", F.col("n_tokens").cast("bigint")).withColumn("key", -F.log(uniform) / F.col("weight"))
        # the mean weight scales keys, so that bins hold about equally many documents
        binned = keyed.withColumn("bin", F.least(F.floor((1 - F.exp(-F.col("key") / F.col("rate"))) * self.bins), F.lit(self.bins - 1)).cast("int"))
        place = "struct(key, doc_id, n_tokens, row)"
        mark = "struct(s.key, s.doc_id, s.n_tokens, s.row)"
        step = f"if(s.single, {place} = {mark}, n = s.level and n_tokens <= s.most and (bin < s.edge or bin = s.edge and {place} <= {mark}))"
        return binned.withColumn("extra", F.expr(f"aggregate(stages, 0, (n, s) -> n + int({step}))"))

    def _step(self, open_: dict[tuple[str, int], _Source]) -> None:
        """One prefix for each open source over the documents that fit its gap and are at its level."""
        fits = self._placed(list(open_.values())).where("extra = level and n_tokens <= gap")
        sums = fits.groupBy("source", "trial", "gap", "bin").agg(F.sum("n_tokens").alias("tokens"))
        upto = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source", "trial").orderBy("bin")))
        crossed = F.when(F.col("upto") > F.col("gap"), F.struct("bin", (F.col("upto") - F.col("tokens")).alias("before")))
        found = {(r.source, r.trial): r for r in upto.groupBy("source", "trial").agg(F.sum("tokens").alias("all"), F.min(crossed).alias("edge")).collect()}
        edges = [(*k, r.edge.bin, r.edge.before) for k, r in found.items() if r.edge]
        at = {}
        if edges:
            inside = fits.join(F.broadcast(self.spark.createDataFrame(edges, "source string, trial int, edge int, before bigint")), ["source", "trial"]).where("bin = edge")
            running = F.sum("n_tokens").over(Window.partitionBy("source", "trial").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0))
            rows = inside.select("source", "trial", "gap", F.struct(*_ORDER).alias("place"), (F.col("before") + running).alias("upto"))
            last = F.max(F.when(F.col("upto") <= F.col("gap"), F.struct("place", "upto")))
            over = F.min(F.when(F.col("upto") > F.col("gap"), F.struct("place", "upto")))
            at = {(r.source, r.trial): r for r in rows.groupBy("source", "trial").agg(last.alias("last"), over.alias("over")).collect()}
        for name, s in open_.items():
            r = found.get(name)
            if r is None:
                s.rise()
            elif not r.edge:
                s.take(r["all"], (False, s.level, s.gap, self.bins, 0.0, 0, 0, 0), self.tolerance)
                s.rise()
            else:
                last, over = at[name].last, at[name].over
                if over.upto - s.gap <= min(self.tolerance * s.budget, s.gap - (last.upto if last else r.edge.before)):
                    last = over
                place = tuple(last.place) if last else (-1.0, 0, 0, 0)
                s.take(last.upto if last else r.edge.before, (False, s.level, s.gap, r.edge.bin, *place), self.tolerance)

    # results -------------------------------------------------------------------------------------------------------------------------------

    def documents(self) -> DataFrame:
        """``source, doc_id, n_tokens, repeats``: the documents of the mixture and how often each is in it."""
        return self._placed(self.sources).select("source", "doc_id", F.col("n_tokens").cast("int").alias("n_tokens"), (F.col("epochs") + F.col("extra")).alias("repeats")).where("repeats > 0")

    def report(self) -> DataFrame:
        """Of each target: share asked for, tokens available, cap, budget, tokens and documents in the mixture, repeats, the share really reached, the tokens of the source that are
        not in the mixture at all, and why it falls short of its share of the size, if it does."""
        got = self.documents().groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.sum("n_tokens").alias("once"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats")
        )
        size = max((s.budget / s.even for s in self.sources if s.even and s.budget < s.most), default=0.0)
        rows = []
        for s in self.sources:
            why = "no documents" if not s.available else "cap" if s.budget + 1 < size * s.even else "documents too long" if s.gap > self.tolerance * s.budget else None
            rows.append((s.name, s.share, s.even, s.cap, s.available, s.budget, why))
        kinds = "source string, target_share double, share_with_documents double, cap int, available bigint, budget bigint, shortfall string"
        joined = self.spark.createDataFrame(rows, kinds).join(got, "source", "left").fillna(0, ["tokens", "once", "documents", "most_repeats"])
        share = F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0))
        return joined.select(
            "source", "target_share", "share_with_documents", "cap", "available", "budget", "tokens", "documents", "most_repeats", share.alias("actual_share"), (F.col("available") - F.col("once")).alias("left_out"), "shortfall"
        )
