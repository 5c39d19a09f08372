"""Word networks: thresholds by corpus size, thinning, bridging, concept discovery and agglomerative clustering."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import fold
from tessera.operators.graph import both_ways, components, degrees, maximum_spanning_tree


@dataclass(frozen=True)
class Thresholds:
    min_freq: int
    min_cooc: int
    edge_threshold: int


#: Token counts up to which each set of thresholds holds; the last has no limit.
PROFILES = ((1500, Thresholds(1, 1, 0)), (8000, Thresholds(2, 2, 1)), (30_000, Thresholds(3, 3, 1)), (90_000, Thresholds(4, 4, 2)), (None, Thresholds(5, 5, 3)))
#: Node counts up to which each mean degree is aimed at.
MEAN_DEGREES = ((70, 11), (120, 12), (220, 13), (None, 14))


def thresholds(n_tokens: int) -> Thresholds:
    """The thresholds for a corpus of this many tokens."""
    return next(t for most, t in PROFILES if most is None or n_tokens <= most)


def vocabulary_words(toks: DataFrame, t: Thresholds, key: str = "doc_id") -> DataFrame:
    """``key, w``: the tokens of each document that are met ``min_freq`` times and more in the corpus, in order; windows are laid over these. ``toks`` is ``key, pos, form``."""
    often = toks.groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= t.min_freq).select("form")
    kept = toks.join(often, "form", "left_semi")
    return kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "form"))), lambda x: x["form"]).alias("w"))


def word_network(pairs: DataFrame, t: Thresholds) -> DataFrame:
    """``src, dst, weight`` of windowed pairs (``term_a, term_b, n_ref``) with at least ``min_cooc`` and more than ``edge_threshold``."""
    kept = pairs.where((F.col("n_ref") >= t.min_cooc) & (F.col("n_ref") > t.edge_threshold))
    return kept.select(F.col("term_a").alias("src"), F.col("term_b").alias("dst"), F.col("n_ref").cast("double").alias("weight"))


def balanced(edges: DataFrame) -> DataFrame:
    """Edges thinned to about max(2n, mean degree x n / 2): each node's best edge and a maximum spanning forest always stay, the heaviest others fill up."""
    n = degrees(edges).count()
    mean = next(d for most, d in MEAN_DEGREES if most is None or n <= most)
    aim = max(2 * n, round(mean * n / 2))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    best = both_ways(edges).withColumn("p", place).where("p = 1").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    kept = maximum_spanning_tree(edges).select("src", "dst").unionByName(best).distinct().withColumn("kept", F.lit(1))
    ranked = edges.join(kept, ["src", "dst"], "left").orderBy(F.col("kept").isNull(), F.desc("weight"), "src", "dst")
    least = kept.count()
    return ranked.limit(max(aim, least)).select("src", "dst", "weight")


def reinforced(edges: DataFrame, raw: DataFrame, quantile: float = 0.25, min_degree: int = 2) -> DataFrame:
    """Adds, for nodes whose strength is at most the quantile, their best raw edges to nodes of the network, up to ``min_degree`` a node."""
    d = degrees(edges)
    bound = d.agg(F.percentile_approx("strength", quantile, 10_000)).scalar()
    weak = d.where(F.col("strength") <= bound).select(F.col("node").alias("src"), "degree")
    nodes = d.select(F.col("node").alias("dst"))
    spare = both_ways(raw).join(weak, "src").join(nodes, "dst", "left_semi").join(both_ways(edges).select("src", "dst"), ["src", "dst"], "left_anti")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    extra = spare.withColumn("p", place).where(F.col("p") + F.col("degree") <= min_degree)
    return edges.select("src", "dst", "weight").unionByName(extra.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")).distinct()


def bridged(edges: DataFrame, raw: DataFrame, most: int = 20) -> DataFrame:
    """Adds at most ``most`` bridges between components: the best raw edges on a maximum spanning tree of the components."""
    labels = components(edges)
    a, b = labels.select(F.col("node").alias("src"), F.col("component").alias("ca")), labels.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    across = raw.join(a, "src").join(b, "dst").where("ca <> cb").select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"), F.struct("weight", "src", "dst").alias("e"))
    best = across.groupBy("x", "y").agg(F.max("e").alias("e"))
    tree = maximum_spanning_tree(best.select(F.col("x").alias("src"), F.col("y").alias("dst"), F.col("e.weight").alias("weight")))
    found = best.join(tree.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"]).select("e.src", "e.dst", "e.weight").orderBy(F.desc("weight"), "src", "dst").limit(most)
    return edges.select("src", "dst", "weight").unionByName(found)


#: Words of the academic trade that are noise among concepts.
ACADEMIC_NOISE = (
    "universidade federal estadual santa catarina florianopolis ufsc usp ufmg ufrj instituto departamento faculdade programa campus centro laboratorio laboratório pesquisador pesquisadora "
    "resumo abstract palavraschave keywords revista periodico periódico editora edicao edição volume numero número suplemento issn doi orcid email http https www com org br "
    "jan fev mar abr mai jun jul ago set out nov dez january february march april may june july august september october november december"
).split()
#: Words that are never concepts.
HARD_NOISE = "doi issn orcid http https www email".split()


def candidate_words(dtm: DataFrame, key: str = "doc_id", min_freq: int = 3, capitals: DataFrame | None = None, foreign: DataFrame | None = None) -> DataFrame:
    """``form, freq, dispersion, dominance, noise, score`` of concept words.

    Dispersion is the share of documents with the word, dominance the share of its largest document. Noise adds up: .42 for academic words, .10 for up to three letters, .06 for
    compounds, .14 under a dispersion of .12, up to .28 for a dominance above .80, .50 for words mostly in capitals (``capitals``: form, capitalised) and .20 more for those that are
    so throughout and widespread, .28 for words of another language (``foreign``: form); .88 at most. score = freq x (.42 + .90 dispersion + .18 (1 - dominance), .1 at least) x (1 - noise, .05 at least).
    """
    docs = dtm.agg(F.count_distinct(key)).scalar()
    sums = dtm.groupBy("form").agg(F.sum("n").alias("freq"), F.count("*").alias("docs"), F.max("n").alias("most")).where((F.col("freq") >= min_freq) & ~F.col("form").isin(HARD_NOISE))
    sums = sums.withColumn("capital", F.lit(0.0)) if capitals is None else sums.join(capitals.select("form", "capitalised"), "form", "left").withColumn("capital", F.least(F.lit(1.0), F.coalesce("capitalised", F.lit(0)) / F.col("freq")))
    sums = sums.withColumn("foreign", F.lit(False)) if foreign is None else sums.join(foreign.select("form").distinct().withColumn("foreign", F.lit(True)), "form", "left").fillna(False, ["foreign"])
    out = sums.withColumns({"dispersion": F.col("docs") / docs, "dominance": F.col("most") / F.col("freq")})
    often, wide = F.col("freq") >= 2, F.col("freq") >= 3
    parts = [
        F.when(F.col("form").isin(ACADEMIC_NOISE), 0.42), F.when(F.length("form") <= 3, 0.10), F.when(F.col("form").rlike("[_-]"), 0.06), F.when(F.col("dispersion") < 0.12, 0.14),
        F.when(F.col("dominance") > 0.80, F.least(F.lit(0.28), (F.col("dominance") - 0.80) * 1.2)), F.when(often & (F.col("capital") >= 0.88), 0.50),
        F.when(wide & (F.col("capital") >= 0.95) & (F.col("dispersion") >= 0.35), 0.20), F.when(F.col("foreign"), 0.28),
    ]
    noise = F.least(F.lit(0.88), sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)))
    rows = out.select("form", "freq", "dispersion", "dominance", noise.alias("noise"))
    spread = F.greatest(F.lit(0.1), 0.42 + 0.90 * F.col("dispersion") + 0.18 * (1 - F.col("dominance")))
    return rows.withColumn("score", F.col("freq") * spread * F.greatest(F.lit(0.05), 1 - F.col("noise")))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Orthographic similarity of two words, 0 to 1."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def orthographic_edges(words: DataFrame, least: float = 0.84, prefix: int = 4) -> DataFrame:
    """``src, dst, weight``: words with one folded prefix that are written alike."""
    w = words.select("form", F.substring(fold(F.col("form")), 1, prefix).alias("block"))
    pairs = w.select("block", F.col("form").alias("src")).join(w.select("block", F.col("form").alias("dst")), "block").where("src < dst")
    return pairs.withColumn("weight", similarity("src", "dst")).where(F.col("weight") >= least).select("src", "dst", "weight")


def concept_confidence(edges: DataFrame, communities: DataFrame, words: DataFrame, least: float = 0.8) -> DataFrame:
    """``community, form, confidence, kept`` of words in communities: .42 purity (inner share of strength) + .27 centrality (strength over the community's largest) + .15 frequency and
    .09 dispersion (against the largest) - .08 dominance - .10 noise, within 0 and 1; kept from ``least``."""
    place = communities.select(F.col("node").alias("dst"), F.col("community").alias("other"))
    ends = both_ways(edges).join(place, "dst").join(communities.withColumnRenamed("node", "src"), "src")
    sums = ends.groupBy(F.col("src").alias("form"), "community").agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("other") == F.col("community"), F.col("weight")).otherwise(0.0)).alias("inner"))
    group = Window.partitionBy("community")
    rows = sums.join(words, "form").withColumn("central", F.col("all") / F.max("all").over(group)).withColumn("often", F.col("freq") / F.max("freq").over(group))
    value = 0.42 * F.col("inner") / F.col("all") + 0.27 * F.col("central") + 0.15 * F.col("often") + 0.09 * F.col("dispersion") - 0.08 * F.col("dominance") - 0.10 * F.col("noise")
    bounded = F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))
    return rows.select("community", "form", bounded.alias("confidence"), (bounded >= least).alias("kept"))


def hierarchical(cells: DataFrame, row: str, col: str, value: str, k: int, most: int = 2000) -> DataFrame:
    """``row, cluster`` by average-linkage clustering on Euclidean distances of the rows of a long matrix; refused above ``most`` rows."""
    names = [r[0] for r in cells.select(row).distinct().orderBy(row).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} rows")
    x = cells.select(F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).cast("double").alias("v")).groupBy("r", "c").agg(F.sum("v").alias("v"))
    squares = {r[0]: r[1] for r in x.groupBy("r").agg(F.sum(F.col("v") ** 2)).collect()}
    packed = x.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("xs"))
    first = packed.select("xs", F.posexplode("xs").alias("i", "a"))
    dots = first.select("a", F.explode(F.expr("slice(xs, i + 2, size(xs))")).alias("b")).groupBy(F.col("a.r").alias("x"), F.col("b.r").alias("y")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("d"))
    at = {n: i for i, n in enumerate(names)}
    s = np.array([squares.get(n, 0.0) for n in names])
    d2 = s[:, None] + s[None, :]
    for a, b, d in dots.collect():  # at most most^2 / 2 rows
        d2[at[a], at[b]] -= 2 * d
        d2[at[b], at[a]] -= 2 * d
    dist = np.sqrt(np.maximum(d2, 0.0))
    np.fill_diagonal(dist, np.inf)
    size, label, live = np.ones(len(names)), list(range(len(names))), set(range(len(names)))
    while len(live) > max(1, k):
        i, j = sorted(np.unravel_index(int(np.argmin(dist)), dist.shape))
        merged = (dist[i] * size[i] + dist[j] * size[j]) / (size[i] + size[j])
        dist[i], dist[:, i] = merged, merged
        dist[i, i] = np.inf
        dist[j], dist[:, j] = np.inf, np.inf
        size[i] += size[j]
        live.discard(int(j))
        label = [i if c == j else c for c in label]
    numbers = {c: n for n, c in enumerate(dict.fromkeys(label))}
    return cells.sparkSession.createDataFrame([(n, numbers[c]) for n, c in zip(names, label)], f"{row} string, cluster int")
