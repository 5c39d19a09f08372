"""Graphs as edge tables ``src, dst, weight`` (undirected, src < dst): degrees, components, spanning trees, ranks and communities.

Iterations write their state to the shared folder each round, so their lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionAll(edges.select(F.col("dst"), F.col("src"), "weight"))


def strong_edges(edges: DataFrame, least: float) -> DataFrame:
    """Edges with a weight above ``least``; isolates go with their edges."""
    return edges.where(F.col("weight") > least)


def degrees(edges: DataFrame) -> DataFrame:
    """``node, degree, strength``."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """One row ``nodes, edges, density, mean_degree``."""
    d = degrees(edges).agg(F.count("*").alias("nodes"), (F.coalesce(F.sum("degree"), F.lit(0)) / 2).cast("bigint").alias("edges"))
    n = F.col("nodes")
    return d.select("nodes", "edges", F.when(n > 1, 2 * F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2 * F.col("edges") / n).otherwise(0.0).alias("mean_degree"))


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """``node, component`` (its least node), by minimum labels with pointer jumping; rounds grow with the logarithm of the diameter."""
    pairs = written(both_ways(edges).select("src", "dst").distinct(), "pairs")
    labels = written(pairs.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(most):
        near = pairs.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(near, "node").select("node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jumped = lower.alias("l").join(labels.select(F.col("node").alias("at"), F.col("component").alias("next")), F.col("l.component") == F.col("at"), "left")
        fresh = written(jumped.select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "old"), "labels")
        changed = fresh.where("component <> old").limit(1).count()
        labels = fresh.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")


def maximum_spanning_tree(edges: DataFrame, most: int = 40) -> DataFrame:
    """The edges of a maximum spanning forest (Borůvka): each round every component takes its heaviest edge to another (ties by names) and components merge."""
    rest = written(edges.where("src <> dst").select("src", "dst", "weight"), "rest")
    labels = degrees(rest).select("node", F.col("node").alias("component"))
    chosen: DataFrame | None = None
    for _ in range(most):
        a = labels.select(F.col("node").alias("src"), F.col("component").alias("ca"))
        b = labels.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
        across = written(rest.join(a, "src").join(b, "dst").where("ca <> cb"), "across")
        if across.isEmpty():
            break
        order = F.struct(F.col("weight"), F.col("src"), F.col("dst"))
        sided = across.select(F.col("ca").alias("c"), order.alias("e")).unionAll(across.select(F.col("cb").alias("c"), order.alias("e")))
        picked = sided.groupBy("c").agg(F.max("e").alias("e")).select("e.*").distinct()
        chosen = written(picked if chosen is None else chosen.unionByName(picked).distinct(), "chosen")
        merged = components(chosen)
        labels = written(labels.join(merged.withColumnRenamed("component", "c"), "node", "left").select("node", F.coalesce("c", "component").alias("component")), "labels")
        rest = across.select("src", "dst", "weight")
    return chosen if chosen is not None else edges.limit(0).select("src", "dst", "weight")


def pagerank(edges: DataFrame, rounds: int = 30, damping: float = 0.85) -> DataFrame:
    """``node, rank`` by weighted PageRank on the undirected graph."""
    out = written(both_ways(edges), "out")
    total = out.groupBy("src").agg(F.sum("weight").alias("total"))
    nodes = written(total.select(F.col("src").alias("node")), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    shares = written(out.join(total, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")), "shares")
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        sums = shares.join(ranks, shares.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("s"))
        ranks = nodes.join(sums, nodes.node == sums.dst, "left").select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
        if k % 5 == 4:
            ranks = written(ranks, "ranks")
    return ranks


def label_propagation(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, community``: each node takes the label with the greatest weight around it (ties by the least label); rounds alternate between halves of the nodes, so that
    labels settle. A warning says if some still moved in the last round."""
    out = written(both_ways(edges), "out")
    labels = out.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for k in range(rounds):
        near = out.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src", "community").agg(F.sum("weight").alias("w"))
        best = near.groupBy("src").agg(F.min_by("community", F.struct((-F.col("w")).alias("w"), "community")).alias("best"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        fresh = written(labels.join(best, labels.node == best.src, "left").select("node", F.when(turn, F.coalesce("best", "community")).otherwise(F.col("community")).alias("community"), F.col("community").alias("old")), "labels")
        moved = fresh.where("community <> old").limit(1).count()
        labels = fresh.select("node", "community")
        if not moved and k % 2:
            return labels
    warnings.warn(f"labels still moved after {rounds} rounds", stacklevel=2)
    return labels


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row ``modularity`` of a partition ``node, community``."""
    total = edges.agg(F.sum("weight")).scalar()
    a, b = communities.select(F.col("node").alias("src"), F.col("community").alias("ca")), communities.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = edges.join(a, "src").join(b, "dst").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("inside"))
    strength = degrees(edges).join(communities, "node").groupBy("community").agg(F.sum("strength").alias("strength"))
    rows = strength.join(inside, "community", "left").fillna(0, ["inside"])
    return rows.agg(F.sum(F.col("inside") / total - (F.col("strength") / (2 * total)) ** 2).alias("modularity"))


def thematic_map(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """``community, size, centrality, density, quadrant``: weight to other communities over all weight, inner weight over possible pairs, and the quadrants by their medians."""
    total = edges.agg(F.sum("weight")).scalar()
    a, b = communities.select(F.col("node").alias("src"), F.col("community").alias("ca")), communities.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    placed = edges.join(a, "src").join(b, "dst")
    ends = placed.select(F.col("ca").alias("community"), F.expr("if(ca = cb, weight, 0)").alias("inner_w"), F.expr("if(ca = cb, 0, weight)").alias("outer_w"))
    ends = ends.unionAll(placed.where("ca <> cb").select(F.col("cb"), F.lit(0), F.col("weight")))
    sizes = communities.groupBy("community").agg(F.count("*").alias("size"))
    rows = sizes.join(ends.groupBy("community").agg(F.sum("inner_w").alias("i"), F.sum("outer_w").alias("o")), "community", "left").fillna(0, ["i", "o"])
    n = F.col("size")
    rows = rows.select("community", "size", (F.col("o") / total).alias("centrality"), F.when(n > 1, F.col("i") / (n * (n - 1) / 2)).otherwise(0.0).alias("density"))
    medians = rows.agg(F.expr("percentile(centrality, 0.5)").alias("c"), F.expr("percentile(density, 0.5)").alias("d"))
    central, dense = F.col("centrality") >= medians.select("c").scalar(), F.col("density") >= medians.select("d").scalar()
    return rows.withColumn("quadrant", F.when(central & dense, "motor").when(central, "basic").when(dense, "specialised").otherwise("emerging"))


def budget_edges(pairs: DataFrame, most_nodes: int, most_pairs: int = 2_000_000) -> DataFrame:
    """The edges accepted when pairs (``term_a, term_b, n, ppmi``) are scanned by strength and one is taken only while distinct nodes stay within ``most_nodes``.

    The scan is sequential by nature and streams the pairs through the driver in their order; more than ``most_pairs`` are refused.
    """
    if pairs.limit(most_pairs + 1).count() > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs")
    seen: set[str] = set()
    taken = []
    for r in pairs.orderBy(F.desc("ppmi"), F.desc("n"), "term_a", "term_b").toLocalIterator():
        fresh = {r.term_a, r.term_b} - seen
        if len(seen) + len(fresh) <= most_nodes:
            seen |= fresh
            taken.append((r.term_a, r.term_b, float(r.ppmi)))
    return pairs.sparkSession.createDataFrame(taken, "src string, dst string, weight double")


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    """Edges among the ``k`` heaviest of one of their ends: how dense graphs are thinned before drawing."""
    sided = both_ways(edges)
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    kept = sided.withColumn("place", place).where(F.col("place") <= k)
    return kept.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").distinct()
