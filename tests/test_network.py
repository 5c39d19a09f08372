from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph, network, tables

EDGES = [("a", "b", 9.0), ("a", "c", 8.0), ("b", "c", 7.0), ("c", "d", 1.0), ("x", "y", 6.0), ("d", "x", 0.5), ("a", "x", 0.25)]


def edges(spark, rows=EDGES):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_thresholds():
    assert network.thresholds(0).min_freq == 1 and network.thresholds(1501).min_cooc == 2 and network.thresholds(10**9).edge_threshold == 3


def test_thinning_keeps_the_network_whole(spark):
    e = edges(spark)
    thin = network.balanced(e)
    assert graph.components(thin).select("component").distinct().count() == 1
    assert thin.count() <= e.count()


def test_bridges(spark):
    strong = graph.strong_edges(edges(spark), 5)
    joined = {(r.src, r.dst): r.weight for r in network.bridged(strong, edges(spark)).collect()}
    assert set(joined) == {("a", "b"), ("a", "c"), ("b", "c"), ("x", "y"), ("a", "x")}
    more = network.reinforced(strong, edges(spark), 0.5, 2)
    assert more.count() >= strong.count()


def test_concepts(spark):
    dtm = spark.createDataFrame([(1, "casa", 3), (2, "casa", 2), (1, "b2b", 5)], "doc_id bigint, form string, n bigint")
    words = {r.form: r for r in network.candidate_words(dtm).collect()}
    assert words["casa"].noise == 0 and words["casa"].dispersion == 1 and words["b2b"].noise > 0.3
    two = spark.createDataFrame([("política",), ("políticas",), ("poltrona",)], "form string")
    assert [(r.src, r.dst) for r in network.orthographic_edges(two).collect()] == [("política", "políticas")]


def test_hierarchical(spark):
    cells = spark.createDataFrame([("p", "u", 1.0), ("q", "u", 1.1), ("r", "v", 9.0), ("s", "v", 9.5), ("s", "w", 1.0)], "r string, c string, v double")
    got = {r.r: r.cluster for r in network.hierarchical(cells, "r", "c", "v", 2).collect()}
    assert got["p"] == got["q"] != got["r"] == got["s"]


def test_tables_of_lemmas_and_classes(spark):
    dtm = spark.createDataFrame([(1, "ia", 2), (1, "foi", 1), (2, "x", 4)], "doc_id bigint, form string, n bigint")
    lex = spark.createDataFrame([("ia", "ir", "ver"), ("foi", "ir", "ver")], "form string, lemma string, gram string")
    groups = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, grp string")
    assert sorted(map(tuple, tables.gram_table(dtm, lex, groups).collect())) == [("nr", "b", 4), ("ver", "a", 3)]
    assert sorted(map(tuple, tables.lemma_postings(dtm, lex, "doc_id").collect())) == [("ir", 1, 3), ("x", 2, 4)]
    p = spark.createDataFrame([(1, "a", 9.0), (1, "b", 8.0), (2, "c", 7.0)], "class_id int, form string, chi2 double")
    q = p.withColumn("class_id", 3 - F.col("class_id"))
    assert sorted(map(tuple, tables.matched_classes(p, q).collect())) == [(1, 2, 1.0), (2, 1, 1.0)]
