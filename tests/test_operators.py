from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions.tokenizers import tokenize, tokens
from tessera.operators import contexts, cooccurrence, corpus, correspondence, fuzzy, graph, lexicon, ngrams, phrases, reinert, segments, small_graph, tables, topics
from tessera.plans import queries


def rows(df, *by):
    return [tuple(r) for r in (df.orderBy(*by) if by else df).collect()]


def test_corpus(spark, docs):
    r = corpus.corpus_statistics(docs).first()
    assert (r.n_docs, r.n_forms, r.n_occurrences, r.n_hapax) == (5, 5, 12, 2)
    assert rows(corpus.top_forms(corpus.form_counts(tokens(docs)), 2)) == [("azul", 5, 3), ("casa", 3, 1)]
    assert rows(corpus.document_sizes(docs), "doc_id") == [(1, 7), (2, 0), (3, 0), (4, 3), (5, 3)]
    assert rows(corpus.metadata(docs).where("doc_id in (3, 5)"), "doc_id", "variable") == [(3, "grupo", "b"), (5, "grupo", "b"), (5, "sexo", "f")]
    sub = corpus.subcorpus(docs, corpus.metadata(docs), "grupo", ["b"])
    assert [(r.doc_id, r.uci_id) for r in sub.orderBy("doc_id").collect()] == [(3, 0), (4, 1), (5, 2)]


def test_empty_corpus(spark, docs):
    none = docs.where("false")
    assert corpus.corpus_statistics(none).first().n_docs == 0
    assert rows(corpus.top_forms(corpus.form_counts(tokens(none)), 5)) == []
    assert rows(cooccurrence.windowed(none.select(tokenize(F.col("text")).alias("w")))) == []


def tie_cut(freqs, most):
    """The cut by walking down the ranks."""
    f = sorted(freqs, reverse=True)
    if len(f) <= most:
        return f
    t = f[most - 1]
    bound = t + 1 if f.count(t) > 1 and t + 1 in f else t
    return [x for x in f if x > bound]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(1, 6), min_size=1, max_size=14), st.integers(1, 10))
def test_tie_cut(spark, freqs, most):
    df = spark.createDataFrame([(f"w{k}", x) for k, x in enumerate(freqs)], "form string, freq bigint")
    assert sorted((r.freq for r in corpus.tie_cut(df, most).collect()), reverse=True) == tie_cut(freqs, most)


def test_tables(spark):
    dtm = spark.createDataFrame([(0, "educacao", 3), (0, "escola", 2), (0, "politica", 1), (0, "saude", 1), (1, "seguranca", 2), (1, "violencia", 2), (1, "dados", 1), (1, "escola", 1)], "doc_id bigint, form string, n bigint")
    groups = spark.createDataFrame([(0, "a"), (1, "b")], "doc_id bigint, grp string")
    t = tables.lexical_table(dtm, groups)
    s = {(r.form, r.grp): r for r in tables.specificities(t).collect()}
    assert s["educacao", "a"].score > 0 and s["escola", "b"].score < 0 and ("educacao", "b") not in s
    h = {(r.form, r.grp): r.score for r in tables.specificities(t, "hypergeo").collect()}
    assert all((h[k] >= 0) == (s[k].score >= 0) for k in h)
    k = {r.form: r for r in tables.keyness(dtm, groups.where("grp = 'a'"), min_freq=1).collect()}
    assert k["educacao"].direction == "A" and k["seguranca"].direction == "B"
    cats = spark.createDataFrame([("A", "F"), ("A", "M"), ("B", "F"), ("B", "M"), ("B", "M"), ("C", None), (None, " ")], "g string, s string")
    cells = tables.crosstab(cats, "g", "s")
    assert cells.agg(F.sum("n")).first()[0] == 7 and cells.count() == 16
    assert rows(tables.category_frequencies(cats, "g", 2)) == [("B", 3, 60.0), ("A", 2, 40.0)]
    two = cats.where("g in ('A', 'B')")
    plain, yates = tables.chi2_test(two, "g", "s", False).first(), tables.chi2_test(two, "g", "s").first()
    assert plain.dof == 1 and yates.chi2 < plain.chi2 and 0 < plain.p < 1
    same = spark.createDataFrame([(x, x) for x in "aabbc"], "x string, y string")
    r = tables.partition_agreement(same, "x", "y").first()
    assert r.ari == pytest.approx(1) and r.nmi == pytest.approx(1)


def test_contexts(spark, docs):
    hits = rows(contexts.kwic(docs, "azul", 2), "doc_id", "pos")
    assert hits[0] == (1, 3, ["branca", "casa"], "azul", ["Não", "é"]) and len(hits) == 5
    assert [r.match for r in contexts.concordance(docs, "casa", 5).orderBy("hit").collect()] == ["Casa", "casa", "casa"]
    d = {r.form: r.juilland_d for r in contexts.dispersion(corpus.document_terms(tokens(docs)), docs).collect()}
    x = np.array([0, 0, 1, 2, 2])
    assert d["azul"] == pytest.approx(round(max(0, 1 - x.std() / x.mean() / 2), 4))
    stream = [w for w in ("casa", "branca", "casa", "azul", "não", "casa", "azul", "azul", "céu", "azul", "azul", "céu")]
    got = rows(contexts.rolling(tokens(docs), F.col("form") == "azul", 4, 2, "raw_count"), "center")
    assert got == [(s + 2, float(stream[s : s + 4].count("azul"))) for s in range(0, len(stream) - 3, 2)]
    assert rows(contexts.trend_codes(contexts.document_bins(tokens(docs), ["azul"], 2), 2), "doc_id") == [(1, "azul", 1, "09"), (4, "azul", 2, "90"), (5, "azul", 2, "90")]


def test_windowed_pairs_against_loops(spark):
    rnd = random.Random(3)
    lines = [[rnd.choice("abcde") for _ in range(rnd.randint(0, 12))] for _ in range(20)]
    want: dict = {}
    for w in lines:
        for i, a in enumerate(w):
            for b in w[i + 1 : i + 4]:
                if a != b:
                    want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + 1
    df = spark.createDataFrame([(w,) for w in lines], "w array<string>")
    assert {(r.term_a, r.term_b): r.n_pairs for r in cooccurrence.windowed(df, 3).collect()} == want


def test_presence_blocks_and_contingency(spark):
    rnd = random.Random(5)
    units = {(u, rnd.choice("abcdefghij")) for u in range(12) for _ in range(6)}
    df = spark.createDataFrame(list(units), "uce_id bigint, form string")
    vocab = df.select("form").distinct()
    want = {}
    for u in range(12):
        held = sorted(f for x, f in units if x == u)
        for i, a in enumerate(held):
            for b in held[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    for block in (2, 128):
        assert {(r.term_a, r.term_b): r.n for r in cooccurrence.presence(df, vocab, block=block).collect()} == want
    check = cooccurrence.validate_contingency(cooccurrence.contingency(df, vocab, full=True)).first()
    assert (check.bad_sum, check.negative, check.bad_order) == (0, 0, 0)
    assert all(r.ppmi >= 0 for r in cooccurrence.ppmi(cooccurrence.presence(df, vocab)).collect())


def test_labbe(spark):
    t = spark.createDataFrame([("x", "a", 4), ("x", "b", 2), ("y", "a", 2), ("y", "c", 1)], "k string, form string, n bigint")
    # x is scaled by 1/2: a 2, b 1; y: a 2, c 1 -> |2-2| + 1 (c) + 1 (b >= 1) over 3 + 3
    assert rows(cooccurrence.labbe(t, "k")) == [("x", "y", pytest.approx(2 / 6))]


def test_ngrams(spark, docs):
    assert {(r.w1, r.w2): r.freq for r in ngrams.ngram_counts(docs, 2).collect()} == {("azul", "azul"): 2, ("azul", "céu"): 2}
    tree = {(r.side, r.path): r.freq for r in ngrams.word_tree(docs, "azul").collect()}
    assert tree["right", "céu"] == 2 and tree["right", "azul céu"] == 2
    edges = ngrams.bigram_edges(spark.createDataFrame([("a", "b", 5), ("b", "a", 3)], "w1 string, w2 string, freq bigint"))
    assert rows(edges) == [("a", "b", 3)]


def test_lexicon(spark):
    lex = lexicon.prepare_lexicon(spark.createDataFrame([(0, "ação", "ação", "nom"), (1, "ir", "ir", "ver"), (2, "ir", "IR", "ver")], "pos bigint, word string, lemma string, gram string"))
    forms = spark.createDataFrame([("ações",), ("acao",), ("ir",), ("12",), ("zzz",)], "form string")
    got = {r.form: (r.lemma, r.gram, r.act) for r in lexicon.lookup(forms, lex).collect()}
    assert got == {"ações": ("ação", "nom", 1), "acao": ("ação", "nom", 1), "ir": ("IR", "ver", 1), "12": ("12", "num", 2), "zzz": ("zzz", "nr", 1)}
    assert {r.form: r.lemma for r in lexicon.lookup(forms, lex, strict=True).collect()}["ações"] == "ações"
    stop = spark.createDataFrame([("não",)], "form string")
    toks = spark.createDataFrame([("nao",), ("não",), ("sim",)], "form string")
    assert rows(lexicon.without_stopwords(toks, stop)) == [("sim",)]


def test_unit_groups(spark):
    sizes = spark.createDataFrame([(1, k, n) for k, n in enumerate([5, 8, 3, 9, 20, 1])] + [(2, 0, 1)], "doc_id bigint, seg bigint, size int")
    assert rows(segments.unit_groups(sizes, 12), "doc_id", "seg") == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 5, 2), (2, 0, 0)]


def test_merge_phrases(spark):
    df = spark.createDataFrame([(["a", "b", "c", "a", "b"],), (None,), ([],)], "w array<string>")
    got = [r[0] for r in df.select(segments.merge_phrases(F.col("w"), [("a", "b"), ("a", "b", "c")])).collect()]
    assert got == [["a_b_c", "a_b"], None, []]


EDGES = [("a", "b", 5.0), ("b", "c", 4.0), ("a", "c", 1.0), ("x", "y", 2.0), ("y", "z", 3.0), ("c", "d", 2.5)]


def test_graph(spark):
    e = spark.createDataFrame(EDGES, "src string, dst string, weight double")
    assert {r.node: r.component for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x", "z": "x"}
    assert sorted((r.src, r.dst) for r in graph.maximum_spanning_tree(e).collect()) == [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "z")]
    assert {r.node: (r.degree, r.strength) for r in graph.degrees(e).collect()}["c"] == (3, 7.5)
    ranks = {r.node: r.rank for r in graph.pagerank(e, 12).collect()}
    assert sum(ranks.values()) == pytest.approx(1, abs=1e-6) and ranks["b"] > ranks["d"]
    found = {r.node: r.community for r in small_graph.louvain(e).collect()}
    assert found["a"] == found["b"] != found["x"] == found["y"]
    between = {r.node: r.betweenness for r in small_graph.path_measures(e).collect()}
    assert between["y"] > 0 and between["x"] == 0
    assert sum(r.score**2 for r in small_graph.eigenvector(e).collect()) == pytest.approx(1)
    assert small_graph.louvain(e.where("false")).count() == 0


def test_fuzzy(spark):
    forms = spark.createDataFrame([("política", 5), ("politica", 2), ("politicas", 1), ("polo", 3)], "form string, freq bigint")
    pairs = {(r.form_a, r.form_b): r.distance for r in fuzzy.close_pairs(forms).collect()}
    assert pairs == {("politica", "política"): 0, ("politica", "politicas"): 1, ("politicas", "política"): 1}
    assert [(r.canonical, r.form) for r in fuzzy.variant_groups(forms, fuzzy.fingerprint(F.col("form"))).orderBy("form").collect()] == [("política", "politica"), ("política", "política")]


def test_correspondence(spark):
    n = np.array([[20, 5, 2], [4, 18, 6], [3, 7, 25], [10, 10, 1]])
    t = spark.createDataFrame([(f"f{i}", f"g{j}", int(n[i, j])) for i in range(4) for j in range(3)], "form string, grp string, n bigint")
    ca = correspondence.correspondence(t)
    p = n / n.sum()
    r, c = p.sum(1), p.sum(0)
    s = np.linalg.svd((p - np.outer(r, c)) / np.sqrt(np.outer(r, c)), compute_uv=False) ** 2
    assert [x.eigenvalue for x in ca["eigenvalues"].orderBy("axis").collect()] == pytest.approx(list(s[:2]))
    coords = {x.label: x.coordinate for x in ca["rows"].where("axis = 1").collect()}
    assert sum(r[i] * coords[f"f{i}"] ** 2 for i in range(4)) == pytest.approx(s[0])


def themes(n_themes=3, per=14):
    rnd = random.Random(1)
    out = []
    for k in range(n_themes * per):
        theme = k // per
        out += [(k, f"t{theme}w{i}") for i in rnd.sample(range(10), 6)] + [(k, w) for w in rnd.sample(["pesquisa", "analise"], 1)]
    return out


def test_reinert(spark, monkeypatch):
    x = spark.createDataFrame(themes(), "uce_id bigint, form string")
    classes, nodes = reinert.classify(x, 3)
    groups = {}
    for r in classes.collect():
        groups.setdefault(r.uce_id // 14, set()).add(r.class_id)
    assert all(len(v) == 1 for v in groups.values()) and len(set.union(*groups.values())) == 3
    assert sum(n.split_chi2 is not None for n in nodes) == 2
    best = reinert.top_profiles(reinert.profiles(x, classes), 3)
    assert all(r.form.startswith("t") for r in best.collect())
    small = x.where("uce_id < 28")
    monkeypatch.setattr(reinert, "KERNEL_CELLS", 0)  # the distributed passes
    split = {r.uce_id: r.class_id for r in reinert.classify(small, 2)[0].collect()}
    assert len({split[k] for k in range(14)}) == 1 and split[0] != split[20]


def test_reinert_splits_alike_at_any_size(spark):
    rng = np.random.default_rng(5)
    cells = sorted({(int(u) * 3 + 100, f"f{w}") for u in range(900) for w in (rng.zipf(1.3, 14) * (1 + u % 3)) % 80})
    x = spark.createDataFrame(cells, "uce_id bigint, form string")
    ids, unit = np.unique([u for u, _ in cells], return_inverse=True)
    want, chi2 = reinert.split_kernel(unit, np.unique([f for _, f in cells], return_inverse=True)[1], 5, ids=ids)
    sides, value = reinert.split(x)
    assert {r.uce_id: r.side for r in sides.collect()} == dict(zip(map(int, ids), map(int, want)))
    assert abs(value - chi2) < 1e-5


def test_reinert_reads_a_large_node_once_a_round(spark, monkeypatch):
    """Rounds of a distributed split are a job each, and ranges of the coordinate find the cut that one task finds; with joins there were several shuffles a round."""
    x = spark.createDataFrame(themes(), "uce_id bigint, form string")
    want = {r.uce_id: r.class_id for r in reinert.classify(x, 3)[0].collect()}
    monkeypatch.setattr(reinert, "KERNEL_CELLS", 0)
    monkeypatch.setattr(reinert, "RANGE_CELLS", 60, raising=False)
    spark.sparkContext.setJobGroup("split", "split")
    try:
        got = {r.uce_id: r.class_id for r in reinert.classify(x, 2)[0].collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("split"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 2 * (reinert.ROUNDS + reinert.REFINE)
    assert all(len({got[u] for u in want if want[u] == c}) == 1 for c in want.values()) and len(set(got.values())) == 2


def test_reinert_packs_units_once(spark, monkeypatch):
    """Packed units hold each form of the vocabulary in two bytes, and their classes and profiles are those of the presence table, in whatever blocks, ranges and sizes of a node."""
    monkeypatch.setattr(reinert, "ROUNDS", 8)
    rng = np.random.default_rng(3)
    rows = [(int(u) - 60, f"f{w:03d}") for u in range(240) for w in (rng.zipf(1.2, 12) * (1 + u % 3)) % 90]
    rows += rows[:100] + [(7, f"rare{k}") for k in range(150)] + [(500, "only")] * 20 + [(None, "f001"), (3, None), (4, " ")] + [(k + 9 * 10**18, "f001") for k in range(3)]
    postings = spark.createDataFrame(rows, "uce_id bigint, form string").repartition(5)
    units = corpus.unit_presence(postings)
    met = Counter(r.form for r in units.collect())
    for most, first, sizes in ((40, 60, [(0, 100, 300)]), (100, 110, [(40_000_000, 250_000, 2_000_000)]), (40, 1000, [(40_000_000, 100, 300)])):  # forms with most rows suffice; forms met once leave it open; all forms at once
        monkeypatch.setattr(reinert, "MOST_BROADCAST", first)
        want = sorted(sorted(met, key=lambda f: (-met[f], f))[:most])
        presence = units.where(F.col("form").isin(want))
        places = {f: k for k, f in enumerate(want)}
        classes, _ = reinert.classify(presence, 3)
        sides = {r.uce_id: r.class_id for r in classes.collect()}
        profile = sorted(map(tuple, reinert.profiles(presence, classes).collect()))
        for kernel, block, ranged in sizes:
            with monkeypatch.context() as m:
                for name, value in (("KERNEL_CELLS", kernel), ("BLOCK_CELLS", block), ("RANGE_CELLS", ranged)):
                    m.setattr(reinert, name, value)
                packed = reinert.packed_units(postings, most)
                assert packed.forms == most and {r.form: r.term for r in packed.vocabulary.collect()} == places
                held = [r for r in packed.blocks.toArrow().to_batches()]
                cells = sorted((int(u), want[t]) for ids, starts, terms in reinert._blocks(held) for k, u in enumerate(ids) for t in terms[starts[k] : starts[k + 1]])
                assert cells == sorted((r.uce_id, r.form) for r in presence.collect()) and sum(len(x) for b in held for x in b.column("terms").to_pylist()) == 2 * len(cells)
                leaves, _ = reinert.classify_packed(packed, 3)
                assert {r.uce_id: r.class_id for r in reinert.classes_of(leaves).collect()} == sides
                assert sorted(map(tuple, reinert.packed_profiles(packed, leaves).collect())) == profile


def test_representative_sentences_make_no_pairs(spark, monkeypatch):
    """Ranks equal those of PageRank on the explicit pairs, of which none is made."""
    rnd = random.Random(4)
    text = [" ".join(rnd.choice("abcdefghij") * 2 for _ in range(rnd.randint(3, 9))) + "." for _ in range(60)]
    d = spark.createDataFrame([(k, " ".join(text[k * 6 : k * 6 + 6])) for k in range(10)], "doc_id bigint, text string")
    sents = {(k, i): set(t[:-1].split()) for k in range(10) for i, t in enumerate(text[k * 6 : k * 6 + 6])}
    sents = {k: w for k, w in sents.items() if len(w) > 2}
    keys = sorted(sents)
    pairs = [(a, b, 2.0 * len(sents[x] & sents[y]) / (len(sents[x]) + len(sents[y]))) for a, x in enumerate(keys) for b, y in enumerate(keys) if a < b and sents[x] & sents[y]]
    rank = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame(pairs, "src bigint, dst bigint, weight double"), 30).collect()}
    want = {k: rank.get(n, 0.0) / max(rank.values()) + ("aa" in sents[k]) for n, k in enumerate(keys) if "aa" in sents[k]}
    monkeypatch.setattr(phrases, "pagerank", lambda *_: (_ for _ in ()).throw(AssertionError("pairs")), raising=False)
    got = phrases.representative_sentences(d, spark.createDataFrame([("t", "aa")], "target string, form string"), most=1000, common=1.0)
    got = {(r.doc_id, r.sent): r.score for r in got.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_repeated_segments_write_out_frequent_grams_only(spark, monkeypatch):
    rnd = random.Random(6)
    words = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 12))] for _ in range(90)] + [None]
    d = spark.createDataFrame(list(enumerate(words)), "uce_id bigint, w array<string>")
    classes = spark.createDataFrame([(k, "xyz"[k % 3]) for k in range(91)], "uce_id bigint, class_id string")
    counts = {}
    for k, w in enumerate(words):
        for n in range(2, 6):
            for i in range(len(w or ()) - n + 1):
                key = (" ".join(w[i : i + n]), "xyz"[k % 3])
                counts[key] = counts.get(key, 0) + 1
    table = spark.createDataFrame([(*k, n) for k, n in counts.items()], "form string, grp string, n bigint")
    want = {(r.grp, r.form): (r.n, r.score) for r in tables.specificities(table).collect() if r.n >= 3 and r.score > 0}
    kept = {}
    write = ngrams.written
    monkeypatch.setattr(ngrams, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    got = {(r.class_id, r.gram): (r.freq, r.chi2) for r in ngrams.repeated_segments(d, classes, most=10_000).collect()}
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    forms = {f for f, _ in counts if sum(n for (g, _), n in counts.items() if g == f) >= 3}
    assert forms <= {r.form for r in kept["table"].collect()} and kept["table"].select("form").distinct().count() < len({f for f, _ in counts})


def test_topics(spark):
    dtm = spark.createDataFrame([(u, w) for u, w in themes(2)], "doc_id bigint, form string").groupBy("doc_id", "form").agg(F.count("*").alias("n"))
    t = topics.lda(dtm, 2, min_freq=1, rounds=8)
    sums = t.documents.groupBy("doc_id").agg(F.sum("gamma").alias("s"))
    assert all(abs(r.s - 1) < 1e-6 for r in sums.collect())
    assert topics.dominant_topics(t).where("gamma < 0.5 or entropy > 1.0000001").count() == 0
    assert topics.topic_labels(t).count() == 2 and topics.cluster(dtm, 2).select("cluster").distinct().count() == 2


def test_phrases(spark):
    assert phrases.find_names("O Dr. João da Silva viu a ONU. Hoje foi. Maria de Souza") == ["Dr", "João da Silva", "ONU", "Maria de Souza"]
    assert phrases.find_names(None) == []
    d = spark.createDataFrame([(1, "O mar azul. O mar calmo. Gato preto dorme."), (2, "mar azul é mar azul bom")], "doc_id bigint, text string")
    top = {r.phrase: r for r in phrases.keyphrases(d).collect()}
    assert top["mar azul"].freq == 3 and top["mar azul"].doc_count == 2
    targets = spark.createDataFrame([("t", "mar")], "target string, form string")
    assert {r.doc_id for r in phrases.representative_sentences(d, targets, common=1.0, rounds=5).collect()} <= {1, 2}


def test_registered_queries_keep_all_forms(spark, tmp_path):
    cells = [(u, f"f{u + k}", 1) for u in range(500) for k in range(2)]
    spark.createDataFrame(cells, "uce_id bigint, form string, n int").write.parquet(f"{tmp_path}/postings.parquet")
    assert queries._presence(spark, str(tmp_path)).select("form").distinct().count() == 501
    assert queries.QUERIES["cooc_presence"](spark, str(tmp_path)).count() == 500
    assert (queries.MAX_ACTIVES, queries.MAX_FEATURES, queries.LDA_ROUNDS) == (20_000, 2000, 20)


def test_kwic_folds_and_reads_on(spark):
    rows_ = [(k, t) for k, t in enumerate(["Um dois", "", None, "três Não", "quatro", "nao! cinco", "fim"])]
    df = spark.createDataFrame(rows_, "doc_id bigint, text string").withColumn("before", F.lit("clash"))
    got = [(r.doc_id, r.left_tokens, r.keyword, r.right_tokens) for r in contexts.kwic(df, "NAO", 3).orderBy("doc_id").collect()]
    assert got == [(3, ["Um", "dois", "três"], "Não", ["quatro", "nao", "cinco"]), (5, ["três", "Não", "quatro"], "nao", ["cinco", "fim"])]
    assert [r.left_tokens for r in contexts.kwic(df, "nao", 3, stream=False).orderBy("doc_id").collect()] == [["três"], []]
    assert contexts.kwic(df, "Não", 3, case_sensitive=True).count() == 1 and contexts.kwic(df, "n.o", 1, regex=True).count() == 2
    assert contexts.kwic(df.where("false"), "nao").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_close_forms_against_loops(spark, most):
    rnd = random.Random(most)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(120)})
    forms = spark.createDataFrame([(w, rnd.randint(1, 9)) for w in words], "form string, freq bigint")
    want = {(a, b): distance(a, b) for a in words for b in words if a < b and a[:3] == b[:3] and distance(a, b) <= most}
    assert {(r.form_a, r.form_b): r.distance for r in fuzzy.close_pairs(forms, most).collect()} == want
    taken, clusters = {}, {}
    for a in words:
        if a not in taken:
            members = [b for b in words if b not in taken and (a, b) in want]
            if members:
                clusters[a] = [a, *members]
                taken |= dict.fromkeys(clusters[a], a)
    freq = {r.form: r.freq for r in forms.collect()}
    heads = {min(m, key=lambda w: (-freq[w], w)): set(m) for m in clusters.values()}
    got = {}
    for r in fuzzy.close_clusters(forms, most).collect():
        got.setdefault(r.canonical, set()).add(r.form)
        assert r.cluster_freq == sum(freq[w] for w in heads[r.canonical])
    assert got == heads


def test_presence_of_a_large_unit(spark):
    u = spark.range(300).select(F.lit(1).alias("uce_id"), F.concat(F.lit("t"), "id").alias("form")).unionByName(spark.createDataFrame([(2, "t1"), (2, "t2"), (3, "t9")], "uce_id int, form string"))
    got = {(r.term_a, r.term_b): r.n for r in cooccurrence.presence(u, u.select("form").distinct(), block=16).collect()}
    assert len(got) == 300 * 299 // 2 and got["t1", "t2"] == 2 and sum(got.values()) == len(got) + 1


def test_tails_are_exact():
    from fractions import Fraction
    from math import comb, log10

    from tessera.functions.measures import hypergeometric_tail

    for k, row, col, total in [(3, 10, 12, 60), (0, 10, 12, 60), (9, 10, 12, 60), (40, 700, 90, 4000)]:
        ps = {x: Fraction(comb(col, x) * comb(total - col, row - x), comb(total, row)) for x in range(max(0, row + col - total), min(row, col) + 1)}
        up = k * total >= row * col
        p = sum(v for x, v in ps.items() if (x >= k if up else x <= k))
        assert hypergeometric_tail(k, row, col, total) == pytest.approx(-log10(p) if up else log10(p), abs=1e-9)


def test_vocabulary_before_windows(spark):
    from tessera.operators import network

    df = spark.createDataFrame([(1, "a x b"), (2, "b y a a")], "doc_id bigint, text string")
    t = tokens(df, "alpha")
    words = network.vocabulary_words(t, network.Thresholds(2, 1, 0))
    assert sorted(map(tuple, words.collect())) == [(1, ["a", "b"]), (2, ["b", "a", "a"])]
    assert rows(network.word_network(cooccurrence.windowed(words, 1), network.Thresholds(2, 2, 0))) == [("a", "b", 4.0)]


def test_names_as_in_sentences():
    assert phrases.find_names("Hoje Ana viu. Ana saiu\n**** *x_Nome\nSobre o iPhone da Casa e nada") == ["Ana", "Ana", "iPhone da Casa"]
    assert [phrases.name_kind(x) for x in ("ONU", "iPhone", "Ana", "Banco do Brasil", "Ana Lima")] == ["acronym", "mixed_case_name", "proper_name", "institution_or_group", "proper_name"]


def test_names_whatever_their_case(spark):
    df = spark.createDataFrame([(2, "vi ANA Lima aqui"), (1, "vi Ana Lima, depois Ana LIMA"), (3, None)], "doc_id bigint, text string")
    assert [(r.name, r.kind, r.freq, r.doc_count, r.score) for r in phrases.named_entities(df).collect()] == [("Ana Lima", "proper_name", 3, 2, 1.0)]
    assert phrases.named_entities(df.where("false")).count() == 0


def test_communities_of_two_cliques(spark):
    rows_ = [(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w", 1.0)]
    e = spark.createDataFrame(rows_, "src string, dst string, weight double")
    for method in (small_graph.greedy_modularity, small_graph.girvan_newman, small_graph.louvain):
        got = {r.node: r.community for r in method(e).collect()}
        assert {got[x] for x in "abcd"} != {got[x] for x in "wxyz"} and len(set(got.values())) == 2, method
    assert small_graph.greedy_modularity(e.where("false")).count() == 0


def test_double_classification(spark):
    themes = {g: [f"{g}{k}" for k in range(6)] for g in "abc"}
    cells, units = [], []
    rnd = random.Random(3)
    for u in range(120):
        g = "abc"[u // 40]
        cells += [(u, w) for w in rnd.sample(themes[g], 4)]
        units.append((u, u // 2, u // 4))
    presence = spark.createDataFrame(cells, "uce_id bigint, form string")
    members = spark.createDataFrame(units, "uce_id bigint, x bigint, y bigint")
    got = {r.uce_id: r.class_id for r in reinert.double_classification(presence, members.selectExpr("uce_id", "x as unit"), members.selectExpr("uce_id", "y as unit"), 3, 2).collect()}
    assert len(got) == 120 and {len({got[u] for u in range(k, k + 40)}) for k in (0, 40, 80)} == {1} and set(got.values()) == {1, 2, 3}
    none = reinert.double_classification(presence, members.selectExpr("uce_id", "x as unit"), members.selectExpr("uce_id", "y as unit"), 3, 2, share=0.9)
    assert {r.class_id for r in none.collect()} == {0}
