"""The registered queries of the library's own operators, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.indices import ALIASES, FULL, INDICES
from tessera.functions.tokenizers import tokenize, tokens
from tessera.operators import contexts, cooccurrence, corpus, correspondence, fuzzy, graph, lexicon, network, ngrams, phrases, reinert, segments, small_graph, tables, topics
from tessera.plans.oracles import DECIMALS, DENSE_FORMS, FLOATS
from tessera.session import spread, table, written
from tessera.sources import readers
from tessera.streaming import counts

STOP = lexicon.STOPWORDS + lexicon.ENGLISH_STOPWORDS
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The limits of the reference: forms of a classification, features of a topic model or a clustering; rounds of a topic model.
MAX_ACTIVES, MAX_FEATURES, LDA_ROUNDS = 20_000, 2000, 20
#: Those of the pictures: forms and pairs of a PPMI table, forms and nodes of a thematic map, edges of an n-gram network.
PPMI_FORMS, PPMI_PAIRS, THEME_FORMS, THEME_NODES, TOP_EDGES = 200, 100, 300, 120, 120



def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


def toks(spark: SparkSession, d: str) -> DataFrame:
    return tokens(docs(spark, d))


def dtm(spark: SparkSession, d: str) -> DataFrame:
    return corpus.document_terms(toks(spark, d))


def lang_groups(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the first two letters of their language."""
    return table(spark, d, "documents").select("doc_id", F.substring(F.lower("lang"), 1, 2).alias("grp")).where("grp is not null")


def source_key(d: DataFrame) -> DataFrame:
    return d.withColumn("source_key", F.regexp_replace(F.lower(F.trim("source")), "[- ]", "_"))


def meta(spark: SparkSession, d: str) -> DataFrame:
    return corpus.metadata(table(spark, d, "documents"))


def loc_groups(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d).where("variable = 'loc'").select("doc_id", F.col("value").alias("grp"))


def units(spark: SparkSession, d: str) -> DataFrame:
    return corpus.unit_presence(table(spark, d, "postings"))


def frequent(spark: SparkSession, d: str, least: int = 3, most: int | None = None) -> DataFrame:
    """Forms with at least ``least`` occurrences in all segments; with ``most`` only the most frequent ones, ties by form."""
    n = F.sum(F.coalesce("n", F.lit(0)))
    forms = table(spark, d, "postings").where("uce_id is not null and trim(form) <> ''").groupBy("form").agg(n.alias("k")).where(F.col("k") >= least)
    return (forms if most is None else forms.orderBy(F.desc("k"), "form").limit(most)).select("form")


def unit_vocabulary(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The n forms met in most segments, ties by form."""
    return units(spark, d).groupBy("form").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "form").limit(n).select("form")


# corpus -----------------------------------------------------------------------------------------------------------------------------------


@query
def corpus_statistics(s: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_statistics(docs(s, d))


@query
def word_freq_top(s: SparkSession, d: str) -> DataFrame:
    return corpus.top_forms(corpus.form_counts(toks(s, d)), 100)


@query
def first_occurrences(s: SparkSession, d: str) -> DataFrame:
    return corpus.first_positions(toks(s, d)).select("form", F.col("first.doc_id").alias("doc_id"), F.col("first.pos").alias("pos"))


@query
def freq_of_freq(s: SparkSession, d: str) -> DataFrame:
    return corpus.frequency_spectrum(corpus.form_counts(toks(s, d)))


@query
def hapax_by_lang(s: SparkSession, d: str) -> DataFrame:
    t = tables.lexical_table(dtm(s, d), lang_groups(s, d))
    return t.where("n = 1").groupBy("grp").agg(F.count("*").alias("hapaxes"))


@query
def doc_sizes(s: SparkSession, d: str) -> DataFrame:
    return corpus.document_sizes(docs(s, d))


@query
def dtm_stats(s: SparkSession, d: str) -> DataFrame:
    return corpus.matrix_statistics(dtm(s, d))


@query
def postings_stats(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "postings").where("uce_id is not null and form is not null").groupBy("uce_id", "form").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return corpus.matrix_statistics(p, "uce_id")


@query
def doc_meta(s: SparkSession, d: str) -> DataFrame:
    return meta(s, d)


@query
def subcorpus_freq(s: SparkSession, d: str) -> DataFrame:
    m = meta(s, d)
    inside = docs(s, d).join(m.where("variable = 'loc' and value in ('campo', 'litoral')").select("doc_id"), "doc_id", "left_semi")
    return corpus.top_forms(corpus.form_counts(tokens(inside)), 200)


@query
def subcorpus_ids(s: SparkSession, d: str) -> DataFrame:
    return corpus.subcorpus(table(s, d, "documents"), meta(s, d), "sexo", ["f"]).select("doc_id", "uci_id")


@query
def tie_cut_vocab(s: SparkSession, d: str) -> DataFrame:
    return corpus.tie_cut(corpus.form_counts(toks(s, d)).where("freq >= 3"), 300)


@query
def dropped_forms(s: SparkSession, d: str) -> DataFrame:
    stop = s.createDataFrame([(w,) for w in lexicon.STOPWORDS], "form string")
    return corpus.dropped_forms(corpus.form_counts(tokens(docs(s, d), "alpha")), 3, stop)


# text -------------------------------------------------------------------------------------------------------------------------------------


@query
def tokenizer_counts(s: SparkSession, d: str) -> DataFrame:
    rules = ("alpha", "alpha2", "alpha3", "compound", "word", "sent")
    return docs(s, d).agg(*[F.coalesce(F.sum(F.greatest(F.size(tokenize(F.col("text"), r)), F.lit(0))), F.lit(0)).alias(r) for r in rules])


@query
def noise_forms(s: SparkSession, d: str) -> DataFrame:
    # engines differ in the small sigma at the end of a capital word, so both are written alike
    forms = toks(s, d).unionByName(tokens(docs(s, d), "word")).select(F.translate("form", "ς", "σ").alias("form"))
    return forms.distinct().where(T.is_noise(F.col("form")))


@query
def folded_forms(s: SparkSession, d: str) -> DataFrame:
    return toks(s, d).select("form", T.fold(F.col("form")).alias("folded")).distinct()


@query
def web_free_texts(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", T.strip_web(F.col("text")).alias("clean"))


@query
def strict_texts(s: SparkSession, d: str) -> DataFrame:
    # engines differ in the small sigma at the end of a capital word, so both are written alike
    return docs(s, d).select("doc_id", F.translate(T.strict_clean(F.col("text")), "ς", "σ").alias("clean"))


@query
def layout_texts(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", T.clean_layout(F.col("text")).alias("clean"))


@query
def minimal_texts(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", T.prepare_minimal(F.col("text")).alias("clean"))


@query
def corpus_cleaned(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.translate(T.clean_corpus_text(F.col("text")), "ς", "σ").alias("clean"))


@query
def transcript_speakers(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.explode(T.speakers(F.col("text"))).alias("speaker")).groupBy("speaker").agg(F.count("*").alias("documents"))


@query
def source_slugs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("source", T.slug(F.col("source")).alias("slug")).where("source is not null").distinct()


@query
def parsed_documents(s: SparkSession, d: str) -> DataFrame:
    p = readers.parse_tagged(docs(s, d), "doc_id")
    return p.select("doc_id", "doc_no", "header", F.length("text").alias("chars"), F.size("themes").alias("themes"))


@query
def corpus_issues(s: SparkSession, d: str) -> DataFrame:
    return readers.validate_tagged(docs(s, d), "doc_id").where("n > 0")


@query
def segments_of_documents(s: SparkSession, d: str) -> DataFrame:
    clean = docs(s, d).select("doc_id", T.strict_clean(F.col("text")).alias("text"))
    cut = segments.segments(clean, tokenize(F.col("text"), "strict"))
    return cut.select("doc_id", "seg", F.size("tokens").alias("n_tokens"))


@query
def character_segments(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", F.posexplode(segments.segment_characters(F.col("text"))).alias("seg", "piece")).select("doc_id", "seg", F.length("piece").alias("chars"))


@query
def segment_groups(s: SparkSession, d: str) -> DataFrame:
    cut = segments.segments(docs(s, d), tokenize(F.col("text"), "alpha3"))
    return segments.unit_groups(cut.select("doc_id", F.col("seg").cast("bigint").alias("seg"), F.size(F.array_distinct("tokens")).alias("size")))


@query
def merged_phrases(s: SparkSession, d: str) -> DataFrame:
    merged = docs(s, d).select("doc_id", segments.merge_phrases(tokenize(F.col("text"), "alpha"), [("acervo", "lexico"), ("equipe", "acervo"), ("www", "acervo", "lexico")]).alias("w"))
    return merged.select("doc_id", F.explode("w").alias("form")).where("form like '%\\\\_%'").groupBy("form").agg(F.count("*").alias("freq"))


@query
def lexicon_lookup(s: SparkSession, d: str) -> DataFrame:
    rows = [(0, "jórado", "jórado", "nom"), (1, "canção", "canção", "nom"), (2, "lhabista", "lhabisto", "adj"), (3, "não", "não", "adv"), (4, "que", "que", "pro")]
    lex = lexicon.prepare_lexicon(s.createDataFrame(rows, "pos bigint, word string, lemma string, gram string"))
    return lexicon.lookup(corpus.form_counts(toks(s, d)).select("form", "freq"), lex)


# tables -----------------------------------------------------------------------------------------------------------------------------------


@query
def lexical_table_lang(s: SparkSession, d: str) -> DataFrame:
    return tables.lexical_table(dtm(s, d), lang_groups(s, d), min_freq=3)


@query
def class_presence_profile(s: SparkSession, d: str) -> DataFrame:
    return tables.presence_table(dtm(s, d), loc_groups(s, d))


@query
def specificity_chi2_loc(s: SparkSession, d: str) -> DataFrame:
    return tables.specificities(tables.lexical_table(dtm(s, d), loc_groups(s, d), min_freq=3))


@query
def specificity_top_loc(s: SparkSession, d: str) -> DataFrame:
    return tables.specificities(tables.lexical_table(dtm(s, d), loc_groups(s, d), min_freq=3), most=200).select("form", "grp", "n", F.round("score", 6).alias("score"))


@query
def specificity_hypergeo_loc(s: SparkSession, d: str) -> DataFrame:
    return tables.specificities(tables.lexical_table(dtm(s, d), loc_groups(s, d), min_freq=3), "hypergeo")


@query
def chronological_specificity(s: SparkSession, d: str) -> DataFrame:
    years = table(s, d, "documents").select("doc_id", F.year("imported_at").alias("grp")).where("grp is not null")
    return tables.chronological(tables.lexical_table(dtm(s, d), years, min_freq=3), 1)


@query
def metadata_profile_chi2(s: SparkSession, d: str) -> DataFrame:
    m = meta(s, d).where("variable in ('sexo', 'idade')").select("doc_id", F.concat("variable", F.lit("_"), "value").alias("form"))
    return tables.specificities(m.join(loc_groups(s, d), "doc_id").groupBy("form", "grp").agg(F.count("*").alias("n"))).select("form", "grp", "n", "score", "sign")


@query
def keyness_g2(s: SparkSession, d: str) -> DataFrame:
    return tables.keyness(dtm(s, d), loc_groups(s, d).where("grp = 'campo'"))


@query
def keyness_chi2(s: SparkSession, d: str) -> DataFrame:
    return tables.keyness(dtm(s, d), loc_groups(s, d).where("grp = 'campo'"), measure="chi2")


@query
def keyness_exact(s: SparkSession, d: str) -> DataFrame:
    return tables.keyness(dtm(s, d), loc_groups(s, d).where("grp = 'campo'"), measure="exact", min_freq=3)


@query
def matrix_frequency(s: SparkSession, d: str) -> DataFrame:
    return tables.category_frequencies(table(s, d, "orders"), "o_orderpriority", 3)


@query
def matrix_chi2(s: SparkSession, d: str) -> DataFrame:
    return tables.chi2_test(table(s, d, "lineitem"), "l_returnflag", "l_linestatus").select("chi2", "dof", "n")


@query
def matrix_chi2_cells(s: SparkSession, d: str) -> DataFrame:
    return tables.crosstab(table(s, d, "lineitem"), "l_returnflag", "l_linestatus").select("row", "col", "n", "expected", "residual")


@query
def matrix_similarity(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return tables.row_products(cells, "user_id", "event_type", "n")


@query
def partition_agreement(s: SparkSession, d: str) -> DataFrame:
    m = meta(s, d)
    a, b = m.where("variable = 'loc'").select("doc_id", F.col("value").alias("x")), m.where("variable = 'sexo'").select("doc_id", F.col("value").alias("y"))
    return tables.partition_agreement(a.join(b, "doc_id"), "x", "y")


# contexts ---------------------------------------------------------------------------------------------------------------------------------


@query
def kwic_hits(s: SparkSession, d: str) -> DataFrame:
    return contexts.kwic(docs(s, d), "sobre")


@query
def concordance_counts(s: SparkSession, d: str) -> DataFrame:
    hits = contexts.concordance(docs(s, d), "sobre")
    return contexts.distribution(hits, meta(s, d).where("variable = 'loc'")).select("value", "n")


@query
def dispersion_juilland(s: SparkSession, d: str) -> DataFrame:
    return contexts.dispersion(dtm(s, d), table(s, d, "documents"))


@query
def rolling_ratio(s: SparkSession, d: str) -> DataFrame:
    return contexts.rolling(tokens(docs(s, d), "kwic"), T.fold(F.col("form")) == "sobre")


@query
def xray(s: SparkSession, d: str) -> DataFrame:
    return contexts.xray(docs(s, d), ["sobre", "lh*"])


@query
def bubblelines(s: SparkSession, d: str) -> DataFrame:
    return contexts.document_bins(toks(s, d), ["sobre", "entre", "com"])


@query
def voyant_trends(s: SparkSession, d: str) -> DataFrame:
    order = corpus.numbered(table(s, d, "documents").select("doc_id"), "doc_id", "idx")
    return contexts.trends(toks(s, d), ["sobre", "entre", "com"], order)


@query
def voyant_doc_terms(s: SparkSession, d: str) -> DataFrame:
    return contexts.trend_codes(contexts.document_bins(toks(s, d), ["sobre", "entre"]))


@query
def collocates(s: SparkSession, d: str) -> DataFrame:
    return contexts.collocates(toks(s, d), "sobre")


@query
def evocation_rank(s: SparkSession, d: str) -> DataFrame:
    return contexts.evocation(docs(s, d))


@query
def prototypical_quadrants(s: SparkSession, d: str) -> DataFrame:
    return contexts.prototypical(contexts.evocation(docs(s, d))).groupBy("quadrant").agg(F.count("*").alias("forms"), F.sum("freq").alias("freq"))


# n-grams ----------------------------------------------------------------------------------------------------------------------------------


@query
def bigrams(s: SparkSession, d: str) -> DataFrame:
    return ngrams.ngram_counts(docs(s, d), 2, stopwords=STOP)


@query
def trigrams(s: SparkSession, d: str) -> DataFrame:
    return ngrams.ngram_counts(docs(s, d), 3, stopwords=STOP)


@query
def bigram_network(s: SparkSession, d: str) -> DataFrame:
    return ngrams.bigram_edges(ngrams.top_ngrams(bigrams(s, d), TOP_EDGES))


@query
def trigram_network(s: SparkSession, d: str) -> DataFrame:
    return ngrams.trigram_edges(ngrams.top_ngrams(trigrams(s, d), TOP_EDGES))


@query
def ngram_union(s: SparkSession, d: str) -> DataFrame:
    """All bigrams and the top trigrams in one table."""
    three = ngrams.top_ngrams(trigrams(s, d), TOP_EDGES).select(F.concat_ws(" ", "w1", "w2", "w3").alias("gram"), "freq")
    return bigrams(s, d).select(F.concat_ws(" ", "w1", "w2").alias("gram"), "freq").unionByName(three)


@query
def multiword_candidates(s: SparkSession, d: str) -> DataFrame:
    return ngrams.multiword_candidates(docs(s, d))


@query
def word_tree(s: SparkSession, d: str) -> DataFrame:
    return ngrams.word_tree(docs(s, d), "sobre")


@query
def keyphrases_scored(s: SparkSession, d: str) -> DataFrame:
    return phrases.keyphrases(docs(s, d))


@query
def named_entities(s: SparkSession, d: str) -> DataFrame:
    return phrases.named_entities(docs(s, d))


# co-occurrence ------------------------------------------------------------------------------------------------------------------------------


@query
def cooc_window(s: SparkSession, d: str) -> DataFrame:
    words = docs(s, d).select(tokenize(F.col("text"), "alpha3").alias("w"))
    return cooccurrence.windowed(words, 5)


@query
def cooc_presence(s: SparkSession, d: str) -> DataFrame:
    u = units(s, d)
    return cooccurrence.presence(u, u.select("form").distinct())


@query
def ppmi_pairs(s: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.presence(units(s, d), unit_vocabulary(s, d, PPMI_FORMS))
    return cooccurrence.ppmi(pairs, most=PPMI_PAIRS).select("term_a", "term_b", "n", F.round("ppmi", 6).alias("ppmi"))


@query
def ppmi_all(s: SparkSession, d: str) -> DataFrame:
    """PPMI of every pair of forms that share a segment."""
    u = units(s, d)
    return cooccurrence.ppmi(cooccurrence.presence(u, u.select("form").distinct()), most=None).select("term_a", "term_b", "n", F.round("ppmi", 6).alias("ppmi"))


@query
def contingency_issues(s: SparkSession, d: str) -> DataFrame:
    return cooccurrence.validate_contingency(cooccurrence.contingency(units(s, d), frequent(s, d)))


@query
def cca_concepts(s: SparkSession, d: str) -> DataFrame:
    concepts = s.createDataFrame([("sobre", "place"), ("entre", "place"), ("com", "company"), ("sem", "company"), ("por", "cause"), ("para", "cause")], "form string, concept string")
    return cooccurrence.concept_pairs(docs(s, d).select("doc_id", F.filter(F.transform(tokenize(F.col("text"), "kwic"), T.fold), lambda w: F.length(w) > 1).alias("w")), concepts)


@query
def labbe_distance(s: SparkSession, d: str) -> DataFrame:
    by_source = source_key(table(s, d, "documents")).select("doc_id", "source_key").where("source_key is not null")
    t = dtm(s, d).join(by_source, "doc_id").groupBy("source_key", "form").agg(F.sum("n").alias("n"))
    return cooccurrence.labbe(t, "source_key").select("text_1", "text_2", F.round("distance", 8).alias("distance"))


def _similitude(name: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return cooccurrence.similitude(units(s, d), frequent(s, d, most=DENSE_FORMS if ALIASES[name] in FULL else None), name).select("term_a", "term_b", F.round("value", 8).alias("value"))

    return run


for _name in INDICES:
    QUERIES[f"similitude_{_name}"] = _similitude(_name)


# graphs -----------------------------------------------------------------------------------------------------------------------------------


def edges(s: SparkSession, d: str) -> DataFrame:
    """Pairs of forms with at least 3 occurrences, weighted by the segments they share."""
    pairs = cooccurrence.presence(units(s, d), frequent(s, d))
    return pairs.select(F.col("term_a").alias("src"), F.col("term_b").alias("dst"), F.col("n").cast("double").alias("weight"))


def tree(s: SparkSession, d: str) -> DataFrame:
    """The maximum spanning tree of ``edges``: the graph that is drawn and measured unless all edges are asked for."""
    return written(graph.maximum_spanning_tree(edges(s, d)), "tree")


@query
def degree_centrality(s: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges(s, d))


@query
def graph_summary(s: SparkSession, d: str) -> DataFrame:
    return graph.graph_summary(edges(s, d))


@query
def graph_components(s: SparkSession, d: str) -> DataFrame:
    return graph.components(edges(s, d))


@query
def mst_edges(s: SparkSession, d: str) -> DataFrame:
    return graph.maximum_spanning_tree(edges(s, d))


@query
def mst_weight(s: SparkSession, d: str) -> DataFrame:
    """Edges and total weight of the tree, which are the same whatever the ties."""
    return graph.maximum_spanning_tree(edges(s, d)).agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query
def pagerank(s: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(edges(s, d), 20)


@query
def communities(s: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(edges(s, d))


@query
def louvain_communities(s: SparkSession, d: str) -> DataFrame:
    return small_graph.louvain(tree(s, d), smallest=3)


@query
def path_centrality(s: SparkSession, d: str) -> DataFrame:
    return small_graph.path_measures(tree(s, d))


@query
def eigenvector_centrality(s: SparkSession, d: str) -> DataFrame:
    return small_graph.eigenvector(tree(s, d))


@query
def community_modularity(s: SparkSession, d: str) -> DataFrame:
    e = tree(s, d)
    return graph.modularity(e, small_graph.louvain(e))


def _themes(s: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.ppmi(cooccurrence.presence(units(s, d), unit_vocabulary(s, d, THEME_FORMS)), most=None)
    return written(graph.budget_edges(pairs, THEME_NODES), "themes")


@query
def budget_network(s: SparkSession, d: str) -> DataFrame:
    return _themes(s, d)


@query
def thematic_map(s: SparkSession, d: str) -> DataFrame:
    e = _themes(s, d)
    return graph.thematic_map(e, small_graph.greedy_modularity(e))


def _windowed(s: SparkSession, d: str) -> tuple[DataFrame, network.Thresholds]:
    """Windowed pairs of the tokens that the profile of the corpus' size keeps."""
    t = toks(s, d)
    profile = network.thresholds(t.count())
    return written(cooccurrence.windowed(network.vocabulary_words(t, profile), 5), "windowed"), profile


@query
def text_network(s: SparkSession, d: str) -> DataFrame:
    return network.word_network(*_windowed(s, d))


@query
def balanced_network(s: SparkSession, d: str) -> DataFrame:
    return network.balanced(text_network(s, d))


@query
def bridged_network(s: SparkSession, d: str) -> DataFrame:
    pairs, profile = _windowed(s, d)
    raw = network.word_network(pairs, network.Thresholds(1, 1, 0))
    return network.bridged(network.reinforced(network.word_network(pairs, profile), raw), raw)


def _capitals(s: SparkSession, d: str) -> DataFrame:
    """``form, capitalised``: how often each form is written with a capital first letter."""
    words = docs(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("w"))
    return words.where(F.col("w").rlike(r"^\p{Lu}")).groupBy(F.lower("w").alias("form")).agg(F.count("*").alias("capitalised"))


@query
def candidate_concepts(s: SparkSession, d: str) -> DataFrame:
    return network.candidate_words(dtm(s, d), capitals=_capitals(s, d))


@query
def concept_words(s: SparkSession, d: str) -> DataFrame:
    e = written(text_network(s, d), "edges")
    return network.concept_confidence(e, graph.label_propagation(e), network.candidate_words(dtm(s, d), capitals=_capitals(s, d)))


@query
def source_clusters(s: SparkSession, d: str) -> DataFrame:
    g = source_key(table(s, d, "documents")).select("doc_id", "source_key").where("source_key is not null")
    cells = dtm(s, d).join(g, "doc_id").groupBy("source_key", "form").agg(F.sum("n").alias("n"))
    return network.hierarchical(cells, "source_key", "form", "n", 4)


@query
def gram_by_loc(s: SparkSession, d: str) -> DataFrame:
    lex = s.createDataFrame([("sobre", "pre"), ("entre", "pre"), ("com", "pre"), ("que", "pro")], "form string, gram string")
    return tables.gram_table(dtm(s, d), lex, loc_groups(s, d))


@query
def word_cloud(s: SparkSession, d: str) -> DataFrame:
    forms = corpus.form_counts(toks(s, d)).where(lexicon.is_content(F.col("form")) & (F.col("freq") >= 3) & ~F.col("form").isin(*lexicon.STOPWORDS))
    return corpus.top_forms(forms, 100)


@query
def crossed_classifications(s: SparkSession, d: str) -> DataFrame:
    m = meta(s, d)
    a, b = (m.where(f"variable = '{v}'").select(F.col("doc_id").alias("uce_id"), F.col("value").alias("class_id")) for v in ("loc", "idade"))
    return tables.crossed_classes(a, b)


@query
def matched_loc_profiles(s: SparkSession, d: str) -> DataFrame:
    """Classes of two cuts of the segments, matched by their strongest terms."""
    p = units(s, d)
    most = p.agg(F.max("uce_id")).scalar()
    profiles = []
    for k in (3, 4):
        classes = p.select("uce_id").distinct().withColumn("class_id", F.floor((F.col("uce_id") - 1) * k / most).cast("int"))
        profiles.append(reinert.profiles(p, classes, 3))
    return tables.matched_classes(*profiles)


@query
def lemma_counts(s: SparkSession, d: str) -> DataFrame:
    """Occurrences of lemmas by segment, of which there are two here."""
    lex = s.createDataFrame([("sobre", "sob"), ("entre", "sob")], "form string, lemma string")
    p = table(s, d, "postings").where("uce_id is not null and form is not null").select("uce_id", "form", F.coalesce("n", F.lit(0)).alias("n"))
    return tables.lemma_postings(p, lex).groupBy("lemma").agg(F.count("*").alias("units"), F.sum("n").alias("n"))


@query
def typical_segments(s: SparkSession, d: str) -> DataFrame:
    p, classes = _cut_classes(s, d)
    return reinert.typical_segments(p, classes, reinert.profiles(p, classes, 3))


@query
def repeated_segments(s: SparkSession, d: str) -> DataFrame:
    words = docs(s, d).select("doc_id", tokenize(F.col("text"), "alpha3").alias("w"))
    classes = loc_groups(s, d).select("doc_id", F.col("grp").alias("class_id"))
    return ngrams.repeated_segments(words, classes, "doc_id")


@query
def representative_sentences(s: SparkSession, d: str) -> DataFrame:
    targets = s.createDataFrame([("t", "sobre"), ("t", "entre"), ("u", "com")], "target string, form string")
    return phrases.representative_sentences(docs(s, d), targets)


# classification and axes ---------------------------------------------------------------------------------------------------------------------


def _packed_units(s: SparkSession, d: str) -> reinert.Packed:
    return reinert.packed_units(table(s, d, "postings"), MAX_ACTIVES)


@query
def reinert_classes(s: SparkSession, d: str) -> DataFrame:
    return reinert.classes_of(reinert.classify_packed(_packed_units(s, d), 4)[0])


@query
def reinert_profiles(s: SparkSession, d: str) -> DataFrame:
    p = _packed_units(s, d)
    return reinert.top_profiles(reinert.packed_profiles(p, reinert.classify_packed(p, 3)[0]), 80)


def _cut_classes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Presence and a given classification: four ranges of segments."""
    p = units(s, d)
    most = p.agg(F.max("uce_id")).scalar()
    return p, p.select("uce_id").distinct().withColumn("class_id", F.floor((F.col("uce_id") - 1) * 4 / most).cast("int"))


@query
def reinert_double(s: SparkSession, d: str) -> DataFrame:
    """Two classifications of the documents' segments, grouped into units of two sizes, and the classes both agree on."""
    cut = segments.segments(docs(s, d), tokenize(F.col("text"), "alpha3")).withColumn("uce_id", F.xxhash64("doc_id", "seg"))
    forms = written(cut.select("doc_id", F.col("seg").cast("bigint").alias("seg"), "uce_id", F.array_distinct("tokens").alias("forms")), "segments")
    often = forms.select(F.explode("forms").alias("form")).groupBy("form").agg(F.count("*").alias("k")).where("k >= 3").orderBy(F.desc("k"), "form").limit(MAX_ACTIVES).select("form")
    presence = forms.select("uce_id", F.explode("forms").alias("form")).join(often, "form", "left_semi")
    sizes = forms.select("doc_id", "seg", F.size("forms").alias("size"))
    units = [forms.join(segments.unit_groups(sizes, limit), ["doc_id", "seg"]).select("uce_id", F.xxhash64("doc_id", "unit").alias("unit")) for limit in (12, 14)]
    return reinert.double_classification(presence, units[0], units[1], 4)


@query
def segment_class_profiles(s: SparkSession, d: str) -> DataFrame:
    """Profiles of a given classification, so the result is plain SQL."""
    p, classes = _cut_classes(s, d)
    return reinert.profiles(p, classes, 3).select("class_id", "form", "freq", "in_all", "chi2", "sign")


@query
def ca_eigenvalues(s: SparkSession, d: str) -> DataFrame:
    return correspondence.correspondence(tables.lexical_table(dtm(s, d), lang_groups(s, d), min_freq=5))["eigenvalues"]


@query
def ca_inertia(s: SparkSession, d: str) -> DataFrame:
    """The sum of the eigenvalues: chi-square over the total."""
    return correspondence.correspondence(tables.lexical_table(dtm(s, d), lang_groups(s, d), min_freq=5), axes=correspondence.MOST)["eigenvalues"].agg(F.sum("eigenvalue").alias("inertia"))


@query
def ca_columns(s: SparkSession, d: str) -> DataFrame:
    return correspondence.correspondence(tables.lexical_table(dtm(s, d), lang_groups(s, d), min_freq=5))["columns"]


@query
def wordfish_sources(s: SparkSession, d: str) -> DataFrame:
    groups = source_key(table(s, d, "documents")).select("doc_id", F.col("source_key").alias("grp")).where("grp is not null")
    return correspondence.wordfish(dtm(s, d), groups)


@query
def lda_topics(s: SparkSession, d: str) -> DataFrame:
    return topics.lda(dtm(s, d), k=4, most=MAX_FEATURES, rounds=LDA_ROUNDS).terms.where("place <= 10")


@query
def lda_dominant(s: SparkSession, d: str) -> DataFrame:
    return topics.dominant_topics(topics.lda(dtm(s, d), k=4, most=MAX_FEATURES, rounds=LDA_ROUNDS))


@query
def kmeans_documents(s: SparkSession, d: str) -> DataFrame:
    return topics.cluster(dtm(s, d), 4, most=MAX_FEATURES)


# lexicons, variants, streams -----------------------------------------------------------------------------------------------------------------


@query
def sentiment_distribution(s: SparkSession, d: str) -> DataFrame:
    lex = s.createDataFrame([("sobre", 1), ("entre", -1), ("com", 0), ("para", 1)], "form string, polarity int")
    return lexicon.polarity(toks(s, d), lex)


@query
def emotion_totals(s: SparkSession, d: str) -> DataFrame:
    lex = s.createDataFrame([("sobre", "joy", 1), ("entre", "fear", 2), ("com", "positive", 1), ("para", "negative", 1), ("para", "joy", 1)], "form string, emotion string, score int")
    return lexicon.emotions(toks(s, d), lex)


@query
def sentiment_timeline(s: SparkSession, d: str) -> DataFrame:
    lex = s.createDataFrame([("sobre", 1), ("entre", -1)], "form string, polarity int")
    dates = table(s, d, "documents").select("doc_id", F.date_format("imported_at", "yyyy-MM").alias("day")).where("day is not null")
    return lexicon.timeline(toks(s, d), lex, dates)


@query
def fuzzy_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return fuzzy.variant_groups(corpus.form_counts(toks(s, d)), T.fold(F.col("form"))).select("key", "canonical", "form", "freq")


@query
def fuzzy_ngram_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return fuzzy.variant_groups(corpus.form_counts(toks(s, d)), fuzzy.ngram_fingerprint(F.col("form")))


@query
def fuzzy_levenshtein_pairs(s: SparkSession, d: str) -> DataFrame:
    return fuzzy.close_pairs(corpus.form_counts(toks(s, d)))


@query
def fuzzy_levenshtein_clusters(s: SparkSession, d: str) -> DataFrame:
    return fuzzy.close_clusters(corpus.form_counts(toks(s, d)))


@query
def stream_event_counts(s: SparkSession, d: str) -> DataFrame:
    stream = s.readStream.schema(table(s, d, "events").schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(d)
    sums = counts.run_available(stream.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")))
    return sums.select("event_type", "n", F.round("value", 4).alias("value"))


@query
def stream_daily_counts(s: SparkSession, d: str) -> DataFrame:
    stream = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    return counts.run_available(counts.windowed_counts(stream, "ts", "event_type")).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _rounded(f: Query, columns: tuple[str, ...], digits: int) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return f(s, d).withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})

    return run


for _name, _columns in FLOATS.items():
    QUERIES[_name] = _rounded(QUERIES[_name], _columns, DECIMALS.get(_name, 6))


def entry(s: SparkSession, d: str) -> DataFrame:
    """The flagship: the 50 most frequent terms with their document frequency, their dispersion and whether they are hapaxes."""
    d_counts = dtm(s, d)
    top = corpus.top_forms(corpus.form_counts(toks(s, d)), 50)
    spread_out = contexts.dispersion(d_counts, table(s, d, "documents")).select("form", "juilland_d")
    return top.join(spread_out, "form").select("form", "freq", "doc_freq", "juilland_d", (F.col("freq") == 1).alias("hapax"))


