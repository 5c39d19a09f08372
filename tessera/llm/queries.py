"""The pN queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.terms import with_term
from tessera.llm.containers import fill_containers, fill_report
from tessera.llm.mixture import Mixture
from tessera.llm.mojibake import garbled, restored_tokens
from tessera.llm.pair_table import PairTable
from tessera.llm.sentences import sentences
from tessera.llm.split_records import current_settings, split_records
from tessera.llm.term_bitmaps import record_count, term_bitmaps, term_frequencies
from tessera.llm.top_n import top_n
from tessera.session import table


def p1_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Every form and phrase with its total frequency, number of records and mark."""
    postings, keyphrases = table(spark, folder, "postings"), table(spark, folder, "keyphrases")
    forms = term_bitmaps(postings, F.col("form"), F.col("uce_id"), F.col("n"))
    phrases = term_bitmaps(keyphrases, F.col("phrase"), F.col("uci_id"), F.col("frequency"), doc_count=F.col("doc_count"))
    first = term_frequencies(forms, record_count(postings, F.col("form"), F.col("uce_id"))).withColumn("doc_count", F.col("n_records"))
    second = term_frequencies(phrases, record_count(keyphrases, F.col("phrase"), F.col("uci_id")))
    both = first.withColumn("tab", F.lit("postings")).unionByName(second.withColumn("tab", F.lit("keyphrases")))
    return both.select("tab", "term", "frequency", "n_records", "doc_count", "mark")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_terms(spark, folder).where("mark <> 'useful'").select("tab", "term")


def _baskets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "postings").select(F.col("uce_id").alias("basket"), "form")
    return with_term(rows, F.col("form"), "term").select("basket", "term")


def _pair_table(spark: SparkSession, folder: str, **bounds: float) -> PairTable:
    """The table over all segments in two batches, as late rows come in: the second brings a sixteenth of the segments whole, half of which the first had with half their forms."""
    rows = _baskets(spark, folder)
    part = F.pmod(F.xxhash64("basket"), F.lit(32))
    first = rows.where((part >= 2) | (part == 1) & (F.pmod(F.xxhash64("term"), F.lit(2)) == 0))
    return PairTable(spark, **bounds).apply(first).apply(rows.where(part < 2))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of at least 12 shared segments and a lift of at least 20."""
    return _pair_table(spark, folder, min_together=12, min_lift=20.0).scores().select("term_a", "term_b")


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of forms that share a segment."""
    scores = _pair_table(spark, folder).scores()
    return scores.select("term_a", "term_b", "cooccurrence", F.round("ppmi", 6).alias("ppmi"))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    topics, lines = table(spark, folder, "topic_corpus"), table(spark, folder, "kwic_lines")
    first = topics.select(F.lit("topic_corpus").alias("tab"), F.col("doc_id").cast("bigint").alias("row_key"), "text")
    return first.unionAll(lines.select(F.lit("kwic_lines"), F.col("line_id").cast("bigint"), F.col("sentence")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that hold garbled text; each key once."""
    return garbled(_texts(spark, folder)).select("tab", "row_key").distinct()


def p3_restored(spark: SparkSession, folder: str) -> DataFrame:
    """What garbled each row, its restored text, and a line's restored tokens."""
    found = garbled(_texts(spark, folder)).dropDuplicates(["tab", "row_key", "text_hash"])
    lines = table(spark, folder, "kwic_lines").select(F.lit("kwic_lines").alias("tab"), F.col("line_id").cast("bigint").alias("row_key"), "left_tokens", "keyword", "right_tokens", "sentence")
    # a key with several sentences keeps them apart
    keyed = lines.withColumn("text_hash", F.xxhash64("sentence")).dropDuplicates(["row_key", "text_hash"])
    joined = found.join(keyed, ["tab", "row_key", "text_hash"], "left")

    def tokens(c: str) -> Column:
        return restored_tokens(F.col(c), F.col("sentence"), F.col("restored")).alias(c)

    keyword = restored_tokens(F.array("keyword"), F.col("sentence"), F.col("restored"))[0].alias("keyword")
    return joined.select("tab", "row_key", "kind", "restored", tokens("left_tokens"), keyword, tokens("right_tokens"))


def p4_top(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "specificities")
    classes = table(spark, folder, "chd_profiles")
    named = F.concat_ws(":", F.when(F.col("class_id").isNotNull(), F.col("run_id").cast("string")), F.col("class_id").cast("string"))
    grp = F.when(F.col("run_id").isNotNull() & F.col("class_id").isNotNull(), named)
    first = top_n(words, F.col("variable"), F.col("word"), F.col("score"), F.col("frequency")).withColumn("tab", F.lit("specificities"))
    return first.unionByName(top_n(classes, grp, F.col("form"), F.col("chi2"), F.col("freq")).withColumn("tab", F.lit("chd_profiles")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_top(spark, folder).select("tab", "grp", "item")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_records(table(spark, folder, "uci_records"), table(spark, folder, "import_config"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).where("piece = 0").select("record_id")


def p5_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Of every record that is split: its tokens, pieces above the size, and tokens lost or not shared as asked between consecutive pieces. The last two are 0."""
    size, overlap = F.col("uce_size"), F.col("uce_overlap")
    pieces = p5_pieces(spark, folder).join(current_settings(table(spark, folder, "import_config")), "corpus_id")
    before = F.lag("end_token").over(Window.partitionBy("record_id").orderBy("piece"))
    rows = pieces.select("record_id", "start_token", "end_token", F.size("tokens").alias("n"), size, overlap, F.coalesce(before, F.lit(0)).alias("before"), "piece")
    off = (F.col("n") != F.col("end_token") - F.col("start_token")) | (F.col("before") - F.col("start_token") != F.when(F.col("piece") == 0, 0).otherwise(overlap))
    return rows.groupBy("record_id").agg(F.max("end_token").cast("bigint").alias("n_tokens"), F.count_if(F.col("n") > size).alias("too_long"), F.count_if(off).alias("off"))


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return fill_containers(table(spark, folder, "documents"), table(spark, folder, "container_specs"))


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each kind are."""
    return fill_report(p6_containers(spark, folder))


def p6_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Of each kind: documents assigned, containers above the capacity, documents in more pieces than they need. The last two are 0."""
    rows = p6_containers(spark, folder)
    keys = ["container_kind", "capacity_tokens"]
    full = rows.groupBy(*keys, "container_id").agg(F.sum("n_tokens").alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    docs = rows.groupBy(*keys, "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"))
    needless = F.count_if(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("capacity_tokens"))))
    return docs.groupBy(*keys).agg(F.count("*").alias("documents"), needless.alias("split_needlessly")).join(full, keys)


def _mixture(spark: SparkSession, folder: str, size: str | None = None) -> Mixture:
    return Mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), size)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The largest mixture that keeps the shares."""
    return _mixture(spark, folder).documents()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares really reached."""
    return _mixture(spark, folder).report()


def p7_all_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture of as many tokens as the targeted sources have: caps bind, and the sources they bind fall short."""
    return _mixture(spark, folder, "all").documents()


def p7_all_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mixture(spark, folder, "all").report()


def p7_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Of each target: the share asked for, that of sources with documents, the cap, and documents repeated more often than it allows (0)."""
    mix = _mixture(spark, folder)
    over = F.count_if(F.col("repeats") > F.col("cap"))
    report = mix.report().select("source", F.round("target_share", 6).alias("target_share"), F.round("share_with_documents", 6).alias("share_with_documents"), "cap")
    rows = mix.documents().join(report.select("source", "cap"), "source").groupBy("source").agg(over.alias("over_cap"))
    return report.join(rows, "source", "left").fillna(0, ["over_cap"])


def p8_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_sentences(spark, folder).select("doc_id", "start_pos")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}
