"""The corpus model: documents, metadata, tokens, forms, and the counts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.tokenizers import tokenize, tokens
from tessera.session import written


def metadata(docs: DataFrame, key: str = "doc_id", etoiles: str = "etoiles") -> DataFrame:
    """``key, variable, value``: the metadata tokens ``*var_value`` of each document, split at the first underscore, the variable in small letters.

    Tokens with an empty side and the literal ``****`` are left out; of a variable named twice the last value holds. Null headers give none.
    """
    parts = docs.select(key, F.posexplode(F.split(F.trim(etoiles), r"\s+")).alias("at", "token")).where("token rlike '^\\\\*+[^*_]+_.+$'")
    bare = F.regexp_replace("token", r"^\*+", "")
    rows = parts.select(key, "at", F.lower(F.substring_index(bare, "_", 1)).alias("variable"), F.regexp_replace(bare, "^[^_]+_", "").alias("value"))
    return rows.groupBy(key, "variable").agg(F.max_by("value", "at").alias("value"))


def form_counts(toks: DataFrame, key: str = "doc_id", form: str = "form") -> DataFrame:
    """``form, freq, doc_freq``. Counted per document first, so both come from one aggregation over small groups."""
    per_doc = toks.groupBy(form, key).agg(F.count("*").alias("n"))
    return per_doc.groupBy(form).agg(F.sum("n").alias("freq"), F.count("*").alias("doc_freq"))


def first_positions(toks: DataFrame, key: str = "doc_id", form: str = "form") -> DataFrame:
    """Each form with its first occurrence, the identity order of the corpus."""
    return toks.groupBy(form).agg(F.min(F.struct(key, "pos")).alias("first"))


def corpus_statistics(docs: DataFrame, rule: str = "alpha3") -> DataFrame:
    """One row: documents, forms, occurrences, hapaxes, mean tokens a document, richness = hapaxes / forms."""
    forms = tokens(docs, rule).groupBy("form").agg(F.count("*").alias("freq"))
    total = docs.agg(F.count("*").alias("n_docs"))
    counts = forms.agg(F.count("*").alias("n_forms"), F.coalesce(F.sum("freq"), F.lit(0)).alias("n_occurrences"), F.count_if(F.col("freq") == 1).alias("n_hapax"))
    docs_n = total.scalar()
    return counts.select(
        docs_n.alias("n_docs"), "n_forms", "n_occurrences", "n_hapax",
        F.when(docs_n > 0, F.col("n_occurrences") / docs_n).otherwise(0.0).alias("mean_tokens"),
        F.when(F.col("n_forms") > 0, F.col("n_hapax") / F.col("n_forms")).otherwise(0.0).alias("richness"),
    )


def top_forms(forms: DataFrame, n: int = 100) -> DataFrame:
    """The n most frequent forms, ties by form; all for n <= 0."""
    ordered = forms.orderBy(F.desc("freq"), "form")
    return ordered.limit(n) if n > 0 else ordered


def frequency_spectrum(forms: DataFrame) -> DataFrame:
    """``freq, n_forms``: how many forms have each frequency."""
    return forms.groupBy("freq").agg(F.count("*").alias("n_forms"))


def document_sizes(docs: DataFrame, rule: str = "alpha") -> DataFrame:
    """``doc_id, n_tokens``; null texts have 0. No shuffle."""
    return docs.select("doc_id", F.greatest(F.coalesce(F.size(tokenize(F.col("text"), rule)), F.lit(0)), F.lit(0)).alias("n_tokens"))


def document_terms(toks: DataFrame, key: str = "doc_id") -> DataFrame:
    """The long document-term matrix ``key, form, n``."""
    return toks.groupBy(key, "form").agg(F.count("*").alias("n"))


def matrix_statistics(dtm: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of a long matrix ``key, form, n``: its dimensions, non-zeros, sparsity, total, and means."""
    per_form = dtm.groupBy("form").agg(F.count("*").alias("nnz"), F.sum("n").alias("n"))
    rows = dtm.select(key).distinct().agg(F.count("*")).scalar()
    out = per_form.agg(F.count("*").alias("n_terms"), F.sum("nnz").alias("nnz"), F.sum("n").alias("total")).withColumn("n_docs", rows)
    cells = F.col("n_docs") * F.col("n_terms")
    return out.select(
        "n_docs", "n_terms", "nnz", "total", (1 - F.col("nnz") / cells).alias("sparsity"),
        (F.col("total") / F.col("n_docs")).alias("mean_doc_length"), (F.col("total") / F.col("n_terms")).alias("mean_term_freq"),
    )


def subcorpus(docs: DataFrame, meta: DataFrame, variable: str, values: list[str], key: str = "doc_id") -> DataFrame:
    """The documents that carry one of the values, with new consecutive ids ``uci_id`` in the order of the old. A semi join; no row is doubled.

    The numbering is by ranges: counts per range, then offsets, so no task sorts all documents.
    """
    wanted = meta.where((F.col("variable") == variable) & F.col("value").isin(values)).select(key)
    return numbered(docs.join(wanted, key, "left_semi"), key, "uci_id")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers from 0 in the order of a column, by range partitions and their offsets (one small row a partition goes to the driver)."""
    ranged = written(df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = sorted((r[0], r[1]) for r in ranged.groupBy("_part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets += [F.lit(part), F.lit(total)]
        total += n
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    base = F.create_map(*offsets)[F.col("_part")] if offsets else F.lit(0)
    return ranged.withColumn(name, (within + base).cast("bigint")).drop("_part")


def tie_cut(forms: DataFrame, most: int, key: Column | str = "freq") -> DataFrame:
    """The forms kept by the vocabulary cut at ``most``: with t the frequency at that rank, none of the ties of t; all if there are no more than ``most``.

    If t occurs once, the forms above it; else, if some form has t + 1, those above t + 1, otherwise those above t.
    """
    freq = F.col(key) if isinstance(key, str) else key
    spectrum = forms.groupBy(freq.alias("f")).agg(F.count("*").alias("n"))
    # the spectrum has one row for each distinct frequency: its running sum is the one ordered step
    above = F.sum("n").over(Window.orderBy(F.desc("f")).rowsBetween(Window.unboundedPreceding, -1))
    ranked = spectrum.withColumn("above", F.coalesce(above, F.lit(0))).withColumn("has_next", F.lag("f").over(Window.orderBy(F.desc("f"))) == F.col("f") + 1)
    # one row, or none where nothing is cut
    at = ranked.where((F.col("above") < most) & (F.col("above") + F.col("n") >= most)).select(F.when((F.col("n") > 1) & F.coalesce("has_next", F.lit(False)), F.col("f") + 1).otherwise(F.col("f")))
    total = spectrum.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return forms.where((total <= most) | (freq > at.scalar()))


def vocabulary(forms: DataFrame, min_freq: int = 3, stopwords: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Forms of at least ``min_freq``, without those of ``stopwords`` (``form``), cut at ``most`` by ``tie_cut``."""
    kept = forms.where(F.col("freq") >= min_freq)
    kept = kept.join(stopwords.select("form"), "form", "left_anti") if stopwords is not None else kept
    return tie_cut(kept, most) if most else kept


def dropped_forms(forms: DataFrame, min_freq: int, stopwords: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """``form, reason`` of every form left out: the first that holds of invalid_token, below_min_freq, stopword, not_selected."""
    flagged = forms.join(stopwords.select("form", F.lit(True).alias("stop")), "form", "left")
    if selected is not None:
        flagged = flagged.join(selected.select("form", F.lit(True).alias("chosen")), "form", "left")
    reason = F.when(F.length("form") < 2, "invalid_token").when(F.col("freq") < min_freq, "below_min_freq").when(F.col("stop"), "stopword")
    reason = reason.when(F.col("chosen").isNull(), "not_selected") if selected is not None else reason
    return flagged.select("form", reason.alias("reason")).where("reason is not null")


def unit_presence(postings: DataFrame, unit: str = "uce_id", form: str = "form") -> DataFrame:
    """``unit, form``: distinct pairs, without null or blank sides."""
    return postings.where(F.col(unit).isNotNull() & (F.trim(form) != "")).select(unit, form).distinct()
