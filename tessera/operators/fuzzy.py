"""Spelling variants of forms: fingerprints, n-gram fingerprints and edit distance within blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold
from tessera.session import written


def fingerprint(text: Column) -> Column:
    """Folded distinct words in order, joined by blanks."""
    words = F.filter(F.split(F.regexp_replace(fold(text), r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def ngram_fingerprint(text: Column, n: int = 2) -> Column:
    """Folded distinct character n-grams in order, joined."""
    bare = F.regexp_replace(fold(text), r"[^\p{L}\p{N}]", "")
    last = F.length(bare) - n + 1
    grams = F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(bare, i, n))).otherwise(F.array(bare))
    return F.array_join(F.array_sort(F.array_distinct(grams)), "")


def variant_groups(forms: DataFrame, key: Column) -> DataFrame:
    """``key, canonical, form, freq``: forms that share a key, of which there are several; the most frequent is canonical (ties by form)."""
    keyed = forms.select(key.alias("key"), "form", "freq")
    groups = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min_by("form", F.struct((-F.col("freq")).alias("f"), "form")).alias("canonical")).where(F.col("size") > 1)
    return keyed.join(groups, "key").select("key", "canonical", "form", "freq")


def close_pairs(forms: DataFrame, most: int = 1, prefix: int = 3) -> DataFrame:
    """``form_a < form_b, distance``: forms with one folded prefix at most ``most`` edits apart.

    Blocks are the prefix, the length and one of ``most`` + 1 equal parts that two such forms must share at about the same place (they differ in ``most`` places at the most), so
    a prefix that many forms have is many small blocks. Forms too short for parts meet under their prefix and length.
    """
    rows = forms.select("form", fold(F.col("form")).alias("d"))
    rows = rows.select("form", "d", F.substring("d", 1, prefix).alias("block"), F.length("d").alias("len"))
    n = most + 1

    def parts(length: Column, shifts: range) -> Column:
        """Keys (part, text) of ``d``, cut as a form of ``length`` would be, each moved by the shifts."""
        found = []
        for k in range(n):
            start, stop = F.floor(length * k / n).cast("int"), F.floor(length * (k + 1) / n).cast("int")
            found += [F.struct(F.lit(k).alias("part"), F.substring(F.col("d"), start + 1 + s, stop - start).alias("piece")) for s in shifts]
        return F.array_distinct(F.array(*found))

    # the shorter form's parts are cut by its own length, the longer one's by the shorter's, wherever edits may have moved them
    left = rows.select("block", "form", "d", "len", F.explode(parts(F.col("len"), range(1))).alias("key"))
    longer = rows.withColumn("short", F.explode(F.sequence(F.greatest(F.col("len") - most, F.lit(0)), F.col("len"))))
    right = longer.select("block", F.col("form").alias("form2"), F.col("d").alias("d2"), F.col("len").alias("len2"), F.col("short").alias("len"), F.explode(parts(F.col("short"), range(-most, most + 1))).alias("key"))
    pairs = left.join(right, ["block", "len", "key"]).where((F.col("len") < F.col("len2")) | (F.col("form") < F.col("form2"))).where("form <> form2")
    named = pairs.select(F.least("form", "form2").alias("form_a"), F.greatest("form", "form2").alias("form_b"), F.levenshtein("d", "d2", most).alias("distance"))
    return named.where(F.col("distance").between(0, most)).distinct()


def close_clusters(forms: DataFrame, most: int = 1, prefix: int = 3, rounds: int = 100) -> DataFrame:
    """``canonical, form, freq, cluster_freq``: close forms in clusters. In the order of their names each form that is in no cluster opens one with the later close forms that are
    in none; the most frequent member is canonical (ties by name). Rounds settle forms whose earlier neighbours are settled, so they follow the longest chain of close forms."""
    pairs = written(close_pairs(forms, most, prefix).select(F.col("form_a").alias("a"), F.col("form_b").alias("b")), "pairs")
    state = written(pairs.select(F.col("a").alias("form")).union(pairs.select("b")).distinct().withColumn("center", F.lit(None).cast("boolean")), "state")
    for _ in range(rounds):
        earlier = pairs.join(state.withColumnRenamed("form", "a"), "a").groupBy(F.col("b").alias("form")).agg(F.coalesce(F.bool_or("center"), F.lit(False)).alias("taken"), F.bool_or(F.col("center").isNull()).alias("open"))
        told = F.when(F.col("taken"), False).when(~F.col("open"), True)
        joined = state.join(earlier, "form", "left").fillna(False, ["taken", "open"])
        state = written(joined.select("form", F.coalesce("center", told).alias("center")), "state")
        if not state.where("center is null").limit(1).count():
            break
    else:
        raise RuntimeError(f"clusters did not settle in {rounds} rounds")
    centers = state.where("center").select(F.col("form").alias("a"))
    members = pairs.join(centers, "a").groupBy("b").agg(F.min("a").alias("cluster")).join(state.where("not center").select(F.col("form").alias("b")), "b").select(F.col("b").alias("form"), "cluster")
    every = members.unionByName(members.select(F.col("cluster").alias("form"), "cluster").distinct()).join(forms.select("form", "freq"), "form")
    heads = every.groupBy("cluster").agg(F.min_by("form", F.struct((-F.col("freq")).alias("f"), "form")).alias("canonical"), F.sum("freq").alias("cluster_freq"))
    return every.join(heads, "cluster").select("canonical", "form", "freq", "cluster_freq")


def apply_variants(toks: DataFrame, canonical: DataFrame) -> DataFrame:
    """Tokens with variants (``form, canonical``) replaced."""
    return toks.join(canonical, "form", "left").withColumn("form", F.coalesce("canonical", "form")).drop("canonical")
