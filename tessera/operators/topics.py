"""Topic models over long document-term tables, and what is read off them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Topics:
    """``terms``: topic, form, weight, place. ``documents``: key, topic, gamma. ``perplexity``: log perplexity on the input."""

    terms: DataFrame
    documents: DataFrame
    perplexity: float


def features(dtm: DataFrame, most: int = 2000, min_freq: int = 2, key: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """Sparse vectors ``key, features`` over the ``most`` frequent forms (ties by form), and those forms. The vocabulary is bounded by ``most``."""
    counts = dtm.groupBy("form").agg(F.sum("n").alias("f")).where(F.col("f") >= min_freq).orderBy(F.desc("f"), "form").limit(most)
    words = [r[0] for r in counts.select("form").orderBy("form").collect()]
    each = dtm.groupBy(key, "form").agg(F.sum("n").cast("int").alias("n"))
    packed = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("form", "n"))).alias("pairs"))
    repeated = packed.select(key, F.flatten(F.transform("pairs", lambda p: F.array_repeat(p["form"], p["n"]))).alias("words"))
    return CountVectorizerModel.from_vocabulary(words or [""], "words", "features").transform(repeated).select(key, "features"), words


def lda(dtm: DataFrame, k: int = 6, seed: int = 42, most: int = 2000, min_freq: int = 2, rounds: int = 20, key: str = "doc_id") -> Topics:
    """Latent Dirichlet allocation by online variational Bayes."""
    vectors, words = features(dtm, most, min_freq, key)
    vectors = vectors.cache()
    model = LDA(k=k, seed=seed, maxIter=rounds, optimizer="online").fit(vectors)
    names = F.array(*map(F.lit, words))
    top = model.describeTopics(len(words)).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
    terms = top.select("topic", F.get(names, F.col("t.termIndices")).alias("form"), F.col("t.termWeights").alias("weight"), (F.col("place") + 1).alias("place"))
    documents = model.transform(vectors).select(key, F.posexplode(vector_to_array("topicDistribution")).alias("topic", "gamma"))
    return Topics(terms, documents, float(model.logPerplexity(vectors)))


def tune(dtm: DataFrame, ks: range = range(2, 21), seed: int = 42, **options: int) -> DataFrame:
    """``k, log_perplexity`` for each number of topics."""
    rows = [(k, lda(dtm, k, seed, **options).perplexity) for k in ks]
    return dtm.sparkSession.createDataFrame(rows, "k int, log_perplexity double")


def stability(dtm: DataFrame, k: int = 6, seeds: tuple[int, ...] = (1, 2, 3), n: int = 25, **options: int) -> DataFrame:
    """``seed, topic, best``: how well each topic of the first seed is met again under the other seeds: the best weighted Jaccard of the first ``n`` terms."""
    base = lda(dtm, k, seeds[0], **options).terms.where(F.col("place") <= n).select("topic", "form", F.col("weight").alias("w1"))
    out = None
    for seed in seeds[1:]:
        other = lda(dtm, k, seed, **options).terms.where(F.col("place") <= n).select(F.col("topic").alias("o"), "form", F.col("weight").alias("w2"))
        shared = base.join(other, "form").groupBy("topic", "o").agg(F.sum(F.least("w1", "w2")).alias("least"))
        a, b = base.groupBy("topic").agg(F.sum("w1").alias("a")), other.groupBy("o").agg(F.sum("w2").alias("b"))
        part = shared.join(a, "topic").join(b, "o").groupBy("topic").agg(F.max(F.col("least") / (F.col("a") + F.col("b") - F.col("least"))).alias("best"))
        part = part.select(F.lit(seed).alias("seed"), "topic", "best")
        out = part if out is None else out.unionByName(part)
    return out


def topic_labels(topics: Topics, n: int = 3) -> DataFrame:
    """``topic, label``: the first ``n`` terms joined by a slash."""
    first = topics.terms.where(F.col("place") <= n).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "form"))).alias("t"))
    return first.select("topic", F.array_join(F.transform("t", lambda x: x["form"]), " / ").alias("label"))


def dominant_topics(topics: Topics, key: str = "doc_id", margin: float = 0.15) -> DataFrame:
    """``key, topic, gamma, margin, entropy, mixed``: each document's strongest topic, its lead, the normalised entropy, and whether the lead is under ``margin``."""
    packed = topics.documents.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("gamma", (-F.col("topic")).alias("minus"))), asc=False).alias("g"))
    entropy = F.aggregate("g", F.lit(0.0), lambda a, x: a - F.when(x["gamma"] > 0, x["gamma"] * F.log(x["gamma"])).otherwise(0.0))
    lead = F.col("g")[0]["gamma"] - F.coalesce(F.get("g", F.lit(1))["gamma"], F.lit(0.0))
    return packed.select(
        key, (-F.col("g")[0]["minus"]).alias("topic"), F.col("g")[0]["gamma"].alias("gamma"), lead.alias("margin"),
        F.when(F.size("g") > 1, entropy / F.log(F.size("g"))).otherwise(0.0).alias("entropy"), (lead < margin).alias("mixed"),
    )


def topic_overlap(topics: Topics, n: int = 25) -> DataFrame:
    """``topic_a < topic_b, jaccard``: weighted Jaccard of the first ``n`` terms' weights. Topics are few."""
    top = topics.terms.where(F.col("place") <= n).select("topic", "form", "weight")
    a, b = top.select(F.col("topic").alias("topic_a"), "form", F.col("weight").alias("wa")), top.select(F.col("topic").alias("topic_b"), "form", F.col("weight").alias("wb"))
    shared = a.join(b, "form").where("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.sum(F.least("wa", "wb")).alias("least"))
    sums = top.groupBy("topic").agg(F.sum("weight").alias("s"))
    joined = shared.join(sums.select(F.col("topic").alias("topic_a"), F.col("s").alias("sa")), "topic_a").join(sums.select(F.col("topic").alias("topic_b"), F.col("s").alias("sb")), "topic_b")
    # sum of the larger weights = both sums less the sum of the smaller ones
    return joined.select("topic_a", "topic_b", (F.col("least") / (F.col("sa") + F.col("sb") - F.col("least"))).alias("jaccard"))


def class_topics(topics: Topics, classes: DataFrame, key: str = "doc_id") -> DataFrame:
    """``class_id, topic, mean_gamma, dominant``: the mean mixture of topics of each class."""
    means = topics.documents.join(classes, key).groupBy("class_id", "topic").agg(F.avg("gamma").alias("mean_gamma"))
    first = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("mean_gamma"), "topic")) == 1
    return means.withColumn("dominant", first)


def cluster(dtm: DataFrame, k: int = 5, seed: int = 42, bisecting: bool = False, most: int = 2000, key: str = "doc_id") -> DataFrame:
    """``key, cluster`` by k-means (or bisecting k-means) on the count vectors: the alternate classifiers."""
    vectors, _ = features(dtm, most, key=key)
    vectors = vectors.cache()
    model = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed).fit(vectors)
    return model.transform(vectors).select(key, F.col("prediction").cast(T.IntegerType()).alias("cluster"))
