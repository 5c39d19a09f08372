"""Dictionary lookup, grammatical classes, stop words and lexicon-based scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import fold

#: Classes whose words are active (content) words.
ACTIVE = ("adv", "ver", "adj", "nom", "nr")
#: Portuguese plural endings and the singular endings to try, in order.
PLURALS = (("ões", "ão"), ("ães", "ão"), ("ães", "ãe"), ("ãos", "ão"), ("ais", "al"), ("eis", "el"), ("óis", "ol"), ("is", "il"), ("ns", "m"), ("s", ""))
#: Frequent Portuguese words without content of their own.
STOPWORDS = (
    "a ao aos as à às até com como da das de dela dele do dos e é ela ele elas eles em entre era essa esse esta está este eu foi há isso isto já lhe mais mas me mesmo "
    "meu minha na nas não nem no nos nós o os ou para pela pelas pelo pelos por qual quando que quem se sem ser seu seus só são sobre sua suas também te tem teu tua um uma você"
).split()

#: English words that n-grams leave out too.
ENGLISH_STOPWORDS = (
    "you your yours the and for with from this that was were are not have has had can could will would shall should what when where which who whom why how into onto over under "
    "than then there their them"
).split()


def prepare_lexicon(rows: DataFrame) -> DataFrame:
    """``word, lemma, gram, folded`` of dictionary rows (``pos, word, lemma, gram``): the last row of a word holds."""
    kept = rows.where("word is not null and lemma is not null and gram is not null").groupBy("word").agg(F.max_by(F.struct("lemma", "gram"), "pos").alias("r"), F.min("pos").alias("pos"))
    return kept.select("word", "r.lemma", "r.gram", fold(F.col("word")).alias("folded"), "pos")


def lookup(forms: DataFrame, lexicon: DataFrame, strict: bool = False) -> DataFrame:
    """``forms`` with ``lemma, gram, act``: exact word, else (unless ``strict``) folded word, else the first plural candidate that is a word.

    Unknown forms of digits only are ``num`` and supplementary, other unknown ones their own lemma, class ``nr``. One row a form: candidates are tried by priority in one
    join, and Spark broadcasts the lexicon or not by its size.
    """
    exact = F.array(F.struct(F.lit(0).alias("try"), F.lit("w").alias("how"), F.col("form").alias("key")))
    options = exact
    if not strict:
        tries = [F.when(F.col("form").endswith(end), F.struct(F.lit(2 + k).alias("try"), F.lit("w").alias("how"), F.concat(F.expr(f"left(form, length(form) - {len(end)})"), F.lit(single)).alias("key"))) for k, (end, single) in enumerate(PLURALS)]
        folded = F.struct(F.lit(1).alias("try"), F.lit("f").alias("how"), fold(F.col("form")).alias("key"))
        options = F.filter(F.concat(exact, F.array(folded, *tries)), lambda x: x.isNotNull())
    words = lexicon.select(F.lit("w").alias("how"), F.col("word").alias("key"), "lemma", "gram")
    first = lexicon.groupBy("folded").agg(F.min_by(F.struct("lemma", "gram"), "pos").alias("r")).select(F.lit("f").alias("how"), F.col("folded").alias("key"), "r.lemma", "r.gram")
    tried = forms.select("form", F.explode(options).alias("o")).select("form", "o.*")
    hits = tried.join(words.unionByName(first), ["how", "key"]).groupBy("form").agg(F.min_by(F.struct("lemma", "gram"), "try").alias("r"))
    gram = F.coalesce(F.col("r.gram"), F.when(F.col("form").rlike(r"^\p{N}+$"), "num").otherwise("nr"))
    out = forms.join(hits, "form", "left").withColumn("lemma", F.coalesce("r.lemma", "form")).withColumn("gram", gram).drop("r")
    return out.withColumn("act", F.when(F.col("gram").isin(*ACTIVE), 1).otherwise(2))


def without_stopwords(toks: DataFrame, stopwords: DataFrame, form: str = "form") -> DataFrame:
    """Tokens that aren't stop words, as they stand or folded."""
    words = stopwords.select(fold(F.col("form")).alias("_stop")).union(stopwords.select(F.col("form"))).distinct()
    return toks.join(words, toks[form] == words["_stop"], "left_anti")


def is_content(form: Column) -> Column:
    """Whether a form can stand in a picture of the content: no digit, three letters or more, and no part of a compound that is shorter than two."""
    return ~form.rlike(r"\p{N}") & (F.length(form) >= 3) & F.forall(F.split(form, "[_-]"), lambda p: F.length(p) >= 2)


def polarity(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``label, n, percent`` over Positivo, Negativa and Neutro for a lexicon ``form, polarity``; percentages of the matched tokens. Forms are counted before the join."""
    counts = toks.groupBy("form").agg(F.count("*").alias("n"))
    label = F.when(F.col("polarity") > 0, "Positivo").when(F.col("polarity") < 0, "Negativa").otherwise("Neutro")
    found = counts.join(lexicon, "form").groupBy(label.alias("label")).agg(F.sum("n").alias("n"))
    every = toks.sparkSession.createDataFrame([("Positivo",), ("Negativa",), ("Neutro",)], "label string")
    out = every.join(found, "label", "left").fillna(0, ["n"])
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return out.withColumn("percent", F.when(total > 0, F.col("n") * 100.0 / total).otherwise(0.0))


def emotions(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``emotion, n, percent`` for a lexicon ``form, emotion, score``; forms are scored once and weighted by their counts. Polarities (positive, negative) have a total of their own."""
    counts = toks.groupBy("form").agg(F.count("*").alias("n"))
    sums = counts.join(lexicon, "form").groupBy("emotion").agg(F.sum(F.col("n") * F.col("score")).alias("n"))
    polar = F.col("emotion").isin("positive", "negative")
    totals = sums.agg(F.sum(F.when(polar, F.col("n"))).alias("p"), F.sum(F.when(~polar, F.col("n"))).alias("e"))
    total = F.when(polar, totals.select("p").scalar()).otherwise(totals.select("e").scalar())
    return sums.withColumn("percent", F.col("n") * 100.0 / total)


def timeline(toks: DataFrame, lexicon: DataFrame, dates: DataFrame, key: str = "doc_id") -> DataFrame:
    """``day, positive, negative, balance`` for documents with a date (``key, day``)."""
    scored = toks.join(lexicon, "form").join(dates, key)
    out = scored.groupBy("day").agg(F.count_if(F.col("polarity") > 0).alias("positive"), F.count_if(F.col("polarity") < 0).alias("negative"))
    return out.withColumn("balance", F.col("positive") - F.col("negative"))
