"""Lexical tables, profiles, categorical tables and partition comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.measures import chi2_p, per, signed_chi2, signed_g2, signed_hypergeometric
from tessera.session import paired, written

#: Classes of a partition that are matched on the driver.
MOST_CLASSES = 1000


def lexical_table(dtm: DataFrame, groups: DataFrame, key: str = "doc_id", min_freq: int = 1) -> DataFrame:
    """``form, grp, n``: occurrences of each form in each group (``key, grp``), for forms with at least ``min_freq`` in all groups."""
    table = dtm.join(groups, key).groupBy("form", "grp").agg(F.sum("n").alias("n"))
    if min_freq <= 1:
        return table
    enough = table.groupBy("form").agg(F.sum("n").alias("all")).where(F.col("all") >= min_freq).select("form")
    return table.join(enough, "form", "left_semi")


def gram_table(dtm: DataFrame, lexicon: DataFrame, groups: DataFrame, key: str = "doc_id") -> DataFrame:
    """``gram, grp, n``: occurrences of each grammatical class (``form, gram``) in each group; forms without a class are ``nr``."""
    tagged = dtm.join(lexicon.select("form", "gram"), "form", "left").join(groups, key)
    return tagged.groupBy(F.coalesce("gram", F.lit("nr")).alias("gram"), "grp").agg(F.sum("n").alias("n"))


def lemma_postings(postings: DataFrame, lexicon: DataFrame, unit: str = "uce_id") -> DataFrame:
    """``lemma, unit, n``: occurrences of each lemma in each unit; forms without a lemma stand for themselves."""
    joined = postings.join(lexicon.select("form", "lemma"), "form", "left")
    return joined.groupBy(F.coalesce("lemma", "form").alias("lemma"), unit).agg(F.sum("n").alias("n"))


def matched_classes(first: DataFrame, second: DataFrame, n: int = 25) -> DataFrame:
    """``class_a, class_b, jaccard``: classes of two profile tables (``class_id, form, chi2``) matched by their ``n`` strongest terms, best match first, each class once.

    Classes are few: the greedy choice is made over their pairs on the driver, and more than ``MOST_CLASSES`` classes are refused.
    """
    place = F.row_number().over(Window.partitionBy("class_id").orderBy(F.desc("chi2"), "form"))
    a, b = (p.withColumn("p", place).where(F.col("p") <= n).groupBy("class_id").agg(F.collect_set("form").alias("t")) for p in (first, second))
    if max(a.limit(MOST_CLASSES + 1).count(), b.limit(MOST_CLASSES + 1).count()) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    pairs = paired(a.select(F.col("class_id").alias("class_a"), F.col("t").alias("ta")), b.select(F.col("class_id").alias("class_b"), F.col("t").alias("tb")))
    scored = pairs.select("class_a", "class_b", (F.size(F.array_intersect("ta", "tb")) / F.size(F.array_union("ta", "tb"))).alias("jaccard")).orderBy(F.desc("jaccard"), "class_a", "class_b")
    taken, used_a, used_b = [], set(), set()
    for r in scored.collect():
        if r.class_a not in used_a and r.class_b not in used_b:
            used_a.add(r.class_a)
            used_b.add(r.class_b)
            taken.append((r.class_a, r.class_b, r.jaccard))
    return first.sparkSession.createDataFrame(taken, "class_a int, class_b int, jaccard double")


def presence_table(dtm: DataFrame, groups: DataFrame, key: str = "doc_id", least: int = 3) -> DataFrame:
    """``form, grp, n``: units of each group that hold the form, for forms in at least ``least`` units. ``dtm`` has a row for each (unit, form)."""
    table = dtm.join(groups, key).groupBy("form", "grp").agg(F.count("*").alias("n"))
    return table.join(table.groupBy("form").agg(F.sum("n").alias("all")).where(F.col("all") >= least).select("form"), "form", "left_semi")


def _with_margins(table: DataFrame) -> DataFrame:
    """Adds the form's total, the group's total and the grand total to a long table ``form, grp, n``."""
    rows = table.groupBy("form").agg(F.sum("n").alias("form_total"))
    cols = table.groupBy("grp").agg(F.sum("n").alias("grp_total"))
    total = cols.agg(F.sum("grp_total")).scalar()
    return table.join(rows, "form").join(cols, "grp").withColumn("total", total)


def specificities(table: DataFrame, index: str = "chi2", most: int = 0) -> DataFrame:
    """``form, grp, n, form_total, score, per_thousand, sign``: how far each form is over- or under-used in each group; cells above 0 only.

    ``index`` is ``chi2`` (signed, 2x2, uncorrected) or ``hypergeo`` (signed -log10 tail). ``most`` > 0 keeps that many of the largest absolute scores a group.
    """
    full = _with_margins(table)
    cell = (F.col("n"), F.col("form_total"), F.col("grp_total"), F.col("total"))
    score = signed_chi2(*cell) if index == "chi2" else signed_hypergeometric(*cell)
    out = full.withColumn("score", score).select(
        "form", "grp", "n", "form_total", "score", per(F.col("n"), F.col("grp_total"), 1000.0).alias("per_thousand"), F.when(F.col("score") >= 0, "+").otherwise("-").alias("sign")
    )
    if most > 0:
        place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.abs("score")), "form"))
        out = out.withColumn("place", place).where(F.col("place") <= most).drop("place")
    return out


def chronological(table: DataFrame, span: int = 2, index: str = "chi2") -> DataFrame:
    """``form, grp, n, n_span, score``: each period against itself and the ``span`` periods before it. ``grp`` is the period, in its order; periods are few."""
    periods = table.groupBy("grp").agg(F.sum("n").alias("size"))
    frame = Window.partitionBy().orderBy("grp").rowsBetween(-span, 0)
    sizes = periods.select("grp", "size", F.sum("size").over(frame).alias("size_span"), F.row_number().over(Window.partitionBy().orderBy("grp")).alias("at"))
    placed = table.join(sizes, "grp")
    within = Window.partitionBy("form").orderBy("at").rangeBetween(-span, 0)
    cells = placed.withColumn("n_span", F.sum("n").over(within))
    cell = (F.col("n"), F.col("n_span"), F.col("size"), F.col("size_span"))
    return cells.select("form", "grp", "n", "n_span", (signed_chi2(*cell) if index == "chi2" else signed_hypergeometric(*cell)).alias("score"))


def keyness(dtm: DataFrame, target: DataFrame, key: str = "doc_id", measure: str = "lr", min_freq: int = 3) -> DataFrame:
    """``form, n_a, n_b, score, direction, norm_a, norm_b``: terms of the target documents (``key``) against the others, with rates per million.

    ``measure`` is ``lr`` (signed log-likelihood ratio), ``chi2`` or ``exact`` (signed -log10 hypergeometric tail); the plain formulas, without corrections.
    """
    sided = dtm.join(target.select(key).distinct().withColumn("inside", F.lit(1)), key, "left")
    counts = sided.groupBy("form").agg(F.sum(F.when(F.col("inside") == 1, F.col("n")).otherwise(0)).alias("n_a"), F.sum(F.when(F.col("inside").isNull(), F.col("n")).otherwise(0)).alias("n_b"))
    kept = counts.where(F.col("n_a") + F.col("n_b") >= min_freq)
    # the kept table is one row a form; its sums are two numbers
    sums = kept.agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b"))
    rows = kept.withColumn("size_a", sums.select("a").scalar()).withColumn("size_b", sums.select("b").scalar())
    a, b, na, nb = (F.col(c) for c in ("n_a", "n_b", "size_a", "size_b"))
    score = {"lr": lambda: signed_g2(a, b, na, nb), "chi2": lambda: signed_chi2(a, a + b, na, na + nb), "exact": lambda: signed_hypergeometric(a, a + b, na, na + nb)}[measure]()
    return rows.withColumn("score", score).select(
        "form", "n_a", "n_b", "score", F.when(F.col("score") >= 0, "A").otherwise("B").alias("direction"), per(a, na, 1e6).alias("norm_a"), per(b, nb, 1e6).alias("norm_b")
    )


def crosstab(df: DataFrame, row: str, col: str, most: int = 4_000_000) -> DataFrame:
    """``row, col, n, row_total, col_total, total, expected, residual`` of every cell, empty ones too: the margins are crossed, and they are categories.

    Null categories read ``(NA)``, blank ones ``(vazio)``. More than ``most`` cells are refused.
    """
    clean = df.select(*(F.when(F.col(c).isNull(), "(NA)").when(F.trim(F.col(c).cast("string")) == "", "(vazio)").otherwise(F.trim(F.col(c).cast("string"))).alias(k) for c, k in ((row, "row"), (col, "col"))))
    cells = written(clean.groupBy("row", "col").agg(F.count("*").alias("n")), "cells")
    sizes = cells.agg(F.count_distinct("row"), F.count_distinct("col")).first()
    if sizes[0] * sizes[1] > most:
        raise ValueError(f"{sizes[0]} x {sizes[1]} categories are more than {most} cells")
    rows, cols = cells.groupBy("row").agg(F.sum("n").alias("row_total")), cells.groupBy("col").agg(F.sum("n").alias("col_total"))
    total = rows.agg(F.sum("row_total")).scalar()
    full = paired(rows, cols).join(cells, ["row", "col"], "left").fillna(0, ["n"]).withColumn("total", total)
    expected = F.col("row_total") * F.col("col_total") / F.col("total")
    return full.withColumn("expected", expected).withColumn("residual", (F.col("n") - F.col("expected")) / F.sqrt(F.greatest(F.col("expected"), F.lit(1e-12))))


def chi2_test(df: DataFrame, row: str, col: str, yates: bool = True) -> DataFrame:
    """One row ``chi2, dof, p, n`` of two categorical columns; with Yates' correction where one degree of freedom is left, unless switched off."""
    cells = crosstab(df, row, col)
    dof = (F.count_distinct("row") - 1) * (F.count_distinct("col") - 1)
    plain = F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected"))
    less = F.greatest(F.abs(F.col("n") - F.col("expected")) - F.least(F.lit(0.5), F.abs(F.col("n") - F.col("expected"))), F.lit(0.0))
    out = cells.agg(plain.alias("plain"), F.sum(less**2 / F.col("expected")).alias("corrected"), dof.alias("dof"), F.max("total").alias("n"))
    chi2 = F.when((F.col("dof") == 1) & F.lit(yates), F.col("corrected")).otherwise(F.col("plain"))
    return out.select(chi2.alias("chi2"), "dof", "n").withColumn("p", chi2_p(F.col("chi2"), F.col("dof")))


def category_frequencies(df: DataFrame, column: str, most: int = 50) -> DataFrame:
    """``value, n, percent``: the most frequent categories; the percentage is of those kept."""
    value = F.trim(F.col(column).cast("string"))
    clean = df.select(F.when(value.isNull(), "(NA)").when(value == "", "(vazio)").otherwise(value).alias("value"))
    top = clean.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(most)
    return top.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def row_products(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """``col_a, col_b, value`` of XᵀX without its diagonal, from a long matrix; infinite and null values count 0. Columns of a matrix are few next to its rows."""
    v = F.col(value).cast("double")
    x = cells.select(F.col(row).alias("r"), F.col(col).alias("c"), F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v).alias("v")).groupBy("r", "c").agg(F.sum("v").alias("v")).where("v <> 0")
    packed = x.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("xs"))
    first = packed.select("xs", F.posexplode("xs").alias("at", "a"))
    both = first.select("a", F.explode(F.expr("slice(xs, at + 2, size(xs))")).alias("b"))
    return both.groupBy(F.col("a.c").alias("col_a"), F.col("b.c").alias("col_b")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("value"))


def partition_agreement(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row ``n, ari, nmi``: adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings; rows with a null label are left out."""
    cells = df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(F.col(first).alias("x"), F.col(second).alias("y")).agg(F.count("*").cast("double").alias("n"))
    xs, ys = cells.groupBy("x").agg(F.sum("n").alias("nx")), cells.groupBy("y").agg(F.sum("n").alias("ny"))

    def pairs(c: str) -> Column:
        return F.sum(F.col(c) * (F.col(c) - 1) / 2)

    total = cells.agg(F.sum("n")).scalar()
    joint = cells.join(xs, "x").join(ys, "y").withColumn("t", total)
    a = joint.agg(pairs("n").alias("both"), F.max("t").alias("n"), F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))
    hx = xs.withColumn("t", total).agg(pairs("nx").alias("px"), (-F.sum(F.col("nx") / F.col("t") * F.log(F.col("nx") / F.col("t")))).alias("hx"))
    hy = ys.withColumn("t", total).agg(pairs("ny").alias("py"), (-F.sum(F.col("ny") / F.col("t") * F.log(F.col("ny") / F.col("t")))).alias("hy"))
    row = a.withColumn("k", F.lit(1)).join(hx.withColumn("k", F.lit(1)), "k").join(hy.withColumn("k", F.lit(1)), "k")
    expected = F.col("px") * F.col("py") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("px") + F.col("py")) / 2
    return row.select(
        F.col("n").cast("bigint").alias("n"), F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"),
        F.when(F.col("hx") + F.col("hy") == 0, 1.0).otherwise(F.col("mi") / ((F.col("hx") + F.col("hy")) / 2)).alias("nmi"),
    )


def crossed_classes(first: DataFrame, second: DataFrame, unit: str = "uce_id", least: int = 1) -> DataFrame:
    """``class_a, class_b, n, chi2`` of two classifications of the same units, cells of at least ``least`` units with a signed chi-square above 3.84, best first."""
    both = first.select(unit, F.col("class_id").alias("class_a")).join(second.select(unit, F.col("class_id").alias("class_b")), unit)
    cells = both.groupBy(F.col("class_a").alias("form"), F.col("class_b").alias("grp")).agg(F.count("*").alias("n"))
    full = _with_margins(cells)
    scored = full.withColumn("chi2", signed_chi2(F.col("n"), F.col("form_total"), F.col("grp_total"), F.col("total")))
    return scored.where((F.col("n") >= least) & (F.col("chi2") > 3.84)).select(F.col("form").alias("class_a"), F.col("grp").alias("class_b"), "n", "chi2")


