"""Correspondence analysis of contingency tables and one-dimensional scaling of documents.

Margins, standardised residuals and projections are relational. The eigenproblem is solved on the smaller side of the table, which is refused above ``MOST`` categories:
only its Gram matrix, at most ``MOST``^2 numbers and summed by Spark, comes to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import written

MOST = 2000


def _eigen(matrix: np.ndarray, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix and their vectors; the sign of an axis is arbitrary, so its largest coordinate is made positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")[: min(axes, max(len(matrix) - 1, 0))]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order]
    for k in range(vectors.shape[1]):
        if vectors[np.argmax(np.abs(vectors[:, k])), k] < 0:
            vectors[:, k] *= -1
    return values, vectors


def _gram(cells: DataFrame, value: str) -> DataFrame:
    """Sums of products of ``value`` of two groups over the forms both have, group pairs in order."""
    packed = cells.groupBy("form").agg(F.array_sort(F.collect_list(F.struct("grp", F.col(value).alias("v")))).alias("xs"))
    first = packed.select("xs", F.posexplode("xs").alias("i", "a"))
    both = first.select("a", F.explode(F.expr("slice(xs, i + 1, size(xs))")).alias("b"))
    return both.groupBy(F.col("a.grp").alias("g"), F.col("b.grp").alias("h")).agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def correspondence(table: DataFrame, axes: int = 4) -> dict[str, DataFrame]:
    """CA of a long table ``form, grp, n`` (n > 0), ``grp`` the smaller side.

    ``eigenvalues``: axis, eigenvalue, percent. ``rows`` and ``columns``: label, axis, coordinate (principal), correlation (coordinate / distance to the centre).
    The eigenvalues sum to chi-square / n over all axes; percentages are of that sum.
    """
    spark = table.sparkSession
    # written once, as every margin and every action below reads it
    cells = written(table.where("n > 0").groupBy("form", "grp").agg(F.sum("n").cast("double").alias("n")), "cells")
    rows, cols = cells.groupBy("form").agg(F.sum("n").alias("r")), cells.groupBy("grp").agg(F.sum("n").alias("c"))
    total = cols.agg(F.sum("c")).scalar()
    full = cells.join(rows, "form").join(cols, "grp").withColumn("t", total)
    # s = (p - rc) / sqrt(rc) = n / sqrt(r c) - sqrt(r c) / t; the second part is the trivial axis, so the Gram matrix of the first less that axis is enough
    weighted = full.withColumn("w", F.col("n") / F.sqrt(F.col("r") * F.col("c")))
    masses = dict(cols.select("grp", "c").orderBy("grp").limit(MOST + 1).collect())
    if len(masses) > MOST:
        raise ValueError(f"the smaller side of the table has more than {MOST} categories")
    labels, size = list(masses), sum(masses.values())
    at = {g: k for k, g in enumerate(labels)}
    root = np.sqrt(np.array([masses[g] for g in labels]) / size) if labels else np.zeros(0)
    gram = np.zeros((len(labels), len(labels)))
    for g, h, v in _gram(weighted, "w").collect():  # at most MOST^2 / 2 rows
        gram[at[g], at[h]] = gram[at[h], at[g]] = v
    gram -= np.outer(root, root)
    inertia = float(np.trace(gram))
    values, vectors = _eigen(gram, axes)
    eigen = [(k + 1, float(v), 100 * float(v) / inertia if inertia > 0 else 0.0) for k, v in enumerate(values)]
    standard = [(g, k + 1, float(vectors[i, k] / np.sqrt(masses[g] / size)), float(values[k])) for i, g in enumerate(labels) for k in range(len(values))]
    axis = spark.createDataFrame(standard, "grp string, axis int, standard double, eigenvalue double")
    columns = axis.select(F.col("grp").alias("label"), "axis", (F.col("standard") * F.sqrt("eigenvalue")).alias("coordinate"))
    # transition: a row's coordinate is the mean of the columns' standard coordinates under its profile
    projected = full.join(axis, "grp").groupBy(F.col("form").alias("label"), "axis").agg(F.sum(F.col("n") / F.col("r") * F.col("standard")).alias("coordinate"))

    def quality(c: DataFrame) -> DataFrame:
        length = F.sqrt(F.sum(F.col("coordinate") ** 2).over(Window.partitionBy("label")))
        return c.withColumn("correlation", F.when(length > 0, F.col("coordinate") / length).otherwise(0.0))

    return {"eigenvalues": spark.createDataFrame(eigen, "axis int, eigenvalue double, percent double"), "rows": quality(projected), "columns": quality(columns)}


def wordfish(dtm: DataFrame, groups: DataFrame, key: str = "doc_id", min_freq: int = 3, most: int = 1200) -> DataFrame:
    """``grp, score``: one-dimensional scaling of groups of documents: log1p counts of the ``most`` frequent forms, centred by form, first singular axis; the largest score is positive."""
    counts = dtm.join(groups, key).groupBy("form", "grp").agg(F.sum("n").alias("n"))
    forms = counts.groupBy("form").agg(F.sum("n").alias("f")).where(F.col("f") >= min_freq).orderBy(F.desc("f"), "form").limit(most)
    x = counts.join(forms.select("form"), "form").select("form", "grp", F.log1p("n").alias("x"))
    names = sorted(r[0] for r in x.select("grp").distinct().limit(MOST + 1).collect())
    if len(names) > MOST:
        raise ValueError(f"more than {MOST} groups")
    m = len(names)
    at = {g: k for k, g in enumerate(names)}
    gram = np.zeros((m, m))
    for a, b, v in _gram(x, "x").collect():
        gram[at[a], at[b]] = gram[at[b], at[a]] = v
    # centring each form over groups is J G J with J the centring matrix
    centre = np.eye(m) - np.ones((m, m)) / max(m, 1)
    values, vectors = np.linalg.eigh(centre @ gram @ centre) if m else (np.zeros(0), np.zeros((0, 0)))
    if not m:
        return dtm.sparkSession.createDataFrame([], "grp string, score double")
    scores = vectors[:, -1] * np.sqrt(max(values[-1], 0.0))
    scores = -scores if scores[np.argmax(np.abs(scores))] < 0 else scores
    return dtm.sparkSession.createDataFrame([(g, float(s)) for g, s in zip(names, scores)], "grp string, score double")
