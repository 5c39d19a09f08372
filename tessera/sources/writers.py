"""Writers: Parquet corpora, dictionaries, matrices and graphs."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.corpus import numbered


def save_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_corpus(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_table(df: DataFrame, path: str, sep: str = ";") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_dictionary(forms: DataFrame, path: str) -> None:
    """``form, lemma, gram, freq`` by descending frequency, tab-separated."""
    forms.select("form", "lemma", "gram", "freq").orderBy(F.desc("freq"), "form").write.mode("overwrite").option("sep", "\t").csv(path)


def matrix_market(cells: DataFrame, path: str, row: str, col: str, value: str) -> dict[str, DataFrame]:
    """A long matrix in coordinate form (1-based ``row column value`` lines, with the header file ``shape``), and its row and column names with their numbers."""
    rows = numbered(cells.select(row).distinct(), row, "i").withColumn("i", F.col("i") + 1)
    cols = numbered(cells.select(col).distinct(), col, "j").withColumn("j", F.col("j") + 1)
    lines = cells.join(rows, row).join(cols, col).select(F.concat_ws(" ", "i", "j", value).alias("line"))
    lines.write.mode("overwrite").text(f"{path}/entries")
    shape = f"%%MatrixMarket matrix coordinate real general\n{rows.count()} {cols.count()} {cells.count()}"
    cells.sparkSession.createDataFrame([(shape,)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/shape")
    return {"rows": rows, "columns": cols}


def dense(cells: DataFrame, row: str, col: str, value: str, most: int = 2000) -> DataFrame:
    """A small matrix with a column per ``col``; refused above ``most`` columns."""
    names = [r[0] for r in cells.select(col).distinct().orderBy(col).limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} columns")
    return cells.groupBy(row).pivot(col, names).agg(F.sum(value)).fillna(0)


def pajek(nodes: DataFrame, edges: DataFrame, most: int = 200_000) -> str:
    """A graph in Pajek's format; for pictures, so refused above ``most`` edges."""
    names, links = _small(nodes, edges, most)
    at = {n: k for k, n in enumerate(names, 1)}
    lines = [f"*Vertices {len(names)}", *(f'{k} "{n}"' for n, k in at.items()), "*Edges", *(f"{at[a]} {at[b]} {w:g}" for a, b, w in links)]
    return "\n".join(lines) + "\n"


def gexf(nodes: DataFrame, edges: DataFrame, most: int = 200_000) -> str:
    """A graph in GEXF; for pictures, so refused above ``most`` edges."""
    names, links = _small(nodes, edges, most)
    body = [f"<node id={quoteattr(n)} label={quoteattr(n)}/>" for n in names]
    lines = [f'<edge id="{k}" source={quoteattr(a)} target={quoteattr(b)} weight="{w:g}"/>' for k, (a, b, w) in enumerate(links)]
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="undirected"><nodes>'
    return head + "".join(body) + "</nodes><edges>" + "".join(lines) + "</edges></graph></gexf>\n"


def _small(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[list[str], list[tuple[str, str, float]]]:
    links = [(str(r[0]), str(r[1]), float(r[2])) for r in edges.select("src", "dst", "weight").orderBy("src", "dst").limit(most + 1).collect()]
    names = [str(r[0]) for r in nodes.select("node").distinct().orderBy("node").limit(most + 1).collect()]
    if max(len(links), len(names)) > most:
        raise ValueError(f"graphs of more than {most} edges or nodes aren't written for pictures")
    return names, links
