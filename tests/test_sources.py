from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.functions.tokenizers import tokens
from tessera.operators import corpus
from tessera.sources import readers, writers
from tessera.streaming import counts


def docx(text: str) -> bytes:
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("ação".encode("latin-1"))
    (tmp_path / "sub" / "b.json").write_text(json.dumps({"x": ["um", {"y": "dois"}], "n": 3}))
    (tmp_path / "c.docx").write_bytes(docx("Olá\nmundo"))
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("in/e.txt", "dentro")
        z.writestr("f.bin", "x")
    got = {r.path.rpartition("/")[2]: r.text for r in readers.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "ação", "b.json": "um\ndois", "c.docx": "Olá\nmundo", "e.txt": "dentro"}
    with pytest.raises(ValueError):
        readers.extract("x.exe", b"")
    with pytest.raises(ValueError):
        readers.extract("x.docx", b"not a zip")


def test_tagged(spark):
    text = "antes\n**** *loc_a *sexo_f\num\n-*tema x\ndois\n**** *loc_b\n"
    files = spark.createDataFrame([("f", text), ("g", ""), ("h", None)], "path string, text string")
    got = [(r.path, r.doc_no, r.header, r.text, r.themes) for r in readers.parse_tagged(files).orderBy("path", "doc_no").collect()]
    assert got == [("f", 0, "**** *doc_1", "antes", []), ("f", 1, "**** *loc_a *sexo_f", "um\ndois", ["-*tema"]), ("f", 2, "**** *loc_b", "", [])]
    bad = spark.createDataFrame([("f", "**** *loc *a_b\nx\n*** *c_d\ny")], "path string, text string")
    issues = {r.what: r.n for r in readers.validate_tagged(bad).collect()}
    assert issues["bad_tokens"] == 1 and issues["bad_markers"] == 1


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id;grupo;grupo;resposta\n" + "".join(f"{k};{'ab'[k % 2]};x;texto {k}\n" for k in range(20)))
    df = readers.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["id", "grupo", "grupo_2", "resposta"]
    assert readers.variable_columns(df, ("resposta",)) == ["grupo", "grupo_2"]
    people = spark.createDataFrame([(f"Ana {k}", k, f"{k:04}", "x" if k else " ", None) for k in range(30)], "nome string, Registro int, numero string, grupo string, vazio string")
    assert readers.variable_columns(people) == ["nome", "grupo"]  # names may be unique, identifiers and unique numbers may not
    r = readers.documents_from_table(df, ["resposta"], ["grupo"], "q").first()
    assert r.etoiles.startswith("*fonte_q *grupo_")
    pages = spark.createDataFrame([("d", k, f"CABEÇALHO\ntexto {k}") for k in range(4)], "doc string, page int, text string")
    assert sorted(r.text for r in readers.repeated_lines(pages).collect()) == [f"texto {k}" for k in range(4)]


def test_dictionaries(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("casas\tcasa\tnom\nruim\nir\tir\tver\n")
    (tmp_path / "exp.txt").write_text("# c\nem vez de\tem_vez_de\nde  d\n")
    (tmp_path / "pol.csv").write_text("bom,adj,1\nmau,adj,-1\nok,adj,x\n")
    assert readers.read_lexicon(spark, str(tmp_path / "lex.txt")).count() == 2
    assert sorted(tuple(r) for r in readers.read_expressions(spark, str(tmp_path / "exp.txt")).collect()) == [("de", "d"), ("em vez de", "em_vez_de")]
    assert {r.form: r.polarity for r in readers.read_polarity(spark, str(tmp_path / "pol.csv")).collect()} == {"bom": 1, "mau": -1, "ok": 0}
    pairs = spark.createDataFrame([("B", "a"), ("a", "b"), ("c", "c"), (None, "d")], "x string, y string")
    assert [tuple(r) for r in readers.semantic_pairs(pairs).collect()] == [("a", "b")]


def test_writers(spark, tmp_path):
    cells = spark.createDataFrame([("u", "a", 2), ("u", "b", 1), ("v", "a", 4)], "row string, col string, n bigint")
    names = writers.matrix_market(cells, str(tmp_path / "m"), "row", "col", "n")
    lines = {r.value for r in spark.read.text(str(tmp_path / "m/entries")).collect()}
    assert lines == {"1 1 2", "1 2 1", "2 1 4"} and names["rows"].count() == 2
    assert {r.row: (r.a, r.b) for r in writers.dense(cells, "row", "col", "n").collect()} == {"u": (2, 1), "v": (4, 0)}
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "b", 2.0)], "src string, dst string, weight double")
    assert "1 2 2" in writers.pajek(nodes, edges) and 'weight="2"' in writers.gexf(nodes, edges)
    writers.save_corpus({"cells": cells}, str(tmp_path / "c"))
    assert writers.load_corpus(spark, str(tmp_path / "c"), ["cells"])["cells"].count() == 3


def test_streams(spark, tmp_path, docs):
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    stream = spark.readStream.schema(docs.schema).parquet(path)
    terms = counts.run_available(counts.term_counts(stream))
    assert {r.form: r.freq for r in terms.collect()} == {r.form: r.freq for r in corpus.form_counts(tokens(docs)).collect()}
    timed = docs.withColumn("at", F.timestamp_seconds(F.col("doc_id") * 86400))
    timed.write.parquet(path + "2")
    day = spark.readStream.schema(timed.schema).parquet(path + "2")
    assert counts.run_available(counts.windowed_counts(day, "at", "etoiles")).count() == 5


def test_intermediate_results_need_a_shared_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://somewhere:7077", "a"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
