from __future__ import annotations

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.indices import ALIASES, INDICES, index
from tessera.functions.measures import chi2_tail, hypergeometric_tail, signed_chi2
from tessera.functions.terms import term_key, with_term
from tessera.functions.tokenizers import tokenize
from tessera.operators.segments import cut_points


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_terms(spark):
    words = ["  Café　 DA  manhã ", "casa", "", "  ", None, "Ünï-Çode", "a b"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r[0] for r in rows.select(term_key(F.col("w"))).collect()]
    assert got == ["café da manhã", "casa", None, None, None, "ünï-çode", "a b"]
    assert sorted(r.t for r in with_term(rows, F.col("w"), "t").collect()) == sorted(t for t in got if t)


def test_tokenizers(spark):
    text = F.lit("Água-viva: d'água 25 x_y, AB c1 ñandú")
    assert one(spark, tokenize(text, "alpha3")) == ["água", "viva", "água", "ñandú"]
    assert one(spark, tokenize(text, "alpha")) == ["água", "viva", "d", "água", "ab", "ñandú"]
    assert one(spark, tokenize(text, "word")) == ["água", "viva", "d", "água", "x_y", "ab", "c1", "ñandú"]
    assert one(spark, tokenize(F.lit(" (Oi!) ... fim. "), "ws")) == ["oi", "fim"]
    assert one(spark, tokenize(F.lit(None).cast("string"))) is None


def test_text(spark):
    assert one(spark, T.strict_clean(F.lit("L’œuvre... é bom! pois-é"), [("é bom", "é_bom")])) == "l oeuvre £$£ é_bom ! pois é"
    assert one(spark, T.strip_web(F.lit("veja https://a.b/c e x@y.zz de @eu 10.0.0.1 fim"))) == "veja e de fim"
    assert one(spark, T.fold(F.lit("ÇÃO Ünïq"))) == "cao uniq"
    assert one(spark, T.slug(F.lit(" São  Paulo/SP "))) == "sao_paulo_sp"
    assert one(spark, T.clean_layout(F.lit("pala-\nvra um\ndois\n\n12\n\ntrês"))) == "palavra um dois\n\ntrês"
    assert one(spark, T.file_metadata(F.lit("x/reuniao_5_ano_2023.pdf"))) == {"reuniao": "5", "ano": "2023"}
    assert [str(one(spark, T.any_date(F.lit(v)))) for v in ("2023-05-01", "01/05/2023", "20230501", "2023-05")] == ["2023-05-01"] * 3 + ["None"]
    assert one(spark, T.speakers(F.lit("E1: oi\nP: sim\nE1: ok"))) == ["E1", "P"]
    assert [one(spark, T.is_noise(F.lit(w))) for w in ("xiv", "a1", "ia", "de", "casa")] == [True, True, False, True, False]
    assert one(spark, T.clean_corpus_text(F.lit("**** *a_1\nO Fim* de 10"))) == "**** *a_1\no fim de"


COUNTS = [(3, 1, 2, 4), (0, 2, 3, 5), (5, 0, 0, 5), (0, 0, 4, 6), (10, 0, 0, 0)]


@pytest.mark.parametrize("name", sorted(INDICES))
def test_indices_are_finite_and_symmetric(spark, name):
    rows = spark.createDataFrame([(*x, sum(x)) for x in COUNTS], "a int, b int, c int, d int, n int")
    f = index(name)
    got = rows.select(f(*(F.col(x) for x in "abcdn")).alias("v"), f(*(F.col(x) for x in "acbdn")).alias("w")).collect()
    assert all(math.isfinite(r.v) and abs(r.v - r.w) < 1e-9 for r in got)


def test_index_values(spark):
    a, b, c, d, n = (F.lit(x) for x in (3, 1, 2, 4, 10))
    want = {"jaccard": 0.5, "dice": 6 / 9, "percentage": 0.3, "sorensen": 6 / 9, "simple matching": 0.7, "hamman": 0.4, "mozley": 30 / 20, "binomial": sum(math.comb(10, k) * 0.2**k * 0.8 ** (10 - k) for k in range(3))}
    for name, value in want.items():
        assert abs(one(spark, index(name)(a, b, c, d, n)) - value) < 1e-9, name
    assert len(INDICES) == 28 and "percentual de coocorrência" in ALIASES


def test_signed_chi2(spark):
    assert one(spark, signed_chi2(*(F.lit(x) for x in (8, 10, 12, 30)))) == pytest.approx(30 * (8 * 30 - 120) ** 2 / (10 * 12 * 20 * 18))
    assert one(spark, signed_chi2(*(F.lit(x) for x in (1, 10, 12, 30)))) < 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(12, 30), st.integers(0, 12))
def test_hypergeometric(row, col, total, k):
    k = min(k, row, col)
    k = max(k, row + col - total)
    p = {x: math.comb(col, x) * math.comb(total - col, row - x) / math.comb(total, row) for x in range(max(0, row + col - total), min(row, col) + 1)}
    up = k * total >= row * col
    tail = sum(v for x, v in p.items() if (x >= k if up else x <= k))
    assert hypergeometric_tail(k, row, col, total) == pytest.approx((-1 if up else 1) * math.log10(min(1, tail)), abs=1e-9)


def test_chi2_tail():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(11.070497693516351, 5) == pytest.approx(0.05)
    assert chi2_tail(0, 3) == 1.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", ".", ",", ";", ":", "$"]), max_size=120), st.integers(3, 20))
def test_segments_keep_all_tokens(tokens, size):
    spans = cut_points(tokens, size, size + 15)
    kept = list(itertools.chain.from_iterable(tokens[a:b] for a, b in spans))
    assert kept == [t for t in tokens if t != "$"]
    assert all(0 < b - a <= size + 16 for a, b in spans)


def test_segment_cuts_at_the_strongest_mark():
    tokens = ["w"] * 9 + ["."] + ["w"] * 10 + [","] + ["w"] * 20
    assert cut_points(tokens, 12, 27)[0] == (0, 10)


def test_a_final_line_end_is_no_part_of_a_term(spark):
    rows = spark.createDataFrame([("casa\n",), ("casa",), ("casa\r\n",), ("mar azul ",)], "form string")
    assert sorted(r.term for r in with_term(rows, F.col("form"), "term").collect()) == ["casa", "casa", "casa", "mar azul"]
