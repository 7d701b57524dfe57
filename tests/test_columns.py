from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import columns as P
from ledgerloom.functions import statistics as S


def _one(spark, column, **values):
    kinds = {k: v[1] for k, v in values.items()}
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("end", "fye", "year"), [
    (date(2021, 1, 3), 12, 2020), (date(2020, 12, 31), 12, 2020), (date(2021, 2, 2), 1, 2021), (date(2021, 1, 31), 1, 2021), (date(2020, 9, 26), 9, 2020),
    (date(2020, 10, 3), 9, 2020), (date(2020, 10, 6), 9, 2021), (date(2021, 6, 30), 1, 2022), (date(2020, 5, 31), 6, 2020),
])
def test_fiscal_year(spark, end, fye, year):
    assert _one(spark, P.fiscal_year("e", "f"), e=(end, "date"), f=(fye, "int")) == year


@pytest.mark.parametrize(("num", "den", "want"), [(1.0, 2.0, 0.5), (1.0, 0.0, None), (1.0, -2.0, None), (1.0, None, None), (None, 2.0, None)])
def test_ratio_guards(spark, num, den, want):
    assert _one(spark, P.ratio("n", "d"), n=(num, "double"), d=(den, "double")) == want


@pytest.mark.parametrize(("days", "want"), [(299, None), (300, 0.5), (400, 0.5), (401, None)])
def test_growth_gap(spark, days, want):
    assert _one(spark, P.guarded_growth("a", "b", F.col("g")), a=(3.0, "double"), b=(2.0, "double"), g=(days, "int")) == want


def test_parse_sic_and_month(spark):
    df = spark.createDataFrame([("3571", "0930"), ("x", "9"), (None, None), ("60", "ab12")], "s string, m string")
    rows = [(r.a, r.b) for r in df.select(P.parse_sic(F.col("s")).alias("a"), P.parse_fye_month("m").alias("b")).collect()]
    assert rows == [(3571, 9), (0, None), (0, None), (60, None)]


def test_word_count_knows_unicode_spaces(spark):
    df = spark.createDataFrame([(" a b \n c ",), ("",), (None,), ("  ",)], "t string")
    assert [r.x for r in df.select(P.word_count("t").alias("x")).collect()] == [3, 0, 0, 0]


def test_quality_ladder(spark):
    rows = [("Pass", "Pass", "PASS"), ("Pass", "Minor", "MINOR"), ("Fail", "Pass", "FAIL"), ("Fail", "?", "PARSE_ERR"), (None, "Pass", "PARSE_ERR")]
    df = spark.createDataFrame(rows, "a string, b string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", P.quality_tag(["a", "b"])).collect())


def test_clip_keeps_null(spark):
    assert _one(spark, P.clip("x", F.lit(0.0), F.lit(1.0)), x=(None, "double")) is None
    assert _one(spark, P.clip("x", F.lit(0.0), F.lit(1.0)), x=(5.0, "double")) == 1.0


@pytest.mark.parametrize(("k", "n", "low", "high"), [
    (192, 200, 0.9231, 0.9796), (193, 200, 0.9295, 0.9829), (195, 200, 0.9428, 0.9893), (191, 200, 0.9167, 0.9761), (187, 200, 0.8920, 0.9616), (0, 0, 0, 1),
])
def test_wilson(spark, k, n, low, high):
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(k, n)], "k long, n long").select(lo.alias("lo"), hi.alias("hi")).first()
    assert got.lo == pytest.approx(low, abs=5e-5) and got.hi == pytest.approx(high, abs=5e-5)


def test_wilson_ends(spark):
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(0, 10), (10, 10)], "k long, n long").select(lo.alias("lo"), hi.alias("hi")).collect()
    assert rows[0].lo == 0 and rows[1].hi == 1


def test_tails_against_known_values():
    assert S.t_tail(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert S.t_tail(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert S.f_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert S.normal_tail(1.959963985) == pytest.approx(0.05, abs=1e-9)
    assert S.pearson_p(1.0, 5) == 0.0 and S.pearson_p(None, 5) is None and S.pearson_p(0.3, 2) is None
    assert math.isclose(S.beta_share(2, 3, 0.4), 0.5248, abs_tol=1e-4)


def test_stars_are_strict(spark):
    df = spark.createDataFrame([(0.009,), (0.01,), (0.05,), (0.10,)], "p double")
    assert [r.s for r in df.select(P.stars("p").alias("s")).collect()] == ["***", "**", "*", ""]
