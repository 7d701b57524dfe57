from __future__ import annotations

from datetime import date, timedelta
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import panel as ops
from ledgerloom.operators.quantiles import exact_quantiles


def _days(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy(*cols[:2]).collect()]


def test_duplicates_and_gaps(spark):
    d = date(2015, 1, 1)
    rows = [
        ("a", d, date(2016, 1, 1), 1.0), ("a", d + timedelta(365), date(2016, 1, 1), None),  # the first row has no gap and loses
        ("a", d + timedelta(365 + 299), date(2017, 1, 1), 1.0), ("a", d + timedelta(365 + 365), date(2018, 1, 1), 1.0),
        ("b", d, date(2016, 1, 1), 1.0), ("b", d + timedelta(300), date(2017, 1, 1), 1.0), ("b", d + timedelta(700), date(2018, 1, 1), 1.0), ("b", d + timedelta(1101), date(2019, 1, 1), 1.0),
    ]
    df = spark.createDataFrame(rows, "ticker string, year_end date, filing_date date, net_income double").withColumn("_x", F.lit(1))
    out = ops.filter_transitions_and_duplicates(df)
    assert "_x" not in out.columns
    got = _days(out, "ticker", "year_end")
    # 299 days goes; the row after it, 66 days on, goes as well: gaps are taken once
    assert got == [("a", d + timedelta(365)), ("b", d), ("b", d + timedelta(300)), ("b", d + timedelta(700))]


def _model_c1(df: pd.DataFrame) -> pd.DataFrame:
    """C1 row by row."""
    keep = []
    for _, g in df.sort_values(["ticker", "year_end"]).groupby("ticker"):
        rows = g.to_dict("records")
        for i, r in enumerate(rows):
            r["gap"] = None if i == 0 else (r["year_end"] - rows[i - 1]["year_end"]).days
        best: dict = {}
        for r in rows:
            score = float("-inf") if r["gap"] is None else 10000 * (r["net_income"] is not None) - abs(r["gap"] - 365)
            if r["filing_date"] not in best or score > best[r["filing_date"]][0]:
                best[r["filing_date"]] = (score, r)
        left = sorted((r for _, r in best.values()), key=lambda r: r["year_end"])
        for i, r in enumerate(left):
            if i == 0 or 300 <= (r["year_end"] - left[i - 1]["year_end"]).days <= 400:
                keep.append((r["ticker"], r["year_end"]))
    return sorted(keep)


def test_c1_against_a_model(spark):
    r = random.Random(4)
    rows = []
    for t in range(60):
        day = date(2010, 1, 1)
        for _ in range(r.randint(1, 9)):
            day += timedelta(r.choice((30, 299, 300, 365, 400, 401)))
            rows.append((f"t{t}", day, date(day.year, 1 + r.randint(0, 1) * 6, 1), r.choice((None, 1.0))))
    df = spark.createDataFrame(rows, "ticker string, year_end date, filing_date date, net_income double")
    model = pd.DataFrame(rows, columns=["ticker", "year_end", "filing_date", "net_income"]).astype(object)
    model["net_income"] = pd.Series([x[3] for x in rows], dtype=object)  # None stays None
    assert sorted((x.ticker, x.year_end) for x in ops.filter_transitions_and_duplicates(df).collect()) == _model_c1(model)


def test_fill_has_a_limit_and_stays_in_the_entity(spark):
    rows = [("a", 1, None), ("a", 2, 1.0), ("a", 3, None), ("a", 4, None), ("a", 5, 2.0), ("a", 6, None), ("b", 1, None), ("b", 2, None), ("b", 3, 5.0)]
    df = spark.createDataFrame(rows, "ticker string, year_end int, x double")
    got = [r.x for r in ops.fill_limited(df, ["x"]).orderBy("ticker", "year_end").collect()]
    assert got == [1.0, 1.0, 1.0, 2.0, 2.0, 2.0, None, 5.0, 5.0]


def test_tag_lock(spark):
    rows = [("a", 1, 1.0, "x"), ("a", 2, 2.0, "y"), ("a", 3, 3.0, "z"), ("a", 4, 4.0, "x"), ("b", 1, 1.0, "y"), ("b", 2, 2.0, "x"), ("c", 1, None, None), ("d", 1, 1.0, "z"), ("d", 2, 1.0, "x")]
    df = spark.createDataFrame(rows, "ticker string, year_end int, m double, _tag_m string")
    tags = [("x", "m", 1), ("y", "m", 2), ("z", "m", 3)]
    out = ops.lock_tags(df, tags=tags, equivalent={"m": ("x", "y")})
    assert _days(out, "ticker", "year_end", "m", "_tag_m") == [
        ("a", 1, 1.0, "x"), ("a", 2, 2.0, "y"), ("a", 3, None, None), ("a", 4, 4.0, "x"), ("b", 1, 1.0, "y"), ("b", 2, 2.0, "x"), ("c", 1, None, None), ("d", 1, None, None), ("d", 2, 1.0, "x"),
    ]
    share = {r.locked_tag: (r.firms, r.percent) for r in ops.tag_distribution(ops.tag_provenance(out), [*tags, ("w", "m", 4)]).collect()}
    assert share["w"] == (0, 0.0) and share["x"][0] == 3 and share["x"][1] == pytest.approx(100.0)


def test_winsorize_edges(spark):
    df = spark.createDataFrame([(1.0, None, 7.0), (2.0, None, None), (100.0, None, None), (None, None, None)], "a double, b double, c double")
    out = ops.winsorize(df, ["a", "b", "c"], 0.0, 0.5).collect()
    assert [r.a for r in out] == [1.0, 2.0, 2.0, None] and all(r.b is None for r in out) and out[0].c == 7.0


def test_sorted_quantiles_equal_percentiles(spark):
    r = random.Random(1)
    vals = [r.choice((None, r.gauss(0, 1), 1.0)) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "a double").repartition(7)
    have = np.array([v for v in vals if v is not None])
    for fetch in (100_000, 3):
        assert exact_quantiles(df, ["a"], [0.0, 0.01, 0.5, 0.99, 1.0], fetch)["a"] == pytest.approx(np.quantile(have, [0.0, 0.01, 0.5, 0.99, 1.0]))
    assert exact_quantiles(df.filter("a > 99"), ["a"], [0.5]) == {"a": [None]}


def test_exact_quantiles_of_many_rows(spark):
    """A million rows in 8 partitions, ties and a half of equal values among them."""
    df = spark.range(0, 1_000_000, 1, 8).select(
        F.hash("id").cast("double").alias("a"), (F.hash("id") % 50).cast("double").alias("b"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.hash("id") / 7).alias("c"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("d")
    )
    shares = [0.0, 0.01, 0.5, 0.99, 1.0]
    values = df.toPandas()
    found = exact_quantiles(df, list("abcd"), shares, fetch=3000)
    for c in "abcd":
        assert found[c] == pytest.approx(values[c].quantile(shares).tolist())
    clipped = ops.winsorize_sorted(df.select("a", "d"), ["a", "d"]).agg(F.sum("a"), F.sum("d")).first()
    assert list(clipped) == [pytest.approx(values[c].clip(*values[c].quantile([0.01, 0.99])).sum()) for c in "ad"]


def test_coverage_bounds(spark):
    rows = [("nine", i, None if i == 0 else 1.0) for i in range(10)] + [("eight", i, None if i == 0 else 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "ticker string, i int, vol_next_year double")
    assert {r.ticker for r in ops.drop_low_coverage(df).collect()} == {"nine"}


def test_tail_and_earliest(spark):
    df = spark.createDataFrame([("a", i) for i in range(6)] + [("b", i) for i in range(4)], "ticker string, year_end int")
    assert _days(ops.tail_periods(df, 5, 5), "ticker", "year_end") == [("a", i) for i in range(1, 6)]
    assert _days(ops.drop_earliest(df), "ticker", "year_end")[0] == ("a", 1)


def test_growth_after_a_removed_row_is_missing(spark):
    d = date(2015, 12, 31)
    df = spark.createDataFrame([("a", d, 1.0), ("a", d + timedelta(730), 2.0)], "ticker string, year_end date, total_assets double")
    assert [r.asset_growth for r in ops.add_ratios(df).orderBy("year_end").collect()] == [None, None]


def test_tracker(spark):
    t = ops.StageTracker(["x"])
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "ticker string, x double")
    t.track(df, "one")
    t.track(df.dropna(), "two")
    rows = t.table(spark).collect()
    assert (rows[1].rows, rows[1].d_rows, rows[1].d_missing_x) == (1, -1, -1)


def test_windows_share_one_shuffle(spark):
    df = spark.range(10).selectExpr("cast(id % 3 as string) ticker", "date_add(date'2015-01-01', cast(id as int) * 365) year_end", "cast(id as double) total_assets", "cast(id as double) vol_next_year")
    plan = ops.drop_low_coverage(ops.drop_earliest(ops.add_lag(ops.add_ratios(df))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
