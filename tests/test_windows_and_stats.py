from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit, describe, regression, sampling
from ledgerloom.operators.eventwindow import window_returns
from ledgerloom.plans import render


def test_window_against_slices(spark):
    r = random.Random(3)
    prices, events = [], []
    for t in "abc":
        day = date(2015, 1, 1)
        for _ in range(120):
            day += timedelta(r.randint(1, 3))
            prices.append((t, day, r.choice((None, 10 + r.random()))))
        events += [(t, date(2015, 1, 1) + timedelta(r.randint(0, 200)), i) for i in range(5)]
    events += [("none", date(2015, 1, 1), 9), ("a", None, 8)]
    e = spark.createDataFrame(events, "ticker string, filing_date date, k int")
    got = {(x.ticker, x.k): (x.return_next_year, x.vol_next_year) for x in window_returns(e, spark.createDataFrame(prices, "ticker string, date date, close double"), window_days=60, min_observations=10).collect()}
    assert len(got) == len(events)
    for t, day, k in events:
        lo = day and day + timedelta(2)
        own = [c for tt, d, c in prices if day and tt == t and c is not None and lo <= d <= lo + timedelta(60)]
        if len(own) < 10:
            assert got[t, k] == (None, None)
        else:
            steps = np.diff(np.log(own))
            assert got[t, k] == (pytest.approx(math.log(own[-1] / own[0])), pytest.approx(np.std(steps, ddof=1) * math.sqrt(252)))


def test_window_bounds_are_inclusive(spark):
    e = spark.createDataFrame([("a", date(2020, 1, 1))], "ticker string, filing_date date")
    days = [date(2020, 1, 3) + timedelta(i) for i in range(366)]
    rows = [("a", d, 1.0 + i) for i, d in enumerate(days)]
    p = spark.createDataFrame(rows, "ticker string, date date, close double")
    assert window_returns(e, p, min_observations=366).first().return_next_year == pytest.approx(math.log(366))
    assert window_returns(e, p.filter(F.col("date") < F.lit(days[-1])), min_observations=366).first().return_next_year is None


def test_window_without_prices(spark):
    e = spark.createDataFrame([("a", date(2020, 1, 1))], "ticker string, filing_date date")
    assert window_returns(e, spark.createDataFrame([], "ticker string, date date, close double")).first().vol_next_year is None


def test_describe_and_correlations(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    x[:, 1] += x[:, 0]
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.values], "a double, b double, c double")
    d = {r.variable: r for r in describe.describe(df, ["a", "b"]).collect()}
    assert d["b"].n == pdf.b.count() and d["b"].p25 == pytest.approx(pdf.b.quantile(0.25)) and d["a"].std == pytest.approx(pdf.a.std())
    assert [tuple(r) for r in describe.describe(df, ["a", "b"], any_size=True).collect()] == [pytest.approx(tuple(d[k])) for k in "ab"]
    c = {(r.variable, r.other): r for r in describe.correlations_with_p(df, list("abc")).collect()}
    assert c["b", "a"].r == pytest.approx(pdf.dropna().corr().loc["a", "b"]) and c["b", "a"].p < 1e-6 < c["c", "a"].p
    assert "1.00" in render.correlation_table(describe.correlations_with_p(df, list("abc")), {k: k for k in "abc"})
    assert render.summary_table(describe.describe(df, ["a"]), {"a": "A"}).count(r"\\") == 2


def test_regression_against_dummies(spark):
    rng = np.random.default_rng(1)
    n = 600
    f1, f2, cl = rng.integers(0, 6, n), rng.integers(0, 5, n), rng.integers(0, 60, n)
    f1[0], cl[1], cl[2] = 99, 900, 901  # a singleton level and singleton clusters
    x = rng.normal(size=(n, 2)) + f1[:, None] * 0.1 + 20
    y = x @ [0.5, -0.2] + f1 * 0.3 - f2 * 0.1 + rng.normal(size=n) * 0.3
    df = spark.createDataFrame([(float(a), float(b), float(c), int(p), int(q), int(g)) for a, (b, c), p, q, g in zip(y, x, f1, f2, cl)], "y double, a double, b double, f1 int, f2 int, cl int")
    fit = regression.fit(df, "y", ["a", "b"], ["f1", "f2"], "cl")
    z = np.column_stack([f1[:, None] == np.unique(f1), f2[:, None] == np.unique(f2)]).astype(float)
    m = lambda v: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
    xr, yr = m(x), m(y)
    beta = np.linalg.lstsq(xr, yr, rcond=None)[0]
    u = yr - xr @ beta
    s = np.array([(xr[cl == g] * u[cl == g, None]).sum(axis=0) for g in np.unique(cl)])
    bread = np.linalg.inv(xr.T @ xr)
    assert fit.params == pytest.approx(beta, rel=1e-8) and fit.cov == pytest.approx(bread @ (s.T @ s) @ bread, rel=1e-6)
    assert fit.rss == pytest.approx(u @ u, rel=1e-8) and fit.effects == np.linalg.matrix_rank(z) and fit.clusters == len(np.unique(cl)) and fit.nobs == n
    f, p = fit.joint_test(["a", "b"])
    assert f > 100 and p < 1e-6
    assert "Adj. $R^2$" in render.regression_table([fit], {"a": "A"}, 60, 6)
    one = regression.within_one_way(df, "y", "a", "f1").first()
    d1 = (f1[:, None] == np.unique(f1)).astype(float)
    w = lambda v: v - d1 @ np.linalg.lstsq(d1, v, rcond=None)[0]
    assert one.coef == pytest.approx((w(x[:, 0]) @ w(y)) / (w(x[:, 0]) @ w(x[:, 0])))


def test_nested_models_use_the_same_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(f"t{i % 9}", int(i % 3), int(i % 4), *(float(v) for v in rng.normal(size=3)), None if i % 5 == 0 else float(rng.normal())) for i in range(200)]
    df = spark.createDataFrame(rows, "ticker string, sic2 int, fiscal_year int, y double, a double, b double, c double")
    fits = regression.nested(df, "y", (("a",), ("a", "b"), ("a", "b", "c")))
    assert [f.nobs for f in fits] == [160] * 3 and fits[0].rss >= fits[1].rss >= fits[2].rss


RESPONSE = "Correct Section: pass\nstart boundary: MINOR, a bit late\n Content Quality : Fail\nNotes: Failed to: find\nEnd Boundary: Pass\nend boundary: Minor"


def test_parse_response(spark):
    m = spark.createDataFrame([(RESPONSE,), (None,), ("",)], "r string").select(audit.parse_response("r").alias("m")).collect()
    assert m[0].m == {"correct_section": "Pass", "start_boundary": "Minor", "content_quality": "Fail", "notes": "Fail", "end_boundary": "Minor"}
    assert not m[1].m and not m[2].m


def test_verdicts_and_summary(spark):
    rows = [("a", 2011, "item_1a", "text", "", RESPONSE), ("b", 2015, "item_7", "", "no filing", None), ("c", 2015, "item_7", "t", "", "\n".join(f"{c}: Pass" for c in audit.CRITERIA))]
    v = audit.verdicts(spark.createDataFrame(rows, "ticker string, fiscal_year int, section string, text string, extract_error string, response string"))
    got = {r.ticker: r for r in v.collect()}
    assert (got["a"].completeness, got["a"].quality, got["b"].quality, got["b"].notes, got["c"].quality) == ("PARSE_ERR", "PARSE_ERR", "FAIL", "no filing", "PASS")
    s = {k: t.collect() for k, t in audit.summary(v).items()}
    assert s["overall"][0].n == 3 and s["overall"][0].n_strict == 1
    assert {r.era: r.n_lenient for r in s["by_era"]} == {"2010-2012": 0, "2013-2015": 1}
    done = {r.criterion: r for r in s["criteria"]}["completeness"]
    assert (done.n, done.n_pass, done.n_fail, done.n_error) == (3, 1, 1, 1)
    assert {r.ticker for r in s["failures"]} == {"a", "b"}


def test_attach_text(spark):
    sample = spark.createDataFrame([("a", 1, "item_1a"), ("a", 1, "item_7"), ("z", 1, "item_7")], "ticker string, fiscal_year int, section string")
    texts = spark.createDataFrame([("a", 1, "one two", None)], "ticker string, fiscal_year int, item_1a string, item_7 string")
    got = {(r.ticker, r.section): (r.word_count, r.extract_error) for r in audit.attach_text(sample, texts).collect()}
    assert got == {("a", "item_1a"): (2, ""), ("a", "item_7"): (0, "empty"), ("z", "item_7"): (0, "no filing")}


def test_batch_audit(spark):
    log = spark.createDataFrame([("OK", "", "WARN", "X,Y"), ("MISSING", "", "OK", "X")], "item_1a_status string, item_1a_flags string, item_7_status string, item_7_flags string")
    got = {(r.item, r.kind, r.value): r.n for r in audit.batch_audit(log).collect()}
    assert got["item_7", "flag", "X"] == 2 and got["item_1a", "status", "MISSING"] == 1


def test_sample_is_stable_and_bounded(spark):
    df = spark.range(1000).selectExpr("concat('t', id) ticker", "cast(2010 + id % 15 as int) fiscal_year")
    one = sampling.section_sample(df, n=25).collect()
    two = sampling.section_sample(df.repartition(9), n=25).collect()
    assert one == two and len(one) == 50
    per = {}
    for r in one:
        per[r.section, r.era] = per.get((r.section, r.era), 0) + 1
    assert set(per.values()) == {5}
    assert {r.ticker for r in one if r.section == "item_1a"} != {r.ticker for r in one if r.section == "item_7"}


def test_prompts_and_files(spark, tmp_path):
    df = spark.createDataFrame([("item_7", "the text")], "section string, text string")
    assert audit.prompts(df, "Audit %s: %s").first().prompt == "Audit item_7: the text"
    render.write_text(spark, "a é\n", f"file://{tmp_path}/t.tex")
    assert (tmp_path / "t.tex").read_text() == "a é\n"


def test_published_arithmetic(spark):
    """Shares of firms by locked tag as printed for 548 firms: 502, 45 and 1."""
    from ledgerloom.operators import panel as ops

    rows = [(f"t{i}", "NetIncomeLoss" if i < 502 else "ProfitLoss" if i < 547 else "IncomeLossFromContinuingOperations", 1.0) for i in range(548)]
    df = spark.createDataFrame(rows, "ticker string, _tag_net_income string, net_income double")
    got = {r.locked_tag: (r.firms, round(r.percent, 1)) for r in ops.tag_distribution(ops.tag_provenance(df)).filter("metric = 'net_income'").collect()}
    assert got == {"NetIncomeLoss": (502, 91.6), "ProfitLoss": (45, 8.2), "IncomeLossFromContinuingOperations": (1, 0.2)}


def test_robustness_variants(spark):
    """Other windows, cut-offs and effects are parameters."""
    from ledgerloom.plans.build_panel import VARIANTS

    assert VARIANTS["winsor_2.5"].winsor == (0.025, 0.975) and VARIANTS["min_8_years"].min_years == 8
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"t{i % 20}", int(i // 20), *map(float, rng.normal(size=2))) for i in range(120)], "ticker string, fiscal_year int, y double, x double")
    firm = regression.fit(df, "y", ["x"], ["ticker", "fiscal_year"])
    one = regression.fit(df, "y", ["x"], ["fiscal_year"])
    assert firm.effects == 25 and one.effects == 6 and firm.rss < one.rss and firm.aic != firm.bic
