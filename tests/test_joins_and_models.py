"""Looking up filings, joining features, the status of calls, and the model tables."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest

from ledgerloom.operators import audit, regression
from ledgerloom.operators import text_features as X
from ledgerloom.operators.filing_text import filing_documents
from ledgerloom.plans import render, robustness
from ledgerloom.sources import readers


def _submissions(spark, path):
    recent = {"accessionNumber": ["a1", "a2", "a3"], "primaryDocument": ["d1.htm", "", "same.htm"]}
    older = [{"accessionNumber": ["a1", "a2", "a4"], "primaryDocument": ["old.htm", "d2.htm", "lost.htm"]}]
    for cik, filings in ((1, {"recent": recent, "older": older}), (2, {"recent": {"accessionNumber": ["b1"], "primaryDocument": ["same.htm"]}, "older": None})):
        (path / f"{cik}.json").write_text(json.dumps({"cik": str(cik), "name": "n", "entityType": "operating", "sic": "1", "fiscalYearEnd": "1231", "filings": filings}))
    return readers.submissions(spark, str(path))


def test_filings_find_their_documents(spark, tmp_path):
    """The recent batch first, then the older ones; each miss has its status."""
    subs = _submissions(spark, tmp_path)
    ciks = spark.createDataFrame([("one", "0000000001"), ("two", "0000000002")], "ticker string, cik string")
    rows = [("one", "a1", 1), ("one", "a2", 2), ("one", "a3", 3), ("one", "a4", 4), ("one", "a5", 5), ("two", "b1", 6), ("none", "a1", 7), ("one", None, 8)]
    filings = spark.createDataFrame(rows, "ticker string, accession_number string, fiscal_year int")
    html = [("d1.htm", "D1", None), ("old.htm", "OLD", None), ("d2.htm", "D2", None), ("same.htm", "A3", "a3"), ("same.htm", "B1", "b1"), ("same.htm", "B1", "b1"), ("unused.htm", "U", "a1")]
    html = spark.createDataFrame(html, "doc string, html string, accession_number string")
    got = {r.fiscal_year: (r.html, r.status) for r in filing_documents(filings, ciks, subs, html).collect()}
    assert got == {1: ("D1", "found"), 2: ("D2", "found"), 3: ("A3", "found"), 4: (None, "no file"), 5: (None, "no document"), 6: ("B1", "found"), 7: (None, "no cik"), 8: (None, "no document")}
    plain = filing_documents(filings, ciks, subs, html.select("doc", "html").filter("html in ('D1', 'A3')"))
    assert {r.fiscal_year: r.html for r in plain.filter("status = 'found'").collect()} == {1: "D1", 3: "A3", 6: "A3"}
    assert filing_documents(filings.limit(0), ciks, subs, html).count() == 0 and filing_documents(filings, ciks, subs, html.limit(0)).count() == len(rows)


def test_html_files_know_their_accession(spark, tmp_path):
    for folder in ("000123456719000012", "0001234567-19-000013", "other"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "form.htm").write_text(folder)
    got = {r.html: (r.doc, r.accession_number) for r in readers.html_files(spark, str(tmp_path)).collect()}
    assert got == {"000123456719000012": ("form.htm", "0001234567-19-000012"), "0001234567-19-000013": ("form.htm", "0001234567-19-000013"), "other": ("form.htm", None)}


def test_features_join_the_panel(spark):
    """Every row of the panel stays once; the panel's columns win; repeated keys raise."""
    panel = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.7), (None, 1, 0.8)], "ticker string, fiscal_year int, roa double")
    features = spark.createDataFrame([("a", 1, 9.0, 1.0), ("b", 1, 9.0, None), ("c", 1, 9.0, 3.0), (None, 1, 9.0, 4.0), (None, 1, 9.0, 5.0)], "ticker string, fiscal_year int, roa double, tone double")
    out = X.attach_features(panel, features)
    assert out.columns == ["ticker", "fiscal_year", "roa", "tone"]
    assert sorted((r.roa, r.tone) for r in out.collect()) == [(0.5, 1.0), (0.6, None), (0.7, None), (0.8, None)]
    assert X.attach_features(panel, features.limit(0)).filter("tone is null").count() == 4
    with pytest.raises(Exception, match="features repeat a key"):
        X.attach_features(panel, features.union(features)).collect()


def test_calls_have_a_status(spark):
    """V6: five tries, waits of 20 seconds times the try, and what a next run repeats."""
    sample = spark.createDataFrame([(i,) for i in range(6)], "k int")
    calls = [(0, 1, "yes"), (1, 1, None), (1, 2, None), (1, 3, "late"), (1, 4, "later"), *((2, t, None) for t in range(1, 6)), (3, 1, None), *((5, t, None) for t in range(1, 6)), (5, 6, "too late")]
    out = audit.call_status(sample, spark.createDataFrame(calls, "k int, try int, response string"), ["k"])
    got = {r.k: (r.response, r.tries, r.waited, r.status) for r in out.collect()}
    assert got == {0: ("yes", 1, 0.0, "recorded"), 1: ("late", 3, 60.0, "recorded"), 2: (None, 5, 300.0, "retry"), 3: (None, 1, 20.0, "open"), 4: (None, 0, 0.0, "retry"), 5: (None, 5, 300.0, "retry")}


NAMES = tuple(dict.fromkeys([*robustness.ladders()[-1], "d_lm_net_tone", "d_roa", "d_ocf_to_assets"]))


def _panel(spark, n: int = 400):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        x = dict(zip(NAMES, map(float, rng.normal(size=len(NAMES)))))
        rows.append((f"t{i % 40}", (3674, 7371, 2000, 2100)[i % 4], 2015 + i // 40, float(0.5 * x["lagged_vol"] + 0.3 * x["d_lm_net_tone"] + rng.normal() * 0.1), float(rng.normal()), *x.values()))
    kinds = ", ".join(["ticker string, sic int, fiscal_year int, vol_next_year double, return_next_year double", *(f"{c} double" for c in NAMES)])
    return spark.createDataFrame(rows, kinds)


def test_ladder_of_models(spark):
    """Gains, F tests of what is added, criteria; the F of one added regressor is its squared t."""
    df = _panel(spark)
    fits = regression.nested(df.withColumn("sic2", df.sic % 7), "vol_next_year", (("lagged_vol",), ("lagged_vol", "roa"), ("lagged_vol", "roa"), ("lagged_vol", "roa", "d_lm_net_tone", "leverage")))
    got = regression.ladder_table(spark, fits).orderBy("step").collect()
    assert [r.added for r in got] == [0, 1, 0, 2] and [r.f is None for r in got] == [True, False, True, False]
    assert math.isclose(got[1].f, fits[1].tstats[1] ** 2) and math.isclose(got[3].gain, got[3].adj_r2 - got[2].adj_r2) and got[3].p < 1e-6 < got[1].p
    assert got[3].aic < got[2].aic and got[3].bic < got[2].bic
    assert render.comparison_table(regression.ladder_table(spark, fits)).count("***") == 1
    with pytest.raises(ValueError, match="different rows"):
        regression.ladder_table(spark, [fits[0], regression.fit(df.limit(100).withColumn("sic2", df.sic % 7), "vol_next_year", ["lagged_vol", "roa"])])
    compared = robustness.compare_models(df).orderBy("step").collect()
    assert [r.model for r in compared] == [n for n, _ in robustness.MODELS] and [r.added for r in compared] == [0, 4, 6, 1, 1]


def test_robustness_battery(spark):
    """Each variant equals a fit of its own rows, variables and effects."""
    df = robustness.with_divergences(_panel(spark).drop("divergence")).cache()
    panels = dict.fromkeys(("base", "window_63", "window_180", "min_8_years", "winsor_2.5"), df)
    out = robustness.battery(panels)
    got = {r.variant: r for r in out.collect()}
    assert len(got) == len(robustness.BATTERY) and got["Base"].nobs == 400
    assert got["Before 2020"].nobs + got["From 2020"].nobs == 400 == got["Technology"].nobs + got["Other industries"].nobs and got["Technology"].nobs == 200
    own = regression.fit(df.filter("fiscal_year < 2020").withColumn("sic2", (df.sic / 100).cast("int")), "vol_next_year", ["divergence", *robustness.CONTROLS])
    assert math.isclose(got["Before 2020"].coef, own.params[0], rel_tol=1e-9) and math.isclose(got["Before 2020"].t, own.tstats[0], rel_tol=1e-9)
    firm = regression.fit(df, "vol_next_year", ["divergence", *robustness.CONTROLS], ("ticker", "fiscal_year"))
    assert math.isclose(got["Firm effects"].coef, firm.params[0], rel_tol=1e-9) and got["Signs differ"].variable == "sign_differs"
    assert render.robustness_table(out).count(r" \\") == 1 + len(got)
    few = robustness.battery({"base": df}, (robustness.Variant("none", where="fiscal_year = 1900"), robustness.Variant("tiny", where="ticker = 't1' and fiscal_year = 2015"))).collect()
    assert [(r.nobs, r.coef) for r in few] == [(0, None), (1, None)]
    with pytest.raises(ValueError, match="window_63"):
        robustness.battery({"base": df})
