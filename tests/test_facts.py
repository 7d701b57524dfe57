from __future__ import annotations

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import Settings
from ledgerloom.operators import facts as fact_ops
from ledgerloom.operators.filters import valid_facts
from ledgerloom.plans.build_panel import build_panel
from ledgerloom.sources import readers, writers

FACT = "ticker string, tag string, unit_rank int, pos int, start string, end string, filed string, form string, val double, accn string"


def _fact(tag, val, start, end, filed, form="10-K", pos=0, accn="1", ticker="a", unit=0):
    return (ticker, tag, unit, pos, start, end, filed, form, val, accn)


@pytest.mark.parametrize(("start", "end", "filed", "flow", "good"), [
    ("2015-01-01", "2015-12-16", "2016-02-01", True, False), ("2015-01-01", "2015-12-17", "2016-02-01", True, True), ("2015-01-01", "2016-01-16", "2016-02-01", True, True),
    ("2015-01-01", "2016-01-17", "2016-02-01", True, False), (None, "2015-12-31", "2016-02-01", True, False), (None, "2015-12-31", "2016-02-01", False, True),
    ("bad", "2015-12-31", "2016-02-01", False, True), ("2015-12-26", "2015-12-31", "2016-02-01", False, True), ("2015-12-25", "2015-12-31", "2016-02-01", False, False),
    (None, "2015-12-31", "2016-06-28", False, True), (None, "2015-12-31", "2016-06-29", False, False), (None, "2015-12-31", "2015-01-01", False, True), (None, "2015-12-31", "x", False, False),
])
def test_valid_facts(spark, start, end, filed, flow, good):
    df = spark.createDataFrame([_fact("t", 1.0, start, end, filed)], FACT).withColumn("is_flow", F.lit(flow))
    assert bool(valid_facts(df).count()) == good


def _records(spark, rows):
    companies = spark.createDataFrame([("a", "A", 12)], "ticker string, company_name string, fiscal_year_end int")
    return fact_ops.annual_records(spark.createDataFrame(rows, FACT), companies, Settings(min_years=1))


def test_an_amendment_wipes_what_it_lacks(spark):
    rows = [
        _fact("Assets", 1.0, None, "2015-12-31", "2016-02-01"), _fact("Liabilities", 2.0, None, "2015-12-31", "2016-02-01"),
        _fact("Assets", 3.0, None, "2015-12-31", "2016-04-01", "10-K/A", 1, "2"), _fact("Assets", 4.0, None, "2015-12-31", "2016-05-01", "10-K/A", 2, "3"),
    ]
    r = _records(spark, rows).first()
    assert (r.total_assets, r.total_liabilities, r.form_type, r.filing_date, r.accession_number) == (4.0, None, "10-K/A", date(2016, 4, 1), "3")


def test_priority_beats_date_and_scan_order_breaks_ties(spark):
    s, e = "2015-01-01", "2015-12-31"
    rows = [
        _fact("ProfitLoss", 2.0, s, e, "2016-05-01", accn="2"), _fact("NetIncomeLoss", 1.0, s, e, "2016-02-01", accn="1"),
        _fact("Assets", 5.0, None, e, "2016-02-01", pos=1, accn="4"), _fact("Assets", 6.0, None, e, "2016-02-01", pos=0, accn="5"), _fact("Assets", 7.0, None, e, "2016-02-01", pos=0, accn="6", unit=2),
    ]
    r = _records(spark, rows).first()
    assert (r.net_income, r._tag_net_income, r.total_assets) == (1.0, "NetIncomeLoss", 6.0)


def test_winners_against_a_sequential_loop(spark):
    r = random.Random(2)
    rows = [(k, r.randint(1, 3), date(2016, 1, r.randint(1, 3)), i, float(i)) for k in range(50) for i in range(r.randint(1, 6))]
    got = {x.k: x.val for x in fact_ops.winners(spark.createDataFrame(rows, "k int, p int, filed date, seq int, val double").withColumn("m", F.lit(1)), ["k"], "m", "p", "filed", ["seq"]).collect()}
    want: dict = {}
    for k, p, filed, _, val in rows:
        if k not in want or p < want[k][0] or (p == want[k][0] and filed > want[k][1]):
            want[k] = (p, filed, val)
    assert got == {k: v[2] for k, v in want.items()}


def test_sources_to_panel(spark, tmp_path):
    """JSON and CSV on disk to the finished panel."""
    years = range(2010, 2020)
    unit = [{"end": f"{y}-12-31", "filed": f"{y + 1}-02-15", "form": "10-K", "val": 100.0 + 10 * (y - 2010), "accn": f"a{y}"} for y in years]
    flow = [u | {"start": f"{u['end'][:4]}-01-01", "val": 5.0} for u in unit]
    (tmp_path / "facts").mkdir()
    (tmp_path / "subs").mkdir()
    tags = {"Assets": {"units": {"USD": unit, "EUR": unit}}, "Liabilities": {"units": {"usd": [u | {"val": 40.0} for u in unit]}}, "NetIncomeLoss": {"units": {"USD": flow}}}
    (tmp_path / "facts/1.json").write_text(json.dumps({"cik": "1", "facts": {"us-gaap": tags}}))
    sub = {"cik": "1", "name": "One", "entityType": "operating", "sic": "3571", "fiscalYearEnd": "1231", "filings": {"recent": {"accessionNumber": ["x", "x"], "primaryDocument": ["d1", "d2"]}, "older": [{"accessionNumber": ["x", "y"], "primaryDocument": ["d3", "d4"]}]}}
    (tmp_path / "subs/1.json").write_text(json.dumps(sub))
    (tmp_path / "subs/2.json").write_text(json.dumps(sub | {"cik": "2", "sic": "6021"}))
    (tmp_path / "universe.json").write_text(json.dumps({"1": {"cik_str": 2, "ticker": "two", "title": "Two"}, "0": {"cik_str": 1, "ticker": "one", "title": "One"}, "2": {"cik_str": 3, "ticker": "one", "title": "Again"}}))
    universe = readers.universe(spark, str(tmp_path / "universe.json"))
    assert [tuple(r)[:3] for r in readers.universe(spark, str(tmp_path / "universe.json"), 2).collect()] == [(0, "ONE", "0000000001"), (1, "TWO", "0000000002")]
    assert {r.ticker: r.cik for r in readers.first_cik(universe).collect()} == {"ONE": "0000000001", "TWO": "0000000002"}
    subs = readers.submissions(spark, str(tmp_path / "subs"))
    docs = lambda older: {r.accession_number: r.doc for r in readers.primary_documents(subs.filter("cik like '%1'"), older).collect()}
    assert docs(False) == {"x": "d2"} and docs(True) == {"x": "d3", "y": "d4"}
    facts = readers.company_facts(spark, str(tmp_path / "facts"))
    assert facts.filter("unit = 'EUR'").count() == 0 and facts.filter("tag = 'Liabilities'").first().unit_rank == 2
    spark.sql("select 'ONE' ticker, explode(sequence(date'2010-06-01', date'2021-06-01')) date").withColumn("close", F.lit(10.0) + F.dayofyear("date") % 7).write.parquet(str(tmp_path / "prices"))
    prices = readers.prices(spark, str(tmp_path / "prices"), "2010-07-01", "2021-06-01")
    out = build_panel(facts, subs, universe, prices).orderBy("fiscal_year").collect()
    assert [r.fiscal_year for r in out] == list(range(2011, 2020))
    first = out[0]
    assert (first.ticker, first.sic, first.total_assets, first.leverage, first.roa) == ("ONE", 3571, 110.0, pytest.approx(40 / 110, abs=0.01), pytest.approx(5 / 110, abs=0.01))  # clipped
    assert first.asset_growth is not None and first.lagged_vol is not None and first.vol_next_year > 0
    panel = build_panel(facts, subs, universe, prices)
    saved = writers.save_panel(panel, str(tmp_path / "panel")).first()
    assert (saved.firms, saved.rows) == (1, 9)
    writers.save_panel(panel, str(tmp_path / "panel_csv"), fmt="csv")
    assert readers.csv(spark, str(tmp_path / "panel_csv")).count() == 9


def test_incremental_sinks(spark, tmp_path):
    p = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 1, "x")], "ticker string, fiscal_year int, t string")
    assert writers.checkpointed(df, p, ["ticker", "fiscal_year"]).count() == 2
    more = spark.createDataFrame([("a", 1, "z"), ("c", 1, "z")], df.schema)
    assert writers.checkpointed(more, p, ["ticker", "fiscal_year"]).count() == 3
    writers.new_sample(df, str(tmp_path / "sample"), p)
    assert not (tmp_path / "out").exists()


def test_tolerant_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('ticker,fiscal_year,t\na,2010,"two\nlines"\nb,bad,x\nc,2012,y\n')
    got = readers.csv_keys(spark, str(tmp_path / "x.csv"), "ticker string, fiscal_year int, t string", ["ticker", "fiscal_year"]).collect()
    assert {(r.ticker, r.fiscal_year) for r in got if r.fiscal_year} == {("a", 2010), ("c", 2012)}
