from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import filing_html as H
from ledgerloom.operators import filing_text as T
from ledgerloom.operators import text_features as X

WORDS = " ".join(f"risk{i}" for i in range(250))


def filing(body_1a: str = WORDS, heading: str = "<p><b>Item 1A. Risk Factors</b></p>", end: str = "<p><b>Item 2. Properties</b></p>") -> str:
    return f"<html><body><p>Cover page of the report</p>{heading}<p>{body_1a}</p>{end}<p>land and buildings</p></body></html>"


def section(html: str, target: str = "1a", **more) -> str | None:
    text, positions = H.to_text(html)
    return H.extract(text, target, positions, **more)


@pytest.mark.parametrize("heading", [
    "<p><b>Item 1A. Risk Factors</b></p>", "<p>ITEM 1A. RISK FACTORS</p>", '<p style="font-weight:700">Item 1A Risk Factors</p>', '<div><span style="font-size: 14pt">Item 1A. Risk Factors</span></div>',
    "<h2><font size=4>Item 1(a). Risk factors</font></h2>", "<p><b>Item 1A. Risk Factors</b></p>", "<table><tr><td><b>Item 1A.</b> <b>Risk Factors</b></td></tr></table>",
])
def test_headers_are_found(heading):
    got = section(filing(heading=heading))
    assert got is not None and "risk249" in got and "land" not in got


@pytest.mark.parametrize("heading", [
    "<p>Item 1A. Risk Factors</p>", "<p><b>Item 1A. Risk Factors (Continued)</b></p>", '<p><b><a href="#x">Item 1A. Risk Factors</a></b></p>', "<p><b>Item 3. Legal</b></p>",
])
def test_what_is_no_header(heading):
    assert section(filing(heading=heading)) is None


def test_title_only_header():
    title = "<p><b>Risk Factors</b></p>"
    assert section(filing(heading=title)) is not None
    assert H.to_text(filing(heading=title))[1].keys() >= {"t_1a", "2"}
    late = "<p><b>What we think about risk factors</b></p>"
    assert "t_1a" not in H.to_text(filing(heading=late))[1]


def test_span_header_in_a_long_block():
    html = f'<div><span style="font-weight:bold">Item 1A. Risk Factors</span> {WORDS}</div><p><b>Item 2. Properties</b></p>'
    assert "risk249" in section(html)


def test_contents_lose_to_the_real_header():
    toc = "".join(f"<p><b>Item {i}. Heading risk</b></p>" for i in ("1A", "1B", "2", "7", "8"))
    html = f"<body>{toc}<p>{'filler ' * 100}</p>" + filing()
    text, positions = H.to_text(html)
    got = H.extract(text, "1a", positions)
    assert got.startswith("Item 1A. Risk Factors") and "risk249" in got


def test_cross_reference_loses():
    html = filing(heading=f"<p>{'x ' * 5}see</p><p><b>Item 1A. Risk Factors</b></p><p>{'other ' * 260}</p><p><b>Item 1A. Risk Factors</b></p>")
    text, positions = H.to_text(html)
    assert len(positions["1a"]) == 2
    assert "other" not in H.extract(text, "1a", positions)


@pytest.mark.parametrize(("n", "found"), [(196, False), (197, True)])
def test_shortest_section(n, found):
    body = " ".join(["risk"] * (n - 1))  # the heading adds four words
    assert (section(filing(body)) is not None) == found
    assert section(filing(body), allow_stub=True) is not None


def test_no_end_marker_and_later_item():
    assert "land" in section(filing(end=""))
    assert "land" not in section(filing(end="<p><b>Item 8. Financial Statements</b></p>"))


def test_data_tables_go_and_their_headers_stay():
    row = "<tr><td>Revenue</td><td>1,234</td><td>5,678</td></tr>"
    text, _ = H.to_text(f"<p>before</p><table>{row * 3}</table><p>after</p>")
    assert "1,234" not in text and text.split() == ["before", "after"]
    text, positions = H.to_text(filing(heading=f"<table>{row * 3}<tr><td><b>Item 1A. Risk Factors</b></td></tr></table>"))
    assert positions["1a"] and text[positions["1a"][0] :].startswith("Item 1A. Risk Factors") and "1,234" not in text
    assert "prose stays here" in H.to_text("<table><tr><td>prose stays here</td></tr></table>")[0]


def test_inline_elements_do_not_break_lines():
    assert H.to_text("<p>a <b>bold</b> and <i>it<span>al</span>ic</i> word<br>next</p>")[0] == "a bold and italic word\nnext"
    assert H.to_text("<p>a<script>x()</script>b</p><style>p{}</style>")[0] == "ab"


def test_deep_pages():
    assert H.to_text("<div>" * 20000 + "x y" + "</div>" * 20000)[0] == "x y"


def test_exhibit_index():
    rows = "<tr><td>1</td><td>d</td><td><a href='/a/b/ex13.htm'>x</a></td><td>EX-13</td></tr><tr><td>2</td><td>d</td><td>ex99.htm</td><td>EX-99.1</td></tr><tr><td>3</td><td>d</td><td>m.htm</td><td>10-K</td></tr>"
    assert H.exhibit_index(f"<table>{rows}</table>") == {"EX-13": "ex13.htm", "EX-99.1": "ex99.htm"}


def _clean(spark, *texts):
    return [r.t for r in T.clean_sections(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()]


def test_cleaning(spark):
    nbsp = " "
    got = _clean(
        spark, "a\n12 Table of Contents\nb", "a\n  TABLE OF CONTENTS \nb", "a\n2019 Form 10-K 59\nb\nAnnual Report on Form 10-K 3\nc", f"a\n 123 \nb{nbsp}c\n1234", "Sales 1 2 3\nkeep 1 2 x y\nw 1 2 3 4",
        "a 1 2\nb\n\n \nc", None, "",
    )
    assert got == ["a\nb", "a\nb", "a\nb\nc", "a\nb c\n1234", "keep 1 2 x y", "a 1 2\nb\nc", None, ""]


def test_number_lines_need_more_than_forty_percent(spark):
    assert _clean(spark, "a b c d e 1 2 3", "a b c d 1 2 3") == ["a b c d e 1 2 3", ""]


@pytest.mark.parametrize(("lines", "times", "gone"), [(51, 4, True), (50, 4, False), (51, 3, False)])
def test_repeated_lines(spark, lines, times, gone):
    text = "\n".join(["Running head"] * times + [f"line number {i} of this text here" for i in range(lines - times)])
    assert ("Running head" not in _clean(spark, text)[0]) == gone


def test_exhibit_fallback(spark):
    stub = filing("The risk information is incorporated by reference to our annual report, Exhibit 13.")
    main = spark.createDataFrame([("f1", stub), ("f2", filing()), ("f3", None), ("f4", stub)], "accession_number string, html string")
    exhibits = spark.createDataFrame([("f1", "EX-99.1", filing("wrong " * 300)), ("f1", "EX-13", filing()), ("f4", "EX-99", filing())], "accession_number string, exhibit_type string, html string")
    got = {r.accession_number: r.item_1a for r in T.extract_filings(main, exhibits).collect()}
    assert "risk249" in got["f1"] and "wrong" not in got["f1"] and "risk249" in got["f2"] and got["f3"] is None and got["f4"] is None


def test_text_dataset_resumes(spark):
    panel = spark.createDataFrame([("a", "f1", 2011, "10-K"), ("a", "f2", 2012, "10-K/A"), ("b", "f3", 2011, "10-K"), ("c", "f4", 2011, "10-K"), ("d", None, 2011, "10-K")], "ticker string, accession_number string, fiscal_year int, form_type string")
    docs = spark.createDataFrame([("f1", filing()), ("f4", filing())], "accession_number string, html string")
    done = spark.createDataFrame([("c", 2011)], "ticker string, fiscal_year int")
    out = T.text_dataset(panel, docs, done=done)
    rows = {r.ticker: r for r in out.collect()}
    assert set(rows) == {"a", "b"} and rows["a"].status == "extracted" and "\n" not in rows["a"].item_1a and rows["b"].status == "failed" and rows["b"].item_1a is None
    assert {r.status: r.n for r in T.progress(out).collect()} == {"extracted": 1, "failed": 1}


def test_null_html(spark):
    got = H.parse_documents(spark.createDataFrame([(1, None), (2, "")], "k int, html string"), "html", ("k",)).orderBy("k").collect()
    assert got[0].text is None and got[1].text == ""


def test_tone_and_blocks(spark):
    words = spark.createDataFrame([("bad", "negative"), ("bad", "litigious"), ("good", "positive"), ("may", "uncertainty")], "word string, category string")
    df = spark.createDataFrame([(1, "Bad bad good, may be fine"), (2, ""), (3, None)], "k int, text string")
    got = {r.k: r for r in X.tone(df, words, ["k"]).collect()}
    assert (got[1].n_tokens, got[1].n_negative, got[1].n_risk, got[1].net_tone) == (6, 2, 3, pytest.approx(-1 / 3)) and got[2].negative_pct is None and got[3].n_tokens == 0
    years = [("a", 2010, "x y z\n\nk l m\n\np q r"), ("a", 2011, "x y z\n\nk l n\n\nu v w"), ("a", 2012, "one")]
    b = {r.fiscal_year: r for r in X.block_changes(spark.createDataFrame(years, "ticker string, fiscal_year int, text string")).collect()}
    assert (b[2011].added, b[2011].removed, b[2011].modified, b[2011].turnover) == (1, 1, 1, pytest.approx(2 / 6)) and b[2012].added is None


def test_divergence_and_effects(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (None, 1.0), (-1.0, 1.0)], "d_tone double, d_roa double")
    got = X.divergence(df).collect()
    assert [r.sign_differs for r in got] == [0, 0, 1, 1]
    e = X.sd_effect(df.dropna(), 2.0, "d_tone", "d_roa").first()
    assert e.effect == pytest.approx(2 * 1.5275, abs=1e-3)
    s = X.section_scores(spark.createDataFrame([("a", -1.0), ("a", 1.0), ("a", None)], "k string, score double"), ["k"]).first()
    assert (s.n_sentences, s.mean_score, s.share_negative) == (2, 0.0, 0.5)


def test_frequency_tables(spark):
    q = [("a", 2010, "ni", p, v) for p, v in zip(("FY", "Q1", "Q2", "Q3", "Q4"), (10.0, 2.0, 2.0, 2.0, 4.0))] + [("b", 2010, "ni", p, v) for p, v in zip(("FY", "Q1", "Q2", "Q3", "Q4"), (10.0, 2.0, 2.0, 2.0, 5.0))] + [("c", 2010, "ni", "FY", None)]
    df = spark.createDataFrame(q, "ticker string, fiscal_year int, metric string, period string, value double")
    r = X.q4_reliability(df).first()
    assert (r.n, r.n_match, r.match_rate) == (2, 1, 0.5)
    assert {x.period: x.percent for x in X.frequency_coverage(df).collect()}["FY"] == pytest.approx(200 / 3)
    assert F is not None
