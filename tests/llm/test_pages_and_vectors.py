"""Operators 5, 7 and 8."""

from __future__ import annotations

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm import html_extract, neighbours, warc

# 5


def test_hilbert_curve_visits_every_cell_by_steps_of_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(cells, bits)
        order = cells[np.argsort(keys)]
        assert sorted(keys) == list(range(len(cells))) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def _brute(rows, k=20, every=20):
    out = {}
    good = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v))]
    for i, q in good:
        if i % every == 0:
            out.setdefault((i, tuple(q)), sorted(((-float(q @ v), j) for j, v in good if j != i))[:k])
    return out


def test_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16)) * 3
    v = centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    rows += [(2000 + i, [1.5 * x for x in rows[20][1]]) for i in range(60)]  # a frequent vector, nearest to row 20
    rows += [rows[40], (3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0] * 15 + [float("nan")]), (3004, [1.0] * 15 + [None]), (None, rows[3][1]), (3020, [1.0] * 15 + [float("inf")]), (3040, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got: dict = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = {i: w for (i, q), w in _brute([r for r in rows if not r[1] or len(r[1]) == 16]).items()}
    assert set(got) == set(want)
    hit = 0
    vec = {i: np.array(x) for i, x in rows if x and None not in x}
    for i, w in want.items():
        assert [g[0] for g in got[i]] == list(range(1, 21))
        assert all(g[2] == pytest.approx(float(vec[i] @ vec[g[1]]), abs=1e-9) for g in got[i])
        assert got[i] == sorted(got[i], key=lambda g: (-g[2], g[1]))
        hit += len({g[1] for g in got[i]} & {j for _, j in w})
    assert hit / (20 * len(want)) >= 0.9
    frequent = set(range(2000, 2060))
    ties = [[g[1] for g in rows_ if g[1] in frequent] for rows_ in got.values()]
    assert max(map(len, ties)) > 5 and all(t == sorted(frequent)[: len(t)] or t == sorted(frequent - {i})[: len(t)] for i, t in zip(got, ties))


def test_repeated_rows_of_equal_vectors_take_no_place(spark):
    """Row 0 repeats 50 times; the other ids with its vector are still its nearest."""
    rows = [(0, [1.0, 0.0])] * 50 + [(i, [1.0, 0.0]) for i in range(1, 31)] * 3 + [(100 + i, [0.0, 1.0 + i]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [r.vec_id for r in neighbours.search(df).filter("query_id = 0").orderBy("rank").collect()]
    assert got == list(range(1, 21))


def test_search_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0)]
    assert neighbours.search(df.filter("false")).count() == 0 and neighbours.search(df.filter("vec_id = 1")).count() == 0
    assert neighbours.search(df.filter("vec_id = 0")).count() == 0


# 7


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header class=top>Site</header><nav><ul><li><a href=/>Home</a></ul></nav><!-- <p>no</p> --><div id="cookie-notice">We use cookies</div>
<main><article><header><h1>Head &amp;  line</h1></header><p>One <b>two<br>three</b>&nbsp;&lt;x&gt;</p><div class="ad">Buy</div><p>Four<p>five &copy; six</p>
<form><label>Name</label><input></form><aside>Side</aside><section class="comments"><p>First!</p></section></article></main>
<div class="sidebar"><p>links</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head & line\n\nOne two three <x>\n\nFour\n\nfive © six"
    assert html_extract.main_text("") == "" and html_extract.main_text("plain  text\n here") == "plain text here"
    assert html_extract.main_text("<p>cut off <b>here &am") == "cut off here &am" and html_extract.main_text("<p>a</p><p cla") == "a"
    assert html_extract.main_text("<ul><li>x<li>y</ul>1 < 2") == "x\n\ny\n\n1 < 2"


@pytest.mark.parametrize(("html", "text"), [
    ('<article><p>Intro</p><p class="alert">Storm warning</p><div class="search-and-rescue">Boats</div><div class="share-prices">Up</div><p>End</p></article>', "Intro\n\nStorm warning\n\nBoats\n\nUp\n\nEnd"),
    ('<article><p>a</p><div class="share-buttons">b</div><div class="site cookie-banner">c</div><span class="ad">x</span><section class="comments">z</section></article>', "a"),
    ('<div id="content"><p>The main text of the page</p></div><article>Teaser</article>', "The main text of the page\n\nTeaser"),
    ('<div>Head</div><div role="main"><p>The text that counts</p></div>', "The text that counts"),
])
def test_names_of_elements(html, text):
    assert html_extract.main_text(html) == text


def test_templates_are_counted_over_the_whole_page(spark):
    """Menus and footers that recur are found as templates, by the same counts as a brute force has."""
    page = lambda i: f"<nav><ul><li>Home</li><li>Item {i}</li></ul></nav><article><h1>H{i}</h1><p>Text {i}</p></article><footer><p>By us</p></footer>"
    rows = [(i, f"https://{'ab'[i % 2]}.example/{i}", page(i)) for i in range(11)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    units: dict = {}
    for _, url, html in rows:
        p = html_extract.Page(html)
        outer, parts, lines = p.hashes()
        for line, hashes, unit in ((False, outer, html), (False, parts, p.key()), (True, lines, p.key())):
            for h in hashes:
                units.setdefault((url[8], h, line), set()).add(unit)
    want = {(f"{k[0]}.example", *k[1:]) for k, u in units.items() if len(u) >= (20 if k[2] else 5)}
    got = {(r["host"], r["hash"], r["line"]) for r in html_extract.templates(html_extract.subtrees(df), 5, 20).collect()}
    assert got == want and len(want) == 6  # li, footer and its p on each host
    out = {r.page_id: (r.text, r.n_template) for r in html_extract.extract(df).collect()}
    assert out[4] == ("H4\n\nText 4", 2)


@pytest.mark.parametrize("s", ["<div>a" * 20000, "<div>" * 20000 + "</p>" * 20000, "<!--" * 50000, '<a "' * 50000, "<p><b>" * 20000, "<" * 100000, "<script>" * 20000])
def test_parser_is_linear(s):
    assert isinstance(html_extract.main_text(s), str)


def test_site_templates_go(spark):
    """Without article marks only what recurs on a host tells template from text."""
    body = lambda i: f"<div><p>Daily News of the town</p></div><div><p>Story {i} is here</p><p>Same end.</p></div><div>Printed by us</div>"
    rows = [(i, f"https://a.example/{i}", body(i)) for i in range(8)] + [(100 + i, f"https://b{i}.example/", body(50 + i)) for i in range(4)]
    rows += [(200, None, body(0)), (201, "https://a.example/x", None), (202, "https://a.example/y", ""), rows[0]]
    rows += [(300 + i, "https://c.example/", f"<article><p>Often said.</p><p>Text {i}</p></article>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit("y"))
    for options in ({}, {"broadcast_rows": 0}):
        got = {r.page_id: r.text for r in html_extract.extract(df, **options).collect()}
        assert got[3] == "Story 3 is here" and got[100] == "Daily News of the town\n\nStory 50 is here\n\nSame end.\n\nPrinted by us"
        assert got[201] == "" and got[202] == "" and got[200].startswith("Daily") and got[305] == "Often said.\n\nText 5"
    assert html_extract.extract(df).count() == len(rows) and html_extract.extract(df.filter("false")).count() == 0


def test_templates_inside_articles_go(spark):
    """Parts that recur inside articles go; single lines only if many articles have them; versions of one article count once."""
    box = "<div><p>Read more</p><ul><li>One</li></ul></div>"
    rows = [(i, f"https://a.example/{i}", f"<main><article><h1>Head {i}</h1>{box}<p>Text {i}</p><p>Quoted.</p></article></main>") for i in range(6)]
    rows += [(100 + i, f"https://b.example/{i}", f"<article><p>Story {i}</p><p>All rights reserved.</p></article>") for i in range(20)]
    rows += [(200 + i, f"https://c.example/{i}", f"<article><h1>Same</h1><div><p>The text.</p></div><p>Read {i} times</p></article>") for i in range(9)]
    rows += [(300 + i, f"https://d.example/{i}", f"<nav>{i}</nav><article><div><p>Whole text.</p></div></article>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[3] == "Head 3\n\nText 3\n\nQuoted." and got[107] == "Story 7"
    assert got[204] == "Same\n\nThe text.\n\nRead 4 times" and got[304] == "Whole text."


def test_templates_of_sections_go_on_large_hosts(spark):
    """A box on 6 of 200 pages of a host goes as it does on a small host; on 4 it stays."""
    box = lambda i: "<div><p>Of the section</p></div>" if i < 6 else "<div><p>On few</p></div>" if i < 10 else ""
    df = spark.createDataFrame([(i, f"https://a.example/{i}", f"{box(i)}<div><p>Text {i}</p></div>") for i in range(200)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert [got[i] for i in (2, 7, 150)] == ["Text 2", "On few\n\nText 7", "Text 150"]


# 8


def test_archives_round_trip(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, f"https://h.example/{i}?q=é x", f"<p>{r.randrange(20)}é</p>" * r.randint(0, 3)) for i in range(150)]
    rows += [(500, None, None), (501, "u", ""), rows[7], (None, "n", rows[3][2]), (None, "n", "only here"), (600, "long", "x\r\n\r\n" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(4)
    for least in (0, 12):
        manifest = warc.write(df, f"file://{tmp_path}/w{least}", archive_bytes=4000, min_bytes=least)
        assert manifest.count() > 8
        captures = warc.assemble(warc.read_records(manifest))
        assert captures.filter("request is null or metadata is null").count() == 0
        first: dict = {}
        for i, _, h in rows:
            if i is not None:
                first[h or ""] = min(i, first.get(h or "", i))
        want = []
        for i, _, h in rows:
            data = (h or "").encode()
            refers = first.get(h or "") if len(data) >= least and first.get(h or "") is not None and (i is None or i > first[h or ""]) else None
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
        assert sorted(map(str, (tuple(x) for x in warc.resolve(captures).collect()))) == sorted(map(str, want))
        bodies = {bytes(x.response.payload).decode() for x in captures.collect() if x.response.type == "response"}
        assert bodies == {h or "" for _, _, h in rows}
    assert warc.resolve(warc.assemble(warc.read_records(warc.write(df.filter("false"), f"{tmp_path}/none")))).count() == 0


def test_revisits_name_their_response(spark, tmp_path):
    rows = [(5, "first", "x" * 50), (7, "second", "x" * 50), (9, "third", "x" * 50), (1, "twice", "y"), (1, "twice", "y"), (2, "of-twice", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for k, options in enumerate(({}, {"broadcast_rows": 0})):
        found = {(r.uri, r.type): r for r in warc.read_records(warc.write(df, f"{tmp_path}/{k}", **options)).collect()}
        first = found["first", "response"]
        for name in ("second", "third"):
            r = found[name, "revisit"]
            assert (r.refers_to, r.refers_uri, r.refers_date, r.digest) == (first.record_id, "first", first.date, first.digest) and r.payload_bytes is None
        assert found["of-twice", "revisit"].refers_to is None and found["of-twice", "revisit"].refers_uri == "twice"


def test_archive_is_read_by_its_records(spark, tmp_path):
    m = warc.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "one"))
    kinds = [(r.type, r.uri) for r in warc.read_records(m).collect()]
    assert sorted(kinds) == [("metadata", "u"), ("request", "u"), ("response", "u")] and math.isclose(m.first().captures, 1)
    assert C.work_dir(spark)


def test_one_page_tree_at_a_time(monkeypatch):
    """A batch of pages holds the tree of one page, not of all."""
    import weakref

    import pyarrow as pa

    from ledgerloom.llm import html_extract

    alive, most = weakref.WeakSet(), []

    class Counted(html_extract.Page):
        def __init__(self, html):
            super().__init__(html)
            alive.add(self)
            most.append(len(alive))

    monkeypatch.setattr(html_extract, "Page", Counted)
    html = [f"<main><div><p>Text {i}</p></div></main>" for i in range(50)] + [None, ""]
    got = html_extract._read(pa.record_batch({"host": ["h"] * 52, "page_key": list(range(52)), "html": html}))
    assert len(got["article"]) == len(got["parts"]) == 52 and got["parts"][-1] == [] and all(got["parts"][:50])
    assert max(most) <= 2  # the last one goes when the next is made
