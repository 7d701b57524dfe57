from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import text_features as tf
from ledgerloom.plans.catalogue import QUERIES, table


def _grams(text, stop=()):
    w = [x for x in re.findall("[a-z]+", (text or "").lower()) if x not in stop]
    return Counter(w) + Counter(f"{a} {b}" for a, b in zip(w, w[1:]))


def _similarities(docs, stop=()):
    """{(ticker, year): cosine with the year before} of rows (ticker, year, text), by brute force."""
    terms = {(t, y): _grams(x, stop) for t, y, x in docs}
    df, firms = Counter(), defaultdict(set)
    for (t, _), c in terms.items():
        df.update(c.keys())
        for g in c:
            firms[g].add(t)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items() if len(firms[g]) >= 5 and n <= 0.95 * len(docs)}
    w = {k: {g: n * idf[g] for g, n in c.items() if g in idf} for k, c in terms.items()}
    w = {k: v for k, v in w.items() if v}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in w.items()}
    return {(t, y): sum(x * w[t, y - 1].get(g, 0.0) for g, x in v.items()) / norm[t, y] / norm[t, y - 1] for (t, y), v in w.items() if (t, y - 1) in w}


def test_query_with_bigrams_against_brute_force(spark, sf_dir):
    by = defaultdict(list)
    for r in table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "text").orderBy("doc_id").collect():
        by["-".join(x for x in (r.source, r.lang) if x is not None)].append(r.text)
    want = _similarities([(t, y, x) for t, xs in by.items() for y, x in enumerate(xs, 1)])
    got = {(r.ticker, r.fiscal_year): r for r in QUERIES["tfidf_yoy_cosine_2grams"](spark, sf_dir).collect()}
    assert set(got) == set(want) and want
    assert all(abs(got[k].similarity - s) < 1e-4 and abs(got[k].delta - 1 + s) < 1e-4 for k, s in want.items())


def test_stop_words_go_before_bigrams(spark):
    docs = [(f"t{i}", y, f"risk of loss {'may' if y else 'will'} of grow") for i in range(6) for y in range(2)]
    df = spark.createDataFrame(docs, "ticker string, fiscal_year int, text string")
    weights = tf.tfidf(df, ["ticker", "fiscal_year"], "ticker", stop_words=("of", "may", "will"), most_share=1.0)
    terms = {r.term for r in weights.select("term").distinct().collect()}
    assert terms == {"risk", "loss", "grow", "risk loss", "loss grow"}
    got = {(r.ticker, r.fiscal_year): r.similarity for r in tf.yearly_similarity(weights).withColumn("x", F.lit(1)).collect()}
    assert got == pytest.approx({(f"t{i}", 1): 1.0 for i in range(6)})


def test_packed_similarity_sends_no_row_for_each_term(spark):
    """The same figures as tfidf and yearly_similarity, for repeated, null and wordless texts, gaps, three-grams; rows shuffled stay few."""
    words = "risk of loss may grow with debt and cash".split()
    docs = [(f"t{i}", y, " ".join(words[(i * y + k) % (3 + i % 6)] for k in range(2 + 7 * y % 11))) for i in range(9) for y in (1, 2, 3, 5, 6)]
    docs += [("t1", 2, "Risk of LOSS"), ("t2", 4, None), ("t3", 4, "1 2 3"), (None, 2, "risk of loss"), ("t4", None, "of loss"), ("t5", 7, "loss"), ("t6", 7, "loss")]
    df = spark.createDataFrame(docs, "ticker string, fiscal_year int, text string")
    for options in ({}, {"grams": 1}, {"grams": 3, "stop_words": ("of",), "least_entities": 2, "most_share": 0.6}):
        want = {(r.ticker, r.fiscal_year): (r.similarity, r.delta) for r in tf.yearly_similarity(tf.tfidf(df, ["ticker", "fiscal_year"], "ticker", **options)).collect()}
        packed = tf.yearly_text_similarity(df, **options)
        got = {(r.ticker, r.fiscal_year): (r.similarity, r.delta) for r in packed.collect()}
        assert set(got) == set(want) and len(want) > 20
        assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    empty = df.filter("ticker = 'nobody'")
    assert tf.yearly_text_similarity(empty).count() == 0


def test_query_with_bigrams_moves_no_row_for_each_term(spark, sf_dir):
    """Of the plan's nodes none explodes texts into terms."""
    plan = QUERIES["tfidf_yoy_cosine_2grams"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(" not in plan.replace("explode(array(", "") and "MapInArrow" in plan
