"""The queries over the driver tables, by name; each applies operators of the library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as P
from ledgerloom.functions.statistics import wilson
from ledgerloom.operators import audit, describe, eventwindow, facts as fact_ops, filing_html, filing_text, filters, panel as ops, regression, sampling, text_features as tf
from ledgerloom.plans.surrogates import facts, panel, table, verdicts


def r4(c) -> F.Column:
    return F.round(P.col(c), 4)


def _rounded(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.select(*keys, *(r4(v).alias(v) for v in values))


def panel_ratios(spark, d):
    p = ops.add_ratios(panel(spark, d).withColumnsRenamed({"current": "assets_current", "equity": "liabilities_current"}))
    return _rounded(p, ["ticker", "fiscal_year"], ["log_total_assets", "leverage", "roa", "current_ratio"])


def asset_growth_gap_guard(spark, d):
    p = ops.add_ratios(panel(spark, d, False)).withColumn("gap_days", ops.days_since_previous())
    return p.select("ticker", "fiscal_year", "gap_days", r4("asset_growth").alias("asset_growth"))


def identity_fill(spark, d):
    p = panel(spark, d).withColumn("filled", P.identity_fill("total_liabilities", "total_assets", "equity"))
    return _rounded(p, ["ticker", "fiscal_year"], ["total_liabilities", "filled"])


def ffill_bfill_limit1(spark, d):
    p = panel(spark, d).withColumns({"ni1": F.col("net_income"), "ni2": F.col("net_income")})
    return _rounded(ops.fill_limited(ops.fill_limited(p, ["ni1"]), ["ni2"], limit=2), ["ticker", "fiscal_year"], ["ni1", "ni2"])


def lagged_metric(spark, d):
    return _rounded(ops.add_changes(ops.add_lag(panel(spark, d), "net_income", "lagged"), ["total_assets"]), ["ticker", "fiscal_year"], ["lagged", "d_total_assets"])


def dup_and_transition_filter(spark, d):
    """Orders as periods, their week as filing date, so that several share one."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("net_income"))
    one = filters.first_per_key(o, ["ticker", "day"], ["k"])
    p = one.select("ticker", F.col("day").alias("year_end"), F.make_date(F.year("day"), F.lit(1), F.lit(1)).alias("filing_date"), "net_income", F.lit(1).alias("_helper"))
    return _rounded(ops.filter_transitions_and_duplicates(p), ["ticker", "year_end", "filing_date"], ["net_income"])


def drop_earliest_period(spark, d):
    return _rounded(ops.drop_earliest(panel(spark, d)), ["ticker", "fiscal_year"], ["total_assets"])


def cap_period(spark, d):
    return _rounded(ops.cap_period(panel(spark, d), 1999), ["ticker", "fiscal_year"], ["total_assets"])


def entity_coverage_filter(spark, d):
    return _rounded(ops.drop_low_coverage(panel(spark, d), "net_income"), ["ticker", "fiscal_year"], ["net_income"])


def min_periods_tail_n(spark, d):
    return _rounded(ops.tail_periods(panel(spark, d), 4, 3), ["ticker", "fiscal_year"], ["total_assets"])


def winsorize_pooled(spark, d):
    p = ops.add_ratios(panel(spark, d, False))
    return _rounded(ops.winsorize(p, ["asset_growth", "roa", "leverage"]), ["ticker", "fiscal_year"], ["asset_growth", "roa", "leverage"])


def fact_priority_resolution(spark, d):
    f = facts(spark, d).withColumn("metric", F.lit("price"))
    w = fact_ops.winners(f, ("ticker", "period"), "metric", "priority", "filed", ("scan",))
    return w.select("ticker", "period", "tag", "filed", "accn", r4("val").alias("val"))


def amendment_precedence(spark, d):
    kept = fact_ops.amendments_first(facts(spark, d), ("ticker", "period"))
    g = kept.groupBy("ticker", "period").agg(F.count("*").alias("n"), F.min("filed").alias("filing_date"), F.max("is_amend").alias("amended"), r4(F.sum("val")).alias("val"))
    return g.select("ticker", "period", "n", "filing_date", P.form_type("amended").alias("form_type"), "val")


def fact_pivot_wide(spark, d):
    f = fact_ops.amendments_first(facts(spark, d), ("ticker", "period")).withColumn("metric", F.when(F.col("tag") == "A", "returned").otherwise("sold"))
    won = fact_ops.winners(f, ("ticker", "period"), "metric", "priority", "filed", ("scan",))
    at = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return won.groupBy("ticker", "period").agg(F.max_by("accn", "scan").alias("accn"), r4(at("sold", "val")).alias("sold"), at("sold", "tag").alias("tag_sold"), r4(at("returned", "val")).alias("returned"))


def _tags(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("ticker"), "o_orderkey", F.col("o_totalprice").alias("income"), F.col("o_orderpriority").alias("_tag_income"))


_TAGS = [(t, "income", i) for i, t in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))]


def dominant_tag(spark, d):
    return ops.dominant(_tags(spark, d), "ticker", "_tag_income").withColumnRenamed("_tag_income", "tag")


def tag_lock(spark, d):
    locked = ops.lock_tags(_tags(spark, d), tags=_TAGS, equivalent={"income": ("1-URGENT", "2-HIGH")})
    return locked.select("ticker", "o_orderkey", r4("income").alias("income"), F.col("_tag_income").alias("tag"))


def tag_distribution(spark, d):
    locked = ops.lock_tags(_tags(spark, d), tags=_TAGS, equivalent={})
    return ops.tag_distribution(ops.tag_provenance(locked), [*_TAGS, ("6-NEVER", "income", 9)]).select("metric", "locked_tag", F.col("firms").cast("long").alias("firms"), r4("percent").alias("percent"))


def event_window_volatility(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("ticker"), F.to_date("ts").alias("day"), "value", "event_type", "event_id")
    daily = e.groupBy("ticker", "day").agg(F.min_by("value", F.struct("value", "event_id")).alias("close")).withColumnRenamed("day", "date")
    anchors = e.filter("event_type = 'signup'").select("event_id", "ticker", F.col("day").alias("filing_date"))
    got = eventwindow.window_returns(anchors, daily, lag_days=2, window_days=14, min_observations=5)
    return got.select("event_id", "ticker", "filing_date", r4("return_next_year").alias("ret"), r4("vol_next_year").alias("vol"))


def sic_style_bucket_filter(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("sic_raw"), F.when(F.col("p_size") % 3 == 0, "other").otherwise("operating").alias("entity_type"))
    s = filters.operating_only(p).withColumn("sic", P.parse_sic(F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(F.concat("sic_raw", F.lit("07")))))
    return filters.outside_sic(s, 2000, 3000).select("p_partkey", "sic", P.sic2("sic").alias("sic2"))


def fiscal_year_assign(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("year_end"), (F.col("o_custkey") % 12 + 1).cast("int").alias("fye"))
    return o.select("o_orderkey", "year_end", "fye", P.fiscal_year("year_end", "fye").alias("fiscal_year"))


def universe_topn(spark, d):
    c = table(spark, d, "customer")
    w = Window.orderBy(F.desc("c_acctbal"), "c_custkey")
    top = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)  # the universe's size is a setting
    return top.select(F.row_number().over(w).alias("rank"), F.upper("c_name").alias("ticker"), F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"))


def resume_anti_join(spark, d):
    todo = table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_nationkey").alias("fiscal_year"))
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("ticker")).join(todo, "ticker")
    return filters.resume(todo, done)


def distinct_keys(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return filters.first_per_key(o, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


def semi_join_keep(spark, d):
    big = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n >= 12").select(F.col("o_custkey").alias("ticker"))
    return filters.keep_entities(table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), "c_name"), big)


def metadata_left_join(spark, d):
    meta = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("ticker"), F.col("c_nationkey").alias("sic"))
    return _rounded(panel(spark, d).join(meta, "ticker", "left"), ["ticker", "fiscal_year", "sic"], ["total_assets"])


def missing_census(spark, d):
    return ops.census(panel(spark, d), ["total_assets", "total_liabilities", "net_income"])


def _ratios(spark, d):
    return ops.add_ratios(panel(spark, d))


def describe_stats(spark, d):
    out = describe.describe(_ratios(spark, d), ["log_total_assets", "leverage", "roa", "asset_growth"])
    return _rounded(out, ["variable", "n"], ["mean", "std", "p25", "p50", "p75"])


def pearson_matrix(spark, d):
    out = describe.correlations(_ratios(spark, d), ["log_total_assets", "leverage", "roa", "asset_growth"])
    return _rounded(out, ["variable", "other", "n"], ["r"])


def fe_one_way_within(spark, d):
    return _rounded(regression.within_one_way(_ratios(spark, d), "roa", "leverage", "fiscal_year"), ["n", "levels"], ["coef"])


def fe_two_way_clustered(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ticker"), F.col("c_nationkey").alias("sic2"))
    p = _ratios(spark, d).join(c, "ticker")
    fits = regression.nested(p, "roa", (("leverage",), ("leverage", "log_total_assets")))
    return reduce(DataFrame.union, [f.table(spark, f"m{i + 1}") for i, f in enumerate(fits)])


def stratified_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return sampling.stratified(docs, ["lang"], 20, ["doc_id"]).select("lang", "doc_id")


def criterion_rates_wilson(spark, d):
    out = audit.criterion_rates(verdicts(spark, d), ("quality_ok", "toxic_ok", "length_ok"))
    return _rounded(out, ["criterion", "n", "n_pass", "n_minor", "n_fail", "n_error"], ["strict", "lenient", "low", "high"])


def overall_by_stratum(spark, d):
    out = audit.overall_rates(verdicts(spark, d), ["lang"], ("quality_ok", "toxic_ok", "length_ok"))
    return _rounded(out, ["lang", "n", "n_strict", "n_lenient"], ["strict", "lenient", "low", "high"])


def quality_ladder(spark, d):
    v = verdicts(spark, d).withColumn("tag", P.quality_tag(["quality_ok", "toxic_ok", "length_ok"]))
    return v.groupBy("source", "tag").agg(F.count("*").alias("n"))


def wilson_intervals(spark, d):
    g = table(spark, d, "labels").groupBy((F.col("doc_id") % 10).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return g.select("bucket", "n", "k", r4(low).alias("low"), r4(high).alias("high"))


def response_parse(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("Correct Section: pass\nNotes: Failed to "), F.col("event_type"), F.lit("\nContent quality: "), F.when(F.col("event_id") % 3 == 0, "Minor issue").otherwise("?"), F.lit("\nEnd boundary: a:b")).alias("response"))
    m = audit.parse_response("response")
    return e.select("event_id", *(m[k].alias(k) for k in ("correct_section", "notes", "content_quality", "end_boundary", "completeness")))


def era_labels(spark, d):
    e = table(spark, d, "orders").select((F.year("o_orderdate") + 15).alias("fy"))
    return e.groupBy(P.era("fy").alias("era")).agg(F.count("*").alias("n"))


def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", P.word_count("text").alias("words"), F.length(P.one_line("text")).alias("chars"))


def clean_lines(spark, d):
    out = filing_text.clean_sections(table(spark, d, "documents").select("doc_id", F.col("text").alias("t")), "t")
    return out.select("doc_id", F.length("t").alias("chars"), P.word_count("t").alias("words"))


def repeated_short_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    short = lines.withColumn("line", F.trim("line")).filter((F.size(F.filter(F.split("line", r"\s+", -1), lambda w: w != "")) <= 8) & (F.col("line") != ""))
    return short.groupBy("doc_id", "line").agg(F.count("*").alias("n")).filter("n >= 4")


def html_to_text(spark, d):
    p = filing_html.parse_documents(table(spark, d, "pages"), "html", ("page_id",))
    return p.select("page_id", F.length("text").alias("chars"), P.word_count("text").alias("words"), F.size("positions").alias("headers"))


def filing_sections(spark, d):
    """Pages dressed as filings: two item headings around the page's text."""
    body = F.concat(F.lit("<p><b>Item 1A. Risk Factors</b></p><div>"), "html", F.lit("</div><p><b>Item 2. Properties</b></p><p>none</p>"))
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("accession_number"), body.alias("html"))
    got = filing_text.extract_filings(p, targets=("1a",))
    return got.select("accession_number", P.word_count("item_1a").alias("words"), F.length("item_1a").alias("chars"))


_WORDS = (("the", "positive"), ("and", "negative"), ("of", "uncertainty"), ("und", "negative"), ("die", "positive"), ("de", "litigious"), ("la", "uncertainty"))


def tone_ratio(spark, d):
    words = spark.createDataFrame(list(_WORDS), "word string, category string")
    t = tf.tone(table(spark, d, "documents").select("doc_id", "text"), words, ["doc_id"])
    return _rounded(t, ["doc_id", "n_tokens"], ["negative_pct", "positive_pct", "uncertainty_pct", "litigious_pct", "risk_density", "net_tone"])


def tfidf_yoy_cosine(spark, d):
    """The part of X2 that its SQL covers: single words only. Single documents as sections of firms: source and lang are the firm, one document a year."""
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "text")
    w = Window.partitionBy("source", "lang").orderBy("doc_id")
    own = docs.select(F.concat_ws("-", "source", "lang").alias("ticker"), F.row_number().over(w).alias("fiscal_year"), "text")
    weights = tf.tfidf(own, ["ticker", "fiscal_year"], "ticker", grams=1).persist()  # read three times; on disk where memory ends
    return _rounded(tf.yearly_similarity(weights), ["ticker", "fiscal_year"], ["similarity", "delta"])


def tfidf_yoy_cosine_2grams(spark, d):
    """1- and 2-grams. Rows are numbered without their texts, which move only where the numbers are too many for a broadcast."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    docs = table(spark, d, "documents").select("source", "lang", "doc_id", "text", at.alias("at"))
    w = Window.partitionBy("source", "lang").orderBy("doc_id", "at")
    numbers = docs.select(F.concat_ws("-", "source", "lang").alias("ticker"), F.row_number().over(w).alias("fiscal_year"), "at")
    numbers = F.broadcast(numbers) if docs.count() <= 300_000 else numbers
    own = docs.select("at", "text").join(numbers, "at").select("ticker", "fiscal_year", "text")
    return _rounded(tf.yearly_text_similarity(own), ["ticker", "fiscal_year"], ["similarity", "delta"])


def divergence(spark, d):
    p = ops.add_changes(_ratios(spark, d), ["leverage", "roa"])
    out = tf.divergence(p, "d_leverage", "d_roa")
    return out.select("ticker", "fiscal_year", "sign_differs", (r4("divergence") + 0.0).alias("divergence"))  # no negative zero


def quartile_sort(spark, d):
    out = tf.quartile_sort(_ratios(spark, d), "leverage", "roa", ["fiscal_year"], ["ticker"])
    return _rounded(out, ["quartile", "n"], ["mean_x", "mean_y"])


def block_turnover(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))
    w = Window.partitionBy("source").orderBy("doc_id")
    own = docs.select(F.col("source").alias("ticker"), F.row_number().over(w).alias("fiscal_year"), "text")
    return _rounded(tf.block_changes(own), ["ticker", "fiscal_year"], ["added", "removed", "modified", "turnover"])


def q4_reliability(spark, d):
    """Quarters of a customer's years, the fourth once more as the year's rest."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), F.concat(F.lit("Q"), F.quarter("o_orderdate")).alias("period"), F.col("o_totalprice").alias("v"))
    q = o.groupBy("ticker", "fiscal_year", "period").agg(F.sum("v").alias("value"))
    fy = q.groupBy("ticker", "fiscal_year").agg(F.sum(F.col("value") * F.when((F.col("period") == "Q4") & (F.col("ticker") % 2 == 0), 1.5).otherwise(1.0)).alias("value")).withColumn("period", F.lit("FY"))
    return _rounded(tf.q4_reliability(q.unionByName(fy).withColumn("metric", F.lit("price"))), ["metric", "n", "n_match"], ["match_rate"])


QUERIES = {f.__name__: f for f in (
    panel_ratios, asset_growth_gap_guard, identity_fill, ffill_bfill_limit1, lagged_metric, dup_and_transition_filter, drop_earliest_period, cap_period, entity_coverage_filter,
    min_periods_tail_n, winsorize_pooled, fact_priority_resolution, amendment_precedence, fact_pivot_wide, dominant_tag, tag_lock, tag_distribution, event_window_volatility,
    sic_style_bucket_filter, fiscal_year_assign, universe_topn, resume_anti_join, distinct_keys, semi_join_keep, metadata_left_join, missing_census, describe_stats, pearson_matrix,
    fe_one_way_within, fe_two_way_clustered, stratified_sample, criterion_rates_wilson, overall_by_stratum, quality_ladder, wilson_intervals, response_parse, era_labels, word_counts,
    clean_lines, repeated_short_lines, html_to_text, filing_sections, tone_ratio, tfidf_yoy_cosine, tfidf_yoy_cosine_2grams, divergence, quartile_sort, block_turnover, q4_reliability,
)}
