"""SQL (DuckDB) with the results of the catalogue's queries, by name."""

from __future__ import annotations

_PANEL = """panel0 AS (
  SELECT o_custkey AS ticker, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, max(CAST(o_orderdate AS DATE)) AS filing_date,
    sum(l_extendedprice) AS total_assets,
    sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice * (1 - l_discount) END) AS total_liabilities,
    sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice * (1 - l_discount) END) AS equity,
    sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount END) AS net_income,
    sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END) AS current_
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
panel AS (SELECT *, make_date(fiscal_year, 12, 31) AS year_end FROM panel0),
panel_last AS (SELECT *, filing_date AS year_end FROM panel0)"""


def _growth(of: str) -> str:
    return f"""grown AS (
  SELECT *, CASE WHEN total_assets > 0 THEN ln(total_assets) END AS log_total_assets,
    CASE WHEN total_assets > 0 THEN total_liabilities / total_assets END AS leverage,
    CASE WHEN total_assets > 0 THEN net_income / total_assets END AS roa,
    CASE WHEN equity > 0 THEN current_ / equity END AS current_ratio,
    date_diff('day', lag(year_end) OVER w, year_end) AS gap_days,
    CASE WHEN lag(total_assets) OVER w > 0 AND date_diff('day', lag(year_end) OVER w, year_end) BETWEEN 300 AND 400
      THEN (total_assets - lag(total_assets) OVER w) / lag(total_assets) OVER w END AS asset_growth
  FROM {of} WINDOW w AS (PARTITION BY ticker ORDER BY year_end))"""


def _wilson(k: str, n: str) -> str:
    p, z = f"(CAST({k} AS DOUBLE) / {n})", 1.96
    spread = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}))"
    scale = f"(1 + {z * z} / {n})"
    return f"""round(CASE WHEN {n} > 0 THEN greatest(0.0, ({p} + {z * z} / (2.0 * {n}) - {spread}) / {scale}) ELSE 0.0 END, 4) AS low,
    round(CASE WHEN {n} > 0 THEN least(1.0, ({p} + {z * z} / (2.0 * {n}) + {spread}) / {scale}) ELSE 1.0 END, 4) AS high"""


_FACTS = """facts AS (
  SELECT l_partkey AS ticker, CAST(year(l_shipdate) AS INTEGER) AS period, l_returnflag AS tag,
    CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS priority, CAST(l_shipdate AS DATE) AS filed,
    l_linestatus = 'O' AS is_amend, l_extendedprice AS val, l_orderkey AS accn, l_orderkey AS s1, l_linenumber AS s2, l_partkey AS s3, l_suppkey AS s4
  FROM lineitem),
kept AS (SELECT * FROM facts QUALIFY is_amend = max(is_amend) OVER (PARTITION BY ticker, period))"""

_SCAN = "priority, filed DESC, s1, s2, s3, s4"

_VERDICTS = """v AS (
  SELECT d.doc_id, source, lang, CASE WHEN quality = 1 THEN 'Pass' ELSE 'Fail' END AS quality_ok, CASE WHEN toxic = 0 THEN 'Pass' ELSE 'Minor' END AS toxic_ok,
    CASE WHEN n_chars > 500 THEN 'Pass' WHEN n_chars > 200 THEN 'Minor' WHEN n_chars > 50 THEN 'Fail' ELSE '?' END AS length_ok
  FROM documents d JOIN labels USING (doc_id))"""

_LADDER = """CASE WHEN quality_ok = 'Pass' AND toxic_ok = 'Pass' AND length_ok = 'Pass' THEN 'PASS'
    WHEN quality_ok IN ('Pass', 'Minor') AND toxic_ok IN ('Pass', 'Minor') AND length_ok IN ('Pass', 'Minor') THEN 'MINOR'
    WHEN quality_ok IN ('Pass', 'Minor', 'Fail') AND toxic_ok IN ('Pass', 'Minor', 'Fail') AND length_ok IN ('Pass', 'Minor', 'Fail') THEN 'FAIL' ELSE 'PARSE_ERR' END"""

_TAGS = "tags AS (SELECT o_custkey AS ticker, o_orderkey, o_totalprice AS income, o_orderpriority AS tag FROM orders), dom AS (SELECT ticker, tag FROM (SELECT ticker, tag, count(*) AS n FROM tags GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY n DESC, tag) = 1)"

#: Spaces that the queries' word splitting knows; texts here hold no others.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0B}]+"


def _words(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array({c}, '{_SPACE}'), lambda w: w <> ''))"


_DICTIONARY = "dict(word, category) AS (VALUES ('the', 'positive'), ('and', 'negative'), ('of', 'uncertainty'), ('und', 'negative'), ('die', 'positive'), ('de', 'litigious'), ('la', 'uncertainty'))"


def _describe(v: str) -> str:
    return f"SELECT '{v}' AS variable, count({v}) AS n, round(avg({v}), 4) AS mean, round(stddev_samp({v}), 4) AS std, round(quantile_cont({v}, 0.25), 4) AS p25, round(quantile_cont({v}, 0.5), 4) AS p50, round(quantile_cont({v}, 0.75), 4) AS p75 FROM grown"


_VARS = ("log_total_assets", "leverage", "roa", "asset_growth")

ORACLES: dict[str, str] = {
    "panel_ratios": f"WITH {_PANEL}, {_growth('panel')} SELECT ticker, fiscal_year, round(log_total_assets, 4) AS log_total_assets, round(leverage, 4) AS leverage, round(roa, 4) AS roa, round(current_ratio, 4) AS current_ratio FROM grown",
    "asset_growth_gap_guard": f"WITH {_PANEL}, {_growth('panel_last')} SELECT ticker, fiscal_year, CAST(gap_days AS INTEGER) AS gap_days, round(asset_growth, 4) AS asset_growth FROM grown",
    "identity_fill": f"WITH {_PANEL} SELECT ticker, fiscal_year, round(total_liabilities, 4) AS total_liabilities, round(coalesce(total_liabilities, total_assets - equity), 4) AS filled FROM panel",
    "ffill_bfill_limit1": f"""WITH {_PANEL}, a AS (SELECT *, last_value(net_income IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY year_end ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS f1,
        last_value(net_income IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY year_end ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f2 FROM panel)
        SELECT ticker, fiscal_year, round(first_value(f1 IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY year_end ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 4) AS ni1,
        round(first_value(f2 IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY year_end ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 4) AS ni2 FROM a""",
    "lagged_metric": f"WITH {_PANEL} SELECT ticker, fiscal_year, round(lag(net_income) OVER w, 4) AS lagged, round(total_assets - lag(total_assets) OVER w, 4) AS d_total_assets FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY year_end)",
    "dup_and_transition_filter": """WITH o AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS year_end, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS net_income FROM orders
          QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1),
        g AS (SELECT *, make_date(year(year_end), 1, 1) AS filing_date, date_diff('day', lag(year_end) OVER (PARTITION BY ticker ORDER BY year_end), year_end) AS gap FROM o),
        k AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY ticker, filing_date ORDER BY (CASE WHEN net_income IS NOT NULL THEN 1 ELSE 0 END) * 10000 - abs(gap - 365) DESC NULLS LAST, year_end) = 1),
        h AS (SELECT *, date_diff('day', lag(year_end) OVER (PARTITION BY ticker ORDER BY year_end), year_end) AS gap2 FROM k)
        SELECT ticker, year_end, filing_date, round(net_income, 4) AS net_income FROM h WHERE gap2 IS NULL OR gap2 BETWEEN 300 AND 400""",
    "drop_earliest_period": f"WITH {_PANEL} SELECT ticker, fiscal_year, round(total_assets, 4) AS total_assets FROM panel QUALIFY year_end > min(year_end) OVER (PARTITION BY ticker)",
    "cap_period": f"WITH {_PANEL} SELECT ticker, fiscal_year, round(total_assets, 4) AS total_assets FROM panel WHERE fiscal_year <= 1999",
    "entity_coverage_filter": f"WITH {_PANEL} SELECT ticker, fiscal_year, round(net_income, 4) AS net_income FROM panel QUALIFY count(net_income) OVER (PARTITION BY ticker) * 1.0 / count(*) OVER (PARTITION BY ticker) >= 0.9",
    "min_periods_tail_n": f"WITH {_PANEL}, t AS (SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY year_end DESC) <= 4) SELECT ticker, fiscal_year, round(total_assets, 4) AS total_assets FROM t QUALIFY count(*) OVER (PARTITION BY ticker) >= 3",
    "winsorize_pooled": f"""WITH {_PANEL}, {_growth('panel_last')}, b AS (SELECT {", ".join(f"quantile_cont({v}, 0.01) AS lo_{v}, quantile_cont({v}, 0.99) AS hi_{v}" for v in ("asset_growth", "roa", "leverage"))} FROM grown)
        SELECT ticker, fiscal_year, {", ".join(f"round(CASE WHEN {v} IS NOT NULL THEN least(greatest({v}, lo_{v}), hi_{v}) END, 4) AS {v}" for v in ("asset_growth", "roa", "leverage"))} FROM grown, b""",
    "fact_priority_resolution": f"WITH {_FACTS} SELECT ticker, period, tag, filed, accn, round(val, 4) AS val FROM facts QUALIFY row_number() OVER (PARTITION BY ticker, period ORDER BY {_SCAN}) = 1",
    "amendment_precedence": f"WITH {_FACTS} SELECT ticker, period, count(*) AS n, min(filed) AS filing_date, CASE WHEN max(is_amend) THEN '10-K/A' ELSE '10-K' END AS form_type, round(sum(val), 4) AS val FROM kept GROUP BY 1, 2",
    "fact_pivot_wide": f"""WITH {_FACTS}, won AS (SELECT *, CASE WHEN tag = 'A' THEN 'returned' ELSE 'sold' END AS metric FROM kept QUALIFY row_number() OVER (PARTITION BY ticker, period, metric ORDER BY {_SCAN}) = 1)
        SELECT ticker, period, arg_max(accn, (s1, s2, s3, s4)) AS accn, round(max(CASE WHEN metric = 'sold' THEN val END), 4) AS sold, max(CASE WHEN metric = 'sold' THEN tag END) AS tag_sold, round(max(CASE WHEN metric = 'returned' THEN val END), 4) AS returned FROM won GROUP BY 1, 2""",
    "dominant_tag": f"WITH {_TAGS} SELECT ticker, tag FROM dom",
    "tag_lock": f"WITH {_TAGS}, x AS (SELECT t.*, t.tag = d.tag OR (t.tag IN ('1-URGENT', '2-HIGH') AND d.tag IN ('1-URGENT', '2-HIGH')) AS ok FROM tags t JOIN dom d USING (ticker)) SELECT ticker, o_orderkey, CASE WHEN ok THEN round(income, 4) END AS income, CASE WHEN ok THEN tag END AS tag FROM x",
    "tag_distribution": f"""WITH {_TAGS}, conf(locked_tag) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NEVER'))
        SELECT 'income' AS metric, locked_tag, count(ticker) AS firms, round(100.0 * count(ticker) / sum(count(ticker)) OVER (), 4) AS percent FROM conf LEFT JOIN dom ON tag = locked_tag GROUP BY 2""",
    "event_window_volatility": """WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
        s AS (SELECT user_id, day, min(value) AS close FROM e GROUP BY 1, 2),
        p AS (SELECT *, lag(close) OVER (PARTITION BY user_id ORDER BY day) AS c0, lag(day) OVER (PARTITION BY user_id ORDER BY day) AS d0 FROM s),
        a AS (SELECT DISTINCT user_id, day AS filed FROM e WHERE event_type = 'signup'),
        w AS (SELECT a.user_id, filed, count(*) AS n, CASE WHEN min_by(close, p.day) > 0 AND max_by(close, p.day) > 0 THEN ln(max_by(close, p.day) / min_by(close, p.day)) END AS ret,
            stddev_samp(CASE WHEN d0 >= filed + INTERVAL 2 DAY AND c0 > 0 AND close > 0 THEN ln(close / c0) END) * sqrt(252) AS vol
          FROM a JOIN p ON a.user_id = p.user_id AND p.day BETWEEN filed + INTERVAL 2 DAY AND filed + INTERVAL 16 DAY GROUP BY 1, 2 HAVING count(*) >= 5)
        SELECT event_id, e.user_id AS ticker, e.day AS filing_date, round(ret, 4) AS ret, round(vol, 4) AS vol FROM e LEFT JOIN w ON e.user_id = w.user_id AND e.day = w.filed WHERE event_type = 'signup'""",
    "sic_style_bucket_filter": "WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size * 100 + 7 END AS sic FROM part WHERE p_size % 3 <> 0) SELECT p_partkey, CAST(sic AS INTEGER) AS sic, CAST(sic // 100 AS INTEGER) AS sic2 FROM p WHERE NOT (sic >= 2000 AND sic < 3000)",
    "fiscal_year_assign": """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS year_end, CAST(o_custkey % 12 + 1 AS INTEGER) AS fye FROM orders),
        m AS (SELECT *, month(year_end) = fye % 12 + 1 AND day(year_end) <= 5 AS late FROM o)
        SELECT o_orderkey, year_end, fye, CAST(year(year_end) + (CASE WHEN (CASE WHEN late THEN fye ELSE month(year_end) END) > fye THEN 1 ELSE 0 END) - (CASE WHEN late AND month(year_end) < fye THEN 1 ELSE 0 END) AS INTEGER) AS fiscal_year FROM m""",
    "universe_topn": "SELECT CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank, upper(c_name) AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer QUALIFY rank <= 100",
    "resume_anti_join": "SELECT c_custkey AS ticker, c_nationkey AS fiscal_year FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "distinct_keys": "SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1",
    "semi_join_keep": "SELECT c_custkey AS ticker, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)",
    "metadata_left_join": f"WITH {_PANEL} SELECT ticker, fiscal_year, c_nationkey AS sic, round(total_assets, 4) AS total_assets FROM panel LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = ticker",
    "missing_census": f"WITH {_PANEL} SELECT count(*) AS rows, count(DISTINCT ticker) AS entities, count(*) FILTER (total_assets IS NULL) AS missing_total_assets, count(*) FILTER (total_liabilities IS NULL) AS missing_total_liabilities, count(*) FILTER (net_income IS NULL) AS missing_net_income FROM panel",
    "describe_stats": f"WITH {_PANEL}, {_growth('panel')} " + " UNION ALL ".join(_describe(v) for v in _VARS),
    "pearson_matrix": f"WITH {_PANEL}, {_growth('panel')}, c AS (SELECT * FROM grown WHERE {' AND '.join(f'{v} IS NOT NULL' for v in _VARS)}) " + " UNION ALL ".join(f"SELECT '{a}' AS variable, '{b}' AS other, count(*) AS n, round(corr({a}, {b}), 4) AS r FROM c" for i, a in enumerate(_VARS) for b in _VARS[:i]),
    "fe_one_way_within": f"""WITH {_PANEL}, {_growth('panel')}, u AS (SELECT roa AS y, leverage AS x, fiscal_year AS e FROM grown WHERE roa IS NOT NULL AND leverage IS NOT NULL),
        m AS (SELECT *, x - avg(x) OVER (PARTITION BY e) AS dx, y - avg(y) OVER (PARTITION BY e) AS dy FROM u) SELECT count(*) AS n, count(DISTINCT e) AS levels, round(sum(dx * dy) / sum(dx * dx), 4) AS coef FROM m""",
    "stratified_sample": "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) <= 20",
    "criterion_rates_wilson": f"""WITH {_VERDICTS}, l AS (SELECT 'quality_ok' AS criterion, quality_ok AS score FROM v UNION ALL SELECT 'toxic_ok', toxic_ok FROM v UNION ALL SELECT 'length_ok', length_ok FROM v),
        g AS (SELECT criterion, count(*) AS n, count(*) FILTER (score = 'Pass') AS n_pass, count(*) FILTER (score = 'Minor') AS n_minor, count(*) FILTER (score = 'Fail') AS n_fail, count(*) FILTER (score NOT IN ('Pass', 'Minor', 'Fail')) AS n_error FROM l GROUP BY 1)
        SELECT *, round(n_pass * 1.0 / n, 4) AS strict, round((n_pass + n_minor) * 1.0 / n, 4) AS lenient, {_wilson("(n_pass + n_minor)", "n")} FROM g""",
    "overall_by_stratum": f"""WITH {_VERDICTS}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (quality_ok = 'Pass' AND toxic_ok = 'Pass' AND length_ok = 'Pass') AS n_strict,
          count(*) FILTER (quality_ok IN ('Pass', 'Minor') AND toxic_ok IN ('Pass', 'Minor') AND length_ok IN ('Pass', 'Minor')) AS n_lenient FROM v GROUP BY 1)
        SELECT *, round(n_strict * 1.0 / n, 4) AS strict, round(n_lenient * 1.0 / n, 4) AS lenient, {_wilson("n_lenient", "n")} FROM g""",
    "quality_ladder": f"WITH {_VERDICTS} SELECT source, {_LADDER} AS tag, count(*) AS n FROM v GROUP BY 1, 2",
    "wilson_intervals": f"WITH g AS (SELECT CAST(doc_id % 10 AS INTEGER) AS bucket, count(*) AS n, CAST(sum(quality) AS BIGINT) AS k FROM labels GROUP BY 1) SELECT *, {_wilson('k', 'n')} FROM g",
    "response_parse": "SELECT event_id, 'Pass' AS correct_section, 'Fail' AS notes, CASE WHEN event_id % 3 = 0 THEN 'Minor' ELSE '?' END AS content_quality, 'a:b' AS end_boundary, CAST(NULL AS VARCHAR) AS completeness FROM events",
    "era_labels": "SELECT CASE WHEN y BETWEEN 2010 AND 2012 THEN '2010-2012' WHEN y BETWEEN 2013 AND 2015 THEN '2013-2015' WHEN y BETWEEN 2016 AND 2018 THEN '2016-2018' WHEN y BETWEEN 2019 AND 2021 THEN '2019-2021' WHEN y BETWEEN 2022 AND 2024 THEN '2022-2024' END AS era, count(*) AS n FROM (SELECT year(o_orderdate) + 15 AS y FROM orders) GROUP BY 1",
    "word_counts": f"SELECT doc_id, CAST(coalesce({_words('text')}, 0) AS INTEGER) AS words, CAST(length(replace(text, chr(10), ' ')) AS INTEGER) AS chars FROM documents",
    "repeated_short_lines": "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) SELECT doc_id, line, count(*) AS n FROM l WHERE line <> '' AND len(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> '')) <= 8 GROUP BY 1, 2 HAVING count(*) >= 4",
    "tone_ratio": f"""WITH {_DICTIONARY}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents),
        g AS (SELECT d.doc_id, count(t.word) AS n_tokens, {", ".join(f"count(*) FILTER (category = '{c}') AS n_{c}" for c in ("negative", "positive", "uncertainty", "litigious"))}
          FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN dict USING (word) GROUP BY 1)
        SELECT doc_id, n_tokens, {", ".join(f"CASE WHEN n_tokens > 0 THEN round(100.0 * n_{c} / n_tokens, 4) END AS {c}_pct" for c in ("negative", "positive", "uncertainty", "litigious"))},
        CASE WHEN n_tokens > 0 THEN round(100.0 * (n_negative + n_uncertainty + n_litigious) / n_tokens, 4) END AS risk_density,
        CASE WHEN n_positive + n_negative > 0 THEN round((n_positive - n_negative) * 1.0 / (n_positive + n_negative), 4) END AS net_tone FROM g""",
    "tfidf_yoy_cosine": """WITH d AS (SELECT source || '-' || lang AS ticker, CAST(row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS INTEGER) AS fiscal_year, text FROM documents),
        tf AS (SELECT ticker, fiscal_year, term, count(*) AS tf FROM (SELECT ticker, fiscal_year, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM d) GROUP BY 1, 2, 3),
        k AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) * 1.0 / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1 HAVING count(DISTINCT ticker) >= 5 AND count(*) <= 0.95 * (SELECT count(*) FROM d)),
        w AS (SELECT ticker, fiscal_year, term, tf * idf AS w FROM tf JOIN k USING (term)),
        u AS (SELECT ticker, fiscal_year, term, w / sqrt(sum(w * w) OVER (PARTITION BY ticker, fiscal_year)) AS w FROM w),
        own AS (SELECT DISTINCT ticker, fiscal_year FROM u),
        p AS (SELECT a.ticker, a.fiscal_year FROM own a JOIN own b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year + 1),
        s AS (SELECT a.ticker, a.fiscal_year, sum(a.w * b.w) AS sim FROM u a JOIN u b ON a.ticker = b.ticker AND a.fiscal_year = b.fiscal_year + 1 AND a.term = b.term GROUP BY 1, 2)
        SELECT p.ticker, p.fiscal_year, round(coalesce(sim, 0.0), 4) AS similarity, round(1 - coalesce(sim, 0.0), 4) AS delta FROM p LEFT JOIN s ON p.ticker = s.ticker AND p.fiscal_year = s.fiscal_year""",
    "divergence": f"""WITH {_PANEL}, {_growth('panel')}, c AS (SELECT ticker, fiscal_year, leverage - lag(leverage) OVER w AS dl, roa - lag(roa) OVER w AS dr FROM grown WINDOW w AS (PARTITION BY ticker ORDER BY year_end))
        SELECT ticker, fiscal_year, CASE WHEN sign(dl) = sign(dr) THEN 0 ELSE 1 END AS sign_differs, round(dl - (SELECT regr_slope(dl, dr) FROM c) * dr, 4) + 0.0 AS divergence FROM c""",
    "quartile_sort": f"""WITH {_PANEL}, {_growth('panel')}, q AS (SELECT *, CAST(ntile(4) OVER (PARTITION BY fiscal_year ORDER BY leverage, ticker) AS INTEGER) AS quartile FROM grown WHERE leverage IS NOT NULL)
        SELECT quartile, count(*) AS n, round(avg(leverage), 4) AS mean_x, round(avg(roa), 4) AS mean_y FROM q GROUP BY 1""",
    "q4_reliability": """WITH q AS (SELECT o_custkey AS t, year(o_orderdate) AS y, quarter(o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2, 3),
        w AS (SELECT t, y, sum(CASE WHEN p = 4 AND t % 2 = 0 THEN v * 1.5 ELSE v END) AS fy, max(CASE WHEN p = 1 THEN v END) AS q1, max(CASE WHEN p = 2 THEN v END) AS q2, max(CASE WHEN p = 3 THEN v END) AS q3, max(CASE WHEN p = 4 THEN v END) AS q4 FROM q GROUP BY 1, 2),
        b AS (SELECT *, fy - q1 - q2 - q3 AS implied FROM w WHERE fy - q1 - q2 - q3 IS NOT NULL AND q4 IS NOT NULL)
        SELECT 'price' AS metric, count(*) AS n, count(*) FILTER (abs(implied - q4) <= 0.01 * abs(q4)) AS n_match, round(avg(CASE WHEN abs(implied - q4) <= 0.01 * abs(q4) THEN 1.0 ELSE 0.0 END), 4) AS match_rate FROM b""",
}
