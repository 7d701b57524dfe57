"""Panel cleaning: C1, C2, C4, imputation, ratios, lags and coverage.

Every operator is DataFrame -> DataFrame with column names as parameters. All
windows partition by the entity alone, so a chain of them takes one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import EQUIVALENT, RATIOS, TAGS
from ledgerloom.functions import columns as P
from ledgerloom.operators.quantiles import exact_quantiles


def _by(entity: str, *order: str | Column) -> Window:
    return Window.partitionBy(entity).orderBy(*order)


def days_since_previous(entity: str = "ticker", end: str = "year_end") -> Column:
    """W3"""
    return F.datediff(end, F.lag(end).over(_by(entity, end)))


def resolve_duplicates(df: DataFrame, entity: str = "ticker", end: str = "year_end", filed: str = "filing_date", income: str = "net_income") -> DataFrame:
    """of rows that share (entity, filing date) the best one: net income present, then a gap close to a year, then the earlier end.

    An entity's first row has no gap and loses to any sibling with one.
    """
    score = F.col("__has") * 10000 - F.abs(F.col("__gap") - 365)
    scored = df.withColumn("__gap", days_since_previous(entity, end)).withColumn("__has", F.col(income).isNotNull().cast("int"))
    same = Window.partitionBy(entity, filed).orderBy(score.desc_nulls_last(), F.col(end))
    return scored.withColumn("__rn", F.row_number().over(same)).filter(F.col(filed).isNull() | (F.col("__rn") == 1)).drop("__gap", "__has", "__rn")


def drop_transitions(df: DataFrame, entity: str = "ticker", end: str = "year_end", low: int = 300, high: int = 400) -> DataFrame:
    """rows less than 300 or more than 400 days after their predecessor go; gaps are taken once."""
    gapped = df.withColumn("__gap", days_since_previous(entity, end))
    return gapped.filter(F.coalesce(F.col("__gap").between(low, high), F.lit(True))).drop("__gap")


def filter_transitions_and_duplicates(df: DataFrame, entity: str = "ticker", end: str = "year_end", filed: str = "filing_date", income: str = "net_income") -> DataFrame:
    """F9, F10, P13."""
    out = drop_transitions(resolve_duplicates(df, entity, end, filed, income), entity, end)
    return out.select(*P.without_helpers(out.columns))


def dominant(df: DataFrame, entity: str, tag: str) -> DataFrame:
    """A1 to A3: (entity, tag) with each entity's most frequent tag, the smallest of equals."""
    counts = df.filter(F.col(tag).isNotNull()).groupBy(entity, tag).agg(F.count("*").alias("__n"))
    best = F.min_by(tag, F.struct(-F.col("__n"), F.col(tag)))
    return counts.groupBy(entity).agg(best.alias(tag))


def lock_tags(df: DataFrame, entity: str = "ticker", tags: Sequence[tuple[str, str, int]] = TAGS, equivalent: dict[str, Sequence[str]] = EQUIVALENT) -> DataFrame:
    """For metrics with several tags, values of other tags than the entity's dominant one become NULL, unless both are equivalent.

    All metrics' dominant tags come from one aggregate, which one join brings back.
    """
    metrics = [m for m in dict.fromkeys(m for _, m, _ in tags) if sum(x == m for _, x, _ in tags) > 1 and f"_tag_{m}" in df.columns]
    if not metrics:
        return df
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_tag_{m}").alias("tag")) for m in metrics))).alias("x")
    long = df.select(entity, pairs).select(entity, "x.metric", "x.tag").filter("tag is not null")
    counts = long.groupBy(entity, "metric", "tag").agg(F.count("*").alias("n"))
    top = counts.groupBy(entity, "metric").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("tag"))
    locked = top.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("metric", "tag"))).alias("__locked"))  # one entry a metric
    out = df.join(locked, entity, "left")
    for m in metrics:
        own, lock = F.col(f"_tag_{m}"), F.col("__locked")[m]
        group = list(equivalent.get(m, ()))
        fits = own.eqNullSafe(lock) | (own.isin(group) & lock.isin(group)) if group else own.eqNullSafe(lock)
        keep = F.coalesce(fits, F.lit(False))
        out = out.withColumns({m: F.when(keep, F.col(m)), f"_tag_{m}": F.when(keep, own)})
    return out.drop("__locked")


def tag_provenance(df: DataFrame, entity: str = "ticker", metrics: Sequence[str] = ()) -> DataFrame:
    """K5, A3: (entity, metric, locked_tag) after locking."""
    metrics = metrics or [c.removeprefix("_tag_") for c in df.columns if c.startswith("_tag_")]
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"_tag_{m}").alias("tag")) for m in metrics))).alias("x")
    counts = df.select(entity, pairs).select(entity, "x.metric", "x.tag").filter("tag is not null").groupBy(entity, "metric", "tag").agg(F.count("*").alias("n"))
    return counts.groupBy(entity, "metric").agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("locked_tag"))


def tag_distribution(provenance: DataFrame, tags: Sequence[tuple[str, str, int]] = TAGS) -> DataFrame:
    """A4: firms and their share in percent for each configured tag, 0 where no firm has it."""
    spark = provenance.sparkSession
    listed = spark.createDataFrame([(m, t) for t, m, _ in tags], "metric string, locked_tag string")
    counts = provenance.groupBy("metric", "locked_tag").agg(F.count("*").alias("firms"))
    out = listed.join(counts, ["metric", "locked_tag"], "left").fillna(0, ["firms"])
    total = F.sum("firms").over(Window.partitionBy("metric"))
    return out.withColumn("percent", F.when(total > 0, 100.0 * F.col("firms") / total).otherwise(0.0))


def fill_limited(df: DataFrame, columns: Sequence[str], entity: str = "ticker", order: str = "year_end", limit: int = 1) -> DataFrame:
    """Forward fill of at most ``limit`` rows, then backward fill of the result."""
    back = _by(entity, order).rowsBetween(-limit, 0)
    ahead = _by(entity, order).rowsBetween(0, limit)
    out = df.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns})
    return out.withColumns({c: F.first(c, ignorenulls=True).over(ahead) for c in columns})


def add_ratios(df: DataFrame, entity: str = "ticker", end: str = "year_end") -> DataFrame:
    """P5 to P10 over the panel's metric columns; metrics without data are NULL columns."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")
    ta = F.col("total_assets")
    w = _by(entity, end)
    return df.withColumns({
        "log_total_assets": P.safe_log(ta),
        "leverage": P.ratio(have("total_liabilities"), ta),
        "roa": P.ratio(have("net_income"), ta),
        "asset_growth": P.guarded_growth(ta, F.lag(ta).over(w), days_since_previous(entity, end)),
        "current_ratio": P.ratio(have("assets_current"), have("liabilities_current")),
        "ocf_to_assets": P.ratio(have("operating_cash_flow"), ta),
    })


def add_lag(df: DataFrame, value: str = "vol_next_year", name: str = "lagged_vol", entity: str = "ticker", end: str = "year_end") -> DataFrame:
    """The previous row's value, however far away."""
    return df.withColumn(name, F.lag(value).over(_by(entity, end)))


def add_changes(df: DataFrame, columns: Sequence[str], entity: str = "ticker", end: str = "year_end", prefix: str = "d_") -> DataFrame:
    """Differences to the previous row."""
    w = _by(entity, end)
    return df.withColumns({f"{prefix}{c}": F.col(c) - F.lag(c).over(w) for c in columns})


def drop_earliest(df: DataFrame, entity: str = "ticker", end: str = "year_end") -> DataFrame:
    """F11"""
    first = F.min(end).over(Window.partitionBy(entity))
    return df.withColumn("__first", first).filter(F.col(end) > F.col("__first")).drop("__first")


def cap_period(df: DataFrame, last: int, year: str = "fiscal_year") -> DataFrame:
    """F12"""
    return df.filter(F.col(year) <= last)


def drop_low_coverage(df: DataFrame, value: str = "vol_next_year", share: float = 0.90, entity: str = "ticker") -> DataFrame:
    """entities with the value in at least that share of their rows."""
    w = Window.partitionBy(entity)
    return df.withColumn("__share", F.count(value).over(w) / F.count("*").over(w)).filter(F.col("__share") >= share).drop("__share")


def tail_periods(df: DataFrame, n: int = 17, least: int = 5, entity: str = "ticker", end: str = "year_end") -> DataFrame:
    """Each entity's last n periods, if there are at least ``least`` of them."""
    last = df.withColumn("__rn", F.row_number().over(_by(entity, F.col(end).desc()))).filter(F.col("__rn") <= n)
    return last.withColumn("__n", F.count("*").over(Window.partitionBy(entity))).filter(F.col("__n") >= least).drop("__rn", "__n")


def winsorize(df: DataFrame, columns: Sequence[str] = RATIOS, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """C4: clips at exact pooled quantiles of all rows; NULL stays NULL.

    One aggregate over the selected columns gives all bounds, one row that is
    broadcast back. Exact percentiles keep a count for each distinct value in one
    task: for columns beyond that use winsorize_sorted, which has the same bounds.
    """
    bounds = df.agg(*(F.percentile(c, [low, high]).alias(f"__{c}") for c in columns))
    wide = df.crossJoin(F.broadcast(bounds))  # one row
    return wide.withColumns({c: P.clip(c, F.col(f"__{c}")[0], F.col(f"__{c}")[1]) for c in columns}).drop(*(f"__{c}" for c in columns))


def winsorize_sorted(df: DataFrame, columns: Sequence[str] = RATIOS, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """C4 for columns with any number of distinct values; the same bounds as winsorize."""
    bounds = exact_quantiles(df, columns, [low, high])
    return df.withColumns({c: P.clip(c, F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items() if lo is not None})


def census(df: DataFrame, columns: Sequence[str], entity: str = "ticker") -> DataFrame:
    """One row with rows, entities and missing values of each column."""
    return df.agg(F.count("*").alias("rows"), F.countDistinct(entity).alias("entities"), *(F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns))


class StageTracker:
    """The census of each stage and the change from the one before."""

    def __init__(self, columns: Sequence[str], entity: str = "ticker") -> None:
        self.columns, self.entity, self.rows = columns, entity, []

    def track(self, df: DataFrame, stage: str) -> DataFrame:
        own = [c for c in self.columns if c in df.columns]
        self.rows.append({"stage": stage} | census(df, own, self.entity).first().asDict())
        return df

    def table(self, spark) -> DataFrame:
        keys = ["rows", "entities", *(f"missing_{c}" for c in self.columns)]
        out, last = [], {}
        for r in self.rows:
            out.append((r["stage"], *(r.get(k) for k in keys), *(r[k] - last[k] if r.get(k) is not None and last.get(k) is not None else None for k in keys)))
            last = r
        return spark.createDataFrame(out, "stage string, " + ", ".join([*(f"{k} long" for k in keys), *(f"d_{k} long" for k in keys)]))
