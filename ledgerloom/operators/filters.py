"""Row filters (F rows) that stand alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import REGRESSION_COLUMNS, Settings
from ledgerloom.functions import columns as P


def operating_only(df: DataFrame, entity_type: str = "entity_type") -> DataFrame:
    """F1"""
    return df.filter(F.col(entity_type) == "operating")


def outside_sic(df: DataFrame, low: int = 6000, high: int = 7000, sic: str = "sic") -> DataFrame:
    """drops low <= sic < high."""
    return df.filter(~((F.col(sic) >= low) & (F.col(sic) < high)))


def company_metadata(df: DataFrame, settings: Settings = Settings(), order: str | None = None) -> DataFrame:
    """F1, P3, F2, P4 over raw submissions; the last row of a repeated ticker wins (by ``order``, else any)."""
    out = operating_only(df).withColumn("sic", P.parse_sic(F.col("sic_raw")))
    out = outside_sic(out, *settings.excluded_sic).withColumn("fiscal_year_end", P.parse_fye_month("fiscal_year_end_raw"))
    out = out.filter(F.col("fiscal_year_end").isNotNull())
    keep = ["cik", "company_name", "fiscal_year_end", "sic"]
    if order is None:
        return out.select("ticker", *keep)
    return out.groupBy("ticker").agg(F.max_by(F.struct(*keep), order).alias("x")).select("ticker", "x.*")


def valid_facts(facts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """annual flows and instants, filed in time; adds typed dates start_d, end_d, filed_d.

    Flows need both dates and a length within the range; instants need an end,
    and a start, if one can be read, at most a few days before it.
    """
    dated = facts.withColumns({f"{c}_d": _date(facts, c) for c in ("start", "end", "filed")}).filter(F.col("form").isin(*settings.forms))
    days = F.datediff("end_d", "start_d")
    flow = F.coalesce(days.between(*settings.flow_days), F.lit(False))
    instant = F.col("end_d").isNotNull() & F.coalesce(days <= settings.instant_days, F.lit(True))
    in_time = F.coalesce(F.datediff("filed_d", "end_d") <= settings.filing_lag, F.lit(False))
    return dated.filter(F.when(F.col("is_flow"), flow).otherwise(instant) & in_time)


def _date(df: DataFrame, c: str) -> Column:
    return F.to_date(c) if dict(df.dtypes)[c] != "string" else F.try_to_date(F.col(c)) if hasattr(F, "try_to_date") else F.expr(f"try_cast(`{c}` as date)")


def complete_cases(df: DataFrame, columns: Sequence[str] = REGRESSION_COLUMNS) -> DataFrame:
    """NaN counts as missing, as NULL does."""
    return df.dropna(subset=list(columns))


def original_filings(df: DataFrame, keys: Sequence[str] = ("ticker", "accession_number", "fiscal_year")) -> DataFrame:
    """F16: distinct filings that are no amendments and have an accession number."""
    return df.filter((F.col("form_type") != "10-K/A") & F.col("accession_number").isNotNull()).select(*keys).distinct()


def one_of(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """F17"""
    return df.filter(F.col(column).isin(*values))


def resume(todo: DataFrame, done: DataFrame, keys: Sequence[str] = ("ticker", "fiscal_year")) -> DataFrame:
    """What is not done yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def keep_entities(df: DataFrame, kept: DataFrame, key: str = "ticker") -> DataFrame:
    """J5"""
    return df.join(kept.select(key).distinct(), key, "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order, by an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(*keys, "x.*").select(*df.columns)
