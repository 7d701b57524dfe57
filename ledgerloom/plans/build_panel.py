"""From facts, companies and prices to the annual panel, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.config import EQUIVALENT, PANEL_COLUMNS, Settings
from ledgerloom.operators import panel as ops
from ledgerloom.operators.eventwindow import window_returns
from ledgerloom.operators.facts import annual_records
from ledgerloom.operators.filters import company_metadata
from ledgerloom.functions import columns as P


def identity_columns(df: DataFrame) -> DataFrame:
    """P11 over the panel's columns."""
    return df.withColumn("total_liabilities", P.identity_fill("total_liabilities", "total_assets", "stockholders_equity"))


def clean_panel(records: DataFrame, prices: DataFrame, settings: Settings = Settings(), tracker: ops.StageTracker | None = None) -> DataFrame:
    """The cleaning order, which is part of the semantics: lock, duplicates and gaps, identity, fill, returns, ratios, lag, first row, last year, coverage, winsorize."""
    see = tracker.track if tracker else lambda df, _: df
    df = see(ops.lock_tags(records, tags=settings.tags, equivalent=EQUIVALENT), "locked")
    df = see(ops.filter_transitions_and_duplicates(df), "cleaned")
    df = see(ops.fill_limited(identity_columns(df), ["total_assets", "total_liabilities"], limit=settings.fill_limit), "imputed")
    df = see(window_returns(df, prices, lag_days=settings.lag_days, window_days=settings.window_days, min_observations=settings.min_observations), "returns")
    df = see(ops.add_lag(ops.add_ratios(df)), "ratios")
    df = ops.cap_period(ops.drop_earliest(df), settings.last_year)
    df = see(ops.drop_low_coverage(df, share=settings.coverage), "covered")
    return see(ops.winsorize(df, low=settings.winsor[0], high=settings.winsor[1]), "winsorized")


def build_panel(facts: DataFrame, submissions: DataFrame, universe: DataFrame, prices: DataFrame, settings: Settings = Settings(), tracker: ops.StageTracker | None = None) -> DataFrame:
    """facts: cik, tag, unit_rank, pos, start, end, filed, form, val, accn; submissions: cik and raw metadata; universe: rank, ticker, cik; prices: ticker, date, close."""
    top = universe if settings.sample_size is None else universe.filter(f"rank < {settings.sample_size}")
    meta = company_metadata(top.select("ticker", "cik").join(submissions, "cik"), settings)
    own = facts.join(meta.select("ticker", "cik"), "cik").drop("cik")
    records = annual_records(own, meta, settings).join(meta.select("ticker", "sic", "fiscal_year_end"), "ticker", "left")
    df = clean_panel(records, prices, settings, tracker)
    return df.select(*(c for c in PANEL_COLUMNS if c in df.columns))


#: The robustness variants of the build, by what they change; those of the models are in robustness.py.
VARIANTS = {
    "window_63": Settings(window_days=91, min_observations=40),
    "window_180": Settings(window_days=180, min_observations=100),
    "winsor_2.5": Settings(winsor=(0.025, 0.975)),
    "min_8_years": Settings(min_years=8),
}
