"""Fixed values of the domain, as frozen parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Source tags with their metric and priority (1 is preferred), in order of precedence lists.
TAGS: tuple[tuple[str, str, int], ...] = (
    ("Assets", "total_assets", 1),
    ("AssetsCurrent", "assets_current", 1),
    ("Liabilities", "total_liabilities", 1),
    ("LiabilitiesCurrent", "liabilities_current", 1),
    ("StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "stockholders_equity", 1),
    ("StockholdersEquity", "stockholders_equity", 2),
    ("NetIncomeLoss", "net_income", 1),
    ("ProfitLoss", "net_income", 2),
    ("IncomeLossFromContinuingOperations", "net_income", 3),
    ("OperatingIncomeLoss", "operating_income", 1),
    ("NetCashProvidedByUsedInOperatingActivities", "operating_cash_flow", 1),
    ("NetCashProvidedByUsedInOperatingActivitiesContinuingOperations", "operating_cash_flow", 2),
)
FLOWS = ("net_income", "operating_income", "operating_cash_flow")
# Tags that may be mixed within a firm.
EQUIVALENT = {
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
}
# Unit keys whose facts are read, in order.
UNITS = ("USD", "iso4217:USD", "usd", "USD/shares", "iso4217:USD/shares")
METRICS = tuple(dict.fromkeys(m for _, m, _ in TAGS))
# Columns of the finished panel, in order.
PANEL_COLUMNS = (
    "ticker", "company_name", "sic", "fiscal_year_end", "year_end", "filing_date", "fiscal_year", "accession_number", "form_type",
    "net_income", "total_assets", "total_liabilities", "operating_income", "operating_cash_flow", "return_next_year", "vol_next_year",
    "lagged_vol", "log_total_assets", "leverage", "roa", "asset_growth", "current_ratio", "ocf_to_assets",
)
RATIOS = ("leverage", "roa", "asset_growth", "current_ratio", "ocf_to_assets")
REGRESSION_COLUMNS = ("ticker", "sic2", "fiscal_year", "vol_next_year", "lagged_vol", "log_total_assets", "leverage", "roa", "asset_growth")
ERAS = ((2010, 2012), (2013, 2015), (2016, 2018), (2019, 2021), (2022, 2024))
CRITERIA = ("correct_section", "start_boundary", "end_boundary", "content_quality", "completeness")
SCORES = ("Pass", "Minor", "Fail")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the panel build; robustness variants replace single ones."""

    sample_size: int | None = 1000
    excluded_sic: tuple[int, int] = (6000, 7000)
    forms: tuple[str, ...] = ("10-K", "10-K/A")
    flow_days: tuple[int, int] = (350, 380)
    instant_days: int = 5
    filing_lag: int = 180
    years: int = 17
    min_years: int = 5
    gap_days: tuple[int, int] = (300, 400)
    last_year: int = 2024
    lag_days: int = 2
    window_days: int = 365
    min_observations: int = 200
    coverage: float = 0.90
    winsor: tuple[float, float] = (0.01, 0.99)
    fill_limit: int = 1
    tags: tuple[tuple[str, str, int], ...] = field(default=TAGS)
