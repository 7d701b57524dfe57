"""The ladder of text models and the robustness battery around its last step."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import columns as P
from ledgerloom.operators import regression
from ledgerloom.operators.text_features import divergence

# The regressors of the models, in order; each model adds its own to those before.
MODELS = (
    ("Baseline-min", ("lagged_vol",)),
    ("Baseline-financial", ("log_total_assets", "leverage", "roa", "asset_growth")),
    ("Text-dictionary", ("d_lm_net_tone", "d_lm_uncertainty", "d_lm_risk_density", "delta_text_1a", "delta_text_7", "rf_turnover")),
    ("Text-FinBERT", ("d_finbert_net",)),
    ("Divergence", ("divergence",)),
)
CONTROLS = MODELS[0][1] + MODELS[1][1]
# Industry codes of technology firms, and the year that parts the subsamples.
TECH, YEAR = "(sic between 7370 and 7379 or sic = 3674)", 2020


@dataclass(frozen=True)
class Variant:
    """One regression: its dependent variable, the coefficient to report, other regressors, effects, rows (SQL) and panel (a key of the panels)."""

    name: str
    y: str = "vol_next_year"
    of: str = "divergence"
    xs: tuple[str, ...] = CONTROLS
    effects: tuple[str, ...] = ("sic2", "fiscal_year")
    where: str = "true"
    panel: str = "base"


#: X9. Panels other than base are built with the settings of build_panel.VARIANTS. Rows without sic are in neither subsample of it.
BATTERY = (
    Variant("Base"),
    Variant("63-day window", panel="window_63"),
    Variant("180-day window", panel="window_180"),
    Variant("Return after filing", y="return_next_year"),
    Variant("Signs differ", of="sign_differs"),
    Variant("Divergence from cash flow", of="divergence_ocf"),
    Variant("Dictionary tone", xs=(*CONTROLS, "d_lm_net_tone")),
    Variant("Model tone", xs=(*CONTROLS, "d_finbert_net")),
    Variant("Both tones", xs=(*CONTROLS, "d_lm_net_tone", "d_finbert_net")),
    Variant("Before 2020", where=f"fiscal_year < {YEAR}"),
    Variant("From 2020", where=f"fiscal_year >= {YEAR}"),
    Variant("Technology", where=TECH),
    Variant("Other industries", where=f"not {TECH}"),
    Variant("At least 8 years", panel="min_8_years"),
    Variant("Winsorized at 2.5 %", panel="winsor_2.5"),
    Variant("Firm effects", effects=("ticker", "fiscal_year")),
)


def ladders(models: Sequence[tuple[str, Sequence[str]]] = MODELS) -> list[tuple[str, ...]]:
    """The regressors of each model, with those of the models before."""
    return [tuple(x for _, own in models[: k + 1] for x in own) for k in range(len(models))]


def with_divergences(df: DataFrame, d_tone: str = "d_lm_net_tone", d_roa: str = "d_roa", d_ocf: str = "d_ocf_to_assets") -> DataFrame:
    """The panel with divergence, sign_differs and divergence_ocf, which takes the change in cash flow for that in results."""
    by_ocf = divergence(df, d_tone, d_ocf).withColumnRenamed("divergence", "divergence_ocf").drop("sign_differs")
    return divergence(by_ocf, d_tone, d_roa)


def compare_models(df: DataFrame, y: str = "vol_next_year", models: Sequence[tuple[str, Sequence[str]]] = MODELS, **options) -> DataFrame:
    """Regression.ladder_table() of the models over the rows that are complete for all."""
    return regression.ladder_table(df.sparkSession, regression.nested(_with_sic2(df), y, ladders(models), **options), [n for n, _ in models])


def battery(panels: Mapping[str, DataFrame], variants: Sequence[Variant] = BATTERY, **options) -> DataFrame:
    """Position, variant, variable, nobs, coef, se, t, p, adj_r2 of each variant; every panel that they name must be given.

    A subsample that is too small or collinear for its model has NULLs; nobs are its complete rows.
    """
    if lacking := sorted({v.panel for v in variants} - set(panels)):
        raise ValueError(f"panels not given: {', '.join(lacking)}")
    rows = []
    for k, v in enumerate(variants):
        df = _with_sic2(panels[v.panel]).filter(F.expr(v.where))
        n = df.dropna(subset=[v.y, v.of, *v.xs, *v.effects, options.get("cluster", "ticker")]).count()
        got: tuple = (None,) * 5
        if n:
            try:
                f = regression.fit(df, v.y, (v.of, *v.xs), v.effects, **options)
                got = tuple(map(float, (f.params[0], f.se[0], f.tstats[0], f.pvalues[0], f.rsquared_adj)))
            except (np.linalg.LinAlgError, ZeroDivisionError):
                pass  # singular, or no degree of freedom is left
        rows.append((k + 1, v.name, v.of, n, *got))
    spark = next(iter(panels.values())).sparkSession
    return spark.createDataFrame(rows, "position int, variant string, variable string, nobs long, coef double, se double, t double, p double, adj_r2 double")


def _with_sic2(df: DataFrame) -> DataFrame:
    return df if "sic2" in df.columns else df.withColumn("sic2", P.sic2("sic"))
