"""R2: least squares with absorbed effects and clustered standard errors.

Only sums pass the driver: counts and means of each pair of effects, the cross
products of the variables, and the scores' outer product. Spark adds up clusters
itself, so their number does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.statistics import f_tail, normal_tail


@dataclass
class Fit:
    """A fitted model; covariance is clustered without small-sample correction, p values are normal."""

    names: list[str]
    params: np.ndarray
    cov: np.ndarray
    nobs: int
    rss: float
    tss: float
    within_tss: float
    effects: int
    clusters: int

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    @property
    def tstats(self) -> np.ndarray:
        return self.params / self.se

    @property
    def pvalues(self) -> np.ndarray:
        return np.array([normal_tail(t) for t in self.tstats])

    @property
    def rsquared(self) -> float:
        return 1 - self.rss / self.tss

    @property
    def rsquared_adj(self) -> float:
        """Counts the absorbed effects as parameters."""
        return 1 - (1 - self.rsquared) * (self.nobs - 1) / (self.nobs - self.effects - len(self.names))

    @property
    def aic(self) -> float:
        return self.nobs * np.log(self.rss / self.nobs) + 2 * (self.effects + len(self.names))

    @property
    def bic(self) -> float:
        return self.nobs * np.log(self.rss / self.nobs) + np.log(self.nobs) * (self.effects + len(self.names))

    def joint_test(self, names: Sequence[str]) -> tuple[float, float]:
        """F statistic and p that the named coefficients are all 0, with the clustered covariance."""
        at = [self.names.index(n) for n in names]
        b, v = self.params[at], self.cov[np.ix_(at, at)]
        f = float(b @ np.linalg.solve(v, b)) / len(at)
        return f, f_tail(f, len(at), max(1, self.clusters - 1))

    def table(self, spark, model: str = "") -> DataFrame:
        rows = [(model, n, float(b), float(s), float(t), float(p)) for n, b, s, t, p in zip(self.names, self.params, self.se, self.tstats, self.pvalues)]
        return spark.createDataFrame(rows, "model string, variable string, coef double, se double, t double, p double")


def fit(df: DataFrame, y: str, xs: Sequence[str], effects: Sequence[str] = ("sic2", "fiscal_year"), cluster: str = "ticker", most_cells: int = 1_000_000) -> Fit:
    """One or two absorbed effects; rows with missing values are dropped, as are none else.

    most_cells bounds the pairs of effect levels that the driver solves for; the
    number of levels of the second effect, and of the first, must fit a dense
    matrix of their sum squared.
    """
    names = [y, *xs]
    used = df.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)), *(F.col(e).cast("string").alias(f"e{i}") for i, e in enumerate(effects)), F.col(cluster).cast("string").alias("cl")).dropna()
    e = [f"e{i}" for i in range(len(effects))]
    v = [f"v{i}" for i in range(len(names))]
    means = used.agg(F.count("*").alias("n"), F.approx_count_distinct("cl").alias("g"), *(F.avg(c).alias(c) for c in v)).first()
    n = means["n"]
    if not n:
        raise ValueError("no complete rows")
    # Centred first, so that sums of squares keep their digits.
    centred = used.select(*((F.col(c) - F.lit(means[c])).alias(c) for c in v), *e, "cl")
    sums = centred.groupBy(*e).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in v))
    cells = sums.limit(most_cells + 1).collect()
    if len(cells) > most_cells:
        raise ValueError(f"over {most_cells} pairs of effect levels")
    gram_row = centred.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(v) for b in v[i:])).first()
    gram = np.zeros((len(v), len(v)))
    for i, a in enumerate(v):
        for j, b in enumerate(v[i:], i):
            gram[i, j] = gram[j, i] = gram_row[f"{a}_{b}"]
    levels = [sorted({c[k] for c in cells}) for k in e]
    at = [{x: i for i, x in enumerate(own)} for own in levels]
    offset = np.cumsum([0, *(len(own) for own in levels)])
    z = np.zeros((offset[-1], offset[-1]))
    d = np.zeros((offset[-1], len(v)))
    for c in cells:
        own = [offset[i] + at[i][c[k]] for i, k in enumerate(e)]
        for i in own:
            d[i] += [c[k] for k in v]
            for j in own:
                z[i, j] += c["n"]
    coef = np.linalg.lstsq(z, d, rcond=None)[0]
    rank = int(np.linalg.matrix_rank(z))
    left = gram - d.T @ coef
    beta = np.linalg.solve(left[1:, 1:], left[1:, 0])
    rss = float(left[0, 0] - beta @ left[1:, 0])
    # Residuals in Spark: the cells' effects come back, one row a cell.
    spark = df.sparkSession
    fitted = spark.createDataFrame([(*(c[k] for k in e), *map(float, sum(coef[offset[i] + at[i][c[k]]] for i, k in enumerate(e)))) for c in cells], ", ".join([*(f"{k} string" for k in e), *(f"f{i} double" for i in range(len(v)))]))
    clean = centred.join(F.broadcast(fitted), e).select("cl", *((F.col(c) - F.col(f"f{i}")).alias(c) for i, c in enumerate(v)))  # at most most_cells rows
    resid = F.col(v[0]) - sum((float(b) * F.col(c) for b, c in zip(beta, v[1:])), F.lit(0.0))
    scored = clean.withColumn("u", resid).groupBy("cl").agg(*(F.sum(F.col(c) * F.col("u")).alias(c) for c in v[1:]))
    outer = scored.agg(F.count("*").alias("g"), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(v[1:]) for b in v[1 + i :])).first()
    meat = np.zeros((len(xs), len(xs)))
    for i, a in enumerate(v[1:]):
        for j, b in enumerate(v[1 + i :], i):
            meat[i, j] = meat[j, i] = outer[f"{a}_{b}"]
    bread = np.linalg.inv(left[1:, 1:])
    return Fit(list(xs), beta, bread @ meat @ bread, n, rss, float(gram[0, 0]), float(left[0, 0]), rank, outer["g"])


def nested(df: DataFrame, y: str = "vol_next_year", ladders: Sequence[Sequence[str]] = (("lagged_vol",), ("lagged_vol", "log_total_assets", "leverage"), ("lagged_vol", "log_total_assets", "leverage", "roa", "asset_growth")), **options) -> list[Fit]:
    """Models with growing sets of regressors over the same rows, those complete for all of them."""
    every = list(dict.fromkeys([y, *(x for xs in ladders for x in xs)]))
    complete = df.dropna(subset=every)
    return [fit(complete, y, xs, **options) for xs in ladders]


def ladder_table(spark, fits: Sequence[Fit], models: Sequence[str] | None = None) -> DataFrame:
    """A row for each model of a ladder: adjusted R2 and its gain over the model before, the joint F test of the regressors that it adds, AIC and BIC.

    Gains and tests are NULL in the first row and where a model adds nothing.
    Models must be fitted to the same rows, as nested() does.
    """
    rows = []
    for k, f in enumerate(fits):
        added = [n for n in f.names if k and n not in fits[k - 1].names]
        if k and f.nobs != fits[0].nobs:
            raise ValueError("the models have different rows")
        test = tuple(map(float, f.joint_test(added))) if added else (None, None)
        gain = float(f.rsquared_adj - fits[k - 1].rsquared_adj) if added else None
        rows.append((models[k] if models else f"({k + 1})", k + 1, int(f.nobs), float(f.rsquared_adj), gain, len(added), *test, float(f.aic), float(f.bic)))
    return spark.createDataFrame(rows, "model string, step int, nobs long, adj_r2 double, gain double, added int, f double, p double, aic double, bic double")


def within_one_way(df: DataFrame, y: str, x: str, effect: str) -> DataFrame:
    """R2 with one effect and one regressor, in one plan: (n, coef, effect_levels)."""
    used = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(effect).alias("e")).dropna()
    g = used.groupBy("e").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("c"), F.var_pop("x").alias("v"))
    den = F.sum(F.col("v") * F.col("n"))
    return g.agg(F.sum("n").alias("n"), F.when(den > 0, F.sum(F.col("c") * F.col("n")) / den).alias("coef"), F.count("*").alias("levels"))
