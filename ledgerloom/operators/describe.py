"""Summary statistics and correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.statistics import pearson_p
from ledgerloom.operators.quantiles import exact_quantiles


_SHARES = [0.25, 0.5, 0.75]


def describe(df: DataFrame, columns: Sequence[str], any_size: bool = False) -> DataFrame:
    """A row for each column: n, mean, std, p25, p50, p75; one pass over the selected columns.

    Exact percentiles keep a count for each distinct value in one task; with
    ``any_size`` narrowing brackets find them instead, in a few more passes.
    """
    found = exact_quantiles(df, columns, _SHARES) if any_size else None
    aggs = []
    for c in columns:
        p = F.array(*(F.lit(x).cast("double") for x in found[c])) if found else F.percentile(c, _SHARES)
        aggs.append(F.struct(F.lit(c).alias("variable"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), p.alias("p")).alias(f"__{c}"))
    one = df.select(*columns).agg(*aggs).select(F.explode(F.array(*(f"__{c}" for c in columns))).alias("x"))
    return one.select("x.variable", "x.n", "x.mean", "x.std", *(F.col("x.p")[k].alias(f"p{round(100 * s)}") for k, s in enumerate(_SHARES)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable, other, r, n of each pair (lower triangle) over complete cases, from one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    complete = df.select(*columns).dropna()
    one = complete.agg(F.count("*").alias("n"), *(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("variable"), F.lit(b).alias("other"), F.col(f"r{k}").alias("r"), F.col("n")) for k, (a, b) in enumerate(pairs))))
    return one.select(rows.alias("x")).select("x.*")


def correlations_with_p(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same with two-sided p values; len(columns)**2 / 2 numbers pass the driver."""
    rows = [(r.variable, r.other, r.r, r.n, pearson_p(r.r, r.n)) for r in correlations(df, columns).collect()]
    return df.sparkSession.createDataFrame(rows, "variable string, other string, r double, n long, p double")
