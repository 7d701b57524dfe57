"""V1: stratified samples without random state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A draw that is the same on every engine: md5 of seed and key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def stratified(df: DataFrame, strata: Sequence[str], n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows of each stratum, by the smallest draws; ties by key.

    Spark limits each task to n rows of a stratum before the shuffle.
    """
    order = [draw(F.concat_ws("|", *key), seed), *(F.col(k) for k in key)]
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).filter(F.col("__rn") <= n).drop("__rn")


def section_sample(filings: DataFrame, sections: Sequence[str] = ("item_1a", "item_7"), n: int = 100, seed: int = 42, strata: int = 5) -> DataFrame:
    """For each section max(1, n / 5) filings of each era, with independent draws; rank is the order after the final shuffle."""
    from functools import reduce

    from ledgerloom.functions.columns import era

    own = filings.withColumn("era", era("fiscal_year")).filter("era is not null")
    parts = [stratified(own, ["era"], max(1, n // strata), ["ticker", "fiscal_year"], seed + 1000 * i).withColumn("section", F.lit(s)) for i, s in enumerate(sections)]
    united = reduce(DataFrame.unionByName, parts)
    key = F.concat_ws("|", "section", "ticker", "fiscal_year")
    return united.withColumn("rank", F.row_number().over(Window.orderBy(draw(key, seed), "section", "ticker", "fiscal_year")))  # a sample of n rows a section
