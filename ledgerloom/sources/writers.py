"""K rows: sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import PANEL_COLUMNS
from ledgerloom.operators.panel import tag_provenance


def save_panel(df: DataFrame, path: str, columns: Sequence[str] = PANEL_COLUMNS, fmt: str = "parquet") -> DataFrame:
    """K1: the panel's columns that exist, in order; returns one row with firms, rows and first and last period."""
    out = df.select(*(c for c in columns if c in df.columns))
    writer = out.write.mode("overwrite")
    writer.parquet(path) if fmt == "parquet" else writer.option("header", True).csv(path)
    written = df.sparkSession.read.parquet(path) if fmt == "parquet" else df.sparkSession.read.option("header", True).csv(path)
    return written.agg(F.countDistinct("ticker").alias("firms"), F.count("*").alias("rows"), F.min("year_end").alias("first"), F.max("year_end").alias("last"))


def save_raw(df: DataFrame, path: str) -> None:
    """K2"""
    df.write.mode("overwrite").parquet(path)


def append(df: DataFrame, path: str) -> None:
    """K3: a batch of finished rows; the unit of recovery is the batch."""
    df.write.mode("append").parquet(path)


def checkpointed(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """K4: appends rows whose keys are not there yet; returns what the path then holds, one row a key."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*keys)
    except Exception as e:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        done = None
    fresh = df.dropDuplicates(list(keys))
    append(fresh if done is None else fresh.join(done.distinct(), list(keys), "left_anti"), path)
    return spark.read.parquet(path).dropDuplicates(list(keys))


def save_provenance(df: DataFrame, path: str) -> None:
    """K5"""
    tag_provenance(df).write.mode("overwrite").parquet(path)


def new_sample(sample: DataFrame, path: str, results_path: str) -> None:
    """K7: a new sample replaces the old one and empties the results that belonged to it."""
    sample.write.mode("overwrite").parquet(path)
    spark = sample.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(results_path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
