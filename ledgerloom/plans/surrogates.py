"""Relations over the driver tables that stand in for the domain's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str, year_ends: bool = True) -> DataFrame:
    """Customer years: ticker, fiscal_year, year_end, filing_date, total_assets, total_liabilities, equity, net_income, current.

    year_end is the year's last day, or with year_ends=False the last order's.
    The orders of a year are aggregated before they meet anything else.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), F.to_date("o_orderdate").alias("day"))
    gross, net, disc = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice") * F.col("l_discount")
    # One row for each order before the join: lines are many, orders few.
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(gross).alias("ta"), F.sum(F.when(F.col("l_linestatus") == "F", net)).alias("tl"), F.sum(F.when(F.col("l_linestatus") == "O", net)).alias("eq"),
        F.sum(F.when(F.col("l_returnflag") == "R", disc)).alias("ni"), F.sum(F.when(F.col("l_returnflag") == "N", gross)).alias("cur"),
    )
    out = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("ticker", "fiscal_year").agg(
        F.max("day").alias("filing_date"), F.sum("ta").alias("total_assets"), F.sum("tl").alias("total_liabilities"), F.sum("eq").alias("equity"), F.sum("ni").alias("net_income"), F.sum("cur").alias("current")
    )
    end = F.make_date("fiscal_year", F.lit(12), F.lit(31)) if year_ends else F.col("filing_date")
    return out.withColumn("year_end", end)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts: ticker (part), period (year), tag, priority, filed, is_amend, val, accn, seq."""
    tag = F.col("l_returnflag")
    priority = F.when(tag == "N", 1).when(tag == "R", 2).otherwise(3)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("ticker"), F.year("l_shipdate").alias("period"), tag.alias("tag"), priority.alias("priority"), F.to_date("l_shipdate").alias("filed"),
        (F.col("l_linestatus") == "O").alias("is_amend"), F.col("l_extendedprice").alias("val"), F.col("l_orderkey").alias("accn"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("scan"),
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as audited sections: doc_id, source, lang, and three criteria."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.select(
        "doc_id", "source", "lang", F.when(F.col("quality") == 1, "Pass").otherwise("Fail").alias("quality_ok"),
        F.when(F.col("toxic") == 0, "Pass").otherwise("Minor").alias("toxic_ok"),
        F.when(F.col("n_chars") > 500, "Pass").when(F.col("n_chars") > 200, "Minor").when(F.col("n_chars") > 50, "Fail").otherwise("?").alias("length_ok"),
    )
