"""Long facts into one wide record for each entity and period end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerloom.config import FLOWS, METRICS, TAGS, Settings
from ledgerloom.functions import columns as P
from ledgerloom.operators.filters import valid_facts
from ledgerloom.operators.panel import tail_periods


def tag_table(spark, tags: Sequence[tuple[str, str, int]] = TAGS) -> DataFrame:
    """tag, metric, priority, tag_seq (order of configuration), is_flow."""
    rows = [(t, m, p, i, m in FLOWS) for i, (t, m, p) in enumerate(tags)]
    return spark.createDataFrame(rows, "tag string, metric string, priority int, tag_seq int, is_flow boolean")


def amendments_first(facts: DataFrame, period: Sequence[str] = ("ticker", "end_d"), amended: str = "is_amend") -> DataFrame:
    """a period with any amended fact keeps only amended facts."""
    return facts.withColumn("__any", F.max(amended).over(Window.partitionBy(*period))).filter(F.col(amended) == F.col("__any")).drop("__any")


def winners(facts: DataFrame, period: Sequence[str], metric: str, priority: str, filed: str, scan: Sequence[str]) -> DataFrame:
    """For each period and metric the fact of the lowest priority, then the latest filed, then the first in scan order."""
    w = Window.partitionBy(*period, metric).orderBy(F.col(priority), F.col(filed).desc(), *scan)
    return facts.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def annual_records(facts: DataFrame, companies: DataFrame, settings: Settings = Settings(), metrics: Sequence[str] = METRICS) -> DataFrame:
    """C3 over all firms in one plan: J7, F3 to F6, A7 to A9, P1, P2, F7, F8.

    facts: ticker, tag, unit_rank, pos, start, end, filed, form, val, accn (long);
    companies: ticker, company_name, fiscal_year_end. The value of a period is an
    aggregate, so one shuffle by (ticker, end) gives the record.
    """
    spark = facts.sparkSession
    tagged = facts.join(F.broadcast(tag_table(spark, settings.tags)), "tag")  # a configuration of a few rows
    good = valid_facts(tagged, settings).withColumn("is_amend", F.col("form").endswith("/A"))
    good = good.withColumn("val", P.no_nan(F.col("val").cast("double")))
    kept = amendments_first(good)
    # Scan order: configured tag, unit, position in the array.
    scan = F.struct("tag_seq", "unit_rank", "pos")
    kept = kept.withColumn("scan", scan)
    won = winners(kept, ("ticker", "end_d"), "metric", "priority", "filed_d", ("scan",))
    period = kept.groupBy("ticker", "end_d").agg(F.min("filed_d").alias("filing_date"), F.max("is_amend").alias("amended"))
    wide = won.groupBy("ticker", "end_d").agg(
        F.max_by("accn", "scan").alias("accession_number"),
        *(F.max(F.when(F.col("metric") == m, F.col("val"))).alias(m) for m in metrics),
        *(F.max(F.when(F.col("metric") == m, F.col("tag"))).alias(f"_tag_{m}") for m in metrics),
    )
    out = wide.join(period, ["ticker", "end_d"]).withColumnRenamed("end_d", "year_end")
    out = out.join(companies.select("ticker", "company_name", "fiscal_year_end"), "ticker")
    out = out.withColumns({"fiscal_year": P.fiscal_year("year_end", "fiscal_year_end"), "form_type": P.form_type("amended")}).drop("amended", "fiscal_year_end")
    return tail_periods(out, settings.years, settings.min_years)
