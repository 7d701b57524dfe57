"""S rows: files on any file system that Spark reads, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import UNITS
from ledgerloom.functions import columns as P

FACT = "struct<start:string,end:string,filed:string,form:string,val:double,accn:string>"
FACTS_SCHEMA = f"cik string, facts struct<`us-gaap`:map<string,struct<units:map<string,array<{FACT}>>>>>"
FILINGS = "struct<accessionNumber:array<string>,primaryDocument:array<string>>"
SUBMISSIONS_SCHEMA = f"cik string, name string, entityType string, sic string, fiscalYearEnd string, filings struct<recent:{FILINGS},older:array<{FILINGS}>>"
AUDIT_SCHEMA = "ticker string, fiscal_year int, item_1a_status string, item_1a_wc int, item_1a_flags string, item_7_status string, item_7_wc int, item_7_flags string"
PRICE_SCHEMA = "ticker string, date date, close double"


def cik10(c):
    return F.lpad(c.cast("string"), 10, "0")


def universe(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """Rank, ticker, cik from a JSON object whose keys "0", "1", ... give the rank."""
    raw = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string,struct<cik_str:string,ticker:string,title:string>>")).alias("key", "row")
    out = raw.select(entries).select(F.col("key").cast("int").alias("rank"), F.upper("row.ticker").alias("ticker"), cik10(F.col("row.cik_str")).alias("cik"), F.col("row.title").alias("title"))
    return out if n is None else out.orderBy("rank").limit(n)


def first_cik(universe_df: DataFrame) -> DataFrame:
    """Ticker -> cik; the first of repeated tickers."""
    return universe_df.groupBy("ticker").agg(F.min_by("cik", "rank").alias("cik"))


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Cik, company_name, entity_type, sic_raw, fiscal_year_end_raw and filings; a missing file is a missing row."""
    raw = spark.read.schema(SUBMISSIONS_SCHEMA).json(path, multiLine=True)
    return raw.select(cik10(F.col("cik")).alias("cik"), F.col("name").alias("company_name"), F.col("entityType").alias("entity_type"), F.col("sic").alias("sic_raw"), F.col("fiscalYearEnd").alias("fiscal_year_end_raw"), "filings")


def company_facts(spark: SparkSession, path: str, units: tuple[str, ...] = UNITS) -> DataFrame:
    """Long facts (cik, tag, unit, unit_rank, pos, start, end, filed, form, val, accn) of the listed units, in order."""
    raw = spark.read.schema(FACTS_SCHEMA).json(path, multiLine=True)
    tags = raw.select(cik10(F.col("cik")).alias("cik"), F.explode(F.col("facts.us-gaap")).alias("tag", "t"))
    by_unit = tags.select("cik", "tag", F.explode("t.units").alias("unit", "facts")).filter(F.col("unit").isin(*units))
    long = by_unit.select("cik", "tag", "unit", (F.array_position(F.array(*map(F.lit, units)), F.col("unit")) - 1).cast("int").alias("unit_rank"), F.posexplode("facts").alias("pos", "f"))
    return long.select("cik", "tag", "unit", "unit_rank", "pos", "f.*").withColumn("val", P.no_nan("val"))


def prices(spark: SparkSession, path: str, start=None, end=None, fmt: str = "parquet") -> DataFrame:
    """Ticker, date, close without missing closes; the date range reaches the scan."""
    reader = spark.read.schema(PRICE_SCHEMA)
    df = reader.parquet(path) if fmt == "parquet" else reader.csv(path, header=True)
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end))
    return df.withColumn("close", P.no_nan("close")).filter("close is not null")


def price_range(filings: DataFrame, end: str = "year_end", filed: str = "filing_date", lag_days: int = 2, window_days: int = 365, slack: int = 10) -> DataFrame:
    """The days that the windows of a table of filings need, one row."""
    return filings.agg(F.min(end).alias("first"), F.date_add(F.max(filed), lag_days + window_days + slack).alias("last"))


def primary_documents(subs: DataFrame, include_older: bool = False) -> DataFrame:
    """Cik, accession_number, doc; of repeated accessions the last, older batches after the recent one."""
    batches = F.array(F.col("filings.recent"))
    if include_older:
        batches = F.concat(batches, F.coalesce(F.col("filings.older"), F.array().cast(f"array<{FILINGS}>")))
    each = subs.select("cik", F.posexplode(batches).alias("batch", "b"))
    rows = each.select("cik", "batch", F.posexplode(F.arrays_zip(F.col("b.accessionNumber").alias("accn"), F.col("b.primaryDocument").alias("doc"))).alias("pos", "z"))
    rows = rows.select("cik", "batch", "pos", F.col("z.accn").alias("accession_number"), F.col("z.doc").alias("doc")).filter("accession_number is not null")
    return rows.groupBy("cik", "accession_number").agg(F.max_by("doc", F.struct("batch", "pos")).alias("doc"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """Doc (file name) and html of each file below a path; accession_number, if its folder is named by one, with or without dashes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = r"/(\d{10})-?(\d{2})-?(\d{6})/[^/]+$"
    accession = F.when(F.col("path").rlike(folder), F.concat_ws("-", *(F.regexp_extract("path", folder, i) for i in (1, 2, 3))))
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("doc"), F.decode("content", "UTF-8").alias("html"), accession.alias("accession_number"))


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With quoted line breaks; types are inferred only without a schema."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def csv_keys(spark: SparkSession, path: str, schema: str, columns: list[str]) -> DataFrame:
    """Some columns of a CSV; bad lines are skipped."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED").csv(path).select(*columns)


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """S12"""
    return spark.read.schema(AUDIT_SCHEMA).json(path)


