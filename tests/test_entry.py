from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerloom.plans.catalogue import QUERIES
from ledgerloom.plans.oracle import ORACLES
from ledgerloom.streaming import resume

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(v.isoformat() if hasattr(v, "isoformat") else v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    want = con.sql(ORACLES[name]).to_arrow_table()
    cols = sorted(df.columns)
    assert cols == sorted(want.schema.names)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(map(_plain, r)) for r in zip(*(want.column(c).to_pylist() for c in cols)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "ticker string, fiscal_year int, x int"
    spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 1, 3)], schema).coalesce(1).write.parquet(src)
    read = lambda: spark.readStream.schema(schema).parquet(src)
    resume.process_new(read(), lambda df: df, out, ck).awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("a", 1, 9), ("c", 1, 4)], schema).coalesce(1).write.mode("append").parquet(src)
    resume.process_new(read(), lambda df: df, out, ck).awaitTermination(60)
    assert {r.ticker for r in spark.read.parquet(out).collect()} == {"a", "b", "c"}


def test_stream_of_amendments(spark, tmp_path):
    schema = "ticker string, end date, metric string, form string, filed timestamp, accn string, val double"
    rows = "select * from values ('a', date'2015-12-31', 'm', '10-K', timestamp'2016-02-01', '1', 1D), ('a', date'2015-12-31', 'm', '10-K/A', timestamp'2016-03-01', '2', 2D), ('a', date'2015-12-31', 'm', '10-K', timestamp'2016-04-01', '3', 3D) t(ticker, end, metric, form, filed, accn, val)"
    spark.sql(rows).write.parquet(str(tmp_path / "s"))
    q = resume.latest_facts(spark.readStream.schema(schema).parquet(str(tmp_path / "s"))).writeStream.outputMode("update").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select val, form from latest").collect()[-1] == (2.0, "10-K/A")
