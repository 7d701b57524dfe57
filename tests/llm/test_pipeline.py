"""The pipeline's stages and the registered queries on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from ledgerloom.llm import decontaminate, line_dedup, order_minhash
from ledgerloom.llm.sql import ORACLES


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, sf_dir)
        if name == "mixing":
            assert {r.doc_id for r in out.collect()} == {d for d, _ in before}
            break
        assert out.columns == columns
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        after = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        assert {d for d, _ in after} <= {d for d, _ in before}
        if name == "line_dedup":
            keyed = sorted((d, t) for d, t in after)
            assert not any(v[0] for v in line_dedup.brute_force([(d, 0, t) for d, t in keyed], 0).values())
        elif name == "near_dedup":
            assert order_minhash.near_classes(docs).filter("not kept").count() == 0 and after <= before
        elif name == "decontamination":
            bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            bad = {r[0] for r in decontaminate.brute_force(sorted(before), bench) if r[5]}
            assert {d for d, _ in before} - {d for d, _ in after} == bad


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and out.agg(F.sum("taken")).first()[0] > 0


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()])
def test_queries_run(spark, sf_dir, name):
    assert entry.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*' if os.path.isdir(p) else p}'")
    df = entry.queries()[name](spark, sf_dir)
    want, cols = con.sql(entry.oracle_sql()[name]).to_arrow_table(), sorted(df.columns)
    assert cols == sorted(want.schema.names)
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(map(str, zip(*(want.column(c).to_pylist() for c in cols))))


def test_names():
    assert [n.split("_")[0] for n in entry.queries() if n.startswith("op") and n[2].isdigit()] == [f"op{i}" for i in range(1, 11)]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
