"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words in the contracts: space and the controls \t \n \v \f \r.
SPACES = r"[^\x20\x09-\x0D]+"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of texts: 10000 rows, Spark's default, of a few kilobytes each hold much memory on both sides. A setting of the user's own stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset (tests, a single machine) a temporary one is made; on a
    cluster without the setting this raises, since a local folder would be lost
    with its machine.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(found)
        return found.rstrip("/")
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        made = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        context.setCheckpointDir(made)
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder; made by its first writer."""
    return f"{work_dir(spark)}/{kind}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared folder, so that a lost executor costs no recomputation.

    Later steps read the checkpoint only, so the run's shuffle files go at its
    end, and not when the driver happens to collect garbage. A setting of the user's own stays.
    """
    spark = df.sparkSession
    work_dir(spark)
    if spark.conf.get(_CLEAN, None) is not None:
        return df.checkpoint()
    spark.conf.set(_CLEAN, "true")
    try:
        return df.checkpoint()
    finally:
        spark.conf.unset(_CLEAN)


def uncut(*frames: DataFrame) -> None:
    """Deletes the checkpoints of results of ``cut`` that nothing reads any more: all that was made of them is itself cut or collected."""
    for df in frames:
        context = df.sparkSession.sparkContext
        found = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if found.isDefined():
            path = context._jvm.org.apache.hadoop.fs.Path(found.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """Columns by name, as Arrow arrays, numpy arrays or lists, in the schema's order and types."""
    arrays = []
    for field in schema:
        x = columns[field.name]
        if isinstance(x, pa.ChunkedArray):
            x = x.combine_chunks()
        arrays.append(x.cast(field.type) if isinstance(x, pa.Array) else pa.array(x, type=field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def pieces(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes: what a function makes of texts is many times their size."""
    rows = batch.num_rows
    step = max(1, min(rows, rows * size // max(1, batch.nbytes)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def give_back() -> None:
    """Returns freed memory to the system at a task's end: workers live on and would keep it from the next stages."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


def map_batches(df: DataFrame, ddl: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """Applies a batch function in Python workers over Arrow, which keeps integers with nulls exact.

    ``make`` runs once in each task and returns the function, so state that is
    expensive to build (automata, trees, memory maps) is built once.
    """
    bound_batches(df.sparkSession)
    schema = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, out = None, arrow_schema(schema)
        for batch in batches:
            for piece in pieces(batch):
                fn = fn or make()
                yield to_batch(fn(piece), out)
        del fn
        give_back()

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """Keeps the rows, with all their columns, for which the batch function says True."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = None
        for batch in batches:
            for piece in pieces(batch):
                fn = fn or make()
                yield piece.filter(pa.array(fn(piece), type=pa.bool_()))
        del fn
        give_back()

    return df.mapInArrow(run, df.schema)


def by_group(df: DataFrame, keys: list[str], ddl: str | T.StructType, make: Callable[[], Callable[[pa.Table], pa.Table]]) -> DataFrame:
    """Calls a function with the rows of each group, which must be small; many small groups cost little more than their rows."""
    schema = schema_of(ddl) if isinstance(ddl, str) else ddl
    marked = df.withColumn("__g", F.xxhash64(*keys)).repartition("__g").sortWithinPartitions("__g", *keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn, held, held_g = make(), [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            g = column(batch, "__g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1), len(g)]
            for s, e in zip(cuts, cuts[1:]):
                if held and g[s] != held_g:
                    yield from fn(pa.Table.from_batches(held)).to_batches()
                    held = []
                held_g = g[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from fn(pa.Table.from_batches(held)).to_batches()
        del fn
        give_back()

    return marked.mapInArrow(run, schema)


def join_by_key(left: DataFrame, right: DataFrame, key: str, spread: Column, n: str = "n", parts: int = 100_000, floor: int = 1000, total: int | None = None) -> DataFrame:
    """Left join with a table of one row for each key (binary or long), some of which may be very frequent on the left.

    right holds the key, n (its rows on the left) and further columns; total is
    the sum of n or an upper bound of it, found if not given. Keys with more than ``floor`` and more than
    one in ``parts`` of the rows are at most ``parts`` and total / floor, which bounds
    their broadcast; their rows then move under the hash ``spread``, so the
    shuffle that joins all other keys has no hot one. Null keys match nothing.
    """
    if total is None:
        total = right.agg(F.sum(n)).first()[0] or 0
    limit = max(floor, total // parts)
    cols = [c for c in right.columns if c not in (key, n)]
    hot = right.filter(F.col(n) > limit).select(F.col(key).alias("__hot"), F.struct(*cols).alias("__a"))
    rest = right.filter(F.col(n) <= limit).select(F.col(key).alias("__rest"), F.struct(*cols).alias("__b"))
    out = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    own = F.unhex(F.md5(spread.cast("string").cast("binary"))) if dict(left.dtypes)[key] == "binary" else spread
    out = out.withColumn("__k", F.when(F.col("__hot").isNotNull(), own).otherwise(F.coalesce(F.col(key), own)))
    out = out.join(rest, F.col("__k") == F.col("__rest"), "left")
    # A spread key may, by chance, equal a real one: what the broadcast found comes first, and null keys get nothing.
    got = F.when(F.col("__hot").isNotNull(), F.col("__a")).when(F.col(key).isNotNull(), F.col("__b"))
    return out.select(*left.columns, *(got[c].alias(c) for c in cols))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Strings of a column; null as the empty string."""
    return [x or "" for x in column(batch, name).to_pylist()]


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def filesystem(uri: str):
    """Arrow's file system for a URI or a plain path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
