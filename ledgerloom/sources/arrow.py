"""Batch functions in Python workers over Arrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_batches(df: DataFrame, ddl: str, fn: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    """fn turns a batch into columns by name (Arrow arrays or lists)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                got = fn(batch)
                arrays = [got[f.name].cast(f.type) if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], type=f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays(arrays, schema=kinds)

    return df.mapInArrow(run, schema)
