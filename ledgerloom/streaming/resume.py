"""Structured Streaming forms of two batch behaviours: keyed resume, and amendments that replace originals.

An extension: the batch operators do the same work once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.writers import checkpointed


def process_new(stream: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: Sequence[str] = ("ticker", "fiscal_year"), once: bool = True) -> StreamingQuery:
    """J4 with K3: each micro-batch does the keys that the output lacks; a repeated batch after a failure adds nothing twice."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            checkpointed(work(df.dropDuplicates(list(keys))), path, keys)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_facts(stream: DataFrame, period: Sequence[str] = ("ticker", "end"), metric: str = "metric", delay: str = "180 days", event_time: str = "filed") -> DataFrame:
    """F6 as a stream: for each period and metric the newest fact, amendments before originals, in update mode.

    Facts later than the watermark are late and dropped, as the batch's filing lag does.
    """
    rank = F.struct(F.col("form").endswith("/A"), F.col(event_time), F.col("accn"))
    return stream.withWatermark(event_time, delay).groupBy(*period, metric).agg(F.max_by("val", rank).alias("val"), F.max_by("form", rank).alias("form"), F.max(event_time).alias(event_time))
