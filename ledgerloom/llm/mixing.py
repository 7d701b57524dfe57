"""Mixing sources to target weights (operator 10) by Sainte-Lague apportionment.

Targets: the mix is as large as the corpus. Sources share it by weight; a source
is read at most ``repeat`` times, and what it cannot give goes to the others by
weight until no target is above its limit.

Blocks: the mix consists of blocks of ``block`` words. Sources get whole numbers
of blocks by the highest quotients target / (2k + 1); the blocks of a source go
to its shards in the same way by shard size. A shard is a seeded hash class of a
source with about ``shard_rows`` documents. Within a shard the documents stand in
seeded order; the blocks are laid along that order from its beginning, again and
again, so that a document gives each pass its whole words but for the one at
which the blocks end.

Defined results: null text has size 0, and a document of size 0 gives 0 words; a
null source is a source of its own, last in order; an empty table gives no rows;
repeated rows each count; columns other than doc_id, text and source are ignored.

Scale: texts are read once and never shuffled; documents then are rows of a few
numbers. Per-source totals (one row a source, at most ``max_sources``) are solved
on the driver. Shard totals, one for about ``shard_rows`` documents, are
apportioned in one task for each source. A hot source is split into shards, so
its running sums are as parallel as those of all others.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common as C

WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[int], weights: list[float], repeat: float = 3.0) -> list[float]:
    """Shares of sum(sizes) by weight, none above repeat times its size."""
    left, out = float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        if total <= 0:
            break
        over = [i for i in open_ if left * weights[i] / total > repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = repeat * sizes[i]
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def sainte_lague(shares: list[float], seats: int, limits: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients share / (2k + 1); ties go to the earlier party.

    No party gets more than its limit. The quotient that wins the last seat is
    found by bisection, so the number of seats does not matter; the few seats
    left at that quotient are dealt one by one.
    """
    import heapq

    n = len(shares)
    limits = [seats] * n if limits is None else limits
    seats = min(seats, sum(m for m, s in zip(limits, shares) if s > 0))
    if seats <= 0:
        return [0] * n

    def won(d: float) -> list[int]:
        """Seats whose quotients exceed d, without the limit's overrun."""
        return [min(m, max(0, int((s / d + 1) / 2))) if s > 0 else 0 for s, m in zip(shares, limits)]

    low, high = 0.0, max(shares) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if sum(won(mid)) > seats:
            low = mid
        else:
            high = mid
    out = won(high)
    heap = [(-s / (2 * k + 1), i) for i, (s, k) in enumerate(zip(shares, out)) if s > 0 and k < limits[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < limits[i]:
            heapq.heappush(heap, (-shares[i] / (2 * out[i] + 1), i))
    return out


def mix(
    documents: DataFrame, weights: tuple[float, ...] = WEIGHTS, block: int = 16, repeat: int = 3,
    shard_rows: int = 4096, seed: int = 17, max_sources: int = 1_000_000,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken."""
    spark = documents.sparkSession
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    docs = C.cut(documents.select("doc_id", F.col("source").cast("string").alias("source"), size.cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("order")))
    totals = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    rows = totals.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"over {max_sources} sources; group them first or raise max_sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in rows]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], repeat)
    # A shard cannot give more than its own whole blocks, which limits a source too; it has at most one shard for shard_rows documents.
    seats = round(sum(wanted) / block)
    quotas = sainte_lague(wanted, seats, [repeat * s // block for s in sizes])
    plan = pd.DataFrame(
        [(r.source, r["size"], -(-r.rows // shard_rows), t, q) for r, t, q in zip(rows, wanted, quotas)],
        columns=["source", "source_size", "shards", "target", "quota"],
    )
    plan_df = spark.createDataFrame(plan.astype(object).where(plan.notna(), None).values.tolist(), "source string, source_size long, shards long, target double, quota long")
    same = F.col("d.source").eqNullSafe(F.col("p.source"))
    placed = (
        docs.alias("d").join(F.broadcast(plan_df).alias("p"), same)  # at most max_sources rows
        .select("doc_id", "d.source", "size", "order", "source_size", "target", "shards", "quota", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), "shards").alias("shard"))
    )

    def by_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        own = pdf["shard_size"].astype(int).tolist()
        quota = sainte_lague([float(s) for s in own], int(pdf["quota"].iloc[0]), [repeat * s // block for s in own])
        return pdf[["source", "shard"]].assign(words=[q * block for q in quota])

    shards = placed.groupBy("source", "quota", "shard").agg(F.sum("size").alias("shard_size"))
    quotas_df = shards.groupBy("source").applyInPandas(by_shard, "source string, shard long, words long")
    order = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size")
    whole = Window.partitionBy("source", "shard")
    laid = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("shard_size", F.sum("size").over(whole))
    joined = laid.alias("l").join(quotas_df.alias("q"), F.col("l.source").eqNullSafe(F.col("q.source")) & (F.col("l.shard") == F.col("q.shard")))
    passes = F.expr("if(shard_size > 0, words div shard_size, 0L)")
    rest = F.expr("if(shard_size > 0, words % shard_size, 0L)")
    taken = F.col("size") * passes + F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("end") - F.col("size"))))
    return joined.select("doc_id", "l.source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).drop("source")
