"""Connected components over a table of links, in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C


def components(links: DataFrame, most_rounds: int = 100, one_task: int = 200_000) -> DataFrame:
    """(v, c): each vertex of the links (a, b) with the smallest vertex of its component.

    Up to ``one_task`` rows of links, which must be cut or cheap to make, are
    joined in one task: rounds over few links are all overhead, and their many
    plans, broadcasts and threads fill the driver. More links go in rounds.

    Each round takes the smallest label among neighbours and then the label of
    that label, so paths halve. Labels are cut in the shared folder each round.
    Minima combine before they are shuffled; where labels meet the links of a
    much-linked vertex, or the members of a large component, these rows are
    joined apart and stay spread (common.join_by_key). Only counts reach the driver.
    What a round no longer reads is deleted, so the disk holds one round at a time.
    """
    if links.limit(one_task + 1).count() <= one_task:
        return _in_one_task(links)
    both = C.cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = C.cut(both.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).select(F.col("a").alias("v"), F.least("a", "b").alias("c"), "n"))
    found = labels.agg(F.sum("n"), F.max("n"), F.count("*")).first()
    if not found[2]:
        return labels.select("v", "c")
    last = labels
    for _ in range(most_rounds):
        ends = labels.select(F.col("v").alias("b"), "n", "c")
        near = _meet(both, ends, "b", F.xxhash64("a", "b"), found[0], found[1]).groupBy("a").agg(F.min("c").alias("least")).withColumnRenamed("a", "v")
        nearer = C.cut(labels.join(near, "v").select("v", "n", F.col("c").alias("old"), F.least("c", "least").alias("c")))
        C.uncut(last)
        sizes = nearer.groupBy("c").agg(F.count("*").alias("n"))
        jump = nearer.select(F.col("v").alias("c"), F.col("c").alias("j")).join(sizes, "c")
        jumped = _meet(nearer, jump, "c", F.xxhash64("v"), found[2], sizes.agg(F.max("n")).first()[0])
        last = C.cut(jumped.select("v", F.least("c", F.coalesce("j", "c")).alias("c"), "n", "old"))
        C.uncut(nearer)
        labels = last.drop("old")
        if not last.filter("c <> old").limit(1).count():
            C.uncut(both)
            return labels.select("v", "c")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _in_one_task(links: DataFrame) -> DataFrame:
    kind = links.schema["a"].dataType.simpleString()
    schema = C.schema_of(f"v {kind}, c {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(v):
            top = v
            while root[top] != top:
                top = root[top]
            while root[v] != top:
                root[v], v = top, root[v]
            return top

        for batch in batches:
            for a, b in zip(C.column(batch, "a").to_pylist(), C.column(batch, "b").to_pylist()):
                x, y = find(root.setdefault(a, a)), find(root.setdefault(b, b))
                root[max(x, y)] = min(x, y)
        every = list(root)
        for at in range(0, len(every), 10_000):
            own = every[at : at + 10_000]
            yield C.to_batch({"v": own, "c": [find(v) for v in own]}, C.arrow_schema(schema))

    return C.cut(links.filter("a <> b").select("a", "b").coalesce(1).mapInArrow(run, schema))


def _meet(left: DataFrame, right: DataFrame, key: str, spread: Column, total: int, most: int, floor: int = 64) -> DataFrame:
    """common.join_by_key; a plain join where no key has more than ``floor`` rows."""
    if most > floor:
        return C.join_by_key(left, right, key, spread, floor=floor, total=total)
    return left.join(right.drop("n"), key)
