"""Approximate nearest neighbours (operator 5): shifted space-filling curves.

Inner products become distances by one more coordinate: a vector x turns into
(x / M, sqrt(1 - |x|^2 / M^2)), M being the largest norm, a query q into
(q / |q|, 0). Each of ``curves`` orderings projects these to ``dims`` dimensions
at random, shifts the grid at random and takes the Hilbert key. Spark range-
partitions and sorts the keys of all curves; a query's neighbours are the rows
within a window of its rank on each curve. Windows are laid out in blocks of
consecutive ranks; each block scores the queries whose windows touch it with
double-precision inner products of the original vectors, and the best of all
blocks and curves merge.

The window is calibrated: for ``sample`` queries the true neighbours are found by
a scan of all rows in blocks, and the window is the rank distance within which
``target`` of them lie on their best curve. Data with little structure so get
wide windows, and an honest recall, instead of a fixed width and a poor one.

Equal vectors share one place on the curves; of their rows the smallest ids, as
many as can be asked for, stand in the result, ties to the smaller id.

Defined results: vectors that are null, empty, zero, or hold null, NaN or
infinite components take no part, nor do rows without id or of another length
than the most frequent one; a repeated row (equal id and vector) counts once;
an empty table gives no rows; other columns are ignored.

Scale: vectors move once for each curve, in single precision if they came so; keys and ranks are rows of a few bytes;
the driver sees the counts of range partitions and the sample's distances. The
top-k of equal vectors is limited before the shuffle, so a frequent vector is no
hot task. Work is rows times window share: on isotropic noise, where near rows
are hardly nearer than others, it nears a full scan; on clustered data it is
small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import common as C


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer cells (n x dims, each below 2**bits) on the Hilbert curve, by Gray-code transposition."""
    x = [c.astype(np.uint32) for c in cells.T]
    one = np.uint32(1)
    for level in range(bits - 1, 0, -1):
        bit = np.uint32(1 << level)
        low = bit - one
        for i in range(len(x)):
            on = (x[i] & bit) != 0
            swap = np.where(on, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(on, low, swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> np.uint32(level)) & one, turn ^ np.uint32((1 << level) - 1), turn)
    key = np.zeros(len(turn), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> np.uint32(level)) & one).astype(np.int64)
    return key


class Curves:
    """Random projections with shifted grids; place() gives a key for each row and curve."""

    def __init__(self, sample: np.ndarray, largest: float, curves: int, dims: int, bits: int, seed: int) -> None:
        r = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.largest, self.bits = largest, bits
        self.axes = [np.linalg.qr(r.normal(size=(d, min(dims, d))))[0] for _ in range(curves)]
        self.shift = [r.uniform(0, 0.5, a.shape[1]) for a in self.axes]
        lifted = self._lift(sample, False)
        at = [lifted @ a for a in self.axes]
        self.middle = [p.mean(axis=0) for p in at]
        self.spread = [np.maximum(p.std(axis=0), 1e-9).max() for p in at]

    def _lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        n = np.linalg.norm(x, axis=1)
        if query:
            return np.c_[x / n[:, None], np.zeros(len(x))]
        return np.c_[x / self.largest, np.sqrt(np.maximum(0, 1 - (n / self.largest) ** 2))]

    def place(self, x: np.ndarray, query: bool) -> np.ndarray:
        lifted, out = self._lift(x, query), []
        for axes, shift, middle, spread in zip(self.axes, self.shift, self.middle, self.spread):
            u = np.clip((lifted @ axes - middle) / (8 * spread) + 0.5, 0, 1) * 0.5 + shift
            cells = np.minimum((u * (1 << self.bits)).astype(np.int64), (1 << self.bits) - 1)
            out.append(hilbert_keys(cells, self.bits))
        return np.stack(out, axis=1)


def matrix(a: pa.Array, dim: int) -> np.ndarray:
    """A list column as doubles, one row each."""
    flat = a.flatten() if not isinstance(a, pa.ChunkedArray) else a.combine_chunks().flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _valid(embeddings: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of floats, if it was one, or doubles) of the rows that take part."""
    v = F.col(vec_col) if dict(embeddings.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0")
    whole = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    rows = rows.filter(whole)
    length = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    return rows.filter(F.size("v") == length[0].n) if length else rows


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Positions of the k largest of each row, ties to the smaller id."""
    out = []
    for s in scores:
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            at = np.flatnonzero(s >= least)
        else:
            at = np.arange(len(s))
        out.append(at[np.lexsort((ids[at], -s[at]))][:k])
    return out


def search(
    embeddings: DataFrame, every: int = 20, k: int = 20, curves: int = 16, dims: int = 8, bits: int = 5,
    sample: int = 128, target: float = 0.96, seed: int = 3, id_col: str = "vec_id", vec_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = _valid(embeddings, id_col, vec_col).withColumn("vh", F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(i), "v")), 16, "0") for i in (0, 1)))))
    # Of equal vectors the k + 1 smallest ids; Spark limits them before the shuffle. row 1 stands for all on the curves.
    # Repeated rows go first: they would take the places of other ids.
    once = rows.groupBy("vh", "vec_id").agg(F.first("v").alias("v"))
    ranked = once.withColumn("m", F.row_number().over(Window.partitionBy("vh").orderBy("vec_id")))
    members = C.cut(ranked.filter(F.col("m") <= k + 1))
    queries = C.cut(rows.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "vh", "v").dropDuplicates(["vh", "vec_id"]))
    data = members.filter("m = 1").select(F.col("vec_id").alias("rep"), "v")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    facts = data.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)")).alias("n"), F.max(F.size("v")).alias("dim"), F.count("*").alias("rows")).first()
    if not facts["rows"] or not queries.limit(1).count():
        return empty
    dim = facts["dim"]
    fit = data.orderBy(F.xxhash64("rep"), "rep").limit(4096).collect()  # a bounded sample, for the grids' scale only
    grid = Curves(np.array([r.v for r in fit]), float(np.sqrt(facts["n"])), curves, dims, bits, seed)

    kind = C.schema_of("curve int, key long, id long, query boolean")

    def place(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = C.arrow_schema(kind)
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = grid.place(matrix(C.column(batch, "v"), dim), query)
                n, c = keys.shape
                ids = np.repeat(C.column(batch, "id").to_numpy(), c)
                yield C.to_batch({"curve": np.tile(np.arange(c), n), "key": keys.ravel(), "id": ids, "query": np.full(n * c, query)}, out)

        return run

    asked = queries.groupBy("vh").agg(F.min("vec_id").alias("id"), F.first("v").alias("v"))  # equal queries are placed once
    placed = data.select(F.col("rep").alias("id"), "v").mapInArrow(place(False), kind).union(asked.select("id", "v").mapInArrow(place(True), kind))
    parts = max(curves, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["curve", "key", "id", "query"]
    ranks_kind = C.schema_of("curve int, id long, query boolean, part int, at long")

    def count_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, at, part = C.arrow_schema(ranks_kind), 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            if n:
                yield C.to_batch({c: C.column(batch, c) for c in ("curve", "id", "query")} | {"part": np.full(n, part), "at": np.arange(at, at + n)}, out)
                at += n

    numbered = C.cut(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(count_up, ranks_kind))
    sizes = sorted((r.part, r.n) for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(sizes, np.cumsum([0, *(n for _, n in sizes)]))], "part int, start long")
    ranks = numbered.join(F.broadcast(starts), "part").select("curve", "id", "query", (F.col("start") + F.col("at")).alias("rank"))  # a row for each range partition

    width = _calibrated(data, asked, ranks, dim, k, sample, target, facts["rows"])
    size = int(min(4096, max(256, width)))
    block = lambda c: F.floor(c / size)  # noqa: E731  rank blocks lie across curve borders; rows of another curve do no harm
    there = ranks.filter("not query").select("id", block(F.col("rank")).alias("block")).join(data.select(F.col("rep").alias("id"), "v"), "id")
    touched = ranks.filter("query").select("id", F.explode(F.sequence(block(F.greatest(F.col("rank") - width, F.lit(0))), block(F.col("rank") + width))).alias("block")).join(asked.select("id", "v"), "id")
    both = there.withColumn("query", F.lit(False)).unionByName(touched.withColumn("query", F.lit(True)))

    def make():
        def run(group: pa.Table) -> pa.Table:
            q = group.column("query").to_numpy(zero_copy_only=False)
            ids, v = group.column("id").to_numpy(), matrix(group.column("v"), dim)
            names, at = np.unique(ids[q], return_index=True)
            reps, rep_at = np.unique(ids[~q], return_index=True)
            a, b, c = [], [], []
            if len(names) and len(reps):
                left, right = v[q][at], v[~q][rep_at]
                for s in range(0, len(left), 512):
                    scores = left[s : s + 512] @ right.T
                    for row, best in enumerate(_top(scores, reps, k + 1)):
                        a.append(np.full(len(best), names[s + row]))
                        b.append(reps[best])
                        c.append(scores[row][best])
            cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            return pa.table({"id": pa.array(cat(a, np.int64), pa.int64()), "rep": pa.array(cat(b, np.int64), pa.int64()), "score": pa.array(cat(c, float), pa.float64())})

        return run

    found = C.by_group(both, ["block"], "id long, rep long, score double", make)
    best = found.groupBy("id", "rep").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "rep"))).filter(F.col("r") <= k + 1)
    # Exact scores of what was found, then members of equal vectors, without the query itself.
    names = queries.join(asked.select("vh", "id"), "vh").select("id", F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    reps = members.filter("m = 1").select(F.col("vec_id").alias("rep"), "vh", "v")
    dot = F.expr("aggregate(zip_with(qv, v, (a, b) -> cast(a as double) * cast(b as double)), 0D, (a, x) -> a + x)")
    scored = best.select("id", "rep").join(names, "id").join(reps, "rep").select("query_id", "qv", "vh", dot.alias("score"))
    answer = scored.join(members.select("vh", "vec_id"), "vh").filter("vec_id <> query_id").select("query_id", "vec_id", "score").distinct()
    place_of = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answer.withColumn("rank", place_of.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _calibrated(data: DataFrame, asked: DataFrame, ranks: DataFrame, dim: int, k: int, sample: int, target: float, rows: int) -> int:
    """The rank distance within which the target share of the sample's true neighbours lie on their best curve."""
    spark = data.sparkSession
    chosen = asked.orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "v").collect()
    q_ids, q = np.array([r.id for r in chosen]), np.array([r.v for r in chosen])
    kind = C.schema_of("id long, rep long, score double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = C.arrow_schema(kind)
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = C.column(batch, "rep").to_numpy()
            scores = q @ matrix(C.column(batch, "v"), dim).T
            best = _top(scores, reps, k + 1)
            yield C.to_batch({"id": np.repeat(q_ids, [len(b) for b in best]), "rep": reps[np.concatenate(best)], "score": np.concatenate([s[b] for s, b in zip(scores, best)])}, out)

    true = data.mapInArrow(scan, kind).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "rep"))).filter(F.col("r") <= k + 1)
    pairs = [(r.id, r.rep) for r in true.select("id", "rep").collect() if r.id != r.rep]  # sample * (k + 1) at most
    if not pairs:
        return rows
    pairs_df = F.broadcast(spark.createDataFrame(pairs, "id long, rep long"))
    q_rank = ranks.filter("query").join(F.broadcast(spark.createDataFrame([(int(i),) for i in q_ids], "id long")), "id").select("curve", "id", F.col("rank").alias("q_rank"))
    r_rank = ranks.filter("not query").select("curve", F.col("id").alias("rep"), "rank").join(pairs_df, "rep")
    apart = r_rank.join(q_rank, ["curve", "id"]).groupBy("id", "rep").agg(F.min(F.abs(F.col("rank") - F.col("q_rank"))).alias("d"))
    d = np.array([r.d for r in apart.collect()])
    return int(np.quantile(d, target, method="higher")) + 1


def op5_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(C.table(spark, sf_dir, "embeddings"))
