"""Line dedup (operator 9): a segment-partition edit join over lines.

A line (text between line feeds, trimmed) is dropped if an earlier line, in the
order of (doc_id, text, line number), is equal or within the edit threshold of
the shorter one: 0 edits below 10 characters, 1 below 20, ``most_edits`` from
there. A pair within t edits leaves one of the shorter line's t + 1 segments
unchanged; so each line puts its segments into an index by (length, number,
substring), and probes, for each length that it can match, the substrings at the
positions that an alignment with at most t edits allows (the multi-match-aware
selection). Candidates are compared by letter counts and then by a banded
bit-parallel automaton of edit distance.

Defined results: blank lines are always kept and never matched; null and empty
texts stay as they are; repeated rows (equal doc_id and text) are one document
and share their decisions; a null doc_id comes first in order; other columns
pass through. "Earlier" counts every line, dropped or not, so the result does not
depend on the order of evaluation.

Scale: the join moves 17 bytes for each index or probe entry, not texts. Lines
that are alone under all their entries, nearly all, end there. The texts of the
others are fetched from their first documents only. A bucket's members are dealt
in pairs of blocks, so a frequent substring is spread over tasks and no pairs are
emitted: a task returns the lines it drops. An equal line costs one row in a
map-side minimum wherever it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm.order_minhash import broadcast_if_small


def edits_for(length: int, most: int = 2) -> int:
    return 0 if length < 10 else min(1, most) if length < 20 else most


def segments(length: int, t: int) -> list[tuple[int, int]]:
    """Start and length of t + 1 segments, as even as can be, the longer ones last."""
    size, long = divmod(length, t + 1)
    out, at = [], 0
    for i in range(t + 1):
        n = size + (i > t - long)
        out.append((at, n))
        at += n
    return out


def probes(length: int, most: int = 2) -> list[tuple[int, int, int, int, bool]]:
    """For a line's length: (indexed length, segment number, start, size, is it the line's own segment)."""
    out = []
    for shorter in range(length, max(0, length - most) - 1, -1):
        t, shift = edits_for(shorter, most), length - shorter
        if shift > t or t == 0:
            continue
        for i, (p, n) in enumerate(segments(shorter, t)):
            low = max(p - i, p + shift - (t - i), 0)
            high = min(p + i, p + shift + (t - i), length - n)
            out += [(shorter, i, s, n, shift == 0 and s == p) for s in range(low, high + 1)]
    return out


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: a bit-parallel automaton on the 2k + 1 diagonals around the main one."""
    if abs(len(a) - len(b)) > k:
        return False
    lo, m = 0, min(len(a), len(b))
    if a[:m] == b[:m]:
        return True  # the rest is insertions, at most k
    step = 1 << (m.bit_length() - 1)
    while step:  # the common beginning, by halving
        if lo + step <= m and a[lo : lo + step] == b[lo : lo + step]:
            lo += step
        step >>= 1
    a, b = a[lo:], b[lo:]
    while a and b and a[-1] == b[-1]:
        for n in (64, 8, 1):
            while len(a) >= n and len(b) >= n and a[-n:] == b[-n:]:
                a, b = a[:-n], b[:-n]
    if not a or not b:
        return len(a) + len(b) <= k
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    # Bit d of states[e]: after i characters of b, i - k + d characters of a are matched with at most e edits.
    mask = (1 << (2 * k + 1)) - 1
    states = [0] * (k + 1)
    states[0] = 1 << k
    for e in range(1, k + 1):
        states[e] = (states[e - 1] | (states[e - 1] << 1)) & mask
    for i, c in enumerate(b):
        own = at.get(c, 0)
        own = ((own >> (i - k)) if i >= k else (own << (k - i))) & mask
        before = states[0]
        states[0] = before & own
        alive = states[0]
        for e in range(1, k + 1):
            old = states[e]
            states[e] = ((old & own) | (before >> 1) | before | (states[e - 1] << 1)) & mask
            before = old
            alive |= states[e]
        if not alive:
            return False
    d = len(a) - len(b) + k
    return bool(states[k] >> d & 1)


def line_id(line: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def lines_of(text: str) -> list[str]:
    """Trimmed lines; blank ones are empty."""
    return [x.strip() for x in text.split("\n")]


def _text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def occurrences(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, line, id and its beginning id8 of each line that is not blank."""
    C.bound_batches(documents.sparkSession)
    schema = C.schema_of(f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text_key bigint, line int, id binary, id8 bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = C.arrow_schema(schema)
        for batch in (p for b in batches for p in C.pieces(b)):
            row, line, ids = [], [], []
            for k, t in enumerate(C.texts(batch)):
                for i, x in enumerate(lines_of(t)):
                    if x:
                        row.append(k)
                        line.append(i)
                        ids.append(line_id(x))
            at = pa.array(row, pa.int64())
            yield C.to_batch({"doc_id": C.column(batch, "doc_id").take(at), "text_key": C.column(batch, "text_key").take(at), "line": line, "id": ids, "id8": np.frombuffer(b"".join(x[:8] for x in ids), dtype=np.int64)}, out)

    return documents.select("doc_id", "text", _text_key().alias("text_key")).mapInArrow(run, schema)


def entries(documents: DataFrame, most: int) -> DataFrame:
    """(bucket, id8) for the index and the probes of each line; id8 is the beginning of its id, and the bucket's last bit is 0 for the index, so that it sorts first."""
    schema = C.schema_of("bucket bigint, id8 bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        h = xxhash.xxh3_64_intdigest
        out, plans = C.arrow_schema(schema), {}
        seen: set[bytes] = set()  # a task's own repeats need no second entry; forgetting them only repeats entries
        for batch in (p for b in batches for p in C.pieces(b)):
            bucket, sizes, own, ids = [], [], [], []
            for t in C.texts(batch):
                for x in lines_of(t):
                    if len(x) < 10:
                        continue
                    i = line_id(x)
                    if i in seen:
                        continue
                    seen.add(i)
                    plan = plans.get(len(x))
                    if plan is None:
                        plan = plans[len(x)] = probes(len(x), most)
                    ids.append(i[:8])
                    sizes.append(len(plan))
                    if x.isascii():
                        raw = x.encode()
                        bucket += [h(raw[s : s + n], 4 * length + k) for length, k, s, n, _ in plan]
                    else:
                        bucket += [h(x[s : s + n].encode("utf-8", "surrogatepass"), 4 * length + k) for length, k, s, n, _ in plan]
                    own += [p[4] for p in plan]
            if len(seen) > 300_000:
                seen.clear()
            if len(plans) > 50_000:
                plans.clear()
            if ids:
                id8 = np.repeat(np.frombuffer(b"".join(ids), dtype=np.int64), sizes)
                hashes = np.array(bucket, dtype=np.uint64) & ~np.uint64(1) | ~np.array(own)
                yield C.to_batch({"bucket": hashes.view(np.int64), "id8": id8}, out)

    return documents.select("text").mapInArrow(run, schema)


def _live(entries_: DataFrame) -> DataFrame:
    """The entries of buckets that hold an index entry and another line, without repeats; rows come sorted."""
    schema = C.schema_of("bucket bigint, id8 bigint, own boolean")
    parted = entries_.repartition(F.shiftright("bucket", 1)).sortWithinPartitions("bucket", "id8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = C.arrow_schema(schema)
        # Of the bucket that the last batch ended in: bucket, first id, is that an index entry, last id, is the first row out.
        carry: tuple[int, int, bool, int, bool] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, i = (C.column(batch, c).to_numpy() for c in ("bucket", "id8"))
            b, o = b >> 1, (b & 1) == 0
            new = np.r_[True, b[1:] != b[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
            first_i, first_o = i[start], o[start]
            repeat = ~new & np.r_[False, i[1:] == i[:-1]]
            goes_on = carry is not None and carry[0] == b[0]
            if goes_on:
                head = start == 0
                first_i[head], first_o[head], repeat[0] = carry[1], carry[2], i[0] == carry[3]
            good = first_o & (i != first_i) & ~repeat
            # A bucket's first row goes out with the first other line.
            leads = np.unique(start[good])
            if goes_on and carry[4]:
                leads = leads[leads > 0]
            tail = start[-1]
            out_now = bool(good[tail:].any())
            if goes_on and tail == 0:
                carry = (*carry[:3], int(i[-1]), carry[4] or out_now)
            else:
                carry = (int(b[-1]), int(i[tail]), bool(o[tail]), int(i[-1]), out_now)
            yield C.to_batch({"bucket": np.r_[b[good], b[leads]], "id8": np.r_[i[good], first_i[leads]], "own": np.r_[o[good], np.ones(len(leads), bool)]}, out)

    return parted.mapInArrow(run, schema)


def _bags(lines: list[str]) -> np.ndarray:
    """Counts of characters by their last five bits."""
    return np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 31, minlength=32) for x in lines]).astype(np.int32)


def near_dropped(documents: DataFrame, firsts: DataFrame, most: int = 2, block: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(id): lines that have an earlier, different line within the threshold. firsts: id, id8, first (doc_id, text_key, line)."""
    live = C.cut(_live(entries(documents, most)))
    ids = live.select("id8").distinct()
    wanted = C.cut(firsts.join(ids, "id8", "left_semi"))
    owners = wanted.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key")).distinct()
    docs = documents.select("doc_id", "text", _text_key().alias("text_key")).alias("d").join(
        broadcast_if_small(owners, broadcast_rows).alias("o"), F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("d.text_key") == F.col("o.text_key")), "left_semi"
    )
    kind = C.schema_of(f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text_key bigint, line int, id binary, text string")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = C.arrow_schema(kind)
        for batch in (p for b in batches for p in C.pieces(b)):
            row, line, found = [], [], []
            for k, t in enumerate(C.texts(batch)):
                for i, x in enumerate(lines_of(t)):
                    if len(x) >= 10:
                        row.append(k)
                        line.append(i)
                        found.append(x)
            at = pa.array(row, pa.int64())
            yield C.to_batch({"doc_id": C.column(batch, "doc_id").take(at), "text_key": C.column(batch, "text_key").take(at), "line": line, "id": [line_id(x) for x in found], "text": found}, out)

    # Repeated rows of a document would repeat its lines.
    texts = docs.mapInArrow(fetch, kind).alias("t").join(
        wanted.alias("w"), (F.col("t.id") == F.col("w.id")) & F.col("t.doc_id").eqNullSafe(F.col("w.first.doc_id")) & (F.col("t.text_key") == F.col("w.first.text_key")) & (F.col("t.line") == F.col("w.first.line"))
    ).select("id8", "w.id", "t.doc_id", "t.text_key", "t.line", "t.text").dropDuplicates(["id8", "id"])
    counts = live.groupBy("bucket").agg(F.count("*").alias("n"))
    dealt = live.join(counts, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("id8"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "own", "id8").join(texts, "id8")

    def make():
        def drop(group: pa.Table) -> pa.Table:
            part, own, ids_, doc, key, line, text = (group.column(c).to_pylist() for c in ("part", "own", "id", "doc_id", "text_key", "line", "text"))
            across = group.column("p")[0].as_py() != group.column("q")[0].as_py()
            order = sorted(range(len(ids_)), key=lambda k: (doc[k] is not None, doc[k] if doc[k] is not None else 0, key[k], line[k]))
            bags = _bags([text[k] for k in order])
            own_, parts = np.array([own[k] for k in order]), np.array([part[k] for k in order])
            sizes = np.array([len(text[k]) for k in order])
            gone = []
            for y in range(1, len(order)):
                t = np.array([edits_for(n, most) for n in np.minimum(sizes[:y], sizes[y])])
                apart = np.abs(bags[:y] - bags[y]).sum(axis=1)
                good = (apart <= 2 * t) & (np.abs(sizes[:y] - sizes[y]) <= t) & (own_[:y] | own_[y])
                if across:
                    good &= parts[:y] != parts[y]
                for x in sorted(np.flatnonzero(good), key=lambda x: apart[x]):
                    if ids_[order[x]] != ids_[order[y]] and within(text[order[x]], text[order[y]], int(t[x])):
                        gone.append(ids_[order[y]])
                        break
            return pa.table({"id": pa.array(gone, pa.binary())})

        return drop

    return C.by_group(dealt, ["bucket", "p", "q"], "id binary", make).distinct()


def dropped(documents: DataFrame, most_edits: int = 2, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, text_key, exact and near: sorted line numbers that go, for each document that loses any."""
    lines = C.cut(occurrences(documents))
    firsts = C.cut(lines.groupBy("id", "id8").agg(F.min(F.struct("doc_id", "text_key", "line")).alias("first"), F.count("*").alias("n")))
    near = C.cut(near_dropped(documents, firsts.select("id", "id8", "first"), most_edits, broadcast_rows=broadcast_rows).withColumn("near", F.lit(True)))
    judged = firsts.join(near, "id", "left").filter("n > 1 or near").select("id", "n", "first", F.coalesce("near", F.lit(False)).alias("near"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("line") == F.col("first.line"))
    gone = C.join_by_key(lines, judged, "id", F.xxhash64("doc_id", "text_key", "line")).filter("first is not null").filter(~is_first | F.col("near")).select("doc_id", "text_key", "line", (is_first & F.col("near")).alias("near")).distinct()
    pick = lambda k: F.array_sort(F.collect_set(F.when(F.col("near") if k else ~F.col("near"), F.col("line"))))  # noqa: E731  a document's own lines
    return gone.groupBy("doc_id", "text_key").agg(pick(False).alias("exact"), pick(True).alias("near"))


def _marked(documents: DataFrame, **options) -> DataFrame:
    """All columns of documents and __gone (line numbers), __exact, __near (their numbers)."""
    cut = dropped(documents, **options).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.size("exact").alias("__exact"), F.size("near").alias("__near"), F.concat("exact", "near").alias("__gone"))
    joined = documents.withColumn("__own", _text_key()).join(cut, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    return joined.drop("__id", "__key", "__own")


#: The lines are bound once, as a lambda's variable; a set difference leaves the numbers of those that stay.
_KEPT = "transform(array(split(text, '\\n', -1)), lines -> array_join(transform(array_except(sequence(0, size(lines) - 1), __gone), i -> lines[i]), '\\n'))[0]"
#: A character that is not white space, as str.strip understands it.
_SOLID = r"(?U)[^\s\x1C-\x1F]"


def dedup_lines(documents: DataFrame, **options) -> DataFrame:
    """The documents without the dropped lines, with all their columns; one that loses all its text goes, n_chars is set anew."""
    out = _marked(documents, **options).withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.expr(_KEPT)))
    out = out.filter(F.col("__gone").isNull() | F.col("text").rlike(_SOLID))
    if dict(documents.dtypes).get("n_chars") in ("int", "bigint"):
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(documents.dtypes)["n_chars"])))
    return out.select(*(F.col(f"`{c}`") for c in documents.columns))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    marked = _marked(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.expr(_KEPT))
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.regexp_like(x, F.lit(_SOLID))))
    return marked.select(
        "doc_id", n.cast("long").alias("n_lines"), F.coalesce("__exact", F.lit(0)).cast("long").alias("n_exact"), F.coalesce("__near", F.lit(0)).cast("long").alias("n_near"),
        F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"),
    )


def brute_force(documents: list[tuple], most: int = 2) -> dict[tuple, tuple[set[int], set[int]]]:
    """(exact, near) line numbers that go, by (position in the list), comparing all lines; order is (doc_id, text key, line); for tests."""
    first: dict[str, tuple] = {}
    every = []
    for k, (doc_id, text_key, text) in enumerate(documents):
        for i, x in enumerate(lines_of(text or "")):
            if x:
                pos = (doc_id is not None, doc_id if doc_id is not None else 0, text_key, i)
                every.append((k, i, x, pos))
                first[x] = min(first.get(x, pos), pos)
    near = {y for y, p in first.items() if any(q < p and x != y and _distance(x, y) <= edits_for(min(len(x), len(y)), most) for x, q in first.items() if abs(len(x) - len(y)) <= most)}
    out: dict = {k: (set(), set()) for k in range(len(documents))}
    for k, i, x, pos in every:
        if pos != first[x]:
            out[k][0].add(i)
        elif x in near:
            out[k][1].add(i)
    return out


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]
