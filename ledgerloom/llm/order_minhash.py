"""MinHash near-dedup (operator 2): order MinHash with verification by banded alignment.

Text is lower-cased and split into words; its k-mers are runs of five words,
each labelled with its occurrence number (a shorter text is one k-mer). A sketch
takes the smallest k-mers under a hash function and keeps them in text order, so
it depends on order as edit similarity does; texts that share one of ``sketches``
sketches are candidates. Candidates are verified by aligning their words: a
bit-parallel longest common subsequence within the band of diagonals that the
threshold allows. Two texts are near duplicates if aligned words make up at least
0.8 of all (aligned / (n1 + n2 - aligned)): one changed word in nine.

A changed word breaks the five k-mers around it, so two texts at the threshold
share down to 0.39 of their k-mers (0.9 ** 5 stay on each side at one changed word in ten).
48 sketches of three k-mers find such a pair with 0.95, a pair with one changed
word in twenty with more than 0.99. Texts below 64 words have fewer k-mers to
share and take sketches of two; those from 52 words on have both, so that any two
texts whose lengths allow 0.8 meet on equal terms. Below ten words a changed word
may leave no k-mer; such texts are found if they are equal or changed at an end.

Texts with equal words are one class from the start. Then, first round: each
class is aligned with the ``hubs_met`` classes with which it shares most buckets, of
those that are the hub (most shared member) of a bucket; so a large group of near
copies costs a few alignments a member. Second round, for every bucket that still holds
several components: bags of words, counts of a few bytes, first tell by an upper
bound of the aligned words which members may have a near one outside their
component; texts of these only are dealt in blocks, and all pairs of different
components are aligned inside the tasks, which return only links. No pair is
skipped, none is emitted.

Defined results: texts without words (null, empty, punctuation) are in a class
of their own and near to nothing; a class is named by its smallest doc_id, null
if it has none; of each class the row with the smallest (doc_id, hash of its text) is kept, one without
doc_id only if all are; repeated rows share class and decision, and dedup keeps one of them; other columns are ignored.

Scale: texts are read in one sketching pass without a shuffle, and again only
for documents in some bucket; the bucket's members are found on rows of a few
bytes. Frequent buckets, hubs, classes and texts are joined apart from the others
(common.join_by_key). Blocks bound a task's memory; hot buckets spread over many tasks.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm.graph import components

_WORD = re.compile(r"\w+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Hashes(dict):
    """Hashes of words, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hashes(words: list[str], cache: Hashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def kmers(h: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of k words; one of all words for a shorter text."""
    n = len(h) - k + 1
    if n < 1:
        n, k = min(len(h), 1), len(h)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k if n else 0):
        out = (out * _M1) ^ mix(h[j : j + n] + np.uint64(j + 1))
    return mix(out)


def labelled(s: np.ndarray) -> np.ndarray:
    """K-mers told apart by their occurrence number."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.r_[True, t[1:] != t[:-1]]
    if first.all():
        return s
    start = np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))
    occurrence = np.empty(len(s), dtype=np.uint64)
    occurrence[order] = (np.arange(len(t)) - start).astype(np.uint64)
    return np.where(occurrence > 0, mix(s + occurrence * _M1), s)


def order_sketches(s: np.ndarray, seeds: np.ndarray, minima: int) -> np.ndarray:
    """For each seed a hash of the k-mers that are smallest under it, in text order."""
    x = labelled(s)
    low, high = x.astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)
    where = []
    for own in np.array_split(seeds, 1 + len(x) * len(seeds) // 4_000_000):  # very long texts: in parts, to bound memory
        h = low[None, :] * (own.astype(np.uint32) | np.uint32(1))[:, None]
        h += high[None, :] * ((own >> np.uint64(32)).astype(np.uint32) | np.uint32(1))[:, None]
        r, at = np.arange(len(own)), []
        for _ in range(min(minima, len(x))):
            i = h.argmin(axis=1)
            at.append(i)
            h[r, i] = np.iinfo(np.uint32).max
        where.append(np.sort(np.stack(at, axis=1), axis=1))
    at = np.concatenate(where)
    sketch = np.arange(1, len(seeds) + 1).astype(np.uint64) * _M3
    for j in range(at.shape[1]):
        sketch = mix(sketch * _M1 + x[at[:, j]])
    return sketch


#: Texts of fewer words are short; those that may be near to a short and a long one count as both.
SHORT = 64


def buckets_of(h: np.ndarray, seeds: np.ndarray, tenths: int = 8) -> np.ndarray:
    """The sketches of a text's word hashes: of three k-mers, of two for short texts, or of both."""
    s = kmers(h)
    out = []
    if 10 * len(h) >= tenths * SHORT:
        out.append(order_sketches(s, seeds, 3))
    if len(h) < SHORT:
        out.append(mix(order_sketches(s, seeds, 2)))
    return np.concatenate(out)


def seeds_of(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64)


def aligned(a: list[int], b: list[int], needed: int) -> int:
    """Longest common subsequence of two sequences, or any smaller number than needed if it is below that.

    Only diagonals that an alignment of the needed length can reach are looked at.
    """
    lo = 0
    m = min(len(a), len(b))
    while lo < m and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < m - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    rest = needed - lo - hi
    if rest <= 0 or not a or not b:
        return lo + hi
    if sum((Counter(a) & Counter(b)).values()) < rest:
        return lo + hi
    left, right = len(a) - rest, len(b) - rest  # so many of a, of b, may stay without a partner
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, width = full, left + right + 1
    for j, y in enumerate(b):
        m_y = at.get(y)
        if m_y is None:
            continue
        low = j - right
        band = ((1 << width) - 1) << low if low >= 0 else ((1 << width) - 1) >> -low
        u = v & m_y & band
        v = ((v + u) | (v - u)) & full
    return lo + hi + len(a) - v.bit_count()


def near(a: list[int], b: list[int], tenths: int = 8) -> bool:
    """Whether aligned / (len(a) + len(b) - aligned) >= tenths / 10."""
    both = len(a) + len(b)
    needed = -(-tenths * both // (10 + tenths))
    return min(len(a), len(b)) >= needed and aligned(a, b, needed) >= needed


def sketch(documents: DataFrame, sketches: int = 48, tenths: int = 8) -> DataFrame:
    """doc_id, key (of the words), text_key, buckets of each whole text; key is null for texts without words."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        import hashlib

        cache, seeds = Hashes(), seeds_of(sketches)

        def run(batch):
            keys, found = [], []
            for t in C.texts(batch):
                words = words_of(t)
                keys.append(hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest() if words else None)
                found.append(buckets_of(word_hashes(words, cache), seeds, tenths).view(np.int64) if words else None)
            return {"doc_id": C.column(batch, "doc_id"), "text_key": C.column(batch, "text_key"), "key": keys, "buckets": found}

        return run

    docs = documents.select("doc_id", "text", text_key().alias("text_key"))
    return C.map_batches(docs, f"doc_id {kind}, text_key binary, key binary, buckets array<bigint>", make)


def text_key() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


_BAG = 128


def with_bags(texts: DataFrame) -> DataFrame:
    """key, text and its bag: the number of its words in each of 128 classes."""

    def make():
        cache, mask = Hashes(), np.uint64(_BAG - 1)

        def run(batch):
            bags = [np.bincount((word_hashes(words_of(t), cache) & mask).astype(np.int64), minlength=_BAG).astype("<u4").tobytes() for t in C.texts(batch)]
            return {"key": C.column(batch, "key"), "text": C.column(batch, "text"), "bag": bags}

        return run

    return C.map_batches(texts.select("key", "text"), "key binary, text string, bag binary", make)


def _sequences(texts: list[str], cache: Hashes) -> list[np.ndarray]:
    return [word_hashes(words_of(t), cache) for t in texts]


def shared(seqs: list[np.ndarray]) -> np.ndarray:
    """For each two sequences the number of labelled words in both: no alignment can be longer."""
    labels = [labelled(s) for s in seqs]
    owner = np.repeat(np.arange(len(seqs)), [len(x) for x in labels])
    _, which, count = np.unique(np.concatenate(labels), return_inverse=True, return_counts=True)
    often = count > 1
    column = np.cumsum(often) - 1
    keep = often[which]
    owner, which = owner[keep], column[which[keep]]
    out = np.zeros((len(seqs), len(seqs)))
    step = 20_000  # columns at once
    for s in range(0, int(often.sum()), step):
        own = (which >= s) & (which < s + step)
        m = np.zeros((len(seqs), min(step, int(often.sum()) - s)), dtype=np.float32)
        m[owner[own], which[own] - s] = 1
        out += m @ m.T
    return out


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """With a broadcast hint if it has at most so many rows of a few bytes; else joins shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def _several(placed: DataFrame, block: int, total: int) -> DataFrame:
    """(bucket, key, c, cross, p, q, own): members of buckets with several components c, dealt for the meetings of their blocks.

    A bucket's largest component needs no look at itself, so its members meet
    blocks of the others only (cross); these meet each other, too.
    """
    counts = placed.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("most"), F.sum("n").alias("n")).filter("n > most.n")
    dealt = C.join_by_key(placed, mixed.withColumn("all", F.col("n")), "bucket", F.xxhash64("key"), total=total).filter("most is not null")
    dealt = dealt.withColumn("minor", F.col("c") != F.col("most.c"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    dealt = dealt.withColumns({"k1": blocks(F.col("most.n")), "k2": blocks(F.col("all") - F.col("most.n"))})
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("key"), F.when(F.col("minor"), F.col("k2")).otherwise(F.col("k1"))).cast("int"))
    # Meetings: (p, q) of a block p of the others with a block q of the largest (cross), or of the others.
    at = lambda p, q, cross, own: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), F.lit(cross).alias("cross"), own.cast("int").alias("own"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    others = F.concat(F.transform(upto(F.col("k1")), lambda j: at(F.col("b"), j, True, F.lit(0))), F.transform(upto(F.col("k2")), lambda j: at(F.least("b", j), F.greatest("b", j), False, F.col("b"))))
    largest = F.transform(upto(F.col("k2")), lambda j: at(j, F.col("b"), True, F.lit(1)))
    return dealt.withColumn("m", F.explode(F.when(F.col("minor"), others).otherwise(largest))).select("bucket", "key", "c", "m.*")


def _who_meets(group: pa.Table) -> np.ndarray:
    """Which two rows of a meeting belong to different components and, where two blocks meet, to different blocks."""
    numbers: dict[bytes, int] = {}
    label = np.array([numbers.setdefault(c, len(numbers)) for c in group.column("c").to_pylist()])
    own = group.column("own").to_numpy()
    out = label[:, None] != label[None, :]
    if group.column("cross")[0].as_py() or group.column("p")[0].as_py() != group.column("q")[0].as_py():
        out &= own[:, None] != own[None, :]  # a pair within one block is compared where that block meets itself
    return np.tril(out, -1)


def _enough(common: np.ndarray, n: np.ndarray, tenths: int) -> np.ndarray:
    """Whether so many words in common, an upper bound of the aligned ones, would do for each two texts."""
    return (10 + tenths) * common >= tenths * (n[:, None] + n[None, :])


def near_classes(documents: DataFrame, sketches: int = 48, tenths: int = 8, block: int = 256, bag_block: int = 4096, hubs_met: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, text_key, class_id, kept: one row for each row of documents."""
    drawn = C.cut(sketch(documents, sketches, tenths))
    n_rows = drawn.count()
    classes = drawn.filter("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "text_key")).alias("own"), F.first("buckets").alias("buckets"), F.count("*").alias("n"))
    spread = classes.select("key", F.explode("buckets").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")  # only buckets with several classes
    members = C.cut(C.join_by_key(spread, sizes.withColumn("size", F.col("n")), "bucket", F.xxhash64("key"), total=2 * sketches * n_rows).filter("size is not null"))
    n_members = members.count()
    owners = C.cut(classes.join(members.select("key").distinct(), "key", "left_semi").select("key", "own.doc_id", "own.text_key"))
    texts = (
        documents.select("doc_id", "text", text_key().alias("text_key")).alias("d")
        .join(broadcast_if_small(owners, broadcast_rows).alias("o"), (F.col("d.text_key") == F.col("o.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("o.doc_id")))
        .select("key", "text").dropDuplicates(["key"])
    )
    texts = C.cut(with_bags(texts))
    C.uncut(owners)

    # First round. The original of many copies is nearer to them than they are to each other, and so shares most buckets.
    degree = members.groupBy("key").agg(F.sum("size").alias("degree"))
    placed = members.join(degree, "key").select("bucket", "key", "degree")
    hubs = placed.groupBy("bucket").agg(F.max(F.struct("degree", "key")).alias("hub"), F.count("*").alias("n"))
    found = C.join_by_key(placed, hubs, "bucket", F.xxhash64("key"), total=n_members).filter("hub.key <> key")
    met = found.groupBy("key", "hub").agg(F.count("*").alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("n", "hub")), False), 1, hubs_met)  # a class has at most two hubs a sketch
    first = met.groupBy("key").agg(best.alias("best")).select("key", F.explode("best").alias("m")).select("key", "m.hub.*").toDF("key", "degree", "hub")
    # A hub has at most so many followers as its degree; they meet its text in parts.
    parts = F.ceil(F.col("degree") / (4 * block)).cast("int")
    first = C.cut(first.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int")))
    paired = first.select("key", "hub", "part").join(texts.select("key", "text"), "key")
    hub_texts = first.select("hub", "degree").distinct().join(texts.select(F.col("key").alias("hub"), F.col("text").alias("hub_text")), "hub")
    paired = paired.join(hub_texts.select("hub", "hub_text", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), ["hub", "part"])

    def compare(batches):
        cache = Hashes()
        last: tuple[str | None, list[int]] = (None, [])
        for batch in (p for b in batches for p in C.pieces(b)):
            good = []
            for t, h in zip(C.texts(batch), C.texts(batch, "hub_text")):
                if h != last[0]:
                    last = (h, _sequences([h], cache)[0].tolist())
                good.append(near(_sequences([t], cache)[0].tolist(), last[1], tenths))
            yield batch.filter(pa.array(good, type=pa.bool_())).select(["a", "b"])
        C.give_back()

    links_kind = C.schema_of("a binary, b binary")
    one = C.cut(paired.select(F.col("hub").alias("a"), F.col("key").alias("b"), "text", "hub_text").mapInArrow(compare, links_kind))
    C.uncut(first)
    labels = components(one)
    C.uncut(one)

    # Second round.
    placed = members.select("bucket", "key").join(labels.select(F.col("v").alias("key"), "c"), "key", "left").select("bucket", "key", F.coalesce("c", "key").alias("c"))
    with_bag = _several(placed, bag_block, n_members).join(texts.select("key", "bag"), "key")

    def alive(group: pa.Table) -> pa.Table:
        """The members of a meeting that may have a near one outside their component, by their bags of words."""
        meets, n_rows = _who_meets(group), group.num_rows
        bags = np.frombuffer(b"".join(group.column("bag").to_pylist()), dtype="<u4").reshape(n_rows, _BAG).astype(np.int32)
        n = bags.sum(axis=1)
        live = np.zeros(n_rows, dtype=bool)
        for i in range(n_rows):
            own = np.flatnonzero(meets[i])
            if len(own):
                good = own[(10 + tenths) * np.minimum(bags[own], bags[i]).sum(axis=1) >= tenths * (n[own] + n[i])]
                live[good] = True
                live[i] |= len(good) > 0
        return group.filter(pa.array(live)).select(["bucket", "key", "c"])

    live = C.cut(C.by_group(with_bag, ["bucket", "cross", "p", "q"], "bucket bigint, key binary, c binary", lambda: alive).distinct())
    with_text = _several(live, block, n_members).join(texts.select("key", "text"), "key")

    def within(group: pa.Table) -> pa.Table:
        labels_ = group.column("c").to_pylist()
        seqs = _sequences([t or "" for t in group.column("text").to_pylist()], Hashes())
        n = np.array([len(s) for s in seqs])
        common = shared(seqs)
        good = _who_meets(group) & _enough(common, n, tenths)
        pairs = np.argwhere(good)
        root = {c: c for c in labels_}

        def find(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b, lists = [], [], {}
        for i, j in pairs[np.argsort(-common[good] / (n[pairs[:, 0]] + n[pairs[:, 1]]), kind="stable")] if len(pairs) else ():
            x, y = find(labels_[i]), find(labels_[j])
            if x == y:
                continue
            for k in (i, j):
                if k not in lists:
                    lists[k] = seqs[k].tolist()
            if near(lists[i], lists[j], tenths):
                root[max(x, y)] = min(x, y)
                a.append(min(x, y))
                b.append(max(x, y))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    two = C.cut(C.by_group(with_text, ["bucket", "cross", "p", "q"], links_kind, lambda: within).distinct())  # links between labels
    C.uncut(members, texts, live)
    if two.limit(1).count():
        joined = components(two).select(F.col("v").alias("l"), F.col("c").alias("further"))
        every = labels.select("v", "c").union(joined.select(F.col("l").alias("v"), F.col("l").alias("c"))).distinct()  # a class without links is its own label
        every = every.groupBy("v").agg(F.min("c").alias("l"))
        counts = every.groupBy("l").agg(F.count("*").alias("n"))
        labels = C.join_by_key(every, joined.join(counts, "l"), "l", F.xxhash64("v"), total=n_members).select("v", F.coalesce("further", "l").alias("c"))
    labels = C.cut(labels.select(F.col("v").alias("key"), "c").join(classes.select("key", "n"), "key"))
    spread_by = F.xxhash64("doc_id", "text_key")  # copies of one text, and members of one class, may be a large part of all rows
    named = C.cut(C.join_by_key(drawn.select("doc_id", "text_key", "key"), labels, "key", spread_by, total=n_rows).select("doc_id", "text_key", F.coalesce("c", "key").alias("c")))
    C.uncut(drawn, two, labels)
    names = named.filter("c is not null").groupBy("c").agg(
        F.min("doc_id").alias("class_id"), F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best"), F.count("*").alias("n")
    ).filter("n > 1")
    out = C.join_by_key(named, names, "c", spread_by, total=n_rows)
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    return out.select("doc_id", "text_key", F.when(F.col("best").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("best").isNotNull(), best).otherwise(True).alias("kept"))


def dedup(documents: DataFrame, broadcast_rows: int = 200_000, **options) -> DataFrame:
    """One document of each class, with all its columns: the one with the smallest doc_id, of repeated rows (equal doc_id and text) one."""
    named = C.cut(near_classes(documents, broadcast_rows=broadcast_rows, **options).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "kept"))
    same = lambda df: documents.join(broadcast_if_small(df, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left_anti")
    gone = named.filter("not kept").select("__id", "__key").distinct()
    repeated = named.filter("kept").groupBy("__id", "__key").agg(F.count("*").alias("__n")).filter("__n > 1").select("__id", "__key")
    again = C.cut(repeated)
    if not again.limit(1).count():
        return same(C.cut(gone))
    rows = documents.join(broadcast_if_small(again, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key() == F.col("__key")), "left_semi")
    return same(C.cut(gone.union(again))).union(rows.dropDuplicates(["doc_id", "text"]))


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_classes(C.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")
