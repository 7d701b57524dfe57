"""LM scoring (operator 1): an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark over every training text. A task turns its texts into
runs of (context, word, count) with 64-bit word hashes, already summed within
the task, and sends them on by the hash of the pair: a frequent context or word
is spread over all shards. A shard adds its counts up, writes them as a sorted
hash array with counts, and passes on what it knows of contexts (their totals
and how many followers they have once, twice, more often) and of words (the
number of different contexts, which is the lower order of the model). Word
shards add these up into sorted arrays of their own.

Scoring reads the texts once more. Workers map the arrays into memory from the
shared folder, look up each different pair of a batch once, in sorted order, and
add up log10 probabilities. Where the shared folder is not a local path, the
worker copies an array to an unlinked temporary file and maps that.

Tokens: text with A-Z in lower case, split at the ASCII white space of the
contract, then one end token; the model begins each text with a start context.

Defined results: null text is the empty text, whose only token is the end; a
word that training has not seen gets the share of the uniform distribution; with
no training text all probabilities are 1 for lack of any other word; repeated
rows count each time and get a row each; a null doc_id counts as the text ''.

Scale: the driver sees one row of numbers for each shard. Shards hold about
``shard_bytes`` of text each, so their number follows the input.
"""

from __future__ import annotations

import math
import struct
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C

START, END = b" <s>", b" </s>"  # no word holds a space
_CHUNK = 3_000_000  # tokens that a worker sums at once
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def tokens_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def pair_hash(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    x = (h1 * _K1) ^ ((h2 ^ (h2 >> np.uint64(29))) * _K2)
    x ^= x >> np.uint64(32)
    x *= _K3
    return x ^ (x >> np.uint64(31))


class Chunk:
    """Texts as one array of word ids that hold within the chunk."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {START: 0, END: 1}
        self.words: list[list[int]] = []
        self.size = 0

    def add(self, text: str) -> int:
        """The number of tokens, its end among them."""
        put = self.ids.setdefault
        own = [put(w, len(self.ids)) for w in tokens_of(text)]
        own.append(1)
        self.words.append(own)
        self.size += len(own) + 1
        return len(own)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each id, and the ids of contexts and words of all positions."""
        import xxhash

        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.ids), dtype=np.uint64, count=len(self.ids))
        flat = np.empty(self.size, dtype=np.int64)
        at, first = 0, []
        for own in self.words:
            flat[at] = 0
            flat[at + 1 : at + 1 + len(own)] = own
            first.append(at)
            at += 1 + len(own)
        keep = np.ones(max(0, self.size - 1), dtype=bool)
        keep[np.array(first[1:], dtype=np.int64) - 1] = False  # the end of a text is no context
        return h, flat[:-1][keep], flat[1:][keep]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of the types that _unpack is told, behind their lengths."""
    return struct.pack(f"<{len(arrays)}Q", *(len(a) for a in arrays)) + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(data, kinds: str) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds.split())}Q", data)
    at, out = 8 * len(sizes), []
    for n, kind in zip(sizes, kinds.split()):
        out.append(np.frombuffer(data, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


def _squeeze(*arrays: np.ndarray) -> bytes:
    """_pack for the way between tasks: small numbers take few bytes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(_pack(*arrays))


def _expand(data: bytes, kinds: str) -> list[np.ndarray]:
    import zstandard

    return _unpack(zstandard.ZstdDecompressor().decompress(data), kinds)


def _small(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as single bytes; those from 255 on are 255, with their positions and values beside them."""
    large = np.flatnonzero(a >= 255)
    return np.minimum(a, 255).astype("u1"), large.astype("u8"), a[large].astype("u8")


#: Between tasks - contexts, length of their runs, different words, the word of each pair, counts.
_SENT = "u8 u4 u8 u4 u4"
#: Files - pairs: hash, count, positions and values of large counts; words: hash, count, contexts before it, total after it, followers once, twice, more.
_PAIRS, _WORDS = "u8 u1 u8 u8", "u8 u8 u4 u8 u4 u4 u4"


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return (keys[starts], *(np.add.reduceat(v[order], starts) for v in values))


def _by_shard(h: np.ndarray, bits: int) -> list[tuple[int, np.ndarray]]:
    """(shard, positions in order) for the top bits of a hash."""
    shard = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), dtype=np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1]]) if len(h) else []
    return [(int(shard[order[a]]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(h)])]


def _spread(key: np.ndarray) -> np.ndarray:
    """Word hashes dealt anew, so that a word's shard does not follow the pair's."""
    return (key ^ (key >> np.uint64(33))) * _K1


def _flush(chunk: Chunk, bits: int) -> list[tuple[int, bytes]]:
    h, left, right = chunk.arrays()
    pairs, counts = np.unique((left << 32) | right, return_counts=True)
    left, right = h[pairs >> 32], h[pairs & 0xFFFFFFFF]
    rows = []
    for shard, at in _by_shard(pair_hash(left, right), bits):
        own = left[at]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        words, which = np.unique(right[at], return_inverse=True)
        rows.append((shard, _squeeze(own[starts], np.diff(np.r_[starts, len(own)]).astype("u4"), words, which.astype("u4"), counts[at].astype("u4"))))
    return rows


def _write(folder: str, name: str, data: bytes) -> str:
    fs, at = C.filesystem(folder)
    fs.create_dir(at, recursive=True)
    path = f"{name}-{uuid.uuid4().hex}.arrays"
    with fs.open_output_stream(f"{at}/{path}", compression=None) as out:
        out.write(data)
    return f"{folder}/{path}"


def _mapped(path: str, kinds: str) -> list[np.ndarray]:
    """The arrays of a file, mapped into memory."""
    from pyarrow import fs as pfs

    fs, at = C.filesystem(path)
    if isinstance(fs, pfs.LocalFileSystem):
        return _unpack(np.memmap(at, dtype="u1", mode="r"), kinds)
    with fs.open_input_stream(at, compression=None) as f, tempfile.TemporaryFile() as own:
        while piece := f.read(1 << 24):
            own.write(piece)
        own.flush()
        return _unpack(np.memmap(own, dtype="u1", mode="r"), kinds)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams that occur 1 to 4 times; a half, one, one and a half where those are missing."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) <= 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05 * k), float(k)) for k, d in zip((1, 2, 3), found))  # type: ignore[return-value]


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *d))[np.minimum(c, 3).astype(np.int64)]


def train(documents: DataFrame, text: str = "text", shard_bytes: int = 24 << 20) -> dict:
    """Counts the model over all rows; returns its files and totals, which fit a closure."""
    spark = documents.sparkSession
    C.bound_batches(spark)
    folder = C.new_folder(spark, "ngrams")
    docs = documents.select(F.col(text).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, math.ceil(math.log2(max(1, size / shard_bytes))))
    sent = C.schema_of("shard int, pairs binary")
    passed = C.schema_of("shard int, stats binary, path string, n1 long, n2 long, n3 long, n4 long")
    done = C.schema_of("shard int, path string, types long, tokens long, contexts long, n1 long, n2 long, n3 long, n4 long")

    def count(batches):
        schema, chunk = C.arrow_schema(sent), Chunk()

        def out():
            for shard, pairs in _flush(chunk, bits):
                yield C.to_batch({"shard": [shard], "pairs": [pairs]}, schema)

        for batch in batches:
            for t in C.texts(batch):
                chunk.add(t)
                if chunk.size >= _CHUNK:
                    yield from out()
                    chunk = Chunk()
        if chunk.size:
            yield from out()
        del chunk
        C.give_back()

    def add_pairs(group: pa.Table) -> pa.Table:
        parts = [_expand(x, _SENT) for x in group.column("pairs").to_pylist()]
        left = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
        right = np.concatenate([p[2][p[3]] for p in parts])
        counts = np.concatenate([p[4] for p in parts]).astype("u8")
        del parts
        key = pair_hash(left, right)
        order = np.argsort(key, kind="stable")
        key, left, right, counts = key[order], left[order], right[order], counts[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, left, right, counts = key[starts], left[starts], right[starts], np.add.reduceat(counts, starts)
        shard = group.column("shard")[0].as_py()
        path = _write(folder, f"pairs-{shard:08d}", _pack(key, *_small(counts)))
        one = np.ones(len(key), dtype="u4")
        context = _sum_by(left, counts, (counts == 1).astype("u4"), (counts == 2).astype("u4"), (counts > 2).astype("u4"))
        word = _sum_by(right, counts, one)
        # A row for each word of either kind: word, count, contexts before it, total after it, followers once, twice, more
        both = _sum_by(
            np.r_[context[0], word[0]],
            *(np.r_[np.zeros(len(context[0]), "u8"), word[k].astype("u8")] for k in (1, 2)),
            *(np.r_[context[k].astype("u8"), np.zeros(len(word[0]), "u8")] for k in (1, 2, 3, 4)),
        )
        rows = {k: [] for k in passed.names}
        for k, (to, at) in enumerate(_by_shard(_spread(both[0]), bits)):
            rows["shard"].append(to)
            rows["stats"].append(_squeeze(both[0][at], *(both[c][at].astype("u4") for c in range(1, 7))))
            rows["path"].append(path if k == 0 else None)
            for n in (1, 2, 3, 4):
                rows[f"n{n}"].append(int((counts == n).sum()) if k == 0 else None)
        return pa.Table.from_batches([C.to_batch(rows, C.arrow_schema(passed))])

    def add_words(group: pa.Table) -> pa.Table:
        parts = [_expand(x, "u8 u4 u4 u4 u4 u4 u4") for x in group.column("stats").to_pylist()]
        key, *values = _sum_by(np.concatenate([p[0] for p in parts]), *(np.concatenate([p[c] for p in parts]).astype("u8") for c in range(1, 7)))
        # In the order of the hash that dealt them, so that a look-up finds the shard by its top bits.
        order = np.argsort(_spread(key), kind="stable")
        key, values = _spread(key)[order], [v[order] for v in values]
        shard = group.column("shard")[0].as_py()
        path = _write(folder, f"words-{shard:08d}", _pack(key, *(v.astype(k) for v, k in zip(values, _WORDS.split()[1:]))))
        row = {"shard": shard, "path": path, "types": int((values[0] > 0).sum()), "tokens": int(values[0].sum()), "contexts": int(values[1].sum())}
        rows = [row | {f"n{n}": int((values[1] == n).sum()) for n in (1, 2, 3, 4)}]
        # What the pair shards say of themselves travels along.
        for r in group.select(["path", "n1", "n2", "n3", "n4"]).to_pylist():
            if r["path"]:
                rows.append(dict.fromkeys(done.names) | r)
        return pa.Table.from_batches([C.to_batch({k: [r[k] for r in rows] for k in done.names}, C.arrow_schema(done))])

    first = docs.mapInArrow(count, sent).groupBy("shard").applyInArrow(add_pairs, passed)
    rows = first.groupBy("shard").applyInArrow(add_words, done).collect()
    words, pairs = [r for r in rows if r.shard is not None], [r for r in rows if r.shard is None]
    total = lambda rows, k: sum(r[k] for r in rows)
    n_of = lambda rows: [total(rows, f"n{n}") for n in (1, 2, 3, 4)]
    at = lambda rows: {int(r.path.rpartition("-")[0].rpartition("-")[2]): r.path for r in rows}
    return {
        "bits": bits, "pairs": at(pairs), "words": at(words), "types": total(words, "types"), "tokens": total(words, "tokens"),
        "contexts": total(words, "contexts"), "low": n_of(words), "high": n_of(pairs),
    }


class Model:
    """Probabilities from mapped arrays, in a worker."""

    def __init__(self, files: dict) -> None:
        self.f = files
        self.low, self.high = discounts(files["low"]), discounts(files["high"])
        self.maps: dict[tuple[str, int], list[np.ndarray]] = {}
        n1, n2 = files["low"][:2]
        spare = self.low[0] * n1 + self.low[1] * n2 + self.low[2] * max(0, files["types"] - n1 - n2)
        self.uniform = (spare / files["contexts"] if files["contexts"] else 1.0) / (files["types"] + 1)

    def _look_up(self, what: str, kinds: str, q: np.ndarray) -> list[np.ndarray]:
        """The values beside the hashes; 0 where there is none. q is sorted."""
        out = [np.zeros(len(q), dtype=np.int64) for _ in kinds.split()[1:]]
        for shard, at in _by_shard(q, self.f["bits"]):
            path = self.f[what].get(shard)
            if path is None:
                continue
            if (what, shard) not in self.maps:
                self.maps[what, shard] = _mapped(path, kinds)
            key, *values = self.maps[what, shard]
            i = np.minimum(np.searchsorted(key, q[at]), len(key) - 1)
            found = key[i] == q[at]
            i, to = i[found], at[found]
            if what == "words":
                for o, v in zip(out, values):
                    o[to] = v[i]
            elif len(i):
                n = values[0][i].astype(np.int64)
                if len(large := np.flatnonzero(n == 255)):
                    n[large] = values[2][np.searchsorted(values[1], i[large])]
                out[0][to] = n
        return out

    def words(self, h: np.ndarray) -> list[np.ndarray]:
        """For word hashes: count, probability of the lower order, total as a context, weight of the lower order."""
        q = _spread(h)
        order = np.argsort(q)
        c, before, total, n1, n2, n3 = (np.empty(len(h), np.int64) for _ in range(6))
        for to, v in zip((c, before, total, n1, n2, n3), self._look_up("words", _WORDS, q[order])):
            to[order] = v
        p = np.maximum(before - _discount(before, self.low), 0) / max(1, self.f["contexts"]) + self.uniform
        spare = (self.high[0] * n1 + self.high[1] * n2 + self.high[2] * n3) / np.maximum(total, 1)
        return [c, p, total, np.where(total > 0, spare, 1.0)]

    def score(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens, score and base score of each text of the chunk."""
        h, left, right = chunk.arrays()
        c, p, total, spare = self.words(h)
        pairs, back = np.unique((left << 32) | right, return_inverse=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        key = pair_hash(h[a], h[b])
        order = np.argsort(key)
        n = np.empty(len(key), np.int64)
        n[order] = self._look_up("pairs", _PAIRS, key[order])[0]
        prob = np.maximum(n - _discount(n, self.high), 0) / np.maximum(total[a], 1) + spare[a] * p[b]
        base = np.log10((c + 0.1) / (self.f["tokens"] + 0.1 * (self.f["types"] + 1)))
        sizes = [len(w) for w in chunk.words]
        starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        return np.add.reduceat((c > 0).astype(np.int64)[right], starts), np.add.reduceat(np.log10(prob)[back], starts), np.add.reduceat(base[right], starts)


def score(documents: DataFrame, files: dict, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_tokens, n_known, train_tokens, base_score, score and perplexity of each whole text."""
    kinds = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep)

    def make():
        model = Model(files)

        def run(batch):
            n_tokens, parts, chunk = [], [], Chunk()
            for t in C.texts(batch):
                n_tokens.append(chunk.add(t))
                if chunk.size >= _CHUNK // 2:
                    parts.append(model.score(chunk))
                    chunk = Chunk()
            if chunk.words:
                parts.append(model.score(chunk))
            known, own, base = (np.concatenate(x) for x in zip(*parts))
            out = {"n_tokens": n_tokens, "n_known": known, "train_tokens": [files["tokens"]] * len(n_tokens), "base_score": base, "score": own}
            return out | {"perplexity": 10 ** (-own / np.array(n_tokens))} | {k: C.column(batch, k) for k in keep}

        return run

    return C.map_batches(documents.select(*keep, "text"), f"{kinds}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double", make)


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", (C.fold_of(F.col("doc_id"), 10) == 0).alias("held_out"))
    return score(docs, train(docs.filter(~F.col("held_out"))), ("doc_id", "held_out"))
