"""Benchmark decontamination (operator 6): one Aho-Corasick automaton over word windows.

Benchmark items are cut into windows of ``n`` consecutive words; an item with
fewer words, but not none, is one window. Each document is normalised to words and
scanned once, so a match always covers whole words. Hits are reported as word
spans and mapped back to character offsets of the original text.

Defined results: null and empty texts have no words and no hits; items without
words never match; items with equal windows all count as occurring; windows of
items without an id are hits that name no item with ``null_items``, as in the
query and the pipeline, and left out without; repeated
document rows each get their own row; other columns of either table are ignored.

Scale: documents are never shuffled. The automaton's letters are the benchmark's
words, so that it has a node a word, not a character, and a text is one letter a
word to it. Patterns travel to the workers in blocks of at most ``block_chars``
characters (a documented memory bound), through the shared folder. A benchmark
of one block has one automaton, built once a task. A larger one is scanned block by
block: a task holds its texts, up to ``hold_bytes`` of them, builds each automaton
once, and scans them all before it builds the next.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C

#: Word bytes of the UTF-8 text stay, A-Z becomes a-z, all else becomes a space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], n: int) -> list[bytes]:
    if not words:
        return []
    return [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]


def _pattern_blocks(rows: list[tuple[str | None, str]], n: int, block_chars: int) -> list[list[tuple[str, int, list[str]]]]:
    """(window, number of words, item ids) in blocks of bounded size."""
    owners: dict[bytes, set[str]] = defaultdict(set)
    for item, text in rows:
        for w in windows_of(words_of(text), n):
            owners[w].update(() if item is None else (item,))
    blocks: list[list[tuple[str, int, list[str]]]] = [[]]
    room = block_chars
    for w in sorted(owners):
        if room < len(w) and blocks[-1]:
            blocks.append([])
            room = block_chars
        room -= len(w)
        blocks[-1].append((w.decode("utf-8", "surrogatepass"), w.count(b" ") + 1, sorted(owners[w])))
    return blocks


class Patterns:
    """One automaton over the windows of a block, whose letters are words."""

    def __init__(self, block: list[tuple[str, int, list[str]]]) -> None:
        import ahocorasick

        self.items = [items for _, _, items in block]
        self.letters: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()
        for i, (window, n, _) in enumerate(block):
            words = window.encode("utf-8", "surrogatepass").split()
            for w in words:
                if w not in self.letters:
                    k = len(self.letters) + 1
                    self.letters[w] = chr(k if k < 0xD800 else k + 0x800)  # past the surrogates
            self.automaton.add_word("".join(map(self.letters.__getitem__, words)), (i, n))
        self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, word after the last, number of the window) of each match."""
        if not words:
            return []
        get = self.letters.get
        text = "".join([get(w, "\x00") for w in words])
        return [(end - n + 1, end + 1, i) for end, (i, n) in self.automaton.iter(text)]


def _original_offsets(text: str) -> list[tuple[int, int]]:
    """Start and end of each word in code points of the text, in order."""
    import re

    return [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(_LOWER))]


_LOWER = {i: i + 32 for i in range(0x41, 0x5B)}


def _publish(benchmark: DataFrame, n: int, block_chars: int, null_items: bool) -> list[str]:
    """Writes the pattern blocks into the shared folder; the paths.

    The benchmark's rows pass the driver in pieces of bounded size and go out as
    files: nothing that grows is held or broadcast.
    """
    folder = C.new_folder(benchmark.sparkSession, "automaton")
    fs, base = C.filesystem(folder)
    fs.create_dir(base, recursive=True)
    paths: list[str] = []

    def put(rows: list[tuple[str | None, str]]) -> None:
        for block in _pattern_blocks(rows, n, block_chars):
            if block:
                name = f"{len(paths):05d}.pickle"
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(pickle.dumps(block))
                paths.append(f"{folder}/{name}")

    rows, held = [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    for row in (items if null_items else items.filter("item is not null")).toLocalIterator(prefetchPartitions=True):
        rows.append((row.item, row.text))
        held += len(row.text) * n
        if held > block_chars:
            put(rows)
            rows, held = [], 0
    put(rows)
    return paths


def _load(path: str) -> Patterns:
    fs, p = C.filesystem(path)
    with fs.open_input_stream(p) as f:
        return Patterns(pickle.loads(f.read()))


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    own: list[list[int]] = []
    for s, e in sorted(spans):
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    return own


def _scan_pieces(paths: list[str], batches: Iterator[pa.RecordBatch], hold_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[list[int]], list[str]]]]]:
    """Each piece of the batches with its texts' numbers of words, merged hit spans in words, and items."""
    kept = [_load(paths[0])] if len(paths) == 1 else None
    held: list[pa.RecordBatch] = []

    def scan_held():
        hits: list[list[list[tuple[int, int]]]] = [[[] for _ in range(p.num_rows)] for p in held]
        items: list[list[set[str]]] = [[set() for _ in range(p.num_rows)] for p in held]
        n_words: list[list[int]] = [[0] * p.num_rows for p in held]
        for patterns in kept or (map(_load, paths) if paths else [None]):
            for k, piece in enumerate(held):
                for row, text in enumerate(C.texts(piece)):
                    words = words_of(text)
                    n_words[k][row] = len(words)
                    for s, e, i in patterns.hits(words) if patterns else ():
                        hits[k][row].append((s, e))
                        items[k][row].update(patterns.items[i])
        for k, piece in enumerate(held):
            yield piece, [(n, _merged(h), sorted(x)) for n, h, x in zip(n_words[k], hits[k], items[k])]

    for batch in batches:
        for piece in C.pieces(batch):
            held.append(piece)
            if len(paths) <= 1 or sum(p.nbytes for p in held) >= hold_bytes:
                yield from scan_held()
                held = []
    if held:
        yield from scan_held()
    C.give_back()


def scan(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_chars: int = 8_000_000, null_items: bool = False, hold_bytes: int = 128 << 20) -> DataFrame:
    """doc_id, n_words, hit_words (merged spans of word numbers), spans (the same in code points of the text), items."""
    C.bound_batches(documents.sparkSession)
    paths = _publish(benchmark, n, block_chars, null_items)
    kind = documents.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:bigint,end:bigint>>"
    schema = C.schema_of(f"doc_id {kind}, n_words bigint, hit_words {span}, spans {span}, items array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = C.arrow_schema(schema)
        for piece, found in _scan_pieces(paths, batches, hold_bytes):
            spans = []
            for text, (_, own, _) in zip(C.texts(piece), found):
                at = _original_offsets(text) if own else []
                spans.append([{"start": at[s][0], "end": at[e - 1][1]} for s, e in own])
            hit_words = [[{"start": s, "end": e} for s, e in own] for _, own, _ in found]
            yield C.to_batch({"doc_id": C.column(piece, "doc_id"), "n_words": [x[0] for x in found], "hit_words": hit_words, "spans": spans, "items": [x[2] for x in found]}, out)

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = 10, block_chars: int = 8_000_000, null_items: bool = False, hold_bytes: int = 128 << 20) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns, in one pass without a shuffle."""
    C.bound_batches(documents.sparkSession)
    paths = _publish(benchmark, n, block_chars, null_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found in _scan_pieces(paths, batches, hold_bytes):
            yield piece.filter(pa.array([not own for _, own, _ in found], type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The result that the contract of the query names."""
    n_hit = F.expr("aggregate(hit_words, 0L, (a, x) -> a + x.end - x.start)")
    return scanned.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return digest(scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), null_items=True))


def brute_force(documents: list[tuple], benchmark: list[tuple], n: int = 10) -> list[tuple]:
    """The same digest by comparing every window with every position; for tests."""
    import re

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for doc_id, text in documents:
        words, hit, items = split(text), set(), set()
        for item, question in benchmark:
            q = split(question)
            for i in range(max(1, len(q) - n + 1) if q else 0):
                w = q[i : i + n]
                for j in range(len(words) - len(w) + 1):
                    if words[j : j + len(w)] == w:
                        hit.update(range(j, j + len(w)))
                        items.add(str(item))
        listed = ",".join(sorted(items))
        out.append((doc_id, len(words), len(hit), len(items), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out
