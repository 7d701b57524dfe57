"""Toxicity (operator 4): a linear-chain conditional random field over tokens.

Token labels: the tables label documents, so tokens of toxic training documents
are labelled by evidence. A word, or a word beginning, that is far more frequent
in toxic than in clean training documents marks its tokens as toxic; all other
tokens are clean. Toxic documents without any marked token are left out of the
field's training.

The field has two states. A token's features are its word, its beginnings and
endings, hashed; neighbours act through the transitions. It is fitted by full
gradients from batched forward-backward passes. A document's score is a logistic
function of its marginals (their largest, their sum, how many reach a half) and
its length, fitted on training documents that the field has not seen, weighted to
the classes' shares among all training labels; offending offsets are the runs of
tokens with a marginal of a half or more.

Of near copies in the sample only one is used: they are no independent evidence.
Learning uses only rows of ``labels`` whose fold is not 0, at most ``per_class``
documents of each class (lowest seeded hashes) with at most ``train_chars``
characters each: a documented bound, a sample for fitting only. Scoring covers
every document and its whole text. Labels, lang, source and doc_id are no input
of a score.

Defined results: null and empty texts have no tokens and get the score of no
evidence; repeated label rows of a document count as toxic if one of them does;
of documents with one doc_id the fit takes the least text; null labels are ignored; if a class is missing, every score is 0 and nothing is
predicted toxic; repeated documents get a row each.

Scale: one pass over the documents without a shuffle; the sample is found on the
labels alone and fetched with a broadcast of its at most 2 * per_class ids. The
weights are a fixed 1 MB.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common as C

_TOKEN = re.compile(r"[^\W\d_]+")
BITS = 17


def tokens_of(text: str) -> list[str]:
    """Words in lower case, one for each match of the pattern in the text itself."""
    low = text.lower()
    return _TOKEN.findall(low) if len(low) == len(text) else [w.lower() for w in _TOKEN.findall(text)]


def _marks(word: str) -> list[str]:
    """What may mark a token as toxic: its word and its longer beginnings."""
    return [f"w {word}", *(f"b {word[:k]}" for k in (4, 5, 6) if len(word) > k)]


_SEEDS = {k: zlib.crc32(k.encode()) for k in ("word", "begin", "end", "size")}
_SIZES = [zlib.crc32(bytes([n]), _SEEDS["size"]) & ((1 << BITS) - 1) for n in range(16)]


def _features(word: str) -> list[int]:
    """Hashed: the word, its first two to six and last two to four bytes, its length."""
    raw, mask = word.encode("utf-8", "surrogatepass"), (1 << BITS) - 1
    n, crc, begin, end = len(raw), zlib.crc32, _SEEDS["begin"], _SEEDS["end"]
    out = [crc(raw, _SEEDS["word"]) & mask, _SIZES[min(n, 15)]]
    out += [crc(raw[:k], begin) & mask for k in range(2, min(n, 6) + 1)]
    out += [crc(raw[-k:], end) & mask for k in range(2, min(n, 4) + 1)]
    return out


def marginals(emit: np.ndarray, sizes: np.ndarray, step: np.ndarray, start: np.ndarray, learning: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For padded rows of log odds (rows x tokens): the marginals of the toxic state and, for learning, the expected transitions summed over all rows.

    step[i, j] and start[j] are log weights; rows must be ordered by falling size.
    """
    rows, length = emit.shape
    odds = np.exp(np.clip(emit, -30, 30))
    e0, e1 = 1 / (1 + odds), odds / (1 + odds)
    t = np.exp(step - step.max())
    s = np.exp(start - start.max())
    live = (sizes[None, :] > np.arange(length)[:, None]).sum(axis=1)  # rows that reach each token
    a = np.zeros((length, rows, 2))
    b = np.ones((length, rows, 2))
    for k in range(length):
        n = live[k]
        prior = np.broadcast_to(s, (n, 2)) if k == 0 else a[k - 1, :n] @ t
        now = prior * np.stack((e0[:n, k], e1[:n, k]), axis=1)
        a[k, :n] = now / now.sum(axis=1, keepdims=True)
    for k in range(length - 2, -1, -1):
        n = live[k + 1]
        back = (b[k + 1, :n] * np.stack((e0[:n, k + 1], e1[:n, k + 1]), axis=1)) @ t.T
        b[k, :n] = back / back.sum(axis=1, keepdims=True)
    p = a * b
    total = p.sum(axis=2)
    moves = np.zeros((2, 2))
    if learning and length > 1:
        e = np.stack((e0.T[1:], e1.T[1:]), axis=2)
        pair = a[:-1, :, :, None] * t * (b[1:] * e)[:, :, None, :]
        weight = pair.sum(axis=(2, 3), keepdims=True)
        reach = np.arange(1, length)[:, None] < sizes[None, :]
        moves = np.where(reach[:, :, None, None], pair / np.maximum(weight, 1e-300), 0).sum(axis=(0, 1))
    return np.where(total > 0, p[:, :, 1] / np.maximum(total, 1e-300), 0).T, moves


def _padded(rows: list[np.ndarray], fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows])
    out = np.full((len(rows), sizes.max(initial=0)), fill, dtype=rows[0].dtype if rows else float)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out, sizes


class Emissions(dict):
    """Log odds of words under a field, kept for words seen before."""

    def __init__(self, field: Field) -> None:
        super().__init__()
        self.weights, self.bias = field.w.tolist(), float(field.bias[0])

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        e = self[word] = self.bias + sum(map(self.weights.__getitem__, _features(word)))
        return e


def _without_copies(docs: list[list[str]], hashes: int = 6) -> list[int]:
    """The first of each group of documents that share a minimum hash of their word pairs: copies are no independent evidence."""
    seen: set[tuple[int, int]] = set()
    out = []
    for k, words in enumerate(docs):
        pairs = {zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(words, words[1:])} or {zlib.crc32(" ".join(words).encode("utf-8", "surrogatepass"))}
        h = np.fromiter(pairs, dtype=np.uint64)
        own = {(i, int((((h + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)).min())) for i in range(hashes)}
        if not own & seen:
            out.append(k)
        seen |= own
    return out


class Field:
    """The fitted field and document scorer."""

    def __init__(self) -> None:
        self.w = np.zeros(1 << BITS)
        self.step, self.start = np.zeros((2, 2)), np.zeros(2)
        self.final = np.zeros(5)
        self.bias = np.zeros(1)
        self.ready = False

    def fit(self, docs: list[list[str]], toxic: np.ndarray, share: float = 0.5, rounds: int = 30, ridge: float = 0.5) -> Field:
        """share: of toxic documents among all labelled ones, which the sample need not keep."""
        if not (toxic == 1).any() or not (toxic == 0).any():
            return self
        alone = _without_copies(docs)
        docs, toxic = [docs[k] for k in alone], toxic[alone]
        marked = self._marked(docs, toxic)
        held = np.arange(len(docs)) % 3 == 2
        if not marked or held.all():
            return self
        ids: dict[str, int] = {}
        rows, gold = [], []
        for k, words in enumerate(docs):
            own = np.array([bool(toxic[k]) and any(m in marked for m in _marks(w)) for w in words], dtype=float)
            if not held[k] and words and (not toxic[k] or own.any()):
                rows.append(np.array([ids.setdefault(w, len(ids)) for w in words]))
                gold.append(own)
        feats, sizes = _padded([np.array(_features(w)) for w in ids], -1)
        flat, owner = feats[feats >= 0], np.repeat(np.arange(len(ids)), sizes)
        order = sorted(range(len(rows)), key=lambda k: -len(rows[k]))
        groups = [order[i : i + 256] for i in range(0, len(order), 256)]
        n = sum(map(len, rows))
        rate = float(sum(g.sum() for g in gold)) / n
        bias = np.log(max(rate, 1e-6) / (1 - rate))
        # Gradients by adaptive steps (Adam); emissions carry the class balance, transitions begin even.
        state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in (("w", self.w), ("step", self.step), ("start", self.start), ("bias", np.zeros(1)))}
        self.bias = np.array([bias])
        y = np.bincount(np.concatenate(rows), np.concatenate(gold), minlength=len(ids))
        for i in range(1, rounds + 1):
            emit = np.bincount(owner, self.w[flat], minlength=len(ids)) + self.bias
            expected, moves, first = np.zeros(len(ids)), np.zeros((2, 2)), np.zeros(2)
            gold_moves, gold_first = np.zeros((2, 2)), np.zeros(2)
            for group in groups:
                own, own_sizes = _padded([rows[k] for k in group])
                p, m = marginals(emit[own], own_sizes, self.step, self.start, True)
                expected += np.bincount(own.ravel(), p.ravel(), minlength=len(ids))
                moves += m
                first += [len(group) - p[:, 0].sum(), p[:, 0].sum()]
                for k in group:
                    g = gold[k].astype(int)
                    gold_moves += np.bincount(g[:-1] * 2 + g[1:], minlength=4).reshape(2, 2)
                    gold_first[g[0]] += 1
            # Each feature's step is scaled by how often it occurs, as Adam does; sums are used, not means, so that rare words learn too.
            grads = {"w": np.bincount(flat, (expected - y)[owner], minlength=1 << BITS) + ridge * self.w, "step": (moves - gold_moves) / n, "start": (first - gold_first) / len(rows), "bias": np.array([(expected - y).sum() / n])}
            for name, g in grads.items():
                m1, m2 = state[name]
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                pace = 0.4 if name == "w" else 0.1
                getattr(self, name)[...] -= pace * (m1 / (1 - 0.9**i)) / (np.sqrt(m2 / (1 - 0.99**i)) + 1e-8)
        self.ready = True
        self._fit_final([docs[k] for k in np.flatnonzero(held)], toxic[held], share)
        return self

    @staticmethod
    def _marked(docs: list[list[str]], toxic: np.ndarray, odds: float = 3.0) -> set[str]:
        seen = (Counter(), Counter())
        for words, t in zip(docs, toxic):
            seen[int(t)].update({m for w in set(words) for m in _marks(w)})
        n = [int((toxic == k).sum()) for k in (0, 1)]
        score = lambda m: np.log((seen[1][m] + 0.5) / (n[1] + 1)) - np.log((seen[0][m] + 0.5) / (n[0] + 1))
        return {m for m, c in seen[1].items() if c >= 3 and score(m) >= odds}

    def _fit_final(self, docs: list[list[str]], toxic: np.ndarray, share: float) -> None:
        cache = Emissions(self)
        x = self.evidence([self.emissions(d, cache) for d in docs])[0]
        v = np.array([-2.0, 0.0, 0.0, 0.0, 0.0])
        weight = np.where(toxic == 1, share / max(1, (toxic == 1).sum()), (1 - share) / max(1, (toxic == 0).sum())) * len(toxic)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
            g = x.T @ (weight * (p - toxic)) + 0.5 * np.r_[0, v[1:]]
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-3, 0.5, 0.5, 0.5, 0.5])
            v -= np.clip(np.linalg.solve(h, g), -2, 2)
        self.final = v

    def emissions(self, words: list[str], cache: Emissions) -> np.ndarray:
        """Log odds of each token; the cache keeps those of words seen before."""
        return np.fromiter(map(cache.__getitem__, words), dtype=float, count=len(words))

    def evidence(self, emit: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The scorer's inputs (1, largest and sum of the marginals, how many reach a half, length) and the marginals themselves."""
        x, own = np.zeros((len(emit), 5)), [np.zeros(0)] * len(emit)
        x[:, 0] = 1
        order = sorted((k for k in range(len(emit)) if len(emit[k])), key=lambda k: -len(emit[k]))
        at = 0
        while at < len(order):
            room = max(1, min(512, 500_000 // len(emit[order[at]])))  # rows of a batch, so that its arrays stay small
            group = order[at : at + room]
            p = marginals(*_padded([emit[k] for k in group]), self.step, self.start)[0]
            for row, k in enumerate(group):
                m = own[k] = p[row, : len(emit[k])]
                x[k, 1:] = m.max(), np.log1p(m.sum()), np.log1p((m >= 0.5).sum()), np.log1p(len(m)) / 4
            at += room
        return x, own

    def score(self, texts: list[str], cache: Emissions, spans: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
        if not self.ready:
            return np.zeros(len(texts)), [[] for _ in texts]
        x, own = self.evidence([self.emissions(tokens_of(t), cache) for t in texts])
        found: list[list[dict]] = [[] for _ in texts]
        for k in np.flatnonzero(x[:, 1] >= 0.5) if spans else ():
            last = -2
            for i, m in enumerate(_TOKEN.finditer(texts[k])):
                if own[k][i] >= 0.5:
                    if i == last + 1:
                        found[k][-1]["end"] = m.end()
                    else:
                        found[k].append({"start": m.start(), "end": m.end()})
                    last = i
        return 1 / (1 + np.exp(-np.clip(x @ self.final, -30, 30))), found


def sample(documents: DataFrame, labels: DataFrame, per_class: int, train_chars: int, seed: int) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels of at most per_class training documents of each class; the toxic share of all training labels."""
    spark = documents.sparkSession
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(C.fold_of(F.col("doc_id"), 5) != 0)
    ids = []
    for k in (0, 1):
        own = known.filter(F.col("toxic") == k)
        ids += [(r.doc_id, k) for r in own.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(per_class).collect()]
    if not ids:
        return [], np.zeros(0, int), 0.0
    share = known.agg(F.avg("toxic")).first()[0]
    chosen = spark.createDataFrame(ids, f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, toxic int")
    fetched = documents.select("doc_id", "text").filter(F.length("text").between(1, train_chars)).join(F.broadcast(chosen), "doc_id")
    rows = fetched.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()  # at most 2 * per_class
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.text))
    return [r.text for r in rows], np.array([r.toxic for r in rows], dtype=int), share


def train(documents: DataFrame, labels: DataFrame, per_class: int = 1500, train_chars: int = 6000, seed: int = 11) -> Field:
    docs, toxic, share = sample(documents, labels, per_class, train_chars, seed)
    return Field().fit([tokens_of(t) for t in docs], toxic, share)


def score(documents: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and spans (offending offsets in code points) of each whole text."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        cache = Emissions(field)

        def run(batch):
            s, spans = field.score(C.texts(batch), cache)
            return {"doc_id": C.column(batch, "doc_id"), "score": s, "spans": spans}

        return run

    return C.map_batches(documents.select("doc_id", "text"), f"doc_id {kind}, score double, spans array<struct<start:bigint,end:bigint>>", make)


def keep_clean(documents: DataFrame, field: Field, limit: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose score is below the limit."""

    def make():
        cache = Emissions(field)

        def run(batch):
            return [s < limit for s in field.score(C.texts(batch), cache, spans=False)[0]]

        return run

    return C.filter_batches(documents, make)


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = C.table(spark, sf_dir, "documents")
    scored = score(documents, train(documents, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (C.fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
