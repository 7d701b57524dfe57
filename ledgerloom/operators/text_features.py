"""X rows: tone, similarity to the year before, block differences, divergence, portfolio sorts, diagnostics."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import columns as P

TOKEN = r"[a-z]+"


def tokens(text: str | Column) -> Column:
    """Lower-case alphabetic tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(P.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def tone(df: DataFrame, dictionary: DataFrame, key: Sequence[str], text: str = "text", categories: Sequence[str] = ("negative", "positive", "uncertainty", "litigious")) -> DataFrame:
    """Shares in percent of the tokens in each category, net tone, and risk density (negative, uncertain or litigious). dictionary: word, category."""
    long = df.select(*key, F.explode_outer(tokens(text)).alias("word"))
    counted = long.groupBy(*key, "word").agg(F.count("word").alias("n"))  # once for each word before the join
    tagged = dictionary.filter(F.col("category").isin(*categories)).groupBy("word").agg(F.collect_set("category").alias("cats"))
    joined = counted.join(tagged, "word", "left")
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    has = lambda *cs: F.coalesce(F.arrays_overlap("cats", F.array(*map(F.lit, cs))), F.lit(False))
    risk = [c for c in ("negative", "uncertainty", "litigious") if c in categories]
    out = joined.groupBy(*key).agg(F.sum("n").alias("n_tokens"), *(share(has(c)).alias(f"n_{c}") for c in categories), share(has(*risk)).alias("n_risk"))
    pct = lambda c: F.when(F.col("n_tokens") > 0, 100.0 * F.col(c) / F.col("n_tokens"))
    out = out.withColumns({f"{c}_pct": pct(f"n_{c}") for c in categories} | {"risk_density": pct("n_risk")})
    if {"negative", "positive"} <= set(categories):
        both = F.col("n_positive") + F.col("n_negative")
        out = out.withColumn("net_tone", F.when(both > 0, (F.col("n_positive") - F.col("n_negative")) / both))
    return out


def tfidf(df: DataFrame, key: Sequence[str], entity: str, text: str = "text", least_entities: int = 5, most_share: float = 0.95, grams: int = 2, stop_words: Sequence[str] = ()) -> DataFrame:
    """Key, term, weight: term frequency times smoothed idf, over 1- to ``grams``-grams in at least 5 entities and at most 95 % of documents, unit length.

    Stop words, in lower case, go before n-grams are formed. The reference names its lists but does not hold them; none go by default.
    """
    words = tokens(text)
    if stop_words:
        words = F.filter(words, lambda x: ~x.isin(*stop_words))
    own = list(dict.fromkeys([*key, entity]))
    split = df.select(*own, words.alias("__words"))  # a column: inside transform() the text would be split again for each n-gram
    t = F.col("__words")

    def runs(g: int) -> Column:
        at = F.sequence(F.lit(1), F.size(t) - g + 1)
        return F.when(F.size(t) >= g, F.transform(at, lambda i: F.concat_ws(" ", F.slice(t, i, g)))).otherwise(F.array().cast("array<string>"))

    terms = F.concat(t, *(runs(g) for g in range(2, grams + 1))) if grams > 1 else t
    docs = split.select(*own, terms.alias("terms"))
    n_docs = docs.agg(F.count("*").alias("docs"))
    tf = docs.select(*own, F.explode("terms").alias("term")).groupBy(*own, "term").agg(F.count("*").alias("tf"))
    # Two plain aggregates instead of a distinct count, which would double the rows.
    df_ = tf.groupBy("term", entity).agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("df"), F.count("*").alias("entities"))
    kept = df_.crossJoin(F.broadcast(n_docs)).filter((F.col("entities") >= least_entities) & (F.col("df") <= most_share * F.col("docs")))  # one row
    idf = F.ln((1 + F.col("docs")) / (1 + F.col("df"))) + 1
    weighted = tf.join(kept.select("term", idf.alias("idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = weighted.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norms, list(key)).select(*key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def yearly_similarity(weights: DataFrame, entity: str = "ticker", year: str = "fiscal_year") -> DataFrame:
    """Cosine with the entity's year before, and delta = 1 - similarity."""
    before = weights.select(entity, (F.col(year) + 1).alias(year), "term", F.col("weight").alias("__before"))
    sim = weights.join(before, [entity, year, "term"]).groupBy(entity, year).agg(F.sum(F.col("weight") * F.col("__before")).alias("similarity"))
    own = weights.select(entity, year).distinct()
    pairs = own.join(own.select(entity, (F.col(year) + 1).alias(year)), [entity, year], "left_semi")
    out = pairs.join(sim, [entity, year], "left").fillna(0.0, ["similarity"])
    return out.withColumn("delta", 1 - F.col("similarity"))


class _Words(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _counted_terms(texts: Iterator[str], cache: _Words, grams: int, stop: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of the text and count of each text's terms, in order of the hashes, then of the texts."""
    hashes = []
    for t in texts:
        words = re.findall(TOKEN, t)
        words = [x for x in words if x not in stop] if stop else words
        hashes.append(np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words)))
    h, at = np.concatenate(hashes), np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])
    found, run = [(h, at)], h
    for g in range(2, grams + 1):
        run = _mix(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[g - 1 :]) if len(run) > 1 else run[:0]
        whole = at[: len(run)] == at[g - 1 :][: len(run)]
        found.append((run[whole], at[: len(run)][whole]))
    term, doc = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(term, kind="stable")  # texts ascend already
    term, doc = term[order], doc[order]
    first = _starts(term, doc)
    return term[first], doc[first], np.diff(np.r_[first, len(term)])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _least(x: np.ndarray) -> bytes:
    """The bytes of non-negative integers in the smallest type that holds them; the reader tells it by the length."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}")


def _summed(own: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """entity, year and the sums of the other columns."""
    e, y, *sums = (np.concatenate(x) for x in zip(*own))
    order = np.lexsort((y, e))
    e, y = e[order], y[order]
    first = _starts(e, y)
    return e[first], y[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in sums)


def _term_sums(tables: list[dict], lo: int, hi: int, n_docs: int, least_entities: int, most_share: float, rows_at_once: int = 500_000) -> tuple[np.ndarray, ...]:
    """entity, year, sum of squared weights and product with the year before, over the terms of one bucket, whose hashes go from lo to below hi."""
    entity, year = (np.concatenate([np.frombuffer(t[k], dtype=kind) for t in tables]) for k, kind in (("entity", "<i8"), ("year", "<i4")))
    base = np.cumsum([0, *(len(t["year"]) // 4 for t in tables)])
    order = np.lexsort((year, entity))  # one number for each entity and year, in their order
    starts = _starts(entity[order], year[order])
    code = np.empty(len(order), dtype=np.int64)
    code[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
    entity, year = entity[order][starts], year[order][starts].astype(np.int64)
    packed = []
    for t, b, e in zip(tables, base, base[1:]):
        terms = np.frombuffer(t["term"], dtype="<u8")
        upto = np.r_[0, np.cumsum(_numbers(t["rows"], len(terms)), dtype=np.int64)]
        packed.append((terms, upto, _numbers(t["doc"], int(upto[-1])), _numbers(t["tf"], int(upto[-1])), code[b:e]))
    ranges = -(-sum(int(p[1][-1]) for p in packed) // rows_at_once)
    edges = np.array([lo + (hi - lo) * k // ranges for k in range(1, ranges)], dtype=np.uint64)
    cuts = [np.r_[0, np.searchsorted(p[0], edges), len(p[0])] for p in packed]
    norm, dot = np.zeros(len(entity)), np.zeros(len(entity))
    for k in range(ranges):
        found = []
        for (terms, upto, doc, tf, codes), cut in zip(packed, cuts):
            i, j = cut[k], cut[k + 1]
            r, s = upto[i], upto[j]
            if r < s:
                found.append((np.repeat(terms[i:j], np.diff(upto[i : j + 1])), codes[doc[r:s]], tf[r:s].astype(np.int64)))
        if not found:
            continue
        term, doc, tf = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        first = _starts(term, doc)  # rows of one entity and year are one document
        term, doc, tf = term[first], doc[first], np.add.reduceat(tf, first)
        start = _starts(term)
        df = np.diff(np.r_[start, len(term)])
        new = np.zeros(len(term), dtype=np.int64)
        new[_starts(term, entity[doc])] = 1
        kept = (np.add.reduceat(new, start) >= least_entities) & (df <= most_share * n_docs)
        w = tf * np.repeat(np.where(kept, np.log((1 + n_docs) / (1 + df)) + 1, 0.0), df)
        norm += np.bincount(doc, w * w, minlength=len(entity))
        now, was = doc[1:], doc[:-1]
        next_ = (term[1:] == term[:-1]) & (entity[now] == entity[was]) & (year[now] == year[was] + 1)
        dot += np.bincount(now[next_], (w[1:] * w[:-1])[next_], minlength=len(entity))
    some = norm > 0
    return entity[some], year[some], norm[some], dot[some]


def yearly_text_similarity(df: DataFrame, entity: str = "ticker", year: str = "fiscal_year", text: str = "text", least_entities: int = 5, most_share: float = 0.95, grams: int = 2, stop_words: Sequence[str] = ()) -> DataFrame:
    """yearly_similarity(tfidf(...)) without a row for each term of each text.

    Tasks count the terms of many texts at once and send them in packed arrays to
    the bucket of the terms' hashes. There a term's documents meet: it gets its
    idf and adds to the squared length of each, and to the product of each with
    its entity's year before. Only these sums go on. Terms and entities are told
    apart by 64-bit hashes: n different terms have one collision with a chance of n * n / 2 ** 65.
    There are spark.sql.shuffle.partitions buckets, two to a task, so that few sums leave a task; a task holds the packed arrays of one of them.
    """
    n_docs, stop = df.count(), frozenset(stop_words)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edge = [(k << 64) // parts for k in range(parts + 1)]
    none = -(1 << 31)  # a null year, which is a document but nobody's year before
    ready = df.select(F.xxhash64(F.col(entity).cast("string")).alias("e"), F.coalesce(F.col(year).cast("int"), F.lit(none)).alias("y"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    blobs = ("term", "rows", "doc", "tf", "entity", "year")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, edges = _Words(), np.array(edge[1:-1], dtype=np.uint64)
        for batch in batches:
            step = max(1, min(50_000, batch.num_rows * (8 << 20) // max(1, batch.nbytes)))  # rows of about 8 MB of text
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                e, y = part.column(0).to_numpy(), part.column(1).to_numpy()
                term, doc, tf = _counted_terms((x.as_py() for x in part.column(2)), cache, grams, stop)
                cuts = [0, *np.searchsorted(term, edges), len(term)]
                out: dict = {k: [] for k in ("bucket", *blobs)}
                for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    if lo == hi:
                        continue
                    own, at = np.unique(doc[lo:hi], return_inverse=True)
                    first = _starts(term[lo:hi])
                    packed = (term[lo:hi][first].astype("<u8").tobytes(), _least(np.diff(np.r_[first, hi - lo])), _least(at), _least(tf[lo:hi]), e[own].astype("<i8").tobytes(), y[own].astype("<i4").tobytes())
                    for k, v in zip(("bucket", *blobs), (b, *packed)):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in blobs)], names=["bucket", *blobs])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, sums = [], None, []

        def close() -> None:
            sums.append(_term_sums(held, edge[at], edge[at + 1], n_docs, least_entities, most_share))
            if sum(len(x[0]) for x in sums) > 2 * len(sums[0][0]) + 200_000:
                sums[:] = [_summed(sums)]

        for batch in batches:
            for row in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                if held and row["bucket"] != at:
                    close()
                    held = []
                at = row["bucket"]
                held.append(row)
        if held:
            close()
        if sums:
            e, y, norm, dot = _summed(sums)
            for s in range(0, len(e), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[s : s + 50_000], kind) for x, kind in ((e, pa.int64()), (y, pa.int32()), (norm, pa.float64()), (dot, pa.float64()))], names=["e", "y", "norm", "dot"])

    packed = ready.mapInArrow(spread, "bucket int, " + ", ".join(f"{k} binary" for k in blobs))
    met = packed.repartition(max(1, parts // 2), "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "e long, y int, norm double, dot double")
    sums = met.groupBy("e", "y").agg(F.sum("norm").alias("norm"), F.sum("dot").alias("dot")).filter(F.col("y") != none)
    both = F.array(F.struct("y", F.col("norm").alias("now"), F.lit(None).cast("double").alias("was"), "dot"), F.struct((F.col("y") + 1).alias("y"), F.lit(None).cast("double").alias("now"), F.col("norm").alias("was"), F.lit(None).cast("double").alias("dot")))
    pairs = sums.select("e", F.explode(both).alias("s")).groupBy("e", "s.y").agg(*(F.max(f"s.{k}").alias(k) for k in ("now", "was", "dot"))).filter("now is not null and was is not null")
    names = df.select(entity, year).dropna().distinct().withColumns({"e": F.xxhash64(F.col(entity).cast("string")), "y": F.col(year).cast("int")})
    sim = names.join(pairs, ["e", "y"]).withColumn("similarity", F.col("dot") / F.sqrt("now") / F.sqrt("was"))
    return sim.select(entity, year, "similarity", (1 - F.col("similarity")).alias("delta"))


def block_changes(df: DataFrame, entity: str = "ticker", year: str = "fiscal_year", text: str = "text", match: float = 0.5, same: float = 0.85, least: int = 3) -> DataFrame:
    """Blocks (parted by blank lines) added, removed, modified and turned over against the year before.

    Similarity is the cosine of token counts; blocks are matched greedily, the
    most similar first, from 0.5; matches below 0.85 are modified. Texts with
    fewer than three blocks give NULLs. A task sees two years of one entity.
    """
    blocks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n", -1), lambda b: F.size(tokens(b)) > 0)
    own = df.select(F.col(entity).cast("string").alias(entity), F.col(year).cast("int").alias(year), F.transform(blocks, tokens).alias("now"))
    pairs = own.join(own.select(entity, (F.col(year) + 1).alias(year), F.col("now").alias("was")), [entity, year])

    def one(now: list, was: list) -> tuple:
        from collections import Counter

        if min(len(now), len(was)) < least:
            return None, None, None, None
        a, b = [Counter(x) for x in now], [Counter(x) for x in was]
        norm = lambda c: sum(v * v for v in c.values()) ** 0.5
        sims = sorted(((-sum(v * y[k] for k, v in x.items() if k in y) / (norm(x) * norm(y)), i, j) for i, x in enumerate(a) for j, y in enumerate(b)))
        left, right, modified = set(range(len(a))), set(range(len(b))), 0
        for s, i, j in sims:
            if -s < match:
                break
            if i in left and j in right:
                left.discard(i)
                right.discard(j)
                modified += -s < same
        return len(left), len(right), modified, (len(left) + len(right)) / (len(a) + len(b))

    def run(frames):
        for f in frames:
            rows = [one(n, w) for n, w in zip(f["now"], f["was"])]
            out = f[[entity, year]].copy()
            for k, c in enumerate(("added", "removed", "modified", "turnover")):
                out[c] = pd.Series([r[k] for r in rows], dtype="object", index=f.index).astype("float64")
            yield out

    kinds = f"{entity} string, {year} int, added double, removed double, modified double, turnover double"
    counts = pairs.mapInPandas(run, kinds)
    return counts.select(entity, year, *(P.no_nan(c).alias(c) for c in ("added", "removed", "modified", "turnover")))


def attach_features(panel: DataFrame, features: DataFrame, keys: Sequence[str] = ("ticker", "fiscal_year")) -> DataFrame:
    """The panel with the text features of its keys, NULL where there are none.

    features has one row for each key; a repeated key raises when the plan runs,
    as it would multiply the panel's rows. A null key matches nothing. Of columns in both, the panel's stay.
    """
    new = [c for c in features.columns if c not in panel.columns]
    known = features.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("__n"), F.first(F.struct(F.lit(1).alias("__one"), *new)).alias("__x"))
    once = F.when(F.col("__n") == 1, F.col("__x")).otherwise(F.raise_error(F.lit("features repeat a key")))
    return panel.join(known.select(*keys, once.alias("__x")), list(keys), "left").select(*panel.columns, *(F.col("__x")[c].alias(c) for c in new))


def section_scores(scores: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """Sentence scores of an outside model, averaged for each section."""
    return scores.groupBy(*key).agg(F.count(score).alias("n_sentences"), F.avg(score).alias("mean_score"), F.avg((F.col(score) < 0).cast("double")).alias("share_negative"))


def divergence(df: DataFrame, d_tone: str = "d_tone", d_roa: str = "d_roa") -> DataFrame:
    """What the change in tone has beyond its pooled relation to the change in results, and whether their signs differ (a missing sign differs)."""
    slope = df.agg(F.regr_slope(d_tone, d_roa).alias("__slope"))
    out = df.crossJoin(F.broadcast(slope))  # one row
    differ = ~F.coalesce(F.signum(d_tone) == F.signum(d_roa), F.lit(False))
    return out.withColumn("divergence", F.col(d_tone) - F.col("__slope") * F.col(d_roa)).withColumn("sign_differs", differ.cast("int")).drop("__slope")


def sd_effect(df: DataFrame, coef: float, x: str, y: str) -> DataFrame:
    """The effect of one standard deviation of x, also in percent of the mean of y."""
    return df.agg((F.lit(coef) * F.stddev_samp(x)).alias("effect"), F.when(F.avg(y) != 0, 100 * F.lit(coef) * F.stddev_samp(x) / F.avg(y)).alias("percent_of_mean"))


def quartile_sort(df: DataFrame, x: str, y: str, by: Sequence[str] = (), order: Sequence[str] = (), n: int = 4) -> DataFrame:
    """Rows are sorted into n equal groups by x within each ``by``; mean of y in each group."""
    ranked = df.filter(F.col(x).isNotNull()).withColumn("quartile", F.ntile(n).over(Window.partitionBy(*by).orderBy(F.col(x), *order)))
    return ranked.groupBy("quartile").agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"))


def q4_reliability(quarters: DataFrame, entity: str = "ticker", year: str = "fiscal_year", tolerance: float = 0.01) -> DataFrame:
    """For each metric how often the explicit fourth quarter equals annual - Q1 - Q2 - Q3 within 1 %. quarters: entity, year, metric, period (FY, Q1..Q4), value."""
    at = lambda p: F.max(F.when(F.col("period") == p, F.col("value")))
    wide = quarters.groupBy(entity, year, "metric").agg(*(at(p).alias(p) for p in ("FY", "Q1", "Q2", "Q3", "Q4")))
    both = wide.withColumn("implied", F.col("FY") - F.col("Q1") - F.col("Q2") - F.col("Q3")).filter("implied is not null and Q4 is not null")
    good = F.abs(F.col("implied") - F.col("Q4")) <= tolerance * F.abs(F.col("Q4"))
    return both.groupBy("metric").agg(F.count("*").alias("n"), F.count_if(good).alias("n_match"), F.avg(good.cast("double")).alias("match_rate"))


def frequency_coverage(quarters: DataFrame, entity: str = "ticker", year: str = "fiscal_year") -> DataFrame:
    """The share of entity years with a value, by metric and period."""
    every = quarters.select(entity, year).distinct().agg(F.count("*").alias("__all"))
    have = quarters.filter("value is not null").select(entity, year, "metric", "period").distinct().groupBy("metric", "period").agg(F.count("*").alias("n"))
    return have.crossJoin(F.broadcast(every)).select("metric", "period", "n", (100.0 * F.col("n") / F.col("__all")).alias("percent"))  # one row
