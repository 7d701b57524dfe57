"""Operators 1, 3, 4, 6, 10 against brute force, and their defined edge cases."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common as C
from ledgerloom.llm import decontaminate, lm, mixing, pii, toxicity

ODD = [(1, "One two one"), (2, None), (3, ""), (None, "two  three x"), (1, "One two one"), (7, "a " * 30000), (8, "\n\t ")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, "en", "s", 9, 9, 9, 9) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, spans int, class_id int, size int").repartition(3)


# 1


def _brute_lm(train: list[str], texts: list[str]) -> list[tuple]:
    tok = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()) + [b" </s>"]
    uni, big = collections.Counter(), collections.Counter()
    for t in train:
        w = tok(t)
        uni.update(w)
        big.update(zip([b" <s>", *w[:-1]], w))
    n, v = sum(uni.values()), len(uni)
    cont = collections.Counter(b for _, b in big)
    total, followers = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), c in big.items():
        total[a] += c
    for (a, _), c in big.items():
        followers[a][min(c, 3) - 1] += 1
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    high, low = lm.discounts(of(big)), lm.discounts(of(cont))
    cut = lambda c, d: max(0.0, c - (d[min(c, 3) - 1] if c else 0))
    m1, m2 = of(cont)[:2]
    pairs = sum(cont.values())
    uniform = ((low[0] * m1 + low[1] * m2 + low[2] * (v - m1 - m2)) / pairs if pairs else 1.0) / (v + 1)

    def p(a, b):
        q = cut(cont[b], low) / max(1, pairs) + uniform
        if not total[a]:
            return q
        return cut(big[a, b], high) / total[a] + sum(x * y for x, y in zip(high, followers[a])) / total[a] * q

    out = []
    for t in texts:
        w = tok(t)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip([b" <s>", *w[:-1]], w))))
    return out


def _lm_rows(df):
    return sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


def test_lm_against_brute_force(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", (C.fold_of(F.col("doc_id"), 10) == 0).alias("held_out"))
    rows = docs.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    want = _brute_lm([r.text for r in rows if not r.held_out], [r.text for r in rows])
    got = _lm_rows(lm.score(docs, lm.train(docs.filter("not held_out"), shard_bytes=1 << 14)))
    assert got == sorted((*w[:3], round(w[3], 6), round(w[4], 6)) for w in want)
    # On text that training has not seen the model must beat the base.
    held = [w for r, w in zip(rows, want) if r.held_out]
    assert sum(w[4] for w in held) > sum(w[3] for w in held)


def test_lm_edges(spark, odd):
    files = lm.train(odd)
    want = _brute_lm([t for _, t in ODD], [t for _, t in ODD])
    assert _lm_rows(lm.score(odd, files)) == sorted((*w[:3], round(w[3], 6), round(w[4], 6)) for w in want)
    nothing = lm.train(odd.filter("false"))
    assert {(r.n_known, r.train_tokens, r.score) for r in lm.score(odd, nothing).collect()} == {(0, 0, 0.0)}
    assert lm.score(odd.filter("false"), files).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    """Over the vocabulary, the end and one unseen word, in contexts that training has seen and in one that it has not."""
    files = lm.train(spark.createDataFrame([(t,) for t in ("a b a c", "b a", "c c a b d", "a b")], "text string"))
    model = lm.Model(files)
    for context in ("a", "b", "never"):
        total = 0.0
        for word in ("a", "b", "c", "d", "unseen", None):
            chunk = lm.Chunk()
            chunk.add(f"{context} {word}" if word else context)
            h, left, right = chunk.arrays()
            c, p, tokens, spare = model.words(h)
            n = model._look_up("pairs", lm._PAIRS, lm.pair_hash(h[left[1:2]], h[right[1:2]]))[0]
            x, y = left[1], right[1]
            total += max(n[0] - lm._discount(n, model.high)[0], 0) / max(tokens[x], 1) + spare[x] * p[y]
        assert total == pytest.approx(1, abs=1e-12)


# 3


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    parts = ("a", "Z", "1", "23", "456", "4111111111111111", ".", "@", "+", "-", " ", "(", ")", "é", "a.b", "@x.y", "255", "+1 (", "%", "1.2.3.4")
    for _ in range(4000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 18)))
        assert pii.base_spans(s) == pii.brute_base(s), s


@pytest.mark.parametrize("s", ["1" * 200_000, "a@" * 60_000, "a" * 200_000 + "@", "1." * 100_000, "+1" + " " * 100_000, ": " * 50_000 + ":::" * 50_000])
def test_pii_is_linear(s):
    assert isinstance(pii.candidates(s), list) and set(pii.base_spans(s)) == set(pii.KINDS)


def test_pii_model_finds_more_and_keeps_the_base():
    model, limits = pii.train()
    found = real = wrong = 0
    for text, truth in pii._sentences(1500, 99):
        base = pii.base_spans(text)
        more = pii.added_spans(text, base, model, limits)
        got = {(k, text[s:e].strip()) for k in pii.KINDS for s, e in base[k] + more[k]}
        truth = {(k, v.strip()) for k, v in truth}
        real += len(truth)
        found += len(got & truth)
        wrong += len(got - truth)
    assert found / real > 0.9 and wrong / real < 0.03


def test_pii_query(spark, odd):
    df = odd.unionByName(spark.createDataFrame([(50, "mail a.b@c.de, ip 10.0.0.1 and 10.0.0.256, card 4111 1111 1111 1111, call +1 (243) 555-7962", "en", "s", 1, 1, 1, 1)], odd.schema))
    rows = {r.doc_id: r for r in pii.find(df).collect()}
    got = [(s.kind, s.start, s.end) for s in rows[50].spans if s.base]
    text = "mail a.b@c.de, ip 10.0.0.1 and 10.0.0.256, card 4111 1111 1111 1111, call +1 (243) 555-7962"
    assert [text[s:e] for _, s, e in got] == ["a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+1 (243) 555-7962"]
    assert pii.redact(text, got).endswith("call [PHONE]") and not rows[2].spans and pii.find(odd.filter("false")).count() == 0


# 4


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([5, 3, 1])
    emit, step, start = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, moves = toxicity.marginals(emit, sizes, step, start, True)
    want_moves = np.zeros((2, 2))
    for row, n in enumerate(sizes):
        weights = {}
        for m in range(2**n):
            z = [(m >> i) & 1 for i in range(n)]
            weights[tuple(z)] = math.exp(start[z[0]] + sum(emit[row, i] * z[i] for i in range(n)) + sum(step[z[i], z[i + 1]] for i in range(n - 1)))
        total = sum(weights.values())
        for i in range(n):
            assert p[row, i] == pytest.approx(sum(w for z, w in weights.items() if z[i]) / total)
        for z, w in weights.items():
            for i in range(n - 1):
                want_moves[z[i], z[i + 1]] += w / total
    assert moves == pytest.approx(want_moves)


def _toxic_docs(spark, n=600):
    r = random.Random(5)
    word = lambda: "".join(r.choice("aeiourstln") for _ in range(r.randint(2, 7)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(5, 60))]
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            words.insert(r.randrange(len(words)), r.choice(("zxidiot", "zxmoron", "qqvile" + word())))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i for i, _, t in labels if t}


def test_toxicity_on_held_out_documents(spark):
    docs, labels, bad = _toxic_docs(spark)
    field = toxicity.train(docs, labels)
    rows = [r for r in toxicity.score(docs, field).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id in bad) for r in rows]) > 0.95
    text = {r.doc_id: r.text for r in docs.collect()}
    spans = [text[r.doc_id][s.start : s.end] for r in rows if r.doc_id in bad for s in r.spans]
    assert np.mean([any(k in s for k in ("zx", "qq")) for s in spans]) > 0.9
    kept = {r.doc_id for r in toxicity.keep_clean(docs.withColumn("score", F.lit(1)), field).collect()}
    assert len(kept & bad) < 0.1 * len(bad) and len(kept) > 0.95 * (600 - len(bad))


def test_toxicity_edges(spark, odd):
    docs, labels, _ = _toxic_docs(spark, 120)
    for table in (labels.filter("false"), labels.filter("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r.score for r in toxicity.score(odd, toxicity.train(docs, table)).collect()} == {0.0}
    field = toxicity.train(docs, labels.union(labels))
    got = toxicity.score(odd, field).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got) and toxicity.score(odd.filter("false"), field).count() == 0


def test_toxicity_offsets_are_those_of_the_text(spark):
    """Lower case may be longer than the text."""
    docs, labels, _ = _toxic_docs(spark)
    field = toxicity.train(docs.union(docs), labels)
    text = "İİİİ İstanbul zxmoron zxidiot fine"
    spans = field.score([text, text.replace("İ", "i")], toxicity.Emissions(field))[1]
    assert spans[0] == spans[1] and any("zxmoron" in text[s["start"] : s["end"]] for s in spans[0])
    assert len(toxicity.tokens_of(text)) == 5


# 6


def test_automata_are_built_once_a_task(spark, monkeypatch, tmp_path):
    import pyarrow as pa

    bench = spark.createDataFrame([(i, f"w{i} x{i} y{i}") for i in range(20)], "item_id long, text string")
    paths = decontaminate._publish(bench, 10, 60, False)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [f"a w{k} x{k} y{k} b"]}) for k in range(30)]
    built, load = [], decontaminate._load
    monkeypatch.setattr(decontaminate, "_load", lambda p: built.append(p) or load(p))
    for own, hold in ((paths, 1 << 20), (paths[:1], 0)):
        built.clear()
        found = [x for _, rows in decontaminate._scan_pieces(own, iter(batches), hold) for x in rows]
        assert built == own and len(found) == 30 and {x[0] for x in found} == {5}
    assert len(paths) > 3 and sum(bool(x[1]) for _, rows in decontaminate._scan_pieces(paths, iter(batches), 100) for x in rows) == 20


def test_decontamination_against_brute_force(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    bench = [(i, " ".join(r.choice(words) for _ in range(r.choice((0, 3, 10, 14)))) if i else None) for i in range(12)] + [(3, "w1, W2 w3"), (None, "w1 w2")]
    docs = []
    for i in range(80):
        t = [r.choice(words) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t) + 1) : 0] = (r.choice(bench)[1] or "").split()
        docs.append((i, r.choice((" ", ", ", "\n")).join(t).upper() if i % 3 else " ".join(t)))
    docs += [(99, None), (None, "w1 w2 w3"), (5, docs[5][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit(1))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = sorted(map(str, decontaminate.brute_force(docs, [x for x in bench if x[0] is not None])))
    for block in (8_000_000, 60):  # one automaton, and many
        got = decontaminate.digest(decontaminate.scan(d, b, block_chars=block)).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    clean = sorted(str(r.doc_id) for r in decontaminate.decontaminate(d, b).collect())
    assert clean == sorted(str(w[0]) for w in decontaminate.brute_force(docs, [x for x in bench if x[0] is not None]) if not w[5])


def test_windows_of_null_items_are_hits(spark, tmp_path):
    """In the query and the pipeline: they hit, but name no item."""
    import corpus_pipeline

    docs, bench = [(1, "a w1 w2 b"), (2, "a w3 b"), (3, "a b")], [(None, "w1 w2"), (4, "w3"), (None, "w3")]
    for name, rows, schema in (("documents", docs, "doc_id long, text string"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    brute = {r[0]: r for r in decontaminate.brute_force(docs, bench)}
    got = {r.doc_id: r for r in decontaminate.op6_decontaminate(spark, str(tmp_path)).collect()}
    assert {k: (r.n_words, r.n_hit, r.contaminated) for k, r in got.items()} == {k: (r[1], r[2], r[5]) for k, r in brute.items()}
    assert [got[k].n_items for k in (1, 2, 3)] == [0, 1, 0] and got[1].n_hit == 2
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    assert [r.doc_id for r in stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()] == [3]


def test_decontamination_offsets_and_empty(spark):
    text = "Été: the QUICK brown-fox jumps! over it"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "quick, brown fox JUMPS")], "item_id long, text string")
    r = decontaminate.scan(d, b).first()
    assert [text[s.start : s.end] for s in r.spans] == ["QUICK brown-fox jumps"] and r["items"] == ["7"]
    assert decontaminate.scan(d, b.filter("false")).first().spans == [] and decontaminate.scan(d.filter("false"), b).count() == 0


# 10


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 1]) == [0, 0]
    got = mixing.targets([1, 1, 1000], [5, 2, 1])
    assert got == pytest.approx([3, 3, 996])


def test_sainte_lague_against_dealing_seat_by_seat():
    r = random.Random(7)
    for _ in range(300):
        shares = [r.choice((0.0, 1.0, 2.0, r.random() * 10)) for _ in range(r.randint(1, 7))]
        limits = [r.randint(0, 12) for _ in shares]
        seats = r.randint(0, 40)
        want = [0] * len(shares)
        for _ in range(seats):
            open_ = [i for i, s in enumerate(shares) if s > 0 and want[i] < limits[i]]
            if not open_:
                break
            want[max(open_, key=lambda i: (shares[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(shares, seats, limits) == want


def test_mix(spark, odd):
    r = random.Random(8)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 80))), f"s{min(r.randrange(9), 5)}" if i % 7 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit("x"))
    out = mixing.mix(df, shard_rows=64).collect()
    again = mixing.mix(df.repartition(5), shard_rows=64).collect()
    assert sorted((x.doc_id, x.taken) for x in out) == sorted((x.doc_id, x.taken) for x in again)
    assert len(out) == 900 and all(0 <= x.taken <= 3 * x.size for x in out)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for x in out:
        by[x.source][0] += x.taken
        by[x.source][1] = x.target
        by[x.source][2] += x.size
        assert x.size == len(re.findall(r"[^\x20\x09-\x0D]+", rows[x.doc_id][1]))
    assert all(abs(t - want) <= 16 for t, want, _ in by.values())
    names = sorted(k for k in by if k is not None) + [None]
    assert [by[k][1] for k in names] == pytest.approx(mixing.targets([by[k][2] for k in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))]))
    assert len(mixing.mix(odd).collect()) == len(ODD) and mixing.mix(odd.filter("false")).count() == 0
    assert {x.taken for x in mixing.mix(odd.filter("text is null")).collect()} == {0}
