"""Operators 2 and 9 and the components they share, against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common as C, graph, line_dedup, order_minhash as O


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.v: r.c for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: find(v) for a, b in links for v in (a, b) if a != b} | {v: got[v] for v in got if v not in root}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_jobs_and_many_go_in_rounds(spark):
    links = [(f"v{i:03}", f"v{i + 1:03}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x")]
    df = spark.createDataFrame(links, "a string, b string").select(F.col("a").cast("binary").alias("a"), F.col("b").cast("binary").alias("b"))
    spark.sparkContext.setJobGroup("few links", "")
    try:
        few = {bytes(r.v): bytes(r.c) for r in graph.components(df).collect()}
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few links")) <= 8  # each round has dozens, whose threads fill the driver
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few == {f"v{i:03}".encode(): b"v000" for i in range(41)} | {b"x": b"x", b"y": b"x"}
    assert few == {bytes(r.v): bytes(r.c) for r in graph.components(df, one_task=10).collect()}


def test_alignment_against_dynamic_programming():
    r = random.Random(2)
    for _ in range(1500):
        a = [r.randrange(6) for _ in range(r.randint(0, 25))]
        b = list(a)
        for _ in range(r.randint(0, 6)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randint(0, 1)] = [r.randrange(6)] * r.randint(0, 1)
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        lcs = row[-1]
        assert O.near(a, b) == (bool(a or b) and 10 * lcs >= 8 * (len(a) + len(b) - lcs) or not (a or b))


def test_sketches_keep_order():
    words = [f"w{i}" for i in range(200)]
    hashes = lambda w: O.word_hashes(w, O.Hashes())
    seeds = O.seeds_of(40)
    same = O.buckets_of(hashes(words), seeds)
    assert (same == O.buckets_of(hashes(list(words)), seeds)).all() and len(same) == 40
    turned = words[100:] + words[:100]  # nearly the same set of k-mers in another order
    assert (same == O.buckets_of(hashes(turned), seeds)).sum() < 20
    assert [len(O.buckets_of(hashes(words[:n]), seeds)) for n in (1, 4, 51, 52, 63, 64)] == [40, 40, 40, 80, 80, 40]
    assert len(O.kmers(hashes(["a", "b"]))) == 1 and len(O.kmers(hashes([]))) == 0
    repeated = hashes(["x"] * 30)
    assert len(set(O.labelled(repeated).tolist())) == len(repeated)


@pytest.mark.parametrize(("n", "percent"), [(20, 5), (50, 6), (60, 10), (120, 3), (120, 10), (300, 1), (300, 10), (600, 5), (3000, 10)])
def test_recall_of_changed_words(n, percent):
    """Texts with so many words changed: the alignment accepts them and the sketches find them."""
    r, cache, seeds = random.Random(n), O.Hashes(), O.seeds_of(48)
    found = 0
    for _ in range(60):
        a = [f"w{r.randrange(50_000)}" for _ in range(n)]
        b = list(a)
        for k in r.sample(range(n), n * percent // 100):
            b[k] = f"w{r.randrange(50_000)}"
        x, y = O.word_hashes(a, cache), O.word_hashes(b, cache)
        assert O.near(x.tolist(), y.tolist())
        found += bool(set(O.buckets_of(x, seeds).tolist()) & set(O.buckets_of(y, seeds).tolist()))
    assert found >= 54


def _copies() -> list[tuple]:
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    docs, i = [], 0
    for _ in range(25):
        base = [word() for _ in range(r.choice((3, 5, 8, 60, 120)))]
        for _ in range(r.randint(1, 9)):
            copy = list(base)
            for _ in range(r.randint(0, 7) if len(base) > 8 else 0):
                copy[r.randrange(len(copy))] = word()
            docs.append((i, " ".join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
            i += 1
    r.shuffle(docs)
    lost = [word() for _ in range(80)]  # a class without ids
    return docs + [(500, None), (501, ""), (502, "..."), (None, docs[0][1]), docs[1], docs[1], (503, "x y " * 9000), (None, " ".join(lost)), (None, " ".join([*lost[:-3], "end"]))]


def _classes(docs: list[tuple]) -> list[int]:
    """For each row the first row of its class, comparing all pairs."""
    seqs = [O._sequences([t or ""], O.Hashes())[0].tolist() for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if seqs[i] and O.near(seqs[i], seqs[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(docs))]


def test_near_classes_against_all_pairs(spark):
    docs = _copies()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit(1)).withColumn("key", F.lit("k")).repartition(4)
    root = _classes(docs)
    names: dict = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            names[root[i]] = min(d, names.get(root[i], d))
    want = sorted(str((d, names.get(root[i]))) for i, (d, _) in enumerate(docs))
    for options in ({}, {"block": 2, "bag_block": 3, "broadcast_rows": 0}):
        got = O.near_classes(df, **options).collect()
        assert sorted(str((r.doc_id, r.class_id)) for r in got) == want


def test_dedup_keeps_one_of_each_class(spark):
    docs = _copies()
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, kept int")
    root = _classes(docs)
    left = O.dedup(df)
    assert left.columns == df.columns
    kept = [(r.doc_id, r.text) for r in left.collect()]
    # One row of each class, those of the rows without words apart; with the smallest id where there is one.
    assert len(kept) == len(set(root)) and sum(d is None for d, _ in kept) == 1
    ids = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[root[i]] = min(d, ids.get(root[i], d))
    assert sorted(d for d, _ in kept if d is not None) == sorted(ids.values())
    assert O.near_classes(df.filter("false")).count() == 0 and O.dedup(df.filter("false")).count() == 0


# 9


def _mutate(r: random.Random, x: str, k: int) -> str:
    s = list(x)
    for _ in range(k):
        i = r.randrange(len(s) + 1)
        s[i : i + r.randint(0, 1)] = [r.choice("abé")] * r.randint(0, 1)
    return "".join(s)


def test_edit_distance_and_probes():
    r = random.Random(4)
    for _ in range(4000):
        a = "".join(r.choice("abé") for _ in range(r.randint(0, 45)))
        b, k = _mutate(r, a, r.randint(0, 4)), r.randint(0, 3)
        d = line_dedup._distance(a, b)
        assert line_dedup.within(a, b, k) == (d <= k)
        x, y = sorted((a, b), key=len)
        t = line_dedup.edits_for(len(x))
        if t and d <= t:
            index = {(n, i, x[s : s + m]) for n, i, s, m, own in line_dedup.probes(len(x)) if own}
            assert index & {(n, i, y[s : s + m]) for n, i, s, m, _ in line_dedup.probes(len(y))}


@pytest.fixture(scope="module")
def lines(spark):
    r = random.Random(5)
    pool = ["".join(r.choice("ab é") for _ in range(r.choice((3, 8, 11, 15, 19, 20, 21, 22, 25, 40)))) for _ in range(50)]
    docs = []
    for k in range(130):
        own = [_mutate(r, r.choice(pool), r.choice((0, 0, 1, 2, 3))) for _ in range(r.randint(0, 7))]
        docs.append((k if r.random() < 0.95 else None, "\n".join(own) if own or r.random() < 0.5 else None))
    docs += [*docs[:5], (900, ""), (901, " \n\n "), (902, "same long line here\n" * 300)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).withColumn("line", F.lit("x")).repartition(6)


def test_line_dedup_against_all_pairs(spark, lines):
    keyed = [(x.doc_id, x.k, x.text) for x in lines.select("doc_id", "text", line_dedup._text_key().alias("k")).collect()]
    want = {(keyed[k][0], keyed[k][1]): (sorted(v[0]), sorted(v[1])) for k, v in line_dedup.brute_force(keyed).items() if v[0] or v[1]}
    for options in ({}, {"broadcast_rows": 0}):
        got = {(x.doc_id, x.text_key): (list(x.exact), list(x.near)) for x in line_dedup.dropped(lines, **options).collect()}
        assert got == want and any(v[1] for v in want.values())


def test_dedup_lines_result(spark, lines):
    out = line_dedup.dedup_lines(lines)
    assert out.columns == lines.columns
    rows = out.collect()
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    by = {r.doc_id: r.text for r in rows}
    assert by[900] == "" and by[901] == " \n\n " and by[902].strip() == "same long line here"
    assert line_dedup.dedup_lines(lines.filter("false")).count() == 0
    again = line_dedup.dropped(out)
    assert not any(r.exact for r in again.collect())


def test_cut_leaves_the_session_alone_and_uncut_deletes(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    made = C.cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    again = C.cut(made.filter("k < 3"))
    folder = Path(urlparse(made._jdf.queryExecution().logical().rdd().getCheckpointFile().get()).path)
    assert folder.is_dir()
    C.uncut(made)
    assert not folder.exists()
    assert sorted(r.k for r in again.collect()) == [0, 1, 2]
