import random

import numpy as np
from pyspark.sql import functions as F

from snaptree.llm import components, minhash


def classes(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    base = [[f"w{r.randrange(900)}" for _ in range(r.choice([6, 30, 120]))] for _ in range(25)]
    docs = []
    for words in base:
        for _ in range(r.choice([1, 2, 6])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                own[r.randrange(len(own))] = f"v{r.randrange(99)}"
            docs.append(r.choice([" ", "\n", "  "]).join(own))
    chain = [f"c{i}" for i in range(160)]
    docs += [" ".join(chain[i : i + 100]) for i in range(0, 60, 4)]  # each near the next one only
    docs += [" ".join(base[0])] * 30 + [None, "", " \n", "One", "one", "two Words", "TWO words"]
    r.shuffle(docs)
    return [(i * 3 + 5, t) for i, t in enumerate(docs)]


def test_against_brute_force(spark):
    for k, percent in ((3, 85), (5, 80)):
        docs = corpus(k)
        df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).withColumn("id", F.lit("clash")).withColumn("bands", F.lit(1)).withColumn("a.b", F.lit(1))
        got = {q.doc_id: (q.n_shingles, q.component_id) for q in minhash.near_duplicates(df, k=k, percent=percent).collect()}
        want = classes(docs, k, percent)
        assert got == want
    kept = minhash.keep_first(df)
    assert kept.columns == df.columns and {q.doc_id for q in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_null_and_repeated_keys(spark):
    t = " ".join(f"x{i}" for i in range(20))
    u = " ".join(f"y{i}" for i in range(20))
    df = spark.createDataFrame([(None, t), (4, t), (9, t), (9, u), (6, u), (None, None)], "doc_id bigint, text string")
    got = sorted((q.doc_id or -1, q.component_id or -1, q.kept) for q in minhash.near_duplicates(df).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (4, 4, True), (6, 4, False), (9, 4, False), (9, 4, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.keep_first(df.limit(0)).count() == 0


def test_blocks_span_all_links():
    r = np.random.default_rng(5)
    rows = []
    for i in range(60):
        s = set(range(i // 6 * 50, i // 6 * 50 + 40)) ^ set(r.integers(0, 2000, 3).tolist())
        rows.append((i, i, np.array(sorted(s), dtype=np.uint64)))
    sets = [set(x[2].tolist()) for x in rows]
    pairs = {(a, b) for a in range(60) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}

    def parts(edges):
        root = list(range(60))
        for _ in range(60):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert pairs and parts(minhash.block_links(rows, None, 80)) == parts(pairs)
    cut = minhash.block_links(rows[:25], None, 80) + minhash.block_links(rows[25:], None, 80) + minhash.block_links(rows[:25], rows[25:], 80)
    assert parts(cut) == parts(pairs)


def test_signature_estimates_the_similarity():
    s = minhash.Signer(10)
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    same = (s.signature(a) == s.signature(b)).mean()
    assert abs(same - 800 / 1200) < 0.2 and (s.signature(a) == s.signature(a[::-1])).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 7), (3, 3), (None, 5), (200, 150)]
    got = {q.id: q.component_id for q in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in (*range(100, 161), 200)} | {7: 7, 9: 7}


def test_very_long_texts(spark):
    """Texts of half a million words are compared whole: those that differ only at their end are near, halves are not."""
    long = " ".join(f"w{i % 70_001}x{i // 70_001}" for i in range(500_000))
    docs = [(1, long), (2, long + " and an end"), (3, long[: len(long) // 2]), (4, None), (5, long)]
    got = {q.doc_id: q.component_id for q in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
