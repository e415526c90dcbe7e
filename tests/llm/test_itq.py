import numpy as np
import pytest
from pyspark.sql import functions as F

from snaptree.llm import itq


def test_against_brute_force(spark):
    r = np.random.default_rng(0)
    base = r.normal(size=(60, 16))
    x = np.concatenate([base, np.repeat(base[:40], 5, axis=0) + r.normal(size=(200, 16)) * 0.3, base[:10] * 3, np.repeat(base[:1], 700, axis=0) + r.normal(size=(700, 16)) * 0.02, r.normal(size=(200, 16))])
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    n = len(rows)
    bad = [(n, None), (n + 1, [0.0] * 16), (n + 2, [1.0, None] + [1.0] * 14), (n + 3, [float("nan")] * 16), (n + 4, [float("inf")] * 16), (n + 5, []), (n + 6, [1.0, 2.0]), (None, rows[0][1]), (n + 7, rows[0][1]), (n + 8, [1e200 * y for y in rows[0][1]])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1)).withColumn("size", F.lit("clash")).withColumn("v", F.lit(0))
    got = {q.vec_id: q for q in itq.near_duplicates(df).collect()}
    assert len(got) == n + 10 and got[None].n_links == 0
    x = np.concatenate([x, x[:1], x[:1]])
    ids = [*range(n), n + 7, n + 8]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    want = hit.sum(axis=1)
    have = np.array([got[i].n_links for i in ids])
    assert (have <= want).all() and have.sum() >= 0.9 * want.sum()
    root = np.arange(len(ids))
    while True:
        low = np.array([min([root[i], *root[hit[i]]]) for i in range(len(ids))])
        if (low == root).all():
            break
        root = low
    same = sum(got[i].component_id == ids[c] for i, c in zip(ids, root, strict=True))
    assert same >= 0.9 * len(ids) and all(q.kept == (i == q.component_id) for i, q in got.items() if i is not None)
    for i in (*range(n, n + 7),):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert itq.near_duplicates(df.limit(0)).count() == 0


def test_rotation_balances_bits():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 8)) * np.array([9, 5, 3, 1, 1, 1, 1, 1])
    mean, matrix = itq.learn(x, 2)
    assert matrix.shape == (8, 16) and np.allclose(matrix[:, :8].T @ matrix[:, :8], np.eye(8))
    assert abs((((x - mean) @ matrix) >= 0).mean(axis=0) - 0.5).max() < 0.1


def spread(kind, n, dim, r):
    """Unit vectors: in all directions, about a common one (mean cosine 0.5 and 0.8), or in clusters."""
    x = r.normal(size=(n, dim))
    if kind == "shared":
        x = x + np.sqrt(dim) * np.eye(dim)[0]
    elif kind == "narrow":
        x = x + 2 * np.sqrt(dim) * np.eye(dim)[0]
    elif kind == "clusters":
        x = 0.7 * x + r.normal(size=(40, dim))[r.integers(0, 40, n)]
    elif kind == "flat":
        x = x * (np.arange(dim) < 12) + 0.05 * r.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["all", "shared", "narrow", "clusters", "flat"])
def test_recall_by_cosine_at_any_number_of_vectors(kind):
    """Planted pairs meet, and their codes are near, for the tables of 51,000, a million and a hundred million vectors."""
    r = np.random.default_rng(3)
    x = spread(kind, 4000, 64, r)
    for n in (51_000, 1_000_000) if kind == "narrow" else (51_000, 1_000_000, 100_000_000):
        m = itq.Model(x, n, 0.9)
        assert kind == "narrow" or n < 1_000_000 or m.bits >= 9  # with 0 bits all are compared
        own = spread(kind, 3000, 64, r)
        for low, high in ((0.9, 0.91), (0.91, 0.94), (0.94, 0.999)):
            c = r.uniform(low, high, size=(len(own), 1))
            way = r.normal(size=own.shape) if low < 0.94 else own[::-1] - 0.3 * own
            way -= (way * own).sum(axis=1, keepdims=True) * own
            other = c * own + np.sqrt(1 - c * c) * way / np.linalg.norm(way, axis=1, keepdims=True)
            (a, ka), (b, kb) = m.encode(own), m.encode(other)
            near = np.bitwise_count((a ^ b).view(np.uint64)).sum(axis=1) <= m.radius
            met = (ka == kb).any(axis=1) & near
            assert met.mean() >= 0.98, (kind, n, low, met.mean(), m.bits, m.tables)


def test_other_lengths_are_compared_too(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.1]), (3, [1.0, 0.0, -3.0]), (4, [1.0, 2.0]), (5, [1.0, 2.1]), (6, [0.5]), (7, [2.0]), (8, [-2.0]), (9, [1.0] * 5)]
    got = sorted((q.vec_id, q.n_links, q.component_id) for q in itq.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 6), (8, 0, 8), (9, 0, 9)]


def test_vectors_are_not_sent_where_nothing_is_near():
    """Hardly any pair of codes of vectors that are not near lies within the greatest distance."""
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, _ = itq.Model(x, 3000, 0.9).encode(x)
    far = np.bitwise_count((code[:, None, :] ^ code[None, :500, :]).view(np.uint64)).sum(axis=2)
    assert (far <= itq.Model(x, 3000, 0.9).radius).mean() < 0.05


def test_planted_pairs_among_many(spark):
    """Through all tables, buckets and blocks: links by brute force, with a dense group, copies and pairs at the threshold."""
    r = np.random.default_rng(8)
    x = r.normal(size=(5000, 24)) + 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    way = r.normal(size=(600, 24))
    way -= (way * x[:600]).sum(axis=1, keepdims=True) * x[:600]
    way /= np.linalg.norm(way, axis=1, keepdims=True)
    c = r.uniform(0.9, 0.97, size=(600, 1))
    x = np.concatenate([x, c * x[:600] + np.sqrt(1 - c * c) * way, x[700:701] + 0.04 * r.normal(size=(900, 24)), x[:50]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {q.vec_id: q for q in itq.near_duplicates(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    have = np.array([got[i].n_links for i in range(len(x))])
    want = hit.sum(axis=1)
    assert (have <= want).all() and have.sum() >= 0.98 * want.sum() and (have > 0).sum() >= 0.98 * (want > 0).sum()


def test_ties_and_copies_keep_the_least_key(spark):
    """Vectors that are equal, or equal but for their length, are one component under its least key; a pair right at the threshold is linked."""
    rows = [(7, [3.0, 4.0]), (3, [6.0, 8.0]), (5, [3.0, 4.0]), (3, [3.0, 4.0]), (9, [0.0, 1.0]), (11, [1.0, 0.0]), (12, [0.9, (1 - 0.81) ** 0.5 * (1 - 1e-12)])]
    got = sorted((q.vec_id, q.component_id, q.kept) for q in itq.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), cosine=0.9).collect())
    assert [x for x in got if x[0] in (3, 5, 7)] == [(3, 3, True), (3, 3, True), (5, 3, False), (7, 3, False)]
    assert [x for x in got if x[0] in (11, 12)] == [(11, 3, False), (12, 3, False)] or [x for x in got if x[0] in (11, 12)] == [(11, 11, True), (12, 11, False)]
