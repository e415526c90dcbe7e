import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from snaptree.llm import eliasfano, lm

TEXTS = [None, "", "a B c", "a b", "A B C a b c", "x", "é É", " \n", "b c d e f " * 400, "a b c", "word " * 60_000, "z" * 3_000_000] + [f"w{i % 7} w{i % 3} the end" for i in range(40)]
HOT_TEXTS = [" ".join(r.choice(["x", "y", "u1", "u2", "rare"], p=[0.4, 0.4, 0.1, 0.05, 0.05]) + ("" if k % 3 else str(int(r.integers(6)))) for k in range(60)) for r in map(np.random.default_rng, range(60))]


def words(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()


def held(key):
    return key is not None and crc32(str(key).encode()) % 10 == 0


def coded(x):
    return float(eliasfano.probability(eliasfano.quantise(np.array([x])))[0])


def plain(rows, order, is_held=held):
    """(key, held out, tokens, known, training tokens, base, score) of each row by dictionaries; probabilities are rounded as the trie's are."""
    grams = Counter()
    for key, t in rows:
        if not is_held(key):
            w = [*range(order - 1), *words(t), None]
            grams.update(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    single = {g: c for g, c in grams.items() if len(g) == 1 and not isinstance(g[0], int)}
    n, v = sum(single.values()), len(single)
    out = []
    for key, t in rows:
        w = [*range(order - 1), *words(t), None]
        base = score = 0.0
        for i in range(order - 1, len(w)):
            p = (single.get((w[i],), 0) + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p)
            for k in range(2, order + 1):
                gram = tuple(w[i - k + 1 : i + 1])
                c, m = grams[gram[:-1]], lm.MASS[k]
                p = coded(grams[gram] / (c + m)) + coded(m / (c + m)) * p
            score += math.log10(p)
        out.append((key if key is not None else -1, is_held(key), len(w) - order + 1, sum((x,) in single for x in w[order - 1 :]), n, base, score))
    return out


def same(got, want):
    """Rows with sums of logarithms that agree to 1e-9 of them."""
    name = lambda x: (x[:5], round(x[6], 3))
    got, want = sorted(got, key=name), sorted(want, key=name)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9), w[:5]


def scored(df, **kw):
    return [(q.doc_id if q.doc_id is not None else -1, q.held_out, q.n_tokens, q.n_known, q.train_tokens, q.base_score, q.score) for q in lm.score(df, **kw).collect()]


@pytest.mark.parametrize("order", [2, 3, 4])
def test_against_brute_force(spark, order):
    rows = [*enumerate(TEXTS), (2, "a c c"), (2, "a c c"), (None, "a b c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("id", F.lit("clash")).withColumn("chunk", F.lit(1)).withColumn("held_out", F.lit("clash"))
    want = plain(rows, order)
    # many small chunks and shards, then also by way of relays
    for kw in ({}, {"chunk_bytes": 2000, "shard_bytes": 100_000}, {"chunk_bytes": 2000, "shard_bytes": 300_000, "direct": 0}) if order == 3 else ({},):
        got = scored(df, order=order, **kw)
        same(got, want)
    assert any(x[1] for x in got)


def test_words_and_pairs_that_are_split(spark):
    """Parts of a few tokens: almost all words are split, and pairs of them as well; the scores are the same."""
    rows = list(enumerate(HOT_TEXTS))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    same(scored(df, chunk_bytes=3000, shard_bytes=2000, hot=40), plain(rows, 3))


def test_a_split_word_is_spread():
    """A word and a pair with most tokens: no shard has much more than a part's share of their n-grams."""
    r = np.random.default_rng(0)
    text = b"".join(b"of the w%d " % i for i in r.integers(0, 10_000, 30_000))
    ids, starts, n_words = lm.padded(text, np.array([len(text)]), 3)
    hashes, _ = lm.word_hashes(b"of the")
    hot = lm.Hot({int(h): 30_000 for h in hashes}, 1000)
    g = lm.Grams(ids, starts, np.ones(len(ids), dtype=bool), 3, 50, hot)
    cold = lm.Grams(ids, starts, np.ones(len(ids), dtype=bool), 3, 50, lm.Hot({}, 1000))
    most = lambda x: np.diff(x.bounds[2]).max() / len(x.levels[2])
    assert most(cold) > 0.3 and most(g) < 0.12


def test_probabilities_of_a_context_sum_to_one():
    """Of a shard's trie: what follows a node, and its weight for shorter contexts; and so the whole model."""
    r = np.random.default_rng(1)
    text = " ".join(f"w{i}" for i in r.zipf(1.3, 30_000) if i < 3000).encode() + b"\n"
    ids, starts, _ = lm.padded(text, np.array([len(text)]), 3)
    hot = lm.Hot({}, 1 << 40)
    g = lm.Grams(ids, starts, np.ones(len(ids), dtype=bool), 3, 1, hot)
    trie = lm.shard_model([lm.asked_for(g.trie(0))], hot, 3)
    for k in (1, 2):
        parent, _ = trie.nodes(k)
        a = np.bincount(parent, eliasfano.probability(trie.payload[k][0]), trie.words[k - 1].n)
        b = eliasfano.probability(trie.payload[k - 1][1])
        with_children = np.diff(trie._once(k, lambda k=k: trie.pointers[k - 1].values().astype(np.int64))) > 0
        assert np.abs((a + b)[with_children] - 1).max() < 4e-4 and np.abs((a + b)[with_children] - 1).mean() < 2e-4


def test_no_training_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = sorted((q.doc_id, q.n_tokens, q.n_known, q.train_tokens, q.held_out) for q in lm.score(df, held_out=F.lit(True)).collect())
    assert got == [(1, 3, 0, 0, True), (2, 1, 0, 0, True)]
    assert lm.score(df.limit(0)).count() == 0


def test_the_model_beats_the_unigrams_on_held_out_text(spark):
    """Third words follow from the two before them, which pairs alone cannot tell."""
    r = np.random.default_rng(0)
    rows = [(i, " ".join(f"{a} {b} then{(a + b) % 9}" for a, b in r.integers(0, 9, (40, 2)).tolist())) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    two, three = (lm.score(df, order=k).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first() for k in (2, 3))
    assert two.s > two.b and three.s > two.s + 200


def test_tries(tmp_path):
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        roots = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        vocabulary = np.unique(r.integers(0, 1 << 32, 300, dtype=np.uint64))
        nodes = np.unique(r.integers(0, max(1, len(roots)) * len(vocabulary), 3 * len(roots)))
        parent, number = nodes // len(vocabulary), nodes % len(vocabulary)
        trie = eliasfano.Trie.of(vocabulary, roots, [parent], [number], [[np.arange(len(roots)).astype("<u2")], [np.arange(len(nodes)).astype("<u4")]])
        mapped = trie.save(f"{tmp_path}/trie{n}")
        assert (mapped.root(roots) == np.arange(len(roots))).all() and (mapped.root(roots + np.uint64(1)) == -1).all()
        assert (mapped.child(1, parent, mapped.numbers(vocabulary)[number]) == np.arange(len(nodes))).all()
        there = set(zip(parent.tolist(), number.tolist(), strict=True))
        ask = [(p, w) for p in range(min(50, len(roots))) for w in range(len(vocabulary))]
        got = mapped.child(1, np.array([p for p, _ in ask], dtype=np.int64), np.array([w for _, w in ask], dtype=np.int64))
        assert [(g >= 0) for g in got] == [x in there for x in ask]
        assert (mapped.child(1, np.full(len(number), -1), number) == -1).all() and [x.tolist() for y in mapped.payload for x in y] == [x.tolist() for y in trie.payload for x in y]


def test_hashes_of_words():
    """Words are cut at ASCII white space alone, A-Z are lower-cased alone, and pieces of the text do not matter."""
    text = "a B\tab\x0bAB é É x  \r\nz\x1cq ".encode() * 50_000
    hashes, places = lm.word_hashes(text)
    w = text.lower().split()
    assert len(hashes) == len(w)
    assert len(set(zip(hashes.tolist(), w, strict=True))) == len(set(w)) == len(set(hashes.tolist())) and text[places[5] : places[5] + 2] == "É".encode()[:2]
