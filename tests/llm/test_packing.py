import itertools
import random

import pytest
from pyspark.sql import functions as F

from snaptree.llm import packing

SIZES = (4, 8, 16)


def least_cost(lengths, sizes, price):
    """Brute force over all ways to part the pieces."""
    best = [float("inf")]

    def go(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(price(min(s for s in sizes if s >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= sizes[-1]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("price", [packing.cost, lambda s: s + s * s / 10], ids=["near linear", "steep"])
def test_best_fit(price):
    r = random.Random(1)
    ratios = []
    for _ in range(60):
        lengths = [r.randint(1, 16) for _ in range(r.randint(1, 7))]
        at, offset, size = packing.best_fit(lengths, SIZES, price)
        for b, s in enumerate(size):
            own = sorted((offset[i], lengths[i]) for i in range(len(lengths)) if at[i] == b)
            assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
            fill = sum(n for _, n in own)
            assert 0 < fill <= s and s == min((c for c in SIZES if c >= fill), key=price)
        ratios.append(sum(map(price, size)) / least_cost(lengths, SIZES, price))
    assert min(ratios) > 0.999999 and max(ratios) < 1.5 and sum(ratios) / len(ratios) < 1.06
    assert packing.best_fit([]) == ([], [], [])


def test_table(spark):
    rows = [(i, "w " * (i * 37 % 400)) for i in range(300)] + [(5, "w " * 185), (None, "a b"), (900, None), (901, ""), (902, "w " * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("clash")).withColumn("n", F.lit(1))
    got = packing.pack(df, shard_rows=100).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_size", "bin_fill"]
    want = sorted(len((t or "").split()) + 1 for _, t in rows)
    one = got.groupby(["doc_id", "piece"], dropna=False).n_tokens
    assert sum(want) == int(got.n_tokens.sum()) and (one.count() == 1).sum() >= len(rows) - 2
    assert list(got[got.doc_id == 902].sort_values("piece").n_tokens) == [8192, 8192, 20001 - 2 * 8192]
    for _, own in got.groupby("bin_id"):
        own = own.sort_values("bin_offset")
        assert list(own.bin_offset) == [0, *own.n_tokens.cumsum()][:-1] and set(own.bin_fill) == {own.n_tokens.sum()}
        assert own.bin_fill.iloc[0] <= own.bin_size.iloc[0] and own.bin_size.iloc[0] in packing.SIZES
    odd = packing.pack(spark.createDataFrame([(1, None), (2, -3), (3, 0), (4, 9)], "doc_id bigint, k int"), length=F.col("k"), text="k").toPandas().set_index("doc_id")
    assert odd.bin_id.isna().tolist() == [i != 4 for i in odd.index] and odd.n_tokens.to_dict() == {1: 0, 2: 0, 3: 0, 4: 9}
    assert packing.pack(df.limit(0)).count() == 0


def test_equal_rows_are_spread(spark):
    df = spark.createDataFrame([(7, "a b")], "doc_id bigint, text string").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20_000))))
    rows = packing._dealt(df.select(F.col("doc_id").alias("key"), F.lit(3).cast("bigint").alias("n")), 1000)[0].groupBy("shard").count().collect()
    assert len(rows) >= 15 and max(r["count"] for r in rows) <= 2000
    got = packing.pack(df, shard_rows=1000)
    assert got.count() == 20_000 and got.agg(F.sum("n_tokens")).first()[0] == 60_000
    fill = got.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.max("bin_fill").alias("f"), F.max("bin_size").alias("s"))
    assert fill.where("n <> f or f > s").count() == 0


def test_sequences(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(i * 53 % 700))) for i in range(60)] + [(99, "x " * 9000), (100, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("bin_id", F.lit("clash"))
    got = packing.sequences(packing.pack(df), df).collect()
    assert all(len(q.words) <= q.bin_size for q in got)
    ends = sorted(w for q in got for w in q.words)
    assert ends == sorted(w for _, t in rows for w in [*(t or "").split(), ""])
    with pytest.raises(Exception, match="repeated"):
        packing.sequences(packing.pack(df), df.union(df)).collect()


def test_ties_keep_the_order_of_keys(spark):
    df = spark.createDataFrame([(i, "w " * 511) for i in range(8)], "doc_id bigint, text string")
    got = {q.doc_id: (q.bin_id, q.bin_offset) for q in packing.pack(df, sizes=(1024,)).collect()}
    assert [got[i] for i in range(8)] == [(i // 2, i % 2 * 512) for i in range(8)]
