"""Near-duplicates by circulant MinHash.

Two permutations give all coordinates of a signature: the first scatters a text's shingles
over a ring, the second numbers the ring, and coordinate k is the least number among the
shingles' places shifted by k.  Bands of the signature name candidates, and links are
confirmed on full shingle sets.

Texts with equal sets are one class and only its least id goes on.  In each band bucket the
members are compared with the bucket's most connected text, which joins a family of copies
without its pairs; buckets that still hold several components are then compared in blocks,
stragglers against all others, inside the tasks.
"""
from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cleaned, col, fresh, saved, split_by, tasks_for
from .components import components

#: Coordinates of a signature, places on the ring, and the permutations' seed.
COORDINATES, RING, SEED = 120, 1 << 20, 20
#: A pair at the threshold may be missed with this probability at most.
MISS = 1e-4
#: Members that one task compares with a hub; shingles in a block of a bucket, where a text counts as
#: so many more (a block has 1,000 texts at most, about).
HUB_MEMBERS, BLOCK_SHINGLES, LEAST_WEIGHT = 500, 200_000, 200
#: Distinct words whose hashes a worker remembers at most.
MEMO = 500_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


class _Memo(dict):
    def __missing__(self, word):
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, k: int):
        self.k, self.memo = k, _Memo()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
        n = len(words)
        if not n:
            return np.empty(0, dtype=np.uint64)
        if len(self.memo) > MEMO:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, n)
        k = min(self.k, n)
        out = np.full(n - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = mix(out + h[i : n - k + 1 + i]) * _ODD[i % 8]
        return np.unique(out)


def rows_of_band(percent: int, coordinates: int = COORDINATES) -> int:
    """The most rows for which a pair at the threshold is missed with probability MISS at most."""
    t = percent / 100
    return max([r for r in range(1, 33) if (1 - t**r) ** (coordinates // r) <= MISS], default=1)


class Signer:
    def __init__(self, rows: int, coordinates: int = COORDINATES):
        self.rows, self.bands, self.k = rows, coordinates // rows, coordinates
        ring = np.random.default_rng(SEED).permutation(RING).astype(np.uint32)
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:coordinates]]), coordinates)
        self.odd = np.random.default_rng(SEED + 1).integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        place = (mix(shingles + np.uint64(SEED)) >> np.uint64(44)).astype(np.int64)  # the first permutation
        least = np.full(self.k, RING, dtype=np.uint32)
        for i in range(0, len(place), 4096):
            np.minimum(least, self.shifts[place[i : i + 4096]].min(axis=0), out=least)  # the second, shifted
        return least

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        s = self.signature(shingles)[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        return mix(mix(s + np.uint64(1)) @ self.odd + np.arange(self.bands, dtype=np.uint64) * _ODD[0]).view(np.int64)


def signatures(df: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """id, n_shingles, fp1, fp2 (equal for equal sets; null for none), bands of each row."""
    rows = rows_of_band(percent)

    def run(batches):
        shingle, signer = Shingler(k), Signer(rows)
        for b in batches:
            n, f1, f2, bands = [], [], [], []
            for t in b.column(1).to_pylist():
                s = shingle(t)
                n.append(len(s))
                if not len(s):
                    f1.append(None), f2.append(None), bands.append(None)
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                f1.append((d >> 64) - (1 << 63)), f2.append((d & 0xFFFFFFFFFFFFFFFF) - (1 << 63)), bands.append(signer.band_keys(s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "n_shingles", "fp1", "fp2", "bands"])

    return df.select(col(key).cast("bigint").alias("id"), col(text)).mapInArrow(run, "id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>")


def linked(inter, a, b, percent: int):
    """100 * intersection >= percent * union."""
    return 100 * inter >= percent * (a + b - inter)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _batch(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], schema=_LINKS)


def _rows(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _against_hub(k: int, percent: int):
    """Rows hub, salt, is_member, id, text, sorted: the hub's text, then its members'."""

    def run(batches):
        shingle, hub, own, found = Shingler(k), None, None, []
        for h, salt, member, i, t in _rows(batches):
            if not member:
                hub, own = (h, salt), shingle(t)
                continue
            if hub != (h, salt):
                raise ValueError("a hub's text is missing")
            s = shingle(t)
            if linked(len(np.intersect1d(own, s, assume_unique=True)), len(own), len(s), percent):
                found.append((i, h))
                if len(found) >= 10_000:
                    yield _batch(found)
                    found = []
        yield _batch(found)

    return run


def block_links(left: list, right: list | None, percent: int):
    """Links between texts (id, component, shingles) of two blocks, or within one, that join components.

    Intersections are counted by products of 0/1 matrices, over the shingles that both sides have.
    """
    all_ = left + (right or [])
    if len(all_) < 2:
        return []
    docs = np.repeat(np.arange(len(all_)), [len(x[2]) for x in all_])
    values, col = np.unique(np.concatenate([x[2] for x in all_]), return_inverse=True)
    n = len(left)
    in_left = docs < n
    lcount = np.bincount(col[in_left], minlength=len(values))
    rcount = np.bincount(col[~in_left], minlength=len(values)) if right is not None else lcount - 1
    use = (lcount > 0) & (rcount > 0)
    number = np.cumsum(use) - 1
    keep = use[col]
    docs, col = docs[keep], number[col[keep]]
    order = np.argsort(col, kind="stable")
    docs, col = docs[order], col[order]
    m = len(all_) - n if right is not None else n
    inter = np.zeros((n, m), dtype=np.float32)
    width = 2048
    edges = np.searchsorted(col, np.arange(0, (int(col[-1]) if len(col) else 0) + width, width)) if len(col) else [0]
    for i, a in enumerate(edges):
        z = edges[i + 1] if i + 1 < len(edges) else len(col)
        if a == z:
            continue
        d, c = docs[a:z], col[a:z] - i * width
        x = np.zeros((n, width), dtype=np.float32)
        x[d[d < n], c[d < n]] = 1
        if right is not None:
            y = np.zeros((m, width), dtype=np.float32)
            y[d[d >= n] - n, c[d >= n]] = 1
        else:
            y = x
        inter += x @ y.T
    size = np.array([len(x[2]) for x in all_], dtype=np.int64)
    inter = inter.astype(np.int64)
    rsize = size[n:] if right is not None else size
    hit = linked(inter, size[:n, None], rsize[None, :], percent)
    if right is None:
        hit = np.triu(hit, 1)
    other = right if right is not None else left
    # a spanning forest of the links is enough
    parent: dict = {}

    def find(x):
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = left[i], other[j]
        ra, rb = find(a[1]), find(b[1])
        if ra != rb:
            parent[ra] = rb
            out.append((a[0], b[0]))
    return out


def _in_blocks(k: int, percent: int):
    """Rows bucket, i, j, is_left, id, comp, text, sorted by the first three."""

    def run(batches):
        shingle = Shingler(k)
        for (_, i, j), group in groupby(_rows(batches), key=lambda r: r[:3]):
            left, right = [], []
            for _, _, _, is_left, doc, comp, text in group:
                (left if is_left else right).append((doc, comp, shingle(text)))
            yield _batch(block_links(left, None if i == j else right, percent))

    return run


def candidates(classes: DataFrame) -> DataFrame:
    """bucket, id, n, total: band buckets that hold two classes or more; total: sizes of all the id's buckets."""
    rows = saved(classes.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")))
    several = saved(rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1"))
    rows = saved(rows.join(several, "bucket"))
    total = saved(rows.groupBy("id").agg(F.sum("c").alias("total")))
    return saved(rows.join(total, "id").select("bucket", "id", "n", "total"))


def links(docs: DataFrame, key: str, text: str, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links between class representatives that span every component of the linked pairs."""
    member = candidates(classes)
    hubs = saved(member.groupBy("bucket").agg(F.max(F.struct("total", (-F.col("id")).alias("id"))).alias("h")).select("bucket", (-F.col("h.id")).alias("hub")))
    pairs = saved(member.join(hubs, "bucket").where("id <> hub").select("hub", "id").distinct())
    texts = docs.select(col(key).cast("bigint").alias("id"), col(text).alias("text"))
    involved = saved(member.select("id").distinct())
    texts = saved(split_by(texts, "id", involved)[0].join(involved, "id", "left_semi").dropDuplicates(["id"]))
    # each hub's text goes to as many tasks as its members fill
    salts = saved(pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("salts")))
    salted = pairs.join(salts, "hub").select("hub", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), "id")
    hub_rows = salts.join(texts, salts.hub == texts.id).select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"), "id", "text")
    member_rows = salted.join(texts, "id").select("hub", "salt", F.lit(True).alias("member"), "id", "text")
    dealt = hub_rows.unionByName(member_rows).repartition(_parts(texts), "hub", "salt").sortWithinPartitions("hub", "salt", "member")
    first = saved(dealt.mapInArrow(_against_hub(k, percent), "a bigint, b bigint"))

    comp = saved(components(first))
    placed = saved(member.join(comp, "id", "left").select("bucket", "id", "n", F.coalesce("component_id", "id").alias("comp")))
    mixed = saved(placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi and c > 2"))
    # the component that holds most of a bucket is not compared with itself
    by_comp = placed.join(mixed.select("bucket"), "bucket").groupBy("bucket", "comp").agg(F.sum(F.col("n") + LEAST_WEIGHT).alias("s"))
    by_comp = saved(by_comp)
    main = by_comp.groupBy("bucket").agg(F.max(F.struct("s", "comp")).alias("m"), F.sum("s").alias("all"))
    blocks = lambda c: F.ceil(c / BLOCK_SHINGLES).cast("int")
    main = saved(main.select("bucket", F.col("m.comp").alias("main"), blocks(F.col("m.s")).alias("mains"), blocks(F.col("all") - F.col("m.s")).alias("rests")))
    rows = placed.join(main, "bucket").select("*", (F.col("comp") == F.col("main")).alias("is_main"))
    h = F.xxhash64("id", F.lit(1))
    # a straggler in block i meets blocks i.. of stragglers (i, j) and all main blocks (i, rests + j)
    i = F.pmod(h, "rests").cast("int")
    seq = lambda a, b: F.sequence(a, b)
    task = lambda i, j, left: F.struct(i.alias("i"), j.alias("j"), left.alias("left"))
    of_rest = F.transform(seq(F.lit(0), F.col("rests") + F.col("mains") - 1), lambda j: task(F.least(i, j), F.when(j >= F.col("rests"), j).otherwise(F.greatest(i, j)), F.when(j >= F.col("rests"), F.lit(True)).otherwise(i <= j)))
    of_main = F.transform(seq(F.lit(0), F.col("rests") - 1), lambda s: task(s, F.col("rests") + F.pmod(h, "mains").cast("int"), F.lit(False)))
    rows = rows.select("bucket", "id", "comp", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_rest)).alias("t")).select("bucket", "t.i", "t.j", "t.left", "id", "comp")
    dealt = rows.join(texts, "id").select("bucket", "i", "j", "left", "id", "comp", "text")
    dealt = dealt.repartition(_parts(texts), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    second = dealt.mapInArrow(_in_blocks(k, percent), "a bigint, b bigint")
    return first.unionByName(second)


def _parts(texts: DataFrame) -> int:
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks_for(texts, 8, n)


@cleaned
def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept for each row of df.

    A text's set holds its distinct shingles of k words (A-Z lower-cased); with fewer words, the whole text
    as one.  Texts are linked if 100 * intersection >= percent * union.  Null, empty and blank texts have an
    empty set and are linked with nothing.  component_id: the least key reachable, itself included; kept: the
    key is that one, so ties and repeated texts leave the least key.  Rows that repeat a key are one document; rows
    with a null key are linked with nothing, have a null component and are kept.  Further columns are left out.
    """
    sig = saved(signatures(df, key, text, k, percent))
    classes = saved(sig.where("fp1 is not null and id is not null").groupBy("fp1", "fp2").agg(F.min("id").alias("rep")))
    reps = sig.join(classes, (sig.id == classes.rep) & (sig.fp1 == classes.fp1) & (sig.fp2 == classes.fp2)).select("id", "n_shingles", "bands").dropDuplicates(["id", "n_shingles"])
    found = links(df, key, text, reps, k, percent)
    # rows that repeat a key with another text tie their classes
    of = saved(sig.where("id is not null").join(classes, ["fp1", "fp2"], "left").select("id", "n_shingles", "rep"))
    twice = of.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    comp = saved(components(found.unionByName(twice)))
    comp = comp.withColumnRenamed("id", "rep")
    done = of.join(comp, "rep", "left").select(F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "rep", "id").alias("component_id"))
    rest = sig.where("id is null").select(F.col("id").alias(key), "n_shingles", F.lit(None).cast("bigint").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that near_duplicates() keeps; their columns are unchanged, whatever their names."""
    found = near_duplicates(df, key, text, k, percent)
    (other,) = fresh(df, "gone")
    gone = saved(found.where("not kept").select(col(key).alias(other)).distinct())
    maybe, stay = split_by(df, key, gone)
    return stay.union(maybe.join(gone, col(key) == F.col(other), "left_anti"))
