"""Embedding near-duplicates by iterative quantisation.

Rotations of the principal components are learnt on a bounded sample so that the signs of the
rotated vectors make balanced bits.  The bits are cut into tables of substrings (multi-index
Hamming tables): two vectors meet if they agree in any table.  How many bits a table has, and how
many tables it takes, is worked out from pairs at the threshold that are made around the sample, so a
direction that all vectors share costs tables, not links.

Tables hold ids and codes.  Vectors that meet go on if their whole codes are near; only then are
vectors fetched and reranked by the cosine of the original components, in blocks inside the
tasks.  A pair counts in the first table in which it meets.  Equal vectors are one class and only its
least id goes on.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleaned, col, saved
from .components import components

#: Vectors on which the rotations are learnt at most, rounds of learning, the seed, and rotations that are learnt.
SAMPLE, ROUNDS, SEED, LEARNT = 10_000, 30, 7, 16
#: Probability that a pair at the threshold is missed; pairs of each kind from which it is worked out; bits of a whole code.
MISS, PAIRS, CODE = 0.01, 2000, 256
#: Microseconds to send a code to a table and to compare two codes, about; they only choose the shape of the tables.
SHIP, COMPARE = 40.0, 0.02
#: Codes and vectors in a block of a bucket.
CODES, BLOCK = 2048, 512


def learn(sample: np.ndarray, n_rotations: int, rounds: int = ROUNDS, seed: int = SEED):
    """(mean, matrix): signs of (x - mean) @ matrix are the bits; matrix has dim columns for each rotation.

    Rotations beyond LEARNT of them, as very many tables need, stay as they are drawn.
    """
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    v = centred @ axes
    out = []
    for k in range(n_rotations):
        r, _ = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(v.shape[1],) * 2))
        for _ in range(rounds if k < LEARNT else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = w.T @ u.T
        out.append(axes @ r)
    return mean, np.concatenate(out, axis=1)


def bits_of(unit: np.ndarray, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return (unit - mean) @ matrix >= 0


def partners(unit: np.ndarray, cosine: float, seed: int = SEED):
    """Pairs of three kinds: a sample's vectors and others at the threshold, in random directions and towards vectors of the sample, and pairs of the sample above it."""
    r = np.random.default_rng(seed)
    own = unit[r.permutation(len(unit))[:PAIRS]]
    for way in (r.normal(size=own.shape), unit[r.integers(0, len(unit), len(own))] + 1e-9 * r.normal(size=own.shape)):
        way = way - (way * own).sum(axis=1, keepdims=True) * own
        size = np.linalg.norm(way, axis=1, keepdims=True)
        way = np.where(size > 1e-12, way / np.maximum(size, 1e-300), 0.0)
        yield own, cosine * own + np.sqrt(max(0.0, 1 - cosine * cosine)) * way
    i, j = np.nonzero(own @ unit.T >= cosine)
    other = (own[i] != unit[j]).any(axis=1)
    i, j = i[other], j[other]
    some = r.permutation(len(i))[:PAIRS]
    yield own[i[some]], unit[j[some]]


def n_tables(differ: list[np.ndarray], bits: int, miss: float = MISS) -> int:
    """Tables of so many bits in which pairs whose bits differ at the given rates (one array for each kind of pair) are missed with probability `miss` at most."""
    if not bits:
        return 1
    low, high = 0, 1
    meet = [(1 - d) ** bits for d in differ]
    enough = lambda t: all(((1 - q) ** t).mean() <= miss for q in meet)
    while not enough(high) and high < 1 << 20:
        low, high = high, 2 * high
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def shape(n: int, code: np.ndarray, differ: list[np.ndarray]) -> tuple[int, int]:
    """(bits of a table, number of tables) of least cost for n vectors; with 0 bits all meet in one table."""
    best = None
    for bits in range(25):
        tables = n_tables(differ, bits)
        share = 1.0  # of pairs that meet in a table
        if bits:
            seen = []
            for t in range(max(1, min(4, code.shape[1] // bits))):
                _, c = np.unique(code[:, t * bits : (t + 1) * bits] @ (1 << np.arange(bits)), return_counts=True)
                seen.append((c * (c - 1.0)).sum() / max(1, len(code) * (len(code) - 1)))
            share = max(np.mean(seen), 0.5**bits)
        cost = tables * (SHIP + n * share * COMPARE)
        if best is None or cost < best[0]:
            best = (cost, bits, tables)
    return best[1], best[2]


def keys(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Substrings of the codes, int32, one column for each table."""
    return (code[:, : bits * tables].reshape(len(code), tables, bits) @ (1 << np.arange(bits))).astype(np.int32)


class Model:
    """Rotations, the shape of the tables, and the greatest distance of codes that goes on."""

    def __init__(self, unit: np.ndarray, n: int, cosine: float):
        dim = unit.shape[1]
        mean, matrix = learn(unit, -(-CODE // dim))
        made = [(bits_of(x, mean, matrix)[:, :CODE], bits_of(y, mean, matrix)[:, :CODE]) for x, y in partners(unit, cosine) if len(x)]
        far = [(a != b).sum(axis=1) for a, b in made]
        # few vectors are all compared
        self.bits, self.tables = shape(n, bits_of(unit, mean, matrix)[:, :CODE], [d / CODE for d in far]) if n > CODES else (0, 1)
        self.radius = int(max(d.max() + d.std() for d in far)) + 1 if n > CODES else CODE
        more = -(-self.bits * self.tables // dim)
        self.mean, self.matrix = (mean, matrix) if more * dim <= matrix.shape[1] else learn(unit, more)

    def encode(self, unit: np.ndarray):
        """(codes as rows of CODE / 64 int64, keys of the tables)."""
        code = bits_of(unit, self.mean, self.matrix)
        return np.packbits(code[:, :CODE], axis=1, bitorder="little").view(np.int64), keys(code, self.bits, self.tables)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _groups(batches, names):
    """Tables of the rows that agree in the named columns; rows come sorted by them."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        own = pa.Table.from_batches([b])
        own = own if held is None else pa.concat_tables([held, own]).combine_chunks()
        k = np.stack([own.column(c).to_numpy().astype(np.int64) for c in names])
        start = 0
        for c in (np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist():
            yield own.slice(start, c - start)
            start = c
        held = own.slice(start)
    if held is not None:
        yield held


def _halves(t: pa.Table):
    """(rows of the left block, rows of the right one or None if it is compared with itself)."""
    left = t.column("left").to_numpy()
    if t.column("i")[0].as_py() == t.column("j")[0].as_py():
        return np.flatnonzero(left), None
    return np.flatnonzero(left), np.flatnonzero(~left)


def _near(model):
    """Rows table, bucket, i, j, left, id, code, sorted: id and table of those with a near code, which did not meet before as far as the codes tell."""

    def run(batches):
        m = model.value
        for t in _groups(batches, ("table", "bucket", "i", "j")):
            a, b = _halves(t)
            if len(a) < 1 or (b is None and len(a) < 2) or (b is not None and not len(b)):
                continue
            code = np.stack([t.column(f"c{w}").to_numpy() for w in range(CODE // 64)], axis=1).view(np.uint64)
            table = t.column("table")[0].as_py()
            before = min(table, CODE // m.bits) if m.bits else 0
            sub = np.unpackbits(code.view(np.uint8), axis=1, bitorder="little")[:, : before * m.bits] if before else None
            k = keys(sub, m.bits, before) if before else None
            right = a if b is None else b
            hit = np.zeros(t.num_rows, dtype=bool)
            for at in range(0, len(a), 256):
                x = a[at : at + 256]
                far = np.zeros((len(x), len(right)), dtype=np.int32)
                for w in range(CODE // 64):
                    far += np.bitwise_count(code[x, w][:, None] ^ code[right, w][None, :])
                near = far <= m.radius
                if b is None:
                    near &= np.arange(len(right))[None, :] > np.arange(at, at + len(x))[:, None]
                i, j = np.nonzero(near)
                i, j = x[i], right[j]
                for s in range(0, len(i), 100_000):
                    p, q = i[s : s + 100_000], j[s : s + 100_000]
                    if before:
                        fresh = ~(k[p] == k[q]).any(axis=1)
                        p, q = p[fresh], q[fresh]
                    hit[p] = hit[q] = True
            if hit.any():
                ids = t.column("id").to_numpy()[hit]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.full(len(ids), table), pa.int32())], names=["id", "table"])

    return run


def _linked(cosine: float):
    """Rows table, bucket, i, j, left, id, size, vector, keys, sorted: id, links, other of the pairs that meet first in this table."""

    def run(batches):
        for t in _groups(batches, ("table", "bucket", "i", "j")):
            a, b = _halves(t)
            if not len(a) or (b is not None and not len(b)):
                continue
            x = np.frombuffer(b"".join(t.column("vector").to_pylist()), "<f8").reshape(t.num_rows, -1)
            k = np.frombuffer(b"".join(t.column("keys").to_pylist()), "<i4").reshape(t.num_rows, -1)[:, : t.column("table")[0].as_py()]
            size, ids = t.column("size").to_numpy(), t.column("id").to_numpy()
            right = a if b is None else b
            hit = x[a] @ x[right].T >= cosine
            if b is None:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            i, j = a[i], right[j]
            if k.shape[1]:
                fresh = np.concatenate([~(k[i[s : s + 100_000]] == k[j[s : s + 100_000]]).any(axis=1) for s in range(0, len(i), 100_000)] or [np.empty(0, dtype=bool)])
                i, j = i[fresh], j[fresh]
            links = np.bincount(i, size[j], t.num_rows) + np.bincount(j, size[i], t.num_rows)
            # what each row is joined to, so that the links of the block are spanned by one edge a row
            root = np.arange(t.num_rows)
            while True:
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            m = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (ids[m], links[m].astype(np.int64), ids[root[m]])], names=["id", "links", "other"])

    return run


def _blocked(rows: DataFrame, block: int, parts: int, rest: list[str]) -> DataFrame:
    """rows (table, bucket, id, rest) for each pair of blocks (i, j) of their bucket, dealt and sorted; left: the row is of block i."""
    large = saved(rows.groupBy("table", "bucket").agg(F.count("*").alias("c")).where(F.col("c") > block).select("table", "bucket", F.ceil(F.col("c") / block).cast("int").alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    i = F.pmod(F.xxhash64("id", F.lit(2)), blocks).cast("int")
    task = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), (i <= j).alias("left")))
    out = rows.join(large, ["table", "bucket"], "left").select("table", "bucket", F.explode(task).alias("t"), "id", *rest)
    out = out.select("table", "bucket", "t.i", "t.j", "t.left", "id", *rest)
    return out.repartition(parts, "table", "bucket", "i", "j").sortWithinPartitions("table", "bucket", "i", "j")


def _links_of(reps: DataFrame, n: int, cosine: float, sample: int) -> DataFrame:
    """id, links, other for the representatives (id, size, v) of n classes of vectors of one length."""
    spark = reps.sparkSession
    drawn = reps.orderBy(F.xxhash64("id")).limit(sample).select("v").toPandas()
    model = spark.sparkContext.broadcast(Model(_unit(np.stack(drawn.v.to_numpy()).astype(float)), n, cosine))  # dim x (bits x tables) numbers
    tables = model.value.tables

    def encode(batches):
        m = model.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(np.stack(b.column(2).to_numpy(zero_copy_only=False)).astype(float))
            code, at = m.encode(x)
            cols = [b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in at.astype("<i4")], pa.binary()), pa.array(list(at), pa.list_(pa.int32())), *(pa.array(code[:, w]) for w in range(CODE // 64))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "size", "vector", "keys", "at", *words])

    words = [f"c{w}" for w in range(CODE // 64)]
    coded = saved(reps.select("id", "size", "v").mapInArrow(encode, f"id bigint, size bigint, vector binary, keys binary, at array<int>, {', '.join(w + ' bigint' for w in words)}"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = coded.select("id", *words, F.posexplode("at").alias("table", "bucket"))
    near = _blocked(met, CODES, max(least, n * tables // 200_000), words).mapInArrow(_near(model), "id bigint, table int")
    near = saved(near.distinct())
    full = near.join(coded, "id").select("table", F.get("at", F.col("table")).alias("bucket"), "id", "size", "vector", "keys")
    return saved(_blocked(full, BLOCK, max(least, near.count() // 20_000), ["size", "vector", "keys"]).mapInArrow(_linked(cosine), "id bigint, links bigint, other bigint"))


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


@cleaned
def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, sample: int = SAMPLE) -> DataFrame:
    """key, n_links, component_id, kept for each row of df.

    Rows are linked if the cosine of their vectors, in double precision, is at least `cosine`.  Vectors that are
    null, empty or zero, or hold null or non-finite components, are linked with nothing, and vectors of different
    lengths never with each other; each length has its own tables.  n_links counts the other rows linked directly;
    component_id: the least key reachable, itself included; kept: the key is that one, so ties leave the least key.  Rows that
    repeat a key each count and are kept alike (with other vectors they are one node, whose links add up); a null key is linked with nothing.  Further columns are left out.
    sample: vectors at most from which the rotations are learnt; all vectors are indexed.
    """
    spark = df.sparkSession
    rows = df.select(col(key).cast("bigint").alias("id"), col(vector).cast("array<double>").alias("v"))
    rows = rows.select("id", F.when(_usable(F.col("v")) & F.col("id").isNotNull(), F.col("v")).alias("v"))
    rows = saved(rows.select("id", "v", F.size("v").alias("d"), F.xxhash64("v").alias("h"), F.xxhash64("v", F.lit(1)).alias("g")))
    good = rows.where("v is not null")
    classes = saved(good.groupBy("d", "h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("size")))
    reps = good.join(classes.withColumnRenamed("rep", "id"), ["id", "d", "h", "g"]).dropDuplicates(["id", "d", "h", "g"]).select("id", "d", "size", "v")
    # a key that is repeated with other vectors may stand for several classes; its rows are one node of the graph
    found = spark.createDataFrame([], "id bigint, links bigint, other bigint")
    lengths = classes.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").orderBy("d").collect()  # lengths that occur twice
    for r in lengths:
        found = found.unionByName(_links_of(reps.where(F.col("d") == r["d"]), r["n"], cosine, sample))
    counts = saved(found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep"))
    comp = saved(components(found.select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "rep"))
    of = rows.drop("v").join(classes, ["d", "h", "g"], "left").select("id", F.when(F.col("id").isNotNull(), F.col("rep")).alias("rep"), "size")
    out = of.join(counts, "rep", "left").join(comp, "rep", "left")
    links = F.when(F.col("rep").isNull(), F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.col("size") - 1)
    out = out.select(F.col("id").alias(key), links.cast("bigint").alias("n_links"), F.coalesce("component_id", "rep", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(col(key) == F.col("component_id"), F.lit(True)))
