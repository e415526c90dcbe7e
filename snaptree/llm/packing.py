"""Best-fit packing into bins of several permitted capacities.

Only keys and lengths are shuffled.  Documents are dealt into shards of a bounded number
of rows by a hash of key and length; a shard that equal rows overfill is dealt out further
by row.  Each shard is one task and is packed on its own: best fit decreasing, where a
piece that fits in no open bin opens the least-cost size under each of several opening
policies; the cheapest outcome is kept, and each bin is cut down to the least-cost size
that holds its contents.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleaned, col, saved, words

#: Permitted sequence lengths, in tokens.
SIZES = (512, 1024, 2048, 4096, 8192)
#: Rows in a shard, about.
SHARD_ROWS = 50_000
#: Shards up to which the list of overfull ones is broadcast (12 bytes each).
BROADCAST_ROWS = 100_000


def cost(size: int) -> float:
    """Cost of a sequence: its tokens, attention that grows with the square, and a fixed part."""
    return size + size * size / 32768 + 64


def best_fit(lengths, sizes=SIZES, price=cost):
    """(bin of each piece, offset in it, size of each bin): the cheapest of all opening policies.

    lengths: positive integers, none above the largest size.  Ties go to the earlier piece
    and to the smaller opening size.
    """
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    best = None
    for least in sizes:
        # a policy opens, among the sizes from `least` on that hold the piece, the one of least cost a token
        opens = {s: min((c for c in sizes if c >= max(s, least)), key=lambda c: (price(c) / c, c)) for s in sizes}
        found = _pack(order, lengths, sizes, opens)
        for fitted in (found, _pack(order, lengths, sizes, {s: max(s, least) for s in sizes})):
            total = sum(price(_down(f, sizes)) for f in fitted[2])
            if best is None or total < best[0]:
                best = (total, fitted)
    if best is None:
        return [], [], []
    at, offset, fill = best[1]
    return at, offset, [_down(f, sizes) for f in fill]


def _down(fill: int, sizes) -> int:
    return next(s for s in sizes if s >= fill)


def _pack(order, lengths, sizes, opens):
    at, offset = [0] * len(lengths), [0] * len(lengths)
    fill: list[int] = []
    room: dict[int, list[int]] = {}  # bins by the room they have left
    mask = 0  # bit r is set if a bin has r tokens left
    for i in order:
        n = lengths[i]
        fit = mask >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                mask ^= 1 << r
        else:
            b, r = len(fill), opens[_down(n, sizes)]
            fill.append(0)
        at[i], offset[i] = b, fill[b]
        fill[b] += n
        if left := r - n:
            own = room.setdefault(left, [])
            if not own:
                mask |= 1 << left
            own.append(b)
    return at, offset, fill


def pack_shard(shard: int, keys, lengths: np.ndarray, sizes=SIZES, price=cost) -> pd.DataFrame:
    """Rows of pack() for one shard."""
    top = sizes[-1]
    keys, lengths = np.asarray(keys), np.asarray(lengths, dtype=np.int64)
    pieces = np.maximum(1, -(-lengths // top))
    row = np.repeat(np.arange(len(lengths)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = piece * top
    n = np.minimum(lengths[row] - start, top)
    full = np.flatnonzero(n)
    at, offset, size = best_fit(n[full].tolist(), sizes, price)
    bins, offsets, caps = np.full(len(row), -1), np.zeros(len(row), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
    if len(full):
        at = np.array(at)
        bins[full], offsets[full], caps[full] = at, offset, np.array(size)[at]
    filled = np.bincount(bins[full], weights=n[full], minlength=1).astype(np.int64) if len(full) else np.zeros(1, dtype=np.int64)
    out = pd.DataFrame({"piece": piece, "start": start, "n_tokens": n, "bin_id": bins + (shard << 32), "bin_offset": offsets, "bin_size": caps, "bin_fill": filled[np.maximum(bins, 0)]})
    out["bin_id"] = out.bin_id.astype("Int64").where(bins >= 0)
    for c in ("bin_offset", "bin_size", "bin_fill"):
        out[c] = out[c].astype("Int64").where(bins >= 0)
    out.insert(0, "key", pd.array(keys[row], dtype="Int64"))
    return out


def _dealt(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """(rows with their shard, number of shards): about shard_rows rows in each, twice as many at most, also where all rows are equal."""
    n = rows.count()
    first = max(1, -(-n // shard_rows))
    by = F.pmod(F.xxhash64("key", "n"), F.lit(first)).cast("int")
    rows = rows.withColumn("shard", by)
    c = F.count("*")
    over = saved(rows.groupBy("shard").agg(c.alias("c")).where(F.col("c") > 2 * shard_rows).select("shard", F.ceil(F.col("c") / shard_rows).cast("int").alias("parts")))
    most = over.agg(F.max("parts")).first()[0]
    if most is None:
        return rows, first
    # the rows of a part are picked by their place, so equal rows part too
    rows = rows.withColumn("row", F.monotonically_increasing_id()).join(F.broadcast(over) if first <= BROADCAST_ROWS else over, "shard", "left")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), "parts")).otherwise(0)
    return rows.select("key", "n", (part * first + F.col("shard")).cast("int").alias("shard")), first * most


@cleaned
def pack(df: DataFrame, key: str = "doc_id", text: str = "text", length: Column | None = None, sizes=SIZES, shard_rows: int = SHARD_ROWS, price=cost) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_size, bin_fill: a row for each piece of each row of df.

    length: tokens of a row; its words and one end token if not given.  Rows longer than the largest size are
    cut into pieces of that size and a rest.  Null and empty texts have only the end token.  A null or
    negative length counts as 0; such a row has one piece and no bin (nulls).  Repeated rows and null keys are packed
    like others, and no shard has many more than shard_rows rows whatever repeats; further columns are left out.
    """
    sizes = tuple(sorted(sizes))
    n = length if length is not None else F.size(words(col(text))) + 1
    rows = df.select(col(key).cast("bigint").alias("key"), F.greatest(F.coalesce(n.cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    rows, shards = _dealt(saved(rows), shard_rows)  # two numbers for each row: texts are read once

    def run(batches):
        own = pd.concat([*batches, pd.DataFrame({"key": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64"), "shard": pd.Series(dtype="int32")})])
        for shard, pdf in own.groupby("shard"):
            pdf = pdf.sort_values(["key", "n"], kind="stable")
            yield pack_shard(int(shard), pdf.key.astype("Int64").to_numpy(dtype=object), pdf.n.to_numpy(dtype=np.int64), sizes, price)

    kinds = "key bigint, piece bigint, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint, bin_size bigint, bin_fill bigint"
    return rows.repartitionById(shards, F.col("shard")).mapInPandas(run, kinds).withColumnRenamed("key", key)


def sequences(plan: DataFrame, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """bin_id, bin_size, keys, starts, words: the packed sequences of a plan that counts words.

    words: those of a bin's pieces one after another, each document closed by an empty word as its end token.  A bin
    is as large as the largest size at most, so no row is larger.  Pieces without a bin are left out.  Keys are to be
    unique: a repeated one is refused when a row is read.
    """
    rows = df.select(col(key).cast("bigint").alias("key"), F.concat(words(col(text)), F.array(F.lit(""))).alias("w"))
    once = rows.groupBy("key").agg(F.count("*").alias("c"), F.any_value("w").alias("w"))
    once = once.select("key", F.when(F.col("c") > 1, F.raise_error(F.lit("a key is repeated")).cast("array<string>")).otherwise(F.col("w")).alias("w"))
    p = plan.where("bin_id is not null").withColumnRenamed(key, "key")
    cut = p.join(once, p["key"].eqNullSafe(once["key"])).select("bin_id", "bin_size", "bin_offset", p["key"], "start", F.slice("w", F.col("start").cast("int") + 1, F.col("n_tokens").cast("int")).alias("w"))
    bins = cut.groupBy("bin_id", "bin_size").agg(F.array_sort(F.collect_list(F.struct("bin_offset", "key", "start", "w"))).alias("own"))
    own = F.col("own")
    return bins.select("bin_id", "bin_size", own["key"].alias("keys"), own["start"].alias("starts"), F.flatten(own["w"]).alias("words"))
