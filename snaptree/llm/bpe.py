"""Byte-level BPE encoding and decoding with a two-tier lookup.

Each pre-token is first looked up whole in a minimal perfect hash over the vocabulary
(hash and displace: a bucket's displacement sends its keys to free slots; the slot holds
the rank, and the key's bytes are compared).  Only misses are merged: a heap of
(rank, position) over a doubly linked list of byte runs.
"""
from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import col

#: Distinct pre-tokens whose ids a worker remembers at most.
MEMO = 600_000
#: Keys in a bucket of the perfect hash, about.
BUCKET = 4


class PerfectHash:
    """Minimal perfect hash over byte strings; get() gives the value, or None for other keys."""

    def __init__(self, items: dict[bytes, int]):
        n = self.n = len(items)
        m = self.m = n // BUCKET + 1
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(m)]
        for key in items:
            h = xxhash.xxh3_128_intdigest(key)
            buckets[(h >> 64) % m].append((h & 0xFFFFFFFFFFFFFFFF, key))
        self.shift, self.keys, self.values = [0] * m, [None] * n, [0] * n
        free = bytearray(b"\1") * n
        spare = iter(range(n))
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:  # a slot of its own, coded below zero
                at = next(i for i in spare if free[i])
                self.shift[b], slots = -1 - at, [at]
            else:
                d = 0
                while True:
                    slots = [_slot(h, d, n) for h, _ in own]
                    if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                        break
                    d += 1
                self.shift[b] = d
            for s, (_, key) in zip(slots, own, strict=True):
                free[s], self.keys[s], self.values[s] = 0, key, items[key]

    def get(self, key: bytes):
        if not self.n:
            return None
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 64) % self.m]
        s = -1 - d if d < 0 else _slot(h & 0xFFFFFFFFFFFFFFFF, d, self.n)
        return self.values[s] if self.keys[s] == key else None


def _slot(h: int, d: int, n: int) -> int:
    x = (h + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    return ((x >> 32) * n) >> 32


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of least rank merges first, the leftmost of equals."""
    n = len(piece)
    ends = list(range(1, n + 1))  # ends[i]: where the run that starts at i ends; 0 once it is merged away
    before = list(range(-1, n - 1))
    rank, push, pop = ranks.get, heapq.heappush, heapq.heappop
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = pop(heap)
        mid = ends[i]
        if not mid or mid >= n or ends[mid] != end:
            continue  # one of the two runs has changed since
        ends[i], ends[mid] = end, 0
        if end < n:
            before[end] = i
            z = ends[end]
            if (q := rank(piece[i:z])) is not None:
                push(heap, (q, i, z))
        j = before[i]
        if j >= 0 and (q := rank(piece[j:end])) is not None:
            push(heap, (q, j, end))
    out, i = [], 0
    while i < n:
        z = ends[i]
        out.append(ranks[piece[i:z]])
        i = z
    return out


class Codec:
    """Encodes and decodes texts; the ids of recent distinct pre-tokens are remembered, MEMO at most."""

    def __init__(self, vocabulary: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.table = vocabulary, pattern, PerfectHash(vocabulary)
        self.tokens = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for k, v in vocabulary.items():
            self.tokens[v] = k
        self.__setstate__({})

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "memo")}

    def __setstate__(self, state):
        import regex

        self.__dict__.update(state)
        self.split, self.memo = regex.compile(self.pattern).findall, _Memo(self)

    def ids_of(self, pretoken: str) -> bytes:
        b = pretoken.encode("utf-8")
        whole = self.table.get(b)
        ids = [whole] if whole is not None else merge(b, self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; nothing for null and empty texts."""
        if not text:
            return b""
        if len(self.memo) > MEMO:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Memo(dict):
    def __init__(self, codec):
        self.codec = codec

    def __missing__(self, pretoken):
        self[pretoken] = x = self.codec.ids_of(pretoken)
        return x


def load(path: str) -> dict[bytes, int]:
    """Ranks of a rank file (one base64 token and rank in a line) on the driver's disk."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def encode(df: DataFrame, key: str, text: str, vocabulary: dict[bytes, int], pattern: str) -> DataFrame:
    """key, n_tokens, ids binary, decoded binary for each row of df.

    Null and empty texts give no ids and decode to nothing.  Repeated rows and null keys each get their own row, equal texts
    equal ids; further columns are left out; an empty table gives an empty one.
    """
    return _run(df, key, text, vocabulary, pattern, False)


def digests(df: DataFrame, key: str, text: str, vocabulary: dict[bytes, int], pattern: str) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 for each row of df: as encode(), without carrying the ids on."""
    return _run(df, key, text, vocabulary, pattern, True)


def _run(df, key, text, vocabulary, pattern, short):
    # made once, from a fixed file of 50,256 entries (a few MB); a worker keeps what it remembers from task to task
    shared = df.sparkSession.sparkContext.broadcast(Codec(vocabulary, pattern))
    kind = df.select(col(key)).schema[0].dataType.simpleString()
    names = [key, "n_tokens", "ids_sha256", "decoded_sha256"] if short else [key, "n_tokens", "ids", "decoded"]
    types = [pa.int64(), pa.string(), pa.string()] if short else [pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        codec = shared.value
        for b in batches:
            n, ids, back = [], [], []
            for t in b.column(1).to_pylist():
                x = codec.encode(t)
                y = codec.decode(x)
                n.append(len(x) // 4)
                ids.append(hashlib.sha256(x).hexdigest() if short else x)
                back.append(hashlib.sha256(y).hexdigest() if short else y)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip((n, ids, back), types, strict=True))], names=names)

    end = "ids_sha256 string, decoded_sha256 string" if short else "ids binary, decoded binary"
    return df.select(col(key), col(text)).mapInArrow(run, f"`{key.replace('`', '``')}` {kind}, n_tokens bigint, {end}")
