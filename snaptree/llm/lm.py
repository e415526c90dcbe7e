"""Language-model scores from an Elias-Fano n-gram trie that is spread over the cluster.

Texts are gathered into chunks.  A chunk sends the n-grams of its texts, with their training counts, as
small tries to shards, dealt by the first word.  A shard adds the counts up, works out smoothed
probabilities, quantises them, builds its part of the trie in a memory-mapped file, and looks up what each chunk
asked; the chunk, which has kept its order, scores its texts.  No model is gathered in one place.

The model interpolates: P(w | h) = a(h w) + b(h) P(w | shorter h), with a(h w) = c(h w) / (c(h) + M) and
b(h) = M / (c(h) + M), down to the unigrams.  A node of the trie holds a and, for what follows it, b; both add up
to one over all w up to their rounding.

With very many chunks and shards, requests and answers go by way of relays, each for a group of shards and a block of
chunks, so that the rows grow with the power 1.5 of the input and not with its square.

Words that occur very often are split: their pairs are dealt by the second word as well, and pairs of two such words
by the third, so no shard grows with a word or a pair.  Such a word's count is known to all, and each of a pair's
shards is sent the pair's whole count.
"""
from __future__ import annotations

import ctypes
import math
import struct
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col
from .eliasfano import U64, Trie, probability, quantise
from .minhash import mix

#: Weight of the shorter context, by order; bytes of text in a chunk and for each shard, about.
MASS, CHUNK_BYTES, SHARD_BYTES = {2: 20.0, 3: 10.0, 4: 10.0, 5: 10.0}, 8_000_000, 11_000_000
#: Tokens of a word from which it is split, into parts of about so many.
HOT = 2_000_000
#: Distinct words that a task counts before it passes them on.
WORDS = 2_000_000
#: Rows between chunks and shards up to which they are sent straight; above, by way of relays.
DIRECT = 50_000_000
#: Add-constant of the unigrams (fixed by the base score).
ADD = 0.1

END = U64(0x5EED0000000000E1)
#: What stands before a text, by distance from its first word.
BEFORE = [U64(0x5EED0000000000A7 + k) for k in range(8)]
_ODD = U64(0x9E3779B97F4A7C15)
_BASE, _BACK = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=U64)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Bytes that are hashed at a time, about.
PIECE = 1 << 20


class _Powers:
    """Powers of the hash's base and of its inverse, as many as the longest piece so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=U64)

    def to(self, n: int):
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(_BACK, k, 1 << 64))])
        return self.up, self.down


_powers = _Powers()


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of its first byte); A-Z count as a-z.  Equal words have equal hashes, others differ but for 64-bit chance."""
    raw = np.frombuffer(text, np.uint8)
    hashes, places = [], []
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw):  # a piece ends in white space
            gap = np.flatnonzero(_SPACE[raw[end : end + PIECE]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end = min(len(raw), end + PIECE)
        piece = raw[at:end]
        space = _SPACE[piece]
        edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
        first, last = edge[::2], edge[1::2]
        up, down = _powers.to(len(piece))
        sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(_LOWER[piece] * up[: len(piece)], dtype=U64)])
        hashes.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U64) * _ODD))
        places.append(first + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(places)) if hashes else (np.empty(0, dtype=U64), np.empty(0, dtype=np.int64))


def padded(text: bytes, ends: np.ndarray, order: int):
    """(tokens of all texts, each after order - 1 marks and closed by END; start of each text in them; its words).

    text: texts that are each followed by white space; ends: the place behind each.
    """
    hashes, places = word_hashes(text)
    n_words = np.diff(np.searchsorted(places, ends), prepend=0)
    size = n_words + order
    starts = np.cumsum(size) - size
    out = np.full(int(size.sum()), END, dtype=U64)
    for k in range(order - 1):
        out[starts + k] = BEFORE[order - 1 - k]
    number = np.arange(len(hashes)) + np.repeat(starts + order - 1 - (np.cumsum(n_words) - n_words), n_words)
    out[number] = hashes
    return out, starts, n_words


class Hot:
    """Words that are split: their hashes in order, and their counts in training."""

    def __init__(self, words: dict[int, int], part: int):
        self.words = np.array(sorted(words), dtype=U64)
        self.counts = np.array([words[w] for w in sorted(words)], dtype=np.int64)
        self.part = part

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Counts, 0 for words that are not split."""
        if not len(self.words):
            return np.zeros(len(ids), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return np.where(self.words[at] == ids, self.counts[at], 0)


def shard_of(word: np.ndarray, second, third, shards: int) -> np.ndarray:
    return (mix(word + second * _ODD + third * U64(0xC2B2AE3D27D4EB4F)) % U64(shards)).astype(np.int64)


class Grams:
    """The n-grams of a chunk as a trie for each shard.

    level k: the nodes of all shards one after another as columns; at[k]: the node of the window of k + 1 tokens that
    starts at each place; bounds[k]: where each shard's nodes start.  count[k]: training counts.
    """

    def __init__(self, ids: np.ndarray, starts: np.ndarray, train: np.ndarray, order: int, shards: int, hot: Hot):
        n = len(ids)
        left = (np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n)).astype(np.int32)  # tokens from here to the text's end
        vocabulary, word = np.unique(ids, return_inverse=True)
        word, size = word.astype(np.int32), max(1, len(vocabulary))
        self.vocabulary, self.word = vocabulary, word
        nxt = np.append(np.arange(1, n, dtype=np.int32), np.int32(n - 1)) if n else np.empty(0, dtype=np.int32)
        # each word has a place of its own, for its count and, if it is not split, for all that follows it
        own = shard_of(vocabulary, U64(0), U64(0), shards) * size + np.arange(len(vocabulary))
        # split words are dealt by the second word, and pairs of two of them by the third
        parts = np.maximum(1, -(-hot.of(vocabulary) // hot.part))
        often = parts > 1
        split = np.flatnonzero(often[word] & (left > 1))
        w, second = word[split], word[nxt[split]]
        by_second = (vocabulary[second] >> U64(7)) % parts[w].astype(U64)
        pair = np.where(often[second], np.minimum(parts[w], parts[second]), 1) if order > 2 else np.ones(len(split), dtype=np.int64)
        third = word[nxt[nxt[split]]]
        by_third = np.where(left[split] > 2, (vocabulary[third] >> U64(9)) % pair.astype(U64), U64(0))
        mine = shard_of(vocabulary[w], by_second, by_third, shards) * size + w
        # all shards of a split pair get its whole count, also those that hold none of its windows here
        many = np.flatnonzero(pair > 1)
        both = w[many].astype(np.int64) * size + second[many]
        _, first, inverse = np.unique(both, return_index=True, return_inverse=True)
        total = np.bincount(inverse, train[split[many]], len(first)).astype(np.int64)
        k = pair[many[first]]
        p = np.repeat(many[first], k)
        r = (np.arange(len(p)) - np.repeat(np.cumsum(k) - k, k)).astype(U64)
        more_next, more_count = second[p], np.repeat(total, k)
        roots, inverse = np.unique(np.concatenate([own, mine, shard_of(vocabulary[w[p]], by_second[p], r, shards) * size + w[p]]), return_inverse=True)
        self.own, extra = inverse[: len(own)], inverse[len(own) + len(mine) :]
        counts = np.zeros(len(roots), dtype=np.int64)
        counts[self.own] = np.bincount(word, train, len(vocabulary)).astype(np.int64)
        at = self.own.astype(np.int32)[word]
        at[split] = inverse[len(own) : len(own) + len(mine)]
        self.at, self.count, self.levels, self.parents = [at], [counts], [roots % size], []
        self.bounds = [np.searchsorted(roots // size, np.arange(shards + 1))]
        del split, w, second, third, by_second, by_third, mine, many, both, inverse
        above, reach = self.at[0], nxt
        for k in range(1, order):
            there = np.flatnonzero(left > k)
            mine = above[there].astype(np.int64) * size + word[reach[there]]
            with_extra = np.concatenate([mine, extra * size + more_next]) if k == 1 else mine
            nodes, inverse = np.unique(with_extra, return_inverse=True)
            counts = np.bincount(inverse[: len(there)], train[there], len(nodes)).astype(np.int64)
            if k == 1 and len(more_next):
                counts[inverse[len(there) :]] = more_count
            at = np.full(n, -1, dtype=np.int32)
            at[there] = inverse[: len(there)]
            parent = nodes // size
            self.parents.append(parent)
            self.levels.append(nodes - parent * size)
            self.at.append(at)
            self.count.append(counts)
            self.bounds.append(np.searchsorted(parent, self.bounds[-1]))
            above, reach = at, nxt[reach]
    def trie(self, s: int) -> bytes:
        """The nodes of a shard with their counts; nothing if there are none."""
        if self.bounds[0][s] == self.bounds[0][s + 1]:
            return b""
        cut = lambda k: slice(self.bounds[k][s], self.bounds[k][s + 1])
        below = range(1, len(self.levels))
        parents = [self.parents[k - 1][cut(k)] - self.bounds[k - 1][s] for k in below]
        words = [self.levels[k][cut(k)] for k in below]
        used = np.zeros(len(self.vocabulary), dtype=bool)
        for w in words:
            used[w] = True
        number = np.cumsum(used) - 1
        trie = Trie.of(self.vocabulary[used] >> U64(32), self.vocabulary[self.levels[0][cut(0)]], parents, [number[w] for w in words], [[_small(x[cut(k)])] for k, x in enumerate(self.count)], linked=False)
        return zstandard.ZstdCompressor(level=3).compress(trie.tobytes())


def _small(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max(initial=0))
    return counts.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4" if top < 1 << 32 else "<u8")


def asked_for(body: bytes) -> Trie:
    """What Grams.trie() gave."""
    return Trie.read(np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8))


def shard_model(asked: list[Trie], hot: Hot, order: int) -> Trie:
    """The shard's trie of all chunks' training counts.  payload: counts and b of the roots, then a and b of each level, a alone of the last."""
    heard = [t.vocabulary.values() for t in asked]
    vocabulary = np.unique(np.concatenate(heard))
    number = [np.searchsorted(vocabulary, x) for x in heard]
    place, levels, totals = [None] * len(asked), [], []
    for k in range(order):
        keys = []
        for i, t in enumerate(asked):
            if k:
                parent, word = t.nodes(k)
                keys.append(place[i][parent] << 32 | number[i][word])
            else:
                keys.append(t.words[0].values())
        sizes = [len(x) for x in keys]
        nodes, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        # bincount adds in double precision, which is exact up to 2**53
        total = np.bincount(inverse, np.concatenate([t.payload[k][0] for t in asked]), len(nodes)).astype(np.int64)
        place = np.split(inverse, np.cumsum(sizes)[:-1])
        levels.append(nodes)
        totals.append(total)
    payload = []
    whole = totals[0]
    if len(hot.words):
        known = hot.of(levels[0])
        whole = np.where(known > 0, known, whole)
    for k in range(order):
        arrays = [totals[0].astype("<u8")] if k == 0 else [quantise(totals[k] / (above + MASS[k + 1]))]
        if k + 1 < order:
            context = whole if k == 0 else totals[k]
            arrays.append(quantise(MASS[k + 2] / (context + MASS[k + 2])))
            above = context[levels[k + 1] >> 32]
        payload.append(arrays)
    return Trie.of(vocabulary, levels[0], [x >> 32 for x in levels[1:]], [x & 0xFFFFFFFF for x in levels[1:]], payload)


def answer(model: Trie, asked: Trie) -> bytes:
    """The payload of each node that a chunk asked for."""
    out, place, number = [], None, model.numbers(asked.vocabulary.values())
    for k in range(len(asked.words)):
        if k:
            parent, word = asked.nodes(k)
            place = model.child(k, place[parent], number[word])
        else:
            place = model.root(asked.words[0].values())
        for i, x in enumerate(model.payload[k]):
            none = quantise(np.ones(1))[0] if i else 0  # what is not there has a count or an a of 0, and a b of 1
            got = np.where(place >= 0, x[np.maximum(place, 0)], none) if len(x) else np.full(len(place), none)
            got = _small(got) if k == 0 and i == 0 else got.astype("<u2")
            out.append(got.dtype.str.encode().ljust(4) + struct.pack("<Q", got.nbytes) + got.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def answered(body: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    while at < len(raw):
        size = struct.unpack_from("<Q", raw, at + 4)[0]
        out.append(np.frombuffer(raw[at + 12 : at + 12 + size], raw[at : at + 4].decode().strip()))
        at += 12 + size
    return out


def scores(g: Grams, starts: np.ndarray, n_words: np.ndarray, answers: list, order: int, total: int, distinct: int, hot: Hot):
    """(base score, score, known tokens) of each text from the answers of the shards."""
    got = [[np.zeros(len(x), dtype=np.float64) for _ in range(2 if k + 1 < order else 1)] for k, x in enumerate(g.levels)]
    for s, arrays in answers:
        at = 0
        for k in range(order):
            a, z = g.bounds[k][s], g.bounds[k][s + 1]
            for i in range(len(got[k])):
                got[k][i][a:z] = arrays[at] if k == 0 and i == 0 else probability(arrays[at])
                at += 1
    known = hot.of(g.vocabulary)
    count = np.where(known > 0, known, got[0][0][g.own])[g.word]
    p = (count + ADD) / (total + ADD * (distinct + 1))
    base = np.log10(p)
    for k in range(1, order):
        # the window of k + 1 tokens that ends at a token starts k before it; its context is the window's node one level up
        a = got[k][0][g.at[k]]
        b = got[k - 1][1][g.at[k - 1]]
        q = p.copy()
        q[k:] = a[: len(p) - k] + b[: len(p) - k] * p[k:]
        p = q
    first = starts + order - 1
    edges = np.stack([first, first + n_words + 1], axis=1).ravel()
    add = lambda x: np.add.reduceat(np.append(x, 0.0), edges)[::2]
    with np.errstate(divide="ignore"):
        return add(base), add(np.log10(p)), add((count > 0).astype(np.float64)).astype(np.int64)


def held_out_of(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 10 == 0, F.lit(False))


_CHUNK = "chunk bigint, ids array<bigint>, held array<boolean>, ends binary, body binary"


def _chunked(chunk_bytes: int):
    """Rows id, held_out, text to chunks of about so many bytes; a text is not parted."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def chunk():
            raw = b"\n".join([*texts, b""])
            ends = np.cumsum([len(t) + 1 for t in texts]).astype("<i8")
            row = [[(part << 32) + number], [ids], [held], [ends.tobytes()], [zstandard.ZstdCompressor(level=3).compress(raw)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["chunk", "ids", "held", "ends", "body"])

        for b in batches:
            for i, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                t = (t or "").encode("utf-8", "replace")
                ids.append(i), held.append(h), texts.append(t)
                size += len(t) + 32
                if size >= chunk_bytes:
                    yield chunk()
                    ids, held, texts, size, number = [], [], [], 0, number + 1
        if ids:
            yield chunk()
        _freed()

    return run


def _read(ends: bytes, body: bytes):
    return zstandard.ZstdDecompressor().decompress(body), np.frombuffer(ends, "<i8")


def parcel(items: list[tuple[int, bytes]]) -> bytes:
    """Numbered bodies as one."""
    return struct.pack("<Q", len(items)) + b"".join(struct.pack("<qQ", i, len(x)) for i, x in items) + b"".join(x for _, x in items)


def opened(body: bytes) -> list[tuple[int, bytes]]:
    (n,) = struct.unpack_from("<Q", body)
    at, out = 8 + 16 * n, []
    for k in range(n):
        i, size = struct.unpack_from("<qQ", body, 8 + 16 * k)
        out.append((i, body[at : at + size]))
        at += size
    return out


#: A parcel on its way: the place it goes to, the block of chunks it belongs to, and where it comes from.
_SENT = "at bigint, block bigint, source bigint, body binary"


def _freed() -> None:
    """Gives memory that is no longer used back to the system, as a worker may be idle for long."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _row(at: int, block: int, source: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([block], pa.int64()), pa.array([source], pa.int64()), pa.array([body], pa.binary())], names=["at", "block", "source", "body"])


def _relay(table: pa.Table) -> pa.Table:
    """Parcels of one group of shards and one block of chunks, regrouped by what they hold: from chunks to shards, or back."""
    by: dict[int, list] = {}
    for source, body in zip(table.column("source").to_pylist(), table.column("body").to_pylist(), strict=True):
        for i, x in opened(body):
            by.setdefault(i, []).append((source, x))
    block = table.column("block")[0].as_py()
    return pa.table({"at": pa.array(list(by), pa.int64()), "block": pa.array([block] * len(by), pa.int64()), "source": pa.array([-1] * len(by), pa.int64()), "body": pa.array([parcel(x) for x in by.values()], pa.binary())})


def _mixed(chunk: int) -> int:
    return int(mix(np.array([chunk], dtype=U64))[0])


def _grams(row: dict, order: int, shards: int, hot: Hot):
    text, ends = _read(row["ends"], row["body"])
    ids, starts, n_words = padded(text, ends, order)
    train = np.repeat(~np.array(row["held"], dtype=bool), n_words + order)
    return Grams(ids, starts, train, order, shards, hot), starts, n_words


def _vocabulary(df: DataFrame, hot: int) -> tuple[int, int, dict[int, int]]:
    """(tokens, distinct tokens, words of `hot` tokens or more with their counts) of the training texts."""

    def gather(batches):
        seen, count = np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)
        for b in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(0).to_pylist()]
            ids, n = np.unique(word_hashes(b"\n".join([*texts, b""]))[0], return_counts=True)
            if texts:
                ids, n = np.append(ids, END), np.append(n, len(texts))
            seen, inverse = np.unique(np.concatenate([seen, ids]), return_inverse=True)
            count = np.bincount(inverse, np.concatenate([count, n]), len(seen)).astype(np.int64)
            if len(seen) > WORDS:
                yield from sent(seen, count)
                seen, count = seen[:0], count[:0]
        yield from sent(seen, count)
        _freed()

    def sent(seen, count):
        for a in range(0, len(seen), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(seen[a : a + 50_000].view(np.int64)), pa.array(count[a : a + 50_000])], names=["w", "n"])

    words = df.where("not held_out").select("text").mapInArrow(gather, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    often = F.collect_list(F.when(F.col("n") >= hot, F.struct("w", "n")))  # at most tokens / hot words
    x = words.agg(F.sum("n").alias("n"), F.count("*").alias("v"), often.alias("hot")).first()
    return int(x["n"] or 0), int(x["v"]), {r["w"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in x["hot"]}


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = 3, held_out: Column | None = None, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES, hot: int = HOT, direct: int = DIRECT) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of df.

    The model learns from the rows that are not held out; held_out: by default those whose crc32 of the key as
    text is divisible by 10 (a null key is not held out).  Tokens: words (A-Z lower-cased), then one end; null and empty texts
    have only the end.  base_score: log10 of the add-0.1 unigram probability; score: of the model of the given order
    (2 or more).  Repeated rows each count and get their own row; further columns are left out.  With no training rows all
    counts are zero.  hot: tokens of a word from which it is split; direct: see DIRECT.
    """
    spark = df.sparkSession
    rows = df.select(col(key).cast("bigint").alias("id"), (held_out if held_out is not None else held_out_of(col(key))).alias("held_out"), col(text).alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32)).first()[0] or 0
    chunks, shards = -(-size // chunk_bytes) or 1, -(-size // shard_bytes) or 1
    total, distinct, often = _vocabulary(rows, hot)
    shared = spark.sparkContext.broadcast(Hot(often, hot))  # 16 bytes for each hot word

    routed = chunks * shards > direct
    per = math.isqrt(shards - 1) + 1 if routed else 1  # shards in a group
    blocks = math.isqrt(chunks - 1) + 1

    def request(batches):
        for b in batches:
            for row in b.to_pylist():
                g = _grams(row, order, shards, shared.value)[0]
                for first in range(0, shards, per):
                    own = [(s, body) for s in range(first, min(first + per, shards)) if (body := g.trie(s))]
                    if own and routed:
                        yield _row(first // per, _mixed(row["chunk"]) % blocks, row["chunk"], parcel(own))
                    elif own:
                        yield _row(own[0][0], row["chunk"], row["chunk"], parcel([(row["chunk"], own[0][1])]))
                del g
        _freed()

    def look_up(batches):
        by: dict[int, list] = {}  # one shard, as a rule
        for b in batches:
            for at, block, body in zip(b.column("at").to_pylist(), b.column("block").to_pylist(), b.column("body"), strict=True):
                by.setdefault(at, []).append((block, [(chunk, asked_for(x)) for chunk, x in opened(body.as_py())]))
        for shard in list(by):
            own = by.pop(shard)
            with tempfile.TemporaryDirectory() as folder:  # the task's own, gone when it ends
                model = shard_model([t for _, parcels in own for _, t in parcels], shared.value, order).save(f"{folder}/trie")
                for block, asked in own:
                    yield _row(shard // per, block, shard, parcel([(chunk, answer(model, t)) for chunk, t in asked]))
                    asked.clear()
                del model
        _freed()

    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        row = docs.to_pylist()[0]
        g, starts, n_words = _grams(row, order, shards, shared.value)
        rows = zip(answers.column("source").to_pylist(), answers.column("body"), strict=True)
        got = ((i if routed else shard, answered(y)) for shard, x in rows for i, y in opened(x.as_py()))
        base, full, known = scores(g, starts, n_words, got, order, total, distinct, shared.value)
        n = len(row["ids"])
        del g
        _freed()
        return pa.table({"id": pa.array(row["ids"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(n_words + 1, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array([total] * n, pa.int64()), "base_score": pa.array(base), "score": pa.array(full)})

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(_chunked(chunk_bytes), _CHUNK).repartition(max(least, chunks // 2), "chunk")
    relayed = lambda df, n: df.repartition(n, "at", "block").groupBy("at", "block").applyInArrow(_relay, _SENT)
    asked = dealt.mapInArrow(request, _SENT)
    if routed:
        asked = relayed(asked, max(least, chunks // 2))
    # a task for each shard
    answers = asked.repartitionById(max(least, shards), F.col("at").cast("int")).mapInArrow(look_up, _SENT)
    # a straight answer's block is its chunk
    answers = relayed(answers, max(least, chunks // 2)).withColumnRenamed("at", "chunk") if routed else answers.select(F.col("block").alias("chunk"), "source", "body")
    kinds = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, kinds).withColumnRenamed("id", key)
