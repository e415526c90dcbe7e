"""Elias-Fano sequences and n-gram tries over numpy arrays, which may be memory-mapped."""
from __future__ import annotations

import struct

import numpy as np

U64 = np.uint64


class EliasFano:
    """A non-decreasing sequence of n integers below universe: low bits packed, high bits in unary."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._ends = None

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(U64, copy=False)
        n = len(values)
        bits = min(56, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
        places = np.arange(bits, dtype=U64)
        # a bit takes eight bytes on its way, so few values at a time (a multiple of eight, which ends a byte)
        parts = [np.packbits((((values[i : i + 16_384] & U64((1 << bits) - 1))[:, None] >> places) & U64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, 16_384)]
        low = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint8)
        top = (values >> U64(bits)).astype(np.int64)
        unary = np.zeros(n + (int(top[-1]) if n else 0) + 1, dtype=np.uint8)
        unary[top + np.arange(n)] = 1
        return cls(n, bits, np.concatenate([low, np.zeros(8, dtype=np.uint8)]), np.packbits(unary, bitorder="little"))

    def tobytes(self) -> bytes:
        return struct.pack("<QBQ", self.n, self.bits, len(self.low)) + self.low.tobytes() + struct.pack("<Q", len(self.high)) + self.high.tobytes()

    @classmethod
    def read(cls, buf, at: int = 0):
        """(sequence, position after it); buf: a uint8 array, which is not copied."""
        n, bits, size = struct.unpack_from("<QBQ", buf, at)
        at += 17
        low = buf[at : at + size]
        at += size
        (size,) = struct.unpack_from("<Q", buf, at)
        return cls(n, bits, low, buf[at + 8 : at + 8 + size]), at + 8 + size

    def ends(self) -> np.ndarray:
        """ends[h]: elements whose high part is h or less; the places of the zeros in the unary part."""
        if self._ends is None:
            zeros = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
            self._ends = zeros - np.arange(len(zeros))
        return self._ends

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=U64)
        at = i.astype(np.int64) * self.bits
        window = np.ascontiguousarray(self.low[(at >> 3)[:, None] + np.arange(8)]).view("<u8").ravel()
        return (window >> (at & 7).astype(U64)) & U64((1 << self.bits) - 1)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)).astype(U64) << U64(self.bits)) | self.lows(np.arange(self.n))

    def take(self, i: np.ndarray) -> np.ndarray:
        """Elements at the places i."""
        return (np.searchsorted(self.ends(), i, side="right").astype(U64) << U64(self.bits)) | self.lows(i)

    def successor(self, q: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        """(place of the first element that is not below q, whether it equals q) for each q; lo, hi: bounds of the place."""
        ends = self.ends()
        h = np.minimum((q >> U64(self.bits)).astype(np.int64), len(ends))
        last = np.where(h < len(ends), ends[np.minimum(h, len(ends) - 1)], self.n) if len(ends) else np.zeros(len(q), dtype=np.int64)
        first = np.where(h > 0, ends[np.maximum(h - 1, 0)], 0) if len(ends) else last
        last, first = np.minimum(last, self.n), np.minimum(first, self.n)
        if lo is not None:
            first, last = np.maximum(first, lo), np.minimum(last, hi)
        want, end = q & U64((1 << self.bits) - 1), last
        lo, hi = first.copy(), last.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            below = self.lows(mid) < want[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
            live = live[lo[live] < hi[live]]
        inside = np.flatnonzero(lo < end)
        equal = np.zeros(len(q), dtype=bool)
        equal[inside] = self.lows(lo[inside]) == want[inside]
        return lo, equal


class Trie:
    """Levels of n-grams: level k holds those of k + 1 words, each below the node of its first k words.

    Roots are 64-bit hashes of words; the words below are 32 bits, and numbered by their place in the trie's own
    vocabulary.  A node is its parent's place times the size of the vocabulary plus its word's number: relative to its
    parent it costs the bits of that number and about two more, and a level never falls.  A node's children are the
    elements from its pointer to the next node's; the pointers never fall either.  All are Elias-Fano sequences.
    payload: arrays of each level with a value for each node.  A request, which is read as a whole, has no pointers.
    """

    def __init__(self, vocabulary: EliasFano, words: list[EliasFano], pointers: list[EliasFano], payload: list[list[np.ndarray]]):
        self.vocabulary, self.words, self.pointers, self.payload = vocabulary, words, pointers, payload
        self.base = U64(max(1, vocabulary.n))
        self._known: dict = {}

    @classmethod
    def of(cls, vocabulary: np.ndarray, roots: np.ndarray, parents: list[np.ndarray], numbers: list[np.ndarray], payload: list[list[np.ndarray]], linked: bool = True) -> Trie:
        """vocabulary, roots: ascending; parents, and numbers of the words in the vocabulary, of each further level, in order of both."""
        base = U64(max(1, len(vocabulary)))
        levels, pointers, above = [EliasFano.of(roots, 1 << 64)], [], len(roots)
        for parent, number in zip(parents, numbers, strict=True):
            levels.append(EliasFano.of(parent.astype(U64) * base + number.astype(U64), max(1, above) * int(base)))
            if linked:
                pointers.append(EliasFano.of(np.searchsorted(parent, np.arange(above + 1)), len(number) + 1))
            above = len(number)
        return cls(EliasFano.of(vocabulary, 1 << 32), levels, pointers, payload)

    def tobytes(self) -> bytes:
        out = [struct.pack("<BB", len(self.words), len(self.pointers)), *(x.tobytes() for x in (self.vocabulary, *self.words, *self.pointers))]
        for arrays in self.payload:
            out.append(struct.pack("<B", len(arrays)))
            out += [x.dtype.str.encode().ljust(4) + struct.pack("<Q", x.nbytes) + x.tobytes() for x in arrays]
        return b"".join(out)

    @classmethod
    def read(cls, buf: np.ndarray) -> Trie:
        n, linked, at, parts = int(buf[0]), int(buf[1]), 2, []
        for _ in range(1 + n + linked):
            x, at = EliasFano.read(buf, at)
            parts.append(x)
        payload = []
        for _ in range(n):
            arrays, k = [], int(buf[at])
            at += 1
            for _ in range(k):
                kind, size = np.dtype(bytes(buf[at : at + 4]).decode().strip()), struct.unpack_from("<Q", buf, at + 4)[0]
                arrays.append(np.frombuffer(buf[at + 12 : at + 12 + size], kind))
                at += 12 + size
            payload.append(arrays)
        return cls(parts[0], parts[1 : 1 + n], parts[1 + n :], payload)

    def save(self, path: str) -> Trie:
        """The trie mapped from a new file."""
        with open(path, "wb") as f:
            f.write(self.tobytes())
        return Trie.read(np.memmap(path, dtype=np.uint8, mode="r"))

    def _once(self, name, make):
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    def nodes(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the parent, number of the word) of each node of a level below the roots."""
        x = self.words[level].values()
        parent = x // self.base
        return parent.astype(np.int64), (x - parent * self.base).astype(np.int64)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for those that are not in the vocabulary."""
        known = self._once("vocabulary", self.vocabulary.values)
        if not len(known):
            return np.full(len(words), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(known, words), len(known) - 1)
        return np.where(known[at] == words, at, -1)

    def root(self, word: np.ndarray) -> np.ndarray:
        """Place of each root, -1 where there is none."""
        out = np.full(len(word), -1, dtype=np.int64)
        if self.words[0].n:
            at, equal = self.words[0].successor(word)
            out[equal] = at[equal]
        return out

    def child(self, level: int, parent: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Place of each word (its number) among the children of the given nodes of the level above; -1 where there is none, also for a parent or number of -1."""
        out = np.full(len(number), -1, dtype=np.int64)
        if not self.words[level].n:
            return out
        live = np.flatnonzero((parent >= 0) & (number >= 0))
        above = parent[live]
        starts = self._once(level, lambda: self.pointers[level - 1].values().astype(np.int64))
        at, equal = self.words[level].successor(above.astype(U64) * self.base + number[live].astype(U64), starts[above], starts[above + 1])
        out[live[equal]] = at[equal]
        return out


#: Steps of a probability's code for a halving.
STEPS = 1024


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of 16 bits of probabilities, off by 0.04 % at most; 0 is 0, and what is below 2**-63 is 2**-63."""
    code = np.zeros(len(p), dtype=np.uint16)
    some = p > 0
    code[some] = 1 + np.minimum(np.round(-np.log2(p[some]) * STEPS), 63 * STEPS).astype(np.uint16)
    return code


_VALUES = np.concatenate([[0.0], 0.5 ** (np.arange(63 * STEPS + 1) / STEPS)])


def probability(code: np.ndarray) -> np.ndarray:
    return _VALUES[code]
