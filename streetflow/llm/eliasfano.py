"""Elias-Fano coded monotone sequences, and n-gram tries made of them, in memory-mapped levels."""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: place of the r-th one of a byte b, at 8 * b + r
_SELECT = np.array([([k for k in range(8) if b >> k & 1] + [8] * 8)[r] for b in range(256) for r in range(8)], np.uint8)
_ONES, _TOPS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def bytes_upto(words: np.ndarray) -> np.ndarray:
    """In byte b of each word the number of ones in its bytes up to b."""
    x = words - ((words >> np.uint64(1)) & np.uint64(0x5555555555555555))
    x = (x & np.uint64(0x3333333333333333)) + ((x >> np.uint64(2)) & np.uint64(0x3333333333333333))
    x = (x + (x >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)
    return x * _ONES


def select_in_words(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one of each word, for k below its number of ones: all bytes' counts are compared with k at once."""
    upto, k = bytes_upto(words), k.astype(np.uint64)
    whole = ((((k * _ONES) | _TOPS) - upto) & _TOPS) >> np.uint64(7)
    at = (whole * _ONES >> np.uint64(56)) << np.uint64(3)
    left = k - (((upto << np.uint64(8)) >> at) & np.uint64(255))
    octet = (words >> at) & np.uint64(255)
    return at.astype(np.int64) + _SELECT[((octet << np.uint64(3)) | left).astype(np.int64)]


class EliasFano:
    """n non-decreasing integers below `universe`: low bits packed, high bits in unary with a directory of ones by 64-bit word."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, n: int, bits: int):
        self.low, self.high, self.ones, self.n, self.bits = low, high, ones, n, bits

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros((n * bits + 63) // 64 + 2, np.uint64)
        if bits and n:
            at = np.arange(n, dtype=np.int64) * bits
            v = values & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(low, at >> 6, v << (at & 63).astype(np.uint64))
            over = np.flatnonzero((at & 63) + bits > 64)
            np.bitwise_or.at(low, (at[over] >> 6) + 1, v[over] >> (64 - (at[over] & 63)).astype(np.uint64))
        top = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = n + (universe >> bits) + 1
        flags = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        flags[top] = 1
        words = np.packbits(flags, bitorder="little").view("<u8")
        return cls(low, words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]), n, bits)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.ones]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        at = i * self.bits
        w, s = at >> 6, (at & 63).astype(np.uint64)
        both = (self.low[w] >> s) | np.where(s > 0, self.low[w + 1] << ((np.uint64(64) - s) & np.uint64(63)), np.uint64(0))
        return (both & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Position of the k-th one or zero of the high bits."""
        count = self.ones if one else np.arange(len(self.ones)) * 64 - self.ones
        w = np.searchsorted(count, k, "right") - 1
        words = self.high[w]
        return w * 64 + select_in_words(words if one else ~words, k - count[w])

    def _next_zero(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Position of the first zero of the high bits at or after each position, which is the k-th of all."""
        rest = ~self.high[at >> 6] >> (at & 63).astype(np.uint64)
        out = at + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(rest == 0)
        out[far] = self._select(k[far], False)
        return out

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, True) - i) << self.bits) | self._lows(i)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the first value that is not less than x, and the end of the bucket of values with x's high bits."""
        top = x >> self.bits
        size = int(len(self.high) * 64 - self.ones[-1])  # zeros
        beyond = top >= size
        top = np.minimum(top, size - 1)
        before = np.maximum(top - 1, 0)
        start = np.where(top > 0, self._select(before, False) + 1, 0)
        lo, hi = start - top, self._next_zero(start, top) - top
        lo, hi = np.where(beyond, self.n, np.minimum(lo, self.n)), np.where(beyond, self.n, np.minimum(hi, self.n))
        want, end = x & ((1 << self.bits) - 1), hi.copy()
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo]) >> 1
            less = self._lows(mid) < want[todo]
            lo[todo[less]], hi[todo[~less]] = mid[less] + 1, mid[~less]
            todo = todo[lo[todo] < hi[todo]]
        return lo, end

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Index of the first value that is not less than x (n if there is none): its bucket of equal high bits, then its low bits."""
        return self._search(np.asarray(x, np.int64))[0]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """successor, and whether it is x itself: then it lies in the bucket of x's high bits, and only low bits remain to compare."""
        x = np.asarray(x, np.int64)
        i, end = self._search(x)
        same = i < end
        same[same] = self._lows(i[same]) == (x[same] & ((1 << self.bits) - 1))
        return i, same


class Trie:
    """Sorted n-grams as levels. Level k has the ids of its entries, in each parent's range relative to that parent's base, so that
    the whole level is one monotone sequence; monotone pointers give each entry's range in the next level; the last level has one
    byte per n-gram, and the level above it may have a row of bytes per context."""

    def __init__(self, ids: list[EliasFano], pointers: list[EliasFano], width: int, values: np.ndarray, contexts: np.ndarray):
        self.ids, self.pointers, self.width, self.values, self.contexts = ids, pointers, width, values, contexts

    @classmethod
    def build(cls, grams: np.ndarray, values: np.ndarray, width: int, contexts: np.ndarray | None = None) -> Trie:
        """grams: (n, order) ids below width, in lexicographic order, without repeats. contexts: a row for each distinct n-gram
        without its last id, in order."""
        n, order = grams.shape
        if n and int(grams.max()) >= width:
            raise ValueError(f"an id of {int(grams.max())} in a trie for ids below {width}")
        ids, pointers, parent, before = [], [], np.zeros(n, np.int64), 1
        for k in range(order):
            new = np.ones(n, bool)
            new[1:] = (parent[1:] != parent[:-1]) | (grams[1:, k] != grams[:-1, k])
            heads = np.flatnonzero(new)
            if k:
                first = np.searchsorted(parent[heads], np.arange(before + 1))
                pointers.append(EliasFano.encode(first, len(heads) + 1))
            ids.append(EliasFano.encode(parent[heads] * width + grams[heads, k], before * width))
            parent, before = np.cumsum(new) - 1, len(heads)
        rows = np.zeros((ids[-2].n if order > 1 else 1, 0)) if contexts is None else contexts
        return cls(ids, pointers, width, values.astype(np.uint8), rows.astype(np.uint8))

    def places(self, grams: np.ndarray) -> list[np.ndarray]:
        """Each n-gram's entry on every level, -1 from where it isn't in the trie: level by level the successor in its context's
        range, once for each run of n-grams that begin alike."""
        n = len(grams)
        at, alive, run, out = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool), []
        run[:1] = True
        for k, level in enumerate(self.ids):
            run[1:] |= grams[1:, k] != grams[:-1, k]
            q = np.flatnonzero(run)
            found = np.full(len(q), -1, np.int64)
            some = np.flatnonzero(alive[q]) if level.n else q[:0]
            if len(some):
                parent = at[q[some]]
                i, hit = level.find(parent * self.width + grams[q[some], k])
                if k:
                    head = np.diff(parent, prepend=-1) != 0
                    hit &= i < self.pointers[k - 1].access(parent[head] + 1)[np.cumsum(head) - 1]
                found[some[hit]] = i[hit]
            at = found[np.cumsum(run) - 1]
            alive = at >= 0
            out.append(at)
        return out

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """The byte of each n-gram, 255 where there is none."""
        at = self.places(grams)[-1]
        out = np.full(len(grams), 255, np.uint8)
        out[at >= 0] = self.values[at[at >= 0]]
        return out

    def lookup_contexts(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte of each n-gram and the row of its context, 255 where there is none."""
        *_, context, at = self.places(grams)
        out, rows = np.full(len(grams), 255, np.uint8), np.full((len(grams), self.contexts.shape[1]), 255, np.uint8)
        out[at >= 0] = self.values[at[at >= 0]]
        rows[context >= 0] = self.contexts[context[context >= 0]]
        return out, rows

    def size(self) -> int:
        return sum(a.nbytes for e in [*self.ids, *self.pointers] for a in e.arrays()) + self.values.nbytes + self.contexts.nbytes

    def mapped(self) -> Trie:
        """The same trie with its levels in a memory-mapped file that is already unlinked, so nothing is left behind."""
        parts = [a for e in [*self.ids, *self.pointers] for a in e.arrays()] + [self.values, self.contexts]
        handle, name = tempfile.mkstemp(prefix="trie-")
        offsets = []
        with os.fdopen(handle, "wb") as f:
            for a in parts:
                f.write(b"\0" * (-f.tell() % 64))
                offsets.append(f.tell())
                f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * 64)
        views = [np.memmap(name, a.dtype, "r", o, a.shape) if a.size else a for a, o in zip(parts, offsets, strict=True)]
        os.unlink(name)
        made = [EliasFano(*(np.asarray(v) for v in views[3 * k : 3 * k + 3]), e.n, e.bits) for k, e in enumerate([*self.ids, *self.pointers])]
        return Trie(made[: len(self.ids)], made[len(self.ids) :], self.width, np.asarray(views[-2]), np.asarray(views[-1]))
