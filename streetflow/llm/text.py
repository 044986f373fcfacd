"""Vectorised text primitives shared by the operators: words, exact 64-bit hashing, ragged gathers.

Texts come as Arrow string columns; a chunk is their concatenated UTF-8 bytes with one offset per document, so that numpy
works on whole chunks. Chunks are bounded in bytes (one longer document makes a chunk of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = (9, 10, 11, 12, 13, 32)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
CHUNK_BYTES = 4 << 20
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    h = (h ^ (h >> np.uint64(30))) * _C1
    h = (h ^ (h >> np.uint64(27))) * _C2
    return h ^ (h >> np.uint64(31))


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, followed by 16 zero bytes, and len+1 offsets. Null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays([c.cast(pa.large_string()) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_string())
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    lo, hi = int(offs[0]), int(offs[-1])
    buf = np.zeros(hi - lo + 16, np.uint8)
    if hi > lo:
        buf[: hi - lo] = np.frombuffer(col.buffers()[2], dtype=np.uint8)[lo:hi]
    return buf, offs - lo


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES):
    """Slices of a batch of at most `most` bytes of text, or of a single row."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal runs of bytes not in `gap` that don't cross documents, and each document's first word."""
    n = int(offs[-1])
    inside = ~gap[buf[:n]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[:-1][offs[:-1] < n]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    end = offs[1:][offs[1:] > 0] - 1
    last[end] = inside[end]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, np.searchsorted(starts, offs)


def hash_spans(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; buf must have at least 8 bytes after the last span."""
    h = mix(lens.astype(np.uint64) * _GOLD + np.uint64(seed))
    if not len(starts):
        return h
    wide = np.ndarray((len(buf) - 7,), np.dtype("<u8"), buf, strides=(1,))
    todo, at, left, step = None, starts, lens, 0
    while True:
        v = wide[at] & _MASK[np.minimum(left, 8)]
        new = mix((h if todo is None else h[todo]) * _GOLD ^ v)
        if todo is None:
            h = new
        else:
            h[todo] = new
        step += 8
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        todo = more if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8


def order(h: np.ndarray, bits: int = 64) -> np.ndarray:
    """A stable argsort of unsigned numbers below 2 ** bits. They are sorted together with their places in one word each, several times
    faster than by comparison through an index; where both don't fit, by their upper bits, and ties of these are set right after."""
    low = max(len(h) - 1, 1).bit_length()
    place, h = np.arange(len(h), dtype=np.uint64), h.astype(np.uint64, copy=False)
    mask = np.uint64((1 << low) - 1)
    if bits + low <= 64:
        return (np.sort((h << np.uint64(low)) | place) & mask).astype(np.int64)
    out = (np.sort((h & ~mask) | place) & mask).astype(np.int64)
    s = h[out]
    return out[np.argsort(s, kind="stable")] if (s[1:] < s[:-1]).any() else out


def distinct(h: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct number occurs first, in ascending order of the numbers, and every one's place among them."""
    at = order(h, bits)
    s = h[at]
    new = np.ones(len(h), bool)
    new[1:] = s[1:] != s[:-1]
    number = np.empty(len(h), np.int64)
    number[at] = np.cumsum(new) - 1
    return at[new], number


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i], ..., starts[i]+lens[i]-1 for all i, in order."""
    lens = lens.astype(np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts.astype(np.int64) - (ends - lens), lens)


def gather(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """buf[ragged(starts, lens)] with the indices of `step` spans at a time in memory."""
    ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    out = np.empty(int(ends[-1]), buf.dtype)
    for i in range(0, len(starts), step):
        j = min(i + step, len(starts))
        out[ends[i] : ends[j]] = buf[ragged(starts[i:j], lens[i:j])]
    return out


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z only; other letters stay."""
    up = (buf >= 65) & (buf <= 90)
    return buf + (up.astype(np.uint8) << 5)


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value of each window (the leftmost of equal ones), by doubling."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        span += step
    return best[:n]
