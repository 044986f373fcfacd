"""Token ids of whole texts by a public tokenizer, with each distinct unit of text encoded once per worker.

A unit is a piece of text that the tokenizer's own pre-tokenisation would cut at both ends, whatever stands around it, so that
encoding units one by one gives the ids of the whole text. Units are cut vectorised and looked up by 64-bit hash in a cache which
lives as long as the Python worker; at MOST_UNITS units, or MOST_PIECES of their pieces, it starts anew, which bounds its memory and changes nothing in the result.

Strings of the vocabulary's special tokens in a text are those tokens, as the library gives them without further settings. A document
with such a string is one unit and goes to the library as it is.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
from collections.abc import Sequence

import numpy as np
import regex

from streetflow.llm import text as T

MOST_UNITS, MOST_PIECES = 3_000_000, 400_000
#: units learnt at once: their lists and strings are gone before the next ones come, so that little is left between what stays
LEARNT = 1 << 13
#: fixed values: the published byte-level pre-tokenisation pattern, and the one of the lower-casing word vocabulary
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 bytes stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Token ids by tokenizers; `encode(buf, offs)` gives the ids of all documents of a chunk and each document's count."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        # tokens that the library looks for in another way make every document a unit
        plain = all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", []))
        self.shortest = min(map(len, self.special), default=1 << 62)
        normal = json.dumps(spec["normalizer"] or "")
        split = json.dumps(spec["pre_tokenizer"] or "")
        self.kind = "byte" if spec["normalizer"] is None and spec["pre_tokenizer"].get("use_regex") else "word" if "Lowercase" in normal and "Removed" in split else "other"
        self.kind = self.kind if plain else "other"
        self.model, self.table = self.tokenizer.model, {b: ord(c) for b, c in byte_alphabet().items()}
        self.find = regex.compile(BYTE_PATTERN if self.kind == "byte" else WORD_PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size, self.units = np.zeros(1024, np.int64), np.zeros(1024, np.int32), 0
        self.pool, self.filled, self.pieces = np.zeros(1 << 16, np.uint16), 0, {}  # type: ignore[var-annotated]

    def cut(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the units of a chunk."""
        starts, lens = self.cut_plain(buf, offs)
        whole = self.with_special(buf, offs) if self.kind != "other" else []
        if not len(whole):
            return starts, lens
        inside = np.isin(np.searchsorted(offs, starts, "right") - 1, whole)
        starts, lens = np.concatenate([starts[~inside], offs[:-1][whole]]), np.concatenate([lens[~inside], np.diff(offs)[whole]])
        order = np.argsort(starts, kind="stable")
        return starts[order], lens[order]

    def with_special(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The documents with a special token's string."""
        raw, found = buf[: int(offs[-1])].tobytes(), []
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                d = int(np.searchsorted(offs, at, "right")) - 1
                end = int(offs[d + 1])
                if at + len(s) <= end:
                    found.append(d)
                    at = raw.find(s, end)
                else:
                    at = raw.find(s, at + 1)  # it crosses into the next document
        return np.unique(np.array(found, np.int64))

    def cut_plain(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = int(offs[-1])
        if self.kind == "word":
            return T.words(buf, offs)[:2]
        b = buf[:n]
        first = np.zeros(n, bool)
        first[offs[:-1][offs[:-1] < n]] = True
        if self.kind == "byte":
            # a white-space character that other characters than white space follow is never joined with what stands before it
            plain = (buf[: n + 1] > 32) & (buf[: n + 1] != 127) & ~np.isin(buf[: n + 1], (0xC2, 0xE1, 0xE2, 0xE3))
            plain[n] = False
            first |= (b == 32) & plain[1:]
            line = np.flatnonzero(b == 10)
            line = line[(line > 0)]
            line = line[plain[line + 1] & (b[line - 1] > 32) & (b[line - 1] < 127)]
            first[line] = True
            first[line + 1] = True
        starts = np.flatnonzero(first)
        return starts, np.diff(starts, append=n)

    def ids_of(self, unit: bytes) -> Sequence[int]:
        s = unit.decode("utf-8", "replace")
        if len(unit) >= self.shortest and any(t in unit for t in self.special):
            return self.tokenizer.encode(s, add_special_tokens=False).ids
        if self.kind == "other" or not (s.isascii() or max(s) < "Ā"):
            return self.tokenizer.encode(s, add_special_tokens=False).ids
        if self.kind == "word":
            s = s.lower()
            if not (s.isascii() or max(s) < "Ā"):
                return self.tokenizer.encode(s, add_special_tokens=False).ids
        bare = s[1:] if s[:1] == " " else s
        if bare.isascii() and bare.isalpha() and self.kind == "byte":
            return self.ids_of_piece(s)  # letters after a blank, if any, are one piece
        if bare.isascii() and bare[-1:] in (".", ",") and bare[:-1].isalpha() and self.kind == "byte":
            return self.ids_of_piece(s[:-1]) + self.ids_of_piece(s[-1])
        out: list[int] = []
        for piece in self.find(s):
            out += self.ids_of_piece(piece)
        return out

    def ids_of_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            if piece.isascii() and piece[1:].isalnum() and (piece[0] == " " or piece[0].isalnum()):
                shown = "Ġ" + piece[1:] if piece[0] == " " else piece
            else:
                shown = piece.encode().decode("latin-1").translate(self.table)
            ids = self.pieces[piece] = tuple([t.id for t in self.model.tokenize(shown)])
        return ids

    def learn(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        sizes, flats = [], []
        gc.disable()  # a million small lists are made, none of them in a cycle
        try:
            for lo in range(0, len(keys), LEARNT):
                got = [self.ids_of(raw[i:j]) for i, j in zip(starts[lo : lo + LEARNT].tolist(), ends[lo : lo + LEARNT].tolist(), strict=True)]
                sizes.append(np.fromiter(map(len, got), np.int32, len(got)))
                flat = np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes[-1].sum()))
                flats.append(flat if flat.max(initial=0) >= 65536 else flat.astype(np.uint16))
                if len(self.pieces) > MOST_PIECES:
                    self.pieces = {}
        finally:
            gc.enable()
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        if flat.dtype != self.pool.dtype and flat.dtype == np.uint32:
            self.pool = self.pool.astype(np.uint32)
        while self.filled + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.units + len(keys) > len(self.at):
            self.at, self.size = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.size, np.zeros_like(self.size)])
        self.pool[self.filled : self.filled + len(flat)] = flat
        new = np.arange(self.units, self.units + len(keys))
        self.at[new], self.size[new] = self.filled + np.cumsum(size) - size, size
        self.filled, self.units = self.filled + len(flat), self.units + len(keys)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, where, keys), np.insert(self.slot, where, new)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lens = self.cut(buf, offs)
        h = T.hash_spans(buf, starts, lens)
        example, number = T.distinct(h)
        keys = h[example]
        if self.units > MOST_UNITS:
            self.forget()
        where = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            known = self.keys[np.minimum(where, len(self.keys) - 1)] == keys
        if not known.all():
            miss = ~known
            self.learn(keys[miss], buf.tobytes(), starts[example[miss]], (starts + lens)[example[miss]])
            where = np.searchsorted(self.keys, keys)
        slot = self.slot[where][number]
        size = self.size[slot]
        ids = self.pool[T.ragged(self.at[slot], size)]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        return ids, np.diff(ends[np.searchsorted(starts, offs)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def drop() -> None:
    """Lets the worker's encoder go, for a step that encodes nothing."""
    _ENCODERS.clear()


def with_end(ids: np.ndarray, counts: np.ndarray, end: int, dtype=np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """Each document's ids followed by the end id, and the len+1 offsets of the documents."""
    offs = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(offs[-1]), end, dtype)
    keep = np.ones(len(out), bool)
    keep[offs[1:] - 1] = False
    out[keep] = ids
    return out, offs
