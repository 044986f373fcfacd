"""Substring dedup: exact counts of word windows by super-k-mer partitioning.

A window is `WINDOW` consecutive words of one document. Each window has a minimiser, the smallest hash of the word pairs in it;
consecutive windows with the same minimiser travel as one packed string, the super-k-mer, to the bucket of that minimiser, so that
all occurrences of a window meet in one bucket and a string costs little more than its own words.

A minimiser whose super-k-mers would be much more than a bucket's share is split: its windows are known by the hash of all their words
instead, and travel one by one. Which ones these are is found on a sample of the documents, a thousandth or SAMPLE_BYTES, and decides
on partitions only: whatever it misses, all occurrences of a window still meet in one bucket.

1. Documents are dealt to groups by doc_id and text. A group sends each of its distinct super-k-mers once, with the smallest doc_id that has
   it; those of one group and bucket are one compressed block. A copied passage therefore costs a bucket one string per group, not
   one per copy.
2. A bucket sorts the windows of its distinct strings and takes the smallest doc_id of each. Sorting is by 64-bit hash; windows with
   equal hashes are compared byte by byte (and grouped by their bytes if any differ). It answers each group with the smallest doc_id
   of every window, for the strings where that is smaller than the group's own.
3. The groups' documents meet their answers and drop each word covered by a window that also starts in a document with a smaller id.

Words are separated by the six ASCII white-space characters; a null text has none. Documents are judged on the input, not on what is
left. Rows with equal doc_id are one document to the rule and keep a row each; a null doc_id counts as larger than all others. Empty
table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm import text as T
from streetflow.llm.shared import group_count, on_path, shuffle_partitions, size_in_bytes, table, tidy

WINDOW, MINIMISER = 13, 2
NO_ID = (1 << 63) - 1
SAMPLE_BYTES = 16 << 20
#: a minimiser with more than so many buckets' share of the words is split
HOT = 4.0


class Group:
    """The documents of a group in canonical order, their words one space apart, and the windows' super-k-mers."""

    def __init__(self, t: pa.Table, window: int, hot: np.ndarray):
        self.window, self.hot = window, hot
        t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.table = t
        self.doc_id = t["doc_id"].combine_chunks()
        self.ids = np.asarray(self.doc_id.fill_null(NO_ID))
        buf, offs = T.text_bytes(t["text"])
        starts, lens, self.first = T.words(buf, offs)
        self.size = lens + 1
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.buf = np.concatenate([T.gather(buf, starts, self.size), np.zeros(16, np.uint8)])
        self.buf[self.at[1:] - 1] = 32
        self.h = T.hash_spans(self.buf, self.at[:-1], lens)
        self.n_words = np.diff(self.first)
        self.cut()

    def cut(self) -> None:
        """Super-k-mers: for each its first and last window, its document and its minimiser; windows are named by their first word."""
        per_doc = np.maximum(self.n_words - self.window + 1, 0)
        self.win = T.ragged(self.first[:-1], per_doc)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        if not len(self.win):
            self.run_at = self.run_doc = self.run_len = np.zeros(0, np.int64)
            self.mini = np.zeros(0, np.uint64)
            return
        gram = self.h[: len(self.h) - MINIMISER + 1].copy()
        for k in range(1, MINIMISER):
            gram = gram * T._GOLD + self.h[k : len(self.h) - MINIMISER + 1 + k]
        gram = T.mix(gram)
        low = gram[T.sliding_argmin(gram, self.window - MINIMISER + 1)][self.win]
        if len(self.hot):
            split = np.flatnonzero(self.hot[np.minimum(np.searchsorted(self.hot, low), len(self.hot) - 1)] == low)
            whole = np.zeros(len(split), np.uint64)
            for k in range(self.window):
                whole = whole * T._GOLD + self.h[self.win[split] + k]
            low[split] = T.mix(whole)
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
        self.run_at = np.flatnonzero(new)
        self.run_len = np.diff(self.run_at, append=len(low))
        self.run_doc, self.mini = doc[self.run_at], low[self.run_at]

    def strings(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct super-k-mers, the run where each occurs first, and each run's number among them."""
        raw, w = self.buf.tobytes(), self.win[self.run_at]
        lo, hi = self.at[w].tolist(), (self.at[w + self.run_len + self.window - 1] - 1).tolist()
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(raw[i:j], len(known)) for i, j in zip(lo, hi, strict=True)), np.int64, len(lo))
        where = np.unique(number, return_index=True)[1]
        return list(known), where, number


def hot_minimisers(docs: DataFrame, window: int, share: float) -> np.ndarray:
    """The minimisers of more than `share` of the words of a sample's super-k-mers, at most 1 / share."""
    parts = max(1, min(1000, size_in_bytes(docs) // SAMPLE_BYTES))
    sample = docs.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(parts)) == 0).select("doc_id", "text")

    def tally(batches):
        for batch in batches:
            for chunk in T.chunks(batch):
                g = Group(pa.Table.from_batches([chunk]), window, np.zeros(0, np.uint64))
                first, number = T.distinct(g.mini)
                words = np.bincount(number, g.run_len + window - 1, len(first)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g.mini[first].view(np.int64)), pa.array(words)], ["mini", "words"])

    counts = table(sample.mapInArrow(tidy(tally), "mini long, words long").groupBy("mini").agg(F.sum("words").alias("words")))
    total = counts.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    hot = counts.where(F.col("words") > share * total).select("mini").toArrow()
    return np.sort(np.asarray(hot["mini"]).astype(np.int64).view(np.uint64))


def pack_block(ids: np.ndarray, numbers: np.ndarray, strings: list[bytes]) -> bytes:
    body = ids.astype("<i8").tobytes() + numbers.astype("<i4").tobytes() + b"\n".join(strings)
    return zstandard.ZstdCompressor(level=3).compress(body)


def unpack_block(block: bytes, n: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    body = zstandard.ZstdDecompressor().decompress(block)
    return np.frombuffer(body, "<i8", n), np.frombuffer(body, "<i4", n, 8 * n), body[12 * n :].split(b"\n")


def smallest_ids(strings: list[bytes], owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of distinct strings, the smallest owner of a string that has it; and where each string's windows begin."""
    col = pa.array(strings, pa.large_binary()).cast(pa.large_string(), safe=False) if strings else pa.array([], pa.large_string())
    buf, offs = T.text_bytes(col)
    starts, lens, first = T.words(buf, offs)
    h = T.hash_spans(buf, starts, lens)
    per = np.diff(first) - window + 1
    win = T.ragged(first[:-1], per)
    own = np.repeat(owner, per)
    bounds = np.concatenate([[0], np.cumsum(per)])
    key = np.zeros(len(win), np.uint64)
    for k in range(window):
        key = key * T._GOLD + h[win + k]
    key = T.mix(key)
    order = T.order(key)
    same = np.zeros(len(win), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    head = np.flatnonzero(~same)
    if same.any():
        lo, hi = starts[win], starts[win + window - 1] + lens[win + window - 1]
        lead = order[head][np.cumsum(~same) - 1]
        at = np.flatnonzero(same)
        for i in range(0, len(at), 1 << 16):
            a, b = order[at[i : i + (1 << 16)]], lead[at[i : i + (1 << 16)]]
            n = hi[a] - lo[a]
            if (n != hi[b] - lo[b]).any() or (buf[T.ragged(lo[a], n)] != buf[T.ragged(lo[b], n)]).any():
                return by_bytes(buf.tobytes(), lo, hi, own), bounds
    out = np.empty(len(win), np.int64)
    if len(win):
        out[order] = np.minimum.reduceat(own[order], head)[np.cumsum(~same) - 1]
    return out, bounds


def by_bytes(raw: bytes, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> np.ndarray:
    """As smallest_ids, without hashes: for a bucket in which two different windows have the same one."""
    best: dict[bytes, int] = {}
    spans = [raw[i:j] for i, j in zip(lo.tolist(), hi.tolist(), strict=True)]
    for s, d in zip(spans, own.tolist(), strict=True):
        best[s] = min(d, best.get(s, d))
    return np.fromiter((best[s] for s in spans), np.int64, len(spans))


def dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False, keep: tuple[str, ...] = (), group_mb: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs; with `texts` also kept_text (the text as it is, where no word
    goes) and removed, the word ranges [from, to) that go; and the columns `keep` of docs."""
    on_path(docs.sparkSession)
    groups, parts = group_count(docs, group_mb), shuffle_partitions(docs.sparkSession)
    # a bucket's strings have about three times the words of its windows, so buckets are no fewer than groups where these are large
    buckets = max(parts, groups if groups > 2 * parts else groups // 2)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    hot = hot_minimisers(dealt, window, HOT / buckets)
    dealt = dealt.withColumn("grp", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")).repartition(parts, "grp")

    def send(key: tuple, t: pa.Table) -> pa.Table:
        g = Group(t, window, hot)
        strings, where, _ = g.strings()
        bucket = (g.mini[where] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        ids = g.ids[g.run_doc[where]]
        blocks = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({
            "bucket": pa.array([int(bucket[b[0]]) for b in blocks], pa.int32()),
            "grp": pa.array([key[0].as_py()] * len(blocks), pa.int32()),
            "n": pa.array([len(b) for b in blocks], pa.int32()),
            "block": pa.array([pack_block(ids[b], b, [strings[i] for i in b.tolist()]) for b in blocks], pa.binary()),
        })

    def count(key: tuple, t: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        rows, owner = [], []
        for grp, n, block in zip(t["grp"].to_pylist(), t["n"].to_pylist(), t["block"].to_pylist(), strict=True):
            ids, numbers, strings = unpack_block(block, n)
            entry = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, n)
            rows.append((grp, ids, numbers, entry))
            owner += [NO_ID] * (len(known) - len(owner))
            for e, d in zip(entry.tolist(), ids.tolist(), strict=True):
                if d < owner[e]:
                    owner[e] = d
        least, bounds = smallest_ids(list(known), np.array(owner, np.int64), window)
        low = np.minimum.reduceat(least, bounds[:-1]) if len(least) else least
        out: dict[str, list] = {"grp": [], "n": [], "block": []}
        for grp, ids, numbers, entry in rows:
            news = np.flatnonzero(low[entry] < ids)
            if len(news):
                e = entry[news]
                per = bounds[e + 1] - bounds[e]
                body = numbers[news].astype("<i4").tobytes() + per.astype("<i4").tobytes() + least[T.ragged(bounds[e], per)].astype("<i8").tobytes()
                out["grp"].append(grp)
                out["n"].append(len(news))
                out["block"].append(zstandard.ZstdCompressor(level=3).compress(body))
        return pa.table({"grp": pa.array(out["grp"], pa.int32()), "n": pa.array(out["n"], pa.int32()), "block": pa.array(out["block"], pa.binary())})

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, removed array<array<int>>" * texts
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def merge(key: tuple, t: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(t, window, hot)
        _, where, number = g.strings()
        # windows in order of their runs; each string's windows have the smallest doc_id of the group until an answer says less
        length = g.run_len[where]
        base = np.concatenate([[0], np.cumsum(length)])
        least = np.repeat(g.ids[g.run_doc[where]], length)
        for n, block in zip(answers["n"].to_pylist(), answers["block"].to_pylist(), strict=True):
            body = zstandard.ZstdDecompressor().decompress(block)
            which, per = np.frombuffer(body, "<i4", n), np.frombuffer(body, "<i4", n, 4 * n)
            least[T.ragged(base[which], per)] = np.frombuffer(body, "<i8", -1, 8 * n)
        hit = least[T.ragged(base[number], g.run_len)] < np.repeat(g.ids[g.run_doc], g.run_len)
        cover = np.zeros(len(g.size) + 1, np.int64)
        np.add.at(cover, g.win[hit], 1)
        np.add.at(cover, g.win[hit] + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        gone_before = np.concatenate([[0], np.cumsum(gone)])
        kept = ~gone
        raw = T.gather(g.buf, g.at[:-1][kept], g.size[kept]).tobytes()
        ends = np.concatenate([[0], np.cumsum(np.where(kept, g.size, 0))])[g.first]
        left = [raw[i : max(i, j - 1)] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        out = {"doc_id": g.doc_id, "n_words": pa.array(g.n_words), "n_removed": pa.array(np.diff(gone_before[g.first])), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in left]}
        if texts:
            same = (np.diff(gone_before[g.first]) == 0).tolist()
            out["kept_text"] = pa.array([old if whole else new.decode() for old, new, whole in zip(g.table["text"].to_pylist(), left, same, strict=True)], pa.string())
            edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
            out["removed"] = pa.array(spans(edge[::2], edge[1::2], g.first), pa.list_(pa.list_(pa.int32())))
        return pa.table(out | {c: g.table[f"keep_{c}"] for c in keep})

    blocks = dealt.groupBy("grp").applyInArrow(send, "bucket int, grp int, n int, block binary")
    answers = blocks.groupBy("bucket").applyInArrow(count, "grp int, n int, block binary")
    return dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(merge, schema)


def spans(lo: np.ndarray, hi: np.ndarray, first: np.ndarray) -> list[list[list[int]]]:
    """Word ranges by document, counted from each document's first word; a range that crosses documents is cut."""
    out: list[list[list[int]]] = [[] for _ in range(len(first) - 1)]
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        d = int(np.searchsorted(first, a, "right")) - 1
        while a < b:
            end = min(b, int(first[d + 1]))
            if a < end:
                out[d].append([a - int(first[d]), end - int(first[d])])
            a, d = end, d + 1
    return out
