"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

A document's ids are those of its whole text and one end id; null text is the empty text. Ids are cut into full pieces of
`capacity` and one remainder, so each id lies in exactly one piece. Documents are dealt at random, by a hash of id and position in
their input partition, to groups of about `group_docs` documents, so that repeated rows are spread, too; in each group the pieces are
placed, longest first, into the first sequence with room. A group's memory is bounded by its number of pieces, whatever the corpus. The
pieces are written to the shared folder with their groups before they are shuffled: a task that runs again after that can't deal a row
to another group, even if its input comes in another order.

Empty table: no rows. Repeated rows and repeated ids: each row is packed as a document of its own. Null doc_id: packed, with a null
doc_id in the result. Extra columns are ignored. Ties in length are placed in order of doc_id and start.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm import text as T
from streetflow.llm import tokens
from streetflow.llm.shared import on_path, table, tidy

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class FirstFit:
    """Bins in a tournament tree: an inner node holds the largest room below it, so the first bin with room is found by descent."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Takes the first bin with room for size; returns it and the room it had."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        leaf = node - self.leaves
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
        return leaf, had


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items must be sorted, largest first."""
    tree = FirstFit(len(sizes), capacity)
    bins, offs = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        bins[i], had = tree.place(size)
        offs[i] = capacity - had
    return bins, offs


def pieces(docs: DataFrame, path: str, end: int, capacity: int, groups: int, ids: bool = False) -> DataFrame:
    """Rows of PIECES, with the ids themselves as array if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = tokens.encoder(path), 0
        for batch in batches:
            for chunk in T.chunks(batch):
                buf, offs = T.text_bytes(chunk.column(1))
                flat, at = tokens.with_end(*enc.encode(buf, offs), end)
                n = np.diff(at)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                start = T.ragged(np.zeros(len(n), np.int64), count) * capacity
                length = np.minimum(capacity, n[doc] - start)
                lo = at[:-1][doc] + start
                crc = [zlib.crc32(flat[i:j]) for i, j in zip(lo.tolist(), (lo + length).tolist(), strict=True)]
                doc_id = chunk.column(0)
                salt = np.asarray(doc_id.fill_null(-1)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(row, row + len(n), dtype=np.uint64)
                row += len(n)
                cols = [doc_id.take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array((T.mix(salt) % np.uint64(groups)).astype(np.int64)[doc])]
                names = [c.split()[0] for c in PIECES.split(", ")]
                if ids:
                    order = T.ragged(lo, length)
                    cols.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(length)]).astype(np.int32), pa.array(flat[order].astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(cut), PIECES + ", ids array<int>" * ids)


def pack(docs: DataFrame, path: str | None = None, end: int = 2, capacity: int = 4096, group_docs: int = 4096, ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `capacity` ids: PACKED, and `ids` if asked for."""
    on_path(docs.sparkSession)
    path = path or tokens.default_path("word_bpe_49k.json")
    groups = max(1, -(-docs.count() // group_docs))

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offs = first_fit_decreasing(np.asarray(t["length"]), capacity)
        group = t["grp"][0].as_py()
        return t.drop_columns(["grp"]).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offs)).select([c.split()[0] for c in PACKED.split(", ")] + ["ids"] * ids)

    return table(pieces(docs, path, end, capacity, groups, ids)).groupBy("grp").applyInArrow(place, PACKED + ", ids array<int>" * ids)


def padding(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: sequences, tokens, padded length. A sequence is padded to capacity, except where its length is a power of two."""
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    return sums.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(F.col("n").bitwiseAND(F.col("n") - 1) == 0, F.col("n")).otherwise(capacity)).alias("padded"))
