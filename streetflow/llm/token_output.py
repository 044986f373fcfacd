"""Token ids as files: canonical length-limited Huffman codes from global counts, in blocks that decode independently.

Two passes over the texts. The first counts all ids of the corpus (one partial count per task, summed by Spark; the vocabulary bounds
what the driver gets), which also gives the size of all codes, and so the number of files. The second range-partitions the documents
by doc_id and a hash of the text, so that rows of one doc_id are split, too, and encodes each partition into files in the shared folder,
a new one at FILE_BYTES; it returns a row per file. A task holds the codes of one file, not its ids. A file is written under an attempt's
name and then renamed, so a task that runs again writes the same bytes again. The reader takes a file's codes by ranges of checkpoints.

File: b"CHT2", length of a JSON header, header, then zlib'd code lengths, doc_ids (int64; `nulls` in the header says how many of the
first have none), ids per document (int64), the bit offset of every BLOCK-th id (uint64), and the code bits in big-endian 64-bit words.
Decoding starts at any checkpoint: one table lookup of MAX_BITS bits per id, for LANES blocks of a file side by side.

Empty table: no files, no rows. Null text is the empty text (its end id only). Equal doc_ids are kept as separate documents, ordered
by a hash of the text, then the text; null doc_ids come first. Extra columns are ignored. A vocabulary of more than 2 ** MAX_BITS
ids has no codes of that length and raises.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetflow.llm import text as T
from streetflow.llm import tokens
from streetflow.llm.shared import let_go, on_path, shared_dir, shuffle_partitions, tidy

MAX_BITS, BLOCK, MAGIC = 16, 1024, b"CHT2"
#: ids coded at once (a multiple of BLOCK) and blocks decoded side by side: they bound a task's memory
SEGMENT, LANES = 1 << 18, 1024
#: a file's size, but for what its last chunk of documents adds
FILE_BYTES = 64 << 20
#: files that are read at once at most
READERS = 10_000


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError("more symbols than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    merged, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(most - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        merged = both[at]
        is_leaf.append(at < len(leaves))
    take, depth = 2 * (len(leaves) - 1), np.zeros(len(leaves) + 1, np.int64)
    for level in reversed(is_leaf):
        n = int(level[:take].sum())
        depth[n] += 1
        take = 2 * (take - n)
    out[order] = np.cumsum(depth[::-1])[::-1][1:]
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then of symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    n = lengths[order].astype(np.int64)
    if len(order):
        top = np.int64(MAX_BITS)
        codes[order] = (np.concatenate([[0], np.cumsum(1 << (top - n))[:-1]]) >> (top - n)).astype(np.uint64)
    return codes


def write_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The code bits of ids and the bit offsets of every BLOCK-th id; every SEGMENT of ids begins a new 64-bit word."""
    parts, checkpoints, before = [], [], 0
    for lo in range(0, len(ids), SEGMENT):
        part = ids[lo : lo + SEGMENT]
        n = lengths[part].astype(np.int64)
        ends = np.cumsum(n)
        at = ends - n
        out = np.zeros(int(ends[-1]) // 64 + 2, np.uint64)
        word, code = at >> 6, codes[part]
        room = 64 - (at & 63) - n
        head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        parts.append(out.astype(">u8").tobytes())
        checkpoints.append(at[::BLOCK].astype(np.uint64) + np.uint64(before))
        before += 64 * len(out)
    return b"".join(parts), np.concatenate([np.zeros(0, np.uint64), *checkpoints])


def decoder(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for each MAX_BITS bits."""
    codes, used = canonical(lengths), np.flatnonzero(lengths)
    order = used[np.argsort(codes[used] << (MAX_BITS - lengths[used]).astype(np.uint64))]
    span = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    symbol, size = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.int64)
    filled = int(span.sum())
    symbol[:filled], size[:filled] = np.repeat(order, span), np.repeat(lengths[order], span)
    return symbol, size


def decode(bits: np.ndarray, at: np.ndarray, count: int, symbol: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at these bits: each step decodes one id of every block."""
    b = np.concatenate([bits, np.zeros(4, np.uint8)]).astype(np.uint32)
    wide = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    pos, out = at.astype(np.int64), np.zeros((BLOCK, len(at)), np.uint32)
    last = count - (len(pos) - 1) * BLOCK
    for step in range(min(BLOCK, count)):
        live = pos if step < last else pos[:-1]
        code = (wide[live >> 3] >> (8 - (live & 7)).astype(np.uint32)) & 0xFFFF
        out[step, : len(live)] = symbol[code]
        live += size[code]
    return out.T.reshape(-1)[:count]


class Writer:
    """One file in the making: ids become codes as soon as a segment is full."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical(lengths)
        self.nulls, self.docs, self.per_doc, self.marks, self.bits = 0, [], [], [], []  # type: ignore[var-annotated]
        self.waiting, self.held, self.size, self.tokens = [], 0, 0, 0  # type: ignore[var-annotated]

    def add(self, doc_ids: np.ndarray, nulls: int, per_doc: np.ndarray, ids: np.ndarray) -> None:
        self.nulls += nulls
        self.docs.append(doc_ids.astype("<i8"))
        self.per_doc.append(per_doc.astype("<i8"))
        self.waiting.append(ids)
        self.held, self.tokens = self.held + len(ids), self.tokens + len(ids)
        if self.held >= SEGMENT:
            self.code(self.held // SEGMENT * SEGMENT)

    def code(self, n: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint16)
        bits, marks = write_bits(ids[:n], self.lengths, self.codes)
        self.marks.append((marks + np.uint64(8 * self.size)).astype("<u8"))
        self.bits.append(bits)
        self.size += len(bits)
        self.waiting, self.held = [ids[n:].copy()], len(ids) - n

    def count(self) -> int:
        return sum(map(len, self.docs))

    def pieces(self) -> list[bytes]:
        """The file's bytes, in order."""
        self.code(self.held)
        join = lambda parts: b"".join(p.tobytes() for p in parts)
        parts = [zlib.compress(self.lengths.tobytes(), 6), join(self.docs), join(self.per_doc), join(self.marks)]
        head = json.dumps({"symbols": len(self.lengths), "docs": self.count(), "nulls": self.nulls, "tokens": self.tokens, "sizes": [*map(len, parts), self.size]}).encode()
        return [MAGIC + len(head).to_bytes(8, "little") + head, *parts, *self.bits]


class Reader:
    """A token file behind a seekable binary stream; `runs` decodes it range by range."""

    def __init__(self, f):
        self.f = f
        start = f.read(12)
        if bytes(start[:4]) != MAGIC:
            raise ValueError("not a token file")
        head = int.from_bytes(start[4:12], "little")
        self.head, self.at = json.loads(f.read(head)), 12 + head
        lengths, docs, per_doc, marks = (f.read(n) for n in self.head["sizes"][:4])
        self.lengths = np.frombuffer(zlib.decompress(lengths), np.uint8)
        self.doc_ids, self.per_doc, self.marks = np.frombuffer(docs, "<i8"), np.frombuffer(per_doc, "<i8"), np.frombuffer(marks, "<u8")
        self.at += sum(self.head["sizes"][:4])

    def runs(self) -> Iterator[np.ndarray]:
        """All ids, those of LANES blocks at a time."""
        symbol, size = decoder(self.lengths)
        for lane in range(0, len(self.marks), LANES):
            marks = self.marks[lane : lane + LANES].astype(np.int64)
            begin = int(marks[0]) >> 3
            # the last code of a range may reach into the next word
            end = min(self.head["sizes"][4], (int(self.marks[lane + LANES]) >> 3) + 8 if lane + LANES < len(self.marks) else self.head["sizes"][4])
            self.f.seek(self.at + begin)
            bits = np.frombuffer(self.f.read(end - begin), np.uint8)
            yield decode(bits, marks - 8 * begin, min(self.head["tokens"] - lane * BLOCK, len(marks) * BLOCK), symbol, size)

    def documents(self, wanted: bool = True) -> Iterator[tuple[int, list[int], list[np.ndarray]]]:
        """Of each run the first document that ends in it, and the crc32 and, if wanted, ids of all that do."""
        at = np.concatenate([[0], np.cumsum(self.per_doc)])
        done, low, crc, kept = 0, 0, 0, []  # type: ignore[var-annotated]
        for ids in self.runs():
            ids, high = np.ascontiguousarray(ids, "<u4"), low + len(ids)
            stop = int(np.searchsorted(at[1:], high, "right"))
            crcs, parts = [], []
            for i, j in zip((np.maximum(at[done:stop], low) - low).tolist(), (at[done + 1 : stop + 1] - low).tolist(), strict=True):
                crcs.append(zlib.crc32(ids[i:j], crc))
                if wanted:
                    parts.append(np.concatenate([*kept, ids[i:j]]))
                crc, kept = 0, []
            if stop < len(self.per_doc) and at[stop] < high:
                rest = ids[max(int(at[stop]), low) - low :]
                crc, kept = zlib.crc32(rest, crc), [*kept, rest] if wanted else []
            yield done, crcs, parts
            done, low = stop, high


def pack_file(doc_ids: np.ndarray, per_doc: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    w = Writer(lengths)
    w.add(doc_ids, 0, per_doc, ids)
    return b"".join(w.pieces())


def unpack_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids per document, all ids."""
    r = Reader(pa.BufferReader(data))
    return r.doc_ids, r.per_doc, np.concatenate([np.zeros(0, np.uint32), *r.runs()])


def count_ids(docs: DataFrame, path: str, end: int, symbols: int) -> np.ndarray:
    """How often each id occurs in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n, some = tokens.encoder(path), np.zeros(symbols, np.int64), 0
        for batch in batches:
            for chunk in T.chunks(batch):
                n += np.bincount(enc.encode(*T.text_bytes(chunk.column(0)))[0], minlength=symbols)
                some += chunk.num_rows
        n[end] += some
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["id", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(symbols, np.int64)
    out[np.asarray(rows["id"], dtype=np.int64)] = np.asarray(rows["n"], dtype=np.int64)
    return out


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = 0, files: int | None = None, file_bytes: int = FILE_BYTES) -> list[tuple[str, int, int]]:
    """Writes the token files of all documents into folder, in ascending order of doc_id. Returns (file, documents, ids) of each in order;
    `files` is the least number of them."""
    on_path(docs.sparkSession)
    path = path or tokens.default_path("byte_bpe_50k.json")
    symbols = max(tokens.encoder(path).tokenizer.get_vocab_size(), end + 1)
    counts = count_ids(docs, path, end, symbols)
    lengths = code_lengths(counts)
    parts = max(files or shuffle_partitions(docs.sparkSession), -(-int((counts * lengths).sum()) // (8 * file_bytes)))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        enc, context, writer, number = tokens.encoder(path), TaskContext.get(), Writer(lengths), 0
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def close() -> pa.RecordBatch:
            name = f"{context.partitionId():08d}-{number:06d}.cht"
            with store.open_output_stream(f"{base}/{name}.{context.taskAttemptId()}") as f:
                for piece in writer.pieces():
                    f.write(piece)
            store.move(f"{base}/{name}.{context.taskAttemptId()}", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.count()], pa.int64()), pa.array([writer.tokens], pa.int64())], ["file", "docs", "tokens"])

        for batch in batches:
            for chunk in T.chunks(batch):
                flat, at = tokens.with_end(*enc.encode(*T.text_bytes(chunk.column(1))), end, np.uint16 if symbols <= 65536 else np.uint32)
                writer.add(np.asarray(chunk.column(0).fill_null(0)), chunk.column(0).null_count, np.diff(at), flat)
                if writer.size >= file_bytes:
                    yield close()
                    writer, number = Writer(lengths), number + 1
        if writer.tokens:
            yield close()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    # a row per file; taken one partition at a time, the files would be written one after another
    return sorted((r.file, r.docs, r.tokens) for r in ordered.mapInArrow(tidy(write), "file string, docs long, tokens long").collect())


def read_tokens(spark: SparkSession, folder: str, written: list[tuple[str, int, int]], ids: bool = False) -> DataFrame:
    """A row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and `ids` if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    if not written:
        return spark.createDataFrame([], schema)
    before = np.cumsum([0, *(n for *_, n in written)])[:-1].tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        tokens.drop()
        let_go()
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as f:
                    r = Reader(f)
                    at = np.concatenate([[0], np.cumsum(r.per_doc)]) + start
                    for done, crcs, parts in r.documents(ids):
                        here = slice(done, done + len(crcs))
                        cols = [pa.array(r.doc_ids[here], mask=np.arange(done, done + len(crcs)) < r.head["nulls"]), pa.array(at[:-1][here]), pa.array(r.per_doc[here]), pa.array(crcs, pa.int64())]
                        if ids:
                            ends = np.concatenate([[0], np.cumsum(r.per_doc[here])])
                            cols.append(pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(np.concatenate([np.zeros(0, "<u4"), *parts]).astype(np.int32))))
                        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])

    todo = spark.createDataFrame([(name, start) for (name, *_), start in zip(written, before, strict=True)], "file string, start long")
    return todo.repartition(min(len(written), READERS)).mapInArrow(tidy(read), schema)


def round_trip(docs: DataFrame, path: str | None = None, end: int = 0) -> DataFrame:
    """Writes the token files of docs to the shared folder and reads them back."""
    folder = shared_dir(docs.sparkSession)
    return read_tokens(docs.sparkSession, folder, write_tokens(docs, folder, path, end))
