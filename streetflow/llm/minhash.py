"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures, every link confirmed on the full shingle sets.

A signature is CHUNKS * WIDTH minima of hashed shingles, BITS bits each. Two signatures are candidates if at most
CHUNKS * (ERRORS + 1) - 1 of their symbols differ; by the pigeonhole principle such a pair has a chunk with at most ERRORS differing
symbols, and so agrees on the remaining symbols of that chunk for one of its C(WIDTH, ERRORS) choices. Each signature is therefore
listed under CHUNKS * C(WIDTH, ERRORS) keys, and the join on keys finds every pair under the threshold. At a similarity of 0.75 a
pair exceeds the threshold with a probability below 0.001, which falls fast above it.

Documents with equal shingle sets are one class, found by a 128-bit digest, and go on as one row. Of the members of a key:

1. each is paired with the key's smallest class only (a star, not all pairs); pairs under the signature threshold are confirmed on
   their texts, and confirmed links make components;
2. keys whose members are then in more than one component are unresolved. Their members are compared signature by signature, a large
   key in a grid of blocks so that no task holds more than two blocks. Pairs of different components under the threshold are not
   listed: a task returns their components as stars, which give groups within which all of them lie. The texts of a group meet in
   one task, or in a grid of pairs of blocks, where exact intersections are counted by matrix products; true links are again
   returned as stars. The components of all links are the result; pairs within a component are not needed for it.

Words are separated by ASCII white space, A-Z lower-cased; a set holds the distinct shingles of SHINGLE words, or the whole sequence
where there are fewer. Texts that are null or without words have an empty set and link with nothing. Rows of equal doc_id are one
document in the graph, linked by any of its rows, and keep a row each; rows without doc_id link with nothing, have a null component
and are kept. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm import text as T
from streetflow.llm.shared import components, forget, on_path, shuffle_partitions, stars, table, tidy

SHINGLE = 5
CHUNKS, WIDTH, ERRORS, BITS = 7, 6, 2, 16
SYMBOLS = CHUNKS * WIDTH
MOST_APART = CHUNKS * (ERRORS + 1) - 1
#: ids so few are sent to all executors; more are joined by shuffle
BROADCAST_IDS = 1_000_000
#: documents and shingles in a block of a large group
BLOCK, BLOCK_SHINGLES = 512, 300_000
#: rows that a task compares: the more keys of a large group it sees, the fewer stars of that group there are in all
TASK_ROWS = 20_000


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of all documents, in order of document, and len+1 offsets."""
    buf = T.lower_ascii(buf)
    starts, lens, first = T.words(buf, offs)
    h = T.hash_spans(buf, starts, lens)
    n = np.diff(first)
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = T.ragged(first[:-1], per)
    doc = np.repeat(np.arange(len(n)), per)
    size = np.minimum(n, k)[doc]
    s = size.astype(np.uint64)
    for j in range(k):
        more = j < size
        s = np.where(more, s * T._GOLD + h[np.minimum(at + j, max(len(h) - 1, 0))], s) if len(h) else s
    s = T.mix(s)
    own = T.mix(s ^ T.mix(doc.astype(np.uint64) + np.uint64(1)))
    keep = np.zeros(len(own), bool)
    keep[T.distinct(own)[0]] = True
    return s[keep], np.searchsorted(doc[keep], np.arange(len(n) + 1))


def signatures(s: np.ndarray, at: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """BITS-bit minima by document; rows of empty sets are zero."""
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, symbols), np.uint16)
    if len(full):
        rng = np.random.default_rng(7)
        for j in range(symbols):
            a, b = rng.integers(1 << 63, size=2, dtype=np.uint64)
            v = (s ^ b) * (a * np.uint64(2) + np.uint64(1))
            out[full, j] = T.mix(np.minimum.reduceat(v, at[:-1][full])) >> np.uint64(64 - BITS)
    return out


def digests(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each set, whatever the order of its members."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full, 0] = np.add.reduceat(T.mix(s + T._C1), at[:-1][full])
        out[full, 1] = np.add.reduceat(T.mix(s ^ T._C2), at[:-1][full])
    return out


def keys(sig: np.ndarray) -> np.ndarray:
    """The keys of each signature: one for each chunk and choice of symbols that must agree."""
    out = []
    for c in range(CHUNKS):
        for p, agree in enumerate(itertools.combinations(range(WIDTH), WIDTH - ERRORS)):
            k = np.full(len(sig), c * 1000 + p, np.uint64)
            for j in agree:
                k = T.mix(k * T._GOLD + sig[:, c * WIDTH + j])
            out.append(k)
    return np.stack(out, 1) if out else np.zeros((len(sig), 0), np.uint64)


def fixed(rows: np.ndarray) -> pa.Array:
    """A binary column from the rows of a matrix."""
    raw, n = np.ascontiguousarray(rows), rows.shape[1] * rows.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * n).astype(np.int32)), pa.py_buffer(raw)])


def matrix(col: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(-1)


def sketch(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch):
                s, at = shingles(*T.text_bytes(chunk.column(1)), k)
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(np.diff(at).astype(np.int64)), fixed(digests(s, at)), fixed(signatures(s, at))], ["doc_id", "n", "dig", "sig"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, dig binary, sig binary")


def list_keys(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                k = keys(matrix(part.column(1), np.uint16, SYMBOLS))
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0)), k.shape[1]))], ["key", "id"])

    return classes.select("id", "sig").mapInArrow(tidy(run), "key long, id long")


def near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose set sizes and signatures allow a link."""
    one = classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    two = classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = apart(matrix(batch.column(2), np.uint16, SYMBOLS), matrix(batch.column(3), np.uint16, SYMBOLS)) <= MOST_APART
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(close))

    return both.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) of documents, those whose full sets are similar enough."""
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in T.chunks(batch, "ta"):
                x, y = shingles(*T.text_bytes(chunk.column(2)), k), shingles(*T.text_bytes(chunk.column(3)), k)
                nx, ny = np.diff(x[1]), np.diff(y[1])
                doc = np.concatenate([np.repeat(np.arange(len(nx)), nx), np.repeat(np.arange(len(ny)), ny)]).astype(np.uint64)
                both = np.sort(T.mix(np.concatenate([x[0], y[0]]) ^ T.mix(doc + np.uint64(1))))
                shared = both[1:][both[1:] == both[:-1]]
                # the document of a shared shingle, by its place in the left set's own hashes
                own = T.mix(x[0] ^ T.mix(doc[: len(x[0])] + np.uint64(1)))
                order = T.order(own)
                inter = np.bincount(doc[: len(x[0])][order[np.searchsorted(own[order], shared)]].astype(np.int64), minlength=len(nx)) if len(shared) else np.zeros(len(nx), np.int64)
                ok = (100 * inter >= percent * (nx + ny - inter)) & (inter > 0)
                yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(1)], ["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(tidy(run), "a long, b long").distinct()


def pairs_within(sizes: np.ndarray, most: int = 200_000):
    """Index pairs p < q of rows of one group, for groups of the given sizes that follow one another, in pieces."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.arange(len(start))
    after = start + np.repeat(sizes, sizes) - 1 - row
    ends, lo = np.cumsum(after), 0
    while lo < len(row):
        hi = max(lo + 1, int(np.searchsorted(ends, (int(ends[lo - 1]) if lo else 0) + most, "right")))
        yield np.repeat(row[lo:hi], after[lo:hi]), T.ragged(row[lo:hi] + 1, after[lo:hi])
        lo = hi


def unresolved(members: DataFrame, comps: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold all pairs of classes that share a key, are in different components of comps, and are near by
    size and signature: of the pairs found in a task only their components are returned, as stars."""
    parts = shuffle_partitions(members.sparkSession)
    comp = members.join(comps.select(F.col("v").alias("id"), "c"), "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
    open_keys = comp.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("many")).where("lo <> hi").select("key", "many")
    rows = comp.join(open_keys, "key").join(classes.select("id", "n", "sig"), "id")
    side = F.ceil(F.col("many") / BLOCK).cast("int")
    cells = rows.withColumn("x", F.pmod(F.xxhash64("id"), side).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), side - 1)))
    cells = cells.select("key", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "c", "n", "sig")
    # many small cells go together; a cell of two blocks is never divided nor joined with another of its key
    cells = table(cells)
    tasks = max(1, -(-cells.count() // TASK_ROWS))
    cells = cells.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks)).cast("int")).repartition(parts, "task")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending")])
        key, i, j, x, ids, c, n = (np.asarray(t[name]) for name in ("key", "i", "j", "x", "id", "c", "n"))
        sig = matrix(t["sig"], np.uint16, SYMBOLS)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        a, b = [], []
        for p, q in pairs_within(np.diff(np.flatnonzero(new), append=len(key))):
            own = (c[p] != c[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q])) & ((x[p] != x[q]) | (i[p] == j[p]))
            p, q = p[own], q[own]
            near_ = apart(sig[p], sig[q]) <= MOST_APART
            a, b = [*a, ids[p[near_]]], [*b, ids[q[near_]]]
        a, b = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
        both = np.unique(np.stack([a, b], 1), axis=0)
        a, b = stars(both[:, 0], both[:, 1])
        return pa.table({"a": a, "b": b})

    return cells.groupBy("task").applyInArrow(compare, "a long, b long").distinct()


def confirm_groups(near_edges: DataFrame, comps: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Stars of the true links inside the components of near_edges, between different components of comps.

    A component's texts meet in one task, or in a grid of pairs of blocks if it is large; shared shingles are counted by products of
    0/1 matrices, so no pairs are listed.
    """
    groups = components(near_edges)
    home = table(groups.select(F.col("c").alias("grp"), F.col("v").alias("id")).union(groups.select(F.col("c").alias("grp"), F.col("c").alias("id")).distinct()))
    known = comps.select(F.col("v").alias("id"), "c")
    rows = home.join(known, "id", "left").select("grp", "id", F.coalesce("c", "id").alias("c")).join(classes.groupBy("id").agg(F.sum("n").alias("n")), "id")
    side = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int")
    rows = rows.join(rows.groupBy("grp").agg(side.alias("side")), "grp")
    few = home.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    cells = rows.select("grp", "id", "c", F.pmod(F.xxhash64("id"), F.col("side")).cast("int").alias("x"), "side")
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(cells) if few else cells, "id")
    texts = texts.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("side") - 1)))
    texts = texts.select("grp", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "c", "text")

    def check(t: pa.Table) -> pa.Table:
        ids, c, x = (np.asarray(t[name]) for name in ("id", "c", "x"))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        s, at = shingles(*T.text_bytes(t["text"]), k)
        size = np.diff(at)
        doc = np.repeat(np.arange(len(size)), size)
        _, column, many = np.unique(s, return_inverse=True, return_counts=True)
        shared = many[column] > 1
        doc, column = doc[shared], (np.cumsum(many > 1) - 1)[column[shared]]
        order = np.argsort(column, kind="stable")
        doc, column = doc[order], column[order]
        inter = np.zeros((len(size), len(size)), np.float32)
        width = 4096
        for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            here = slice(np.searchsorted(column, lo), np.searchsorted(column, lo + width))
            m = np.zeros((len(size), width), np.float32)
            m[doc[here], column[here] - lo] = 1
            inter += m @ m.T
        linked = 100 * inter >= percent * (size[:, None] + size[None] - inter)
        linked &= (inter > 0) & (c[:, None] != c[None]) & ((x[:, None] != x[None]) | (i == j))
        p, q = np.nonzero(np.triu(linked, 1))
        a, b = stars(ids[p], ids[q])
        return pa.table({"a": a, "b": b})

    return texts.groupBy("grp", "i", "j").applyInArrow(check, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs."""
    on_path(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_docs = table(sketch(docs, k))
    some = all_docs.where("n > 0 and doc_id is not null")
    # rows of one class carry the same signature, whichever is taken
    sets = some.groupBy("dig").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"), F.min("n").alias("n"))
    classes = table(sets.select("id", "n", "sig", "dig"))
    listed = list_keys(classes)
    least = listed.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("many")).where("many > 1").select("key", "a")
    members = table(listed.join(least, "key"))
    star = members.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    links = confirm(table(near(star, classes, percent)), docs, k, percent)
    # a doc_id with several texts belongs to several classes and links them
    twice = some.select("doc_id", "dig").distinct().groupBy("doc_id").agg(F.count("*").alias("many")).where("many > 1").select("doc_id")
    own = some.join(twice, "doc_id").join(classes.select("dig", "id"), "dig").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    links = table(links.union(own))
    comps = components(links)
    open_edges = table(unresolved(members.select("key", "id"), comps, classes, percent))
    forget(members)
    more = table(confirm_groups(open_edges, comps, docs, classes, k, percent))
    if not more.isEmpty():
        comps = components(links.union(more))
    # a document's class, then the class's component
    home = some.select("doc_id", "dig").join(classes.select("dig", "id"), "dig").where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    comps = comps.select(F.col("v").alias("id"), "c")
    doc_comp = home.select(F.col("a").alias("doc_id"), F.col("b").alias("id")).join(comps, "id", "left").select("doc_id", F.coalesce("c", "id").alias("c"))
    own = comps.select(F.col("id").alias("doc_id"), "c")
    found = doc_comp.union(own).groupBy("doc_id").agg(F.min("c").alias("c"))
    out = all_docs.join(found, "doc_id", "left")
    component = F.least(F.coalesce("c", "doc_id"), F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
