"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; its hash is the axis of the cross-polytope nearest to the
rotated vector. A table joins HASHES such hashes to one code, and lists each vector under its PROBES best codes. With the
parameters here a pair at the threshold is missed with a probability below 1e-5 in 64 dimensions.

Equal vectors are one class. A listing is a bucket's key, a class number and SIGNS signs of other rotations; vectors don't travel with it.

1. Buckets are dealt to tasks by rows, a large bucket as a grid of blocks, so that no cell holds more than two blocks. A task compares
   the signs of its cells' pairs and returns the members that are near enough to some other one for a link, most often none.
2. Only these members' vectors are joined, and the pairs that are near by sign are compared in double precision. A pair counts only in
   the cell of the smallest key that it shares, so counts can be summed; a task returns a sum of links by class and its components as
   stars, never its pairs.

Signs of a pair at the threshold differ with a known probability; the bar lies SURE standard deviations above its mean, which misses
fewer pairs than the hashes do. Components of any finite size count, since vectors are scaled by their largest one first.

Vectors that are null, zero or have null or non-finite components link with nothing, and so do rows without vec_id (their component
is null and they are kept). Vectors are compared with those of equal length. Rows of equal vec_id are vectors of their own with one
component. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.llm import text as T
from streetflow.llm.decontaminate import sized
from streetflow.llm.minhash import pairs_within
from streetflow.llm.shared import components, forget, on_path, stars, table, tidy

TABLES, HASHES, PROBES, CHOICES = 6, 2, 4, 4
SIGNS, SURE = 128, 6.2
#: vectors rotated at once, which stay in the processor's cache
CACHED = 1024
BLOCK = 1024
#: listings that a task compares
TASK_ROWS = 100_000
#: a table's buckets hold about so many listings at most before codes are made longer
LISTINGS = 256


def plan(n: int, dim: int = 64) -> tuple[int, int, int]:
    """Tables, hashes a code, and probes for n vectors: longer codes keep buckets small, more tables and probes keep the recall."""
    tables, hashes, probes = TABLES, HASHES, PROBES
    while n * probes > LISTINGS * (2 * dim) ** hashes:
        tables, hashes, probes = tables * 2, hashes + 1, probes * 2
    return tables, hashes, probes


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of columns whose length is a power of two, orthonormal."""
    n, h, other = x.shape[0], 1, np.empty_like(x)
    while h < n:
        v, o = x.reshape(n // (2 * h), 2, h, -1), other.reshape(n // (2 * h), 2, h, -1)
        np.add(v[:, 0], v[:, 1], out=o[:, 0])
        np.subtract(v[:, 0], v[:, 1], out=o[:, 1])
        x, other, h = other, x, 2 * h
    return x * x.dtype.type(1 / np.sqrt(n))


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Columns after three rounds of random signs and a transform."""
    for signs in np.random.default_rng(seed).choice(np.array([-1, 1], x.dtype), (3, x.shape[0], 1)):
        x = hadamard(x * signs)
    return x


def padded(x: np.ndarray) -> np.ndarray:
    size = max(CHOICES, 1 << max(0, x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, size - x.shape[1]))).astype(np.float32)


def codes(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """The codes of each vector, (rows, tables, probes), best first."""
    x = padded(x)
    size = x.shape[1]
    picks = np.indices((CHOICES,) * hashes).reshape(hashes, -1)
    out = np.zeros((len(x), tables, probes), np.int64)
    for lo in range(0, len(x), CACHED):
        columns = np.ascontiguousarray(x[lo : lo + CACHED].T)
        for t in range(tables):
            score, code = 0, 0
            for k in range(hashes):
                y = np.ascontiguousarray(rotated(columns, 1000 * t + k).T)
                most = np.abs(y)
                best = np.argpartition(-most, CHOICES - 1, 1)[:, :CHOICES] if size > CHOICES else np.tile(np.arange(size), (len(y), 1))
                best = np.take_along_axis(best, np.lexsort((best, -np.take_along_axis(most, best, 1))), 1)
                value = np.take_along_axis(y, best, 1)
                score = score + np.abs(value)[:, picks[k]]
                code = code * (2 * size) + (2 * best + (value < 0))[:, picks[k]]
            out[lo : lo + CACHED, t] = np.take_along_axis(code, np.argsort(-score, 1, kind="stable")[:, :probes], 1)
    return out


def keys(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """The bucket keys of unit vectors of one length, (rows, tables * probes): hashes of length, table and code."""
    code = codes(x, tables, hashes, probes).astype(np.uint64)
    salt = T.mix(np.arange(tables, dtype=np.uint64) + np.uint64(x.shape[1] << 20))
    return T.mix(code * T._GOLD ^ salt[:, None]).reshape(len(x), -1).view(np.int64)


def sign_words(x: np.ndarray) -> np.ndarray:
    """SIGNS signs of the coordinates of rotated vectors, as two 64-bit words."""
    x = np.ascontiguousarray(padded(x).T)
    bits = np.concatenate([rotated(x, 10_000_000 + k)[:SIGNS] > 0 for k in range(-(-SIGNS // len(x)))])[:SIGNS]
    return np.packbits(np.ascontiguousarray(bits.T), axis=1).view(np.int64)


def most_apart(least: float) -> int:
    p = math.acos(min(1.0, max(-1.0, least))) / math.pi
    return min(SIGNS, math.ceil(SIGNS * p + SURE * math.sqrt(SIGNS * p * (1 - p))))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def raw_vectors(col: pa.Array) -> pa.Array:
    """Each vector's bytes; null for those that link with nothing."""
    v, offs = col.values.to_numpy(zero_copy_only=False), np.asarray(col.offsets)
    v = v + v.dtype.type(0)  # no negative zeros
    count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])
    ok = np.asarray(col.is_valid()) & (count(~np.isfinite(v)) == 0) & (count(v != 0) > 0)
    offsets = np.ascontiguousarray(offs * v.dtype.itemsize, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(col), [pa.array(ok).buffers()[1], pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(v))]).cast(pa.binary())


def by_length(raw: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit vectors of equal length, and the rows that they are of."""
    items = raw.to_pylist()
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, unit(np.frombuffer(b"".join([items[i] for i in at.tolist()]), f"<f{width}").reshape(len(at), -1))


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors (vec_id, embedding)."""
    on_path(vectors.sparkSession)
    width = 4 if dict(vectors.dtypes)["embedding"] == "array<float>" else 8
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if width == 4 else "array<double>").alias("embedding"))

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), raw_vectors(batch.column(1))], ["vec_id", "raw"])

    # a vector is known by a digest, since rows of one vec_id may differ
    all_rows = rows.mapInArrow(tidy(valid), "vec_id long, raw binary").withColumn("dig", F.substring(F.unhex(F.sha2("raw", 256)), 1, 16))
    some = all_rows.where("raw is not null and vec_id is not null")
    classes = table(some.groupBy("dig").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.any_value("raw").alias("raw")).withColumn("class", F.monotonically_increasing_id()))
    n = classes.count()
    shape = plan(n)
    bar = most_apart(least)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column(1), width):
                k, s = keys(x, *shape), sign_words(x)
                who = np.repeat(at, k.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1)), batch.column(0).take(pa.array(who)), pa.array(np.repeat(s[:, 0], k.shape[1])), pa.array(np.repeat(s[:, 1], k.shape[1]))], ["key", "class", "s0", "s1"])

    entries = classes.select("class", "raw").mapInArrow(tidy(listed), "key long, class long, s0 long, s1 long")
    large = table(entries.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > BLOCK))
    side = F.coalesce(F.ceil(F.col("many") / BLOCK), F.lit(1)).cast("int")
    grid = entries.join(sized(large), "key", "left").withColumn("x", F.pmod(F.xxhash64("class", "key"), side).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), side - 1)))
    # of two different blocks, part says which one a row is of
    part = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2).cast("byte")
    cell = F.when(F.col("many").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("x", "y"), F.greatest("x", "y")))
    cells = grid.select("key", cell.alias("cell"), part.alias("part"), "class", "s0", "s1")
    tasks = max(1, -(-n * shape[0] * shape[2] // TASK_ROWS))
    dealt = lambda df, k: df.withColumn("task", F.pmod(F.col("cell"), F.lit(k)).cast("int")).groupBy("task")

    def near(t: pa.Table) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
        """The rows in order of cells, and the pairs of them, by place in that order, whose signs allow a link."""
        at = T.order(np.asarray(t["cell"]).view(np.uint64))
        c, f, s0, s1 = (np.asarray(t[name])[at] for name in ("cell", "part", "s0", "s1"))
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
        sizes = np.diff(np.flatnonzero(np.diff(c, prepend=c[0] - 1)), append=len(c)) if len(c) else np.zeros(0, np.int64)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for p, q in pairs_within(sizes):
                ok = np.bitwise_count(s0[p] ^ s0[q]).astype(np.int64) + np.bitwise_count(s1[p] ^ s1[q]) <= bar
                p, q = p[ok], q[ok]
                ok = (f[p] == 0) | (f[p] != f[q])
                yield p[ok], q[ok]

        return at, pairs()

    def find(t: pa.Table) -> pa.Table:
        at, pairs = near(t)
        hit = np.zeros(len(at), bool)
        for p, q in pairs:
            hit[p] = hit[q] = True
        return t.take(pa.array(np.sort(at[hit]))).select(["key", "cell", "part", "class", "s0", "s1"])

    found = "key long, cell long, part byte, class long, s0 long, s1 long"
    active = table(dealt(cells, tasks).applyInArrow(find, found))
    forget(large)

    def compare(t: pa.Table) -> pa.Table:
        at, pairs = near(t)
        t = t.take(pa.array(at))
        key, size, ids, own_class = (np.asarray(t[name]) for name in ("key", "size", "id", "class"))
        length, place, vectors_ = np.zeros(t.num_rows, np.int64), np.zeros(t.num_rows, np.int64), {}
        for rows_, x in by_length(t["raw"].combine_chunks(), width):
            length[rows_], place[rows_], vectors_[x.shape[1]] = x.shape[1], np.arange(len(rows_)), x
        known = {n_: keys(x, *shape) for n_, x in vectors_.items()}
        links, a, b = np.zeros(t.num_rows, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p, q in pairs:
            for lo in range(0, len(p), 1 << 13):
                i, j = p[lo : lo + (1 << 13)], q[lo : lo + (1 << 13)]
                same = length[i] == length[j]
                for n_ in np.unique(length[i[same]]).tolist():
                    u, v = (z[same & (length[i] == n_)] for z in (i, j))
                    x = vectors_[n_]
                    ok = np.einsum("ij,ij->i", x[place[u]], x[place[v]]) >= least
                    u, v = u[ok], v[ok]
                    one, two = known[n_][place[u]], known[n_][place[v]]
                    first = np.where((one[:, :, None] == two[:, None, :]).any(-1), one, np.iinfo(np.int64).max).min(1)
                    u, v = u[first == key[u]], v[first == key[u]]
                    links += np.bincount(u, size[v], t.num_rows).astype(np.int64) + np.bincount(v, size[u], t.num_rows).astype(np.int64)
                    root, rest = stars(ids[u], ids[v])
                    a, b = [*a, root], [*b, rest]
        root, rest = stars(np.concatenate(a), np.concatenate(b))
        some_ = np.flatnonzero(links)
        none = np.zeros(len(some_), np.int64)
        return pa.table({
            "class": pa.concat_arrays([pa.array(own_class[some_], pa.int64()), pa.nulls(len(root), pa.int64())]),
            "links": pa.array(np.concatenate([links[some_], np.zeros(len(root), np.int64)])),
            "a": pa.array(np.concatenate([none, root])),
            "b": pa.array(np.concatenate([none, rest])),
        })

    with_vectors = active.join(classes.select("class", "id", "size", "raw"), "class")
    linked = table(dealt(with_vectors, max(1, -(-active.count() // (TASK_ROWS // 4)))).applyInArrow(compare, "class long, links long, a long, b long"))
    forget(active)
    # rows of one vec_id with different vectors join their classes
    twice = some.groupBy("vec_id").agg(F.min("dig").alias("lo"), F.max("dig").alias("hi")).where("lo <> hi").select("vec_id")
    joined = some.select("vec_id", "dig").join(twice, "vec_id").join(classes.select("dig", "id"), "dig").select(F.col("vec_id").alias("a"), F.col("id").alias("b"))
    comps = components(linked.where("class is null").select("a", "b").union(joined)).select(F.col("v").alias("id"), "c")
    links = linked.where("class is not null").groupBy("class").agg(F.sum("links").alias("links"))
    by_class = classes.select("class", "dig", "id", "size").join(comps, "id", "left").join(links, "class", "left")
    by_class = by_class.select("dig", F.coalesce("c", "id").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = all_rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("dig")).alias("dig")).join(by_class, "dig", "left")
    component = F.coalesce(F.col("c"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
