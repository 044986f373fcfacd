"""What several operators need from the cluster: the shared folder, tables written there, sizes, connected components."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetflow.storage import forget, shared_dir, table, trim

__all__ = ["components", "forget", "group_count", "on_path", "shared_dir", "shuffle_partitions", "size_in_bytes", "stars", "table", "tidy", "tidy_driver"]
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: estimates from here on stand for an unknown size
UNKNOWN_SIZE = 1 << 55


def on_path(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it, besides their own path, and get batches of bounded size."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    if int(spark.conf.get(BATCH, "10000")) == 10000:  # Spark's own number; long texts make batches of that many rows large
        spark.conf.set(BATCH, "2000")
        spark.conf.set(BATCH_BYTES, str(4 << 20))


def let_go() -> None:
    """Gives the memory that this Python worker has freed back to the machine. Workers outlive their tasks, and what one keeps is
    missing to the next stage of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidy_driver(spark: SparkSession) -> None:
    """The driver lets its memory go: garbage of the JVM and what either process has freed."""
    spark._jvm.System.gc()
    trim(spark)
    let_go()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the worker lets its memory go."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            let_go()

    return tidied


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, for a table read from files their size; where it has none, half the bytes of the texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < UNKNOWN_SIZE:
        return size
    return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def group_count(docs: DataFrame, group_mb: int = 8) -> int:
    """So many groups that one holds about group_mb of text (compressed files hold about half of it)."""
    return max(2 * shuffle_partitions(docs.sparkSession), -(-2 * size_in_bytes(docs) // (group_mb << 20)))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges (a, b) as stars: the smallest vertex of each with every other. Tasks that see parts of one large group
    mostly agree on its smallest vertex, so that their stars fall together."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    rest = np.array(sorted(up), np.int64)
    roots = np.array([find(x) for x in rest.tolist()], np.int64)
    return roots[roots != rest], rest[roots != rest]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): rows (v, c) with c the smallest vertex that v reaches, for every vertex that isn't its
    own component's smallest.

    Alternating large-star and small-star rounds; each round is a combinable minimum by vertex and a join which adaptive execution
    splits where a vertex has very many edges. Nothing but a count and a checksum comes to the driver.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())

    e = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    was = state(e)
    for _ in range(rounds):
        if not was[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large
        mins = least(down)
        small = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(mins.select("u", F.col("m").alias("v")))
        old, e = e, table(small.where("u <> v").distinct())
        now = state(e)
        forget(old)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return e.select(F.col("u").alias("v"), F.col("v").alias("c"))
