"""Text sources: object streams, road queries, id lists and result relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetflow import schemas
from streetflow.functions import geometry as G
from streetflow.storage import table


def locations(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated t oid x y qid."""
    return spark.read.schema(schemas.LOCATIONS).csv(path, sep=" ")


def locations_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same as a stream of files, in the order of their arrival; event time in the column ts."""
    stream = spark.readStream.schema(schemas.LOCATIONS).option("maxFilesPerTrigger", files_per_trigger).csv(path, sep=" ")
    return stream.withColumn("ts", F.timestamp_micros(F.round(F.col("t") * 1e6).cast("long")))


def by_event_time(points: DataFrame, period: float) -> DataFrame:
    """Each point's cycle: the first multiple of period that isn't before it."""
    return points.withColumn("cycle", F.ceil(F.col("t") / period) * period)


def with_rank(points: DataFrame, *order: str) -> DataFrame:
    """rank: each row's place from 1 in the order of the whole input.

    Places come from the counts of range partitions, so that no task sees more than its own partition. The sorted partitions are written
    with their numbers and their rows': counted and ranked apart, adaptive execution could cut the same rows in two ways.
    """
    place = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's
    ranged = table(points.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place))
    ranged = ranged.withColumn("__part", F.shiftright("__place", 33))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row per partition
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    local = F.col("__place").bitwiseAND((1 << 33) - 1) + 1
    return ranged.join(F.broadcast(before), "__part").withColumn("rank", F.col("__before") + local).drop("__part", "__place", "__before")


def by_arrival(points: DataFrame, rate: int, *order: str) -> DataFrame:
    """Cycles of `rate` points each, in the given order."""
    return with_rank(points, *order).withColumn("cycle", F.floor((F.col("rank") - 1) / rate)).drop("rank")


def _vertex(text: Column) -> Column:
    v = F.split(text, ",")
    return F.struct(v[0].cast("double").alias("x"), v[1].cast("double").alias("y"))


def roads(spark: SparkSession, path: str, rome: bool, global_window: bool = True, window: tuple[int, int] = (0, 0)) -> DataFrame:
    """Road queries. Rome's lines are `t qid cid Xs,Ys Xe,Ye ring`, Athens' `t qid range slide Xs,Ys Xe,Ye ring`. With a global window
    its range and slide replace those of the file; Rome's file has none. Of equal qids the first line counts where only one may."""
    return parse_roads(spark.read.text(path), rome, global_window, window)


def parse_roads(lines: DataFrame, rome: bool, global_window: bool = True, window: tuple[int, int] = (0, 0)) -> DataFrame:
    """As roads, from lines of text in the column value."""
    f = F.split(F.trim("value"), " +", -1)
    skip = 0 if rome else 1
    wide = F.lit(window[0]).cast("long"), F.lit(window[1]).cast("long")
    own = (F.lit(0).cast("long"), F.lit(0).cast("long")) if rome else (f[2].cast("long"), f[3].cast("long"))
    return lines.where(F.length(F.trim("value")) > 0).select(
        f[0].cast("long").alias("t"), f[1].cast("int").alias("qid"), (f[2].cast("int") if rome else F.lit(None).cast("int")).alias("cid"),
        *(F.when(F.lit(global_window), w).otherwise(o).alias(n) for w, o, n in zip(wide, own, ("range", "slide"), strict=True)),
        _vertex(f[3 + skip]).alias("start"), _vertex(f[4 + skip]).alias("end"), G.parse_ring(f[5 + skip]).alias("ring"),
    )


def active_ids(spark: SparkSession, path: str) -> DataFrame:
    """Integers between white space, in any number of lines."""
    return spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("q")).where("q <> ''").select(F.col("q").cast("int").alias("qid"))


def start_times(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.START_TIMES).csv(path, sep=" ")


def first_times(points: DataFrame) -> DataFrame:
    """The same table, derived from the stream."""
    return points.groupBy("oid").agg(F.min("t").alias("t"))


def road_segments(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schemas.ROAD_SEGMENTS).csv(path, sep=sep)


def buffers(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schemas.BUFFERS).csv(path, sep=sep, nullValue="")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Comma-separated t, qid, speed, num_objects; empty is null."""
    return spark.read.schema(schemas.RESULTS).csv(path, sep=",", nullValue="")


def axes(spark: SparkSession, path: str) -> DataFrame:
    """Road axes with a header, separated by spaces; empty is null."""
    return spark.read.schema(schemas.AXES).csv(path, sep=" ", header=True, nullValue="")
