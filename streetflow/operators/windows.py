"""Sliding windows that are closed at both ends, speeds by road and the reporting rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetflow.operators.joins import small


def last_tick(points: DataFrame, period: int) -> DataFrame:
    """One row: the last cycle, the smallest multiple of period that isn't before the last point."""
    return points.agg((F.ceil(F.max("t") / period) * period).alias("last"))


def ticks(points: DataFrame, period: int, window: int, *, t: str = "t") -> DataFrame:
    """Points with each tick whose window [tick - window, tick] holds them, up to the last cycle."""
    first, end = F.ceil(F.col(t) / period), F.floor((F.col(t) + window) / period)
    bound = points.agg(F.ceil(F.max(t) / period).alias("__last"))
    out = points.join(F.broadcast(bound)).withColumn("__k", F.explode(F.sequence(first, F.least(end, F.col("__last")))))
    return out.withColumn("tick", F.col("__k") * period).drop("__k", "__last")


def object_means(points: DataFrame, period: int, window: int | Column, road: str = "qid", stream: DataFrame | None = None) -> DataFrame:
    """(tick, oid, road, m, n): mean and number of an object's speeds on a road in the tick's window; the window may be a column of points.

    The points that enter and leave with the same ticks are summed first, two sums for each object, road and cycle at most where the
    window is one for all, and only the sums are spread over the ticks. The last tick is that of `stream`, the raw points, which costs a
    scan of one column; without it the points themselves are computed twice.
    """
    own = points.where(F.col("v").isNotNull() & (F.col(road) != 0))
    bound = last_tick(points if stream is None else stream, period)
    first, end = F.ceil(F.col("t") / period), F.floor((F.col("t") + window) / period)
    panes = own.groupBy("oid", F.col(road).alias("road"), first.alias("k"), end.alias("end")).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    spread = panes.join(F.broadcast(bound)).withColumn("tick", F.explode(F.sequence(F.col("k") * period, F.least(F.col("end") * period, "last"), F.lit(period).cast("long"))))
    return spread.groupBy("tick", "oid", "road").agg((F.sum("s") / F.sum("n")).alias("m"), F.sum("n").alias("n"))


def road_speeds(means: DataFrame, roads: DataFrame, kind: str = "avg") -> DataFrame:
    """(tick, qid, speed, num_objects) of the registered roads: the mean or the largest of the objects' means."""
    out = F.avg("m") if kind == "avg" else F.greatest(F.max("m"), F.lit(0.0))
    registered = small(roads.select(F.col("qid").alias("road")).distinct(), roads)
    return means.join(registered, "road", "left_semi").groupBy("tick", F.col("road").alias("qid")).agg(out.alias("speed"), F.count("*").alias("num_objects"))


def reports(roads: DataFrame) -> Column:
    """Whether a tick is one at which the road's query reports."""
    return (F.col("tick") >= F.col("q_t") + F.col("q_range")) & ((F.col("tick") - F.col("q_t")) % F.col("q_slide") == 0)


def own_times(roads: DataFrame) -> DataFrame:
    """(qid, q_t, q_range, q_slide): when a road's query begins and reports."""
    return roads.groupBy("qid").agg(F.min("t").alias("q_t"), F.min("range").alias("q_range"), F.min("slide").alias("q_slide"))


def answer(kind: str = "avg") -> list[Column]:
    """speed and num_objects of a row that may have no objects: speed -1 and 0 objects; an average that is not above 0.001 is -1, too."""
    n = F.coalesce("num_objects", F.lit(0).cast("long"))
    low = F.col("speed") * n <= 0.001 if kind == "avg" else F.lit(False)
    return [F.when((n == 0) | low, -1.0).otherwise(F.col("speed")).alias("speed"), n.alias("num_objects")]


def answers(roads: DataFrame, speeds: DataFrame, tick: int, kind: str = "avg") -> DataFrame:
    """(t, qid, speed, num_objects) of all roads that report at one tick; speeds are that tick's."""
    due = own_times(roads).withColumn("tick", F.lit(tick).cast("long")).where(reports(roads))
    return due.join(speeds.drop("tick"), "qid", "left").select(F.col("tick").alias("t"), "qid", *answer(kind))


def report(roads: DataFrame, speeds: DataFrame, points: DataFrame, period: int, zero_fill: bool = True, kind: str = "avg") -> DataFrame:
    """(t, qid, speed, num_objects) at the reporting ticks. A road without objects has speed -1 and 0 objects if zero_fill; an average
    that is not above 0.001 is shown as -1 and keeps its count."""
    own = small(own_times(roads), roads)
    if zero_fill:
        grid = last_tick(points, period).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(period).cast("long"))).alias("tick"))
        # every tick with every road: the output's own size
        frame = grid.join(own).where(reports(roads))
        out = frame.join(speeds, ["tick", "qid"], "left")
    else:
        out = speeds.join(own, "qid").where(reports(roads))
    return out.select(F.col("tick").cast("long").alias("t"), "qid", *answer(kind))


def own_windows(points: DataFrame, roads: DataFrame, period: int, stream: DataFrame | None = None) -> DataFrame:
    """Object means where each road has a window of its own: a point's window is that of its road, the shortest of a road's segments."""
    ranges = small(roads.groupBy("qid").agg(F.min("range").alias("__range")), roads)
    return object_means(points.join(ranges, "qid"), period, F.col("__range"), stream=points if stream is None else stream)


def panes(points: DataFrame, slide: int, keep: int) -> DataFrame:
    """(pane, qid, n, total): points by slide and road, and their sum over the last `keep` panes."""
    own = points.where("qid <> 0").groupBy((F.ceil(F.col("t") / slide) * slide).alias("pane"), "qid").agg(F.count("*").alias("n"))
    w = Window.partitionBy("qid").orderBy("pane").rangeBetween(-(keep - 1) * slide, 0)
    return own.withColumn("total", F.sum("n").over(w))


def telemetry(points: DataFrame, means: DataFrame, period: int, window: int, slide: int, stored: DataFrame | None = None, processed: DataFrame | None = None) -> DataFrame:
    """By tick: points in, evicted, all so far, active and new objects, objects with a road, objects in all; with the stored points given
    also how many of the tick's points were processed and stored. Without shedding all points are processed."""
    cycle = (F.ceil(F.col("t") / period) * period).alias("tick")
    came = points.groupBy(cycle).agg(F.count("*").alias("tuples"))
    # a point leaves at the first tick whose window begins after it
    left = points.groupBy(((F.floor((F.col("t") + window) / period) + 1) * period).alias("tick")).agg(F.count("*").alias("evicted"))
    new = points.groupBy("oid").agg(F.min("t").alias("t")).groupBy(cycle).agg(F.count("*").alias("newbies"))
    active = points.select("oid", "t").withColumn("k", F.explode(F.sequence(F.ceil(F.col("t") / period), F.ceil((F.col("t") + slide) / period) - 1)))
    active = active.groupBy((F.col("k") * period).alias("tick")).agg(F.countDistinct("oid").alias("active"))
    profit = means.groupBy("tick").agg(F.countDistinct("oid").alias("profitable"))
    grid = last_tick(points, period).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(period).cast("long"))).alias("tick"))
    out = grid
    more = [] if stored is None else [p.groupBy(cycle).agg(F.count("*").alias(c)) for p, c in ((points if processed is None else processed, "processed"), (stored, "stored"))]
    for part in (came, left, new, active, profit, *more):
        out = out.join(part, "tick", "left")
    out = out.na.fill(0)
    so_far = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("so_far", F.sum("tuples").over(so_far)).withColumn("total", F.sum("newbies").over(so_far))
