"""Run-length segments of trajectories by road or by cell, and scores made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetflow.operators.trajectory import order


def segments(points: DataFrame, key: str) -> DataFrame:
    """(oid, seg, key, t1, t2, n): maximal runs of equal key; a segment ends where the next begins, the last at its last point."""
    w = Window.partitionBy("oid").orderBy(*order(points))
    marked = points.withColumn("__new", F.coalesce(F.col(key) != F.lag(key).over(w), F.lit(True)).cast("int")).withColumn("seg", F.sum("__new").over(w))
    runs = marked.groupBy("oid", "seg", key).agg(F.min("t").alias("t1"), F.max("t").alias("last"), F.count("*").alias("n"))
    after = F.lead("t1").over(Window.partitionBy("oid").orderBy("seg"))
    return runs.select("oid", "seg", key, "t1", F.coalesce(after, "last").alias("t2"), "n")


def crop(segs: DataFrame, rear: float) -> DataFrame:
    """Segments of the window that begins at rear."""
    return segs.where(F.col("t2") >= rear).withColumn("t1", F.greatest("t1", F.lit(float(rear))))


def duration() -> Column:
    return F.col("t2") - F.col("t1") + 1


def cell_score(segs: DataFrame, cells: DataFrame) -> DataFrame:
    """By object, the sum of durations times the number of roads registered in the cell; cells: (cell, roads)."""
    return segs.join(cells, "cell", "left").groupBy("oid").agg(F.sum(F.coalesce("roads", F.lit(0)) * duration()).alias("score"))


def road_score(segs: DataFrame) -> DataFrame:
    """By object, the time on any road."""
    return segs.groupBy("oid").agg(F.sum(F.when(F.col("qid") != 0, duration()).otherwise(0.0)).alias("score"))


def decayed_score(segs: DataFrame, decay: bool = True) -> DataFrame:
    """By object, the share of its time on roads, newest segment first with weights 1/2, 1/4, ... if decay."""
    w = Window.partitionBy("oid")
    on_road = segs.where("qid <> 0").withColumn("d", duration())
    newest = F.row_number().over(w.orderBy(F.desc("seg")))
    weight = F.pow(F.lit(0.5), newest) if decay else F.lit(1.0)
    return on_road.withColumn("p", weight * F.col("d") / F.sum("d").over(w)).groupBy("oid").agg(F.sum("p").alias("score"))


def share_score(segs: DataFrame) -> DataFrame:
    """By object, the sum over its segments of its share of all time on that road."""
    on_road = segs.where("qid <> 0").groupBy("oid", "qid").agg(F.sum(duration()).alias("d"))
    total = on_road.groupBy("qid").agg(F.sum("d").alias("all"))
    return on_road.join(total, "qid").groupBy("oid").agg(F.sum(F.col("d") / F.col("all")).alias("score"))


def time_on_road(segs: DataFrame, objects: DataFrame, qid: int) -> DataFrame:
    """By object, the time on one road; -2 for none."""
    mine = segs.where(F.col("qid") == qid).groupBy("oid").agg(F.sum(duration()).alias("d"))
    return objects.join(mine, "oid", "left").select("oid", F.coalesce("d", F.lit(-2.0)).alias("seconds"))


def update_durations(segs: DataFrame, slide: int) -> DataFrame:
    """Each segment's part of the slide in which it ends: the gap to the segment before, capped to the slide."""
    tick = F.ceil(F.col("t2") / slide) * slide
    gap = F.col("t2") - F.lag("t2").over(Window.partitionBy("oid").orderBy("seg"))
    return segs.select("oid", "seg", "qid", F.when(gap <= slide, gap + 1).otherwise(F.col("t2") - (tick - slide) + 1).alias("slide_duration"))


def score_unselected(scores: DataFrame, selected: DataFrame) -> DataFrame:
    """Scores with -2 for objects that are selected already."""
    return scores.join(selected.select("oid", F.lit(True).alias("__s")), "oid", "left").select("oid", F.when(F.col("__s"), -2.0).otherwise(F.col("score")).alias("score"))
