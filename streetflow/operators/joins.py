"""Joins that choose their way by a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a narrow table that may be sent to every executor
BROADCAST_ROWS = 500_000
#: vertices of polygons that may be
BROADCAST_VERTICES = 2_000_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most `most` rows; counted once for the same DataFrame."""
    known = df.__dict__.setdefault("_streetflow_few", {})
    if most not in known:
        known[most] = df.limit(most + 1).count() <= most
    return known[most]


def small(df: DataFrame, of: DataFrame | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it, or the table `of` that has no fewer rows, has at most `most`; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if few(df if of is None else of, most) else df


def range_join(points: DataFrame, boxes: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """Points and the boxes (x_min, y_min, x_max, y_max) that hold them, by an equi-join on squares of the given size."""
    at = lambda c: F.floor(F.col(c) / size)
    tiled = boxes.withColumn("__i", F.explode(F.sequence(at("x_min"), at("x_max")))).withColumn("__j", F.explode(F.sequence(at("y_min"), at("y_max"))))
    placed = points.withColumn("__i", at(x)).withColumn("__j", at(y))
    inside = F.col(x).between(F.col("x_min"), F.col("x_max")) & F.col(y).between(F.col("y_min"), F.col("y_max"))
    return placed.join(small(tiled), ["__i", "__j"]).where(inside).drop("__i", "__j")
