"""Whole queries: speeds by road over sliding windows, with or without shedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetflow.config import EngineConfig
from streetflow.operators import trajectory, windows


def speed_query(points: DataFrame, roads: DataFrame, config: EngineConfig | None = None, kind: str = "avg", zero_fill: bool = True, kept: DataFrame | None = None, mode: str = "label") -> DataFrame:
    """(t, qid, speed, num_objects) at the reporting ticks.

    mode "label" takes the roads that the stream says, "assigned" those of the polygons; a first point keeps its label in both. With
    `kept` (cycle, oid), points of objects that were not kept don't enter, while points already in a window stay.
    """
    config = config or EngineConfig()
    own = trajectory.stored(points, roads, config, kept)
    if mode == "assigned":
        own = trajectory.assign_roads(own, roads, config).withColumn("qid", F.when(F.col("rn") == 1, F.col("qid")).otherwise(F.coalesce("road", F.lit(0))))
    if config.global_window:
        means = windows.object_means(own, config.period, config.range, stream=points)
    else:
        means = windows.own_windows(own, roads, config.period, stream=points)
    return windows.report(roads, points=points, speeds=windows.road_speeds(means, roads, kind), period=config.period, zero_fill=zero_fill, kind=kind)
