"""The same queries on a stream: the last point of each object is keyed state, windows are built-in aggregations.

Two ways: declared as one streaming query (speeds, stored, road_speeds, reported), which answers roads with objects when the watermark has
passed a tick; or cycle by cycle in foreachBatch (adaptive), with zero fill and load control, whose state outlives a restart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from streetflow.config import EngineConfig
from streetflow.operators import trajectory, windows
from streetflow.operators.joins import small
from streetflow.plans.adaptive import Cost, Run, with_cycle

STATE = "t double, x double, y double"
SPEEDS = "oid long, t double, x double, y double, qid int, first boolean, v double, ts timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastPoint(StatefulProcessor):
    """Adds to each point its speed from the object's previous point; a first point has speed 0, no elapsed time none. Points of one
    time go in order of place. A point that is older than the object's last one is dropped, whatever the watermark would let in; with
    `expire` an object without a point for so many seconds is forgotten, and its next point is a first one."""

    def __init__(self, expire: float | None = None) -> None:
        self.expire = expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points = pd.concat(list(rows), ignore_index=True).sort_values(["t", "x", "y", "qid"], kind="stable")
        known = self.last.get() if self.last.exists() else None
        if known is not None:
            points = points[points.t >= known[0]]
        if points.empty:
            return
        prev = points[["t", "x", "y"]].shift(1)
        if known is not None:
            prev.iloc[0] = list(known)
        moved, passed = ((points.x - prev.x) ** 2 + (points.y - prev.y) ** 2) ** 0.5, points.t - prev.t
        v = (3.6 * moved / passed).where(passed != 0)
        first = prev.t.isna() | ((passed > self.expire) if self.expire is not None else False)
        end = points.iloc[-1]
        self.last.update((float(end.t), float(end.x), float(end.y)))
        if self.expire is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((end.t + self.expire) * 1000))
        yield points.assign(oid=key[0], first=first, v=v.where(~first, 0.0))[["oid", "t", "x", "y", "qid", "first", "v", "ts"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def speeds(points: DataFrame, late: str = "0 seconds", expire: float | None = None) -> DataFrame:
    """points: (t, oid, x, y, qid, ts) in order of time; rows later than the watermark are dropped, as are those older than their object's
    last point."""
    points.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return points.withWatermark("ts", late).groupBy("oid").transformWithStateInPandas(LastPoint(expire), SPEEDS, "append", "eventtime", eventTimeColumnName="ts")


def with_inside(with_speeds: DataFrame, roads: DataFrame, config: EngineConfig) -> DataFrame:
    """Points with rn, 1 for an object's first and else 2, and whether they are on a road."""
    rn = F.when(F.col("first"), 1).otherwise(2)
    return trajectory.with_nearby(with_speeds.withColumn("rn", rn), roads, config).withColumn("inside", trajectory.is_inside()).drop("nearby")


def stored(with_speeds: DataFrame, roads: DataFrame, config: EngineConfig) -> DataFrame:
    """The points that enter trajectories: as trajectory.stored, without shedding."""
    slow = F.isnull("v") | (F.col("v") <= trajectory.MOST_SPEED)
    return with_inside(with_speeds, roads, config).where(F.col("first") | (F.col("inside") & slow)).drop("rn", "inside")


def road_speeds(with_speeds: DataFrame, period: int, window: int, kind: str = "avg") -> DataFrame:
    """(tick, qid, speed, num_objects): mean, or largest, of the objects' means in [tick - window, tick]. The window's length has one
    microsecond more, which closes its right end; ticks appear once the watermark has passed them."""
    span = F.window("ts", f"{window} seconds 1 microsecond", f"{period} seconds")
    means = with_speeds.where("v IS NOT NULL AND qid <> 0").groupBy(span.alias("w"), "oid", "qid").agg(F.avg("v").alias("m"))
    speed = F.avg("m") if kind == "avg" else F.greatest(F.max("m"), F.lit(0.0))
    out = means.groupBy("w", "qid").agg(speed.alias("speed"), F.count("*").alias("num_objects"))
    return out.select((F.unix_micros(F.col("w.start")) / 1e6 + window).cast("long").alias("tick"), "qid", "speed", "num_objects")


def reported(speeds_: DataFrame, roads: DataFrame, kind: str = "avg") -> DataFrame:
    """(t, qid, speed, num_objects) of the registered roads with objects, at the ticks at which they report."""
    out = speeds_.join(small(windows.own_times(roads), roads), "qid").where(windows.reports(roads))
    low = F.col("speed") * F.col("num_objects") <= 0.001 if kind == "avg" else F.lit(False)
    return out.select(F.col("tick").alias("t"), "qid", F.when(low, -1.0).otherwise(F.col("speed")).alias("speed"), "num_objects")


def adaptive(points: DataFrame, roads: DataFrame, config: EngineConfig, folder: str, cost: Cost | None = None, late: str = "0 seconds") -> tuple[DataStreamWriter, Callable[[], Run]]:
    """A stream under load control: a writer to be started, and a function that finishes the run when the stream has ended.

    Speeds are keyed state on the unfiltered stream. Each micro-batch is written to the run's folder; every cycle whose end the stream
    has passed is then one step of plans.adaptive.Run over its points. A batch that comes again overwrites its own files, and cycles
    done already are left alone, so a restart from the checkpoint goes on as if nothing had happened.
    """
    spark = points.sparkSession
    run = Run(spark, roads, config, folder, cost)
    rows = with_cycle(with_inside(speeds(points, late), roads, config), config).select("t", "oid", "qid", "rn", "v", "inside", "cycle")
    schema = rows.schema

    def base() -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/base")

    def steps(end: int) -> None:
        for cycle in range(run.state["cycle"] + 1, end):
            run.step(cycle, base().where(F.col("cycle") == cycle))

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/base/batch-{number}")
        newest = base().agg(F.max("cycle")).first()[0]
        if newest is not None:
            steps(newest)

    def finish() -> Run:
        newest = base().agg(F.max("cycle")).first()[0]
        steps((newest or 0) + 1)
        return run

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint"), finish
