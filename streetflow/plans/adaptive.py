"""Speed queries under load control, cycle by cycle: points come in, windows are evaluated, the load sets how many trajectories stay.

Only the choice of the trajectories is sequential: it stands on the last cycle's window and load, and decides which of the next
cycle's points enter. Each phase of a cycle is a distributed job over that cycle's points and the window's stored ones; the driver
holds a row of counts. What a run knows lies in its folder: the stored points by cycle, the kept ids, the results, a telemetry row for
each cycle and one small file of state, so that a run which stops goes on behind its last whole cycle.

Speeds come from the unfiltered stream. A dropped object's points that are stored already stay until they leave the window. An object
that appears under shedding enters with its first point and stays out until the next choice; scheme 3 lets it in or not, from the next
cycle on. When shedding ends, all objects count again. Under scheme 6, too, speeds are those of the unfiltered stream.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetflow.config import EngineConfig
from streetflow.operators import shedding, trajectory, windows
from streetflow.operators.controller import Controller
from streetflow.operators.joins import small
from streetflow.schemas import TELEMETRY
from streetflow.sources.files import with_rank
from streetflow.storage import get_text, put_text, shared_dir

STORED = "oid long, t double, qid int, v double, rn int"
ROWS = ", ".join(f"`{c}` {'double' if c in ('load', 'predicted', 'capacity', 'low', 'high') or c.endswith('_time') else 'boolean' if c == 'shed' else 'long'}" for c in TELEMETRY)


Cost = Callable[[dict], tuple[float, float, float]]


def work(unit: float) -> Cost:
    """A load that is the same at each run: the points processed, those held in the window, and the objects among which the cycle chose,
    in units of so many."""
    return lambda counts: (counts["processed"] / unit, counts["held"] / unit, counts["chosen"] / unit)


def annotated(points: DataFrame, roads: DataFrame, config: EngineConfig) -> DataFrame:
    """Points with what doesn't depend on shedding: number and speed within the object, and whether they are on a road."""
    known = trajectory.with_nearby(trajectory.speeds(points), roads, config).withColumn("inside", trajectory.is_inside())
    return with_cycle(known.select(*trajectory.order(points), "oid", "qid", "rn", "v", "inside"), config)


def with_cycle(points: DataFrame, config: EngineConfig) -> DataFrame:
    return points.withColumn("cycle", F.ceil(F.col("t") / config.period).cast("int"))


class Run:
    """The state of a run and its cycles' phases. cost gives the loads of update, evaluation and choice from a cycle's counts; without it
    they are the seconds that the phases took."""

    def __init__(self, spark: SparkSession, roads: DataFrame, config: EngineConfig, folder: str | None = None, cost: Cost | None = None):
        self.spark, self.roads, self.config, self.cost = spark, roads, config, cost
        self.folder = folder or shared_dir(spark)
        self.controller = Controller(config.capacity, config.band, config.period, config.loads, config.prediction, select=self.select)
        self.state = {"cycle": -1, "kept": None, "total": 0, "so_far": 0, "maintained": 0, "over": 0, "under": 0, "ls": 0.0}
        if saved := get_text(spark, f"{self.folder}/state.json"):
            self.state = json.loads(saved)
            self.controller.resume(self.state["controller"])

    def stored(self, first: int, last: int) -> DataFrame:
        points = self.spark.read.schema(f"{STORED}, cycle int").parquet(f"{self.folder}/stored")
        return points.where(F.col("cycle").between(first, last))

    def ids(self) -> DataFrame:
        """All objects so far; each has its first point stored."""
        return self.stored(0, self.at).where("rn = 1").select("oid").distinct()

    def kept(self) -> DataFrame | None:
        return None if self.state["kept"] is None else self.spark.read.schema("oid long").parquet(self.state["kept"])

    def keep(self, ids: DataFrame, step: str) -> None:
        path = f"{self.folder}/kept/{self.at:08d}-{step}"
        ids.select("oid").write.mode("overwrite").parquet(path)
        self.state["kept"] = path

    def window(self) -> DataFrame:
        """The stored points in the window that ends with this cycle's tick."""
        tick, c = self.at * self.config.period, self.config
        return self.stored(self.at - -(-c.range // c.period), self.at).where(F.col("t") >= tick - c.range)

    def select(self, n: int) -> int:
        """Chooses the n trajectories that stay."""
        scheme, ids = self.config.scheme, self.ids()
        if scheme == 6:
            return 1  # points are dropped as they come, not objects
        if scheme in (1, 2, 3):
            chosen = (shedding.first, shedding.smallest_ids, shedding.random)[scheme - 1](ids, n)
        elif scheme == 4:
            active = self.kept() or ids
            chosen = shedding.drop_random(ids, active, n) if self.controller.turn == "over" else shedding.top_up(ids, active, n)
        else:
            touched = self.window().where("qid <> 0 AND v IS NOT NULL").select("oid", "qid").distinct()
            policy = self.config.first_criterion
            chosen = shedding.sparse_first(ids, touched, n, shedding.few_objects_threshold(touched, policy)) if policy else shedding.semantic(ids, touched, n)
        self.keep(chosen, "chosen")
        return 1

    def update(self, came: DataFrame) -> dict:
        """Stores the points of the cycle that enter; the cycle's counts."""
        c, tick, kept = self.config, self.at * self.config.period, self.kept()
        if c.scheme == 6 and self.controller.active:
            place = F.col("rank") + self.state["so_far"]
            taken = trajectory.chance("event_id" if "event_id" in came.columns else "oid", 7) < 1.5 * self.controller.n / place
            came = with_rank(came, *trajectory.order(came)).withColumn("taken", taken)
        else:
            came = came.withColumn("taken", F.lit(True))
        if kept is not None:
            keep = kept.select("oid", F.lit(True).alias("keep"))
            came = came.join(small(keep), "oid", "left").withColumn("taken", (F.col("rn") == 1) | F.coalesce("keep", F.lit(False)))
        recent = F.countDistinct(F.when(F.col("t") > tick - c.slide, F.col("oid")))
        counts = came.agg(F.count("*").alias("tuples"), F.count(F.when(F.col("rn") == 1, 1)).alias("newbies"), F.count(F.when(F.col("taken"), 1)).alias("processed"), recent.alias("active")).first().asDict()
        if c.slide > c.period:
            came.groupBy("oid").agg(F.max("t").alias("t")).write.mode("overwrite").parquet(f"{self.folder}/seen/cycle={self.at}")
            seen = self.spark.read.schema("oid long, t double, cycle int").parquet(f"{self.folder}/seen").where(F.col("cycle").between(self.at - -(-c.slide // c.period), self.at))
            counts["active"] = seen.where(F.col("t") > tick - c.slide).select("oid").distinct().count()
        enters = (F.col("rn") == 1) | (F.col("inside") & (F.isnull("v") | (F.col("v") <= trajectory.MOST_SPEED)))
        came.where(F.col("taken") & enters).select("oid", "t", "qid", "v", F.col("rn").cast("int").alias("rn")).write.mode("overwrite").parquet(f"{self.folder}/stored/cycle={self.at}")
        if c.scheme == 3 and kept is not None and counts["newbies"]:
            new = came.where("rn = 1").select("oid", "t")
            self.keep(shedding.admit(new, kept, self.state["total"], self.controller.n), "admitted")
        return counts

    def evaluate(self) -> dict:
        """Writes the answers of the roads that report at this tick; the window's counts."""
        c, tick = self.config, self.at * self.config.period
        reach = self.stored(self.at - -(-c.range // c.period) - 1, self.at)
        inside, left = F.col("t") >= tick - c.range, F.col("t") >= tick - c.period - c.range
        profit = F.countDistinct(F.when(inside & F.col("v").isNotNull() & (F.col("qid") != 0), F.col("oid")))
        counts = reach.agg(F.count(F.when(inside, 1)).alias("held"), F.count(F.when(~inside & left, 1)).alias("evicted"), profit.alias("profitable")).first().asDict()
        means = self.window().where("v IS NOT NULL AND qid <> 0").groupBy("oid", F.col("qid").alias("road")).agg(F.avg("v").alias("m")).withColumn("tick", F.lit(tick).cast("long"))
        kind = "avg" if c.query_type == 1 else "max"
        windows.answers(self.roads, windows.road_speeds(means, self.roads, kind), tick, kind).write.mode("overwrite").parquet(f"{self.folder}/results/cycle={self.at}")
        return counts

    def step(self, cycle: int, came: DataFrame) -> None:
        """One cycle; came: its points with rn, v and inside. A cycle that the run has done already is left alone."""
        if cycle <= self.state["cycle"]:
            return
        c, s, self.at = self.config, self.state, cycle
        begun = time.perf_counter()
        counts = self.update(came)
        middle = time.perf_counter()
        counts |= self.evaluate()
        ended = time.perf_counter()
        up, ev = self.cost(counts | {"chosen": 0})[:2] if self.cost else (middle - begun, ended - middle)
        load, total = up + ev + s["ls"], s["total"] + counts["newbies"]
        used, shed = self.controller.n, ""
        if c.scheme:
            if self.controller.step(cycle * c.period, load, total) is None:
                s["kept"] = None
            shed = self.controller.turn
            used = total if used is None else used
        took = time.perf_counter() - ended
        ls = self.cost(counts | {"chosen": total if shed else 0})[2] if self.cost else took if c.scheme else 0.0
        s["over"], s["under"] = s["over"] + (shed == "over"), s["under"] + (shed == "under")
        s["maintained"] += counts["processed"] if c.scheme == 6 and self.controller.active else 0
        row = {
            "t": cycle * c.period, "load": load, "predicted": self.controller.ahead, "capacity": c.capacity, "low": c.capacity - c.band, "high": c.capacity + c.band,
            "active": counts["active"], "newbies": counts["newbies"], "profitable": counts["profitable"], "total": total, "used": used, "delta": abs(self.controller.delta),
            "next": self.controller.n, "processed": counts["processed"], "tuples": counts["tuples"], "so_far": s["so_far"], "maintained": s["maintained"],
            "evicted": counts["evicted"], "cycles_under": s["under"], "cycles_over": s["over"], "cycles_shed": s["over"] + s["under"], "cycles": cycle + 1,
            "shed": bool(shed), "answered": self.answered(), "up_time": up, "ev_time": ev, "ls_time": ls, "mil_up_time": 1000 * (middle - begun),
            "mil_ev_time": 1000 * (ended - middle), "mil_ls_time": 1000 * took, "loads": len(self.controller.history),
        }
        put_text(self.spark, f"{self.folder}/telemetry/{cycle:08d}.json", json.dumps(row))
        s |= {"cycle": cycle, "total": total, "so_far": s["so_far"] + counts["tuples"], "ls": ls, "controller": self.controller.state()}
        put_text(self.spark, f"{self.folder}/state.json", json.dumps(s))

    def answered(self) -> int:
        if not hasattr(self, "_roads"):
            self._roads = self.roads.select("qid").distinct().count()
        return self._roads

    def telemetry(self) -> DataFrame:
        """The columns of schemas.TELEMETRY, a row per cycle. so_far counts the points before the cycle."""
        return self.spark.read.schema(ROWS).json(f"{self.folder}/telemetry")

    def results(self) -> DataFrame:
        """(t, qid, speed, num_objects) at the reporting ticks."""
        return self.spark.read.schema("t long, qid int, speed double, num_objects long").parquet(f"{self.folder}/results")


def adaptive_query(points: DataFrame, roads: DataFrame, config: EngineConfig, cost: Cost | None = None, folder: str | None = None) -> Run:
    """A whole run over a finished stream."""
    spark = points.sparkSession
    run = Run(spark, roads, config, folder, cost)
    base = annotated(points, roads, config)
    schema = base.schema
    if run.state["cycle"] < 0:
        base.write.mode("overwrite").partitionBy("cycle").parquet(f"{run.folder}/base")
    base = spark.read.schema(schema).parquet(f"{run.folder}/base")
    last = windows.last_tick(points, config.period).first()["last"]
    for cycle in range(0, (last or 0) // config.period + 1):
        run.step(cycle, base.where(F.col("cycle") == cycle))
    return run
