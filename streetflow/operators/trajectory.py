"""From points to speeds and roads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetflow.config import EngineConfig
from streetflow.functions import geometry as G
from streetflow.operators.joins import BROADCAST_VERTICES, small
from streetflow.sources.files import with_rank

MOST_SPEED = 130.0


def order(points: DataFrame) -> list[str]:
    return ["t", *(c for c in ("event_id",) if c in points.columns)]


def with_previous(points: DataFrame) -> DataFrame:
    """Each point's number within its object, and the object's previous raw point; this must see the unfiltered stream."""
    w = Window.partitionBy("oid").orderBy(*order(points))
    return points.withColumns({"rn": F.row_number().over(w)} | {f"prev_{c}": F.lag(c).over(w) for c in ("t", "x", "y")})


def speed(first: Column | float = 0.0) -> Column:
    """km/h from the previous raw point; a first point has the speed `first`, no elapsed time gives null."""
    moved = G.distance(F.col("x"), F.col("y"), F.col("prev_x"), F.col("prev_y"))
    return F.when(F.col("rn") == 1, first if isinstance(first, Column) else F.lit(first)).otherwise(3.6 * F.try_divide(moved, F.col("t") - F.col("prev_t")))


def speeds(points: DataFrame) -> DataFrame:
    return with_previous(points).withColumn("v", speed())


def with_first_speed_of_second(points: DataFrame) -> DataFrame:
    """The older rule: a first point takes the speed of the object's second."""
    s = speeds(points)
    return s.withColumn("v", F.when(F.col("rn") == 1, F.coalesce(F.lead("v").over(Window.partitionBy("oid").orderBy(*order(points))), F.lit(0.0))).otherwise(F.col("v")))


def road_cells(roads: DataFrame, config: EngineConfig) -> DataFrame:
    """Each road in every cell that its bounding box overlaps; all segments of a road are kept."""
    cells = G.cells_of(G.box_of(F.col("ring")), config.universe, config.gran_x, config.gran_y)
    return roads.withColumn("cell", F.explode(cells))


def candidates(points: DataFrame, roads: DataFrame, config: EngineConfig) -> DataFrame:
    """Points with each road that contains them: cells first, then the polygon. Points outside the universe are on no road."""
    cells = road_cells(roads.select(F.col("qid").alias("road"), F.col("start").alias("road_start"), F.col("end").alias("road_end"), "ring"), config)
    placed = points.withColumn("cell", G.cell_of(F.col("x"), F.col("y"), config.universe, config.gran_x, config.gran_y))
    return placed.join(small(cells), "cell").where(G.in_polygon(F.col("ring"), F.col("x"), F.col("y"))).drop("ring", "cell")


def with_nearby(points: DataFrame, roads: DataFrame, config: EngineConfig) -> DataFrame:
    """Each point once, with the array `nearby` of the roads (qid, start, end, ring) whose boxes overlap its cell; null for none. The
    cells' arrays go to every executor up to a checked number of vertices; beyond, points are shuffled by cell and crowded cells split."""
    cells = road_cells(roads.select("qid", "start", "end", "ring"), config)
    vertices = cells.agg(F.coalesce(F.sum(F.size("ring")), F.lit(0))).first()[0]
    arrays = cells.groupBy(F.col("cell").alias("__cell")).agg(F.collect_list(F.struct("qid", "start", "end", "ring")).alias("nearby"))
    placed = points.withColumn("__cell", G.cell_of(F.col("x"), F.col("y"), config.universe, config.gran_x, config.gran_y))
    return placed.join(F.broadcast(arrays) if vertices <= BROADCAST_VERTICES else arrays, "__cell", "left").drop("__cell")


def holds(road: Column) -> Column:
    return G.in_polygon(road["ring"], F.col("x"), F.col("y"))


def is_inside() -> Column:
    """Whether one of the nearby roads holds the point."""
    return F.coalesce(F.exists("nearby", holds), F.lit(False))


def heading_cost(road: Column) -> Column:
    """1 - cosine between a road's direction and the move from the previous point; a point that doesn't move has cost 1."""
    rx, ry = road["end"]["x"] - road["start"]["x"], road["end"]["y"] - road["start"]["y"]
    return 1 - F.coalesce(G.heading_cosine(rx, ry, F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y")), F.lit(0.0))


def assign_roads(points: DataFrame, roads: DataFrame, config: EngineConfig) -> DataFrame:
    """road: of the roads that contain a point the one whose heading is closest, the smaller id of equal ones; null on no road."""
    costs = F.transform(F.filter("nearby", holds), lambda r: F.struct(F.round(heading_cost(r), 9).alias("cost"), r["qid"].alias("qid")))
    return with_nearby(points, roads, config).withColumn("road", F.array_min(costs)["qid"]).drop("nearby")


def processed(points: DataFrame, kept: DataFrame, config: EngineConfig) -> DataFrame:
    """Of points with their number rn those that aren't shed: an object's first, and those of objects kept (cycle, oid) at the end of the cycle before."""
    out = points.withColumn("__before", F.ceil(F.col("t") / config.period) * config.period - config.period)
    keep = kept.select(F.col("cycle").alias("__before"), "oid", F.lit(True).alias("__keep"))
    return out.join(small(keep), ["__before", "oid"], "left").where("rn = 1 OR __keep").drop("__before", "__keep")


def enters() -> Column:
    """Whether a point with rn, v and nearby roads enters its trajectory: an object's first always, later ones on a road and not too fast."""
    return (F.col("rn") == 1) | (is_inside() & (F.isnull("v") | (F.col("v") <= MOST_SPEED)))


def stored(points: DataFrame, roads: DataFrame, config: EngineConfig, kept: DataFrame | None = None) -> DataFrame:
    """The points that enter the trajectories: an object's first point always; later ones if inside an active road and not above the
    highest speed, and, with a history kept (cycle, oid), if the object was kept at the end of the cycle before."""
    out = with_nearby(speeds(points), roads, config).where(enters()).drop("nearby")
    return out if kept is None else processed(out, kept, config)


def chance(key: str, seed: int) -> Column:
    """A number in [0, 1) for each id, the same on every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def tuples_shed(points: DataFrame, n: int, factor: float = 1.5, seed: int = 7) -> DataFrame:
    """Tuple-level shedding: of the first m points the m-th is taken with probability factor * n / m."""
    return with_rank(points, *order(points)).where(chance("event_id", seed) < factor * n / F.col("rank")).drop("rank")


def nested(points: DataFrame) -> DataFrame:
    """Trajectories as arrays in order of time."""
    return points.groupBy("oid").agg(F.array_sort(F.collect_list(F.struct("t", "x", "y", "v", "qid"))).alias("points"))


def lengths(points: DataFrame) -> DataFrame:
    """By object: number of points and metres travelled."""
    step = G.distance(F.col("x"), F.col("y"), F.col("prev_x"), F.col("prev_y"))
    return with_previous(points).groupBy("oid").agg(F.count("*").alias("points"), F.coalesce(F.sum(step), F.lit(0.0)).alias("distance"))


def latest(points: DataFrame, *columns: str) -> DataFrame:
    """Each object's last point; a combinable aggregate, so no window over the whole object is needed."""
    last = F.struct(*order(points))
    return points.groupBy("oid").agg(*[F.max_by(c, last).alias(c) for c in columns])
