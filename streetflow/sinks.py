"""Outputs: result rows, telemetry, id lists and replicated streams as text, tables, and printed views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streetflow.config import EngineConfig
from streetflow.functions.geometry import cell_of, ring_text
from streetflow.operators.trajectory import latest, road_cells
from streetflow.schemas import TELEMETRY


def six_digits(c: Column) -> Column:
    """A double as text with six significant digits and no zeros at the end; beyond 1e-4 and 1e6 with an exponent."""
    short, size = F.format_string("%.5e", c), F.abs(c)
    plain = F.regexp_replace(F.format_string("%.10f", short.cast("double")), r"[.]?0+$", "")
    wide = (size != 0) & ((size < 1e-4) | (short.cast("double") >= 1e6) | (short.cast("double") <= -1e6))
    return F.when(wide, F.regexp_replace(short, r"[.]?0*e", "e")).otherwise(plain)


def write_results(results: DataFrame, path: str) -> None:
    results.select("t", "qid", six_digits(F.col("speed")).alias("speed"), "num_objects").write.mode("overwrite").csv(path)


def write_telemetry(rows: DataFrame, path: str) -> None:
    """With the header of the run's own 31 columns where rows are those of an adaptive run."""
    if set(TELEMETRY) <= set(rows.columns):
        rows = rows.orderBy("t").coalesce(1).select(*[F.col(c).alias(name) for c, name in TELEMETRY.items()])  # a row per cycle
    rows.write.mode("overwrite").option("header", True).csv(path, sep=";")


def summary(rows: DataFrame) -> DataFrame:
    """rows: update_s, eval_s, shed_s, load by cycle. Means, each phase's share in percent, and the largest load."""
    total = F.avg("update_s") + F.avg("eval_s") + F.avg("shed_s")
    phases = [c for n in ("update_s", "eval_s", "shed_s") for c in (F.avg(n).alias(f"avg_{n}"), F.try_divide(100 * F.avg(n), total).alias(f"share_{n}"))]
    return rows.agg(*phases, F.max("load").alias("max_load"))


def final_summary(rows: DataFrame, points: DataFrame) -> DataFrame:
    """One row at the end of a run: summary of its telemetry, and of its points (v, qid, road) how many speeds aren't defined and the
    percentage of points on a road whose label is that road."""
    of_points = points.agg(F.count(F.when(F.col("v").isNull(), 1)).alias("not_a_number"), F.try_divide(100 * F.count(F.when(F.col("road") == F.col("qid"), 1)), F.count("road")).alias("pip_correctness"))
    named = rows.select(F.col("up_time").alias("update_s"), F.col("ev_time").alias("eval_s"), F.col("ls_time").alias("shed_s"), F.col("load"))
    return summary(named).join(F.broadcast(of_points))


def write_stream_text(points: DataFrame, path: str) -> None:
    """t oid x y qid with eight decimals, separated by spaces."""
    number = lambda c: F.format_string("%.8f", F.col(c))
    points.select(number("t"), "oid", number("x"), number("y"), "qid").write.mode("overwrite").csv(path, sep=" ")


def write_ids(ids: DataFrame, path: str) -> None:
    ids.write.mode("overwrite").csv(path, sep=" ")


def save_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """A table of the catalog, in place of one of that name; with `path` its files lie there."""
    df.write.mode("overwrite").options(**({"path": path} if path else {})).saveAsTable(name)


# views to be read by people


def printed(roads: DataFrame) -> DataFrame:
    """Roads with their rings as text."""
    return roads.select("qid", ring_text(F.col("ring")).alias("ring"))


def printed_points(points: DataFrame) -> DataFrame:
    """(oid, t, line) of each point."""
    line = F.concat(F.lit("<"), F.concat_ws(", ", six_digits(F.col("t")), F.col("oid").cast("string"), six_digits(F.col("x")), six_digits(F.col("y"))), F.lit(">"))
    return points.select("oid", "t", line.alias("line"))


def printed_cells(points: DataFrame, config: EngineConfig) -> DataFrame:
    """(cell, oids): the objects whose last point is in a cell, in order."""
    placed = latest(points.withColumn("cell", cell_of(F.col("x"), F.col("y"), config.universe, config.gran_x, config.gran_y)), "cell")
    return placed.where("cell IS NOT NULL").groupBy("cell").agg(F.array_join(F.sort_array(F.collect_list("oid")).cast("array<string>"), ", ").alias("oids"))


def printed_cell_roads(roads: DataFrame, config: EngineConfig, more_than: int = 5) -> DataFrame:
    """(cell, roads): the crowded cells and how many roads are registered there."""
    return road_cells(roads, config).groupBy("cell").agg(F.countDistinct("qid").alias("roads")).where(F.col("roads") > more_than)


def printed_trajectories(points: DataFrame) -> DataFrame:
    """(oid, line): an object's roads and whole seconds in order of time; a line grows with its trajectory."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("t", "qid"))), lambda p: F.concat(F.lit("("), p["qid"].cast("string"), F.lit(" "), F.floor(p["t"]).cast("string"), F.lit(")")))
    return points.groupBy("oid").agg(F.concat(F.lit("{"), F.array_join(steps, " -> "), F.lit("}")).alias("line"))


def printed_synopses(segments: DataFrame, key: str) -> DataFrame:
    """(oid, line): an object's segments by road or cell, in order."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("seg", F.col(key).alias("k"), "t1", "t2"))), lambda s: F.concat(F.lit("("), s["k"].cast("string"), F.lit(")["), six_digits(s["t1"]), F.lit(", "), six_digits(s["t2"]), F.lit("]")))
    return segments.groupBy("oid").agg(F.array_join(steps, "--->").alias("line"))
