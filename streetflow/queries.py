"""The registered queries of the traffic engine and, for each that SQL can express, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streetflow.config import ATHENS, EngineConfig
from streetflow.functions import geometry as G
from streetflow.operators import accuracy, controller, joins, segments, sets, shedding, sketches, trajectory, windows
from streetflow import schemas, sinks
from streetflow.plans import adaptive
from streetflow.plans.speeds import speed_query
from streetflow.sources import files, generators, tables
from streetflow.storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CONFIG = EngineConfig()
PERIOD, RANGE, SLIDE = CONFIG.period, CONFIG.range, CONFIG.slide

BASE = """
WITH RECURSIVE ev AS (SELECT event_id, user_id AS oid, (epoch_us(ts) - 1704067200000000) / 1e6::DOUBLE AS t, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events),
loc AS (SELECT event_id, oid, t, 450000 + 80 * value AS x, 4175000 + 500 * k AS y, CAST((oid + CAST(k AS INT)) % 26 AS INT) AS qid FROM ev),
sp0 AS (SELECT *, row_number() OVER w AS rn, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py FROM loc WINDOW w AS (PARTITION BY oid ORDER BY t, event_id)),
sp AS (SELECT *, CASE WHEN rn = 1 THEN 0.0::DOUBLE WHEN t = pt THEN NULL ELSE 3.6 * sqrt((x - px) * (x - px) + (y - py) * (y - py)) / (t - pt) END AS v FROM sp0),
road AS (SELECT CAST(n_nationkey + 1 AS INT) AS qid, n_regionkey AS cid, 450000::DOUBLE + 10000 * (n_nationkey % 5) AS cx, 4175000::DOUBLE + 10000 * floor(n_nationkey / 5) AS cy FROM nation),
act AS (SELECT * FROM road WHERE cid <> 3),
edge AS (SELECT qid, cx + unnest([500, 9500, 8500, 1500]) AS x1, cy + unnest([500, 500, 9500, 9500]) AS y1, cx + unnest([1500, 500, 9500, 8500]) AS x2, cy + unnest([9500, 500, 500, 9500]) AS y2 FROM road),
pip AS (SELECT event_id, e.qid AS road FROM loc, edge e GROUP BY event_id, e.qid
  HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1 THEN 1 ELSE 0 END) % 2 = 1),
sto AS (SELECT * FROM sp WHERE rn = 1 OR (event_id IN (SELECT event_id FROM pip WHERE road IN (SELECT qid FROM act)) AND (v IS NULL OR v <= 130))),
lastk AS (SELECT CAST(max(ceil(t / 21600)) AS BIGINT) AS k FROM loc),
tk AS (SELECT *, unnest(range(CAST(ceil(t / 21600) AS BIGINT), least(CAST(floor((t + 86400) / 21600) AS BIGINT), (SELECT max(ceil(t / 21600))::BIGINT FROM sto)) + 1)) * 21600 AS tick FROM sto),
om AS (SELECT tick, oid, qid AS road, avg(v) AS m, count(*) AS n FROM tk WHERE v IS NOT NULL AND qid <> 0 GROUP BY ALL),
tch AS (SELECT DISTINCT oid, qid FROM sto WHERE qid <> 0),
ids AS (SELECT DISTINCT oid FROM loc),
seg0 AS (SELECT *, CASE WHEN qid = lag(qid) OVER (PARTITION BY oid ORDER BY t, event_id) THEN 0 ELSE 1 END AS new FROM loc),
seg1 AS (SELECT *, sum(new) OVER (PARTITION BY oid ORDER BY t, event_id) AS seg FROM seg0),
seg2 AS (SELECT oid, CAST(seg AS BIGINT) AS seg, qid, min(t) AS t1, max(t) AS last, count(*) AS n FROM seg1 GROUP BY ALL),
seg AS (SELECT oid, seg, qid, t1, coalesce(lead(t1) OVER (PARTITION BY oid ORDER BY seg), last) AS t2, n FROM seg2),
cel AS (SELECT *, CASE WHEN x >= 450000 AND x < 500000 AND y >= 4175000 AND y < 4225000 THEN CAST(50 * floor((y - 4175000) / 1000) + floor((x - 450000) / 1000) AS BIGINT) END AS cell FROM loc),
ax AS (SELECT CAST(s_nationkey + 1 AS INT) AS qid, CAST(300 * (1 + n_regionkey % 4) AS INT) AS win_range, CAST(30 * (1 + n_regionkey % 4) AS INT) AS win_slide, CAST(1 + n_regionkey % 4 AS INT) AS category, abs(s_acctbal) / 10 AS length FROM supplier JOIN nation ON s_nationkey = n_nationkey),
kept AS (SELECT oid FROM ids ORDER BY md5(concat(CAST(oid AS VARCHAR), '|7')), oid LIMIT 100),
grid AS (SELECT unnest(range(0, (SELECT k FROM lastk) + 1)) * 21600 AS tick),
rs AS (SELECT tick, road AS qid, avg(m) AS speed, max(m) AS top, count(*) AS num FROM om WHERE road IN (SELECT qid FROM act) GROUP BY ALL),
rep AS (SELECT g.tick AS t, a.qid, coalesce(num, 0) AS num_objects, CASE WHEN coalesce(num, 0) = 0 OR speed * num <= 0.001 THEN -1 ELSE speed END AS speed, CASE WHEN coalesce(num, 0) = 0 THEN -1 ELSE greatest(top, 0) END AS top
  FROM grid g CROSS JOIN act a LEFT JOIN rs ON rs.tick = g.tick AND rs.qid = a.qid WHERE g.tick >= 86400),
shedom AS (SELECT * FROM om WHERE oid IN (SELECT oid FROM kept)),
shedrs AS (SELECT tick AS t, road AS qid, avg(m) AS speed, count(*) AS num FROM shedom WHERE road IN (SELECT qid FROM act) GROUP BY ALL),
fullrs AS (SELECT tick AS t, qid, speed FROM rs),
dif AS (SELECT t, qid, abs(a.speed - b.speed) AS diff, abs(a.speed - b.speed) / nullif(b.speed, 0) AS relative FROM shedrs a JOIN fullrs b USING (t, qid) WHERE a.speed >= 0 AND b.speed >= 0)
"""


def query(oracle: str | None = None, base: bool = True):
    """Registers a query under its function's name; the oracle's SELECT stands on BASE."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = (BASE if base else "") + oracle
        return f

    return add


def r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def pts(spark, d):
    return tables.locations(spark, d)


def act(spark, d):
    return tables.roads(spark, d).join(tables.active(spark, d), "qid", "left_semi")


def stored(spark, d):
    return trajectory.stored(pts(spark, d), act(spark, d), CONFIG)


def touched(spark, d):
    return stored(spark, d).where("qid <> 0").select("oid", "qid").distinct()


def ids(spark, d):
    return pts(spark, d).select("oid").distinct()


def road_segs(spark, d):
    return segments.segments(pts(spark, d), "qid")


def with_cells(spark, d):
    return pts(spark, d).withColumn("cell", G.cell_of(F.col("x"), F.col("y"), ATHENS, 50, 50))


def means(spark, d):
    return windows.object_means(stored(spark, d), PERIOD, RANGE, stream=pts(spark, d))


def speeds_of(m, roads):
    return windows.road_speeds(m, roads).select(F.col("tick").alias("t"), "qid", "speed", "num_objects")


def result_pair(spark, d):
    """The exhaustive result and that of a fixed random hundred objects."""
    m, roads = means(spark, d), act(spark, d)
    kept = shedding.random(ids(spark, d), 100)
    return speeds_of(m.join(joins.small(kept), "oid", "left_semi"), roads), speeds_of(m, roads)


def constant_history(p, kept):
    """A history in which the same ids stay all the time: its rows are the cycles times the ids."""
    cycles = windows.last_tick(p, PERIOD).select(F.explode(F.sequence(F.lit(-PERIOD).cast("long"), F.col("last"), F.lit(PERIOD).cast("long"))).alias("cycle"))
    return cycles.join(joins.small(kept))


def diffs(spark, d):
    return accuracy.differences(*result_pair(spark, d))


# the flagship


@query("SELECT CAST(t AS BIGINT) AS t, qid, round(speed, 6) AS speed, num_objects FROM rep")
def avg_speed(spark, d):
    return speed_query(pts(spark, d), act(spark, d)).select("t", "qid", r("speed").alias("speed"), "num_objects")


@query("SELECT CAST(t AS BIGINT) AS t, qid, round(top, 6) AS speed, num_objects FROM rep")
def max_speed(spark, d):
    return speed_query(pts(spark, d), act(spark, d), kind="max").select("t", "qid", r("speed").alias("speed"), "num_objects")


@query("SELECT CAST(t AS BIGINT) AS t, qid, round(speed, 6) AS speed, num_objects FROM rep WHERE num_objects > 0")
def avg_speed_without_zero_fill(spark, d):
    return speed_query(pts(spark, d), act(spark, d), zero_fill=False).select("t", "qid", r("speed").alias("speed"), "num_objects")


@query("""SELECT CAST(tick AS BIGINT) AS t, CAST(qid AS INT) AS qid, round(CASE WHEN avg(m) * count(*) <= 0.001 THEN -1 ELSE avg(m) END, 6) AS speed, count(*) AS num_objects FROM (
  SELECT tick, oid, road AS qid, avg(v) AS m FROM (SELECT s.oid, s.v, s.qid AS road, h, unnest(range(CAST(ceil(t / 21600) AS BIGINT), least(CAST(floor((t + h) / 21600) AS BIGINT), (SELECT max(ceil(t / 21600))::BIGINT FROM sto)) + 1)) * 21600 AS tick
    FROM sto s JOIN (SELECT qid, 43200 * (1 + cid % 2) AS h FROM act) a ON a.qid = s.qid WHERE v IS NOT NULL) GROUP BY ALL)
  JOIN (SELECT qid AS q, 43200 * (1 + cid % 2) AS h, 21600 * (1 + cid % 2) AS s FROM act) ON q = qid WHERE tick >= h AND tick % s = 0 GROUP BY ALL""")
def avg_speed_own_windows(spark, d):
    roads = tables.roads(spark, d, global_window=False).join(tables.active(spark, d), "qid", "left_semi")
    c = EngineConfig(global_window=False)
    return speed_query(pts(spark, d), roads, c, zero_fill=False).select("t", "qid", r("speed").alias("speed"), "num_objects")


@query("""SELECT CAST(t AS BIGINT) AS t, qid, round(speed, 6) AS speed, num_objects FROM (
  SELECT tick AS t, road AS qid, avg(m) AS speed, count(*) AS num_objects FROM (SELECT tick, oid, qid AS road, avg(v) AS m FROM tk WHERE v IS NOT NULL AND qid <> 0
    AND (rn = 1 OR oid IN (SELECT oid FROM kept)) GROUP BY ALL) WHERE road IN (SELECT qid FROM act) GROUP BY ALL) WHERE t >= 86400 AND speed * num_objects > 0.001""")
def avg_speed_with_kept_history(spark, d):
    p = pts(spark, d)
    kept = shedding.random(ids(spark, d), 100)
    return speed_query(p, act(spark, d), zero_fill=False, kept=constant_history(p, kept)).where("speed >= 0").select("t", "qid", r("speed").alias("speed"), "num_objects")


@query("""SELECT CAST(tick AS BIGINT) AS t, CAST(road AS INT) AS qid, round(CASE WHEN avg(m) * count(*) <= 0.001 THEN -1 ELSE avg(m) END, 6) AS speed, count(*) AS num_objects FROM (
  SELECT tick, oid, road, avg(v) AS m FROM (SELECT s.*, CASE WHEN rn = 1 THEN s.qid ELSE p.road END AS road FROM tk s LEFT JOIN (SELECT * FROM pip WHERE road IN (SELECT qid FROM act)) p USING (event_id))
  WHERE v IS NOT NULL AND road IN (SELECT qid FROM act) GROUP BY ALL) WHERE tick >= 86400 GROUP BY ALL""")
def avg_speed_assigned(spark, d):
    """The roads of the polygons, not of the labels."""
    return speed_query(pts(spark, d), act(spark, d), zero_fill=False, mode="assigned").select("t", "qid", r("speed").alias("speed"), "num_objects")


def adaptive_run(spark, d):
    """Cycles of five days, windows of ten; the load is work, so that runs are alike; more of it comes than is wanted."""
    p = pts(spark, d)
    config = EngineConfig(period=432_000, slide=432_000, range=864_000, scheme=5, capacity_percent=60, loads=3)
    roads = act(spark, d).withColumn("range", F.lit(864_000).cast("long")).withColumn("slide", F.lit(432_000).cast("long"))
    return adaptive.adaptive_query(p, roads, config, adaptive.work(0.4 * p.count()))


@query()
def adaptive_telemetry(spark, d):
    """Tested against a plain fold: the choice of each cycle stands on the window of the one before."""
    return adaptive_run(spark, d).telemetry().drop("mil_up_time", "mil_ev_time", "mil_ls_time")


@query()
def adaptive_speeds(spark, d):
    return adaptive_run(spark, d).results()


# sources and sinks


@query("SELECT event_id, oid, round(t, 6) AS t, round(x, 4) AS x, round(y, 4) AS y, qid FROM loc")
def src1_locations(spark, d):
    return pts(spark, d).select("event_id", "oid", r("t").alias("t"), r("x", 4).alias("x"), r("y", 4).alias("y"), "qid")


@query("SELECT CAST(ceil(t / 21600) * 21600 AS BIGINT) AS cycle, count(*) AS n FROM loc GROUP BY ALL")
def src2_event_time_cycles(spark, d):
    return files.by_event_time(pts(spark, d), PERIOD).groupBy(F.col("cycle").cast("long").alias("cycle")).agg(F.count("*").alias("n"))


@query("SELECT CAST((row_number() OVER (ORDER BY t, event_id) - 1) // 700 AS BIGINT) AS cycle, event_id FROM loc")
def src3_arrival_cycles(spark, d):
    return files.by_arrival(pts(spark, d), 700, "t", "event_id").select("cycle", "event_id")


def text_of(spark, write, *args):
    """Writes text to a new folder, by a sink; its path."""
    path = shared_dir(spark)
    write(*args, path)
    return path


@query("SELECT oid, round(t, 6) AS t, round(x, 4) AS x, round(y, 4) AS y, qid FROM loc")
def src1_snk4_text_stream(spark, d):
    """The stream written as text and read back."""
    p = files.locations(spark, text_of(spark, sinks.write_stream_text, pts(spark, d)))
    return p.select("oid", r("t").alias("t"), r("x", 4).alias("x"), r("y", 4).alias("y"), "qid")


@query("SELECT qid FROM act")
def src8_snk5_text_ids(spark, d):
    return files.active_ids(spark, text_of(spark, sinks.write_ids, tables.active(spark, d)))


@query("SELECT n_nationkey AS segment_id, CAST(n_regionkey + 1 AS INT) AS class_id, 1000 + n_nationkey AS osm_id, n_name AS name FROM nation", base=False)
def src10_road_segments(spark, d):
    n = tables.read(spark, d, "nation").select("n_nationkey", F.col("n_regionkey") + 1, 1000 + F.col("n_nationkey"), "n_name")
    return files.road_segments(spark, text_of(spark, lambda df, path: df.write.csv(path), n))


@query("SELECT CAST(n_nationkey + 1 AS INT) AS qid, 1000 + n_nationkey AS osm_id, CASE WHEN n_regionkey > 1 THEN n_name END AS name, CAST(n_regionkey + 1 AS INT) AS class_id FROM nation", base=False)
def src10_buffers(spark, d):
    n = tables.read(spark, d, "nation").select(F.col("n_nationkey") + 1, 1000 + F.col("n_nationkey"), F.when(F.col("n_regionkey") > 1, F.col("n_name")), F.col("n_regionkey") + 1)
    return files.buffers(spark, text_of(spark, lambda df, path: df.write.csv(path, emptyValue=""), n))


SIX = "CASE WHEN abs({0}) < 10 THEN 5 WHEN abs({0}) < 100 THEN 4 ELSE 3 END"


@query(f"SELECT CAST(t AS BIGINT) AS t, qid, round(speed, {SIX.format('speed')}) AS speed, num_objects FROM rep")
def snk1_src11_text_results(spark, d):
    """The answers as text, read back. The sink writes six significant digits; of speeds below 1 the SQL wants five decimals, which are fewer,
    so the speeds are rounded as there before they are written: rounded after, a digit could differ."""
    speed = F.when(F.abs("speed") < 10, r("speed", 5)).when(F.abs("speed") < 100, r("speed", 4)).otherwise(r("speed", 3))
    answers = speed_query(pts(spark, d), act(spark, d)).withColumn("speed", speed)
    return files.results(spark, text_of(spark, sinks.write_results, answers))


@query("SELECT qid, win_range, win_slide, category, round(length, 4) AS length FROM ax")
def src12_text_axes(spark, d):
    text = lambda df, path: df.write.csv(path, sep=" ", header=True)
    return files.axes(spark, text_of(spark, text, tables.axes(spark, d))).select("qid", "win_range", "win_slide", "category", r("length", 4).alias("length"))


@query("SELECT * FROM (VALUES ('gran_x', '40'), ('capacity', '8.0'), ('band', '0.5'), ('scheme', '3'), ('range', '900'), ('global_window', 'False'), ('universe', '(1757000.0, 4608800.0, 1822000.0, 4673800.0)')) v(name, value)", base=False)
def src13_parameters(spark, d):
    c = EngineConfig.parse("VALID 1 10 o 2 q a 1 0 40 50 10 80 3 5 1 5 0 900 60 60 1 2 0".split())
    return spark.createDataFrame([(n, str(getattr(c, n))) for n in ("gran_x", "capacity", "band", "scheme", "range", "global_window", "universe")], "name string, value string")


@query("SELECT qid FROM act")
def snk6_snk7_saved_table(spark, d):
    """A table that is replaced: first all roads, then the active ones."""
    path = shared_dir(spark)
    for rows in (tables.roads(spark, d).select("qid"), tables.active(spark, d)):
        sinks.save_table(rows, "streetflow_saved", path)
    return spark.read.schema("qid int").parquet(path)


NAMES = ", ".join("'" + name.replace("'", "''") + "'" for name in schemas.TELEMETRY.values())


@query(f"SELECT unnest([{NAMES}]) AS name", base=False)
def snk2_telemetry_columns(spark, d):
    """The header of an adaptive run's telemetry as text, of a run over the first day."""
    p = pts(spark, d).where("t <= 86400")
    run = adaptive.adaptive_query(p, act(spark, d), EngineConfig(period=86_400, slide=86_400))
    path = text_of(spark, sinks.write_telemetry, run.telemetry())
    return spark.read.text(path).where("value LIKE 't;%'").select(F.explode(F.split("value", ";")).alias("name"))


def road_lines(spark, d, rome):
    ring = F.array_join(F.transform("ring", lambda v: F.concat(v["x"].cast("long"), F.lit(","), v["y"].cast("long"))), ",")
    p = lambda c: F.concat(F.col(c)["x"].cast("long"), F.lit(","), F.col(c)["y"].cast("long"))
    middle = ["cid"] if rome else ["range", "slide"]
    return tables.roads(spark, d).select(F.concat_ws(" ", "t", "qid", *middle, p("start"), p("end"), ring).alias("value"))


@query("SELECT qid, CAST(cid AS INT) AS cid, CAST(0 AS BIGINT) AS range, CAST(4 AS INT) AS vertices, cx + 500 AS x1, cy + 9500 AS y4 FROM road")
def src5_rome_roads(spark, d):
    return files.parse_roads(road_lines(spark, d, True), True, False).select("qid", "cid", "range", F.size("ring").alias("vertices"), F.col("ring")[0]["x"].alias("x1"), F.col("ring")[3]["y"].alias("y4"))


@query("SELECT qid, CAST(86400 AS BIGINT) AS range, CAST(21600 AS BIGINT) AS slide, CASE WHEN cid % 2 = 1 THEN cx + 9500 ELSE cx + 500 END AS start_x, cx + 9500 AS x2 FROM road")
def src6_athens_roads(spark, d):
    return files.parse_roads(road_lines(spark, d, False), False, False).select("qid", "range", "slide", F.col("start")["x"].alias("start_x"), F.col("ring")[1]["x"].alias("x2"))


@query("SELECT qid, CAST(900 AS BIGINT) AS range, CAST(60 AS BIGINT) AS slide, CAST(86400 AS BIGINT) AS own_range FROM road")
def src7_window_choice(spark, d):
    lines = road_lines(spark, d, False)
    own = files.parse_roads(lines, False, False).select("qid", F.col("range").alias("own_range"))
    return files.parse_roads(lines, False, True, (900, 60)).select("qid", "range", "slide").join(own, "qid")


@query("SELECT qid FROM act")
def src8_active_ids(spark, d):
    return tables.active(spark, d)


@query("SELECT oid, round(min(t), 6) AS t FROM loc GROUP BY oid")
def src9_start_times(spark, d):
    return files.first_times(pts(spark, d)).select("oid", r("t").alias("t"))


@query("SELECT qid, win_range, win_slide, category, round(length, 4) AS length FROM ax")
def src12_axes(spark, d):
    return tables.axes(spark, d).select("qid", "win_range", "win_slide", "category", r("length", 4).alias("length"))


DRAW = "('0x' || substr(md5(concat(CAST(id AS VARCHAR), '|draw|{}')), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
DRAWN = f"WITH u AS (SELECT id AS i, {DRAW.format(7)} AS u, {DRAW.format(8)} AS v FROM range(0, 2000) a(id))"


@query(DRAWN + """, w AS (SELECT k, pow(k, -1.0) AS w FROM range(1, 101) a(k)), s AS (SELECT k, sum(w) OVER (ORDER BY k) / sum(w) OVER () AS step FROM w)
SELECT i, least(1 + count(step), 100) AS item FROM u LEFT JOIN s ON step <= u GROUP BY i""", base=False)
def src14_zipf(spark, d):
    return generators.zipf(spark, 2000, 100, 1.0, 7)


@query(DRAWN + " SELECT i, round(10 + 2 * sqrt(-2 * ln(1 - u)) * cos(2 * pi() * v), 6) AS value FROM u", base=False)
def src14_gaussian(spark, d):
    return generators.gaussian(spark, 2000, 10.0, 2.0, 7).select("i", r("value").alias("value"))


@query(DRAWN + " SELECT i, round(5 + 4 * u, 6) AS value FROM u", base=False)
def src14_uniform(spark, d):
    return generators.uniform(spark, 2000, 5.0, 9.0, 7).select("i", r("value").alias("value"))


@query("""SELECT round(avg(tuples), 6) AS avg_update_s, round(100 * avg(tuples) / (avg(tuples) + avg(num)), 6) AS share_update_s, max(tuples) AS max_load FROM
  (SELECT CAST(ceil(t / 21600) AS BIGINT) AS k, count(*)::DOUBLE AS tuples, count(DISTINCT oid)::DOUBLE AS num FROM loc GROUP BY 1)""")
def snk3_summary(spark, d):
    by = pts(spark, d).groupBy(F.ceil(F.col("t") / PERIOD).alias("k")).agg(F.count("*").cast("double").alias("update_s"), F.countDistinct("oid").cast("double").alias("eval_s"))
    s = sinks.summary(by.withColumn("shed_s", F.lit(0.0)).withColumn("load", F.col("update_s")))
    return s.select(r("avg_update_s").alias("avg_update_s"), r("share_update_s").alias("share_update_s"), F.col("max_load"))


@query("SELECT qid, printf('%.6f %.6f', cx + 500, cy + 500) || ',' || printf('%.6f %.6f', cx + 9500, cy + 500) || ',' || printf('%.6f %.6f', cx + 8500, cy + 9500) || ',' || printf('%.6f %.6f', cx + 1500, cy + 9500) AS ring FROM road")
def snk8_printed_roads(spark, d):
    return sinks.printed(tables.roads(spark, d))


# filters and projections


@query("SELECT event_id FROM sp WHERE rn = 1 OR oid IN (SELECT oid FROM kept)")
def fil1_kept(spark, d):
    kept = shedding.random(ids(spark, d), 100).withColumn("k", F.lit(True))
    return trajectory.speeds(pts(spark, d)).join(joins.small(kept), "oid", "left").where("rn = 1 OR k").select("event_id")


@query("SELECT event_id FROM pip WHERE road IN (SELECT qid FROM act)")
def fil2_inside_active(spark, d):
    return trajectory.candidates(pts(spark, d), act(spark, d), CONFIG).select("event_id").distinct()


@query("SELECT count(*) FILTER (v > 130) AS dropped, count(*) FILTER (v <= 130) AS passed, count(*) FILTER (v IS NULL) AS undefined FROM sp")
def fil3_fil4_speed_outliers(spark, d):
    v = F.col("v")
    return trajectory.speeds(pts(spark, d)).agg(F.count(F.when(v > trajectory.MOST_SPEED, 1)).alias("dropped"), F.count(F.when(v <= trajectory.MOST_SPEED, 1)).alias("passed"), F.count(F.when(v.isNull(), 1)).alias("undefined"))


@query("SELECT event_id FROM loc WHERE qid <> 0 AND qid IN (SELECT qid FROM act)")
def fil5_fil6_registered(spark, d):
    return pts(spark, d).where("qid <> 0").join(joins.small(act(spark, d).select("qid")), "qid", "left_semi").select("event_id")


@query("SELECT CAST(tick AS BIGINT) AS tick, CAST(qid AS INT) AS qid FROM grid CROSS JOIN (SELECT qid, 43200 * (1 + cid % 2) AS h, 21600 * (1 + cid % 2) AS s FROM road) WHERE tick >= h AND tick % s = 0")
def fil7_reporting_ticks(spark, d):
    roads = tables.roads(spark, d, global_window=False).select("qid", F.col("t").alias("q_t"), F.col("range").alias("q_range"), F.col("slide").alias("q_slide"))
    grid = windows.last_tick(pts(spark, d), PERIOD).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(PERIOD).cast("long"))).alias("tick"))
    return grid.join(joins.small(roads)).where(windows.reports(roads)).select("tick", "qid")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY t, event_id) AS m FROM loc) WHERE ('0x' || substr(md5(concat(CAST(event_id AS VARCHAR), '|7')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 1.5 * 300 / m")
def fil8_tuple_shedding(spark, d):
    return trajectory.tuples_shed(pts(spark, d), 300).select("event_id")


@query("SELECT CAST(t AS BIGINT) AS t, qid, round(diff, 6) AS diff FROM dif WHERE diff > 0.5")
def fil9_large_errors(spark, d):
    return accuracy.large(diffs(spark, d), 0.5).select(F.col("t").cast("long").alias("t"), "qid", r("diff").alias("diff"))


@query("SELECT oid, arg_max(event_id, (t, event_id)) AS event_id FROM loc GROUP BY oid HAVING max(t) > 86400 * 20")
def fil10_fresh_objects(spark, d):
    return trajectory.latest(pts(spark, d), "event_id", "t").where(F.col("t") > 86400 * 20).select("oid", "event_id")


@query("SELECT event_id FROM (SELECT *, lag(qid) OVER (PARTITION BY oid ORDER BY t, event_id) AS pq FROM loc) WHERE oid IN (SELECT oid FROM kept) OR pq IS NULL OR pq <> qid")
def fil11_kept_or_road_changed(spark, d):
    kept = shedding.random(ids(spark, d), 100).withColumn("k", F.lit(True))
    before = F.lag("qid").over(Window.partitionBy("oid").orderBy("t", "event_id"))
    return pts(spark, d).withColumn("pq", before).join(joins.small(kept), "oid", "left").where("k OR pq IS NULL OR pq <> qid").select("event_id")


@query("SELECT event_id, oid, round(v, 6) AS v FROM sp")
def prj1_prj2_speed(spark, d):
    return trajectory.speeds(pts(spark, d)).select("event_id", "oid", r("v").alias("v"))


@query("SELECT event_id, round(CASE WHEN rn = 1 THEN coalesce(lead(v) OVER (PARTITION BY oid ORDER BY t, event_id), 0) ELSE v END, 6) AS v FROM sp")
def prj3_first_speed_fixed(spark, d):
    return trajectory.with_first_speed_of_second(pts(spark, d)).select("event_id", r("v").alias("v"))


@query("SELECT CAST(t AS BIGINT) AS t, qid, round(diff, 6) AS diff, round(relative, 6) AS relative FROM dif")
def prj4_join8_differences(spark, d):
    return diffs(spark, d).select(F.col("t").cast("long").alias("t"), "qid", r("diff").alias("diff"), r("relative").alias("relative"))


LENGTH_CLASS = "CASE WHEN length < 200 THEN '1: <200' WHEN length < 500 THEN '2: 200-500' WHEN length < 1000 THEN '3: 500-1000' WHEN length < 2000 THEN '4: 1000-2000' ELSE '5: 2000+' END"


@query(f"SELECT qid, round(length, 4) AS length, {LENGTH_CLASS} AS length_class FROM (SELECT qid, sum(length) AS length FROM ax GROUP BY qid)")
def prj5_agg18_road_lengths(spark, d):
    return accuracy.length_of_road(tables.axes(spark, d)).select("qid", r("length", 4).alias("length"), accuracy.length_class(F.col("length")).alias("length_class"))


# joins


@query("SELECT event_id, road FROM pip")
def join1_points_in_roads(spark, d):
    return trajectory.candidates(pts(spark, d), tables.roads(spark, d), CONFIG).select("event_id", "road")


HEADING = """, both_ways AS (SELECT qid, CASE WHEN cid % 2 = 1 THEN -9000 ELSE 9000 END AS rx FROM road UNION ALL SELECT qid + 25, CASE WHEN cid % 2 = 1 THEN 9000 ELSE -9000 END FROM road),
best AS (SELECT event_id, arg_min(b.qid, (round(1 - coalesce((rx * (x - px)) / nullif(sqrt(rx * rx) * sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0), 0), 9), b.qid)) AS road
  FROM pip JOIN sp USING (event_id) JOIN both_ways b ON b.qid % 25 = pip.road % 25 GROUP BY event_id)
"""


@query(HEADING + "SELECT event_id, CAST(road AS INT) AS road FROM best")
def join2_heading(spark, d):
    return trajectory.assign_roads(trajectory.with_previous(pts(spark, d)), tables.roads(spark, d, both_ways=True), CONFIG).where("road IS NOT NULL").select("event_id", "road")


@query("SELECT count(*) AS assigned, count(*) FILTER (pip.road = loc.qid) AS agree, round(avg(CASE WHEN pip.road = loc.qid THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM pip JOIN loc USING (event_id)")
def join3_agg8_agreement(spark, d):
    a = trajectory.assign_roads(trajectory.with_previous(pts(spark, d)), tables.roads(spark, d), CONFIG).where("road IS NOT NULL")
    same = (F.col("road") == F.col("qid")).cast("int")
    return a.agg(F.count("*").alias("assigned"), F.sum(same).alias("agree"), r(F.avg(same)).alias("agreement"))


@query("SELECT qid, CAST(cid AS INT) AS cid FROM act")
def join4_active_roads(spark, d):
    return act(spark, d).select("qid", "cid")


@query("SELECT CAST(50 * j + i AS BIGINT) AS cell, qid FROM road, range(0, 50) a(i), range(0, 50) b(j) WHERE i BETWEEN floor((cx + 500 - 450000) / 1000) AND floor((cx + 9500 - 450000) / 1000) AND j BETWEEN floor((cy + 500 - 4175000) / 1000) AND floor((cy + 9500 - 4175000) / 1000)")
def join5_fn4_road_cells(spark, d):
    return trajectory.road_cells(tables.roads(spark, d), CONFIG).select("cell", "qid")


@query("SELECT event_id, round(pt, 6) AS prev_t, round(px, 4) AS prev_x, round(py, 4) AS prev_y FROM sp0")
def join6_win1_previous_point(spark, d):
    return trajectory.with_previous(pts(spark, d)).select("event_id", r("prev_t").alias("prev_t"), r("prev_x", 4).alias("prev_x"), r("prev_y", 4).alias("prev_y"))


@query("SELECT CAST(tick AS BIGINT) AS tick, count(*) AS points FROM tk GROUP BY tick")
def join7_str2_window_contents(spark, d):
    return windows.ticks(stored(spark, d), PERIOD, RANGE).groupBy(F.col("tick").cast("long").alias("tick")).agg(F.count("*").alias("points"))


@query("SELECT s.win_slide, CAST(c.roads AS BIGINT) AS roads, count(*) AS answers FROM dif JOIN (SELECT qid, min(win_slide) AS win_slide FROM ax GROUP BY qid) s USING (qid) JOIN (SELECT win_range, win_slide, count(DISTINCT qid) AS roads FROM ax GROUP BY ALL) c USING (win_slide) GROUP BY ALL")
def join9_three_ways(spark, d):
    return accuracy.by_class(diffs(spark, d), tables.axes(spark, d)).select("win_slide", "roads", "answers")


@query(f"SELECT {LENGTH_CLASS} AS length_class, count(*) AS answers FROM dif JOIN (SELECT qid, sum(length) AS length FROM ax GROUP BY qid) USING (qid) GROUP BY 1")
def join10_length_classes(spark, d):
    return accuracy.by_length(diffs(spark, d), tables.axes(spark, d)).select("length_class", "answers")


@query("SELECT b.qid, count(*) AS objects, round(avg(v), 6) AS speed FROM (SELECT oid, arg_max(x, (t, event_id)) AS x, arg_max(y, (t, event_id)) AS y, arg_max(coalesce(v, -1), (t, event_id)) AS v FROM sp GROUP BY oid) l JOIN road b ON x BETWEEN cx + 2000 AND cx + 8000 AND y BETWEEN cy + 2000 AND cy + 8000 GROUP BY b.qid")
def join11_latest_in_boxes(spark, d):
    last = trajectory.latest(trajectory.speeds(pts(spark, d)).withColumn("v", F.coalesce("v", F.lit(-1.0))), "x", "y", "v")
    cx, cy = F.col("ring")[0]["x"] - 500, F.col("ring")[0]["y"] - 500
    boxes = tables.roads(spark, d).select("qid", (cx + 2000).alias("x_min"), (cx + 8000).alias("x_max"), (cy + 2000).alias("y_min"), (cy + 8000).alias("y_max"))
    return joins.range_join(last, boxes, "x", "y", 2500.0).groupBy("qid").agg(F.count("*").alias("objects"), r(F.avg("v")).alias("speed"))


@query("SELECT qid, oid, count(*) AS points FROM sto WHERE qid <> 0 GROUP BY ALL")
def join12_road_object_index(spark, d):
    return stored(spark, d).where("qid <> 0").groupBy("qid", "oid").agg(F.count("*").alias("points"))


# aggregates


@query("SELECT CAST(tick AS BIGINT) AS tick, oid, road, round(m, 6) AS m, n FROM om")
def agg1_object_means(spark, d):
    return means(spark, d).select(F.col("tick").cast("long").alias("tick"), "oid", "road", r("m").alias("m"), "n")


@query("SELECT CAST(tick AS BIGINT) AS tick, qid, round(speed, 6) AS speed, round(greatest(top, 0), 6) AS top, num AS num_objects FROM rs")
def agg2_agg3_road_speeds(spark, d):
    m, roads = means(spark, d), act(spark, d)
    top = windows.road_speeds(m, roads, "max").select("tick", "qid", F.col("speed").alias("top"))
    return windows.road_speeds(m, roads).join(top, ["tick", "qid"]).select(F.col("tick").cast("long").alias("tick"), "qid", r("speed").alias("speed"), r("top").alias("top"), "num_objects")


@query("SELECT CAST(t AS BIGINT) AS t, count(*) AS roads, count(*) FILTER (speed = -1) AS unanswered FROM rep GROUP BY t")
def agg4_zero_fill(spark, d):
    return speed_query(pts(spark, d), act(spark, d)).groupBy("t").agg(F.count("*").alias("roads"), F.count(F.when(F.col("speed") == -1, 1)).alias("unanswered"))


@query("SELECT CAST(tick AS BIGINT) AS tick, road, string_agg(CAST(oid AS VARCHAR), ',' ORDER BY oid) AS oids FROM om GROUP BY ALL")
def agg5_contributors(spark, d):
    m = means(spark, d).groupBy(F.col("tick").cast("long").alias("tick"), "road").agg(F.array_sort(F.collect_set("oid")).alias("o"))
    return m.select("tick", "road", F.array_join(F.col("o").cast("array<string>"), ",").alias("oids"))


@query("SELECT CAST(tick AS BIGINT) AS tick, oid, count(DISTINCT road) AS roads FROM om GROUP BY ALL")
def agg6_roads_by_object(spark, d):
    return means(spark, d).groupBy(F.col("tick").cast("long").alias("tick"), "oid").agg(F.countDistinct("road").alias("roads"))


@query("""SELECT CAST(tick AS BIGINT) AS tick, coalesce(tuples, 0) AS tuples, coalesce(evicted, 0) AS evicted, coalesce(newbies, 0) AS newbies, coalesce(active, 0) AS active, coalesce(profitable, 0) AS profitable,
    CAST(sum(coalesce(tuples, 0)) OVER (ORDER BY tick) AS BIGINT) AS so_far, CAST(sum(coalesce(newbies, 0)) OVER (ORDER BY tick) AS BIGINT) AS total FROM grid
  LEFT JOIN (SELECT ceil(t / 21600) * 21600 AS tick, count(*) AS tuples FROM loc GROUP BY 1) USING (tick)
  LEFT JOIN (SELECT (floor((t + 86400) / 21600) + 1) * 21600 AS tick, count(*) AS evicted FROM loc GROUP BY 1) USING (tick)
  LEFT JOIN (SELECT ceil(t / 21600) * 21600 AS tick, count(*) AS newbies FROM (SELECT oid, min(t) AS t FROM loc GROUP BY oid) GROUP BY 1) USING (tick)
  LEFT JOIN (SELECT g.tick, count(DISTINCT oid) AS active FROM grid g JOIN loc ON t <= g.tick AND t > g.tick - 21600 GROUP BY 1) USING (tick)
  LEFT JOIN (SELECT tick, count(DISTINCT oid) AS profitable FROM om GROUP BY 1) USING (tick)""")
def agg7_telemetry(spark, d):
    out = windows.telemetry(pts(spark, d), means(spark, d), PERIOD, RANGE, SLIDE)
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("tick", "tuples", "evicted", "newbies", "active", "profitable", "so_far", "total")])


@query("""SELECT CAST(tick AS BIGINT) AS tick, coalesce(tuples, 0) AS tuples, coalesce(tuples, 0) AS processed, coalesce(stored, 0) AS stored, coalesce(kept_processed, 0) AS kept_processed, coalesce(kept_stored, 0) AS kept_stored FROM grid
  LEFT JOIN (SELECT ceil(t / 21600) * 21600 AS tick, count(*) AS tuples, count(*) FILTER (rn = 1 OR oid IN (SELECT oid FROM kept)) AS kept_processed FROM sp GROUP BY 1) USING (tick)
  LEFT JOIN (SELECT ceil(t / 21600) * 21600 AS tick, count(*) AS stored, count(*) FILTER (rn = 1 OR oid IN (SELECT oid FROM kept)) AS kept_stored FROM sto GROUP BY 1) USING (tick)""")
def agg7_processed_stored(spark, d):
    """The points processed and stored by tick: of all objects, and when the same hundred are kept all the time."""
    p, m, s = pts(spark, d), means(spark, d), stored(spark, d)
    history = constant_history(p, shedding.random(ids(spark, d), 100))
    every = windows.telemetry(p, m, PERIOD, RANGE, SLIDE, s)
    kept = windows.telemetry(p, m, PERIOD, RANGE, SLIDE, trajectory.processed(s, history, CONFIG), trajectory.processed(trajectory.with_previous(p), history, CONFIG))
    both = every.join(kept.select("tick", F.col("processed").alias("kept_processed"), F.col("stored").alias("kept_stored")), "tick")
    return both.select(*[F.col(c).cast("long").alias(c) for c in ("tick", "tuples", "processed", "stored", "kept_processed", "kept_stored")])


@query("""SELECT round(avg(up), 6) AS avg_update_s, CAST(max(up) AS DOUBLE) AS max_load, max(nan) AS not_a_number, round(max(pip), 6) AS pip_correctness FROM (SELECT count(*)::DOUBLE AS up FROM loc GROUP BY ceil(t / 21600)),
  (SELECT count(*) FILTER (v IS NULL) AS nan FROM sp), (SELECT 100.0 * count(*) FILTER (pip.road = loc.qid) / count(*) AS pip FROM pip JOIN loc USING (event_id))""")
def snk3_final_summary(spark, d):
    p = pts(spark, d)
    by = p.groupBy(F.ceil(F.col("t") / PERIOD).alias("k")).agg(F.count("*").cast("double").alias("up_time"))
    rows = by.select("up_time", F.lit(0.0).alias("ev_time"), F.lit(0.0).alias("ls_time"), F.col("up_time").alias("load"))
    s = sinks.final_summary(rows, trajectory.assign_roads(trajectory.speeds(p), tables.roads(spark, d), CONFIG))
    return s.select(r("avg_update_s").alias("avg_update_s"), "max_load", "not_a_number", r("pip_correctness").alias("pip_correctness"))


@query("SELECT oid, round(t, 6) AS t, oid AS id, round(x, 0) AS x FROM loc")
def snk8_printed_points(spark, d):
    """Of each line the object and the place that it names, the place in whole metres."""
    part = F.split(F.regexp_replace("line", "[<>]", ""), ", ")
    return sinks.printed_points(pts(spark, d)).select("oid", r("t").alias("t"), part[1].cast("long").alias("id"), part[2].cast("double").alias("x"))


@query("SELECT cell, string_agg(CAST(oid AS VARCHAR), ', ' ORDER BY oid) AS oids FROM (SELECT oid, arg_max(cell, (t, event_id)) AS cell FROM cel GROUP BY oid) WHERE cell IS NOT NULL GROUP BY cell")
def snk8_printed_cells(spark, d):
    return sinks.printed_cells(pts(spark, d), CONFIG)


@query("SELECT oid, '{' || string_agg('(' || qid || ' ' || CAST(floor(t) AS BIGINT) || ')', ' -> ' ORDER BY t, event_id) || '}' AS line FROM loc GROUP BY oid")
def snk8_printed_trajectories(spark, d):
    return sinks.printed_trajectories(pts(spark, d))


@query("SELECT round(max(n), 6) AS max_load, round(avg(n), 6) AS avg_load FROM (SELECT count(*)::DOUBLE AS n FROM loc GROUP BY ceil(t / 21600))")
def agg9_loads(spark, d):
    by = pts(spark, d).groupBy(F.ceil(F.col("t") / PERIOD).alias("k")).agg(F.count("*").cast("double").alias("n"))
    return by.agg(r(F.max("n")).alias("max_load"), r(F.avg("n")).alias("avg_load"))


@query("SELECT round(regr_slope(n, t), 9) AS slope, round(regr_intercept(n, t), 4) AS intercept FROM (SELECT ceil(t / 21600) AS t, count(*)::DOUBLE AS n FROM loc GROUP BY 1)")
def agg10_regression(spark, d):
    by = pts(spark, d).groupBy(F.ceil(F.col("t") / PERIOD).cast("double").alias("t")).agg(F.count("*").cast("double").alias("load"))
    return controller.regression(by).select(r("slope", 9).alias("slope"), r("intercept", 4).alias("intercept"))


@query("SELECT CAST(floor(avg(c)) AS BIGINT) AS mean_crowd, CAST(list_sort(list(c))[len(list(c)) // 3 + 1] AS BIGINT) AS third FROM (SELECT qid, count(*) AS c FROM tch GROUP BY qid)")
def agg11_agg12_crowd_thresholds(spark, d):
    t = touched(spark, d)
    return spark.createDataFrame([(shedding.few_objects_threshold(t, 1), shedding.few_objects_threshold(t, 3))], "mean_crowd long, third long")


@query("SELECT qid, cx + 500 AS x_min, cy + 500 AS y_min, cx + 9500 AS x_max, cy + 9500 AS y_max FROM road")
def agg13_bounding_boxes(spark, d):
    return tables.roads(spark, d).select("qid", G.box_of(F.col("ring")).alias("b")).select("qid", "b.*")


@query("SELECT round(avg(diff), 3) AS avg_error, round(stddev_samp(diff), 3) AS std_error FROM dif")
def agg14_error_summary(spark, d):
    return accuracy.summary(diffs(spark, d))


@query("SELECT s.win_slide, CAST(c.roads AS BIGINT) AS roads, count(diff) AS answers, round(max(diff), 6) AS max_error, round(avg(diff), 6) AS avg_error, round(stddev_samp(diff), 6) AS std_error FROM dif JOIN (SELECT qid, min(win_slide) AS win_slide FROM ax GROUP BY qid) s USING (qid) JOIN (SELECT win_range, win_slide, count(DISTINCT qid) AS roads FROM ax GROUP BY ALL) c USING (win_slide) GROUP BY ALL")
def agg15_errors_by_class(spark, d):
    e = accuracy.by_class(diffs(spark, d), tables.axes(spark, d))
    return e.select("win_slide", "roads", "answers", *[r(c).alias(c) for c in ("max_error", "avg_error", "std_error")])


@query("SELECT qid, min(win_slide) AS win_slide FROM ax GROUP BY qid")
def agg16_slide_of_road(spark, d):
    return accuracy.slide_of_road(tables.axes(spark, d))


@query("SELECT win_range, win_slide, count(DISTINCT qid) AS roads FROM ax GROUP BY ALL")
def agg17_roads_of_class(spark, d):
    return accuracy.roads_of_class(tables.axes(spark, d))


@query(f"SELECT {LENGTH_CLASS} AS length_class, count(diff) AS answers, round(max(diff), 6) AS max_error, round(avg(diff), 6) AS avg_error, round(stddev_samp(diff), 6) AS std_error FROM dif JOIN (SELECT qid, sum(length) AS length FROM ax GROUP BY qid) USING (qid) GROUP BY 1")
def agg19_errors_by_length(spark, d):
    e = accuracy.by_length(diffs(spark, d), tables.axes(spark, d))
    return e.select("length_class", "answers", *[r(c).alias(c) for c in ("max_error", "avg_error", "std_error")])


@query("SELECT count(*) AS queries, count(DISTINCT category) AS categories FROM ax")
def agg20_counts(spark, d):
    return tables.axes(spark, d).agg(F.count("*").alias("queries"), F.countDistinct("category").alias("categories"))


@query("SELECT oid, count(*) AS points, round(coalesce(sum(sqrt((x - px) * (x - px) + (y - py) * (y - py))), 0), 4) AS distance FROM sp0 GROUP BY oid")
def agg21_trajectory_lengths(spark, d):
    return trajectory.lengths(pts(spark, d)).select("oid", "points", r("distance", 4).alias("distance"))


@query("""SELECT count(*) AS objects, count(DISTINCT cell) AS cells FROM (SELECT oid, arg_max(cell, (t, event_id)) AS cell FROM cel GROUP BY oid)
  WHERE cell IN (SELECT CAST(50 * j + i AS BIGINT) FROM act, range(0, 50) a(i), range(0, 50) b(j) WHERE i BETWEEN floor((cx + 500 - 450000) / 1000) AND floor((cx + 9500 - 450000) / 1000) AND j BETWEEN floor((cy + 500 - 4175000) / 1000) AND floor((cy + 9500 - 4175000) / 1000))""")
def agg22_objects_in_road_cells(spark, d):
    cells = trajectory.road_cells(act(spark, d), CONFIG).select("cell").distinct()
    last = trajectory.latest(with_cells(spark, d), "cell")
    return last.join(joins.small(cells), "cell", "left_semi").agg(F.count("*").alias("objects"), F.countDistinct("cell").alias("cells"))


@query("SELECT pane, qid, n, CAST(sum(n) OVER (PARTITION BY qid ORDER BY pane RANGE BETWEEN 64800 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM (SELECT CAST(ceil(t / 21600) * 21600 AS BIGINT) AS pane, qid, count(*) AS n FROM loc WHERE qid <> 0 GROUP BY ALL)")
def agg23_panes(spark, d):
    return windows.panes(pts(spark, d), SLIDE, 4).select(F.col("pane").cast("long").alias("pane"), "qid", "n", "total")


@query("SELECT qid, round(median(v), 6) AS median FROM sp WHERE v IS NOT NULL GROUP BY qid")
def agg24_median_speed(spark, d):
    return trajectory.speeds(pts(spark, d)).where("v IS NOT NULL").groupBy("qid").agg(r(sketches.median("v")).alias("median"))


# ordered functions


@query("SELECT event_id FROM sp WHERE rn = 1")
def win2_first_points(spark, d):
    return trajectory.with_previous(pts(spark, d)).where("rn = 1").select("event_id")


@query("SELECT oid, seg, qid, round(t1, 6) AS t1, round(t2, 6) AS t2, n FROM seg")
def win3_road_segments(spark, d):
    return road_segs(spark, d).select("oid", "seg", "qid", r("t1").alias("t1"), r("t2").alias("t2"), "n")


CELL_SEGS = """, c0 AS (SELECT *, CASE WHEN cell = lag(cell) OVER (PARTITION BY oid ORDER BY t, event_id) THEN 0 ELSE 1 END AS new FROM cel), c1 AS (SELECT *, sum(new) OVER (PARTITION BY oid ORDER BY t, event_id) AS seg FROM c0),
c2 AS (SELECT oid, seg, cell, min(t) AS t1, max(t) AS last FROM c1 GROUP BY ALL), cseg AS (SELECT oid, CAST(seg AS BIGINT) AS seg, cell, t1, coalesce(lead(t1) OVER (PARTITION BY oid ORDER BY seg), last) AS t2 FROM c2)
"""


@query(CELL_SEGS + "SELECT oid, seg, cell, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM cseg")
def win4_cell_segments(spark, d):
    return segments.segments(with_cells(spark, d), "cell").select("oid", "seg", "cell", r("t1").alias("t1"), r("t2").alias("t2"))


@query("SELECT oid, seg, round(greatest(t1, 1000000), 6) AS t1, round(t2, 6) AS t2 FROM seg WHERE t2 >= 1000000")
def win5_cropped_segments(spark, d):
    return segments.crop(road_segs(spark, d), 1_000_000).select("oid", "seg", r("t1").alias("t1"), r("t2").alias("t2"))


@query("SELECT oid, round(sum(t2 - t1 + 1), 4) AS seconds FROM seg GROUP BY oid")
def win6_durations(spark, d):
    return road_segs(spark, d).groupBy("oid").agg(r(F.sum(segments.duration()), 4).alias("seconds"))


@query(CELL_SEGS + ", cr AS (SELECT CAST(50 * j + i AS BIGINT) AS cell, count(*) AS roads FROM act, range(0, 50) a(i), range(0, 50) b(j) WHERE i BETWEEN floor((cx + 500 - 450000) / 1000) AND floor((cx + 9500 - 450000) / 1000) AND j BETWEEN floor((cy + 500 - 4175000) / 1000) AND floor((cy + 9500 - 4175000) / 1000) GROUP BY 1) SELECT oid, round(sum(coalesce(roads, 0) * (t2 - t1 + 1)), 3) AS score FROM cseg LEFT JOIN cr USING (cell) GROUP BY oid")
def win7_cell_score(spark, d):
    cells = trajectory.road_cells(act(spark, d), CONFIG).groupBy("cell").agg(F.count("*").alias("roads"))
    return segments.cell_score(segments.segments(with_cells(spark, d), "cell"), cells).select("oid", r("score", 3).alias("score"))


@query("SELECT oid, round(sum(CASE WHEN qid <> 0 THEN t2 - t1 + 1 ELSE 0 END), 3) AS score FROM seg GROUP BY oid")
def win8_road_score(spark, d):
    return segments.road_score(road_segs(spark, d)).select("oid", r("score", 3).alias("score"))


@query("SELECT oid, round(sum(p), 6) AS score FROM (SELECT oid, pow(0.5, row_number() OVER (PARTITION BY oid ORDER BY seg DESC)) * (t2 - t1 + 1) / sum(t2 - t1 + 1) OVER (PARTITION BY oid) AS p FROM seg WHERE qid <> 0) GROUP BY oid")
def win9_decayed_score(spark, d):
    return segments.decayed_score(road_segs(spark, d)).select("oid", r("score").alias("score"))


@query("SELECT oid, round(sum(s / total), 6) AS score FROM (SELECT oid, qid, sum(t2 - t1 + 1) AS s, sum(sum(t2 - t1 + 1)) OVER (PARTITION BY qid) AS total FROM seg WHERE qid <> 0 GROUP BY oid, qid) GROUP BY oid")
def win10_share_score(spark, d):
    return segments.share_score(road_segs(spark, d)).select("oid", r("score").alias("score"))


@query("SELECT oid, round(coalesce(s, -2), 4) AS seconds FROM ids LEFT JOIN (SELECT oid, sum(t2 - t1 + 1) AS s FROM seg WHERE qid = 3 GROUP BY oid) USING (oid)")
def win11_time_on_road(spark, d):
    return segments.time_on_road(road_segs(spark, d), ids(spark, d), 3).select("oid", r("seconds", 4).alias("seconds"))


@query("SELECT oid, seg, qid, round(CASE WHEN t2 - pt2 <= 21600 THEN t2 - pt2 + 1 ELSE t2 - (ceil(t2 / 21600) * 21600 - 21600) + 1 END, 4) AS slide_duration FROM (SELECT *, lag(t2) OVER (PARTITION BY oid ORDER BY seg) AS pt2 FROM seg)")
def win12_update_durations(spark, d):
    return segments.update_durations(road_segs(spark, d), SLIDE).select("oid", "seg", "qid", r("slide_duration", 4).alias("slide_duration"))


SEM = ", sem AS (SELECT oid, round(coalesce(sum(1.0::DOUBLE / c), 0), 9) AS score FROM ids LEFT JOIN (SELECT oid, c FROM tch JOIN (SELECT qid, count(*) AS c FROM tch GROUP BY qid) USING (qid)) USING (oid) GROUP BY oid)\n"
HASH = "md5(concat(CAST(oid AS VARCHAR), '|7'))"


@query(SEM + "SELECT oid, CASE WHEN oid IN (SELECT oid FROM kept) THEN -2.0 ELSE round(score, 6) END AS score FROM sem WHERE score > 0")
def win13_unselected_scores(spark, d):
    scores = shedding.semantic_scores(touched(spark, d))
    return segments.score_unselected(scores, shedding.random(ids(spark, d), 100)).select("oid", r("score").alias("score"))


# which n stay


@query("SELECT oid FROM ids ORDER BY md5(concat(CAST(oid AS VARCHAR), '|0')), oid LIMIT 40")
def top1_first(spark, d):
    return shedding.first(ids(spark, d), 40)


@query("SELECT oid FROM ids ORDER BY oid LIMIT 40")
def top2_smallest_ids(spark, d):
    return shedding.smallest_ids(ids(spark, d), 40)


@query("SELECT oid FROM kept")
def top3_top14_top19_random(spark, d):
    return shedding.random(ids(spark, d), 100)


@query(""", f AS (SELECT oid, min(t) AS t FROM loc GROUP BY oid), old AS (SELECT oid FROM f WHERE t <= 60000), a AS (SELECT oid, row_number() OVER (ORDER BY oid) - 1 AS place FROM (SELECT oid FROM old ORDER BY md5(concat(CAST(oid AS VARCHAR), '|7')), oid LIMIT 30)),
  new AS (SELECT oid, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY t, oid) AS size FROM f WHERE t > 60000),
  drawn AS (SELECT oid, size, floor(('0x' || substr(md5(concat(CAST(oid AS VARCHAR), '|7')), 1, 8))::BIGINT / 4294967296.0::DOUBLE * size) AS place FROM new),
  let_in AS (SELECT * FROM drawn WHERE size < 80 OR place < (SELECT count(*) FROM a))
SELECT oid FROM a WHERE place NOT IN (SELECT place FROM let_in WHERE size >= 80) UNION ALL SELECT oid FROM let_in""")
def top4_reservoir(spark, d):
    """Thirty of the objects known after 60,000 s are active; those that come later are let in one after another."""
    first = files.first_times(pts(spark, d))
    old = first.where("t <= 60000").select("oid")
    return shedding.admit(first.where("t > 60000"), shedding.random(old, 30), old.count(), 80)


@query("SELECT oid FROM kept WHERE oid NOT IN (SELECT oid FROM kept ORDER BY md5(concat(CAST(oid AS VARCHAR), '|9')), oid LIMIT (SELECT greatest(count(*) - 70, 0) FROM kept))")
def top5_drop_random(spark, d):
    return shedding.drop_random(ids(spark, d), shedding.random(ids(spark, d), 100), 70, seed=9)


@query("SELECT oid FROM kept UNION ALL (SELECT oid FROM ids WHERE oid NOT IN (SELECT oid FROM kept) ORDER BY md5(concat(CAST(oid AS VARCHAR), '|9')), oid LIMIT 20)")
def top6_top_up(spark, d):
    return shedding.top_up(ids(spark, d), shedding.random(ids(spark, d), 100), 120, seed=9)


@query(SEM + f"SELECT oid FROM sem ORDER BY score DESC, {HASH}, oid LIMIT 40")
def top7_top17_semantic(spark, d):
    return shedding.semantic(ids(spark, d), touched(spark, d), 40)


@query(SEM + f", sparse AS (SELECT DISTINCT oid FROM tch WHERE qid IN (SELECT qid FROM tch GROUP BY qid HAVING count(*) <= 130)) SELECT oid FROM sem ORDER BY oid IN (SELECT oid FROM sparse) DESC, score DESC, {HASH}, oid LIMIT 60")
def top8_sparse_roads_first(spark, d):
    return shedding.sparse_first(ids(spark, d), touched(spark, d), 60, 130)


STRATA = """, c5 AS (SELECT *, CASE WHEN x >= 450000 AND x < 500000 AND y >= 4175000 AND y < 4225000 THEN CAST(5 * floor((y - 4175000) / 10000) + floor((x - 450000) / 10000) AS BIGINT) END AS cell FROM loc),
rc AS (SELECT CAST(qid - 1 AS BIGINT) AS cell FROM act), lc AS (SELECT oid, cell FROM (SELECT oid, arg_max(cell, (t, event_id)) AS cell FROM c5 GROUP BY oid) WHERE cell IN (SELECT cell FROM rc))"""


def coarse_cells(spark, d):
    """Points in 25 cells, each with a road of its own, and the cells of the active roads."""
    c = EngineConfig(gran_x=5, gran_y=5)
    return pts(spark, d).withColumn("cell", G.cell_of(F.col("x"), F.col("y"), ATHENS, 5, 5)), trajectory.road_cells(act(spark, d), c).select("cell").distinct()


def strata(spark, d):
    """The objects that are now in a cell of an active road."""
    points, cells = coarse_cells(spark, d)
    return trajectory.latest(points, "cell").join(joins.small(cells), "cell", "left_semi").select("oid", "cell")


@query(STRATA + f" SELECT oid, cell FROM (SELECT oid, cell, row_number() OVER (PARTITION BY cell ORDER BY {HASH}, oid) AS rn, count(*) OVER (PARTITION BY cell) AS size, (SELECT count(*) FROM lc) AS total FROM lc) WHERE rn <= greatest(1, ceil(50.0::DOUBLE * size / total) - 1)")
def top10_stratified(spark, d):
    return shedding.stratified(strata(spark, d), 50)


@query(STRATA + f", hist AS (SELECT DISTINCT oid, cell FROM c5 WHERE cell IN (SELECT cell FROM rc)), quota AS (SELECT cell, ceil(50.0::DOUBLE * count(*) / (SELECT count(*) FROM hist)) AS q FROM hist GROUP BY cell), uni AS (SELECT oid, cell, min(late) AS late FROM (SELECT oid, cell, 0 AS late FROM hist UNION ALL SELECT oid, cell, 1 FROM lc) GROUP BY ALL) SELECT DISTINCT oid FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY late, {HASH}, oid) AS rn FROM uni) JOIN quota USING (cell) WHERE rn <= q")
def top11_stratified_history(spark, d):
    points, cells = coarse_cells(spark, d)
    history = points.join(joins.small(cells), "cell", "left_semi").select("oid", "cell").distinct()
    return shedding.stratified_history(strata(spark, d), history, 50)


@query("SELECT oid FROM (SELECT oid, row_number() OVER (ORDER BY oid) - 1 AS rn FROM ids) WHERE rn % greatest((SELECT count(*) FROM ids) // 40, 1) = 0 ORDER BY rn LIMIT 40")
def top12_systematic(spark, d):
    return shedding.systematic(ids(spark, d), 40)


@query(STRATA + " SELECT oid, cell FROM lc WHERE ('0x' || substr(md5(concat(CAST(oid AS VARCHAR), '|7')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < CASE cell WHEN 1 THEN 0.5 WHEN 2 THEN 0.25 ELSE 0 END")
def top12_sample_by(spark, d):
    return shedding.sample_by(strata(spark, d), {1: 0.5, 2: 0.25})


@query(f", lr AS (SELECT oid, arg_max(qid, (t, event_id)) AS qid, max(t) AS t FROM loc GROUP BY oid), sc AS (SELECT oid, round(CASE WHEN t <= 2000000 THEN -10 ELSE coalesce(1.0::DOUBLE / c, 0) END, 9) AS score FROM lr LEFT JOIN (SELECT qid, count(*) AS c FROM lr WHERE qid <> 0 GROUP BY qid) USING (qid)) SELECT oid FROM sc ORDER BY score DESC, {HASH}, oid LIMIT 40")
def top13_last_road(spark, d):
    return shedding.top(shedding.last_road_scores(pts(spark, d), 2_000_000), 40)


TOUCH = ", sc AS (SELECT oid, CASE WHEN t <= 2000000 THEN -10 ELSE coalesce(n, 0) END AS score FROM (SELECT oid, max(t) AS t FROM loc GROUP BY oid) LEFT JOIN (SELECT oid, count(DISTINCT qid) AS n FROM tch GROUP BY oid) USING (oid))"


def touch_scores(spark, d):
    return shedding.roads_touched_scores(touched(spark, d), trajectory.latest(pts(spark, d), "t"), 2_000_000)


@query(TOUCH + f" SELECT oid FROM sc ORDER BY score DESC, {HASH}, oid LIMIT 40")
def top15_roads_touched(spark, d):
    return shedding.top(touch_scores(spark, d), 40)


@query(TOUCH + f", half AS (SELECT oid FROM sc ORDER BY score DESC, {HASH}, oid LIMIT 20) SELECT oid FROM half UNION ALL (SELECT oid FROM sc WHERE oid NOT IN (SELECT oid FROM half) ORDER BY {HASH}, oid LIMIT 20)")
def top16_combined(spark, d):
    return shedding.combined(touch_scores(spark, d), 40)


@query(CELL_SEGS + f""", cr AS (SELECT CAST(50 * j + i AS BIGINT) AS cell, count(*) AS roads FROM act, range(0, 50) a(i), range(0, 50) b(j) WHERE i BETWEEN floor((cx + 500 - 450000) / 1000) AND floor((cx + 9500 - 450000) / 1000) AND j BETWEEN floor((cy + 500 - 4175000) / 1000) AND floor((cy + 9500 - 4175000) / 1000) GROUP BY 1),
sc AS (SELECT oid, CASE WHEN t <= 2000000 THEN -10 ELSE score END AS score FROM (SELECT oid, max(t) AS t FROM loc GROUP BY oid) JOIN (SELECT oid, round(sum(coalesce(roads, 0) * (t2 - t1 + 1)), 3) AS score FROM cseg LEFT JOIN cr USING (cell) GROUP BY oid) USING (oid)) SELECT oid FROM sc ORDER BY score DESC, {HASH}, oid LIMIT 40""")
def top18_cell_score(spark, d):
    cells = trajectory.road_cells(act(spark, d), CONFIG).groupBy("cell").agg(F.count("*").alias("roads"))
    scores = segments.cell_score(segments.segments(with_cells(spark, d), "cell"), cells).select("oid", r("score", 3).alias("score"))
    return shedding.top(shedding.cell_scores(scores, trajectory.latest(pts(spark, d), "t"), 2_000_000), 40)


@query(SEM + f"SELECT oid FROM sem WHERE oid IN (SELECT oid FROM tch) ORDER BY score DESC, {HASH}, oid LIMIT 40")
def top20_semantic_of_touched(spark, d):
    t = touched(spark, d)
    return shedding.semantic(t.select("oid").distinct(), t, 40)


@query("SELECT qid FROM road ORDER BY md5(concat(CAST(qid AS VARCHAR), '|7')), qid LIMIT 10")
def top21_random_roads(spark, d):
    return shedding.random(tables.roads(spark, d).select(F.col("qid").alias("oid")), 10).select(F.col("oid").alias("qid"))


@query("SELECT CAST(t AS BIGINT) AS t, qid, round(diff, 6) AS diff FROM dif ORDER BY diff DESC, t, qid LIMIT 50")
def top22_largest_errors(spark, d):
    return diffs(spark, d).orderBy(F.desc("diff"), "t", "qid").limit(50).select(F.col("t").cast("long").alias("t"), "qid", r("diff").alias("diff"))


@query("SELECT i AS id FROM range(1, 1001) a(i) ORDER BY md5(concat(CAST(i AS VARCHAR), '|7')), i LIMIT 60", base=False)
def top23_random_subset(spark, d):
    return shedding.random_subset(spark, 1000, 60)


@query("SELECT oid, n, row_number() OVER (ORDER BY n, oid) AS place FROM (SELECT oid, count(*) AS n FROM loc GROUP BY oid)")
def top24_sorted(spark, d):
    return files.with_rank(pts(spark, d).groupBy("oid").agg(F.count("*").alias("n")), "n", "oid").withColumnRenamed("rank", "place")


@query("SELECT item, count(*) * (SELECT count(*) FROM loc)::DOUBLE / 500 AS estimate FROM (SELECT qid AS item FROM loc ORDER BY md5(concat(CAST(event_id AS VARCHAR), '|7')), event_id LIMIT 500) GROUP BY item")
def top25_reservoir_frequencies(spark, d):
    return shedding.frequency_estimates(pts(spark, d).select(F.col("event_id").alias("i"), F.col("qid").alias("item")), 500)


# set operations


@query("SELECT oid + 100000 * c AS oid, count(*) AS n FROM loc, range(0, 5) k(c) GROUP BY ALL")
def set1_snk4_replicated(spark, d):
    return sets.replicate(pts(spark, d)).groupBy("oid").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT qid FROM loc")
def set2_distinct(spark, d):
    return pts(spark, d).select("qid").distinct()


@query("SELECT qid, arg_min(event_id, (t, event_id)) AS event_id FROM loc GROUP BY qid")
def set3_first_wins(spark, d):
    return sets.first_wins(pts(spark, d).withColumn("o", F.struct("t", "event_id")), "qid", "o").select("qid", "event_id")


@query("SELECT oid FROM ids WHERE oid NOT IN (SELECT oid FROM kept)")
def set4_difference(spark, d):
    return shedding.without(ids(spark, d), shedding.random(ids(spark, d), 100))


@query("SELECT (SELECT count(*) FROM (SELECT oid FROM loc WHERE qid = 1 UNION SELECT oid FROM loc WHERE qid = 2)) AS either, (SELECT count(*) FROM (SELECT oid FROM loc WHERE qid = 1 INTERSECT SELECT oid FROM loc WHERE qid = 2)) AS both_")
def set5_union_intersection(spark, d):
    a, b = (pts(spark, d).where(F.col("qid") == k).select("oid") for k in (1, 2))
    either = sets.union_ids(a, b).agg(F.count("*").alias("either"))
    return either.join(F.broadcast(sets.common_ids(a, b).agg(F.count("*").alias("both_"))))


# scalar functions


@query("SELECT event_id, cell, round(450000 + 1000.0::DOUBLE * (cell % 50), 4) AS x_min, round(4175000 + 1000.0::DOUBLE * floor(cell / 50), 4) AS y_min FROM cel")
def fn3_fn5_cells(spark, d):
    return with_cells(spark, d).withColumn("b", G.box_of_cell(F.col("cell"), ATHENS, 50, 50)).select("event_id", "cell", r("b.x_min", 4).alias("x_min"), r("b.y_min", 4).alias("y_min"))


@query("SELECT event_id, round(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 6) AS moved, round((x - px) / nullif(sqrt((x - px) * (x - px) + (y - py) * (y - py)), 0), 6) AS east FROM sp0")
def fn1_fn6_moves(spark, d):
    p = trajectory.with_previous(pts(spark, d))
    dx, dy = F.col("x") - F.col("prev_x"), F.col("y") - F.col("prev_y")
    east = F.round(G.heading_cosine(dx, dy, F.lit(1.0), F.lit(0.0)), 6)
    return p.select("event_id", r(G.distance(F.col("x"), F.col("y"), F.col("prev_x"), F.col("prev_y"))).alias("moved"), east.alias("east"))


@query("SELECT a.qid AS a, b.qid AS b, a.cx <= b.cx + 9000 AND b.cx <= a.cx + 9000 AND a.cy <= b.cy + 9000 AND b.cy <= a.cy + 9000 AS meet, a.cx <= b.cx + 4000 AND a.cx + 9000 >= b.cx + 5000 AND a.cy <= b.cy + 4000 AND a.cy + 9000 >= b.cy + 5000 AS has_center FROM road a, road b")
def fn7_boxes(spark, d):
    """All pairs of the 25 roads."""
    b = tables.roads(spark, d).select("qid", G.box_of(F.col("ring")).alias("b"))
    x, y = b.select(F.col("qid").alias("a"), F.col("b").alias("ba")), b.select(F.col("qid").alias("b"), F.col("b").alias("bb"))
    mid = F.struct((F.col("bb")["x_min"] + 4000).alias("x_min"), (F.col("bb")["y_min"] + 4000).alias("y_min"), (F.col("bb")["x_min"] + 5000).alias("x_max"), (F.col("bb")["y_min"] + 5000).alias("y_max"))
    return x.join(joins.small(y)).select("a", "b", G.boxes_intersect(F.col("ba"), F.col("bb")).alias("meet"), G.box_contains(F.col("ba"), mid).alias("has_center"))


@query("SELECT event_id, v BETWEEN 1 AND 3 AS inside, k >= 10 AND k <= 50 AND value >= 5 AND value <= 40 AS in_box, greatest(0, least(k + 10, 50) - greatest(k, 10)) * greatest(0, least(value + 10, 40) - greatest(value, 5)) AS volume FROM (SELECT event_id, value / 10 AS v, k, value FROM ev)", base=True)
def fn8_boxes_of_any_dimension(spark, d):
    p = pts(spark, d).select("event_id", F.round((F.col("x") - 450000) / 80, 2).alias("value"), F.round((F.col("y") - 4175000) / 500).alias("k"))
    point = F.array("k", "value")
    top = F.array(F.col("k") + 10, F.col("value") + 10)
    low, high = F.array(F.lit(10.0), F.lit(5.0)), F.array(F.lit(50.0), F.lit(40.0))
    return p.select("event_id", G.in_interval(F.col("value") / 10, F.lit(1), F.lit(3)).alias("inside"), G.in_box(point, low, high).alias("in_box"), G.overlap_volume(point, top, low, high).alias("volume"))


@query("SELECT event_id, CAST(least(qid, 10) AS INT) AS low, CAST(greatest(qid, 10) AS INT) AS high, round(log2(1 + abs(t)), 6) AS l, round(abs(x - y), 2) AS gap, CAST(event_id % 7 AS BIGINT) AS rest FROM loc")
def fn9_fn14_fn15_math(spark, d):
    return pts(spark, d).select("event_id", F.least("qid", F.lit(10)).alias("low"), F.greatest("qid", F.lit(10)).alias("high"), r(F.log2(1 + F.abs("t"))).alias("l"), r(F.abs(F.col("x") - F.col("y")), 2).alias("gap"), (F.col("event_id") % 7).alias("rest"))


@query("SELECT doc_id, len(list_filter(string_split(source || ',,' || lang || ',', ','), lambda s: s <> '')) AS tokens FROM documents", base=False)
def fn10_split(spark, d):
    t = F.concat("source", F.lit(",,"), "lang", F.lit(","))
    return tables.read(spark, d, "documents").select("doc_id", F.size(G.split_tokens(t, ",")).cast("long").alias("tokens"))


@query("SELECT n_nationkey, CAST(2 AS INT) AS vertices, n_nationkey + 0.5::DOUBLE AS x1, CAST(n_regionkey AS DOUBLE) AS y2 FROM nation", base=False)
def fn11_ring(spark, d):
    n = tables.read(spark, d, "nation")
    ring = G.parse_ring(F.concat_ws(",", F.col("n_nationkey") + 0.5, F.lit(1), F.lit(2), "n_regionkey", F.lit(9)))
    return n.select("n_nationkey", F.size(ring).alias("vertices"), ring[0]["x"].alias("x1"), ring[1]["y"].alias("y2"))


@query("SELECT event_id, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(lat - 38) / 2), 2) + cos(radians(38)) * cos(radians(lat)) * pow(sin(radians(lon - 23) / 2), 2)))), 6) AS km FROM (SELECT event_id, 37 + value / 100 AS lat, 23 + k / 100 AS lon FROM ev)")
def fn13_sphere(spark, d):
    p = pts(spark, d).select("event_id", (37 + F.round((F.col("x") - 450000) / 80, 2) / 100).alias("lat"), (23 + F.round((F.col("y") - 4175000) / 500) / 100).alias("lon"))
    return p.select("event_id", r(G.haversine_km(F.lit(38.0), F.lit(23.0), F.col("lat"), F.col("lon"))).alias("km"))


@query("SELECT oid, round(len(list_intersect(q, p))::DOUBLE / len(list_distinct(list_concat(q, p))), 6) AS similarity FROM (SELECT oid, list(DISTINCT qid) AS q FROM loc GROUP BY oid), (SELECT list(qid) AS p FROM act)")
def fn17_jaccard(spark, d):
    """Each object's roads and the active ones."""
    q = pts(spark, d).groupBy("oid").agg(F.collect_set("qid").alias("q"))  # roads, of which an object has few
    active = tables.active(spark, d).agg(F.collect_set("qid").alias("p"))
    return q.join(F.broadcast(active)).select("oid", r(G.jaccard(F.col("q"), F.col("p"))).alias("similarity"))


# streaming semantics on the batch, and the controller


@query("SELECT CAST(k * 21600 AS BIGINT) AS tick, qid, round(avg(m), 6) AS speed FROM (SELECT ceil(t / 21600) AS k, oid, qid, avg(v) AS m FROM sto WHERE v IS NOT NULL AND qid <> 0 GROUP BY ALL UNION ALL SELECT t / 21600 + 1, oid, qid, v FROM sto WHERE false) GROUP BY ALL")
def str3_tumbling(spark, d):
    s = stored(spark, d).where("v IS NOT NULL AND qid <> 0").groupBy(F.ceil(F.col("t") / PERIOD).alias("k"), "oid", "qid").agg(F.avg("v").alias("m"))
    return s.groupBy((F.col("k") * PERIOD).cast("long").alias("tick"), "qid").agg(r(F.avg("m")).alias("speed"))


LOADS = ", ld AS (SELECT CAST(ceil(t / 21600) * 21600 AS BIGINT) AS t, count(*)::DOUBLE AS load FROM loc GROUP BY 1)"


def loads(spark, d):
    return pts(spark, d).groupBy((F.ceil(F.col("t") / PERIOD) * PERIOD).cast("long").alias("t")).agg(F.count("*").cast("double").alias("load"))


@query(LOADS + " SELECT t, load, round(CASE WHEN count(*) OVER w < 2 THEN NULL ELSE regr_slope(load, t) OVER w * (t + 21600) + regr_intercept(load, t) OVER w END, 4) AS predicted FROM ld WINDOW w AS (ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)")
def str10_load_prediction(spark, d):
    return controller.predictions(loads(spark, d), PERIOD, 5).select("t", "load", r("predicted", 4).alias("predicted"))


def fold(less, more):
    """The controller in SQL: one row of state after another. Choices of fewer than all say 1, so shedding ends when all are kept again."""
    return LOADS + f""", pr AS (SELECT t, load, row_number() OVER (ORDER BY t) AS i, CASE WHEN count(*) OVER w < 2 THEN NULL ELSE regr_slope(load, t) OVER w * (t + 21600) + regr_intercept(load, t) OVER w END AS ahead FROM ld WINDOW w AS (ORDER BY t RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)),
cap AS (SELECT 0.8::DOUBLE * max(load) AS c, 0.05::DOUBLE * max(load) AS theta, (SELECT count(*) FROM ids) AS total FROM ld),
state(i, t, active, n) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(NULL AS DOUBLE) UNION ALL
  SELECT i, t, is_on AND NOT ends, CASE WHEN is_on AND NOT ends THEN m END FROM (SELECT *, under AND m >= total AND load < c - theta AND ahead < c - theta AS ends FROM (
    SELECT *, CASE WHEN over THEN greatest(0, n0 + round({less})) WHEN under THEN least(total, n0 + round({more})) ELSE n0 END AS m FROM (
      SELECT p.i, p.t, load, ahead, c, theta, total, coalesce(ahead > c + theta, false) AS over, coalesce(ahead < c - theta, false) AND active AS under, active OR coalesce(ahead > c + theta, false) AS is_on,
        CASE WHEN active THEN n ELSE total END AS n0, abs(ahead - c) AS gap FROM state s JOIN pr p ON p.i = s.i + 1 CROSS JOIN cap))))
SELECT t, CAST(n AS INT) AS n FROM state WHERE i > 0"""


def controlled(spark, d, formula):
    total = ids(spark, d).count()
    series = [(x.t, x.load, total) for x in loads(spark, d).orderBy("t").collect()]  # a row per cycle
    peak = max(x[1] for x in series)
    out = controller.run(series, controller.Controller(0.8 * peak, 0.05 * peak, PERIOD, formula=formula))
    return spark.createDataFrame(out, "t long, n int")


@query(fold("-log2(greatest(1, 100 * gap / c) + 1) * gap * n0 / greatest(1, 100 * gap / c)", "gap / c * n0"))
def str11_load_controller(spark, d):
    return controlled(spark, d, "logarithmic")


@query(fold("(c + theta - ahead) / load * n0", "(c - theta - ahead) / load * n0"))
def str12_band_controller(spark, d):
    return controlled(spark, d, "band")


@query(LOADS + " SELECT t, CASE WHEN load > 80 THEN CAST(80 AS INT) END AS n FROM ld")
def str13_capped(spark, d):
    return loads(spark, d).select("t", controller.capped_series(F.col("load"), 100, 80).alias("n"))


# sketches


@query("SELECT qid, count(*) AS n FROM loc GROUP BY qid HAVING count(*) >= 0.04 * (SELECT count(*) FROM loc)")
def sk1_heavy_hitters(spark, d):
    return sketches.heavy_hitters(pts(spark, d), "qid", 0.04)


@query("SELECT event_id FROM loc WHERE oid IN (SELECT oid FROM kept)")
def sk2_membership(spark, d):
    return sketches.members(pts(spark, d), shedding.random(ids(spark, d), 100), "oid").select("event_id")


PLACES = "list_distinct(list_transform(range(0, 5), lambda j: ('0x' || substr(md5(concat(CAST(oid AS VARCHAR), '|7|', j)), 1, 8))::BIGINT % 512))"


@query(f""", pl AS (SELECT oid, {PLACES} AS p FROM ids), odd AS (SELECT DISTINCT unnest(p) AS b FROM pl WHERE oid % 3 = 1), low AS (SELECT DISTINCT unnest(p) AS b FROM pl WHERE oid % 5 = 1),
has AS (SELECT oid, p, (SELECT list(b) FROM odd) AS a, (SELECT list(b) FROM low) AS c FROM pl)
SELECT oid, list_has_all(a, p) AS one, list_has_all(list_concat(a, c), p) AS merged, list_has_all(list_intersect(a, c), p) AS both_ FROM has""")
def sk2_bloom(spark, d):
    """Two filters of 512 bits, their union and their intersection: which objects each may have."""
    every, bits = ids(spark, d), 512
    one, two = (sketches.bloom(every.where(F.col("oid") % k == 1), "oid", bits) for k in (3, 5))
    out = every
    for name, f in (("one", one), ("merged", sketches.bloom_merge(one, two)), ("both_", sketches.bloom_intersect(one, two))):
        found = sketches.bloom_contains(every, "oid", f, bits).withColumn(name, F.lit(True))
        out = out.join(found, "oid", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


DIGEST = "md5(concat(CAST(item AS VARCHAR), '|7|', j))"


@query(f""", it AS (SELECT oid AS item, count(*) AS exact FROM loc GROUP BY oid),
h AS (SELECT item, exact, j, ('0x' || substr({DIGEST}, 1, 8))::BIGINT AS h, CASE WHEN substr({DIGEST}, 9, 1) < '8' THEN 1 ELSE -1 END AS sign FROM it, range(0, 5) k(j)),
c AS (SELECT j, h % 2719 AS slot, sum(exact) AS n, sum(sign * exact) AS s FROM h GROUP BY ALL),
b AS (SELECT place, sum(exact) AS b FROM (SELECT DISTINCT item, exact, h % 13595 AS place FROM h) GROUP BY place)
SELECT item, exact, CAST(min(n) AS BIGINT) AS count_min, CAST(least(min(n), 15) AS BIGINT) AS multi_bloom, CAST(least(min(b), 15) AS BIGINT) AS bloom, CAST(list_sort(list(sign * s))[3] AS BIGINT) AS fast_ams
  FROM h JOIN c ON c.j = h.j AND slot = h % 2719 JOIN b ON place = h % 13595 GROUP BY item, exact""")
def sk3_sk4_sk7_frequencies(spark, d):
    return sketches.frequencies(pts(spark, d), "oid")


@query("SELECT count(DISTINCT oid) AS exact, true AS close FROM loc")
def sk5_distinct_objects(spark, d):
    p = pts(spark, d)
    parts = p.groupBy("qid").agg(sketches.distinct_sketch("oid").alias("s"))
    exact = p.agg(F.countDistinct("oid").alias("exact"))
    return exact.join(F.broadcast(sketches.distinct_estimate(parts, "s"))).select("exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact") + 1).alias("close"))


@query("SELECT CAST(sum(n * n) AS BIGINT) AS f2 FROM (SELECT count(*) AS n FROM loc GROUP BY oid)")
def sk6_second_moment(spark, d):
    return sketches.second_moment(pts(spark, d), "oid")


@query(f""", it AS (SELECT oid AS item, count(*) AS n FROM loc GROUP BY oid), h AS (SELECT j, ('0x' || substr({DIGEST}, 1, 8))::BIGINT % 272 AS slot, CASE WHEN substr({DIGEST}, 9, 1) < '8' THEN n ELSE -n END AS s FROM it, range(0, 5) k(j)),
f AS (SELECT j, sum(s * s) AS f2 FROM (SELECT j, slot, sum(s) AS s FROM h GROUP BY ALL) GROUP BY j)
SELECT CAST((SELECT sum(n * n) FROM it) AS BIGINT) AS exact, CAST(list_sort(list(f2))[3] AS BIGINT) AS estimate FROM f""")
def sk6_second_moment_sketch(spark, d):
    return sketches.second_moment_sketch(pts(spark, d), "oid", 0.01)


@query("SELECT count(DISTINCT qid) AS items, true AS close FROM loc")
def sk9_top_items(spark, d):
    """Whether the roads' counts are exact, and those of the most frequent of 2000 items, from 256 counters, within the sketch's error."""
    p, skewed = pts(spark, d), generators.zipf(spark, 20_000, 2000, 1.2, 7)
    counts = lambda rows, c: rows.groupBy(c).agg(F.count("*").alias("exact"))
    off = sketches.top_items(skewed, "item", 10, 256).join(counts(skewed, "item"), "item").agg(F.max(F.abs(F.col("n") - F.col("exact"))).alias("off"), F.count("*").alias("found"))
    roads = sketches.top_items(p, "qid", 200).join(counts(p, "qid"), "qid").agg(F.count("*").alias("items"), F.sum((F.col("n") != F.col("exact")).cast("int")).alias("wrong"))
    return roads.join(F.broadcast(off)).select("items", ((F.col("wrong") == 0) & (F.col("found") == 10) & (F.col("off") <= 3.5 / 256 * 20_000)).alias("close"))


@query("SELECT count(*) AS n, true AS close FROM loc")
def sk10_quantiles(spark, d):
    p = pts(spark, d).select("x")
    q = sketches.quantiles(p, "x", [0.5]).select(F.col("quantiles")[0].alias("q"))
    ranked = p.join(F.broadcast(q)).agg(F.count("*").alias("n"), F.avg((F.col("x") <= F.col("q")).cast("double")).alias("share"))
    return ranked.select("n", (F.abs(F.col("share") - 0.5) < 0.02).alias("close"))


@query("SELECT place, true AS close FROM (SELECT unnest([0.1, 0.5, 0.9, 450400, 452000, 456000])::DOUBLE AS place)")
def sk10_merged_digests(spark, d):
    """Quantiles at three shares and ranks of three places from two merged sketches, against the exact shares of points up to them."""
    p = pts(spark, d)
    half = lambda k: p.where(F.col("oid") % 2 == k).agg(sketches.digest_of("x").alias(f"s{k}"))
    both = half(0).join(F.broadcast(half(1))).select(sketches.merged("s0", "s1").alias("s"))
    shares, places = [0.1, 0.5, 0.9], [450400.0, 452000.0, 456000.0]
    asked = [F.struct(F.lit(q).alias("place"), F.lit(q).alias("said"), sketches.quantiles_of("s", shares)[k].alias("value")) for k, q in enumerate(shares)]
    asked += [F.struct(F.lit(v).alias("place"), sketches.rank_of("s", f"{v}D").alias("said"), F.lit(v).alias("value")) for v in places]
    q = both.select(F.explode(F.array(*asked)).alias("q")).select("q.*")
    exact = p.join(F.broadcast(q)).groupBy("place", "said").agg(F.avg((F.col("x") <= F.col("value")).cast("double")).alias("exact"))
    return exact.select("place", (F.abs(F.col("said") - F.col("exact")) < 0.03).alias("close"))


@query(""", z AS (SELECT event_id AS i, qid AS item, row_number() OVER (ORDER BY event_id) - 1 AS i0 FROM loc), m AS (SELECT CAST(floor(max(i0) / 250) AS BIGINT) AS last FROM z),
st AS (SELECT i0, item, unnest(range(CAST(floor(i0 / 250) AS BIGINT), (SELECT last FROM m) + 1)) AS step FROM z),
tk2 AS (SELECT step, item, row_number() OVER (PARTITION BY step ORDER BY md5(concat(CAST(i0 AS VARCHAR), '|7')), i0) <= 200 AS taken FROM st),
ct AS (SELECT step, item, count(*) AS exact, count(*) FILTER (taken) AS taken, sum(count(*)) OVER (PARTITION BY step) AS n, row_number() OVER (PARTITION BY step ORDER BY count(*) DESC, item) AS place FROM tk2 GROUP BY step, item)
SELECT (step + 1) * 250 AS rows, round(avg(abs(taken * n / least(n, 200) - exact) / exact), 6) AS error FROM ct WHERE place <= 20 GROUP BY step""")
def sk13_sampler_errors(spark, d):
    items = files.with_rank(pts(spark, d).select("event_id", "qid"), "event_id").select((F.col("rank") - 1).alias("i"), F.col("qid").alias("item"))
    return shedding.sampler_errors(items, 200, 250).select("rows", r("error").alias("error"))


@query("SELECT qid, count(DISTINCT oid) AS exact, true AS close FROM loc GROUP BY qid")
def sk11_distinct_by_road(spark, d):
    out = sketches.distinct_by_item(pts(spark, d), "qid", "oid")
    return out.select("qid", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact") + 2).alias("close"))


@query(""", n AS (SELECT oid, count(*) AS v FROM loc GROUP BY oid), s AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9])::DOUBLE AS share)
SELECT share, CAST(quantile_disc(v, [0.1, 0.25, 0.5, 0.75, 0.9])[row_number() OVER (ORDER BY share)] AS BIGINT) AS value, count(*) AS objects, true AS close FROM n, s GROUP BY share""")
def sk12_distinct_quantile_ranks(spark, d):
    """Quantiles over the objects of their numbers of points, read from a stream in which an object comes once for each of its points."""
    p = pts(spark, d)
    stream = p.join(p.groupBy("oid").agg(F.count("*").alias("v")), "oid").select("oid", "v")
    q = sketches.distinct_ranks(stream, "oid", "v", [0.1, 0.25, 0.5, 0.75, 0.9])
    error, share = 0.0001 * F.col("n") + 1, F.col("share") * F.col("n")
    close = (F.col("below") - error <= share) & (share <= F.col("upto") + error)
    return q.select("share", "value", F.col("n").alias("objects"), close.alias("close"))
