"""Boundary rows, text formats, the controller and the stream."""

import math

import pytest
from pyspark.sql import functions as F

from streetflow import sinks
from streetflow.config import EngineConfig
from streetflow.functions import geometry as G
from streetflow.operators import accuracy, controller, segments, shedding, sketches, trajectory, windows
from streetflow.plans.speeds import speed_query
from streetflow.sources import files, generators, tables
from streetflow.storage import get_text, put_text
from streetflow.streaming import speeds as streaming

SQUARE = "array(named_struct('x', 0d, 'y', 0d), named_struct('x', 1d, 'y', 0d), named_struct('x', 1d, 'y', 1d), named_struct('x', 0d, 'y', 1d))"


def points(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, oid long, t double, x double, y double, qid int")


@pytest.mark.parametrize(("x", "y", "inside"), [(0.0, 0.5, True), (0.5, 0.0, True), (1.0, 0.5, False), (0.5, 1.0, False), (0.5, 0.5, True), (2.0, 0.5, False)])
def test_polygon_edges(spark, x, y, inside):
    assert spark.sql(f"select {SQUARE} r").select(G.in_polygon(F.col("r"), F.lit(x), F.lit(y))).first()[0] is inside


def test_speed_boundaries(spark):
    p = points(spark, [(1, 0.0, 0.0, 0.0, 1), (1, 1.0, 10.0, 0.0, 1), (1, 1.0, 10.0, 0.0, 1), (1, 1.0, 20.0, 0.0, 1)])
    v = [r.v for r in trajectory.speeds(p).orderBy("event_id").collect()]
    assert v == [0.0, 36.0, None, None]


def test_window_ends_are_closed(spark):
    p = points(spark, [(1, 10.0, 0.0, 0.0, 1), (1, 20.0, 0.0, 0.0, 1), (1, 30.0, 0.0, 0.0, 1)])
    got = {(r.tick, r.t) for r in windows.ticks(p, 10, 10).select(F.col("tick").cast("int").alias("tick"), F.col("t").cast("int").alias("t")).collect()}
    assert got == {(10, 10), (20, 10), (20, 20), (30, 20), (30, 30)}


@pytest.mark.parametrize("window", [20, 25])
def test_panes_agree_with_points(spark, window):
    rows = [(o, float(t), 0.0, 0.0, 1 + (t // 30) % 2) for o in (1, 2) for t in range(0, 101, 5)]
    p = trajectory.speeds(points(spark, rows)).withColumn("v", F.col("t") + F.col("oid"))
    direct = windows.ticks(p, 10, window).groupBy("tick", "oid", F.col("qid").alias("road")).agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    key = lambda d: sorted((int(r.tick), r.oid, r.road, round(r.m, 6), r.n) for r in d.collect())
    assert key(windows.object_means(p, 10, window)) == key(direct)


def test_outside_universe_is_on_no_cell(spark):
    assert spark.range(1).select(G.cell_of(F.lit(-1.0), F.lit(0.0), (0.0, 0.0, 10.0, 10.0), 2, 2)).first()[0] is None


def test_regression_golden():
    slope, intercept = controller.fit([10, 30, 50, 70, 90, 110], [5, 8, 6.5, 9, 12, 10])
    assert math.isclose(slope * 130 + intercept, 12.3666667, abs_tol=1e-6)
    assert controller.fit([1.0], [2.0]) is None


def test_controller_rises_and_falls():
    kept = []
    c = controller.Controller(1.0, 0.05, 1, loads=2, select=lambda n: kept.append(n) or 1)
    out = [c.step(t, load, 50) for t, load in enumerate([0.9, 1.0, 1.2, 1.4, 0.6, 0.2, 0.1, 0.1, 0.1, 0.1])]
    assert out[0] is None and out[3] is not None and out[3] < 50
    assert out[-1] is None  # all are kept again and the load is below the band
    assert kept


def test_older_models():
    c = controller.Controller(100.0, 5.0, 1, prediction=2, formula="band")
    assert c.step(0, 210, 100) == 50  # (capacity + band - load) / load of all go
    assert controller.capped(90, 100, 80) == 80 and controller.capped(70, 100, 80) is None


@pytest.mark.parametrize("n", [-1, 0, 3, 100])
def test_schemes_keep_at_most_n(spark, n):
    ids = spark.range(10).select(F.col("id").alias("oid"))
    touched = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "oid long, qid int")
    for got in (shedding.first(ids, n), shedding.smallest_ids(ids, n), shedding.random(ids, n), shedding.semantic(ids, touched, n)):
        assert got.count() == min(max(n, 0), 10)
    assert shedding.semantic(ids, touched, 1).first()[0] == 2


def test_few_objects_threshold(spark):
    touched = spark.createDataFrame([(o, q) for q in range(1, 5) for o in range(q * q)], "oid long, qid int")
    assert shedding.few_objects_threshold(touched, 1) == 7 and shedding.few_objects_threshold(touched, 2) == 9
    with pytest.raises(ValueError):
        shedding.few_objects_threshold(touched, 0)


def test_self_comparison_has_no_error(spark, sf):
    full = speed_query(tables.locations(spark, sf), tables.roads(spark, sf))
    e = accuracy.summary(accuracy.differences(full, full)).first()
    assert e.avg_error == 0 and e.std_error == 0


def test_segments(spark):
    p = points(spark, [(1, 0.0, 0.0, 0.0, 1), (1, 5.0, 0.0, 0.0, 1), (1, 9.0, 0.0, 0.0, 2), (1, 12.0, 0.0, 0.0, 1)])
    got = [(r.qid, r.t1, r.t2, r.n) for r in segments.segments(p, "qid").orderBy("seg").collect()]
    assert got == [(1, 0.0, 9.0, 2), (2, 9.0, 12.0, 1), (1, 12.0, 12.0, 1)]


def test_text_formats(spark, sf, tmp_path):
    p = tables.locations(spark, sf).select("t", "oid", "x", "y", "qid")
    sinks.write_stream_text(p, str(tmp_path / "s"))
    back = files.locations(spark, str(tmp_path / "s"))
    assert back.count() == p.count() and abs(back.agg(F.sum("t")).first()[0] - p.agg(F.sum("t")).first()[0]) < 1e-3
    (tmp_path / "rome").write_text("0 7 3 1,2 3,4 0,0,1,0,1,1,0,0\n")
    road = files.roads(spark, str(tmp_path / "rome"), True, True, (900, 60)).first()
    assert (road.qid, road.cid, road.range, road.slide, len(road.ring), road.end.y) == (7, 3, 900, 60, 4, 4.0)
    (tmp_path / "athens").write_text("0 7 300 30 1,2 3,4 0,0,1,0,1,1\n")
    assert files.roads(spark, str(tmp_path / "athens"), False, False).first().range == 300
    (tmp_path / "ids").write_text("3 5\n8\n")
    assert [r.qid for r in files.active_ids(spark, str(tmp_path / "ids")).collect()] == [3, 5, 8]
    r = speed_query(tables.locations(spark, sf), tables.roads(spark, sf))
    sinks.write_results(r, str(tmp_path / "r"))
    assert files.results(spark, str(tmp_path / "r")).where("speed is null").count() == 0
    (tmp_path / "axes").write_text("qid win_range win_slide category length\n1 300 30 2 10.5\n2 300 30 2 \n")
    assert files.axes(spark, str(tmp_path / "axes")).where("length is null").count() == 1
    sinks.write_ids(tables.active(spark, sf), str(tmp_path / "a"))
    assert files.active_ids(spark, str(tmp_path / "a")).count() == tables.active(spark, sf).count()
    (tmp_path / "starts").write_text("1 14.5\n")
    assert files.start_times(spark, str(tmp_path / "starts")).first().t == 14.5
    (tmp_path / "segs").write_text("1,2,3,Main\n")
    assert files.road_segments(spark, str(tmp_path / "segs")).first().name == "Main"
    (tmp_path / "buf").write_text("1,2,,4\n")
    assert files.buffers(spark, str(tmp_path / "buf")).first().name is None
    sinks.write_telemetry(windows.telemetry(tables.locations(spark, sf), windows.object_means(trajectory.speeds(tables.locations(spark, sf)), 21600, 86400), 21600, 86400, 21600), str(tmp_path / "t"))
    assert ";" in next((tmp_path / "t").glob("part*")).read_text()


def test_config():
    c = EngineConfig.parse("VALID 0 1 o 2 q a 1 0 50 50 10 80 3 5 1 5 1 900 60 60 1 2".split() + ["0"])
    assert c.capacity == 8.0 and c.band == 0.5 and c.range == 900
    with pytest.raises(ValueError):
        EngineConfig(scheme=9)
    with pytest.raises(ValueError):
        EngineConfig.parse(["x"])


def test_assigned_mode(spark, sf):
    r = speed_query(tables.locations(spark, sf), tables.roads(spark, sf), mode="assigned")
    assert r.where("num_objects > 0").count() > 0


def test_ranks_and_median_and_zipf(spark):
    assert 0.4 < sketches.rank(spark.range(1000).select(F.col("id").cast("double").alias("v")), "v", 500.0).first()[0] < 0.6
    counts = {r.item: r["count"] for r in generators.zipf(spark, 5000, 50, 1.0, 7).groupBy("item").count().collect()}
    assert counts[1] > counts[10] and max(counts) <= 50
    assert shedding.sample_size(0.1, 0.1) == 150
    items = generators.zipf(spark, 5000, 50, 1.0, 7).select("i", "item")
    estimate = {r.item: r.estimate for r in shedding.frequency_estimates(items, 2000).collect()}
    assert abs(estimate[1] - counts[1]) < 0.2 * counts[1]


def test_stream_is_the_batch(spark, sf, tmp_path):
    period, window = 21600, 86400
    p = tables.locations(spark, sf).select("t", "oid", "x", "y", "qid")
    ordered = p.orderBy("t").toPandas()
    size = -(-len(ordered) // 4)
    (tmp_path / "in").mkdir()
    for k in range(4):
        ordered.iloc[k * size : (k + 1) * size].to_csv(tmp_path / "in" / f"{k}.csv", sep=" ", header=False, index=False, float_format="%.6f")
    (tmp_path / "in" / "9.csv").write_text(f"{ordered.t.max() + 10 * window:.6f} 999999 0 0 0\n")  # moves the watermark past all ticks
    stream = files.locations_stream(spark, str(tmp_path / "in"))
    out = streaming.road_speeds(streaming.speeds(stream), period, window)
    q = out.writeStream.format("memory").queryName("stream_speeds").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    last = math.ceil(ordered.t.max() / period) * period
    got = {(r.tick, r.qid): (round(r.speed, 4), r.num_objects) for r in spark.table("stream_speeds").collect() if 0 < r.tick <= last}
    points_ = p.withColumn("t", F.round("t", 6))
    means = windows.object_means(trajectory.speeds(points_), period, window)
    batch = means.groupBy("tick", "road").agg(F.avg("m").alias("speed"), F.count("*").alias("n"))
    want = {(int(r.tick), r.road): (round(r.speed, 4), r.n) for r in batch.collect() if r.tick <= last}
    assert got == want


def test_ranks_over_many_partitions(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        n = 200_000
        rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") * 7919 % n).alias("t"), F.col("id").alias("event_id"), F.lit("x").alias("other"))
        ranked = files.with_rank(rows, "t", "event_id")
        got = ranked.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank")).first()
        assert tuple(got) == (n, n, 1, n)
        # a row's place in the order of the whole input
        pairs = ranked.select("rank", "t", "event_id").orderBy("rank").toPandas()
        assert (pairs.sort_values(["t", "event_id"])["rank"].to_numpy() == pairs["rank"].to_numpy()).all()
        assert files.with_rank(rows.limit(0), "t").count() == 0
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/state.json"
    assert get_text(spark, path) is None
    for text in ("one", "two\nlines"):
        put_text(spark, path, text)
        assert get_text(spark, path) == text


@pytest.mark.parametrize(("value", "text"), [(-1.0, "-1"), (0.0, "0"), (12.3400001, "12.34"), (123456.7, "123457"), (1234567.0, "1.23457e+06"), (0.00001, "1e-05"), (10.0, "10"), (99.99999, "100")])
def test_six_digits(spark, value, text):
    assert spark.range(1).select(sinks.six_digits(F.lit(value))).first()[0] == text


def test_printed_views(spark):
    p = points(spark, [(1, 0.5, 450001.0, 4175001.0, 1), (1, 9.0, 450001.0, 4175001.0, 2), (2, 3.0, 450002.0, 4175002.0, 1)])
    assert [r.line for r in sinks.printed_points(p).orderBy("t").collect()][0] == "<0.5, 1, 450001, 4.175e+06>"
    assert {r.oid: r.line for r in sinks.printed_trajectories(p).collect()} == {1: "{(1 0) -> (2 9)}", 2: "{(1 3)}"}
    assert [tuple(r) for r in sinks.printed_cells(p, EngineConfig()).collect()] == [(0, "1, 2")]
    assert {r.oid: r.line for r in sinks.printed_synopses(segments.segments(p, "qid"), "qid").collect()} == {1: "(1)[0.5, 9]--->(2)[9, 9]", 2: "(1)[3, 3]"}
    ring = "array(named_struct('x', 450100d, 'y', 4175100d), named_struct('x', 450900d, 'y', 4175100d), named_struct('x', 450500d, 'y', 4175900d))"
    roads = spark.range(1, 8).selectExpr("cast(id as int) qid", f"{ring} AS ring")
    assert [tuple(r) for r in sinks.printed_cell_roads(roads, EngineConfig()).collect()] == [(0, 7)] and sinks.printed_cell_roads(roads, EngineConfig(), 7).count() == 0


def test_halves_go_away_from_zero():
    assert [controller.rounded(x) for x in (0.5, 1.5, 2.5, -0.5, -2.5, 2.4, -2.6)] == [1, 2, 3, -1, -3, 2, -3]
    # 0.5 / 100 * 100 = 0.5 goes up to 1, where halves to even would leave n as it is
    c = controller.Controller(100.0, 5.0, 1, prediction=2)
    c.active, c.n = True, 5
    assert c.step(0, 90, 1000) == 6


def test_controller_goes_on_from_its_state():
    loads = [0.9, 1.0, 1.2, 1.4, 1.3, 0.6, 0.5]
    whole, first = (controller.Controller(1.0, 0.05, 1, loads=3) for _ in range(2))
    want = [whole.step(t, x, 50) for t, x in enumerate(loads)]
    got = [first.step(t, x, 50) for t, x in enumerate(loads[:4])]
    second = controller.Controller(1.0, 0.05, 1, loads=3)
    second.resume(first.state())
    assert got + [second.step(t, x, 50) for t, x in enumerate(loads[4:], 4)] == want


def test_broadcast_or_not_is_the_same(spark, sf, monkeypatch):
    p, roads = tables.locations(spark, sf), tables.roads(spark, sf, both_ways=True)
    key = lambda: sorted((r.event_id, r.road) for r in trajectory.assign_roads(trajectory.with_previous(p), roads, EngineConfig()).select("event_id", "road").collect())
    want = key()
    monkeypatch.setattr(trajectory, "BROADCAST_VERTICES", 0)
    assert key() == want
