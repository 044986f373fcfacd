"""The run under load control: the batch against a plain fold, the stream against the batch."""

import math

import pytest
from pyspark.sql import functions as F

from streetflow.config import EngineConfig
from streetflow.operators.controller import Controller
from streetflow.plans import adaptive
from streetflow.plans.speeds import speed_query
from streetflow.sources import files, tables
from streetflow.streaming import speeds as streaming

PERIOD, RANGE = 432_000, 864_000
COUNTS = ("t", "total", "newbies", "tuples", "processed", "evicted", "profitable", "active", "so_far", "used", "next", "cycles_over", "cycles_under", "loads")


def config(**more):
    return EngineConfig(**({"period": PERIOD, "slide": PERIOD, "range": RANGE, "capacity_percent": 60, "loads": 3, "scheme": 2} | more))


def inputs(spark, sf):
    roads = tables.roads(spark, sf).join(tables.active(spark, sf), "qid", "left_semi")
    return tables.locations(spark, sf), roads.withColumn("range", F.lit(RANGE).cast("long")).withColumn("slide", F.lit(PERIOD).cast("long"))


def plain(points, roads, c, unit):
    """The run by loops over lists: telemetry rows and answers."""
    stored, kept, seen, last, out, answers, ls, so_far, over, under = [], None, set(), {}, [], {}, 0.0, 0, 0, 0
    control = Controller(c.capacity, c.band, c.period, c.loads, c.prediction)
    points = sorted(points)
    held_by = lambda x, y: any(inside(ring, x, y) for ring in roads.values())
    for k in range(math.ceil(max(p[0] for p in points) / c.period) + 1):
        tick, came = k * c.period, [p for p in points if math.ceil(p[0] / c.period) == k]
        before, processed, new = list(stored), 0, 0
        for t, _, oid, x, y, qid in came:
            first, prev = oid not in seen, last.get(oid)
            last[oid] = (t, x, y)
            seen.add(oid)
            new += first
            if not first and kept is not None and oid not in kept:
                continue
            processed += 1
            v = 0.0 if first else None if t == prev[0] else 3.6 * math.hypot(x - prev[1], y - prev[2]) / (t - prev[0])
            if first or (held_by(x, y) and (v is None or v <= 130)):
                stored.append((t, oid, qid, v))
        window = [p for p in stored if p[0] >= tick - c.range]
        mean = {}
        for _, oid, qid, v in window:
            if v is not None and qid:
                mean.setdefault((qid, oid), []).append(v)
        if tick >= c.range:
            for qid in roads:
                m = [sum(v) / len(v) for (q, _), v in mean.items() if q == qid]
                answers[tick, qid] = (-1.0 if not m or sum(m) <= 0.001 else sum(m) / len(m), len(m))
        load = (processed + len(window)) / unit + ls
        used = control.n if control.active else len(seen)
        n = control.step(tick, load, len(seen))
        kept = None if n is None else kept if not control.turn else set(sorted(seen)[: max(n, 0)])
        ls, over, under = len(seen) / unit if control.turn else 0.0, over + (control.turn == "over"), under + (control.turn == "under")
        gone = sum(tick - c.period - c.range <= p[0] < tick - c.range for p in before + stored[len(before) :])
        out.append((tick, len(seen), new, len(came), processed, gone, len({o for _, o in mean}), len({p[2] for p in came}), so_far, used, n, over, under, len(control.history)))
        so_far += len(came)
    return out, answers


def inside(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[-1:] + ring[:-1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


def told(run):
    rows = sorted(tuple(r) for r in run.telemetry().select(*COUNTS).collect())
    return rows, {(r.t, r.qid): (round(r.speed, 6), r.num_objects) for r in run.results().collect()}


def test_run_is_the_plain_fold(spark, sf):
    p, roads = inputs(spark, sf)
    unit = 0.4 * p.count()
    rows = [(r.t, r.event_id, r.oid, r.x, r.y, r.qid) for r in p.collect()]
    rings = {r.qid: [(v.x, v.y) for v in r.ring] for r in roads.collect()}
    want, answers = plain(rows, rings, config(), unit)
    got, speeds = told(adaptive.adaptive_query(p, roads, config(), adaptive.work(unit)))
    assert got == want and any(r[-3] for r in got)  # some cycle was overloaded
    assert speeds == {k: (round(v, 6), n) for k, (v, n) in answers.items()}


def test_run_without_shedding_is_the_query(spark, sf):
    p, roads = inputs(spark, sf)
    run = adaptive.adaptive_query(p, roads, config(scheme=0))
    want = {(r.t, r.qid): (round(r.speed, 6), r.num_objects) for r in speed_query(p, roads, config()).collect()}
    assert told(run)[1] == want
    assert run.telemetry().where("up_time > 0 AND ev_time > 0 AND ls_time = 0 AND load = up_time + ev_time").count() == run.telemetry().count()


@pytest.mark.parametrize("scheme", [1, 3, 4, 5, 6])
def test_schemes_shed(spark, sf, scheme):
    p, roads = inputs(spark, sf)
    p = p.where("t < 1800000")
    run = adaptive.adaptive_query(p, roads, config(scheme=scheme, first_criterion=1), adaptive.work(0.4 * p.count()))
    rows = run.telemetry().orderBy("t").collect()
    assert any(r.shed for r in rows) and all(r.processed <= r.tuples for r in rows) and any(r.processed < r.tuples for r in rows)


def stream_of(spark, p, folder, parts=3):
    """The points as text files in order of time."""
    rows = p.select("t", "oid", "x", "y", "qid").orderBy("t").toPandas()
    folder.mkdir()
    size = -(-len(rows) // parts)
    for k in range(parts):
        rows.iloc[k * size : (k + 1) * size].to_csv(folder / f"{k}.csv", sep=" ", header=False, index=False, float_format="%.6f")
    return files.locations_stream(spark, str(folder))


def test_stream_is_the_run_and_survives_a_stop(spark, sf, tmp_path):
    p, roads = inputs(spark, sf)
    p = p.withColumn("t", F.round("t", 6))
    unit, folder = 0.4 * p.count(), f"file://{tmp_path}/run"
    batch = adaptive.adaptive_query(p, roads, config(), adaptive.work(unit))
    source = stream_of(spark, p, tmp_path / "in")
    steps, real = [], adaptive.Run.step

    def stops(self, cycle, came):
        steps.append(cycle)
        if cycle == 3:
            raise RuntimeError("lost")
        real(self, cycle, came)

    writer, _ = streaming.adaptive(source, roads, config(), folder, adaptive.work(unit))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(adaptive.Run, "step", stops)
        with pytest.raises(Exception, match="lost"):
            writer.trigger(availableNow=True).start().awaitTermination(300)
    writer, finish = streaming.adaptive(files.locations_stream(spark, str(tmp_path / "in")), roads, config(), folder, adaptive.work(unit))
    writer.trigger(availableNow=True).start().awaitTermination(300)
    assert told(finish()) == told(batch)
    assert steps[-1] == 3


def test_declared_stream_reports_as_the_batch(spark, sf, tmp_path):
    p, roads = inputs(spark, sf)
    p = p.withColumn("t", F.round("t", 6))
    end = p.agg(F.max("t")).first()[0]
    source = stream_of(spark, p, tmp_path / "in", 2)
    (tmp_path / "in" / "9.csv").write_text(f"{end + 10 * RANGE:.6f} 999999 0 0 0\n")  # moves the watermark past all ticks
    for kind in ("avg", "max"):
        out = streaming.reported(streaming.road_speeds(streaming.stored(streaming.speeds(source), roads, config()), PERIOD, RANGE, kind), roads, kind)
        q = out.writeStream.format("memory").queryName(f"reported_{kind}").outputMode("append").option("checkpointLocation", str(tmp_path / kind)).trigger(availableNow=True).start()
        q.awaitTermination(300)
        last = math.ceil(end / PERIOD) * PERIOD
        got = {(r.t, r.qid): (round(r.speed, 4), r.num_objects) for r in spark.table(f"reported_{kind}").collect() if r.t <= last}
        want = {(r.t, r.qid): (round(r.speed, 4), r.num_objects) for r in speed_query(p, roads, config(), kind, zero_fill=False).collect()}
        assert got == want


def test_late_points_and_forgotten_objects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.csv").write_text("10 1 0 0 1\n20 1 10 0 1\n")
    (tmp_path / "in" / "1.csv").write_text("15 1 99 0 1\n30 1 20 0 1\n")  # the first is older than the object's last point
    (tmp_path / "in" / "2.csv").write_text("5000 2 0 0 1\n")
    (tmp_path / "in" / "3.csv").write_text("6000 1 0 0 1\n")
    for k in range(4):
        import os

        os.utime(tmp_path / "in" / f"{k}.csv", (1000 + k, 1000 + k))
    out = streaming.speeds(files.locations_stream(spark, str(tmp_path / "in")), "100 seconds", expire=1000)
    q = out.writeStream.format("memory").queryName("late_points").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted((r.t, r.oid, r.first, r.v) for r in spark.table("late_points").collect())
    assert got == [(10.0, 1, True, 0.0), (20.0, 1, False, 3.6), (30.0, 1, False, 3.6), (5000.0, 2, True, 0.0), (6000.0, 1, True, 0.0)]
