"""Queries that returned less than the whole job before, against all rows of plain Python or of their own SQL without its filter."""

import hashlib
import os
import random
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from streetflow import queries
from streetflow.config import EngineConfig
from streetflow.operators import shedding, sketches, trajectory, windows


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf}/{name}'")
    return con


def test_contributors_of_all_ticks(spark, sf, duck):
    got = {(r.tick, r.road): r.oids for r in queries.agg5_contributors(spark, sf).collect()}
    whole = queries.ORACLES["agg5_contributors"].replace(" WHERE tick % 432000 = 0", "")
    assert got == {(t, road): oids for t, road, oids in duck.sql(whole).fetchall()}
    # the same by hand: a stored point contributes to each tick whose window holds it
    points = queries.stored(spark, sf).where("v IS NOT NULL AND qid <> 0").select("oid", "t", "qid").collect()
    last = max(-(-r.t // 21600) for r in queries.stored(spark, sf).select("t").collect())
    sets = defaultdict(set)
    for r in points:
        k = -(-r.t // 21600)
        while k <= last and k * 21600 - 86400 <= r.t:
            sets[int(k * 21600), r.qid].add(r.oid)
            k += 1
    assert got == {k: ",".join(map(str, sorted(v))) for k, v in sets.items()}
    assert len({t % 432000 for t, _ in got}) == 20


def test_frequencies_are_read_back(spark):
    true = {i: 1 + 2000 // (i * i) for i in range(1, 601)}  # skewed: most items come once
    items = spark.createDataFrame([(i,) for i, n in true.items() for _ in range(n)] + [(None,)], "item long")
    got = sketches.frequencies(items, "item", 0.01, 0.01).collect()
    total, f2 = sum(true.values()), sum(n * n for n in true.values())
    assert {r.item: r.exact for r in got} == true
    assert all(r.count_min >= r.exact and min(r.exact, 15) <= min(r.multi_bloom, r.bloom) and max(r.multi_bloom, r.bloom) <= 15 for r in got)
    assert sum(r.count_min > r.exact + 0.01 * total for r in got) <= 0.01 * len(got)
    assert sum(abs(r.fast_ams - r.exact) > 3 * (f2 / 272) ** 0.5 for r in got) <= 0.01 * len(got)
    assert any(r.count_min != r.exact for r in got)  # 272 counters for 600 items: an estimate, not a count
    alone = sketches.frequencies(items.where("item <= 3"), "item").collect()
    assert all((r.count_min, r.fast_ams) == (r.exact, r.exact) for r in alone)


def test_boxes_of_all_pairs(spark, sf, duck):
    got = sorted(map(tuple, queries.fn7_boxes(spark, sf).select("a", "b", "meet", "has_center").collect()))
    whole = queries.ORACLES["fn7_boxes"].replace(" WHERE a.qid % 5 = b.qid % 5", "")
    assert len(got) == 625 and got == sorted(duck.sql(f"SELECT a, b, meet, has_center FROM ({whole})").fetchall())


def test_telemetry_counts_processed_and_stored_points(spark):
    rows = [(0, 1, 5.0), (1, 1, 10.0), (2, 1, 15.0), (3, 2, 12.0), (4, 2, 18.0), (5, 2, 25.0), (6, 2, 31.0)]
    p = trajectory.with_previous(spark.createDataFrame([(e, o, t, 0.0, 0.0, 1) for e, o, t in rows], "event_id long, oid long, t double, x double, y double, qid int"))
    means = windows.object_means(p.withColumn("v", F.lit(1.0)), 10, 20)
    got = lambda *more: {int(r.tick): (r.tuples, r.processed, r.stored) for r in windows.telemetry(p, means, 10, 20, 10, *more).collect()}
    stored = p.where("event_id NOT IN (1, 4)")
    assert got(stored) == {0: (0, 0, 0), 10: (2, 2, 1), 20: (3, 3, 2), 30: (1, 1, 1), 40: (1, 1, 1)}
    # object 1 is kept at tick 10, object 2 at 30 only
    history, config = spark.createDataFrame([(10, 1), (30, 2)], "cycle long, oid long"), EngineConfig(period=10)
    shed = trajectory.processed(p, history, config)
    assert sorted(r.event_id for r in shed.collect()) == [0, 2, 3, 6]
    assert got(trajectory.processed(stored, history, config), shed) == {0: (0, 0, 0), 10: (2, 1, 1), 20: (3, 2, 2), 30: (1, 0, 0), 40: (1, 1, 1)}


def test_distinct_quantiles_of_a_skewed_stream(spark):
    # key k has the value k and comes k * k times: of the rows, most belong to high keys
    keys = spark.range(1, 101).select(F.col("id").alias("k"), F.col("id").alias("v"))
    stream = keys.select("k", "v", F.explode(F.sequence(F.lit(1), F.col("k") * F.col("k"))).alias("i")).union(spark.createDataFrame([(None, 1, 1), (500, None, 1)], "k long, v long, i long"))
    shares = [0.25, 0.5, 0.75]
    got = {r.share: (r.value, r.below, r.upto, r.n) for r in sketches.distinct_ranks(stream, "k", "v", shares).collect()}
    assert got == {0.25: (25, 24, 25, 100), 0.5: (50, 49, 50, 100), 0.75: (75, 74, 75, 100)}
    assert got == {r.share: (r.value, r.below, r.upto, r.n) for r in sketches.distinct_ranks(stream.union(stream), "k", "v", shares).collect()}
    assert sketches.quantiles(stream, "v", [0.5]).first()[0][0] > 75  # what counting each row would give


def md5(i):
    return hashlib.md5(f"{i}|7".encode()).hexdigest()


def shuffled_rows(spark):
    """Rows that all stages so far have written for others."""
    jvm, none = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, none, jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}


@pytest.mark.parametrize("k", [3, 40, 5000])
def test_sampler_errors_without_a_row_for_each_step(spark, k):
    draw, every, top = random.Random(1), 10, 5
    rows = [None if draw.random() < 0.05 else int(draw.paretovariate(0.7)) % 10**9 for _ in range(4003)]  # some often, most once
    want, order = {}, lambda x: (x is None, x or 0)
    for end in range(every, len(rows) + every, every):
        n = min(end, len(rows))
        exact, taken = Counter(rows[:n]), Counter(rows[i] for i in sorted(range(n), key=lambda i: (md5(i), i))[:k])
        best = sorted(exact, key=lambda x: (-exact[x], order(x)))[:top]
        want[end] = sum(abs(taken[x] * n / min(n, k) - exact[x]) / exact[x] for x in best) / len(best)
    before = shuffled_rows(spark)
    got = shedding.sampler_errors(spark.createDataFrame(list(enumerate(rows)), "i long, item long"), k, every, top).collect()
    made = sum(n for stage, n in shuffled_rows(spark).items() if stage not in before)
    assert {r.rows: r.error for r in got} == pytest.approx(want) and len(got) == 401
    assert made < 100 * len(rows)  # a row for each later step were 200 times as many, each written more than once


def test_sample_moves_where_hashes_fall(spark):
    """Of the rows with the least hashes so far none is among those expected at first."""
    every, k = 100, 5
    falling = sorted(range(3200), key=md5, reverse=True)
    stream = spark.createDataFrame([(n // every, i, str(i)) for n, i in enumerate(falling)], "step long, i long, item string")
    sample, got = Counter(), shedding.sample_moves(stream, k, every, len(falling)).collect()
    for step in range(32):
        for r in got:
            if r.step == step:
                sample[r.item] += r.taken
        assert +sample == Counter(str(i) for i in falling[: (step + 1) * every][-k:]) and min(sample.values()) >= 0


def test_sampler_errors_of_no_rows(spark):
    assert shedding.sampler_errors(spark.createDataFrame([], "i long, item int"), 5, 10).collect() == []
    assert [tuple(r) for r in shedding.sampler_errors(spark.createDataFrame([(0, 3)], "i long, item int"), 5, 10).collect()] == [(10, 0.0)]
