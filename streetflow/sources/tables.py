"""The engine's inputs from the driver's tables: events are the object stream, nations the roads, suppliers the road axes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: microseconds of the first event's day since 1970
EPOCH_US = 1704067200000000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, oid, t, x, y, qid (the file's label, 0 for no road)."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("oid"), F.col("ts").cast("timestamp_ntz").alias("ts"), "value", k.alias("k"))
    # the difference of local timestamps doesn't depend on the session's time zone
    t = F.expr(f"(unix_micros(to_utc_timestamp(ts, current_timezone())) - {EPOCH_US}) / 1e6d")
    return e.select("event_id", "oid", t.alias("t"), (450000 + 80 * F.col("value")).alias("x"), (4175000 + 500 * F.col("k")).alias("y"), ((F.col("oid") + F.col("k").cast("int")) % 26).cast("int").alias("qid"))


def roads(spark: SparkSession, sf_dir: str, global_window: bool = True, both_ways: bool = False) -> DataFrame:
    """25 disjoint trapezoids; with both_ways the same again, 25 higher, in the other direction."""
    i, cx, cy = "n_nationkey", "(450000d + 10000d * (n_nationkey % 5))", "(4175000d + 10000d * floor(n_nationkey / 5))"
    point = lambda x, y: f"named_struct('x', {cx} + {x}d, 'y', {cy} + {y}d)"
    odd = "n_regionkey % 2 = 1"
    out = read(spark, sf_dir, "nation").selectExpr(
        "cast(0 AS bigint) AS t", f"cast({i} + 1 AS int) AS qid", "cast(n_regionkey AS int) AS cid",
        "86400L AS range" if global_window else "43200L * (1 + n_regionkey % 2) AS range",
        "21600L AS slide" if global_window else "21600L * (1 + n_regionkey % 2) AS slide",
        f"if({odd}, {point(9500, 5000)}, {point(500, 5000)}) AS start", f"if({odd}, {point(500, 5000)}, {point(9500, 5000)}) AS end",
        f"array({point(500, 500)}, {point(9500, 500)}, {point(8500, 9500)}, {point(1500, 9500)}) AS ring",
    )
    if both_ways:
        out = out.union(out.select("t", (F.col("qid") + 25).alias("qid"), "cid", "range", "slide", F.col("end").alias("start"), F.col("start").alias("end"), "ring"))
    return out


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").where("n_regionkey <> 3").select((F.col("n_nationkey") + 1).cast("int").alias("qid"))


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    slide = 30 * (1 + F.col("n_regionkey") % 4)
    return s.select((F.col("s_nationkey") + 1).cast("int").alias("qid"), (10 * slide).cast("int").alias("win_range"), slide.cast("int").alias("win_slide"), (1 + F.col("n_regionkey") % 4).cast("int").alias("category"), (F.abs("s_acctbal") / 10).cast("double").alias("length"))
