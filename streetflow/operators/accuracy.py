"""Errors of a shed run against the exhaustive one, in all and by road class or length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(shed: DataFrame, full: DataFrame, positive: bool = False, since: float | None = None, until: float | None = None) -> DataFrame:
    """(t, qid, diff, relative): absolute and relative error where both have an answer."""
    ok = (lambda c: F.col(c) > 0) if positive else (lambda c: F.col(c) >= 0)
    both = shed.select("t", "qid", F.col("speed").alias("a")).join(full.select("t", "qid", F.col("speed").alias("b")), ["t", "qid"]).where(ok("a") & ok("b"))
    if since is not None:
        both = both.where(F.col("t") >= since)
    if until is not None:
        both = both.where(F.col("t") <= until)
    return both.select("t", "qid", F.abs(F.col("a") - F.col("b")).alias("diff"), F.try_divide(F.abs(F.col("a") - F.col("b")), F.col("b")).alias("relative"))


def summary(diffs: DataFrame, digits: int = 3) -> DataFrame:
    return diffs.agg(F.round(F.avg("diff"), digits).alias("avg_error"), F.round(F.stddev_samp("diff"), digits).alias("std_error"))


def large(diffs: DataFrame, more_than: float) -> DataFrame:
    return diffs.where(F.col("diff") > more_than).orderBy("t", F.desc("diff"), "qid")


def slide_of_road(axes: DataFrame) -> DataFrame:
    return axes.groupBy("qid").agg(F.min("win_slide").alias("win_slide"))


def roads_of_class(axes: DataFrame) -> DataFrame:
    return axes.groupBy("win_range", "win_slide").agg(F.countDistinct("qid").alias("roads"))


def length_of_road(axes: DataFrame) -> DataFrame:
    return axes.groupBy("qid").agg(F.sum("length").alias("length"))


def length_class(length: Column) -> Column:
    return F.when(length < 200, "1: <200").when(length < 500, "2: 200-500").when(length < 1000, "3: 500-1000").when(length < 2000, "4: 1000-2000").otherwise("5: 2000+")


def stats(grouped) -> DataFrame:
    return grouped.agg(F.count("diff").alias("answers"), F.max("diff").alias("max_error"), F.avg("diff").alias("avg_error"), F.stddev_samp("diff").alias("std_error"))


def by_class(diffs: DataFrame, axes: DataFrame) -> DataFrame:
    """Errors by reporting class, with the number of roads of the class."""
    joined = diffs.join(slide_of_road(axes), "qid").join(roads_of_class(axes), "win_slide")
    return stats(joined.groupBy("win_slide", "roads"))


def by_length(diffs: DataFrame, axes: DataFrame) -> DataFrame:
    return stats(diffs.join(length_of_road(axes), "qid").groupBy(length_class(F.col("length")).alias("length_class")))


def answered(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("answers"), F.sum((F.col("speed") >= 0).cast("long")).alias("with_speed"))
