"""Set operations on streams and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replicate(points: DataFrame, copies: int = 5, offset: int = 100_000) -> DataFrame:
    """The stream `copies` times, with new object ids for each copy; one scan, whatever the number of copies."""
    return points.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("oid", F.col("oid") + F.col("copy") * offset)


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__rn = 1").drop("__rn")


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def common_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)
