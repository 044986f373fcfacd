"""Synthetic streams of numbers and items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: steps of a distribution that are sent to every executor
MOST_ITEMS = 1_000_000


def draw(seed: int) -> Column:
    """A number in [0, 1) for each id, alike on every engine; other ones than those by which samples are chosen."""
    return F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"|draw|{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform(spark: SparkSession, n: int, low: float, high: float, seed: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), (draw(seed) * (high - low) + low).alias("value"))


def gaussian(spark: SparkSession, n: int, mean: float, deviation: float, seed: int) -> DataFrame:
    """From two uniform numbers each, by their polar form."""
    u, v = 1 - draw(seed), draw(seed + 1)
    normal = F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * v)
    return spark.range(n).select(F.col("id").alias("i"), (normal * deviation + mean).alias("value"))


def zipf(spark: SparkSession, n: int, domain: int, skew: float, seed: int) -> DataFrame:
    """Items 1..domain (at most MOST_ITEMS) with probabilities proportional to item ** -skew, by inverting the distribution: a guide of
    as many equal slots as items names the steps in each, one on average, so that a draw compares with those of its own slot only."""
    if not 0 < domain <= MOST_ITEMS:
        raise ValueError(f"domain {domain}")
    weights = np.arange(1, domain + 1, dtype=float) ** -skew
    steps = np.cumsum(weights) / weights.sum()
    first = np.searchsorted(steps, np.arange(domain + 1) / domain, "right")  # steps up to each slot's begin
    guide = [(k, int(first[k]), steps[first[k] : first[k + 1]].tolist()) for k in range(domain)]
    slots = spark.createDataFrame(guide, "slot long, below long, steps array<double>")
    drawn = spark.range(n).select(F.col("id").alias("i"), draw(seed).alias("u")).withColumn("slot", F.floor(F.col("u") * domain))
    passed = F.col("below") + F.size(F.filter("steps", lambda c: c <= F.col("u")))
    return drawn.join(F.broadcast(slots), "slot").select("i", F.least(passed + 1, F.lit(domain)).cast("long").alias("item"))
