"""Summaries of item streams on Spark's own sketches; where there is none, the exact combinable aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_hitters(items: DataFrame, column: str, support: float) -> DataFrame:
    """Items with at least a share `support` of all rows and their exact counts, which a lossy count bounds from both sides."""
    n = items.count()
    return items.groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= support * n)


def top_items(items: DataFrame, column: str, k: int, counters: int = 10_000) -> DataFrame:
    """Approximate top k by a frequent-items sketch."""
    top = items.agg(F.expr(f"approx_top_k({column}, {k}, {counters})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias(column), F.col("t.count").alias("n"))


def members(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Membership: a semi-join, for which Spark builds its own Bloom filter where that pays."""
    return rows.join(known.select(key).distinct(), key, "left_semi")


def count_min(column: str, error: float = 0.001, confidence: float = 0.99, seed: int = 7) -> Column:
    """A mergeable count-min sketch in binary form."""
    return F.count_min_sketch(F.col(column), F.lit(error), F.lit(confidence), F.lit(seed))


def digest(column: str, j: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(column).cast("string"), F.lit(seed), j))


def hash_of(digest: Column) -> Column:
    """A number below 2^32."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def hash_rows(items: DataFrame, column: str, depth: int, seed: int) -> DataFrame:
    """items with each hash row j, a hash h and a sign of 1 or -1, by md5 of item, seed and j."""
    rows = items.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("__m", digest(column, F.col("j"), seed))
    return rows.withColumn("h", hash_of(F.col("__m"))).withColumn("sign", F.when(F.substring("__m", 9, 1) < "8", 1).otherwise(-1)).drop("__m")


def frequencies(items: DataFrame, column: str, error: float = 0.001, doubt: float = 0.01, seed: int = 7, most: int = 15) -> DataFrame:
    """(item, exact, count_min, multi_bloom, bloom, fast_ams): each item's count and its estimates read back from the sketches.

    The sketches have ceil(e / error) counters in each of ceil(ln(1 / doubt)) hash rows, made odd for the median; the counting Bloom
    filter has the same number of counters in one vector, where an item counts once in each of its counters. Both Bloom filters' counters
    stop at `most`, 4 bits, and answer so for all beyond. Null items aren't counted. The sketches are of a fixed size, so they are sent to every executor.
    """
    width, depth = math.ceil(math.e / error), math.ceil(math.log(1 / doubt)) // 2 * 2 + 1
    n = F.count("*")
    slot, place = (F.col("h") % width).alias("slot"), F.col("h") % (width * depth)
    stream = items.where(F.col(column).isNotNull()).select(F.col(column).alias("item"))
    counters = hash_rows(stream, "item", depth, seed).groupBy("j", slot).agg(n.alias("n"), F.sum("sign").alias("s"))
    asked = hash_rows(stream.groupBy("item").agg(n.alias("exact")), "item", depth, seed).select("item", "exact", "j", "sign", slot, place.alias("place"))
    vector = stream.select(F.explode(places("item", depth, width * depth, seed)).alias("place")).groupBy("place").agg(n.alias("b"))
    read = asked.join(F.broadcast(counters), ["j", "slot"]).join(F.broadcast(vector), "place")
    low = F.min("n")
    middle = F.array_sort(F.collect_list(F.col("sign") * F.col("s")))[depth // 2]
    return read.groupBy("item", "exact").agg(low.alias("count_min"), F.least(low, F.lit(most)).alias("multi_bloom"), F.least(F.min("b"), F.lit(most)).alias("bloom"), middle.alias("fast_ams"))


def places(column: str, depth: int, bits: int, seed: int) -> Column:
    """The places of an item in a Bloom filter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda j: hash_of(digest(column, j, seed)) % bits))


def bloom(items: DataFrame, column: str, bits: int = 8192, depth: int = 5, seed: int = 7) -> DataFrame:
    """A Bloom filter as its set bits (place), at most `bits` rows: filters merge by union and intersect by intersection of their bits."""
    return items.where(F.col(column).isNotNull()).select(F.explode(places(column, depth, bits, seed)).alias("place")).distinct()


def bloom_merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def bloom_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of bits in both: it has every common item, and no more than either filter has."""
    return a.intersect(b)


def bloom_contains(items: DataFrame, column: str, filter_: DataFrame, bits: int = 8192, depth: int = 5, seed: int = 7) -> DataFrame:
    """The distinct items that the filter may have; no item that it was given is missing. The set bits are at most `bits`, hence sent
    to every executor as one array."""
    known = filter_.agg(F.sort_array(F.collect_list("place")).alias("known"))
    asked = items.where(F.col(column).isNotNull()).select(column).distinct()
    return asked.join(F.broadcast(known)).where(F.size(F.array_except(places(column, depth, bits, seed), "known")) == 0).select(column)


def distinct_sketch(column: str, precision: int = 14) -> Column:
    return F.hll_sketch_agg(column, F.lit(precision))


def distinct_estimate(sketches: DataFrame, column: str) -> DataFrame:
    """The number of distinct items of all merged sketches."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg(column)).alias("estimate"))


def second_moment_sketch(items: DataFrame, column: str, error: float = 0.001, doubt: float = 0.01, seed: int = 7) -> DataFrame:
    """One row: exact, the sum of squared counts, and estimate, the median over hash rows of the counters' sums of squares."""
    width, depth = math.ceil(math.e / error), math.ceil(math.log(1 / doubt)) // 2 * 2 + 1
    stream = items.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("item")).agg(F.count("*").alias("n"))
    counters = hash_rows(stream, "item", depth, seed).groupBy("j", (F.col("h") % width).alias("slot")).agg(F.sum(F.col("sign") * F.col("n")).alias("s"))
    rows = counters.groupBy("j").agg(F.sum(F.col("s") * F.col("s")).alias("f2"))
    estimate = rows.agg(F.array_sort(F.collect_list("f2"))[depth // 2].alias("estimate"))  # a number per hash row
    return second_moment(items.where(F.col(column).isNotNull()), column).select(F.col("f2").alias("exact")).join(F.broadcast(estimate))


def second_moment(items: DataFrame, column: str) -> DataFrame:
    return items.groupBy(column).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("f2"))


def distinct_by_item(rows: DataFrame, item: str, key: str) -> DataFrame:
    """Frequencies that don't count a key twice."""
    return rows.groupBy(item).agg(F.approx_count_distinct(key, 0.01).alias("estimate"), F.countDistinct(key).alias("exact"))


def quantiles(rows: DataFrame, column: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    return rows.agg(F.percentile_approx(column, shares, accuracy).alias("quantiles"))


def distinct_quantiles(rows: DataFrame, key: str, column: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """Quantiles that don't count a key twice."""
    return quantiles(rows.dropDuplicates([key]), column, shares, accuracy)


def distinct_ranks(rows: DataFrame, key: str, column: str, shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """(share, value, below, upto, n): each quantile that doesn't count a key twice, how many of the n keys have less and how many at most
    its value. A key's value is the least of its rows, so that repeated rows change nothing; a key without a value doesn't count."""
    keys = rows.where(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias("v"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("quantiles").alias("value")))
    q = distinct_quantiles(keys, key, "v", shares, accuracy).select(each.alias("q")).select("q.share", "q.value")
    less, most = ((F.col("v") < F.col("value")).cast("long"), (F.col("v") <= F.col("value")).cast("long"))
    return keys.join(F.broadcast(q)).groupBy("share", "value").agg(F.sum(less).alias("below"), F.sum(most).alias("upto"), F.count("*").alias("n"))


def digest_of(column: str) -> Column:
    """A quantile sketch in binary form."""
    return F.expr(f"kll_sketch_agg_double({column})")


def merged(a: str, b: str) -> Column:
    return F.expr(f"kll_sketch_merge_double({a}, {b})")


def rank_of(sketch: str, value: str) -> Column:
    """The share of rows up to a value."""
    return F.expr(f"kll_sketch_get_rank_double({sketch}, {value})")


def quantiles_of(sketch: str, shares: list[float]) -> Column:
    return F.expr(f"kll_sketch_get_quantile_double({sketch}, array({', '.join(f'{s}D' for s in shares)}))")


def rank(rows: DataFrame, column: str, value: float) -> DataFrame:
    return rows.agg(digest_of(column).alias("s")).select(rank_of("s", f"{value}D").alias("rank"))


def median(column: str) -> Column:
    return F.median(column)
