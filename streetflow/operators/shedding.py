"""Load shedding: which n trajectories stay. Random choices order by md5 of id and seed, alike on every engine and run."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streetflow.operators.joins import small
from streetflow.operators.trajectory import chance, latest
from streetflow.sources.files import with_rank
from streetflow.storage import table


def shuffled(key: str = "oid", seed: int = 7) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def first(ids: DataFrame, n: int) -> DataFrame:
    """Any n ids: those first in an order that has no meaning, but is the same each time."""
    return ids.orderBy(shuffled(seed=0), "oid").limit(max(n, 0)).select("oid")


def smallest_ids(ids: DataFrame, n: int) -> DataFrame:
    return ids.orderBy("oid").limit(max(n, 0)).select("oid")


def random(ids: DataFrame, n: int, seed: int = 7) -> DataFrame:
    return ids.orderBy(shuffled(seed=seed), "oid").limit(max(n, 0)).select("oid")


def drop_random(ids: DataFrame, active: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Over-load: a random active - n of the active ids go."""
    surplus = max(active.count() - n, 0)
    return active.join(small(random(active, surplus, seed)), "oid", "left_anti").select("oid")


def top_up(ids: DataFrame, active: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Under-load: random ids that aren't active are added until n are."""
    missing = max(n - active.count(), 0)
    return active.select("oid").union(random(without(ids, active), missing, seed))


def without(ids: DataFrame, active: DataFrame) -> DataFrame:
    return ids.join(active.select("oid"), "oid", "left_anti")


def admit(new: DataFrame, active: DataFrame, known: int, n: int, seed: int = 7) -> DataFrame:
    """Admission of new objects (oid, t) in order of arrival to the active ids, as in reservoir sampling: the i-th is the (known + i)-th
    object of all. While these are fewer than n it is let in. After that it draws a place among all objects; a place of an active id,
    in order of id, lets it in instead of that one. Draws are hashes, so that all are made at once."""
    m = active.count()
    placed = with_rank(new.select("oid", "t"), "t", "oid").withColumn("size", F.col("rank") + known)
    drawn = placed.withColumn("place", F.floor(chance("oid", seed) * F.col("size"))).withColumn("free", F.col("size") < n)
    let_in = drawn.where(F.col("free") | (F.col("place") < m))
    lost = let_in.where(~F.col("free")).select("place").distinct()
    stays = with_rank(active.select("oid"), "oid").withColumn("place", F.col("rank") - 1).join(lost, "place", "left_anti")
    return stays.select("oid").union(let_in.select("oid"))


def semantic_scores(touched: DataFrame) -> DataFrame:
    """touched: distinct (oid, qid). An object scores the sum over its roads of 1 / objects on the road."""
    crowd = touched.groupBy("qid").agg(F.count("*").alias("crowd"))
    return touched.join(crowd, "qid").groupBy("oid").agg(F.sum(1 / F.col("crowd")).alias("score"))


def semantic(ids: DataFrame, touched: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """The n highest scores; objects on no road only where fewer than n are on one, in random order."""
    scored = ids.join(semantic_scores(touched), "oid", "left").select("oid", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    return scored.orderBy(F.desc("score"), shuffled(seed=seed), "oid").limit(max(n, 0)).select("oid")


def few_objects_threshold(touched: DataFrame, policy: int) -> int:
    """Policy 1: the mean crowd of a road, rounded down; policy k >= 2: the crowd at ascending rank floor(roads / k)."""
    crowds = touched.groupBy("qid").agg(F.count("*").alias("crowd"))
    if policy == 1:
        return int(crowds.agg(F.floor(F.avg("crowd"))).first()[0])
    if policy < 2:
        raise ValueError(f"policy {policy}")
    rank = crowds.count() // policy
    return with_rank(crowds, "crowd", "qid").where(F.col("rank") == rank + 1).first()["crowd"]


def sparse_first(ids: DataFrame, touched: DataFrame, n: int, threshold: int, seed: int = 7) -> DataFrame:
    """First criterion: objects on a road with at most `threshold` objects stay; the rest is filled by semantic score."""
    crowd = touched.groupBy("qid").agg(F.count("*").alias("crowd")).where(F.col("crowd") <= threshold)
    sparse = touched.join(crowd, "qid", "left_semi").select("oid").distinct()
    scored = ids.join(semantic_scores(touched), "oid", "left").join(sparse.withColumn("sparse", F.lit(1)), "oid", "left")
    scored = scored.select("oid", F.coalesce("sparse", F.lit(0)).alias("sparse"), F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    return scored.orderBy(F.desc("sparse"), F.desc("score"), shuffled(seed=seed), "oid").limit(max(n, 0)).select("oid")


def stratified(cells: DataFrame, n: int, seed: int = 7, less_one: bool = True) -> DataFrame:
    """cells: (oid, cell). Of each cell's objects a random quota: its share of n rounded up, less one but at least one if less_one."""
    total = cells.count()
    sizes = cells.groupBy("cell").agg(F.count("*").alias("size"))
    share = F.ceil(n * F.col("size") / max(total, 1))
    quota = F.greatest(F.lit(1), share - 1) if less_one else share
    w = Window.partitionBy("cell").orderBy(shuffled(seed=seed), "oid")
    return cells.withColumn("rn", F.row_number().over(w)).join(small(sizes.select("cell", quota.alias("quota"))), "cell").where("rn <= quota").select("oid", "cell")


def stratified_history(now: DataFrame, history: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Quotas from all objects ever in a cell; a cell takes them from its history first, then from its present objects."""
    ever = history.select("oid", "cell").distinct()
    total = ever.count()
    quota = ever.groupBy("cell").agg(F.ceil(n * F.count("*") / max(total, 1)).alias("quota"))
    both = ever.withColumn("late", F.lit(0)).union(now.select("oid", "cell").withColumn("late", F.lit(1))).groupBy("oid", "cell").agg(F.min("late").alias("late"))
    w = Window.partitionBy("cell").orderBy("late", shuffled(seed=seed), "oid")
    return both.withColumn("rn", F.row_number().over(w)).join(small(quota), "cell").where("rn <= quota").select("oid").distinct()


def systematic(ids: DataFrame, n: int, start: int = 0) -> DataFrame:
    """Every (ids / n)-th id in order of id, n at most."""
    skip = max(ids.count() // max(n, 1), 1)
    return with_rank(ids, "oid").withColumn("rn", F.col("rank") - 1).where((F.col("rn") >= start) & ((F.col("rn") - start) % skip == 0)).orderBy("rn").limit(n).select("oid")


def sample_by(cells: DataFrame, fractions: dict, seed: int = 7) -> DataFrame:
    """A random share of each stratum, by hash."""
    share = F.element_at(F.create_map(*[F.lit(v) for kv in fractions.items() for v in kv]), F.col("cell"))
    return cells.where(chance("oid", seed) < F.coalesce(share, F.lit(0.0))).select("oid", "cell")


def last_road_scores(points: DataFrame, since: float) -> DataFrame:
    """1 / crowd of the road of an object's last point; -10 for objects without a point since `since`."""
    last = latest(points, "qid", "t")
    crowd = last.where(F.col("qid") != 0).groupBy("qid").agg(F.count("*").alias("crowd"))
    score = F.when(F.col("t") <= since, -10.0).otherwise(F.coalesce(1 / F.col("crowd"), F.lit(0.0)))
    return last.join(small(crowd), "qid", "left").select("oid", score.alias("score"))


def roads_touched_scores(touched: DataFrame, last: DataFrame, since: float) -> DataFrame:
    """The number of roads an object has touched; -10 if inactive. last: (oid, t)."""
    n = touched.groupBy("oid").agg(F.countDistinct("qid").alias("n"))
    return last.join(n, "oid", "left").select("oid", F.when(F.col("t") <= since, -10.0).otherwise(F.coalesce("n", F.lit(0)).cast("double")).alias("score"))


def top(scores: DataFrame, n: int, seed: int = 7) -> DataFrame:
    return scores.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), shuffled(seed=seed), "oid").limit(max(n, 0)).select("oid")


def combined(scores: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """Half by score, the rest at random from the others."""
    best = top(scores, n // 2, seed)
    return best.union(random(without(scores.select("oid"), best), n - n // 2, seed))


def cell_scores(scores: DataFrame, last: DataFrame, since: float) -> DataFrame:
    """Scores by cell synopsis; -10 if inactive. last: (oid, t)."""
    return last.join(scores, "oid", "left").select("oid", F.when(F.col("t") <= since, -10.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def random_subset(spark, of: int, k: int, seed: int = 7) -> DataFrame:
    """k of the numbers 1..of."""
    return spark.range(1, of + 1).select(F.col("id").alias("oid")).transform(lambda d: random(d, k, seed)).select(F.col("oid").alias("id"))


def sampler_errors(items: DataFrame, k: int, every: int = 100, top: int = 20, seed: int = 7) -> DataFrame:
    """items: (i, item), i from 0 without gaps. After each `every` rows, the mean relative error with which a sample of k rows estimates
    the counts of the `top` most frequent items: (rows, error). The sample are the k rows of least hash up to there.

    No row is repeated for later steps: an item's count and its rows in the sample are sums of their changes, and a row changes the sample
    where it comes in and where it goes.
    """
    total = (items.agg(F.max("i")).first()[0] or 0) + 1
    stream = items.select(F.floor(F.col("i") / every).alias("step"), "i", "item")
    moves = sample_moves(stream, k, every, total, seed)
    changes = stream.select("step", "item", F.lit(1).alias("n"), F.lit(0).alias("taken")).union(moves.select("step", "item", F.lit(0), "taken"))
    changes = table(changes.groupBy("step", "item").agg(F.sum("n").alias("n"), F.sum("taken").alias("taken")))
    n = F.least((F.col("step") + 1) * every, F.lit(total))
    error = F.abs(F.col("taken") * n / F.least(n, F.lit(k)) - F.col("exact")) / F.col("exact")
    return running_top(changes, (total - 1) // every, top).groupBy(((F.col("step") + 1) * every).alias("rows")).agg(F.avg(error).alias("error"))


def sample_moves(stream: DataFrame, k: int, every: int, total: int, seed: int = 7) -> DataFrame:
    """stream: (step, i, item), `every` rows a step. (step, item, taken): 1 for each row that is in the sample of k rows after a step and
    wasn't before, -1 for each that is no longer.

    A row whose hash isn't below a share of about 2 k / (rows before) hardly ever comes in. Those below, some 2 k each time that the
    stream doubles, are sent to the driver, which checks that they hold the sample of every step, and asks for more otherwise.
    """
    low = F.pow(F.lit(2.0), F.length(F.bin("step")) - 1)  # the last power of two up to the step, 1 for step 0
    slack = 2 * k + 50
    while True:
        share = lambda p: slack / F.least(p * every, F.lit(total))  # noqa: E731, B023
        hashed = stream.withColumn("h", shuffled("i", seed)).withColumn("place", chance("i", seed))
        rows = hashed.where(F.col("place") < share(low)).select("step", "i", "item", "h", "place").toArrow().sort_by([("h", "ascending"), ("i", "ascending")])
        step, place = rows["step"].to_numpy(), rows["place"].to_numpy()
        # from 2^j on rows have one share, and until the next power the sample's hashes only fall
        shares = {first: slack / min(max(first, 1) * every, total) for first in [0, *(2**j for j in range(1, ((total - 1) // every).bit_length()))]}
        if all(x >= 1 or np.count_nonzero((step <= first) & (place < x)) >= k for first, x in shares.items()):
            break
        slack *= 2
    held, moves = [], []  # the sample as a heap, the greatest hash on top
    for now in np.unique(step):
        new = np.flatnonzero(step == now).tolist()
        for row in new:
            heapq.heappush(held, -row)
        gone = {-heapq.heappop(held) for _ in range(len(held) - k)}
        moves += [(now, row, 1) for row in new if row not in gone] + [(now, row, -1) for row in gone.difference(new)]
    at, row, taken = (pa.array([m[c] for m in moves], pa.int64()) for c in range(3))
    return stream.sparkSession.createDataFrame(pa.table({"step": at, "item": rows["item"].take(row), "taken": taken}))


def running_top(changes: DataFrame, last: int, top: int, base: int = 32) -> DataFrame:
    """changes: (step, item, n, taken), n never negative. (step, item, exact, taken): after each step up to `last`, the `top` items with the
    largest sums of n, the lesser of equal ones first, and their sums.

    Sums of units of steps, each a part of a larger one: in a unit only items can be on top that were at its begin or that come in it. So
    no step sees more than these, and no task a whole item.
    """
    item, width = F.col("item"), base
    while width <= last:
        width *= base
    zero = F.lit(0).cast("long")
    lead = changes.select("item").distinct().select(zero.alias("unit"), "item", zero.alias("exact"), zero.alias("had"))
    while width > 1:
        width //= base
        sums = changes.groupBy(F.floor(F.col("step") / width).alias("part"), item.alias("of")).agg(F.sum("n").alias("n"), F.sum("taken").alias("taken"))
        parts = F.sequence(F.col("unit") * base, F.least(F.col("unit") * base + base - 1, F.lit(last // width)))
        each = lead.withColumn("unit_part", F.explode(parts)).join(sums, (F.col("unit_part") == F.col("part")) & item.eqNullSafe(F.col("of")), "left")
        n, taken = F.coalesce("n", F.lit(0)), F.coalesce("taken", F.lit(0))
        until = Window.partitionBy("unit", "item").orderBy("unit_part").rowsBetween(Window.unboundedPreceding, 0)
        ended = each.select(F.col("unit_part").alias("unit"), "item", n.alias("n"), taken.alias("taken"), (F.col("exact") + F.sum(n).over(until)).alias("exact"), (F.col("had") + F.sum(taken).over(until)).alias("had"))
        if width > 1:  # back to the begin of each part
            ended = ended.withColumn("exact", F.col("exact") - F.col("n")).withColumn("had", F.col("had") - F.col("taken"))
        order = Window.partitionBy("unit").orderBy(F.desc("exact"), F.asc_nulls_last("item"))
        placed = ended.where((F.col("exact") > 0) | (F.col("n") > 0)).withColumn("place", F.row_number().over(order))
        lead = placed.where((F.col("place") <= top) | ((F.col("n") > 0) if width > 1 else F.lit(False))).select("unit", "item", "exact", "had")
    return lead.select(F.col("unit").alias("step"), "item", "exact", F.col("had").alias("taken"))


def sample_size(epsilon: float, delta: float) -> int:
    """Rows for frequencies within epsilon with probability 1 - delta."""
    import math

    return math.ceil(0.5 * math.log(2 / delta) / epsilon**2)


def frequency_estimates(items: DataFrame, k: int, seed: int = 7) -> DataFrame:
    """items: (i, item). Estimated frequency of each item in a uniform sample of k rows."""
    n = items.count()
    sample = items.orderBy(F.md5(F.concat(F.col("i").cast("string"), F.lit(f"|{seed}"))), "i").limit(k)
    return sample.groupBy("item").agg((F.count("*") * n / min(k, max(n, 1))).alias("estimate"))
