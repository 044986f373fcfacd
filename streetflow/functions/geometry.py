"""Planar geometry as Column expressions; no UDFs. Divisions that may be by zero give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def in_polygon(ring: Column, x: Column, y: Column) -> Column:
    """Ray crossing with half-open edges: of an axis-parallel square, the left and bottom edges are inside."""
    n = F.size(ring)

    def toggle(inside: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        spans = (a["y"] > y) != (b["y"] > y)
        crosses = x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return F.when(spans & crosses, ~inside).otherwise(inside)

    return F.when(n < 3, False).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(False), toggle))


def box_of(ring: Column) -> Column:
    """The ring's minimum bounding box."""
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max"))


def cell_steps(universe: Box, gran_x: int, gran_y: int) -> tuple[float, float]:
    x_min, y_min, x_max, y_max = universe
    return (x_max - x_min) / gran_x, (y_max - y_min) / gran_y


def cell_of(x: Column, y: Column, universe: Box, gran_x: int, gran_y: int) -> Column:
    """Row-major cell number; null outside the universe."""
    dx, dy = cell_steps(universe, gran_x, gran_y)
    i, j = F.floor((x - universe[0]) / dx), F.floor((y - universe[1]) / dy)
    return F.when((i >= 0) & (i < gran_x) & (j >= 0) & (j < gran_y), gran_x * j + i)


def cells_of(box: Column, universe: Box, gran_x: int, gran_y: int) -> Column:
    """The cells that a box overlaps, clipped to the universe."""
    dx, dy = cell_steps(universe, gran_x, gran_y)
    clip = lambda v, most: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(most - 1))
    i = F.sequence(clip((box["x_min"] - universe[0]) / dx, gran_x), clip((box["x_max"] - universe[0]) / dx, gran_x))
    j = F.sequence(clip((box["y_min"] - universe[1]) / dy, gran_y), clip((box["y_max"] - universe[1]) / dy, gran_y))
    return F.flatten(F.transform(j, lambda b: F.transform(i, lambda a: gran_x * b + a)))


def box_of_cell(cell: Column, universe: Box, gran_x: int, gran_y: int) -> Column:
    dx, dy = cell_steps(universe, gran_x, gran_y)
    i, j = cell % gran_x, F.floor(cell / gran_x)
    return F.struct((universe[0] + i * dx).alias("x_min"), (universe[1] + j * dy).alias("y_min"), (universe[0] + (i + 1) * dx).alias("x_max"), (universe[1] + (j + 1) * dy).alias("y_max"))


def heading_cosine(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The cosine between two vectors; null if one has no length."""
    return F.try_divide(x1 * x2 + y1 * y2, F.sqrt(x1 * x1 + y1 * y1) * F.sqrt(x2 * x2 + y2 * y2))


def box_has_point(box: Column, x: Column, y: Column) -> Column:
    return x.between(box["x_min"], box["x_max"]) & y.between(box["y_min"], box["y_max"])


def intervals_overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    return (a_min <= b_max) & (b_min <= a_max)


def boxes_intersect(a: Column, b: Column) -> Column:
    return intervals_overlap(a["x_min"], a["x_max"], b["x_min"], b["x_max"]) & intervals_overlap(a["y_min"], a["y_max"], b["y_min"], b["y_max"])


def box_contains(a: Column, b: Column) -> Column:
    return (a["x_min"] <= b["x_min"]) & (a["x_max"] >= b["x_max"]) & (a["y_min"] <= b["y_min"]) & (a["y_max"] >= b["y_max"])


# boxes of any dimension: two arrays, the lower and the upper bounds


def in_interval(v: Column, low: Column, high: Column) -> Column:
    return (v >= low) & (v <= high)


def in_box(v: Column, low: Column, high: Column) -> Column:
    return F.forall(F.arrays_zip(v.alias("v"), low.alias("l"), high.alias("h")), lambda p: (p["v"] >= p["l"]) & (p["v"] <= p["h"]))


def overlap_low(a_low: Column, b_low: Column) -> Column:
    return F.zip_with(a_low, b_low, lambda a, b: F.greatest(a, b))


def overlap_high(a_high: Column, b_high: Column) -> Column:
    return F.zip_with(a_high, b_high, lambda a, b: F.least(a, b))


def overlap_volume(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    sides = F.zip_with(overlap_low(a_low, b_low), overlap_high(a_high, b_high), lambda a, b: F.greatest(b - a, F.lit(0.0)))
    return F.aggregate(sides, F.lit(1.0), lambda product, side: product * side)


def sections_meet(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.forall(F.zip_with(overlap_low(a_low, b_low), overlap_high(a_high, b_high), lambda a, b: a <= b), lambda ok: ok)


# text


def split_tokens(text: Column, separator: str) -> Column:
    """Split at a character, without empty tokens."""
    return F.filter(F.split(text, f"[{separator}]"), lambda s: s != "")


def parse_ring(text: Column) -> Column:
    """x,y,x,y,... as a ring; an odd last number is left out."""
    a = F.transform(split_tokens(text, ","), lambda s: s.cast("double"))
    half = F.floor(F.size(a) / 2)
    return F.when(half < 1, F.expr("cast(array() AS array<struct<x:double,y:double>>)")).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), half - 1), lambda i: F.struct(F.get(a, 2 * i).alias("x"), F.get(a, 2 * i + 1).alias("y")))
    )


def ring_text(ring: Column) -> Column:
    return F.array_join(F.transform(ring, lambda v: F.format_string("%.6f %.6f", v["x"], v["y"])), ",")


# the sphere

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def arc_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same distance by the spherical law of cosines."""
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return EARTH_KM * F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))


# sets


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
