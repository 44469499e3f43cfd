"""Boxes and polygons as columns: the R-tree's queries are filters and grid joins, polygons arrays of x and y."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLYGON = "array<struct<x:double,y:double>>"
Box = list[tuple[Column, Column]]


def within_box(box: Box, query: list[tuple[float, float]]) -> Column:
    return _all([(lo >= q0) & (hi <= q1) for (lo, hi), (q0, q1) in zip(box, query, strict=True)])


def overlaps(box: Box, query: list[tuple]) -> Column:
    return _all([(lo <= q1) & (hi >= q0) for (lo, hi), (q0, q1) in zip(box, query, strict=True)])


def volume(box: Box) -> Column:
    out = F.lit(1.0)
    for lo, hi in box:
        out = out * (hi - lo)
    return out


def union(a: Box, b: Box) -> Box:
    return [(F.least(x[0], y[0]), F.greatest(x[1], y[1])) for x, y in zip(a, b, strict=True)]


def enlargement(a: Box, b: Box) -> Column:
    return volume(union(a, b)) - volume(a)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def polygon(*points: tuple) -> Column:
    """Of pairs of columns."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def edges(p: Column) -> Column:
    """Each vertex with the next one, closing the ring."""
    return F.transform(p, lambda v, i: F.struct(v.alias("a"), F.element_at(p, ((i + 1) % F.size(p) + 1).cast("int")).alias("b")))


def cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def signed_area(p: Column) -> Column:
    return F.aggregate(edges(p), F.lit(0.0), lambda s, e: s + cross(e)) / 2


def area(p: Column) -> Column:
    return F.abs(signed_area(p))


def ccw(p: Column) -> Column:
    """Counter-clockwise, reversed if it is not."""
    return F.when(signed_area(p) >= 0, p).otherwise(F.reverse(p))


def bbox(p: Column) -> Box:
    xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
    return [(F.array_min(xs), F.array_max(xs)), (F.array_min(ys), F.array_max(ys))]


def contains(p: Column, x: Column, y: Column) -> Column:
    """By the number of edges that a ray to the right crosses."""
    hit = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.aggregate(edges(p), F.lit(0), lambda s, e: s + F.when(hit(e), 1).otherwise(0)) % 2 == 1


def within(inner: Column, outer: Column) -> Column:
    return F.forall(inner, lambda v: contains(outer, v["x"], v["y"])) & ~crossing(inner, outer)


def crossing(p: Column, q: Column) -> Column:
    """Whether any edges cross."""
    side = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    cut = lambda e, f: (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)
    return F.exists(edges(p), lambda e: F.exists(edges(q), lambda f: cut(e, f)))


def overlap(p: Column, q: Column) -> Column:
    return crossing(p, q) | F.exists(p, lambda v: contains(q, v["x"], v["y"])) | F.exists(q, lambda v: contains(p, v["x"], v["y"]))


def transformed(p: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> Column:
    """x' = a x + b y + e, y' = c x + d y + f."""
    return F.transform(p, lambda v: F.struct((v["x"] * a + v["y"] * b + e).alias("x"), (v["x"] * c + v["y"] * d + f).alias("y")))


def regular(x: Column, y: Column, r: Column, n: int) -> Column:
    import math

    return polygon(*[(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)])


def svg(p: Column) -> Column:
    points = F.array_join(F.transform(p, lambda v: F.concat_ws(",", v["x"].cast("string"), v["y"].cast("string"))), " ")
    return F.concat(F.lit("<polyline points='"), points, F.lit("'></polyline>"))


def group_bbox(p: Column) -> list[Column]:
    """Aggregates: least x, largest x, least y, largest y."""
    (x0, x1), (y0, y1) = bbox(p)
    return [F.min(x0), F.max(x1), F.min(y0), F.max(y1)]
