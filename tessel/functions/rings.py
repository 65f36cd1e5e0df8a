"""Polygons as array<struct<x, y>> columns, with higher-order functions; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions.boxes import Box, clamp


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def move(ring: Column, f) -> Column:
    """Each point through f(x, y) -> (x, y)."""
    return F.transform(ring, lambda p: _point(*f(p["x"], p["y"])))


def scale(ring: Column, w, h) -> Column:
    """P2 with the inverses of an image's size; P24 without a pad."""
    return move(ring, lambda x, y: (x * w, y * h))


def unletterbox(ring: Column, gain: float, pad_w: float, pad_h: float, w: float, h: float) -> Column:
    """Points of the letterboxed image back on the original, clipped to it."""
    return move(ring, lambda x, y: (clamp((x - pad_w) / gain, 0.0, w), clamp((y - pad_h) / gain, 0.0, h)))


def clip(ring: Column, w: float, h: float) -> Column:
    """P26."""
    return move(ring, lambda x, y: (clamp(x, 0.0, w), clamp(y, 0.0, h)))


def project(ring: Column, m: list[list[float]]) -> Column:
    """Points under a 3 x 3 matrix."""

    def f(x, y):
        u, v, s = (m[i][0] * x + m[i][1] * y + m[i][2] for i in range(3))
        return u / s, v / s

    return move(ring, f)


def bounds(ring: Column) -> Box:
    """The box around the points."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def bounds_inside(ring: Column, w: float, h: float) -> Box:
    """P20: the box around the vertices in the image; all zero if there is none.

    Vertices are clamped first where at least three of the four sides of the ring overshoot the image.
    """
    b = bounds(ring)
    over = (b.a < 0).cast("int") + (b.b < 0).cast("int") + (b.c > w).cast("int") + (b.d > h).cast("int")
    used = F.when(over >= 3, clip(ring, w, h)).otherwise(ring)
    kept = F.filter(used, lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= w) & (p["y"] <= h))
    b = bounds(kept)
    some = F.exists(kept, lambda p: p["x"] != 0)
    return Box(*(F.when(some, c).otherwise(0.0) for c in b))


def area(ring: Column) -> Column:
    """The shoelace area."""
    n = F.size(ring)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2


def valid(ring: Column) -> Column:
    """At least three vertices, a triangle not on a line."""
    return (F.size(ring) > 3) | ((F.size(ring) == 3) & (area(ring) > 1e-10))


def centre_inside(ring: Column, w: float, h: float) -> Column:
    """P52, its test: the mean of the vertices lies in the image."""
    n = F.size(ring)
    x = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["x"]) / n
    y = F.aggregate(ring, F.lit(0.0), lambda a, p: a + p["y"]) / n
    return (n >= 3) & (x >= 0) & (x < w) & (y >= 0) & (y < h)


def resample(ring: Column, n: int) -> Column:
    """N points at equal steps of the vertex number along the closed ring, linear between vertices."""
    last = F.size(ring)

    def at(i):
        t = i * last / F.lit(float(n - 1))
        k = F.least(F.floor(t).cast("int"), last - 1)
        a, b = F.get(ring, k), F.get(ring, (k + 1) % last)
        return _point(a["x"] + (b["x"] - a["x"]) * (t - k), a["y"] + (b["y"] - a["y"]) * (t - k))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def runs(ring: Column, height: int, width: int) -> Column:
    """The pixels whose centres a polygon holds, by the even-odd rule, as an array of row, start and stop.

    Runs are half-open and clipped to the raster, so a mask takes room by its outline and not by its raster. A ring of
    less than three points holds none, a null one is null.
    """
    n = F.size(ring)
    sides = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, (i + 1) % n).alias("b")))
    box = bounds(ring)
    low, high = F.greatest(F.ceil(box.b - 0.5), F.lit(0)).cast("int"), F.least(F.ceil(box.d - 0.5), F.lit(height)).cast("int") - 1

    def crossings(y):
        hit = F.filter(sides, lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
        return F.array_sort(F.transform(hit, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))

    def between(line):
        edge = lambda k: F.greatest(F.least(F.ceil(F.get(line["x"], k) - 0.5), F.lit(width)), F.lit(0)).cast("int")
        pairs = F.when(F.size(line["x"]) > 1, F.sequence(F.lit(0), F.size(line["x"]) - 2, F.lit(2)))
        return F.transform(pairs, lambda k: F.struct(line["row"].alias("row"), edge(k).alias("start"), edge(k + 1).alias("stop")))

    lines = F.transform(F.sequence(low, high), lambda r: F.struct(r.alias("row"), crossings(r + 0.5).alias("x")))
    found = F.filter(F.flatten(F.filter(F.transform(lines, between), lambda a: a.isNotNull())), lambda r: r["stop"] > r["start"])
    return F.when(ring.isNull(), None).when((n > 2) & (low <= high), found).otherwise(F.array().cast("array<struct<row:int,start:int,stop:int>>"))


def text(ring: Column, digits: int = 6) -> Column:
    """The coordinates in turn with fixed digits, separated by spaces."""
    return F.array_join(F.flatten(F.transform(ring, lambda p: F.array(F.format_string(f"%.{digits}f", p["x"]), F.format_string(f"%.{digits}f", p["y"])))), " ")


def close(ring: Column) -> Column:
    """O3: the first point again at the end."""
    return F.concat(ring, F.array(F.get(ring, F.lit(0))))
