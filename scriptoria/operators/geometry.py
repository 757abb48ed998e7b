"""Quadrilaterals and polygons as arrays of struct(x, y), in expressions (GEO)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def polygon(*xy: Column) -> Column:
    """An array of points from x1, y1, x2, y2 and so on."""
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in zip(xy[::2], xy[1::2], strict=True)])


def turned(points: Column, by: int = 1) -> Column:
    """The same polygon, starting `by` points later."""
    return F.concat(F.slice(points, by + 1, F.size(points) - by), F.slice(points, 1, by))


def area(points: Column) -> Column:
    parts = F.zip_with(points, turned(points), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)) / 2


def perimeter(points: Column) -> Column:
    parts = F.zip_with(points, turned(points), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def turns(points: Column) -> Column:
    """Cross products at each corner."""
    pairs = F.zip_with(points, turned(points), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(pairs, turned(points, 2), lambda p, c: (p["b"]["x"] - p["a"]["x"]) * (c["y"] - p["b"]["y"]) - (p["b"]["y"] - p["a"]["y"]) * (c["x"] - p["b"]["x"]))


def is_convex(points: Column) -> Column:
    """Strictly: three points in a line are not."""
    t = turns(points)
    return F.forall(t, lambda x: x > 0) | F.forall(t, lambda x: x < 0)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it: an array of one binds it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def ordered_corners(points: Column) -> Column:
    """Corners by angle about their centre, beginning with the least x + y; null unless there are four."""
    mean = lambda ps, k: F.aggregate(ps, F.lit(0.0), lambda s, p: s + p[k]) / F.size(ps)

    def by_angle(ps: Column, c: Column) -> Column:
        turned_to = F.array_sort(F.transform(ps, lambda p: F.struct(F.atan2(p["y"] - c["y"], p["x"] - c["x"]).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
        return F.transform(turned_to, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))

    def begun(clean: Column) -> Column:
        first = bound(F.transform(clean, lambda p: p["x"] + p["y"]), lambda sums: F.array_position(sums, F.array_min(sums)).cast("int"))
        return bound(first, lambda k: F.concat(F.slice(clean, k, F.lit(4)), F.slice(clean, F.lit(1), k - 1)))

    centre = lambda ps: F.struct(mean(ps, "x").alias("x"), mean(ps, "y").alias("y"))
    ordered = bound(points, lambda ps: bound(centre(ps), lambda c: bound(by_angle(ps, c), begun)))
    return F.when(F.size(points) == 4, ordered)


def angles(points: Column) -> Column:
    """Degrees at each corner, beginning with the second point's."""
    pairs = F.zip_with(points, turned(points), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    def at(p: Column, c: Column) -> Column:
        ux, uy, vx, vy = p["a"]["x"] - p["b"]["x"], p["a"]["y"] - p["b"]["y"], c["x"] - p["b"]["x"], c["y"] - p["b"]["y"]
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / (F.hypot(ux, uy) * F.hypot(vx, vy))))))
    return F.zip_with(pairs, turned(points, 2), at)


def sides(points: Column) -> Column:
    return F.zip_with(points, turned(points), lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def valid_quad(points: Column, width: Column, height: Column, least_area: float = 0.1) -> Column:
    """Convex, large enough, no side below 12 % of the shorter edge, angles from 35 to 145 degrees."""
    ok = F.forall(angles(points), lambda a: (a >= 35) & (a <= 145)) & F.forall(sides(points), lambda s: s >= F.least(width, height) * 0.12)
    return is_convex(points) & (area(points) >= width * height * least_area) & ok


def target_size(points: Column, least: float, most: float) -> Column:
    """struct(w, h): the longer of opposite sides, scaled so that the long side is within bounds."""
    s = sides(points)
    w, h = F.greatest(s[0], s[2]), F.greatest(s[1], s[3])
    long = F.greatest(w, h)
    scale = F.when(long > most, F.lit(most) / long).when(long < least, F.lit(least) / long).otherwise(1.0)
    return F.struct(F.floor(w * scale + 0.5).alias("w"), F.floor(h * scale + 0.5).alias("h"))


def inside(points: Column, x: Column, y: Column) -> Column:
    """Whether a convex polygon holds a point, edges included."""
    s = F.zip_with(points, turned(points), lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
    return F.forall(s, lambda v: v >= 0) | F.forall(s, lambda v: v <= 0)


def lattice_iou(a: Column, b: Column, n: int = 240) -> Column:
    """Overlap of two convex polygons in the unit square, counted on n by n cell centres."""
    cells = F.sequence(F.lit(0), F.lit(n * n - 1))
    x, y = lambda i: (i % n + 0.5) / n, lambda i: (F.floor(i / n) + 0.5) / n
    both = F.aggregate(cells, F.struct(F.lit(0).alias("i"), F.lit(0).alias("u")), lambda s, i: F.struct((s["i"] + (inside(a, x(i), y(i)) & inside(b, x(i), y(i))).cast("int")).alias("i"), (s["u"] + (inside(a, x(i), y(i)) | inside(b, x(i), y(i))).cast("int")).alias("u")))
    return F.when(both["u"] > 0, both["i"] / both["u"]).otherwise(0.0)


def fitted_line(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, mx, my, angle): total least squares through each key's points."""
    stats = df.groupBy(key).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_pop(x).alias("sxx"), F.var_pop(y).alias("syy"), F.covar_pop(x, y).alias("sxy"))
    return stats.select(key, "mx", "my", (F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2).alias("angle"))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull's corners, counter-clockwise in a frame with y upwards."""
    order = np.unique(points, axis=0)
    if len(order) < 3:
        return order

    def half(seq: np.ndarray) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(order) + half(order[::-1]))


def simplified(points: np.ndarray, epsilon: float) -> np.ndarray:
    """A closed line with points taken out that lie within epsilon of what is left, without recursion."""
    n = len(points)
    if n < 4:
        return points
    far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
    keep = np.zeros(n + 1, bool)
    keep[[0, far, n]] = True
    ring, todo = np.vstack([points, points[:1]]).astype(float), [(0, far), (far, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = ring[b] - ring[a]
        v = ring[a + 1 : b] - ring[a]
        size = math.hypot(*d)
        off = np.abs(d[0] * v[:, 1] - d[1] * v[:, 0]) / size if size else np.hypot(v[:, 0], v[:, 1])
        k = int(np.argmax(off))
        if off[k] > epsilon:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep[:n]]


def quad_of_hull(points: np.ndarray) -> np.ndarray | None:
    """Four corners, by simplifying more and more; None if that passes four."""
    h = hull(points)
    length = np.hypot(*(np.roll(h, -1, axis=0) - h).T).sum() if len(h) > 2 else 0.0
    for epsilon in np.arange(0.02, 0.081, 0.01):
        q = simplified(h, epsilon * length)
        if len(q) == 4:
            return q
        if len(q) < 4:
            return None
    return None
