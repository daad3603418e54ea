"""Lookups in small surfaces and outlines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Nodes of the largest grid that may become a literal of the plan.
MOST_NODES = 40_000


def load_grid(nodes: DataFrame, h: str, r: str, value: str) -> tuple[list[float], list[float], list[float]]:
    """Axes and values, row by row, of a complete two-dimensional grid; an incomplete one is refused."""
    n, nh, nr = nodes.agg(F.count(value), F.count_distinct(h), F.count_distinct(r)).first()
    if n != nh * nr or not n:
        raise ValueError(f"the grid is incomplete: {n} of {nh * nr} nodes")
    if n > MOST_NODES:
        raise ValueError(f"the grid has {n} nodes, more than {MOST_NODES}")
    rows = nodes.select(h, r, value).orderBy(h, r).collect()  # MOST_NODES at most
    return sorted({x[0] for x in rows}), sorted({x[1] for x in rows}), [float(x[2]) for x in rows]


def _array(values: list[float]) -> Column:
    return F.from_json(F.lit("[" + ",".join(map(repr, values)) + "]"), "array<double>")


def bilinear(h: Column, r: Column, grid: tuple[list[float], list[float], list[float]]) -> Column:
    """Interpolated value at (h, r), both first clipped to the grid; null for a null. Axes rise, in
    even steps or not."""
    hs, rs, values = grid
    v = _array(values)

    def cell(x: Column, axis: list[float]) -> tuple[Column, Column]:
        x = F.greatest(F.least(x, F.lit(axis[-1])), F.lit(axis[0]))
        if len(axis) == 1:
            return F.lit(0), F.lit(0.0)
        step = (axis[-1] - axis[0]) / (len(axis) - 1)
        if all(abs(v - axis[0] - k * step) <= 1e-9 * abs(axis[-1] - axis[0]) for k, v in enumerate(axis)):
            p = (x - axis[0]) / step
            i = F.least(F.floor(p), F.lit(len(axis) - 2)).cast("int")
            return i, p - i
        nodes = _array(axis)
        i = F.least(F.greatest(F.size(F.filter(nodes, lambda a: a <= x)) - 1, F.lit(0)), F.lit(len(axis) - 2))
        return i, (x - nodes[i]) / (nodes[i + 1] - nodes[i])

    (i, a), (j, b) = cell(h, hs), cell(r, rs)
    at = lambda di, dj: v[(i + (di if len(hs) > 1 else 0)) * len(rs) + j + (dj if len(rs) > 1 else 0)]
    out = at(0, 0) * (1 - a) * (1 - b) + at(1, 0) * a * (1 - b) + at(0, 1) * (1 - a) * b + at(1, 1) * a * b
    return F.when(h.isNotNull() & r.isNotNull(), out)


def nearest_node(h: Column, r: Column, grid: tuple[list[float], list[float], list[float]]) -> Column:
    """Value at the node nearest on each axis, the first of two equally near; null for a null."""
    hs, rs, values = grid

    def index(x: Column, axis: list[float]) -> Column:
        near = F.transform(_array(axis), lambda a, i: F.struct(F.abs(a - x).alias("d"), i.alias("i")))
        return F.array_min(near)["i"]

    return F.when(h.isNotNull() & r.isNotNull(), _array(values)[index(h, hs) * len(rs) + index(r, rs)])


def outside(h: Column, r: Column, grid: tuple[list[float], list[float], list[float]]) -> Column:
    hs, rs, _ = grid
    return ~(h.between(hs[0], hs[-1]) & r.between(rs[0], rs[-1]))


def contour(grid: tuple[list[float], list[float], list[float]], level: float) -> list[tuple[float, float, float, float]]:
    """Segments of the iso-line at the level, by marching squares over the cells' edges."""
    hs, rs, values = grid
    out = []
    for i in range(len(hs) - 1):
        for j in range(len(rs) - 1):
            corners = [(hs[i], rs[j]), (hs[i + 1], rs[j]), (hs[i + 1], rs[j + 1]), (hs[i], rs[j + 1])]
            v = [values[a * len(rs) + b] for a, b in ((i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1))]
            cuts = []
            for k in range(4):
                a, b = v[k], v[(k + 1) % 4]
                if (a < level) != (b < level):
                    f = (level - a) / (b - a)
                    p, q = corners[k], corners[(k + 1) % 4]
                    cuts.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
            out += [(*cuts[k], *cuts[k + 1]) for k in range(0, len(cuts) - 1, 2)]
    return out


def distance_to_segments(x: Column, y: Column, segments: list[tuple[float, float, float, float]]) -> Column:
    """Least distance of a point to any of the segments (a few hundred at most)."""
    if len(segments) * 4 > MOST_NODES:
        raise ValueError("too many segments for a literal")
    rows = _array([c for s in segments for c in s])
    each = F.transform(F.sequence(F.lit(0), F.lit(len(segments) - 1)), lambda k: _to_segment(x, y, *(rows[k * 4 + d] for d in range(4))))
    return F.array_min(each)


def _to_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(length, F.lit(0.0)), F.lit(0.0))))
    return F.hypot(x - (ax + t * dx), y - (ay + t * dy))


def structure_score(points: DataFrame, frame: list[str], flagged: Column, distance: Column) -> DataFrame:
    """Per frame the flagged points and the sum of their distances; null where a flagged one has none."""
    d = points.withColumn("_d", F.when(flagged, distance)).withColumn("_f", flagged)
    missing = F.count_if(F.col("_f") & F.col("_d").isNull())
    return d.groupBy(*frame).agg(F.count_if("_f").alias("n_flagged"), F.when(missing == 0, F.coalesce(F.sum("_d"), F.lit(0.0))).alias("score"))


def uniform_axis(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * k / (n - 1) for k in range(n)] if n > 1 and math.isfinite(low + high) else [low]
