"""Pairs within a distance: rows meet in cells of the cutoff's size, never all with all."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(columns: list[str], cutoff: float) -> Column:
    return F.struct(*[F.floor(F.col(c) / cutoff).alias(f"c{i}") for i, c in enumerate(columns)])


def _near_cells(columns: list[str], cutoff: float) -> Column:
    steps = itertools.product((-1, 0, 1), repeat=len(columns))
    return F.explode(F.array(*[F.struct(*[(F.floor(F.col(c) / cutoff) + k).alias(f"c{i}") for i, (c, k) in enumerate(zip(columns, s, strict=True))]) for s in steps]))


def pairs_within(a: DataFrame, b: DataFrame, frame: list[str], columns: list[str], cutoff: float, key: str) -> DataFrame:
    """Pairs of rows of one frame, one from each table, at a distance up to the cutoff; a row is not paired
    with itself (equal keys)."""
    left = a.select(*frame, F.col(key).alias("a"), *[F.col(c).alias(f"_a_{c}") for c in columns], _cells(columns, cutoff).alias("_cell"))
    right = b.select(*frame, F.col(key).alias("b"), *[F.col(c).alias(f"_b_{c}") for c in columns], _near_cells(columns, cutoff).alias("_cell"))
    d2 = sum((F.pow(F.col(f"_a_{c}") - F.col(f"_b_{c}"), 2) for c in columns), F.lit(0.0))
    return left.join(right, [*frame, "_cell"]).withColumn("distance", F.sqrt(d2)).where((F.col("distance") <= cutoff) & (F.col("a") != F.col("b"))).select(*frame, "a", "b", "distance")


def periodic_pairs_within(a: DataFrame, b: DataFrame, frame: list[str], columns: list[str], box: list[float], cutoff: float, key: str) -> DataFrame:
    """The same in a rectangular periodic box, by minimum image. Cells divide the box evenly, so that they
    wrap; a side of less than three cells takes part in one cell."""
    n = [max(1, int(length // cutoff)) for length in box]
    n = [x if x >= 3 else 1 for x in n]
    cell = lambda c, length, k: F.pmod(F.floor(F.pmod(F.col(c), F.lit(length)) / (length / k)), F.lit(k))
    left = a.select(*frame, F.col(key).alias("a"), *[F.col(c).alias(f"_a_{c}") for c in columns], F.struct(*[cell(c, x, k).alias(f"c{i}") for i, (c, x, k) in enumerate(zip(columns, box, n, strict=True))]).alias("_cell"))
    steps = itertools.product(*[(-1, 0, 1) if k > 1 else (0,) for k in n])
    near = F.explode(F.array(*[F.struct(*[F.pmod(cell(c, x, k) + d, F.lit(k)).alias(f"c{i}") for i, (c, x, k, d) in enumerate(zip(columns, box, n, s, strict=True))]) for s in steps]))
    right = b.select(*frame, F.col(key).alias("b"), *[F.col(c).alias(f"_b_{c}") for c in columns], near.alias("_cell"))

    def image(c: str, length: float) -> Column:
        d = F.col(f"_a_{c}") - F.col(f"_b_{c}")
        return d - length * F.rint(d / length)

    d2 = sum((F.pow(image(c, x), 2) for c, x in zip(columns, box, strict=True)), F.lit(0.0))
    return left.join(right, [*frame, "_cell"]).withColumn("distance", F.sqrt(d2)).where((F.col("distance") <= cutoff) & (F.col("a") != F.col("b"))).select(*frame, "a", "b", "distance")


def triclinic_pairs_within(a: DataFrame, b: DataFrame, frame: list[str], columns: list[str], vectors: list[list[float]], cutoff: float, key: str) -> DataFrame:
    """The same in a periodic box of any three vectors (rows). Places are taken in parts of the vectors; cells are at least
    a cutoff high along each; of the 27 images next to the nearest parts the least distance counts, which is exact up to
    half the least height of the box (a longer cutoff is an error)."""
    import numpy as np

    m = np.array(vectors, float)
    heights = abs(np.linalg.det(m)) / np.array([np.linalg.norm(np.cross(m[(i + 1) % 3], m[(i + 2) % 3])) for i in range(3)])
    if cutoff > heights.min() / 2:
        raise ValueError(f"the cutoff is over half the box's least height, {heights.min() / 2}")
    inverse = np.linalg.inv(m)
    n = [int(x) if x >= 3 else 1 for x in heights // cutoff]
    part = lambda i: sum((F.col(c) * float(inverse[j, i]) for j, c in enumerate(columns)), F.lit(0.0))
    cell = lambda i: F.least(F.floor((part(i) - F.floor(part(i))) * n[i]), F.lit(n[i] - 1))
    left = a.select(*frame, F.col(key).alias("a"), *[part(i).alias(f"_a{i}") for i in range(3)], F.struct(*[cell(i).alias(f"c{i}") for i in range(3)]).alias("_cell"))
    steps = itertools.product(*[(-1, 0, 1) if k > 1 else (0,) for k in n])
    near = F.explode(F.array(*[F.struct(*[F.pmod(cell(i) + d, F.lit(n[i])).alias(f"c{i}") for i, d in enumerate(s)]) for s in steps]))
    right = b.select(*frame, F.col(key).alias("b"), *[part(i).alias(f"_b{i}") for i in range(3)], near.alias("_cell"))
    d = left.join(right, [*frame, "_cell"]).where(F.col("a") != F.col("b"))
    d = d.withColumns({f"_d{i}": F.col(f"_a{i}") - F.col(f"_b{i}") - F.rint(F.col(f"_a{i}") - F.col(f"_b{i}")) for i in range(3)})
    flat = d.withColumns({f"_x{j}": sum((F.col(f"_d{i}") * float(m[i, j]) for i in range(3)), F.lit(0.0)) for j in range(3)})
    shifts = [np.array(s, float) @ m for s in itertools.product((-1, 0, 1), repeat=3)]
    squares = [sum((F.pow(F.col(f"_x{j}") + float(s[j]), 2) for j in range(3)), F.lit(0.0)) for s in shifts]
    return flat.withColumn("distance", F.sqrt(F.least(*squares))).where(F.col("distance") <= cutoff).select(*frame, "a", "b", "distance")


def coordination(a: DataFrame, b: DataFrame, frame: list[str], columns: list[str], cutoff: float, key: str) -> DataFrame:
    """How many rows of b are within the cutoff of each row of a; 0 included."""
    n = pairs_within(a, b, frame, columns, cutoff, key).groupBy(*frame, F.col("a").alias(key)).agg(F.count("*").alias("n_near"))
    return a.select(*frame, key).join(n, [*frame, key], "left").fillna(0, ["n_near"])


def charge_over_distance(probes: DataFrame, partners: DataFrame, frame: list[str], columns: list[str], cutoff: float, key: str, charge: str, kind: str) -> DataFrame:
    """Sum of q / max(r, 1e-6) over the partners of each kind within the cutoff of a probe."""
    p = pairs_within(probes, partners, frame, columns, cutoff, key)
    q = partners.select(*frame, F.col(key).alias("b"), F.col(charge).alias("_q"), F.col(kind).alias(kind))
    return p.join(q, [*frame, "b"]).groupBy(*frame, F.col("a").alias(key), kind).agg(F.sum(F.col("_q") / F.greatest("distance", F.lit(1e-6))).alias("potential"))


def first_minimum(histogram: DataFrame, bin_: str, value: str) -> DataFrame:
    """Place of the least value after the highest peak (the first of equal ones)."""
    peak = histogram.agg(F.max_by(F.struct(bin_, value), F.struct(value, -F.col(bin_))).alias("p"))
    top = peak.first()[0]
    rows = histogram.where(F.col(bin_) > top[bin_]) if top else histogram.limit(0)
    return rows.agg(F.min(F.struct(value, bin_)).getField(bin_).alias(bin_))
