"""Measures of frames from particle rows, all of them in one exchange.

A block declares aggregates over the rows of a frame and columns that follow from them. The blocks of a table are planned
together: one aggregate by frame computes what all of them need (the same aggregate once), combined within tasks before
the exchange, and columns are expressions over its row. Only particles that a block lists in order (a chain of
water, a ring) are shipped one by one; these are what a frame holds in its channel. Steps that need several frames come after.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import sign_flip


@dataclass
class Block:
    """sums: aggregates by name. columns: expressions over those names, made by `of(name)`. flips: columns whose sign follows the
    direction; rivals: columns that stay out of a model; later: steps over frames, with the columns that they add."""

    name: str
    sums: dict[str, Column]
    columns: dict[str, Callable[[Callable[[str], Column]], Column]]
    flips: list[str] = field(default_factory=list)
    rivals: list[str] = field(default_factory=list)
    later: Callable[[DataFrame], DataFrame] | None = None
    adds: list[str] = field(default_factory=list)


def schema(blocks: list[Block]) -> list[tuple[str, str, bool]]:
    """(column, block, to the model) of all blocks; a name in two of them, or a flip or rival that is no column, is an error."""
    seen: dict[str, str] = {}
    for b in blocks:
        names = [*b.columns, *b.adds]
        for c in [*b.flips, *b.rivals]:
            if c not in names:
                raise ValueError(f"{b.name} names {c}, which is not among its columns")
        for c in names:
            if c in seen:
                raise ValueError(f"{c} is in {seen[c]} and in {b.name}")
            seen[c] = b.name
    rivals = {c for b in blocks for c in b.rivals}
    return [(c, b, c not in rivals) for c, b in seen.items()]


def measure(blocks: list[Block], particles: DataFrame, frame: list[str]) -> DataFrame:
    """A row per frame with the columns of all blocks but those of their later steps."""
    schema(blocks)
    aggs, alias = [], {}
    known: dict[str, str] = {}
    for b in blocks:
        for n, e in b.sums.items():
            text = e._jc.toString() if hasattr(e, "_jc") else str(e)
            if text not in known:
                known[text] = f"_{b.name}_{n}"
                aggs.append(e.alias(known[text]))
            alias[b.name, n] = known[text]
    rows = particles.groupBy(*frame).agg(*aggs) if aggs else particles.select(*frame).distinct()
    return rows.select(*frame, *[make(lambda n, b=b: F.col(alias[b.name, n])).alias(c) for b in blocks for c, make in b.columns.items()])


def assemble(blocks: list[Block], particles: DataFrame, frame: list[str], direction: Column) -> DataFrame:
    """Measures, the blocks' later steps in turn, then the signs of flipping columns: steps see laboratory signs."""
    out = measure(blocks, particles, frame)
    for b in blocks:
        out = b.later(out) if b.later else out
    return sign_flip(out, direction, [c for b in blocks for c in b.flips])


def _where(condition: Column, value) -> Column:
    return F.when(condition, value)


def geometry(lining: Column, z: str, r: str, low: float, high: float, bins: int = 0) -> Block:
    """Least radius of the lining between the ends and where it first is, the share of rows with a radius, and the least
    radius per axial bin."""
    inside = lining & F.col(z).between(low, high)
    width = (high - low) / max(1, bins)
    at = F.least(F.floor((F.col(z) - low) / width), F.lit(bins - 1))
    sums = {"narrow": F.min(_where(inside & F.col(r).isNotNull(), F.struct(F.col(r).alias("r"), F.col(z).alias("z")))), "n": F.count_if(inside), "known": F.count_if(inside & F.col(r).isNotNull())}
    sums |= {f"bin{i}": F.min(_where(inside & (at == i), F.col(r))) for i in range(bins)}
    columns = {"r_min": lambda of: of("narrow")["r"], "z_min": lambda of: of("narrow")["z"], "measured_frac": lambda of: of("known") / F.nullif(of("n"), F.lit(0))}
    return Block("geometry", sums, columns | {f"r_bin{i}": (lambda of, i=i: of(f"bin{i}")) for i in range(bins)})


def hydration(water: Column, z: str, r: str, low: float, high: float, radius: float) -> Block:
    """Water in the cylinder, and per volume of it."""
    n = F.count_if(water & F.col(z).between(low, high) & (F.col(r) <= radius))
    volume = math.pi * radius * radius * (high - low)
    return Block("hydration", {"n": n}, {"n_water": lambda of: of("n"), "water_density": lambda of: of("n") / F.lit(volume)})


def water_wire(water: Column, z: str, low: float, high: float, most: float) -> Block:
    """The largest gap along the axis in the chain of water from end to end, and whether none is over `most`; null under two."""
    listed = F.sort_array(F.collect_list(_where(water & F.col(z).between(low, high), F.col(z))))

    def gap(of):
        zs = F.concat(F.array(F.lit(float(low))), of("zs"), F.array(F.lit(float(high))))
        steps = F.zip_with(F.slice(zs, 2, 2_000_000_000), zs, lambda b, a: b - a)
        return F.when(F.size(of("zs")) >= 2, F.array_max(steps))

    return Block("water_wire", {"zs": listed}, {"wire_gap": gap, "wire_closed": lambda of: (gap(of) <= most).cast("int")})


def occupancy(ion: Column, z: str, sites: dict[str, float], sigma: float) -> Block:
    """Gaussian weights of the ions around each site."""
    sums = {s: F.coalesce(F.sum(_where(ion, F.exp(-F.pow((F.col(z) - at) / sigma, 2) / 2))), F.lit(0.0)) for s, at in sites.items()}
    return Block("occupancy", sums, {f"occ_{s}": (lambda of, s=s: of(s)) for s in sites})


def named_sites(ion: Column, z: str, sites: dict[str, tuple[float, float]]) -> Block:
    """Whether an ion is in each named range of the axis, and how many."""
    sums = {s: F.count_if(ion & F.col(z).between(*ends)) for s, ends in sites.items()}
    columns = {}
    for s in sites:
        columns |= {f"n_{s}": (lambda of, s=s: of(s)), f"held_{s}": (lambda of, s=s: (of(s) > 0).cast("int"))}
    return Block("named_sites", sums, columns)


def electrostatics(charge: str, z: str, r: str, centre: float) -> Block:
    """Charge above the centre less that below it, and the sum of charge over distance to the centre (1e-6 at least)."""
    q, d = F.col(charge), F.sqrt(F.pow(F.col(z) - centre, 2) + F.pow(F.col(r), 2))
    sums = {"above": F.coalesce(F.sum(_where(F.col(z) > centre, q)), F.lit(0)), "below": F.coalesce(F.sum(_where(F.col(z) < centre, q)), F.lit(0)), "potential": F.sum(q / F.greatest(d, F.lit(1e-6)))}
    return Block("electrostatics", sums, {"axial_asymmetry": lambda of: of("above") - of("below"), "potential": lambda of: of("potential")}, flips=["axial_asymmetry"])


def symmetry(gate: Column, x: Column, y: Column, entity: str) -> Block:
    """Deviation over mean of the distances between neighbours of a ring in order of angle; null under three."""
    listed = F.sort_array(F.collect_list(_where(gate, F.struct(F.atan2(y, x).alias("a"), F.col(entity).alias("e"), x.alias("x"), y.alias("y")))))

    def cv(of):
        ring = of("ring")
        after = F.concat(F.slice(ring, 2, 2_000_000_000), F.slice(ring, 1, 1))
        d = F.zip_with(ring, after, lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))
        # One pass: an expression of the whole ring inside a function of its members would be evaluated for each of them.
        begin = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

        def add(s, v):
            n, off = s["n"] + 1, v - s["mean"]
            mean = s["mean"] + off / n
            return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + off * (v - mean)).alias("m2"))

        return F.aggregate(d, begin, add, lambda s: F.when(s["n"] >= 3, F.sqrt(s["m2"] / s["n"]) / F.nullif(s["mean"], F.lit(0.0))))

    return Block("symmetry", {"ring": listed}, {"ring_cv": cv, "ring_n": lambda of: F.size(of("ring"))})


def fluctuations(rows: Column, value: str) -> Block:
    """Mean, and population deviation of two values or more."""
    v = _where(rows, F.col(value))
    return Block("fluctuations", {"mean": F.avg(v), "deviation": F.stddev_pop(v), "n": F.count(v)}, {f"{value}_mean": lambda of: of("mean"), f"{value}_deviation": lambda of: F.when(of("n") >= 2, of("deviation"))})


def dynamics(column: str, unit: list[str], window: int, t: str = "t") -> Block:
    """Of a column of another block: its mean over the frames in [t - window, t], and its change since the frame before."""
    from tidemark.operators.windows import ordered, trailing

    def later(d: DataFrame) -> DataFrame:
        return d.withColumns({f"{column}_trailing": F.avg(column).over(trailing(unit, window, t)), f"{column}_change": F.col(column) - F.lag(column).over(ordered(unit, t))})

    return Block("dynamics", {}, {}, later=later, adds=[f"{column}_trailing", f"{column}_change"])


def delivery(rows: Column, z: str, low: float, high: float, depth: float) -> Block:
    """Rows up to `depth` beyond either end, and the upper ones less the lower ones, in the direction of conduction."""
    below, above = F.count_if(rows & (F.col(z) < low) & (F.col(z) >= low - depth)), F.count_if(rows & (F.col(z) > high) & (F.col(z) <= high + depth))
    return Block("delivery", {"below": below, "above": above}, {"n_below": lambda of: of("below"), "n_above": lambda of: of("above"), "n_ahead": lambda of: of("above") - of("below")}, flips=["n_ahead"])
