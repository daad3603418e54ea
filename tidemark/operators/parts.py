"""Work along time within units, with a unit's rows spread over many tasks.

Rows are cut at approximate quantiles of time, the same for all units, so that a unit which holds a third of all rows is
cut into about a third of the parts' rows each. Running values are an associative scan in two levels: windows inside
(unit, part), and over one row per (unit, part) a window that carries totals from part to part; the carried row is joined back by the
exchange that the inner window has made. Frames that look back a fixed time get a halo instead: rows that a later part looks
back on are copied to it. Equal times fall into one part, so ties are as in a window over the whole unit.

Rows without a time are in the first part. The cuts are one row of the plan: nothing runs when a plan is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 32


def _with_edges(df: DataFrame, t: str, parts: int) -> DataFrame:
    """df with the cuts of its times as the array `_edges`."""
    edges = df.agg(F.percentile_approx(t, [k / parts for k in range(1, parts)], 1000).alias("_edges"))
    return df.crossJoin(F.broadcast(edges))  # one row


def _place(value: Column) -> Column:
    """Number of cuts at or below the value; 0 for none."""
    return F.greatest(F.coalesce(F.size(F.filter("_edges", lambda e: e <= value)), F.lit(0)), F.lit(0)).cast("int")


def cut(df: DataFrame, t: str = "t", parts: int = PARTS, name: str = "_part") -> DataFrame:
    """df with the part that each row's time falls into."""
    return _with_edges(df, t, parts).withColumn(name, _place(F.col(t))).drop("_edges")


def _inner(unit: list[str], t: str, down: bool, frame: str, tie: list[str]):
    w = Window.partitionBy(*unit, "_part").orderBy(*[F.desc(c) if down else F.asc(c) for c in (t, *tie)])
    begin = Window.unboundedPreceding
    if frame in ("rows", "earlier"):
        return w.rowsBetween(begin, 0 if frame == "rows" else -1)
    if tie:
        raise ValueError("frames of equal times have no use for an order within them")
    return w.rangeBetween(begin, 0 if frame == "range" else -1)


def scan(df: DataFrame, unit: list[str], t: str, columns: dict[str, tuple[str, Column]], down: bool = False, frame: str = "rows", parts: int = PARTS, tie: list[str] | None = None) -> DataFrame:
    """df with running values along t (from the greatest t down, if so), each a kind and an expression over rows: "sum", "count", "min",
    "max", or "last", the latest one that is not null. frame: "rows" up to and with this row, "earlier" without it, "range" with all rows of the same
    t too, "before" without any of the same t. `tie` orders rows of the same t (for "rows" and "earlier")."""
    tie = tie or []
    d = (df if "_part" in df.columns else cut(df, t, parts)).withColumns({f"_v_{n}": e for n, (_, e) in columns.items()})
    inner = _inner(unit, t, down, frame, tie)
    over = Window.partitionBy(*unit).orderBy(F.desc("_part") if down else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    simple = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    totals, carried, merged, within = [], [], {}, {}
    for n, (kind, _) in columns.items():
        v = F.col(f"_v_{n}")
        if kind == "last":
            latest = F.min if down else F.max
            totals.append(latest(F.when(v.isNotNull(), F.struct(F.col(t).alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(tie)], v.alias("v")))).alias(f"_c_{n}"))
            carried.append(F.last(F.col(f"_c_{n}.v"), ignorenulls=True).over(over).alias(f"_c_{n}"))
            within[f"_v_{n}"] = F.last(v, ignorenulls=True).over(inner)
            merged[n] = F.coalesce(f"_v_{n}", f"_c_{n}")
            continue
        totals.append(simple[kind](v).alias(f"_c_{n}"))
        carried.append((F.sum if kind == "count" else simple[kind])(f"_c_{n}").over(over).alias(f"_c_{n}"))
        within[f"_v_{n}"] = simple[kind](v).over(inner)
        a, b = F.col(f"_v_{n}"), F.col(f"_c_{n}")
        if kind in ("sum", "count"):
            both = F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            merged[n] = both if kind == "count" else F.when(a.isNotNull() | b.isNotNull(), both)
        else:
            merged[n] = F.least(a, b) if kind == "min" else F.greatest(a, b)
    per = d.groupBy(*unit, "_part").agg(*totals)
    per = per.select(*[F.col(c).alias(f"_u_{c}") for c in unit], F.col("_part").alias("_p"), *carried)
    on = F.col("_part") == F.col("_p")
    for c in unit:
        on = on & F.col(c).eqNullSafe(F.col(f"_u_{c}"))
    out = d.withColumns(within).join(per, on, "left").withColumns(merged)
    return out.select(*[c for c in df.columns if c not in columns], *columns)


def previous(df: DataFrame, unit: list[str], t: str, columns: dict[str, str], parts: int = PARTS, tie: list[str] | None = None) -> DataFrame:
    """df with the values of the unit's row before, under new names, and `_first`, whether there is none. Times, or times and `tie`, are distinct within units."""
    d = df if "_part" in df.columns else cut(df, t, parts)
    held = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    w = Window.partitionBy(*unit, "_part").orderBy(t, *(tie or []))
    d = scan(d.withColumn("_lag", F.lag(held).over(w)), unit, t, {"_carry": ("last", held)}, frame="earlier", parts=parts, tie=tie)
    prev = F.coalesce("_lag", "_carry")
    out = d.withColumns({**{n: prev[n] for n in columns}, "_first": prev.isNull()})
    return out.drop("_lag", "_carry") if "_part" in df.columns else out.drop("_lag", "_carry", "_part")


def trailing(df: DataFrame, unit: list[str], t: str, window: int, columns: dict, parts: int = PARTS) -> DataFrame:
    """df with columns over the unit's rows in [t - window, t]: each of `columns` makes an expression of a window specification.
    Rows are copied to the later parts that look back on them, so a row counts where it is needed and no task holds a unit."""
    d = _with_edges(df, t, parts)
    d = d.withColumns({"_own": _place(F.col(t)), "_last": _place(F.col(t) + window)}).drop("_edges")
    d = d.select("*", F.explode(F.sequence("_own", F.coalesce("_last", "_own"))).alias("_part"))
    w = Window.partitionBy(*unit, "_part").orderBy(t).rangeBetween(-window, 0)
    d = d.withColumns({n: make(w) for n, make in columns.items()}).where(F.col("_part") == F.col("_own"))
    return d.drop("_own", "_last", "_part")


def trailing_totals(df: DataFrame, unit: list[str], t: str, window: int, columns: dict[str, tuple[str, Column]], parts: int = PARTS) -> DataFrame:
    """df with "sum", "count", "min" or "max" (kind and expression, as in `scan`) over the unit's rows in [t - window, t], linear in the rows
    however many a window holds. Time is cut into blocks of the window's length: a window is what its own block holds
    up to t and what the block before holds from t - window on, a running value forwards and one backwards."""
    length = max(1, window)
    held = {n: e.alias(f"_x_{n}") for n, (_, e) in columns.items()}
    d = df.select("*", *held.values(), F.expr(f"`{t}` div {length} - if(`{t}` % {length} < 0, 1, 0)").alias("_block"))
    by = [*unit, "_block"]
    own = scan(d, by, t, {f"_own_{n}": (kind, F.col(f"_x_{n}")) for n, (kind, _) in columns.items()}, frame="range", parts=parts)
    # rows of the block before, moved on by the window: what a row at t looks back on is there at t or later
    moved = d.where(F.col(t).isNotNull()).select(*unit, (F.col("_block") + 1).alias("_block"), (F.col(t) + window).alias(t), *[F.col(f"_x_{n}") for n in columns])
    asked = own.drop(*[f"_x_{n}" for n in columns]).withColumn("_asks", F.lit(True))
    both = asked.unionByName(moved, allowMissingColumns=True)
    both = scan(both, by, t, {f"_old_{n}": (kind, F.col(f"_x_{n}")) for n, (kind, _) in columns.items()}, down=True, frame="range", parts=parts).where("_asks")

    def merged(n: str, kind: str) -> Column:
        a, b = F.col(f"_own_{n}"), F.col(f"_old_{n}")
        if kind in ("min", "max"):
            return (F.least if kind == "min" else F.greatest)(a, b)
        return F.coalesce(a + b, a, b)

    return both.select(*df.columns, *[merged(n, kind).alias(n) for n, (kind, _) in columns.items()])
