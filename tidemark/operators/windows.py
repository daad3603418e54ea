"""Operators on rows ordered by time within units: trailing windows, changes, islands, latches.

The time column is integral, so that RANGE frames have exact bounds; frames include ties. Every window
is partitioned by the unit, and operators that look forward order by descending time, because frames
that grow from the partition's start cost one pass while frames that end at its end cost one per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.parts import previous, scan


def ordered(unit: list[str], t: str = "t"):
    return Window.partitionBy(*unit).orderBy(t)


def trailing(unit: list[str], window: int, t: str = "t"):
    """Rows of the unit in [t - window, t]."""
    return ordered(unit, t).rangeBetween(-window, 0)


def trailing_log_odds(predicate: Column, over) -> Column:
    """ln((n1 + 1) / (n0 + 1)) of the rows that satisfy the predicate and those that do not."""
    n1 = F.sum(F.when(predicate, 1).otherwise(0)).over(over)
    n0 = F.sum(F.when(~predicate, 1).otherwise(0)).over(over)
    return F.log((n1 + 1) / (n0 + 1))


def joint_means(a: str, b: str, over) -> tuple[Column, Column]:
    """Trailing means of two columns over the rows that have both."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.avg(F.when(both, F.col(a))).over(over), F.avg(F.when(both, F.col(b))).over(over)


def rows_per_window(df: DataFrame, unit: list[str], window: int, t: str = "t") -> int:
    """How many rows the median time step fits into a window, one at least."""
    step = df.select((F.col(t) - F.lag(t).over(ordered(unit, t))).alias("d")).agg(F.median("d")).first()[0]
    return max(1, round(window / step)) if step else 1


def changes(value: str, unit: list[str], t: str = "t") -> Column:
    """Whether the value differs from the unit's previous row; false on the first."""
    return F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(ordered(unit, t))) & (F.row_number().over(ordered(unit, t)) > 1), F.lit(False))


def with_islands(df: DataFrame, value: str, unit: list[str], t: str = "t", name: str = "island") -> DataFrame:
    """Number the maximal runs of rows with an equal value."""
    running = ordered(unit, t).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_change", changes(value, unit, t)).withColumn(name, F.sum(F.col("_change").cast("int")).over(running)).drop("_change")


def state_age(df: DataFrame, value: str, unit: list[str], t: str = "t", parts: int | None = None) -> DataFrame:
    """Time since the value last changed; 0 on the unit's first row. With `parts`, units are cut by time into so many tasks."""
    if parts:
        d = previous(df, unit, t, {"_before": value}, parts)
        begins = F.when(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before")), F.col(t))
        return scan(d, unit, t, {"_at": ("last", begins)}, parts=parts).withColumn("age", F.col(t) - F.col("_at")).drop("_at", "_before", "_first")
    marked = df.withColumn("_at", F.when(changes(value, unit, t) | (F.row_number().over(ordered(unit, t)) == 1), F.col(t)))
    last = F.last("_at", ignorenulls=True).over(ordered(unit, t).rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("age", F.col(t) - last).drop("_at")


def run_counts(df: DataFrame, y: str, unit: list[str], t: str = "t") -> DataFrame:
    """Positive runs of each unit (rising edges), and the time of the last row of its latest one."""
    w = ordered(unit, t)
    up = (F.col(y) == 1) & (F.coalesce(F.lag(y).over(w), F.lit(0)) != 1)
    down = (F.col(y) == 1) & (F.coalesce(F.lead(y).over(w), F.lit(0)) != 1)
    edges = df.select(*unit, up.cast("int").alias("up"), F.when(down, F.col(t)).alias("fell"))
    return edges.groupBy(*unit).agg(F.sum("up").alias("runs"), F.max("fell").alias("last_fall"))


def latch(df: DataFrame, p: str, on: Column | float, off: Column | float, unit: list[str], t: str = "t", name: str = "armed", parts: int | None = None) -> DataFrame:
    """Hysteresis: armed from p >= on until p < off; a null p keeps the state; unarmed at first. on >= off. With `parts`, units
    are cut by time into so many tasks."""
    on, off = (x if isinstance(x, Column) else F.lit(x) for x in (on, off))
    said = F.when(F.col(p) >= on, True).when(F.col(p) < off, False)
    if parts:
        return scan(df, unit, t, {name: ("last", said)}, parts=parts).withColumn(name, F.coalesce(name, F.lit(False)))
    state = F.last(said, ignorenulls=True).over(ordered(unit, t).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.coalesce(state, F.lit(False)))


def inter_event_intervals(events: DataFrame, unit: list[str], t: str = "t") -> DataFrame:
    """Median time between a unit's events."""
    d = events.select(*unit, (F.col(t) - F.lag(t).over(ordered(unit, t))).alias("d"))
    return d.groupBy(*unit).agg(F.count("*").alias("n_events"), F.median("d").alias("median_interval"))


def stride(df: DataFrame, every: int, unit: list[str], t: str = "t") -> DataFrame:
    """Every n-th row of each unit, from the first."""
    return df.withColumn("_i", F.row_number().over(ordered(unit, t)) - 1).where(F.col("_i") % every == 0).drop("_i")


def even_sample(df: DataFrame, n: int, unit: list[str], t: str = "t") -> DataFrame:
    """n rows of each unit at evenly spaced places, first and last included; all rows of shorter units."""
    w = Window.partitionBy(*unit)
    d = df.withColumn("_i", F.row_number().over(ordered(unit, t)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / F.lit(max(1, n - 1))))
    return d.where((F.col("_n") <= n) | F.array_contains(places, F.col("_i").cast("long"))).drop("_i", "_n")


def cyclic_shift(df: DataFrame, value: str, k: Column, unit: list[str], t: str = "t", name: str = "shifted") -> DataFrame:
    """Each unit's values moved k rows later, the last ones coming round to the front."""
    w = Window.partitionBy(*unit)
    d = df.withColumn("_i", F.row_number().over(ordered(unit, t)) - 1).withColumn("_n", F.count("*").over(w))
    moved = d.select(*unit, F.pmod(F.col("_i") + k, F.col("_n")).cast("int").alias("_i"), F.col(value).alias(name))
    return d.join(moved, [*unit, "_i"]).drop("_i", "_n")


def falling_edges(df: DataFrame, y: str, unit: list[str], t: str = "t") -> DataFrame:
    """The last row of every run of y = 1."""
    return df.withColumn("_next", F.lead(y).over(ordered(unit, t))).where((F.col(y) == 1) & (F.coalesce("_next", F.lit(0)) != 1)).drop("_next")


def displacement(df: DataFrame, chosen: DataFrame, unit: list[str], entity: str, z: str, inside: Column, window: int, t: str = "t") -> DataFrame:
    """For each row of `chosen` (unit, t, entity) how far that entity has moved along z since the first frame of the window
    [t - window, t], if it was inside then and that frame is not this one; else null. `persist` says whether it did.
    A frame is a distinct t of the unit."""
    frames = df.select(*unit, t).distinct().withColumn("_t0", F.min(t).over(trailing(unit, window, t)))
    now = chosen.select(*unit, t, entity).join(frames, [*unit, t]).join(df.select(*unit, t, entity, F.col(z).alias("_z1")), [*unit, t, entity], "left")
    then = df.select(*unit, F.col(t).alias("_t0"), entity, F.col(z).alias("_z0"), inside.alias("_in"))
    d = now.join(then, [*unit, "_t0", entity], "left")
    persist = F.coalesce((F.col("_t0") < F.col(t)) & F.col("_in"), F.lit(False))
    return d.select(*unit, t, entity, persist.alias("persist"), F.when(persist, F.col("_z1") - F.col("_z0")).alias("displacement"))


def at_or_below(value: str, over) -> Column:
    """Share of the window's known values that are at or below this row's."""
    values = F.collect_list(value).over(over)
    return F.size(F.filter(values, lambda v: v <= F.col(value))) / F.nullif(F.size(values), F.lit(0))
