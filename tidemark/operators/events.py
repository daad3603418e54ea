"""Event detection: passes through an ordered ladder of zones, as window expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.parts import previous, scan

BELOW, LOWER, INSIDE, UPPER, ABOVE, OUTSIDE = 0, 1, 2, 3, 4, -9


def zone(z: Column, r: Column, low: float, high: float, slab_low: float, slab_high: float, radius: float) -> Column:
    """Zone of a point: the slab inside the cylinder is 2, the slab beside it -9, then the ends, then the rest."""
    slab = (z >= slab_low) & (z <= slab_high)
    return F.when(slab & (r <= radius), INSIDE).when(slab, OUTSIDE).when(z <= low, BELOW).when(z >= high, ABOVE).when(z < slab_low, LOWER).otherwise(UPPER)


def zone_planes(low: Column, high: Column) -> tuple[Column, Column]:
    """Slab planes halfway between the middle and either end."""
    middle = (low + high) / 2
    return (low + middle) / 2, (high + middle) / 2


def ladder_events(rows: DataFrame, track: list[str], t: str = "t", zone: str = "zone", wrap: str | None = None, parts: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """Full one-way passes 0 -> 2 -> 4 or 4 -> 2 -> 0 of each track (unit and entity).

    A track's rows fall into segments that begin where a state machine would forget its origin: on the first
    row, on a periodic wrap, and on each change into an end or out of bounds. An event is a change into
    an end from a segment that began in the other end and went through the middle; its entry is the
    last change into the middle. Sequence work is one exchange on the track; with `parts`, tracks are cut by time
    into so many tasks: what a part must know of those before is its last zone and how many segments have begun, and
    segments meet the ones before them by a join. Times are distinct within tracks, or `tie` orders rows of the same time.
    """
    tie = tie or []
    w = Window.partitionBy(*track).orderBy(t, *tie)
    at = F.struct(t, *tie) if tie else F.col(t)
    wrapped = F.col(wrap) if wrap else F.lit(False)
    if parts:
        d = previous(rows, track, t, {"_pz": zone}, parts, tie)
    else:
        d = rows.withColumns({"_pz": F.lag(zone).over(w), "_first": F.row_number().over(w) == 1})
    d = d.withColumn("_wrap", F.coalesce(wrapped, F.lit(False)) & ~F.col("_first"))
    d = d.withColumn("_chg", ~F.col("_first") & (F.col(zone) != F.col("_pz")) & ~F.col("_wrap"))
    d = d.withColumn("_reset", F.col("_first") | F.col("_wrap") | (F.col("_chg") & F.col(zone).isin(BELOW, ABOVE, OUTSIDE)))
    if parts:
        d = scan(d, track, t, {"_seg": ("sum", F.col("_reset").cast("int"))}, parts=parts, tie=tie)
    else:
        d = d.withColumn("_seg", F.sum(F.col("_reset").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    enter = F.when(F.col("_chg") & (F.col(zone) == INSIDE), F.struct(F.col(t).alias("t"), *tie, F.col("_pz").isin(LOWER, UPPER).alias("seen")))
    seg = d.groupBy(*track, "_seg").agg(
        F.min(t).alias("t_exit"),
        F.min_by(F.col(zone), at).alias("origin"),
        F.min_by(F.col("_chg"), at).alias("by_change"),
        F.max(enter).alias("enter"),
    )
    if parts:
        prior = seg.select(*track, (F.col("_seg") + 1).alias("_seg"), F.col("origin").alias("from_"), F.col("enter").alias("in_"))
        seg = seg.join(prior, [*track, "_seg"], "left")
    else:
        s = Window.partitionBy(*track).orderBy("_seg")
        seg = seg.withColumns({"from_": F.lag("origin").over(s), "in_": F.lag("enter").over(s)})
    hit = seg.where(F.col("by_change") & F.col("origin").isin(BELOW, ABOVE) & (F.col("from_") == 4 - F.col("origin")) & F.col("in_").isNotNull())
    return hit.select(*track, F.col("in_.t").alias("t_entry"), "t_exit", F.col("in_.seen").alias("entrance_observed"), F.when(F.col("origin") == ABOVE, 1).otherwise(-1).alias("direction"))


def left_censored(rows: DataFrame, track: list[str], t: str = "t", zone: str = "zone") -> DataFrame:
    """Tracks whose first row is in neither end."""
    return rows.groupBy(*track).agg((~F.min_by(zone, t).isin(BELOW, ABOVE)).alias("left_censored"))


def flux_sign(events: DataFrame, unit: list[str]) -> DataFrame:
    return events.groupBy(*unit).agg(F.count("*").alias("n_events"), F.sum("direction").alias("net"), F.signum(F.sum("direction")).cast("int").alias("flux_sign"))


def of_direction(events: DataFrame, direction: int | None) -> DataFrame:
    """Events of a direction; those of unknown direction (0) always stay, and all do without a direction."""
    return events if direction is None else events.where(F.col("direction").isin(direction, 0))


def compare_sources(own: DataFrame, given: DataFrame, unit: list[str], within: int, at: str = "at") -> DataFrame:
    """For each unit: counts of both sources, and how far the given events are from the nearest own one."""
    from tidemark.operators.intervals import with_nearest

    near = with_nearest(given.withColumnRenamed(at, "t"), own, unit, "t", at).withColumn("shift", F.abs(F.col("nearest_event") - F.col("t")))
    a = own.groupBy(*unit).agg(F.count("*").alias("n_own"))
    b = near.groupBy(*unit).agg(F.count("*").alias("n_given"), F.median("shift").alias("median_shift"), F.percentile("shift", 0.9).alias("p90_shift"), F.avg(F.coalesce(F.col("shift") <= within, F.lit(False)).cast("int")).alias("matched"))
    return a.join(b, unit, "full_outer").fillna(0, ["n_own", "n_given"])


def label_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Jaccard similarity of two label vectors on a common grid; null where neither has a positive."""
    both = a.select(*keys, "tau", F.col("y").alias("ya")).join(b.select(*keys, "tau", F.col("y").alias("yb")), [*keys, "tau"])
    return both.groupBy("tau").agg((F.sum(F.col("ya") * F.col("yb")) / F.nullif(F.sum(F.greatest("ya", "yb")), F.lit(0))).alias("jaccard"))


def checked_flux(events: DataFrame, unit: list[str], declared: int | None = None) -> tuple[DataFrame, int]:
    """`flux_sign` with whether a unit disagrees with the majority, and the majority's direction. A declared direction
    that the majority contradicts is an error."""
    signs = flux_sign(events, unit)
    net = signs.agg(F.coalesce(F.sum("flux_sign"), F.lit(0))).first()[0]
    majority = (net > 0) - (net < 0)
    if declared and majority and declared != majority:
        raise ValueError(f"direction {declared} is declared, most units go the other way")
    way = declared or majority
    return signs.withColumn("disagrees", (F.col("flux_sign") != 0) & (F.col("flux_sign") != way) & F.lit(way != 0)), way
