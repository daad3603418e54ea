"""Joins of observations to events along time: next, last, nearest, counts, containment.

Point-to-point relations (next event, last event) are running aggregates over the union of both tables,
one exchange on the unit and linear in its rows; with `parts`, units are cut by time into so many tasks. Relations of a range to points are equi-joins on (unit,
bucket of time): a range enters each bucket that it meets, so rows meet only those near them, and a
unit of any length is spread over its buckets instead of being one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.parts import PARTS, cut, scan


def _union(frames: DataFrame, events: DataFrame, unit: list[str], t: str, at: str) -> DataFrame:
    marked = frames.withColumn("_event", F.lit(None).cast("long"))
    points = events.where(F.col(at).isNotNull()).select(*unit, F.col(at).cast("long").alias(t), F.col(at).cast("long").alias("_event"))
    return marked.unionByName(points, allowMissingColumns=True).withColumn("_frame", F.col("_event").isNull())


def with_next(frames: DataFrame, events: DataFrame, unit: list[str], t: str = "t", at: str = "at", name: str = "next_event", parts: int | None = None) -> DataFrame:
    """Time of the unit's first event strictly after each row."""
    if parts:
        both = scan(_union(frames, events, unit, t, at), unit, t, {name: ("min", F.col("_event"))}, down=True, frame="before", parts=parts)
        return both.where("_frame").drop("_event", "_frame")
    later = Window.partitionBy(*unit).orderBy(F.desc(t)).rangeBetween(Window.unboundedPreceding, -1)
    return _union(frames, events, unit, t, at).withColumn(name, F.min("_event").over(later)).where("_frame").drop("_event", "_frame")


def with_last(frames: DataFrame, events: DataFrame, unit: list[str], t: str = "t", at: str = "at", name: str = "last_event", parts: int | None = None) -> DataFrame:
    """As-of: time of the unit's last event at or before each row."""
    if parts:
        both = scan(_union(frames, events, unit, t, at), unit, t, {name: ("max", F.col("_event"))}, down=False, frame="range", parts=parts)
        return both.where("_frame").drop("_event", "_frame")
    sofar = Window.partitionBy(*unit).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    return _union(frames, events, unit, t, at).withColumn(name, F.max("_event").over(sofar)).where("_frame").drop("_event", "_frame")


def with_nearest(frames: DataFrame, events: DataFrame, unit: list[str], t: str = "t", at: str = "at", name: str = "nearest_event") -> DataFrame:
    """Time of the unit's event nearest to each row; of two at equal distance the earlier."""
    both = with_next(with_last(frames, events, unit, t, at, "_last"), events, unit, t, at, "_next")
    nearest = F.when(F.col("_last").isNull(), F.col("_next")).when(F.col("_next").isNull() | (F.col(t) - F.col("_last") <= F.col("_next") - F.col(t)), F.col("_last")).otherwise(F.col("_next"))
    return both.withColumn(name, nearest).drop("_last", "_next")


def with_count(frames: DataFrame, events: DataFrame, unit: list[str], t: str = "t", at: str = "at", name: str = "events_so_far", parts: int | None = None) -> DataFrame:
    """Number of the unit's events at or before each row; differences of it count events in a range."""
    if parts:
        both = scan(_union(frames, events, unit, t, at), unit, t, {name: ("count", F.col("_event"))}, down=False, frame="range", parts=parts)
        return both.where("_frame").drop("_event", "_frame")
    sofar = Window.partitionBy(*unit).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    return _union(frames, events, unit, t, at).withColumn(name, F.count("_event").over(sofar)).where("_frame").drop("_event", "_frame")


def with_relations(frames: DataFrame, events: DataFrame, unit: list[str], t: str = "t", at: str = "at", parts: int = PARTS) -> DataFrame:
    """Frames with next_event, last_event, events_so_far and nearest_event, as above, from one union whose units are cut by time into parts."""
    both = cut(_union(frames, events, unit, t, at), t, parts)
    event = F.col("_event")
    both = scan(both, unit, t, {"next_event": ("min", event)}, down=True, frame="before")
    both = scan(both, unit, t, {"last_event": ("max", event), "events_so_far": ("count", event)}, frame="range")
    last, nxt = F.col("last_event"), F.col("next_event")
    nearest = F.when(last.isNull(), nxt).when(nxt.isNull() | (F.col(t) - last <= nxt - F.col(t)), last).otherwise(nxt)
    return both.where("_frame").withColumn("nearest_event", nearest).drop("_event", "_frame", "_part")


def with_containment(points: DataFrame, ranges: DataFrame, unit: list[str], t: str, lo: str, hi: str, name: str = "inside") -> DataFrame:
    """Points with whether t lies in a range lo <= t <= hi of their unit: the greatest end among the ranges that have
    begun. One pass over the union, whatever the ranges' length."""
    ends = ranges.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(*unit, F.col(lo).cast("long").alias(t), F.col(hi).cast("long").alias("_end"))
    both = points.withColumn("_is", F.lit(True)).unionByName(ends, allowMissingColumns=True)
    begun = Window.partitionBy(*unit).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumn(name, F.coalesce(F.max("_end").over(begun) >= F.col(t), F.lit(False))).where("_is")
    return both.drop("_end", "_is")


def buckets(lo: Column, hi: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def points_in_ranges(points: DataFrame, ranges: DataFrame, unit: list[str], t: str, lo: str, hi: str, width: int, how: str = "left_semi") -> DataFrame:
    """Points with (left_semi), without (left_anti) or joined to (inner) ranges lo <= t <= hi of their unit."""
    p = points.withColumn("_bucket", F.floor(F.col(t) / width))
    extra = [c for c in ranges.columns if c not in unit]
    r = ranges.select(*[F.col(c).alias(f"_r_{c}") for c in unit], *extra, buckets(F.col(lo), F.col(hi), width).alias("_r_bucket"))
    on = [F.col(c) == F.col(f"_r_{c}") for c in unit] + [F.col("_bucket") == F.col("_r_bucket"), F.col(t) >= F.col(lo), F.col(t) <= F.col(hi)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return p.join(r, condition, how).drop("_bucket", "_r_bucket", *[f"_r_{c}" for c in unit])
