"""Splits by groups and by time, as columns or plans; nothing is materialised per fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leave_one_out_folds(df: DataFrame, group: str, unit: list[str] | None = None) -> DataFrame:
    """For each group: rows tested and rows trained on when it is held out, and units on both sides (of the group
    itself, if no other is given): anything but 0 is leakage."""
    unit = unit or [group]
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_test"))
    total = df.count()
    pairs = df.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.struct(*unit).alias("_u")).distinct()
    shared = pairs.groupBy("_u").agg(F.count("*").alias("_groups")).where("_groups > 1")
    n = pairs.join(shared, "_u").groupBy("_g").agg(F.count("*").alias("_n"))
    out = g.join(n, F.col(group) == F.col("_g"), "left")
    return out.select(group, "n_test", (F.lit(total) - F.col("n_test")).alias("n_train"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_overlap"))


def fold(df: DataFrame, group: str, held_out) -> tuple[DataFrame, DataFrame]:
    """Training and test rows with a group held out; rows without a group only train."""
    return df.where(~F.col(group).eqNullSafe(F.lit(held_out))), df.where(F.col(group) == F.lit(held_out))


def overlap(train: DataFrame, test: DataFrame, unit: list[str]) -> int:
    """Units on both sides; anything but 0 is leakage."""
    return train.select(*unit).intersect(test.select(*unit)).count()


def refuse_overlap(train: DataFrame, test: DataFrame, unit: list[str]) -> None:
    n = overlap(train, test, unit)
    if n:
        raise ValueError(f"leakage: {n} units on both sides of a split")


def time_blocks(df: DataFrame, blocks: int, embargo: int, unit: list[str] | None = None, t: str = "t") -> DataFrame:
    """Each row once per block with its role: test inside the block of equal duration (half-open, the last
    one closed), train outside it by the embargo or more on either side, gap between. Roles of blocks
    with no train or no test rows are left to the caller (see `viable_blocks`)."""
    span = df.groupBy(*unit).agg(F.min(t).alias("_a"), F.max(t).alias("_z")) if unit else df.agg(F.min(t).alias("_a"), F.max(t).alias("_z"))
    if unit:
        d = df.join(span, unit)
    else:
        a, z = span.first()
        d = df.withColumns({"_a": F.lit(a), "_z": F.lit(z)})
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    width = (F.col("_z") - F.col("_a")) / blocks
    lo, hi = F.col("_a") + width * F.col("block"), F.col("_a") + width * (F.col("block") + 1)
    test = (F.col(t) >= lo) & ((F.col(t) < hi) | ((F.col("block") == blocks - 1) & (F.col(t) <= hi)))
    train = (F.col(t) < lo - embargo) | (F.col(t) >= hi + embargo)
    return d.withColumn("role", F.when(test, "test").when(train, "train").otherwise("gap")).drop("_a", "_z")


def viable_blocks(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = [*(by or []), "block"]
    c = rows.groupBy(*keys).agg(F.count_if(F.col("role") == "test").alias("n_test"), F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "gap").alias("n_gap"))
    return c.where("n_test > 0 and n_train > 0")


def inner_folds(df: DataFrame, group: str) -> DataFrame:
    """Ordered pairs of distinct groups (outer held out, inner held out) with the rows left to train on."""
    g = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    total = df.count()
    names = g.select(F.col(group).alias("g"), F.col("n").alias("m")).limit(10_001).collect()
    if len(names) > 10_000:
        raise ValueError("nested folds of more than 10,000 groups")
    other = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"g":{_json(r.g)},"m":{r.m}}}' for r in names) + "]"), f"array<struct<g:{df.schema[group].dataType.simpleString()},m:bigint>>"))
    pairs = g.withColumn("o", other).where(F.col("o.g") != F.col(group))
    return pairs.select(F.col(group).alias("outer_group"), F.col("o.g").alias("inner_group"), (F.lit(total) - F.col("n") - F.col("o.m")).alias("n_train"))


def _json(x) -> str:
    import json

    return json.dumps(x)


def runs_of(df: DataFrame, y: str, unit: list[str], t: str = "t") -> DataFrame:
    """Positives per event and rate: what a bound on leaf weights is made of (see `leaf_bound`)."""
    w = Window.partitionBy(*unit).orderBy(t)
    up = (F.col(y) == 1) & (F.coalesce(F.lag(y).over(w), F.lit(0)) != 1)
    return df.select(F.col(y).alias("y"), up.cast("int").alias("up")).agg(F.sum("y").alias("positives"), F.greatest(F.lit(1), F.sum("up")).alias("runs"), F.avg("y").alias("rate"))


def leaf_bound(df: DataFrame, y: str, unit: list[str], k_events: float, weight: float = 1.0, t: str = "t") -> float:
    """Least sum of second derivatives in a leaf, in units of events: k * positives per event * p0 (1 - p0) * w."""
    r = runs_of(df, y, unit, t).first()
    return k_events * (r.positives / r.runs) * r.rate * (1 - r.rate) * weight if r.positives else 0.0
