"""Forward-horizon labels with right-censoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import with_containment, with_next


def forward_labels(frames: DataFrame, events: DataFrame, taus: list[int], unit: list[str], t: str = "t", at: str = "at") -> DataFrame:
    """A row for each frame and horizon: y = 1 where an event of the unit is in (t, t + tau]; valid where
    y = 1 or the unit is observed up to t + tau. All horizons share one pass over each unit."""
    known = with_next(frames, events, unit, t, at, "_next").withColumn("_t_last", F.max(t).over(Window.partitionBy(*unit)))
    known = known.withColumn("tau", F.explode(F.array(*[F.lit(x).cast("long") for x in taus])))
    y = F.coalesce(F.col("_next") - F.col(t) <= F.col("tau"), F.lit(False))
    return known.withColumns({"y": y.cast("int"), "valid": y | (F.col(t) + F.col("tau") <= F.col("_t_last"))}).drop("_next", "_t_last")


def label_columns(frames: DataFrame, events: DataFrame, taus: dict[tuple[str, str], int], unit: list[str], t: str = "t", at: str = "at") -> DataFrame:
    """The labels of forward_labels as columns, named (y, valid) for each horizon: a row stays one row, in one pass over each unit."""
    return _columns(with_next(frames, events, unit, t, at, "_next").withColumn("_t_last", F.max(t).over(Window.partitionBy(*unit))), taus, t)


def own_label_columns(frames: DataFrame, event: Column, taus: dict[tuple[str, str], int], unit: list[str], t: str = "t") -> DataFrame:
    """label_columns where the events are those rows of the table that satisfy a condition: nothing is read or dealt out a second time."""
    later = Window.partitionBy(*unit).orderBy(F.desc(t)).rangeBetween(Window.unboundedPreceding, -1)
    known = {"_next": F.min(F.when(event, F.col(t).cast("long"))).over(later), "_t_last": F.first(t).over(later.rowsBetween(Window.unboundedPreceding, 0))}
    return _columns(frames.withColumns(known), taus, t)


def _columns(known: DataFrame, taus: dict[tuple[str, str], int], t: str) -> DataFrame:
    out = {}
    for (y, valid), tau in taus.items():
        out[y] = F.coalesce(F.col("_next") - F.col(t) <= tau, F.lit(False))
        out[valid] = out[y] | (F.col(t) + tau <= F.col("_t_last"))
        out[y] = out[y].cast("int")
    return known.withColumns(out).drop("_next", "_t_last")


def wide_labels(labels: DataFrame, taus: list[int], keys: list[str]) -> DataFrame:
    """One row per frame, with y_tau<n> and valid_tau<n> for each horizon."""
    at = lambda c, x: F.max(F.when(F.col("tau") == x, F.col(c)))
    return labels.groupBy(*keys).agg(*[a for x in taus for a in (at("y", x).alias(f"y_tau{x}"), at("valid", x).alias(f"valid_tau{x}"))])


def in_interval(frames: DataFrame, ranges: DataFrame, unit: list[str], t: str = "t", lo: str = "t_entry", hi: str = "t_exit") -> DataFrame:
    """Frames with whether t is in a range of the unit, ends included."""
    return with_containment(frames, ranges, unit, t, lo, hi, "in_interval")


def label_summary(labels: DataFrame, by: list[str]) -> DataFrame:
    """Rows, positives, censored rows, and the base rate over valid rows and over all rows."""
    ok = F.col("valid")
    return labels.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.sum("y").alias("n_positive"),
        F.count_if(~ok).alias("n_censored"),
        F.avg(F.when(ok, F.col("y"))).alias("base_rate_valid"),
        F.avg("y").alias("base_rate_all"),
    )


def relabel(table: DataFrame, events: DataFrame, tau: int, unit: list[str], y: str, t: str = "t", at: str = "at") -> DataFrame:
    """The table's own label column where it is complete, else labels rebuilt from events; other values
    than 0 and 1 are refused."""
    if y in table.columns:
        n, missing, odd = table.agg(F.count("*"), F.count_if(F.col(y).isNull()), F.count_if(~F.col(y).isin(0, 1))).first()
        if odd:
            raise ValueError(f"{y} is not binary")
        if n and not missing:
            return table
        table = table.drop(y)
    built = forward_labels(table, events, [tau], unit, t, at)
    return built.withColumn(y, F.col("y")).drop("y", "tau", "valid") if y != "y" else built.drop("tau", "valid")
