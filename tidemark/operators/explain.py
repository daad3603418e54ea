"""Why a score is low: contributions by column rolled up to axes, and readable answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _negative(c: str) -> Column:
    return -F.least(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))


def axis_push(df: DataFrame, axes: dict[str, list[str]], floor: float) -> DataFrame:
    """Per row: the sum of negative contributions of each axis, the axis with the greatest one ("unclear"
    up to the floor; the first of equals), the column with the most negative contribution in it, and a reason."""
    names = list(axes)
    d = df.withColumns({f"push_{a}": sum((_negative(c) for c in cs), F.lit(0.0)) for a, cs in axes.items()})
    best = F.array_max(F.array(*[F.struct(F.col(f"push_{a}").alias("v"), F.lit(-i).alias("o"), F.lit(a).alias("a")) for i, a in enumerate(names)]))
    d = d.withColumn("_best", best).withColumn("axis", F.when(F.col("_best.v") > floor, F.col("_best.a")).otherwise("unclear"))

    def driver(cs: list[str]) -> Column:
        return F.array_min(F.array(*[F.struct(F.coalesce(F.col(c), F.lit(0.0)).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(cs)]))

    of = F.lit(None).cast("struct<v:double,i:int,c:string>")
    for a in reversed(names):
        of = F.when(F.col("axis") == a, driver(axes[a])).otherwise(of)
    d = d.withColumn("_driver", of)
    reason = F.when(F.col("axis") == "unclear", F.lit("no axis stands out")).otherwise(F.format_string("%s: %s pushes by %.3f", F.col("axis"), F.col("_driver.c"), -F.col("_driver.v")))
    return d.withColumns({"driver": F.col("_driver.c"), "reason": reason}).drop("_best", "_driver")


def top_axes(df: DataFrame, axes: dict[str, list[str]], k: int, keys: list[str]) -> DataFrame:
    """The k axes with the greatest absolute contribution of each row, and their shares."""
    total = lambda cs: sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cs), F.lit(0.0))
    parts = F.array(*[F.struct((-F.abs(total(cs))).alias("o"), F.lit(a).alias("axis"), total(cs).alias("value")) for a, cs in axes.items()])
    d = df.select(*keys, F.array_sort(parts).alias("p"))
    whole = F.aggregate("p", F.lit(0.0), lambda acc, x: acc - x["o"])
    return d.select(*keys, F.posexplode(F.slice("p", 1, k)).alias("rank", "x"), whole.alias("_w")).select(*keys, "rank", "x.axis", "x.value", (F.abs("x.value") / F.nullif(F.col("_w"), F.lit(0.0))).alias("share"))


def global_importance(df: DataFrame, columns: list[str], block_of: dict[str, str]) -> DataFrame:
    """Mean absolute contribution of each column, with its block."""
    one = df.agg(*[F.avg(F.abs(c)).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(block_of[c]).alias("block"), F.col(c).alias("importance")) for c in columns]))
    return one.select(each.alias("c")).select("c.*")


def axis_specificity(df: DataFrame, fired: str, y: str, by: list[str]) -> DataFrame:
    """How often an axis fires on rows of either class, and the odds ratio (null where undefined)."""
    f = F.col(fired).cast("double")
    a, b = F.avg(F.when(F.col(y) == 1, f)), F.avg(F.when(F.col(y) == 0, f))
    out = df.groupBy(*by).agg(a.alias("rate_positive"), b.alias("rate_negative"), F.avg(f).alias("rate"))
    odds = lambda c: F.col(c) / F.nullif(1 - F.col(c), F.lit(0.0))
    return out.withColumn("odds_ratio", odds("rate_negative") / F.nullif(odds("rate_positive"), F.lit(0.0))).withColumn("near_universal", F.col("rate") > 0.95)


def verdict(prob: Column, threshold: Column) -> Column:
    """READY, NOT_READY, or N/A where either is missing."""
    return F.when(prob.isNull() | threshold.isNull(), "N/A").when(prob >= threshold, "READY").otherwise("NOT_READY")


def point_query(df: DataFrame, requests: DataFrame, unit: list[str], t: str = "t", at: str = "at") -> DataFrame:
    """The row nearest to each requested time of its unit (the earlier of two), and how far off it is."""
    from tidemark.operators.intervals import with_nearest

    near = with_nearest(requests.withColumnRenamed(at, "_at"), df.select(*unit, F.col(t).alias("at")), unit, "_at", "at", "_t")
    out = near.join(df.withColumnRenamed(t, "_t"), [*unit, "_t"], "left")
    return out.withColumn("offset", F.col("_t") - F.col("_at")).withColumnsRenamed({"_t": t, "_at": at})


def range_query(df: DataFrame, lo: int, hi: int, window: int = 0, t: str = "t", measure=None) -> DataFrame:
    """measure(rows) for the rows in [lo, hi]: it is given those that a trailing window needs before them as well, and
    what it makes of these is left out again."""
    rows = df.where(F.col(t).between(lo - window, hi))
    return (measure(rows) if measure else rows).where(F.col(t) >= lo)


def stretch_summary(df: DataFrame, by: list[str], prob: str, threshold: Column) -> DataFrame:
    """Median, quartiles and maximum of the probability; rows at or over the threshold and their share."""
    ready = F.col(prob) >= threshold
    return df.groupBy(*by).agg(F.median(prob).alias("median"), F.percentile(prob, 0.25).alias("q1"), F.percentile(prob, 0.75).alias("q3"), F.max(prob).alias("top"), F.count_if(ready).alias("n_ready"), F.avg(ready.cast("int")).alias("ready_frac"))
