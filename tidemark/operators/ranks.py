"""Running totals and exact quantiles over the ordered values of a group, in parallel within it.

Values are cut at approximate quantiles of the whole column into parts of about equal size. Totals run within
the parts and are shifted by those of the parts before, so a group of any size is spread over many tasks;
nothing but one row per group and part is ever ordered in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 32


def running(counted: DataFrame, by: list[str], value: str, columns: list[str], down: bool = False, parts: int = PARTS) -> DataFrame:
    """`counted` (one row per group and numeric value) with upto_<c> for each column, its sum over the group's rows up to
    this value (from the greatest one down, if so), and all_<c>, its sum over the group. Null values are left out."""
    d = counted.where(F.col(value).isNotNull())
    v = F.col(value).cast("double")
    finite = F.when(F.abs(v) < math.inf, v)
    edges = d.agg(F.array_distinct(F.percentile_approx(finite, [k / parts for k in range(1, parts)], 1000)).alias("_edges"))
    # One row beside all others: the cuts are part of the plan, and the counts before them one exchange that Spark reuses.
    part = F.greatest(F.coalesce(F.size(F.filter("_edges", lambda e: e < v)), F.lit(0)), F.lit(0))
    d = d.crossJoin(F.broadcast(edges)).withColumn("_part", -part if down else part).drop("_edges")
    totals = d.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(*[F.col(c).alias(f"_g_{c}") for c in by], F.col("_part").alias("_p"), *[x for c in columns for x in (F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_s_{c}"), F.sum(f"_t_{c}").over(whole).alias(f"all_{c}"))])
    on = F.col("_part") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    within = Window.partitionBy(*by, "_part").orderBy(F.desc(value) if down else F.asc(value)).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"_w_{c}": F.sum(c).over(within) for c in columns}).join(shift, on)
    return d.select(*counted.columns, *[(F.col(f"_w_{c}") + F.col(f"_s_{c}")).alias(f"upto_{c}") for c in columns], *[F.col(f"all_{c}") for c in columns])


def quantiles(df: DataFrame, by: list[str], value: str, qs: list[float], name: str = "q") -> DataFrame:
    """Exact interpolated quantiles of each group's values as an array `name`, and their number n; groups without a
    value are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    r = running(counted, by, value, ["_c"])
    picks = []
    for i, q in enumerate(qs):
        at = F.lit(float(q)) * (F.col("all__c") - 1)
        for end, k in (("a", F.floor(at)), ("b", F.ceil(at))):
            picks.append(F.min(F.when(F.col("upto__c") > k, F.col(value))).alias(f"_{end}{i}"))
    g = r.groupBy(*by).agg(F.max("all__c").alias("n"), *picks)

    def at(i: int, q: float) -> Column:
        k = F.lit(float(q)) * (F.col("n") - 1)
        return F.when(F.col(f"_a{i}") == F.col(f"_b{i}"), F.col(f"_a{i}").cast("double")).otherwise((F.ceil(k) - k) * F.col(f"_a{i}") + (k - F.floor(k)) * F.col(f"_b{i}"))

    return g.select(*by, "n", F.array(*[at(i, q) for i, q in enumerate(qs)]).alias(name))


def column_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float]]:
    """Exact quantiles of several columns; columns without a value are absent."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    rows = quantiles(df.select(each.alias("x")).select("x.c", "x.v"), ["c"], "v", qs).collect()  # one row per column
    return {r.c: list(r.q) for r in rows}
