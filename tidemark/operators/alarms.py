"""Hysteresis alarms judged against events: episodes, warned events, empty episodes, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.parts import scan
from tidemark.operators.ranks import quantiles, running
from tidemark.operators.windows import ordered


def with_episodes(df: DataFrame, unit: list[str], t: str = "t", armed: str = "armed") -> DataFrame:
    """Number the maximal armed runs of each unit; null on unarmed rows."""
    w = ordered(unit, t)
    begin = F.col(armed) & ~F.coalesce(F.lag(armed).over(w), F.lit(False))
    number = F.sum(F.col("_begin").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_begin", begin).withColumn("episode", F.when(F.col(armed), number)).drop("_begin")


def episodes(df: DataFrame, unit: list[str], t: str = "t", armed: str = "armed") -> DataFrame:
    e = with_episodes(df, unit, t, armed).where(armed)
    return e.groupBy(*unit, "episode").agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count("*").alias("n_rows"))


def warned_events(df: DataFrame, events: DataFrame, tau: int, unit: list[str], key: str, t: str = "t", at: str = "at", armed: str = "armed") -> DataFrame:
    """Each event with whether a row in [at - tau, at) was armed, and the lead from the start of the
    episode to which the first such row belongs. One pass over the union: an event looks up the first armed
    row from at - tau on."""
    rows = with_episodes(df, unit, t, armed).where(armed)
    rows = rows.select(*unit, F.col(t).cast("long").alias("_t"), F.struct(F.col(t).cast("long").alias("t"), F.min(t).over(Window.partitionBy(*unit, "episode")).alias("t0")).alias("_row"))
    probes = events.withColumn("_t", F.col(at).cast("long") - tau).withColumn("_is", F.lit(True))
    both = probes.unionByName(rows, allowMissingColumns=True)
    later = Window.partitionBy(*unit).orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_first", F.min("_row").over(later)).where("_is")
    hit = F.coalesce(F.col("_first.t") < F.col(at), F.lit(False))
    return out.withColumn("warned", hit).withColumn("lead", F.when(hit, F.col(at) - F.col("_first.t0"))).select(*events.columns, "warned", "lead")


def empty_episodes(eps: DataFrame, events: DataFrame, tau: int, unit: list[str], at: str = "at") -> DataFrame:
    """Episodes with no event from their start to tau after their end: the next event is later, or there is none."""
    from tidemark.operators.intervals import with_next

    nxt = with_next(eps.withColumn("_from", F.col("t0") - 1), events, unit, "_from", at, "_next")
    return nxt.where(F.col("_next").isNull() | (F.col("_next") > F.col("t1") + tau)).select(*eps.columns)


def alarm_metrics(df: DataFrame, events: DataFrame, tau: int, unit: list[str], key: str, t: str = "t", at: str = "at", armed: str = "armed") -> DataFrame:
    """Per unit: duty cycle, events and the share warned, lead median and 10th and 90th percentiles,
    episodes and how many were empty. Shares without a denominator are null, counts 0."""
    duty = df.groupBy(*unit).agg(F.count("*").alias("n_rows"), F.avg(F.col(armed).cast("int")).alias("duty"))
    w = warned_events(df, events, tau, unit, key, t, at, armed).groupBy(*unit).agg(
        F.count("*").alias("n_events"), F.avg(F.col("warned").cast("int")).alias("warned"), F.median("lead").alias("lead_median"),
        F.percentile("lead", 0.1).alias("lead_p10"), F.percentile("lead", 0.9).alias("lead_p90"),
    )
    eps = episodes(df, unit, t, armed)
    n = eps.groupBy(*unit).agg(F.count("*").alias("n_episodes"))
    none = empty_episodes(eps, events, tau, unit, at).groupBy(*unit).agg(F.count("*").alias("n_empty"))
    return duty.join(w, unit, "left").join(n, unit, "left").join(none, unit, "left").fillna(0, ["n_events", "n_episodes", "n_empty"])


def leave_one_out_quantile(df: DataFrame, unit: str, value: str, q: float) -> DataFrame:
    """For each unit the exact interpolated quantile of the values of all other units.

    Values are counted once over the pool. Of the others, those up to a unit's own value v are the pool's less its own up to v, so a
    unit's own values of which the others have k or fewer lie below the others' k-th, which is then the pool's at k and their
    number: two ranks per unit, looked up in the pool's running counts. All steps are linear in the rows; units without a
    name are no unit's others.
    """
    d = df.where(F.col(value).isNotNull() & F.col(unit).isNotNull()).select(F.col(unit).alias("u"), F.col(value).cast("double").alias("v"))
    own = running(d.groupBy("u", "v").agg(F.count("*").alias("c")), ["u"], "v", ["c"])
    pool = running(d.groupBy("v").agg(F.count("*").alias("c")), [], "v", ["c"]).select("v", F.col("upto_c").alias("upto"), F.col("all_c").alias("n"))
    rows = own.withColumnRenamed("all_c", "m").join(pool, "v").withColumn("rest", F.col("n") - F.col("m")).where("rest > 0")
    k = F.lit(q) * (F.col("rest") - 1)
    rows = rows.withColumns({"lo": F.floor(k), "frac": k - F.floor(k), "others": F.col("upto") - F.col("upto_c")})
    hi = F.least(F.col("lo") + 1, F.col("rest") - 1)
    below = lambda rank: F.coalesce(F.sum(F.when(F.col("others") <= rank, F.col("c"))), F.lit(0))
    ranks = rows.groupBy("u", "lo", "rest", "frac").agg((F.col("lo") + below(F.col("lo"))).alias("a"), (hi + below(hi)).alias("b"))
    wanted = ranks.select(F.explode(F.array("a", "b")).alias("rank")).distinct().withColumn("upto", F.col("rank") + 1)  # the first value with so many up to it
    found = scan(wanted.unionByName(pool.select("upto", "v"), allowMissingColumns=True), [], "upto", {"at": ("min", F.col("v"))}, down=True, frame="range").where("rank is not null")
    at = lambda name: found.select(F.col("rank").alias(name), F.col("at").alias(f"v_{name}"))
    pick = ranks.join(at("a"), "a").join(at("b"), "b")
    return pick.select(F.col("u").alias(unit), (F.col("v_a") + (F.col("v_b") - F.col("v_a")) * F.col("frac")).alias("threshold"))


def duty_matched(df: DataFrame, unit: list[str], score: str, duty: float) -> DataFrame:
    """Rows armed where the score exceeds the unit's own (1 - duty) quantile."""
    q = quantiles(df, unit, score, [1 - duty]).select(*unit, F.col("q")[0].alias("threshold"))
    return df.join(q, unit).withColumn("armed", F.coalesce(F.col(score) > F.col("threshold"), F.lit(False)))


def others_alarm(df: DataFrame, unit: str, score: str, on: float, off: float, smooth: int, t: str = "t") -> DataFrame:
    """The alarm on the score's trailing mean, armed and released at quantiles of the other units' scores. A unit
    alone in the table has no thresholds and no rows here."""
    from tidemark.operators.windows import latch, trailing

    a, b = (leave_one_out_quantile(df, unit, score, q).withColumnRenamed("threshold", n) for q, n in ((on, "on_threshold"), (off, "off_threshold")))
    d = df.join(a.join(b, unit), unit).withColumn("smoothed", F.avg(score).over(trailing([unit], smooth, t)))
    return latch(d, "smoothed", F.col("on_threshold"), F.col("off_threshold"), [unit], t)


def random_null(df: DataFrame, events: DataFrame, tau: int, unit: list[str], key: str, shifts: int = 50, shift=None, t: str = "t", at: str = "at", armed: str = "armed") -> DataFrame:
    """Mean share of warned events per unit when the alarm is turned round in time, which keeps its episodes and breaks
    their tie to the events: what an alarm of this shape reaches without knowing anything. `shift(i, n)` is the number
    of rows, 1 to n - 1, of turn i in a unit of n rows; by default drawn by a hash of unit and turn."""
    from tidemark.operators.windows import cyclic_shift

    draw = shift or (lambda i, n: F.pmod(F.xxhash64(F.lit("null"), *unit, i), n - 1) + 1)
    n = df.groupBy(*unit).agg(F.count("*").alias("_n")).where("_n > 1")
    turns = n.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))))
    turns = turns.select(*unit, "turn", draw(F.col("turn"), F.col("_n")).alias("_k"))
    each = df.select(*unit, t, armed).join(turns, unit)
    turned = cyclic_shift(each, armed, F.col("_k"), [*unit, "turn"], t).select(*unit, "turn", t, F.col("shifted").alias(armed))
    probes = events.join(turns.select(*unit, "turn"), unit)
    w = warned_events(turned, probes, tau, [*unit, "turn"], key, t, at, armed)
    share = w.groupBy(*unit, "turn").agg(F.avg(F.col("warned").cast("int")).alias("_w"))
    return share.groupBy(*unit).agg(F.avg("_w").alias("null_warned"), F.count("*").alias("turns"))
