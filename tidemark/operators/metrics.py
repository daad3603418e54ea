"""Ranking and calibration metrics as one plan over any grouping.

Scores are first counted per distinct value; totals along them run in parallel within a group (see `ranks`), so a
pooled metric of continuous scores is spread over many tasks. Undefined metrics (one class only) are null. Null
scores are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import quantiles, running


def by_score(df: DataFrame, by: list[str], y: str = "y", score: str = "score", weight: Column | None = None) -> DataFrame:
    """Weighted positives and rows of each distinct score."""
    w = weight if weight is not None else F.lit(1)
    return df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(*by, score).agg(F.sum(F.col(y) * w).alias("tp"), F.sum(w).alias("n"))


def average_precision(df: DataFrame, by: list[str], y: str = "y", score: str = "score", counted: bool = False) -> DataFrame:
    """Step-wise average precision with ties grouped, base rate, and their ratio."""
    c = df if counted else by_score(df, by, y, score)
    c = running(c, by, score, ["tp", "n"], down=True).withColumn("_part", F.col("tp") * F.col("upto_tp") / F.col("upto_n"))
    out = c.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.sum("tp").alias("n_positive"), F.sum("_part").alias("_sum"))
    defined = (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n_rows"))
    ap = F.when(defined, F.col("_sum") / F.col("n_positive"))
    base = F.col("n_positive") / F.col("n_rows")
    return out.select(*by, "n_rows", "n_positive", base.alias("base_rate"), ap.alias("ap"), (ap / base).alias("ratio"))


def roc_auc(df: DataFrame, by: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Area under the ROC curve; tied pairs count a half."""
    c = running(by_score(df, by, y, score), by, score, ["tp", "n"])
    below = F.col("upto_n") - F.col("upto_tp") - (F.col("n") - F.col("tp"))
    c = c.withColumn("_won", F.col("tp") * (below + (F.col("n") - F.col("tp")) / 2))
    out = c.groupBy(*by).agg(F.sum("_won").alias("won"), F.sum("tp").alias("p"), F.sum("n").alias("n"))
    return out.select(*by, F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.col("won") / (F.col("p") * (F.col("n") - F.col("p")))).alias("auc"))


def brier(df: DataFrame, by: list[str], y: str = "y", p: str = "prob") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def curve(df: DataFrame, by: list[str], y: str = "y", score: str = "score", counted: bool = False) -> DataFrame:
    """For each distinct score as a threshold: true and false positives, precision, recall, false-positive rate."""
    c = running(df if counted else by_score(df, by, y, score), by, score, ["tp", "n"], down=True)
    c = c.withColumnsRenamed({"upto_tp": "tps", "upto_n": "_cum", "all_tp": "_p", "all_n": "_n"})
    fps = F.col("_cum") - F.col("tps")
    rate = lambda a, b: a / F.nullif(b, F.lit(0))
    return c.select(*by, F.col(score).alias("threshold"), "tps", fps.alias("fps"), (F.col("tps") / F.col("_cum")).alias("precision"), rate(F.col("tps"), F.col("_p")).alias("recall"), rate(fps, F.col("_n") - F.col("_p")).alias("fpr"))


def f1_threshold(df: DataFrame, by: list[str], y: str = "y", score: str = "score", counted: bool = False) -> DataFrame:
    """Threshold of the best F1, the lowest of equal ones; 0.5 without positives."""
    c = curve(df, by, y, score, counted).withColumn("f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)))
    best = c.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("low"))).alias("b"), F.max("tps").alias("p"))
    return best.select(*by, F.when(F.col("p") > 0, -F.col("b.low")).otherwise(F.lit(0.5)).alias("threshold"), F.when(F.col("p") > 0, F.col("b.f1")).alias("f1"))


def confusion(df: DataFrame, by: list[str], y: str = "y", verdict: str = "verdict") -> DataFrame:
    """Counts of the two verdicts against y over judged rows; balanced accuracy, MCC, F1 (null where undefined)."""
    d = df.where(F.col(verdict).isNotNull() & F.col(y).isNotNull())
    v, t = F.col(verdict), F.col(y) == 1
    c = d.groupBy(*by).agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("tp", v & t), ("fp", v & ~t), ("fn", ~v & t), ("tn", ~v & ~t))])
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    none = lambda x: F.nullif(x, F.lit(0.0))
    return c.select(
        *by, *[F.col(n).cast("long").alias(n) for n in ("tp", "fp", "fn", "tn")],
        ((tp / none(tp + fn) + tn / none(tn + fp)) / 2).alias("balanced_accuracy"),
        ((tp * tn - fp * fn) / none(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))).alias("mcc"),
        (2 * tp / none(2 * tp + fp + fn)).alias("f1"),
    )


def percentile_rank(df: DataFrame, by: list[str], value: str, name: str = "pct_rank") -> DataFrame:
    """Average rank of the value among the group's non-null values, divided by their number; null for null."""
    ties = running(df.groupBy(*by, value).agg(F.count("*").alias("_c")), by, value, ["_c"])
    ranks = ties.select(*by, value, ((F.col("upto__c") - (F.col("_c") - 1) / 2) / F.col("all__c")).alias(name))
    return df.join(ranks, [*by, value], "left")


def reliability_bins(df: DataFrame, by: list[str], bins: int = 10, y: str = "y", p: str = "prob") -> DataFrame:
    """Mean p and mean y between quantile edges, bins (a, b] and the first one closed; equal edges collapse."""
    points = [k / bins for k in range(bins + 1)]
    edges = quantiles(df, by, p, points, "edges").select(*by, F.array_distinct("edges").alias("edges"))
    placed = df.join(edges, by).withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col(p)))))
    return placed.where(F.col(p).isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n_rows"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def weighted_ap(df: DataFrame, weights: DataFrame, unit: list[str], draw: str = "boot", y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Average precision of resamples of whole units. `weights` says how often each draw takes each unit;
    rows are counted per (unit, score) first, so a draw costs distinct scores, not rows."""
    by = by or []
    counted = df.where(F.col(score).isNotNull()).groupBy(*by, *unit, score).agg(F.sum(y).alias("_tp"), F.count("*").alias("_n"))
    drawn = counted.join(weights, unit).groupBy(*by, draw, score).agg(F.sum(F.col("_tp") * F.col("w")).alias("tp"), F.sum(F.col("_n") * F.col("w")).alias("n"))
    return average_precision(drawn, [*by, draw], y, score, counted=True)


def paired_bootstrap(df: DataFrame, weights: DataFrame, unit: list[str], a: str = "a", b: str = "b", y: str = "y", draw: str = "boot") -> DataFrame:
    """Difference of the average precision of two scores, a row per draw: boot, ap_a, ap_b, difference (null where the draw
    has one class). The same drawn units weigh both scores, so what comes from the draw cancels. Rows that one of the
    scores lacks count for neither. Rows are counted per (unit, score) before the weights are joined, once for both."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), F.col(c).cast("double").alias("score")) for n, c in (("a", a), ("b", b))]))
    aps = weighted_ap(both.select(*unit, y, each.alias("_s")).select(*unit, y, "_s.*"), weights, unit, draw, y, "score", ["arm"])
    at = lambda n: F.max(F.when(F.col("arm") == n, F.col("ap")))
    return aps.groupBy(draw).agg(at("a").alias("ap_a"), at("b").alias("ap_b")).withColumn("difference", F.col("ap_a") - F.col("ap_b"))


def paired_interval(draws: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Mean difference and its percentile interval; draws of one class are counted and skipped."""
    q = F.percentile("difference", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return draws.agg(F.avg("difference").alias("mean_difference"), q[0].alias("low"), q[1].alias("high"), F.count("difference").alias("used"), F.count_if(F.col("difference").isNull()).alias("skipped"))


def bootstrap_weights(units: DataFrame, draws: int, seed: str = "bootstrap") -> DataFrame:
    """How often each of `draws` resamples takes each unit (with replacement), reproducible from the seed.
    `units` has one column and is small next to the rows that it names."""
    name = units.columns[0]
    once = units.where(F.col(name).isNotNull()).distinct()
    n = once.count()
    # Place i of a draw takes the unit of that number; numbers follow the units' hashes.
    number = lambda text: F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    hashed = once.withColumn("_h", number(F.col(name).cast("string")))
    counted = running(hashed.groupBy("_h").agg(F.count("*").alias("_c")), [], "_h", ["_c"])
    tied = F.row_number().over(Window.partitionBy("_h").orderBy(name))
    numbered = hashed.withColumn("_tie", tied).join(counted, "_h").select(name, (F.col("upto__c") - F.col("_c") + F.col("_tie") - 1).cast("int").alias("_i"))
    picks = units.sparkSession.range(draws * n).select(F.floor(F.col("id") / n).alias("boot"), F.pmod(number(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.lit(n)).cast("int").alias("_i"))
    return picks.groupBy("boot", "_i").agg(F.count("*").alias("w")).join(numbered, "_i").drop("_i")


def bootstrap_interval(aps: DataFrame, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """Percentile interval of the resampled AP; resamples of one class are counted and skipped."""
    q = F.percentile("ap", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return aps.groupBy(*(by or [])).agg(F.count("ap").alias("used"), F.count_if(F.col("ap").isNull()).alias("skipped"), q[0].alias("low"), q[1].alias("high"))
