"""Reports over out-of-fold scores: one row per (observation, arm) with fold, y, valid, score and, where the arm has
them, probabilities. Rows are never collected; folds and arms are few and come as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.explain import verdict
from tidemark.operators.ranks import quantiles, running
from tidemark.operators.tables import largest_group

POOLED = "pooled"


def evaluation(oof: DataFrame, arm: str = "arm", fold: str = "fold", y: str = "y", score: str = "score", prob: str = "prob", valid: str = "valid") -> DataFrame:
    """For each arm, over all folds ("pooled") and in each: rows, positives, base rate, average precision and its ratio to
    chance, AUC, Brier score where there are probabilities, and the reason where nothing can be ranked."""
    part = F.explode(F.array(F.lit(POOLED), F.col(fold).cast("string"))).alias("part")
    d = oof.where(F.col(valid)).select(arm, part, F.col(y).alias("y"), F.col(score).alias("score"), F.col(prob).alias("prob"))
    by = [arm, "part"]
    ap = metrics.average_precision(d, by)
    auc = metrics.roc_auc(d, by)
    brier = metrics.brier(d.where("prob is not null"), by)
    reason = F.when(F.col("n_positive") == 0, "no positives").when(F.col("n_positive") == F.col("n_rows"), "no negatives")
    return ap.join(auc, by, "left").join(brier, by, "left").withColumn("degenerate", reason)


def fold_thresholds(oof: DataFrame, arm: str = "arm", fold: str = "fold", y: str = "y", prob: str = "prob", valid: str = "valid") -> DataFrame:
    """For each arm and fold the threshold of the best F1 over the valid rows of the other folds."""
    d = oof.where(F.col(valid) & F.col(prob).isNotNull()).groupBy(arm, fold, prob).agg(F.sum(y).alias("tp"), F.count("*").alias("n"))
    folds = F.broadcast(oof.select(F.col(fold).alias("_held")).distinct())  # folds are few
    others = d.join(folds, F.col(fold) != F.col("_held")).groupBy(arm, "_held", prob).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    best = metrics.f1_threshold(others, [arm, "_held"], score=prob, counted=True)
    return best.select(arm, F.col("_held").alias(fold), "threshold", "f1")


def judged(oof: DataFrame, thresholds: DataFrame, arm: str = "arm", fold: str = "fold", y: str = "y", prob: str = "prob", valid: str = "valid") -> DataFrame:
    """oof with the verdict by the threshold of the row's own fold, and whether it is right: null where the arm says
    nothing or the truth is censored."""
    d = oof.join(thresholds.select(arm, fold, "threshold"), [arm, fold], "left")
    d = d.withColumn("verdict", verdict(F.col(prob), F.col("threshold")))
    return d.withColumn("correct", F.when((F.col("verdict") != "N/A") & F.col(valid), (F.col("verdict") == "READY") == (F.col(y) == 1)))


def benchmark(judged_: DataFrame, keys: list[str], arms: list[str], arm: str = "arm", score: str = "score") -> DataFrame:
    """One row per observation of the arm that covers most: truth, and for each arm its score, verdict and whether it is
    right."""
    base = largest_group(judged_, arm).first()[arm]
    at = lambda c, a: F.max(F.when(F.col(arm) == a, F.col(c)))
    wide = judged_.groupBy(*keys).agg(F.max("y").alias("truth"), F.max("valid").alias("valid"), at(score, base).isNotNull().alias("_base"), *[at(c, a).alias(f"{a}_{n}") for a in arms for c, n in ((score, "score"), ("verdict", "verdict"), ("correct", "correct"))])
    named = {f"{a}_verdict": F.coalesce(F.col(f"{a}_verdict"), F.lit("N/A")) for a in arms}
    return wide.where("_base").drop("_base").withColumns(named)


def benchmark_summary(judged_: DataFrame, evaluation_: DataFrame, arm: str = "arm") -> DataFrame:
    """Per arm: rows judged, share right, balanced accuracy, average precision over chance."""
    said = F.when(F.col("verdict") != "N/A", F.col("verdict") == "READY")
    balanced = metrics.confusion(judged_.where("valid").withColumn("_v", said), [arm], verdict="_v").select(arm, "balanced_accuracy")
    n = judged_.groupBy(arm).agg(F.count("correct").alias("n_judged"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    ratio = evaluation_.where(F.col("part") == POOLED).select(arm, F.col("ratio").alias("ap_over_chance"))
    return n.join(balanced, arm, "left").join(ratio, arm, "left")


def arm_ratios(evaluation_: DataFrame, base_arm: str, arm: str = "arm") -> DataFrame:
    """Average precision of each arm over that of one arm, per part."""
    base = evaluation_.where(F.col(arm) == base_arm).select("part", F.col("ap").alias("_b"))
    return evaluation_.join(base, "part", "left").select(arm, "part", (F.col("ap") / F.nullif(F.col("_b"), F.lit(0.0))).alias("ratio_to_base"))


def mean_over_units(df: DataFrame, unit: list[str], a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Mean over units of a unit's mean of a, the same of b, and their ratio; units without a value are left out."""
    per = df.groupBy(*(by or []), *unit).agg(F.avg(a).alias("_a"), F.avg(b).alias("_b"))
    out = per.groupBy(*(by or [])).agg(F.avg("_a").alias("mean_a"), F.avg("_b").alias("mean_b"), F.count("_a").alias("units_a"))
    return out.withColumn("ratio", F.col("mean_a") / F.nullif(F.col("mean_b"), F.lit(0.0)))


def mcc_headroom(df: DataFrame, by: list[str], verdict_: str, y: str = "y", score: str = "score", cuts: int = 60) -> DataFrame:
    """MCC of the given verdicts, and the best over `cuts` quantiles of the score as cut-offs."""
    own = metrics.confusion(df, by, y, verdict_).select(*by, "mcc")
    qs = quantiles(df, by, score, [(k + 0.5) / cuts for k in range(cuts)])
    # The cuts stand among the scores with nothing of their own, and read what is at or above them off running totals.
    each = qs.select(*by, F.explode(F.array_distinct("q")).alias(score), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("_cut"))
    counted = metrics.by_score(df, by, y, score).select(*by, F.col(score).cast("double").alias(score), F.col("tp").cast("long").alias("tp"), F.col("n").cast("long").alias("n"), F.lit(False).alias("_cut"))
    both = counted.unionByName(each).groupBy(*by, score).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"), F.max("_cut").alias("_cut"))
    d = running(both, by, score, ["tp", "n"], down=True).where("_cut")
    over, hits = F.col("upto_n").cast("double"), F.col("upto_tp").cast("double")
    d = d.select(*by, hits.alias("tp"), (over - hits).alias("fp"), (F.col("all_tp") - hits).alias("fn"), (F.col("all_n") - F.col("all_tp") - (over - hits)).alias("tn"))
    tp, fp, fn, tn = (F.col(n) for n in ("tp", "fp", "fn", "tn"))
    mcc = (tp * tn - fp * fn) / F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0))
    best = d.withColumn("_m", mcc).groupBy(*by).agg(F.max("_m").alias("best_mcc"))
    return own.join(best, by, "left").withColumn("headroom", F.col("best_mcc") - F.col("mcc"))


def negative_control(judged_: DataFrame, unit: list[str], prob: str = "prob", y: str = "y") -> DataFrame:
    """Per unit: share of READY verdicts, mean probability, average precision over chance. On units that never have the
    event a sound model says READY seldom and its probabilities stay low."""
    ready = F.when(F.col("verdict") != "N/A", (F.col("verdict") == "READY").cast("int"))
    d = judged_.groupBy(*unit).agg(F.avg(ready).alias("ready_frac"), F.avg(prob).alias("mean_prob"))
    ap = metrics.average_precision(judged_.where("valid"), unit, y, prob).select(*unit, "ratio")
    return d.join(ap, unit, "left")


def negligible(df: DataFrame, frac: float, y: str = "y") -> Column:
    """Contribution up to which no axis counts: a share of the base rate's distance from even odds, in logits."""
    p = df.agg(F.avg(y)).first()[0]
    p = F.greatest(F.lit(0.5 if p is None else float(p)), F.lit(1e-6))
    return F.lit(frac) * F.greatest(F.abs(F.log(p / F.greatest(1 - p, F.lit(1e-6)))), F.lit(1e-6))


def axis_availability(df: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """How many of an axis's columns a table has and knows on some row, on how many rows it knows any of them, and whether the axis
    is available at all. One aggregate over the table."""
    have = {a: [c for c in cs if c in df.columns] for a, cs in axes.items()}
    names = list(dict.fromkeys(c for cs in have.values() for c in cs))
    known = [F.count(c).alias(f"n_{c}") for c in names]
    rows = [F.count_if(F.coalesce(*[F.col(c).cast("string") for c in cs]).isNotNull()).alias(f"_rows_{i}") for i, cs in enumerate(have.values()) if cs]
    one = df.agg(F.count("*").alias("_all"), *known, *rows)
    n = lambda cs: sum(((F.col(f"n_{c}") > 0).cast("long") for c in cs), F.lit(0).cast("long"))
    each = [F.struct(F.lit(a).alias("axis"), n(cs).alias("n_columns"), (F.col(f"_rows_{i}") if cs else F.lit(0).cast("long")).alias("n_rows")) for i, (a, cs) in enumerate(have.items())]
    return one.select(F.explode(F.array(*each)).alias("a")).select("a.*").withColumn("available", F.col("n_columns") > 0)



def digest(answers: DataFrame, by: list[str]) -> DataFrame:
    """Per group: share of READY among the verdicts, and how often each axis is named."""
    ready = F.when(F.col("verdict") != "N/A", (F.col("verdict") == "READY").cast("int"))
    n = answers.groupBy(*by).agg(F.avg(ready).alias("ready_frac"))
    axes = answers.groupBy(*by, "axis").agg(F.count("*").alias("n"))
    return axes.join(n, by)


def several_horizons(df: DataFrame, keys: list[str], taus: list[int], value: str = "prob", tau: str = "tau") -> DataFrame:
    """One row per observation with the value at each horizon, and the horizons that have none, by name."""
    at = {x: F.max(F.when(F.col(tau) == x, F.col(value))) for x in taus}
    d = df.groupBy(*keys).agg(*[v.alias(f"{value}_tau{x}") for x, v in at.items()])
    missing = F.array_compact(F.array(*[F.when(F.col(f"{value}_tau{x}").isNull(), F.lit(str(x))) for x in taus]))
    return d.withColumn("skipped", F.array_join(missing, ","))


def rank_ensemble(df: DataFrame, by: list[str], columns: list[str], name: str = "ensemble") -> DataFrame:
    """Mean percentile rank over the columns (horizons, say) that a row has."""
    d = df
    for c in columns:
        d = metrics.percentile_rank(d, by, c, f"_r_{c}")
    ranks = F.array_compact(F.array(*[F.col(f"_r_{c}") for c in columns]))
    mean = F.aggregate(ranks, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(ranks), F.lit(0))
    return d.withColumn(name, mean).drop(*[f"_r_{c}" for c in columns])


def methods_at(oof: DataFrame, moments: DataFrame, evaluation_: DataFrame, unit: list[str], window: int, arm: str = "arm", score: str = "score", t: str = "t", at: str = "at") -> DataFrame:
    """Every arm's output at requested moments (unit, at): its score at that row, the share of the rows in
    [at - window, at] that are no higher, and how the arm is to be read: above, at or below chance by its pooled ratio."""
    m = moments.select(*[F.col(c).alias(f"_m_{c}") for c in unit], at)
    on = (F.col(t) <= F.col(at)) & (F.col(t) >= F.col(at) - window)
    for c in unit:
        on = on & (F.col(c) == F.col(f"_m_{c}"))
    near = oof.join(m, on)
    now = near.where(F.col(t) == F.col(at)).select(arm, *unit, at, F.col(score).alias("_now"))
    rank = near.join(now, [arm, *unit, at]).where(F.col(score).isNotNull()).groupBy(arm, *unit, at, "_now").agg(F.avg((F.col(score) <= F.col("_now")).cast("int")).alias("rank_in_window"))
    ratio = F.col("ratio")
    reading = F.when(ratio >= 1.2, "above chance").when(ratio >= 0.9, "at chance").when(ratio.isNotNull(), "below chance").otherwise("not rated")
    rated = evaluation_.where(F.col("part") == POOLED).select(arm, reading.alias("reading"))
    return rank.join(rated, arm, "left").withColumnRenamed("_now", score)


def unit_report(df: DataFrame, again: DataFrame, keys: list[str], unit: list[str], columns: list[str], most: float = 1e-6) -> DataFrame:
    """Per unit: rows, rows that a second computation lacks, the greatest deviation between the two, and whether the
    result is reproduced."""
    b = again.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_seen"))
    d = df.join(b, keys, "left")
    differ = lambda c: F.when(F.col(c).isNull() & F.col(f"_b_{c}").isNull(), 0.0).otherwise(F.coalesce(F.abs(F.col(c) - F.col(f"_b_{c}")), F.lit(float("inf"))))
    worst = F.greatest(*[differ(c) for c in columns]) if len(columns) > 1 else differ(columns[0])
    out = d.groupBy(*unit).agg(F.count("*").alias("n_rows"), F.count_if(F.col("_seen").isNull()).alias("n_absent"), F.max(worst).alias("max_deviation"))
    return out.withColumn("reproduced", (F.col("n_absent") == 0) & (F.col("max_deviation") < most))


def correlation_curve(df: DataFrame, by: list[str], x: str = "score", y: str = "y") -> DataFrame:
    """Pearson correlation of score and outcome in each group: along a number of components, say, and on both sides of a
    split."""
    return df.groupBy(*by).agg(F.corr(x, y).alias("r"), F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"))
