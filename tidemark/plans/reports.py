"""Queries of composed operators: matrix, evaluation, benchmark, answers, alarms against others, frame measures.

Out-of-fold rows stand for fitted arms: folds are users by five, "head" scores by a trailing mean, "control" by the value
itself, "rule" by minus a number without a probability.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import alarms, detect, experiment, explain, features, intervals, metrics, reports, splits, tables, windows
from tidemark.plans.catalogue import AP, DAY, EV, HOUR, NEXT, U, alarmed, labelled, of_kind, observations, query

OOF = f"""{NEXT}, f AS (SELECT *, unit % 5 AS fold, floor(sum(CAST(round(score * 100) AS BIGINT)) OVER w * 100 / count(*) OVER w) / 10000.0 AS mean FROM lab WINDOW w AS (PARTITION BY unit ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)),
oof AS (SELECT event_id, unit, t, fold, y, valid, 'head' AS arm, mean AS score, floor(mean / (mean + 50) * 10000) / 10000.0 AS prob FROM f
UNION ALL SELECT event_id, unit, t, fold, y, valid, 'control', score, least(floor(score * 50) / 10000.0, 1) FROM f
UNION ALL SELECT event_id, unit, t, fold, y, valid, 'rule', CAST(-k AS DOUBLE), NULL FROM f WHERE k % 11 <> 0)"""
PARTS = f"""{OOF}, v AS (SELECT arm, unnest(['pooled', CAST(fold AS VARCHAR)]) AS part, y, score, prob FROM oof WHERE valid), {AP.format(by='arm, part', src='v')},
rk AS (SELECT arm, part, y, rank() OVER (PARTITION BY arm, part ORDER BY score) + (count(*) OVER (PARTITION BY arm, part, score) - 1) / 2 AS rk FROM v),
g AS (SELECT arm, part, sum(y) AS p, count(*) AS n, sum(rk * y) AS s FROM rk GROUP BY arm, part), b AS (SELECT arm, part, avg((prob - y) ** 2) AS brier FROM v WHERE prob IS NOT NULL GROUP BY arm, part),
report AS (SELECT ap.arm, ap.part, n_rows, n_positive, base_rate, ap, ap / base_rate AS ratio, (s - p * (p + 1) / 2) / (p * (n - p)) AS auc, brier,
CASE WHEN n_positive = 0 THEN 'no positives' WHEN n_positive = n_rows THEN 'no negatives' END AS degenerate FROM ap JOIN g ON g.arm = ap.arm AND g.part = ap.part LEFT JOIN b ON b.arm = ap.arm AND b.part = ap.part)"""
THRESHOLDS = f"""{OOF}, c0 AS (SELECT arm, fold, prob, sum(y) AS tp, count(*) AS n FROM oof WHERE valid AND prob IS NOT NULL GROUP BY arm, fold, prob),
c1 AS (SELECT arm, h.fold, prob, sum(tp) AS tp, sum(n) AS n FROM c0 JOIN (SELECT DISTINCT fold FROM oof) h ON h.fold <> c0.fold GROUP BY arm, h.fold, prob),
c2 AS (SELECT arm, fold, prob, sum(tp) OVER w AS tps, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY arm, fold) AS p FROM c1 WINDOW w AS (PARTITION BY arm, fold ORDER BY prob DESC)),
c3 AS (SELECT *, CASE WHEN tps > 0 THEN 2 * (tps / cn) * (tps / p) / (tps / cn + tps / p) ELSE 0 END AS f1 FROM c2),
thr AS (SELECT arm, fold, prob AS threshold, f1 FROM c3 QUALIFY row_number() OVER (PARTITION BY arm, fold ORDER BY f1 DESC, prob) = 1),
judged AS (SELECT o.*, threshold, CASE WHEN prob IS NULL OR threshold IS NULL THEN 'N/A' WHEN prob >= threshold THEN 'READY' ELSE 'NOT_READY' END AS verdict FROM oof o LEFT JOIN thr ON thr.arm = o.arm AND thr.fold = o.fold),
said AS (SELECT *, CASE WHEN verdict <> 'N/A' AND valid THEN (verdict = 'READY') = (y = 1) END AS correct FROM judged)"""


def _mean():
    """Trailing mean, in whole hundredths of cents, so that it does not depend on the order of additions."""
    w = windows.trailing(U, DAY)
    return F.floor(F.sum(F.round(F.col("score") * 100).cast("long")).over(w) * 100 / F.count("*").over(w)) / 10000.0


def scored(spark, sf_dir: str) -> DataFrame:
    lab = labelled(spark, sf_dir).drop("tau")
    d = lab.withColumns({"fold": F.col("unit") % 5, "mean": _mean()})
    prob = F.floor(F.col("mean") / (F.col("mean") + 50) * 10000) / 10000.0
    arms = [("head", F.col("mean"), prob, F.lit(True)), ("control", F.col("score"), F.least(F.floor(F.col("score") * 50) / 10000.0, F.lit(1.0)), F.lit(True)), ("rule", -F.col("k").cast("double"), F.lit(None).cast("double"), F.col("k") % 11 != 0)]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("arm"), s.alias("score"), p.alias("prob"), use.alias("use")) for n, s, p, use in arms]))
    return d.select("event_id", "unit", "t", "fold", "y", "valid", each.alias("a")).where("a.use").select("event_id", "unit", "t", "fold", "y", "valid", "a.arm", "a.score", "a.prob")


def _judged(spark, sf_dir: str) -> DataFrame:
    oof = scored(spark, sf_dir)
    return reports.judged(oof, reports.fold_thresholds(oof))


# metrics and reports


@query(f"WITH {NEXT}, v AS (SELECT 1 AS one, y, score FROM lab WHERE valid), {AP.format(by='one', src='v')} SELECT n_rows, n_positive, base_rate, ap, ap / base_rate AS ratio FROM ap", ap=9, ratio=9)
def pooled_average_precision(spark, sf_dir):
    return metrics.average_precision(labelled(spark, sf_dir).where("valid"), [])


@query(f"WITH {PARTS} SELECT * FROM report", ap=9, ratio=9, auc=9, brier=6)
def evaluation_report(spark, sf_dir):
    return reports.evaluation(scored(spark, sf_dir))


@query(f"WITH {THRESHOLDS} SELECT arm, fold, threshold, f1 FROM thr", f1=9)
def fold_thresholds(spark, sf_dir):
    return reports.fold_thresholds(scored(spark, sf_dir))


BENCH = ", ".join(f"max(score) FILTER (arm = '{a}') AS {a}_score, coalesce(max(verdict) FILTER (arm = '{a}'), 'N/A') AS {a}_verdict, bool_or(correct) FILTER (arm = '{a}') AS {a}_correct" for a in ("head", "control", "rule"))


@query(f"WITH {THRESHOLDS} SELECT event_id, max(y) AS truth, bool_or(valid) AS valid, {BENCH} FROM said GROUP BY event_id HAVING count(*) FILTER (arm = 'control') > 0")
def benchmark_table(spark, sf_dir):
    return reports.benchmark(_judged(spark, sf_dir), ["event_id"], ["head", "control", "rule"])


@query(f"""WITH {PARTS}, {THRESHOLDS.removeprefix(OOF + ", ")}, n AS (SELECT arm, count(correct) AS n_judged, avg(CAST(correct AS INT)) AS accuracy FROM said GROUP BY arm),
q AS (SELECT arm, (avg(CAST(verdict = 'READY' AS INT)) FILTER (y = 1) + avg(CAST(verdict = 'NOT_READY' AS INT)) FILTER (y = 0)) / 2 AS balanced_accuracy FROM said WHERE valid AND verdict <> 'N/A' GROUP BY arm)
SELECT n.arm, n_judged, accuracy, balanced_accuracy, ratio AS ap_over_chance FROM n LEFT JOIN q ON q.arm = n.arm LEFT JOIN report r ON r.arm = n.arm AND r.part = 'pooled'""", accuracy=9, balanced_accuracy=9, ap_over_chance=9)
def benchmark_summary(spark, sf_dir):
    return reports.benchmark_summary(_judged(spark, sf_dir), reports.evaluation(scored(spark, sf_dir)))


@query(f"WITH {PARTS} SELECT r.arm, r.part, r.ap / nullif(b.ap, 0) AS ratio_to_base FROM report r LEFT JOIN report b ON b.part = r.part AND b.arm = 'control'", ratio_to_base=9)
def arm_ratios(spark, sf_dir):
    return reports.arm_ratios(reports.evaluation(scored(spark, sf_dir)), "control")


ANSWERS = f"""{THRESHOLDS}, h AS (SELECT event_id, unit, t, prob, verdict FROM said WHERE arm = 'head'),
c AS (SELECT h.*, f.score / 100 - 0.5 AS a, f.k / 100.0 - 0.4 AS b, f.mean / 100 - 0.6 AS d FROM h JOIN f ON f.event_id = h.event_id),
fl AS (SELECT 0.1 * greatest(abs(ln(greatest(p, 1e-6) / greatest(1 - p, 1e-6))), 1e-6) AS floor FROM (SELECT avg(y) AS p FROM lab)),
ans AS (SELECT event_id, unit, t, prob, verdict, CASE WHEN greatest(greatest(-a, 0) + greatest(-d, 0), greatest(-b, 0)) <= floor THEN 'unclear' WHEN greatest(-a, 0) + greatest(-d, 0) >= greatest(-b, 0) THEN 'size' ELSE 'count' END AS axis,
CASE WHEN a <= d THEN 'a' ELSE 'd' END AS size_driver FROM c, fl)"""


def _answers(spark, sf_dir):
    lab = labelled(spark, sf_dir)
    mean = _mean()
    parts = lab.select("event_id", (F.col("score") / 100 - 0.5).alias("a"), (F.col("k") / 100.0 - 0.4).alias("b"), (mean / 100 - 0.6).alias("d"))
    head = _judged(spark, sf_dir).where("arm = 'head'").select("event_id", "unit", "t", "prob", "verdict")
    return explain.axis_push(head.join(parts, "event_id"), {"size": ["a", "d"], "count": ["b"]}, reports.negligible(lab, 0.1))


@query(f"WITH {ANSWERS} SELECT event_id, prob, verdict, axis, CASE axis WHEN 'size' THEN size_driver WHEN 'count' THEN 'b' END AS driver FROM ans")
def answers(spark, sf_dir):
    return _answers(spark, sf_dir).select("event_id", "prob", "verdict", "axis", "driver")


@query(f"""WITH {ANSWERS} SELECT unit, axis, count(*) AS n, max(r) AS ready_frac FROM (SELECT unit, axis, avg(CASE verdict WHEN 'READY' THEN 1 WHEN 'NOT_READY' THEN 0 END) OVER (PARTITION BY unit) AS r FROM ans) GROUP BY unit, axis""", ready_frac=9)
def answers_digest(spark, sf_dir):
    return reports.digest(_answers(spark, sf_dir), U)


@query(f"""WITH {EV}, m AS (SELECT CASE WHEN kind = 'purchase' THEN score END AS paid, CASE WHEN k > 50 THEN k END AS high, CASE WHEN score < 0 THEN k END AS never FROM ev),
n AS (SELECT count(paid) AS p, count(high) AS h, count(never) AS v, count(*) FILTER (paid IS NOT NULL OR high IS NOT NULL) AS ph FROM m)
SELECT 'value' AS axis, CAST(p > 0 AS BIGINT) + CAST(h > 0 AS BIGINT) AS n_columns, ph AS n_rows, p > 0 OR h > 0 AS available FROM n UNION ALL SELECT 'tail', CAST(v > 0 AS BIGINT), v, v > 0 FROM n UNION ALL SELECT 'none', 0, 0, false FROM n""")
def axis_availability(spark, sf_dir):
    ev = observations(spark, sf_dir)
    m = ev.select(F.when(F.col("kind") == "purchase", F.col("score")).alias("paid"), F.when(F.col("k") > 50, F.col("k")).alias("high"), F.when(F.col("score") < 0, F.col("k")).alias("never"))
    return reports.axis_availability(m, {"value": ["paid", "high"], "tail": ["never", "not_there"], "none": ["nor_there"]})


@query(f"""WITH {THRESHOLDS}, h AS (SELECT * FROM said WHERE arm = 'head'), d AS (SELECT unit, avg(CASE verdict WHEN 'READY' THEN 1 WHEN 'NOT_READY' THEN 0 END) AS ready_frac, avg(prob) AS mean_prob FROM h GROUP BY unit),
v AS (SELECT unit, y, prob AS score FROM h WHERE valid), {AP.format(by='unit', src='v')} SELECT d.unit, ready_frac, mean_prob, ap / base_rate AS ratio FROM d LEFT JOIN ap ON ap.unit = d.unit""", ready_frac=9, mean_prob=9, ratio=9)
def negative_control(spark, sf_dir):
    return reports.negative_control(_judged(spark, sf_dir).where("arm = 'head'"), U)


@query(f"""WITH {NEXT}, m AS (SELECT unit, avg(score) FILTER (y = 1) AS a, avg(score) FILTER (y = 0) AS b FROM lab GROUP BY unit) SELECT avg(a) AS mean_a, avg(b) AS mean_b, count(a) AS units_a, avg(a) / avg(b) AS ratio FROM m""", mean_a=6, mean_b=6, ratio=6)
def unit_mean_ratio(spark, sf_dir):
    d = labelled(spark, sf_dir).withColumns({"a": F.when(F.col("y") == 1, F.col("score")), "b": F.when(F.col("y") == 0, F.col("score"))})
    return reports.mean_over_units(d, U, "a", "b")


@query(f"""WITH {NEXT}, v AS (SELECT kind, y, score, score >= 60 AS armed FROM lab WHERE valid), q AS (SELECT kind, unnest(list_distinct(quantile_cont(score, [{', '.join(str((k + 0.5) / 20) for k in range(20))}]))) AS cut FROM v GROUP BY kind),
x AS (SELECT v.kind, 'own' AS way, 0.0 AS cut, y, armed AS over FROM v UNION ALL SELECT v.kind, 'cut', cut, y, score >= cut FROM v JOIN q ON q.kind = v.kind),
m AS (SELECT kind, way, cut, CAST(count(*) FILTER (over AND y = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (over AND y = 0) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT over AND y = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT over AND y = 0) AS DOUBLE) AS tn FROM x GROUP BY ALL),
s AS (SELECT kind, way, (tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc FROM m)
SELECT kind, max(mcc) FILTER (way = 'own') AS mcc, max(mcc) FILTER (way = 'cut') AS best_mcc, max(mcc) FILTER (way = 'cut') - max(mcc) FILTER (way = 'own') AS headroom FROM s GROUP BY kind""", mcc=6, best_mcc=6, headroom=6)
def mcc_headroom(spark, sf_dir):
    return reports.mcc_headroom(labelled(spark, sf_dir).where("valid").withColumn("armed", F.col("score") >= 60), ["kind"], "armed", cuts=20)


@query(f"WITH {OOF} SELECT arm, fold, corr(score, y) AS r, count(*) AS n FROM oof WHERE valid GROUP BY arm, fold", r=6)
def correlation_curve(spark, sf_dir):
    return reports.correlation_curve(scored(spark, sf_dir).where("valid"), ["arm", "fold"])


@query(f"""WITH {EV}, p AS (SELECT unit, t AS at FROM ev WHERE kind = 'purchase'), h AS (SELECT e.event_id, {', '.join(f'CASE WHEN k % {m} <> 0 THEN score / {d} END AS prob_tau{x}' for x, m, d in ((6, 3, 100), (24, 5, 200)))} FROM ev e)
SELECT *, concat_ws(',', CASE WHEN prob_tau6 IS NULL THEN '6' END, CASE WHEN prob_tau24 IS NULL THEN '24' END) AS skipped FROM h""")
def several_horizons(spark, sf_dir):
    ev = observations(spark, sf_dir)
    each = F.explode(F.array(F.struct(F.lit(6).alias("tau"), F.when(F.col("k") % 3 != 0, F.col("score") / 100).alias("prob")), F.struct(F.lit(24).alias("tau"), F.when(F.col("k") % 5 != 0, F.col("score") / 200).alias("prob"))))
    return reports.several_horizons(ev.select("event_id", each.alias("h")).select("event_id", "h.tau", "h.prob"), ["event_id"], [6, 24])


def _pct(v: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (PARTITION BY grp, {v} IS NULL ORDER BY {v}) + (count(*) OVER (PARTITION BY grp, {v}) - 1) / 2) / count({v}) OVER (PARTITION BY grp) END"


@query(f"""WITH {EV}, m AS (SELECT event_id, unit % 4 AS grp, round(avg(score) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW), 4) AS a, CASE WHEN k % 7 <> 0 THEN round(avg(score) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW), 4) END AS b FROM ev),
r AS (SELECT event_id, {_pct('a')} AS ra, {_pct('b')} AS rb FROM m) SELECT event_id, CASE WHEN rb IS NULL THEN ra ELSE (ra + rb) / 2 END AS ensemble FROM r""", ensemble=9)
def rank_over_horizons(spark, sf_dir):
    mean = lambda h: F.round(F.avg("score").over(windows.trailing(U, h)), 4)
    d = observations(spark, sf_dir).withColumn("grp", F.col("unit") % 4).withColumns({"a": mean(6 * HOUR), "b": F.when(F.col("k") % 7 != 0, mean(DAY))})
    return reports.rank_ensemble(d, ["grp"], ["a", "b"]).select("event_id", "ensemble")


@query(f"""WITH {PARTS}, q AS (SELECT unit, max(t) AS q_at FROM ev GROUP BY unit), n AS (SELECT o.arm, o.unit, q_at, o.score, x.score AS now FROM oof o JOIN q ON q.unit = o.unit AND o.t <= q_at AND o.t >= q_at - {2 * DAY} JOIN oof x ON x.arm = o.arm AND x.unit = o.unit AND x.t = q_at)
SELECT n.arm, unit, q_at AS "at", now AS score, avg(CAST(score <= now AS INT)) AS rank_in_window, max(CASE WHEN ratio >= 1.2 THEN 'above chance' WHEN ratio >= 0.9 THEN 'at chance' ELSE 'below chance' END) AS reading
FROM n JOIN report r ON r.arm = n.arm AND r.part = 'pooled' GROUP BY n.arm, unit, q_at, now""", rank_in_window=9)
def methods_at_moment(spark, sf_dir):
    oof = scored(spark, sf_dir)
    moments = observations(spark, sf_dir).groupBy("unit").agg(F.max("t").alias("at"))
    return reports.methods_at(oof, moments, reports.evaluation(oof), U, 2 * DAY)


@query(f"""WITH {EV}, b AS (SELECT *, CASE WHEN k % 50 = 7 THEN score + 0.001 ELSE score END AS again FROM ev WHERE k % 97 <> 5)
SELECT ev.unit, count(*) AS n_rows, count(*) FILTER (b.event_id IS NULL) AS n_absent, max(CASE WHEN b.event_id IS NULL THEN CAST('inf' AS DOUBLE) ELSE abs(ev.score - again) END) AS max_deviation,
count(*) FILTER (b.event_id IS NULL) = 0 AND max(CASE WHEN b.event_id IS NULL THEN CAST('inf' AS DOUBLE) ELSE abs(ev.score - again) END) < 1e-6 AS reproduced FROM ev LEFT JOIN b ON b.event_id = ev.event_id GROUP BY ev.unit""", max_deviation=9)
def unit_report(spark, sf_dir):
    ev = observations(spark, sf_dir)
    again = ev.where("k % 97 <> 5").withColumn("score", F.when(F.col("k") % 50 == 7, F.col("score") + 0.001).otherwise(F.col("score")))
    return reports.unit_report(ev, again, ["event_id"], U, ["score"])


# alarms against others


@query(f"""WITH {EV}, u AS (SELECT DISTINCT unit FROM ev), q AS (SELECT u.unit, quantile_cont(e.score, 0.9) AS hi, quantile_cont(e.score, 0.5) AS lo FROM u JOIN ev e ON e.unit <> u.unit GROUP BY u.unit),
s AS (SELECT ev.unit, event_id, t, hi, lo, avg(score) OVER (PARTITION BY ev.unit ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS smoothed FROM ev JOIN q ON q.unit = ev.unit)
SELECT event_id, coalesce(last_value(CASE WHEN smoothed >= hi THEN true WHEN smoothed < lo THEN false END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING), false) AS armed FROM s""")
def alarm_by_others(spark, sf_dir):
    return alarms.others_alarm(observations(spark, sf_dir), "unit", "score", 0.9, 0.5, DAY).select("event_id", "armed")


@query(f"""WITH {EV}, a AS (SELECT *, coalesce(last_value(CASE WHEN score >= 60 THEN true WHEN score < 20 THEN false END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING), false) AS armed, row_number() OVER (PARTITION BY unit ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY unit) AS n FROM ev),
g AS (SELECT unnest(range(5)) AS turn), s AS (SELECT x.unit, g.turn, x.t, y.armed FROM a x, g JOIN a y ON y.unit = x.unit AND (y.i + (g.turn * 7 + 3) % (y.n - 1) + 1) % y.n = x.i WHERE x.n > 1),
p AS (SELECT unit, event_id, t AS at FROM ev WHERE kind = 'purchase'),
w AS (SELECT p.unit, g.turn, p.event_id, EXISTS (SELECT 1 FROM s WHERE s.unit = p.unit AND s.turn = g.turn AND s.armed AND s.t >= p.at - {6 * HOUR} AND s.t < p.at) AS warned FROM p, g WHERE p.unit IN (SELECT unit FROM s)),
r AS (SELECT unit, turn, avg(CAST(warned AS INT)) AS w FROM w GROUP BY unit, turn) SELECT unit, avg(w) AS null_warned, count(*) AS turns FROM r GROUP BY unit""", null_warned=9)
def alarm_null(spark, sf_dir):
    a, p = alarmed(spark, sf_dir)
    return alarms.random_null(a, p, 6 * HOUR, U, "event_id", shifts=5, shift=lambda i, n: (i * 7 + 3) % (n - 1) + 1)


# matrix and gates

COLUMNS = {"score": "all", "k": "all", "double_score": "all", "one": "all", "gone": "all", "rival": "all", "filter_only": "filter"}


def _matrix(spark, sf_dir):
    return observations(spark, sf_dir).select("unit", "t", "score", F.col("k").cast("double").alias("k"), (2 * F.col("score") - 3).alias("double_score"), F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("gone"), (F.col("score") + F.col("k")).alias("rival"), F.lit(0.5).alias("filter_only"))


MATRIX = f"{EV}, m AS (SELECT score, CAST(k AS DOUBLE) AS k, 2 * score - 3 AS double_score, 1.0 AS one, CAST(NULL AS DOUBLE) AS gone, score + k AS rival, 0.5 AS filter_only FROM ev)"


@query(f"""WITH {MATRIX}, c AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, '{s}' AS subject, count({c}) AS n, count(DISTINCT {c}) AS d, corr({c}, score) AS r FROM m" for c, s in COLUMNS.items())})
SELECT name AS "column", CASE WHEN name = 'rival' THEN 'outside the model' WHEN subject = 'filter' THEN 'nothing to measure' WHEN n = 0 THEN 'never measured' WHEN d = 1 THEN 'constant' WHEN name <> 'score' AND abs(r) > 1 - 1e-12 THEN 'affine function of score' ELSE 'used' END AS reason FROM c""")
def model_matrix(spark, sf_dir):
    kept, reasons = tables.model_matrix(_matrix(spark, sf_dir), COLUMNS, ["all"], ["rival"])
    return spark.createDataFrame([(c, "used") for c in kept] + list(reasons.items()), "column string, reason string")


@query(f"""WITH {MATRIX}, c AS ({' UNION ALL '.join(f"SELECT '{c}' AS name, '{s}' AS subject, count(*) AS n_rows, count({c}) AS n, count(DISTINCT {c}) AS d FROM m" for c, s in COLUMNS.items())})
SELECT name AS "column", n_rows, 1 - n / n_rows AS missing_frac, d AS n_distinct, CASE WHEN subject = 'filter' THEN 'inapplicable' WHEN n = 0 THEN 'missing' WHEN d <= 1 THEN 'constant' ELSE 'active' END AS verdict FROM c""")
def applicability(spark, sf_dir):
    return tables.applicability(_matrix(spark, sf_dir), COLUMNS, ["all"])


GATES = f"""{EV}, g AS (SELECT unit, unnest(['high', 'known', 'odd']) AS gate, unnest([score >= 20, k IS NOT NULL, k % 2 = 1]) AS ok FROM ev),
n AS (SELECT unit, gate, count(*) FILTER (ok) AS n_ok, count(*) AS n, count(*) FILTER (ok) = count(*) AS all_ok, count(*) FILTER (ok) > 0 AS any_ok FROM g GROUP BY unit, gate)"""


def _gates(spark, sf_dir):
    return tables.gates(observations(spark, sf_dir), {"high": F.col("score") >= 20, "known": F.col("k").isNotNull(), "odd": F.col("k") % 2 == 1}, U)


@query(f"WITH {GATES} SELECT * FROM n")
def gate_counts(spark, sf_dir):
    return _gates(spark, sf_dir)


@query(f"WITH {GATES} SELECT unit, count(*) FILTER (CASE gate WHEN 'high' THEN all_ok WHEN 'known' THEN all_ok ELSE any_ok END) AS n_gates_ok, count(*) FILTER (CASE gate WHEN 'high' THEN all_ok WHEN 'known' THEN all_ok ELSE any_ok END) = 3 AS accepted FROM n GROUP BY unit")
def acceptance(spark, sf_dir):
    return tables.accepted(_gates(spark, sf_dir), {"high": "all", "known": "all", "odd": "any"}, U)


@query(f"WITH {EV}, n AS (SELECT unit, kind, count(*) AS n_rows FROM ev GROUP BY unit, kind) SELECT unit, kind, n_rows FROM n QUALIFY row_number() OVER (PARTITION BY unit ORDER BY n_rows DESC, kind) = 1")
def widest_group(spark, sf_dir):
    return tables.largest_group(observations(spark, sf_dir), "kind", U)


@query(f"WITH {EV} SELECT 'one' AS block, avg(abs(score - 50)) + avg(abs(score * 0.1 - 4)) AS importance, 2 :: BIGINT AS n_columns FROM ev UNION ALL SELECT 'two', avg(abs(k - 50.0)), 1 FROM ev", importance=6)
def block_importance(spark, sf_dir):
    c = observations(spark, sf_dir).select((F.col("score") - 50).alias("a"), (F.col("k") - 50.0).alias("b"), (F.col("score") * 0.1 - 4).alias("d"))
    return tables.block_importance(explain.global_importance(c, ["a", "b", "d"], {"a": "one", "b": "two", "d": "one"}))


@query(f"""WITH {EV}, g AS (SELECT unit % 5 AS grp, count(*) AS n_test FROM ev GROUP BY ALL), k AS (SELECT DISTINCT unit % 5 AS grp, k % 40 + (unit % 5 >= 3) :: INT * 1000 AS u FROM ev),
s AS (SELECT u FROM k GROUP BY u HAVING count(*) > 1) SELECT g.grp, n_test, (SELECT count(*) FROM ev) - n_test AS n_train, (SELECT count(*) FROM k JOIN s ON s.u = k.u WHERE k.grp = g.grp) AS n_overlap FROM g""")
def fold_leaks(spark, sf_dir):
    ev = observations(spark, sf_dir).withColumn("grp", F.col("unit") % 5)
    return splits.leave_one_out_folds(ev.withColumn("u", F.col("k") % 40 + (F.col("grp") >= 3).cast("int") * 1000), "grp", ["u"])


@query(f"""WITH {NEXT}, b AS (SELECT unit FROM lab GROUP BY unit HAVING min(y) <> max(y)), s AS (SELECT unit, min(t) AS a, max(t) AS z FROM lab WHERE unit IN (FROM b) GROUP BY unit),
e AS (SELECT s.*, k AS block, a + (z - a) / 2 * k AS lo, a + (z - a) / 2 * (k + 1) AS hi FROM s, (SELECT unnest(range(2)) AS k))
SELECT event_id, CAST(block AS INT) AS block, CASE WHEN t >= lo AND (t < hi OR (block = 1 AND t <= hi)) THEN 'test' WHEN t < lo - {DAY} OR t >= hi + {DAY} THEN 'train' ELSE 'gap' END AS role FROM lab JOIN e ON e.unit = lab.unit
UNION ALL SELECT event_id, NULL, 'train' FROM lab WHERE unit NOT IN (FROM b)""")
def event_rotations(spark, sf_dir):
    return experiment.event_rotations(labelled(spark, sf_dir), 2, DAY, U).select("event_id", "block", "role")


# along time


@query(f"WITH {NEXT} SELECT event_id FROM lab QUALIFY y = 1 AND coalesce(lead(y) OVER (PARTITION BY unit ORDER BY t), 0) <> 1")
def falling_edges(spark, sf_dir):
    return windows.falling_edges(labelled(spark, sf_dir), "y", U).select("event_id")


@query(f"WITH {EV} SELECT e.event_id, (SELECT avg(CAST(p.score <= e.score AS INT)) FROM ev p WHERE p.unit = e.unit AND p.t <= e.t AND p.t >= e.t - {DAY}) AS share FROM ev e", share=9)
def window_percentile(spark, sf_dir):
    return observations(spark, sf_dir).select("event_id", windows.at_or_below("score", windows.trailing(U, DAY)).alias("share"))


PLACES = f"{EV}, d AS (SELECT unit, t // {DAY} AS t, kind AS entity, max(score) AS z FROM ev GROUP BY ALL), c AS (SELECT unit, t, entity FROM d QUALIFY row_number() OVER (PARTITION BY unit, t ORDER BY abs(z - 50), entity) = 1)"


def _places(spark, sf_dir):
    ev = observations(spark, sf_dir)
    d = ev.groupBy("unit", F.floor(F.col("t") / DAY).alias("t"), F.col("kind").alias("entity")).agg(F.max("score").alias("z"))
    return d, features.innermost(d, ["unit", "t"], "entity", "z", 50.0).select("unit", "t", "entity")


@query(f"""WITH {PLACES}, f AS (SELECT unit, t, min(t) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS t0 FROM (SELECT DISTINCT unit, t FROM d)),
x AS (SELECT c.unit, c.t, c.entity, coalesce(f.t0 < c.t AND b.z BETWEEN 0 AND 100, false) AS persist, a.z - b.z AS moved FROM c JOIN f ON f.unit = c.unit AND f.t = c.t LEFT JOIN d a ON a.unit = c.unit AND a.t = c.t AND a.entity = c.entity LEFT JOIN d b ON b.unit = c.unit AND b.t = f.t0 AND b.entity = c.entity)
SELECT unit, t, entity, persist, CASE WHEN persist THEN moved END AS displacement FROM x""", displacement=9)
def entity_displacement(spark, sf_dir):
    d, chosen = _places(spark, sf_dir)
    return windows.displacement(d, chosen, U, "entity", "z", F.col("z").between(0, 100), 3)


# measures of a frame

SLICES = f"{EV}, s AS (SELECT unit, event_id, score AS z, CASE WHEN k >= 20 THEN CAST(k + 0.5 AS DOUBLE) END AS r, k % 5 = 0 AS on_edge, (k - 50) / 64.0 AS cosine, kind FROM ev)"


def _slices(spark, sf_dir):
    ev = observations(spark, sf_dir)
    return ev.select("unit", "event_id", F.col("score").alias("z"), F.when(F.col("k") >= 20, (F.col("k") + 0.5).cast("double")).alias("r"), (F.col("k") % 5 == 0).alias("on_edge"), ((F.col("k") - 50) / 64.0).alias("cosine"), "kind")


@query(f"WITH {SLICES} SELECT unit, avg(CAST(r IS NOT NULL AS INT)) AS search_frac, avg(CAST(on_edge AS INT)) FILTER (r IS NOT NULL AND z BETWEEN 10 AND 80) AS boundary_frac FROM s GROUP BY unit")
def search_fractions(spark, sf_dir):
    return features.search_fractions(_slices(spark, sf_dir), U, F.col("z").between(10, 80))


@query(f"""WITH {SLICES}, b AS (SELECT unit, CAST(floor(z / 25) AS BIGINT) AS bin, min(r) AS r_min, count(r) AS n_search FROM s WHERE z >= 0 AND z < 100 GROUP BY ALL), l AS (SELECT unit, min(r) AS least FROM s GROUP BY unit)
SELECT l.unit, g.bin, r_min, coalesce(n_search, 0) AS n_search, r_min / least AS r_relative FROM l, (SELECT unnest(range(4)) AS bin) g LEFT JOIN b ON b.unit = l.unit AND b.bin = g.bin""")
def radius_bins(spark, sf_dir):
    return features.radius_bins(_slices(spark, sf_dir), U, 0.0, 100.0, 4)


@query(f"WITH {SLICES} SELECT unit, avg(cosine) AS mean_cosine, count(*) AS n FROM s WHERE z BETWEEN 20 AND 60 GROUP BY unit", mean_cosine=9)
def band_cosine(spark, sf_dir):
    return features.band_cosine(_slices(spark, sf_dir), U, 20, 60, "cosine")


HIST = f"{EV}, u AS (SELECT DISTINCT unit FROM ev), b AS (SELECT unit, CAST(least(floor(score / 25), 3) AS BIGINT) AS bin, count(*) AS n FROM ev WHERE score BETWEEN 0 AND 100 GROUP BY ALL), h AS (SELECT u.unit, g.bin, coalesce(n, 0) AS n FROM u, (SELECT unnest(range(4)) AS bin) g LEFT JOIN b ON b.unit = u.unit AND b.bin = g.bin)"


@query(f"WITH {HIST} SELECT unit, CAST(sum(n) AS BIGINT) AS total, min(n) AS least FROM h GROUP BY unit")
def histogram_minimum(spark, sf_dir):
    return features.histogram_minimum(features.histogram(observations(spark, sf_dir), U, "score", 0.0, 100.0, 4), U)


@query(f"WITH {HIST} SELECT unit, bin, n / (4.0 / 3 * pi() * ((2 + bin * 0.5 + 0.5) ** 3 - (2 + bin * 0.5) ** 3)) / 7 AS density FROM h", density=6)
def shell_density(spark, sf_dir):
    return features.shell_density(features.histogram(observations(spark, sf_dir), U, "score", 0.0, 100.0, 4), U, 2.0, 0.5, F.lit(7))


@query(f"""WITH {EV}, g AS (SELECT unit, score, score - lag(score) OVER (PARTITION BY unit ORDER BY score) AS gap FROM ev), m AS (SELECT unit, count(*) AS n, CASE WHEN count(*) >= 2 THEN greatest(max(gap), min(score), 300 - max(score)) END AS max_gap FROM g GROUP BY unit)
SELECT *, max_gap <= 100 AS continuous, max_gap / 300 AS relative_gap FROM m""")
def chain_gaps(spark, sf_dir):
    return features.wire(observations(spark, sf_dir), U, "score", 0.0, 300.0, 100.0)


@query(f"WITH {EV} SELECT unit, count(*) FILTER (score BETWEEN 10 - 5 AND 70 + 5) AS n_filter FROM ev GROUP BY unit")
def filter_count(spark, sf_dir):
    sites = spark.createDataFrame([(0, 10.0), (1, 40.0), (2, 70.0)], "site int, z double")
    return features.filter_count(observations(spark, sf_dir), sites, U, "score", 5.0)


@query(f"WITH {EV} SELECT unit, count(*) FILTER (score BETWEEN 10 AND 90) AS n_wide, min(greatest(30 - score, score - 70)) FILTER (score BETWEEN 10 AND 90 AND greatest(30 - score, score - 70) > 0) AS nearest_outside FROM ev GROUP BY unit")
def wide_zone(spark, sf_dir):
    return features.wide_zone(observations(spark, sf_dir), U, "score", 30.0, 70.0, 20.0)


@query(f"""WITH {EV}, v(resname, v) AS (VALUES ('view', 1.5), ('click', -2.0), ('purchase', 0.25)) SELECT unit, k % 4 AS subunit, avg(v) AS lining_mean, count(*) AS lining_n FROM ev JOIN v ON v.resname = ev.kind WHERE score BETWEEN 10 AND 60 GROUP BY ALL""", lining_mean=9)
def lining_by_subunit(spark, sf_dir):
    scale = spark.createDataFrame([("view", 1.5), ("click", -2.0), ("purchase", 0.25)], "resname string, v double")
    ev = observations(spark, sf_dir).select("unit", F.col("kind").alias("resname"), (F.col("k") % 4).alias("subunit"), F.col("score").alias("z"))
    return features.lining_by_subunit(ev, scale, U, "subunit", 10, 60)


@query(f"""WITH {EV}, m AS (SELECT unit, median(score) AS median FROM ev GROUP BY unit) SELECT m.unit, m.median, avg(score) FILTER (score < m.median) AS mean_low, avg(score) FILTER (score >= m.median) AS mean_high FROM ev JOIN m ON m.unit = ev.unit GROUP BY m.unit, m.median""", median=9, mean_low=9, mean_high=9)
def median_split(spark, sf_dir):
    return detect.halves_means(observations(spark, sf_dir), U, "score")


@query(f"""WITH {EV}, s AS (SELECT unit, event_id, t, k, lag(k) OVER (PARTITION BY unit ORDER BY t) AS p FROM ev), j AS (SELECT *, coalesce(-100 * CASE WHEN abs(k - p) = 50 THEN 0 ELSE round((k - p) / 100.0) END, 0) AS j FROM s)
SELECT event_id, k + sum(j) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING) AS x FROM j""")
def unwrapped_places(spark, sf_dir):
    ev = observations(spark, sf_dir).withColumns({"x": F.col("k").cast("double"), "entity": F.lit(0)})
    return features.unwrapped(ev, U, "entity", ["x"], {"x": F.lit(100.0)}).select("event_id", "x")


@query(f"""WITH {EV}, c AS (SELECT unit, avg(score) FILTER (kind = 'view') AS c FROM ev GROUP BY unit), m AS (SELECT ev.unit, event_id, k % 6 AS residue, score - c + 50 AS x FROM ev JOIN c ON c.unit = ev.unit),
r AS (SELECT unit, residue, avg(x) AS rc FROM m GROUP BY ALL) SELECT event_id, x - 100 * floor(rc / 100) AS x FROM m JOIN r ON r.unit = m.unit AND r.residue = m.residue""", x=6)
def prepared_frames(spark, sf_dir):
    ev = observations(spark, sf_dir).withColumns({"x": F.col("score"), "residue": F.col("k") % 6})
    c = features.centred(ev, U, ["x"], F.col("kind") == "view", {"x": 50.0})
    return features.wrapped(c, U, ["residue"], ["x"], {"x": F.lit(100.0)}).select("event_id", "x")


# frames of blocks, and detection


BLOCKS = f"""{SLICES}, fr AS (SELECT DISTINCT unit FROM ev), geo AS (SELECT unit, min(r) AS r_min FROM s GROUP BY unit), occ AS (SELECT unit, CAST(count(*) AS DOUBLE) AS n_inside, avg(cosine) AS mean_cosine FROM s WHERE z BETWEEN 20 AND 60 GROUP BY unit)"""


@query(f"""WITH {BLOCKS}, m AS (SELECT fr.unit, r_min, n_inside, mean_cosine, CAST(NULL AS DOUBLE) AS filter_only FROM fr LEFT JOIN geo ON geo.unit = fr.unit LEFT JOIN occ ON occ.unit = fr.unit)
SELECT unit, r_min, n_inside, CASE WHEN unit % 2 = 0 THEN 0 - mean_cosine ELSE mean_cosine END AS mean_cosine, filter_only, r_min / (SELECT max(r_min) FROM m) AS r_relative FROM m""", mean_cosine=9)
def assembled_frames(spark, sf_dir):
    from tidemark.plans.frames import Block, assemble

    slices = _slices(spark, sf_dir)
    band = lambda t: features.band_cosine(t["slices"], U, 20, 60, "cosine").select("unit", F.col("n").cast("double").alias("n_inside"), "mean_cosine")
    blocks = [
        Block("geometry", {"r_min": "least radius"}, lambda t: t["slices"].groupBy("unit").agg(F.min("r").alias("r_min")), ["slices"]),
        Block("occupancy", {"n_inside": "slices in the band", "mean_cosine": "their mean cosine"}, band, ["slices"], flips=["mean_cosine"]),
        Block("filter", {"filter_only": "nothing here"}, lambda t: t["filter"], ["filter"]),
    ]

    def relative(d):
        top = d.agg(F.max("r_min").alias("_top"))
        return d.withColumn("r_relative", F.col("r_min") / F.lit(top.first()[0]))

    out = assemble(blocks, {"frames": slices, "slices": slices}, U, F.when(F.col("unit") % 2 == 0, -1).otherwise(1), {"baseline": relative})
    return out.select("unit", "r_min", "n_inside", "mean_cosine", "filter_only", "r_relative")


@query(f"""WITH {EV}, a AS (SELECT unit % 8 AS fragment, k % 20 AS position, CASE WHEN kind = 'view' THEN 'O' WHEN kind = 'click' THEN 'OG' ELSE 'C' END AS name, score AS z FROM ev), g AS (SELECT *, position - 4 AS o FROM a),
l AS (SELECT name, o AS "offset", round(avg(z), 6) AS mean_z, count(*) AS n_atoms FROM g WHERE o >= 0 AND o < 5 AND (name = 'O' OR (name = 'OG' AND o = 0)) GROUP BY name, o)
SELECT name, "offset", mean_z, n_atoms, row_number() OVER (ORDER BY mean_z) - 1 AS layer FROM l""", mean_z=6)
def motif_layers(spark, sf_dir):
    name = F.when(F.col("kind") == "view", "O").when(F.col("kind") == "click", "OG").otherwise("C")
    atoms = observations(spark, sf_dir).select((F.col("unit") % 8).alias("fragment"), (F.col("k") % 20).alias("position"), name.alias("name"), F.col("score").alias("z"))
    places = atoms.select("fragment").distinct().withColumn("place", F.lit(4))
    return detect.motif_layers(atoms, places, ["fragment"], 5, "O", "OG")


@query(f"""WITH {EV}, a AS (SELECT unit % 10 AS frame, unit AS fragment, score AS x, CAST(k AS DOUBLE) AS y FROM ev), c AS (SELECT frame, avg(x) AS cx, avg(y) AS cy FROM a GROUP BY frame),
e AS (SELECT a.frame, fragment, count(*) AS n, min(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS r FROM a JOIN c ON c.frame = a.frame GROUP BY a.frame, fragment) SELECT frame, count(*) FILTER (n >= 30 AND r < 6) AS n_subunits FROM e GROUP BY frame""")
def lining_subunits(spark, sf_dir):
    atoms = observations(spark, sf_dir).select((F.col("unit") % 10).alias("frame"), F.col("unit").alias("fragment"), F.col("score").alias("x"), F.col("k").cast("double").alias("y"))
    return detect.lining_subunits(atoms, ["frame"], "fragment", 4.0)


@query(f"""WITH {EV}, p AS (SELECT unit % 6 AS species, unit FROM ev GROUP BY ALL), q AS (SELECT unit % 6 AS species, CASE WHEN k % 3 = 0 THEN -1 ELSE 1 END AS direction FROM ev WHERE kind = 'purchase' AND unit % 6 <> 5)
SELECT n.species, n_particles, coalesce(n_passes, 0) AS n_passes, coalesce(net, 0) :: BIGINT AS net, coalesce(n_passes, 0) / n_particles AS rate FROM (SELECT species, count(*) AS n_particles FROM p GROUP BY species) n
LEFT JOIN (SELECT species, count(*) AS n_passes, sum(direction) AS net FROM q GROUP BY species) m ON m.species = n.species""")
def crossing_rates(spark, sf_dir):
    ev = observations(spark, sf_dir).withColumn("species", F.col("unit") % 6)
    passes = ev.where("kind = 'purchase' and species <> 5").withColumn("direction", F.when(F.col("k") % 3 == 0, -1).otherwise(1))
    return detect.crossing_rates(passes, ev.select("species", "unit").distinct(), "species")


@query(f"""WITH {EV}, p AS (SELECT unit, t AS at FROM ev WHERE kind = 'purchase'), s AS (SELECT unit, sign(sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END)) AS f, count(*) AS n, sum(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) AS net FROM ev WHERE kind = 'purchase' GROUP BY unit),
w AS (SELECT sign(sum(f)) AS way FROM s) SELECT unit, n AS n_events, net :: BIGINT AS net, f :: INT AS flux_sign, f <> 0 AND f <> way AND way <> 0 AS disagrees FROM s, w""")
def flux_agreement(spark, sf_dir):
    from tidemark.operators.events import checked_flux

    ev = observations(spark, sf_dir).where("kind = 'purchase'").withColumn("direction", F.when(F.col("k") % 2 == 0, 1).otherwise(-1))
    return checked_flux(ev, U)[0]


@query(f"""WITH {EV}, n AS (SELECT *, CASE WHEN k % 7 <> 0 THEN score END AS v FROM ev) SELECT event_id, round(sqrt(var_pop(v) OVER w), 6) AS deviation, first_value(score) OVER w - score AS diff, count(*) OVER w >= 2 AS has_pair FROM n WINDOW w AS (PARTITION BY unit ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""")
def trailing_known_variance(spark, sf_dir):
    w = windows.trailing(U, DAY)
    ev = observations(spark, sf_dir).withColumn("v", F.when(F.col("k") % 7 != 0, F.col("score")))
    return ev.select("event_id", F.round(F.sqrt(F.var_pop("v").over(w)), 6).alias("deviation"), (F.first("score").over(w) - F.col("score")).alias("diff"), (F.count("*").over(w) >= 2).alias("has_pair"))


# further measures and lookups


@query(f"""WITH {EV} SELECT event_id, CASE WHEN score >= 40 AND score <= 80 THEN CASE WHEN k <= 60 THEN 2 ELSE -9 END WHEN score <= 20 THEN 0 WHEN score >= 100 THEN 4 WHEN score < 40 THEN 1 ELSE 3 END AS zone FROM ev""")
def zones(spark, sf_dir):
    from tidemark.operators.events import zone, zone_planes

    low, high = F.lit(20.0), F.lit(100.0)
    a, b = zone_planes(low, high)
    return observations(spark, sf_dir).select("event_id", zone(F.col("score"), F.col("k"), 20.0, 100.0, a, b, 60.0).alias("zone"))


@query(f"""WITH {EV}, d AS (SELECT unit, event_id, CASE WHEN k % 3 = 0 THEN 0 WHEN k % 3 = 1 THEN 1 ELSE -1 END AS direction FROM ev) SELECT event_id, direction FROM d WHERE direction IN (1, 0)""")
def events_of_direction(spark, sf_dir):
    from tidemark.operators.events import of_direction

    d = observations(spark, sf_dir).select("event_id", F.when(F.col("k") % 3 == 0, 0).when(F.col("k") % 3 == 1, 1).otherwise(-1).alias("direction"))
    return of_direction(d, 1)


@query("""SELECT c_custkey, n_name, o_totalprice FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")
def left_one_to_one_join(spark, sf_dir):
    from tidemark.functions.keys import join_one_to_one

    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    best = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("o_totalprice"))
    c = join_one_to_one(t("customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), best, ["c_custkey"], "left")
    return tables.lookup_all(c, t("nation"), ["n_nationkey"], "n_name").select("c_custkey", "n_name", "o_totalprice")


@query(f"""WITH {EV} SELECT event_id FROM ev WHERE unit % 4 = 1 OR (unit % 4 = 2 AND kind IN ('view', 'click'))""")
def pool_members(spark, sf_dir):
    pool = spark.createDataFrame([(1, "*"), (2, "view"), (2, "click")], "system long, condition string")
    ev = observations(spark, sf_dir).select("event_id", (F.col("unit") % 4).alias("system"), F.col("kind").alias("condition"))
    return tables.in_pool(ev, pool).select("event_id")


@query(f"""WITH {NEXT} SELECT event_id, CASE WHEN k >= 0 THEN y END AS y_one_day FROM lab""")
def relabelled(spark, sf_dir):
    from tidemark.operators.labels import relabel

    ev = observations(spark, sf_dir)
    return relabel(ev, of_kind(ev, "purchase"), DAY, U, "y_one_day").select("event_id", "y_one_day")


@query(f"""WITH {SLICES}, o AS (SELECT unit, z, r, z - lag(z) OVER (PARTITION BY unit ORDER BY z) AS dz FROM s), v AS (SELECT unit, median(dz) AS dz, sum(pi() * r * r) AS a FROM o GROUP BY unit), n AS (SELECT unit, count(*) AS n FROM ev WHERE kind = 'view' GROUP BY unit)
SELECT n.unit, n, n / nullif(a * dz, 0) AS density FROM n LEFT JOIN v ON v.unit = n.unit""", density=9)
def column_density(spark, sf_dir):
    counts = observations(spark, sf_dir).where("kind = 'view'").groupBy("unit").agg(F.count("*").alias("n"))
    return features.column_density(_slices(spark, sf_dir), counts, U)


@query(f"""WITH {EV}, g AS (SELECT unit, max(k) FILTER (kind = 'signup') AS c, median(k) FILTER (score >= 50) AS b FROM ev GROUP BY unit) SELECT unit, 1 - c / nullif(b, 0) AS desolvation FROM g""", desolvation=9)
def desolvation(spark, sf_dir):
    return features.desolvation(observations(spark, sf_dir), U, F.col("k"), F.col("score") >= 50, F.col("kind") == "signup")


@query(f"""WITH {EV} SELECT unit, sum((k - 50) * sign(score - 60)) :: BIGINT AS asymmetry FROM ev GROUP BY unit""")
def axial_asymmetry(spark, sf_dir):
    ev = observations(spark, sf_dir).withColumn("q", F.col("k") - 50)
    return features.axial_asymmetry(ev, U, "q", "score", 60.0).withColumn("asymmetry", F.col("asymmetry").cast("long"))


@query(f"""WITH {EV}, m AS (SELECT *, score BETWEEN 70 AND 90 AS up, score BETWEEN 10 AND 30 AS down FROM ev) SELECT unit, count(*) FILTER (up) AS n_upper, count(*) FILTER (down) AS n_lower, count(*) FILTER (CASE WHEN unit % 3 = 1 THEN down WHEN unit % 3 = 2 THEN up ELSE false END) AS n_entry FROM m GROUP BY unit""")
def mouth_counts(spark, sf_dir):
    way = F.when(F.col("unit") % 3 == 1, 1).when(F.col("unit") % 3 == 2, -1)
    return features.mouth_counts(observations(spark, sf_dir), U, "score", 30.0, 70.0, 20.0, way)


@query(f"""WITH {EV}, a AS (SELECT unit, event_id, k % 3 AS fragment, score AS x FROM ev), c AS (SELECT unit, fragment, avg(x) AS c FROM a GROUP BY ALL), f AS (SELECT unit, arg_min(c, fragment) AS c0 FROM c GROUP BY unit)
SELECT event_id, x - 100 * round((c - c0) / 100) AS x FROM a JOIN c ON c.unit = a.unit AND c.fragment = a.fragment JOIN f ON f.unit = a.unit""", x=6)
def aligned_fragments(spark, sf_dir):
    a = observations(spark, sf_dir).select("unit", "event_id", (F.col("k") % 3).alias("fragment"), F.col("score").alias("x"))
    return features.image_aligned(a, U, "fragment", ["x"], {"x": F.lit(100.0)}).select("event_id", "x")


@query("""WITH a AS (SELECT p_partkey, p_brand AS resname, p_type AS name, CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'N' END AS element FROM part)
SELECT p_partkey, CASE WHEN resname = 'Brand#1' AND name = 'ECONOMY' THEN 1 WHEN name = 'ECONOMY' THEN 2 ELSE 3 END AS rung, CASE WHEN resname = 'Brand#1' AND name = 'ECONOMY' THEN 1.25::DOUBLE WHEN name = 'ECONOMY' THEN 1.5::DOUBLE WHEN element = 'C' THEN 1.7::DOUBLE ELSE 1.55::DOUBLE END AS radius FROM a""")
def radius_ladder(spark, sf_dir):
    atoms = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("resname"), F.col("p_type").alias("name"), F.when(F.col("p_size") % 2 == 0, "C").otherwise("N").alias("element"))
    pair = spark.createDataFrame([("Brand#1", "ECONOMY", 1.25)], "resname string, name string, radius double")
    name, element = spark.createDataFrame([("ECONOMY", 1.5)], "name string, radius double"), spark.createDataFrame([("C", 1.7), ("N", 1.55)], "element string, radius double")
    return tables.resolve_ladder(atoms, pair, name, element).select("p_partkey", "rung", "radius")


@query(f"""WITH {EV}, d AS (SELECT unit, t - lag(t) OVER w AS d, abs((k + 100.0) / lag(k + 100.0) OVER w - 1) AS b FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t)) SELECT unit, count(*) FILTER (d <= 0) AS n_not_rising, max(d) - min(d) AS step_spread, count(*) FILTER (b > 0.3) AS n_box_jumps FROM d GROUP BY unit""")
def step_checks(spark, sf_dir):
    ev = observations(spark, sf_dir).withColumn("box", F.col("k") + 100.0)
    return detect.check_steps(ev, U, box="box", most_change=0.3)


@query(f"""WITH {EV}, h AS (SELECT CAST(floor(score / 20) AS BIGINT) AS bin, count(*) AS n FROM ev WHERE score < 200 GROUP BY ALL), p AS (SELECT bin FROM h ORDER BY n DESC, bin LIMIT 1) SELECT h.bin FROM h, p WHERE h.bin > p.bin ORDER BY n, h.bin LIMIT 1""")
def first_minimum(spark, sf_dir):
    from tidemark.operators.spatial import first_minimum as least

    h = observations(spark, sf_dir).where("score < 200").groupBy(F.floor(F.col("score") / 20).alias("bin")).agg(F.count("*").alias("n"))
    return least(h, "bin", "n")


@query(f"""WITH {EV} SELECT unit, k % 4 AS residue, avg(score) AS score, avg(CAST(k AS DOUBLE)) AS k FROM ev GROUP BY unit, k % 4""", score=6, k=6)
def residue_centres(spark, sf_dir):
    ev = observations(spark, sf_dir).withColumns({"residue": F.col("k") % 4, "k": F.col("k").cast("double")})
    return features.centres(ev, U, ["residue"], ["score", "k"])


@query(f"""WITH {NEXT} SELECT event_id, CASE WHEN score = 0 THEN NULL ELSE CASE WHEN k % 9 = 0 THEN NULL ELSE score END END AS score FROM lab""")
def missing_is_null(spark, sf_dir):
    from tidemark.functions.keys import nan_to_null

    ev = observations(spark, sf_dir)
    d = ev.select("event_id", F.when((F.col("score") == 0) | (F.col("k") % 9 == 0), F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))
    return nan_to_null(d)
