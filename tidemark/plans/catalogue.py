"""One query per operator over the driver tables, and the same in SQL.

Units are users, observations are their rows in `events`, target events are purchases, a second kind of
event is signups, scores are values. Times are microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import derived_seed, join_one_to_one, micros, minimum_image
from tidemark.operators import alarms, events, explain, features, intervals, labels, lookup, metrics, spatial, splits, tables, windows

HOUR = 3_600_000_000
DAY = 24 * HOUR
U = ["unit"]
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

EV = "ev AS (SELECT user_id AS unit, event_id, epoch_us(ts) AS t, event_type AS kind, value AS score, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
NEXT = f"""{EV}, p AS (SELECT unit, t AS at FROM ev WHERE kind = 'purchase'),
l AS (SELECT e.*, EXISTS (SELECT 1 FROM p WHERE p.unit = e.unit AND p.at > e.t AND p.at <= e.t + {DAY}) AS yb, max(t) OVER (PARTITION BY unit) AS t_last FROM ev e),
lab AS (SELECT unit, event_id, t, kind, score, k, CAST(yb AS INT) AS y, yb OR t + {DAY} <= t_last AS valid FROM l)"""
ARMED = f"""{EV}, a AS (SELECT *, coalesce(last_value(CASE WHEN score >= 60 THEN true WHEN score < 20 THEN false END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING), false) AS armed FROM ev),
b AS (SELECT *, armed AND NOT coalesce(lag(armed) OVER (PARTITION BY unit ORDER BY t), false) AS start FROM a),
c AS (SELECT *, CASE WHEN armed THEN sum(CAST(start AS INT)) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING) END AS episode FROM b),
eps AS (SELECT unit, episode, min(t) AS t0, max(t) AS t1, count(*) AS n_rows FROM c WHERE armed GROUP BY unit, episode),
p AS (SELECT unit, event_id, t AS at FROM ev WHERE kind = 'purchase')"""


def query(sql: str | None = None, **digits: int):
    """Register a query and its SQL. Sums of doubles depend on their order: columns named with a number of
    digits are rounded on both sides."""

    def add(f):
        def rounded(spark, sf_dir):
            return f(spark, sf_dir).withColumns({c: F.round(c, n) for c, n in digits.items()})

        QUERIES[f.__name__] = rounded if digits else f
        if sql:
            ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, {n}) AS {c}' for c, n in digits.items())}) FROM ({sql})" if digits else sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("unit"), "event_id", micros("ts").alias("t"), F.col("event_type").alias("kind"), F.col("value").alias("score"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def of_kind(ev: DataFrame, kind: str) -> DataFrame:
    return ev.where(F.col("kind") == kind).select("unit", F.col("t").alias("at"))


def labelled(spark, sf_dir: str, taus: list[int] | None = None) -> DataFrame:
    ev = observations(spark, sf_dir)
    return labels.forward_labels(ev, of_kind(ev, "purchase"), taus or [DAY], U)


def alarmed(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ev = observations(spark, sf_dir)
    return windows.latch(ev, "score", 60.0, 20.0, U), ev.where("kind = 'purchase'").select("unit", "event_id", F.col("t").alias("at"))


# labels


@query(f"WITH {NEXT} SELECT event_id, y, valid FROM lab")
def label_forward(spark, sf_dir):
    return labelled(spark, sf_dir).select("event_id", "y", "valid")


@query(f"""WITH {EV}, p AS (SELECT unit, t AS at FROM ev WHERE kind = 'purchase'), tau(tau) AS (VALUES ({6 * HOUR}), ({DAY}), ({2 * DAY}))
SELECT event_id, CAST(tau AS BIGINT) AS tau, CAST(EXISTS (SELECT 1 FROM p WHERE p.unit = e.unit AND p.at > e.t AND p.at <= e.t + tau) AS INT) AS y FROM ev e, tau""")
def label_multi_tau(spark, sf_dir):
    return labelled(spark, sf_dir, [6 * HOUR, DAY, 2 * DAY]).select("event_id", "tau", "y")


@query(f"""WITH {NEXT} SELECT unit, count(*) AS n_rows, CAST(sum(y) AS BIGINT) AS n_positive, count(*) FILTER (NOT valid) AS n_censored,
avg(y) FILTER (valid) AS base_rate_valid, avg(y) AS base_rate_all FROM lab GROUP BY unit""")
def label_summary(spark, sf_dir):
    return labels.label_summary(labelled(spark, sf_dir), U)


@query(f"""WITH {EV}, p AS (SELECT unit, t AS at FROM ev WHERE kind = 'purchase'),
x AS (SELECT e.event_id, bool_or(p.at > e.t AND p.at <= e.t + {6 * HOUR}) AS a, bool_or(p.at > e.t AND p.at <= e.t + {DAY}) AS b FROM ev e LEFT JOIN p ON p.unit = e.unit GROUP BY e.event_id)
SELECT event_id, CAST(coalesce(a, false) AS INT) AS y_6h, CAST(coalesce(b, false) AS INT) AS y_1d FROM x""")
def label_wide(spark, sf_dir):
    w = labels.wide_labels(labelled(spark, sf_dir, [6 * HOUR, DAY]), [6 * HOUR, DAY], ["event_id"])
    return w.select("event_id", F.col(f"y_tau{6 * HOUR}").alias("y_6h"), F.col(f"y_tau{DAY}").alias("y_1d"))


@query(f"""WITH {EV}, s AS (SELECT unit, t AS t_entry, (SELECT min(p.t) FROM ev p WHERE p.unit = s.unit AND p.kind = 'purchase' AND p.t > s.t) AS t_exit FROM ev s WHERE kind = 'signup')
SELECT event_id, EXISTS (SELECT 1 FROM s WHERE s.unit = e.unit AND s.t_entry <= e.t AND e.t <= s.t_exit) AS in_interval FROM ev e""")
def in_interval(spark, sf_dir):
    ev = observations(spark, sf_dir)
    ranges = intervals.with_next(ev.where("kind = 'signup'").select("unit", "t"), of_kind(ev, "purchase"), U, name="t_exit").where("t_exit is not null").withColumnRenamed("t", "t_entry").select("unit", "t_entry", "t_exit")
    return labels.in_interval(ev, ranges, U).select("event_id", "in_interval")


# joins along time


@query(f"""WITH {EV} SELECT e.event_id, (SELECT max(p.t) FROM ev p WHERE p.unit = e.unit AND p.kind = 'purchase' AND p.t <= e.t) AS last_event,
e.t - (SELECT max(p.t) FROM ev p WHERE p.unit = e.unit AND p.kind = 'purchase' AND p.t <= e.t) AS since FROM ev e""")
def asof_since_last(spark, sf_dir):
    ev = observations(spark, sf_dir)
    out = intervals.with_last(ev, of_kind(ev, "purchase"), U)
    return out.select("event_id", "last_event", (F.col("t") - F.col("last_event")).alias("since"))


@query(f"""WITH {EV} SELECT e.event_id, (SELECT min(abs(p.t - e.t)) FROM ev p WHERE p.unit = e.unit AND p.kind = 'error') AS distance FROM ev e WHERE kind = 'purchase'""")
def nearest_event(spark, sf_dir):
    ev = observations(spark, sf_dir)
    out = intervals.with_nearest(ev.where("kind = 'purchase'"), of_kind(ev, "error"), U)
    return out.select("event_id", F.abs(F.col("nearest_event") - F.col("t")).alias("distance"))


@query(f"""WITH {EV}, f AS (SELECT *, min(t) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW) AS t0 FROM ev)
SELECT event_id, (SELECT count(*) FROM ev p WHERE p.unit = f.unit AND p.kind = 'purchase' AND p.t > f.t0 AND p.t <= f.t) AS n,
(SELECT count(*) FROM ev p WHERE p.unit = f.unit AND p.kind = 'purchase' AND p.t > f.t0 AND p.t <= f.t) / (greatest(t - t0, 1) / {HOUR}.0) AS per_hour FROM f""")
def range_count_rate(spark, sf_dir):
    ev = observations(spark, sf_dir)
    w = windows.trailing(U, 2 * DAY)
    d = intervals.with_count(ev, of_kind(ev, "purchase"), U)
    d = d.withColumns({"_c0": F.first("events_so_far").over(w), "_t0": F.first("t").over(w)})
    n = F.col("events_so_far") - F.col("_c0")
    return d.select("event_id", n.alias("n"), (n / (F.greatest(F.col("t") - F.col("_t0"), F.lit(1)) / HOUR)).alias("per_hour"))


@query(f"""WITH {EV}, a AS (SELECT unit, t FROM ev WHERE kind = 'purchase'), b AS (SELECT unit, t FROM ev WHERE kind = 'signup'),
d AS (SELECT b.unit, b.t, min(abs(a.t - b.t)) AS shift FROM b LEFT JOIN a ON a.unit = b.unit GROUP BY b.unit, b.t),
ga AS (SELECT unit, count(*) AS n FROM a GROUP BY unit), gb AS (SELECT unit, count(*) AS n, median(shift) AS m, quantile_cont(shift, 0.9) AS q, avg(CAST(coalesce(shift <= {DAY}, false) AS INT)) AS f FROM d GROUP BY unit)
SELECT coalesce(ga.unit, gb.unit) AS unit, coalesce(ga.n, 0) AS n_own, coalesce(gb.n, 0) AS n_given, m AS median_shift, q AS p90_shift, f AS matched FROM ga FULL JOIN gb ON ga.unit = gb.unit""", p90_shift=2)
def source_compare(spark, sf_dir):
    ev = observations(spark, sf_dir)
    return events.compare_sources(of_kind(ev, "purchase"), of_kind(ev, "signup"), U, DAY)


@query(f"""WITH {EV}, g AS (SELECT unit, event_id, t FROM ev),
y AS (SELECT event_id, EXISTS (SELECT 1 FROM ev p WHERE p.kind = 'purchase' AND p.unit = g.unit AND p.t > g.t AND p.t <= g.t + {DAY}) AS a, EXISTS (SELECT 1 FROM ev p WHERE p.kind = 'signup' AND p.unit = g.unit AND p.t > g.t AND p.t <= g.t + {DAY}) AS b FROM g)
SELECT CAST({DAY} AS BIGINT) AS tau, sum(CAST(a AND b AS INT)) / sum(CAST(a OR b AS INT)) AS jaccard FROM y""")
def source_label_overlap(spark, sf_dir):
    ev = observations(spark, sf_dir)
    a, b = (labels.forward_labels(ev, of_kind(ev, k), [DAY], U) for k in ("purchase", "signup"))
    return events.label_overlap(a, b, ["event_id"])


@query("""SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000""")
def one_to_one_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    keyed = join_one_to_one(o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    return keyed.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_totalprice")


# trailing windows


@query(f"""WITH {EV} SELECT event_id, CAST(sum(CAST(round(score * 100) AS BIGINT)) OVER w AS BIGINT) AS sum_cents, count(*) OVER w AS n, round(sqrt(var_pop(score) OVER w), 6) AS deviation FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""")
def trailing_mean_var(spark, sf_dir):
    w = windows.trailing(U, DAY)
    return observations(spark, sf_dir).select("event_id", F.sum(F.round(F.col("score") * 100).cast("long")).over(w).alias("sum_cents"), F.count("*").over(w).alias("n"), F.round(F.sqrt(F.var_pop("score").over(w)), 6).alias("deviation"))


@query(f"""WITH {EV} SELECT event_id, avg(CAST(kind = 'error' AS INT)) OVER w AS frac, ln((sum(CAST(kind = 'error' AS INT)) OVER w + 1) / (sum(CAST(kind <> 'error' AS INT)) OVER w + 1)) AS log_odds
FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t RANGE BETWEEN {2 * DAY} PRECEDING AND CURRENT ROW)""", log_odds=9)
def trailing_frac_logodds(spark, sf_dir):
    w = windows.trailing(U, 2 * DAY)
    hit = F.col("kind") == "error"
    return observations(spark, sf_dir).select("event_id", F.avg(hit.cast("int")).over(w).alias("frac"), windows.trailing_log_odds(hit, w).alias("log_odds"))


@query(f"""WITH {EV} SELECT event_id, first_value(score) OVER w - score AS diff, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""")
def trailing_endpoint_diff(spark, sf_dir):
    w = windows.trailing(U, DAY)
    return observations(spark, sf_dir).select("event_id", (F.first("score").over(w) - F.col("score")).alias("diff"), F.count("*").over(w).alias("n"))


@query(f"""WITH {EV}, n AS (SELECT *, CASE WHEN k % 7 <> 0 THEN k END AS k7 FROM ev)
SELECT event_id, avg(CASE WHEN k7 IS NOT NULL THEN score END) OVER w AS mean_score, avg(CAST(k7 AS DOUBLE)) OVER w AS mean_k FROM n WINDOW w AS (PARTITION BY unit ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""", mean_score=9, mean_k=9)
def trailing_joint_means(spark, sf_dir):
    ev = observations(spark, sf_dir).withColumn("k7", F.when(F.col("k") % 7 != 0, F.col("k").cast("double")))
    a, b = windows.joint_means("score", "k7", windows.trailing(U, DAY))
    return ev.select("event_id", a.alias("mean_score"), b.alias("mean_k"))


@query(f"WITH {EV} SELECT event_id, avg(score) OVER (PARTITION BY unit ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rolling FROM ev", rolling=9)
def rolling_rows(spark, sf_dir):
    return observations(spark, sf_dir).select("event_id", F.avg("score").over(windows.ordered(U).rowsBetween(-4, 0)).alias("rolling"))


@query(f"""WITH {EV}, c AS (SELECT *, coalesce(kind <> lag(kind) OVER w, true) AS chg FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t))
SELECT event_id, t - last_value(CASE WHEN chg THEN t END IGNORE NULLS) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING) AS age FROM c""")
def state_age(spark, sf_dir):
    return windows.state_age(observations(spark, sf_dir), "kind", U).select("event_id", "age")


@query(f"""WITH {NEXT}, e AS (SELECT unit, t, y = 1 AND coalesce(lag(y) OVER w, 0) <> 1 AS up, y = 1 AND coalesce(lead(y) OVER w, 0) <> 1 AS down FROM lab WINDOW w AS (PARTITION BY unit ORDER BY t))
SELECT unit, CAST(sum(CAST(up AS INT)) AS BIGINT) AS runs, max(CASE WHEN down THEN t END) AS last_fall FROM e GROUP BY unit""")
def run_counts(spark, sf_dir):
    return windows.run_counts(labelled(spark, sf_dir), "y", U)


@query(f"""WITH {EV}, d AS (SELECT unit, t - lag(t) OVER (PARTITION BY unit ORDER BY t) AS d FROM ev WHERE kind = 'purchase') SELECT unit, count(*) AS n_events, median(d) AS median_interval FROM d GROUP BY unit""")
def inter_event_interval(spark, sf_dir):
    return windows.inter_event_intervals(observations(spark, sf_dir).where("kind = 'purchase'"), U)


@query(f"WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) - 1 AS i FROM ev) SELECT event_id FROM n WHERE i % 5 = 0")
def stride_sample(spark, sf_dir):
    return windows.stride(observations(spark, sf_dir), 5, U).select("event_id")


@query(f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY unit) AS n FROM ev)
SELECT event_id FROM n WHERE n <= 10 OR list_contains(list_transform(range(10), lambda q: CAST(floor(q * (n - 1) / 9) AS BIGINT)), i)""")
def even_sample(spark, sf_dir):
    return windows.even_sample(observations(spark, sf_dir), 10, U).select("event_id")


# event detection

LADDER = f"""{EV}, z AS (SELECT *, CASE WHEN score < 10 THEN 0 WHEN score < 25 THEN 1 WHEN score < 50 THEN CASE WHEN k <= 79 THEN 2 ELSE -9 END WHEN score < 90 THEN 3 ELSE 4 END AS zone FROM ev),
l AS (SELECT *, lag(zone) OVER w AS pz, coalesce(abs(score - lag(score) OVER w) > 150, false) AS wrap, row_number() OVER w = 1 AS first FROM z WINDOW w AS (PARTITION BY unit ORDER BY t)),
c AS (SELECT *, NOT first AND zone <> pz AND NOT wrap AS chg FROM l),
s AS (SELECT *, sum(CAST(first OR wrap OR (chg AND zone IN (0, 4, -9)) AS INT)) OVER (PARTITION BY unit ORDER BY t ROWS UNBOUNDED PRECEDING) AS seg FROM c),
g AS (SELECT unit, seg, min(t) AS t_exit, arg_min(zone, t) AS origin, arg_min(chg, t) AS by_change, max(CASE WHEN chg AND zone = 2 THEN t END) AS t_entry,
  arg_max(pz IN (1, 3), CASE WHEN chg AND zone = 2 THEN t END) AS seen FROM s GROUP BY unit, seg),
h AS (SELECT *, lag(origin) OVER w AS o2, lag(t_entry) OVER w AS t2, lag(seen) OVER w AS s2 FROM g WINDOW w AS (PARTITION BY unit ORDER BY seg)),
found AS (SELECT unit, t2 AS t_entry, t_exit, s2 AS entrance_observed, CASE origin WHEN 4 THEN 1 ELSE -1 END AS direction FROM h WHERE by_change AND origin IN (0, 4) AND o2 = 4 - origin AND t2 IS NOT NULL)"""


def zoned(ev: DataFrame, wrap) -> DataFrame:
    s = F.col("score")
    zone = F.when(s < 10, 0).when(s < 25, 1).when(s < 50, F.when(F.col("k") <= 79, 2).otherwise(-9)).when(s < 90, 3).otherwise(4)
    return ev.withColumns({"zone": zone, "wrap": wrap})


def ladder(spark, sf_dir) -> DataFrame:
    return zoned(observations(spark, sf_dir), F.abs(F.col("score") - F.lag("score").over(windows.ordered(U))) > 150)


@query(f"WITH {LADDER} SELECT * FROM found")
def ladder_events(spark, sf_dir):
    return events.ladder_events(ladder(spark, sf_dir), U, wrap="wrap")


@query(f"WITH {LADDER} SELECT unit, count(*) AS n_events, CAST(sum(direction) AS BIGINT) AS net, CAST(sign(sum(direction)) AS INT) AS flux_sign FROM found GROUP BY unit")
def flux_sign(spark, sf_dir):
    return events.flux_sign(events.ladder_events(ladder(spark, sf_dir), U, wrap="wrap"), U)


@query(f"WITH {LADDER} SELECT unit, arg_min(zone, t) NOT IN (0, 4) AS left_censored FROM z GROUP BY unit")
def left_censored(spark, sf_dir):
    return events.left_censored(ladder(spark, sf_dir), U)


# alarms


@query(f"WITH {ARMED} SELECT event_id, armed FROM a")
def hysteresis_state(spark, sf_dir):
    return alarmed(spark, sf_dir)[0].select("event_id", "armed")


@query(f"WITH {ARMED} SELECT unit, CAST(episode AS BIGINT) AS episode, t0, t1, n_rows FROM eps")
def episodes(spark, sf_dir):
    return alarms.episodes(alarmed(spark, sf_dir)[0], U)


WARNED = f"""{ARMED}, w0 AS (SELECT p.unit, p.event_id, p.at, arg_min(e.t0, c.t) AS t0 FROM p JOIN c ON c.unit = p.unit AND c.armed AND c.t < p.at AND c.t >= p.at - {DAY} JOIN eps e ON e.unit = c.unit AND e.episode = c.episode GROUP BY p.unit, p.event_id, p.at),
w AS (SELECT p.unit, p.event_id, w0.t0 IS NOT NULL AS warned, p.at - w0.t0 AS lead FROM p LEFT JOIN w0 ON w0.event_id = p.event_id),
none AS (SELECT unit, episode FROM eps e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.unit = e.unit AND p.at BETWEEN e.t0 AND e.t1 + {DAY}))"""


@query(f"WITH {WARNED} SELECT event_id, warned, lead FROM w")
def warned_events(spark, sf_dir):
    a, p = alarmed(spark, sf_dir)
    return alarms.warned_events(a, p, DAY, U, "event_id").select("event_id", "warned", "lead")


@query(f"WITH {WARNED} SELECT unit, CAST(episode AS BIGINT) AS episode FROM none")
def empty_episodes(spark, sf_dir):
    a, p = alarmed(spark, sf_dir)
    return alarms.empty_episodes(alarms.episodes(a, U), p, DAY, U).select("unit", "episode")


@query(f"""WITH {WARNED}, d AS (SELECT unit, count(*) AS n_rows, avg(CAST(armed AS INT)) AS duty FROM c GROUP BY unit),
x AS (SELECT unit, count(*) AS n_events, avg(CAST(warned AS INT)) AS warned, median(lead) AS m, quantile_cont(lead, 0.1) AS lo, quantile_cont(lead, 0.9) AS hi FROM w GROUP BY unit)
SELECT d.unit, d.n_rows, duty, coalesce(n_events, 0) AS n_events, x.warned, m AS lead_median, lo AS lead_p10, hi AS lead_p90,
coalesce((SELECT count(*) FROM eps WHERE eps.unit = d.unit), 0) AS n_episodes, coalesce((SELECT count(*) FROM none WHERE none.unit = d.unit), 0) AS n_empty FROM d LEFT JOIN x ON x.unit = d.unit""", lead_p10=2, lead_p90=2)
def alarm_metrics(spark, sf_dir):
    a, p = alarmed(spark, sf_dir)
    return alarms.alarm_metrics(a, p, DAY, U, "event_id")


@query(f"WITH {EV}, u AS (SELECT DISTINCT unit FROM ev) SELECT u.unit, quantile_cont(e.score, 0.95) AS threshold FROM u JOIN ev e ON e.unit <> u.unit GROUP BY u.unit", threshold=6)
def loo_threshold(spark, sf_dir):
    return alarms.leave_one_out_quantile(observations(spark, sf_dir), "unit", "score", 0.95)


@query(f"WITH {EV}, q AS (SELECT unit, quantile_cont(score, 0.8) AS threshold FROM ev GROUP BY unit) SELECT event_id, score > threshold AS armed FROM ev JOIN q ON q.unit = ev.unit")
def duty_matched_alarm(spark, sf_dir):
    return alarms.duty_matched(observations(spark, sf_dir), U, "score", 0.2).select("event_id", "armed")


@query(f"""WITH {ARMED}, n AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY unit) AS n FROM a)
SELECT x.event_id, y.armed AS shifted FROM n x JOIN n y ON y.unit = x.unit AND (y.i + 7) % y.n = x.i""")
def cyclic_shift(spark, sf_dir):
    return windows.cyclic_shift(alarmed(spark, sf_dir)[0], "armed", F.lit(7), U).select("event_id", "shifted")


# ranking metrics

AP = """c AS (SELECT {by}, score, sum(y) AS tp, count(*) AS n FROM {src} GROUP BY {by}, score),
r AS (SELECT *, sum(tp) OVER w AS ct, sum(n) OVER w AS cn FROM c WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
m AS (SELECT {by}, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(tp) AS BIGINT) AS n_positive, sum(tp * (ct / cn)) AS s FROM r GROUP BY {by}),
ap AS (SELECT {by}, n_rows, n_positive, n_positive / n_rows AS base_rate, CASE WHEN n_positive > 0 AND n_positive < n_rows THEN s / n_positive END AS ap FROM m)"""


@query(f"WITH {NEXT}, v AS (SELECT * FROM lab WHERE valid), {AP.format(by='unit', src='v')} SELECT unit, n_rows, n_positive, base_rate, ap, ap / base_rate AS ratio FROM ap", ap=9, ratio=9)
def average_precision(spark, sf_dir):
    return metrics.average_precision(labelled(spark, sf_dir).where("valid"), U)


@query(f"""WITH {NEXT}, s AS (SELECT unit % 16 AS grp, y, avg(score) OVER (PARTITION BY unit ORDER BY t RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS score, valid FROM lab),
v AS (SELECT grp, y, round(score, 6) AS score FROM s WHERE valid), {AP.format(by='grp', src='v')} SELECT grp, n_rows, n_positive, base_rate, ap, ap / base_rate AS ratio FROM ap""", ap=9, ratio=9)
def forecast_quality(spark, sf_dir):
    """Flagship: labels, a trailing mean as the score, and its ranking quality per group of units."""
    d = labelled(spark, sf_dir)
    d = d.withColumn("score", F.round(F.avg("score").over(windows.trailing(U, DAY)), 6)).where("valid")
    return metrics.average_precision(d.withColumn("grp", F.col("unit") % 16), ["grp"])


@query(f"""WITH {NEXT}, v AS (SELECT * FROM lab WHERE valid), r AS (SELECT unit, y, rank() OVER (PARTITION BY unit ORDER BY score) + (count(*) OVER (PARTITION BY unit, score) - 1) / 2 AS rk FROM v),
g AS (SELECT unit, sum(y) AS p, count(*) AS n, sum(rk * y) AS s FROM r GROUP BY unit)
SELECT unit, CASE WHEN p > 0 AND p < n THEN (s - p * (p + 1) / 2) / (p * (n - p)) END AS auc FROM g""", auc=9)
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(labelled(spark, sf_dir).where("valid"), U)


@query(f"WITH {NEXT} SELECT kind, avg((least(score / 200, 1) - y) ** 2) AS brier FROM lab WHERE valid GROUP BY kind", brier=9)
def brier(spark, sf_dir):
    d = labelled(spark, sf_dir).where("valid").withColumn("prob", F.least(F.col("score") / 200, F.lit(1.0)))
    return metrics.brier(d, ["kind"])


@query(f"""WITH {NEXT}, v AS (SELECT kind, y, score AS p FROM lab WHERE valid), q AS (SELECT kind, list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM v GROUP BY kind),
b AS (SELECT v.kind, y, p, greatest(1, len(list_filter(edges, lambda e: e < p))) AS bin FROM v JOIN q ON q.kind = v.kind)
SELECT kind, CAST(bin AS INT) AS bin, count(*) AS n_rows, avg(p) AS mean_p, avg(y) AS mean_y FROM b GROUP BY kind, bin""", mean_p=9)
def reliability_bins(spark, sf_dir):
    d = labelled(spark, sf_dir).where("valid")
    return metrics.reliability_bins(d, ["kind"], 10, "y", "score")


CURVE = """c AS (SELECT kind, score, sum(y) AS tp, count(*) AS n FROM v GROUP BY kind, score),
r AS (SELECT kind, score AS threshold, sum(tp) OVER w AS tps, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY kind) AS p, sum(n) OVER (PARTITION BY kind) AS nn FROM c WINDOW w AS (PARTITION BY kind ORDER BY score DESC))"""


@query(f"WITH {NEXT}, v AS (SELECT * FROM lab WHERE valid), {CURVE} SELECT kind, threshold, CAST(tps AS BIGINT) AS tps, CAST(cn - tps AS BIGINT) AS fps, tps / cn AS precision, tps / nullif(p, 0) AS recall, (cn - tps) / nullif(nn - p, 0) AS fpr FROM r")
def pr_roc_curve(spark, sf_dir):
    return metrics.curve(labelled(spark, sf_dir).where("valid"), ["kind"])


@query(f"""WITH {NEXT}, v AS (SELECT * FROM lab WHERE valid), {CURVE}, f AS (SELECT kind, threshold, p, CASE WHEN tps > 0 THEN 2 * (tps / cn) * (tps / p) / (tps / cn + tps / p) ELSE 0 END AS f1 FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY f1 DESC, threshold) AS rn FROM f) SELECT kind, CASE WHEN p > 0 THEN threshold ELSE 0.5 END AS threshold, CASE WHEN p > 0 THEN f1 END AS f1 FROM b WHERE rn = 1""", f1=9)
def f1_threshold(spark, sf_dir):
    return metrics.f1_threshold(labelled(spark, sf_dir).where("valid"), ["kind"])


@query(f"""WITH {NEXT}, c AS (SELECT kind, count(*) FILTER (score >= 60 AND y = 1) AS tp, count(*) FILTER (score >= 60 AND y = 0) AS fp, count(*) FILTER (score < 60 AND y = 1) AS fn, count(*) FILTER (score < 60 AND y = 0) AS tn FROM lab WHERE valid GROUP BY kind)
SELECT *, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy, (tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c""", mcc=9)
def confusion_metrics(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir).where("valid").withColumn("verdict", F.col("score") >= 60), ["kind"])


@query(f"""WITH {EV}, a AS (SELECT *, (rank() OVER (PARTITION BY kind ORDER BY score) + (count(*) OVER (PARTITION BY kind, score) - 1) / 2) / count(*) OVER (PARTITION BY kind) AS pa,
(rank() OVER (PARTITION BY kind ORDER BY k) + (count(*) OVER (PARTITION BY kind, k) - 1) / 2) / count(*) OVER (PARTITION BY kind) AS pb FROM ev) SELECT event_id, (pa + pb) / 2 AS ensemble FROM a""")
def pct_rank_ensemble(spark, sf_dir):
    d = metrics.percentile_rank(observations(spark, sf_dir), ["kind"], "score", "a")
    d = metrics.percentile_rank(d, ["kind"], "k", "b")
    return d.select("event_id", ((F.col("a") + F.col("b")) / 2).alias("ensemble"))


BOOT = "w AS (SELECT unit, b AS boot, (unit * 7 + b * 13) % 3 AS w FROM (SELECT DISTINCT unit FROM ev), (SELECT unnest(range(20)) AS b))"


@query(f"""WITH {NEXT}, {BOOT}, c AS (SELECT w.boot, l.score, sum(l.y * w.w) AS tp, sum(w.w) AS n FROM lab l JOIN w ON w.unit = l.unit WHERE l.valid AND w.w > 0 GROUP BY w.boot, l.score),
r AS (SELECT *, sum(tp) OVER x AS ct, sum(n) OVER x AS cn FROM c WINDOW x AS (PARTITION BY boot ORDER BY score DESC)),
m AS (SELECT boot, sum(tp) AS p, sum(n) AS n, sum(tp * (ct / cn)) AS s FROM r GROUP BY boot)
SELECT boot, CAST(n AS BIGINT) AS n_rows, CASE WHEN p > 0 AND p < n THEN s / p END AS ap FROM m""", ap=9)
def bootstrap_ap(spark, sf_dir):
    d = labelled(spark, sf_dir).where("valid")
    units = d.select("unit").distinct()
    w = units.withColumn("boot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).withColumn("w", (F.col("unit") * 7 + F.col("boot") * 13) % 3).where("w > 0")
    return metrics.weighted_ap(d, w, U).select("boot", "n_rows", "ap")


# splits


@query(f"WITH {EV}, g AS (SELECT kind, count(*) AS n_test FROM ev GROUP BY kind) SELECT kind, n_test, (SELECT count(*) FROM ev) - n_test AS n_train, CAST(0 AS BIGINT) AS n_overlap FROM g")
def loo_group_folds(spark, sf_dir):
    return splits.leave_one_out_folds(observations(spark, sf_dir), "kind")


@query(f"WITH {EV}, g AS (SELECT kind, count(*) AS n FROM ev GROUP BY kind) SELECT a.kind AS outer_group, b.kind AS inner_group, (SELECT count(*) FROM ev) - a.n - b.n AS n_train FROM g a JOIN g b ON a.kind <> b.kind")
def inner_folds(spark, sf_dir):
    return splits.inner_folds(observations(spark, sf_dir), "kind")


@query(f"""WITH {EV}, s AS (SELECT min(t) AS a, max(t) AS z FROM ev), b AS (SELECT unnest(range(4)) AS block), e AS (SELECT block, a + (z - a) / 4 * block AS lo, a + (z - a) / 4 * (block + 1) AS hi FROM s, b),
r AS (SELECT block, t >= lo AND (t < hi OR (block = 3 AND t <= hi)) AS test, t < lo - {DAY} OR t >= hi + {DAY} AS train FROM ev, e)
SELECT CAST(block AS INT) AS block, count(*) FILTER (test) AS n_test, count(*) FILTER (train AND NOT test) AS n_train, count(*) FILTER (NOT test AND NOT train) AS n_gap FROM r GROUP BY block""")
def embargo_blocks(spark, sf_dir):
    return splits.viable_blocks(splits.time_blocks(observations(spark, sf_dir), 4, DAY))


# columns


def _column_sql(cols: list[str]) -> str:
    one = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, 1 - count({c}) / count(*) AS missing_frac, count(DISTINCT {c}) AS n_distinct FROM t" for c in cols)
    return f"WITH t AS (SELECT *, CASE WHEN l_tax > 0.04 THEN l_tax END AS tax, 1 AS one, CAST(NULL AS DOUBLE) AS gone FROM lineitem), o AS ({one}) SELECT *, CASE WHEN missing_frac = 1 THEN 'missing' WHEN n_distinct <= 1 THEN 'constant' ELSE 'active' END AS verdict FROM o"


@query(_column_sql(["l_quantity", "l_returnflag", "tax", "one", "gone"]))
def column_profile(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumns({"tax": F.when(F.col("l_tax") > 0.04, F.col("l_tax")), "one": F.lit(1), "gone": F.lit(None).cast("double")})
    return tables.column_profile(t, ["l_quantity", "l_returnflag", "tax", "one", "gone"])


@query("""WITH t AS (SELECT CASE WHEN l_linenumber <> 3 THEN l_tax END AS v, l_quantity AS i FROM lineitem) SELECT 'v' AS "column", avg(CAST(v IS NULL AND i >= 10 AS INT)) AS broken_frac FROM t""")
def indicator_audit(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("v"), F.col("l_quantity").alias("i"))
    return tables.indicator_audit(t, [("v", "i", 10.0)])


@query(f"""WITH {EV}, d AS (SELECT kind IS DISTINCT FROM lag(kind) OVER w AS a, k IS DISTINCT FROM lag(k) OVER w AS b, row_number() OVER w AS i FROM ev WINDOW w AS (PARTITION BY unit ORDER BY t))
SELECT unnest(['kind', 'k']) AS "column", unnest([avg(CAST(a AS INT)), avg(CAST(b AS INT))]) AS frac_changed FROM d WHERE i > 1""")
def change_fractions(spark, sf_dir):
    return tables.change_fractions(observations(spark, sf_dir), ["kind", "k"], U)


@query("""WITH t AS (SELECT l_quantity AS a, 2 * l_quantity - 3 AS b, l_tax AS c FROM lineitem), f AS (SELECT regr_slope(b, a) AS s, regr_intercept(b, a) AS i, max(abs(b)) AS m FROM t)
SELECT 'a' AS column_a, 'b' AS column_b, round(s, 6) AS slope, round(i, 6) AS intercept FROM f WHERE (SELECT max(abs(b - f.s * a - f.i)) FROM t) <= 1e-9 * greatest(1, m)""")
def affine_duplicates(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (2 * F.col("l_quantity") - 3).alias("b"), F.col("l_tax").alias("c"))
    return tables.affine_duplicates(t, ["a", "b", "c"]).withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 6)})


@query("""WITH t AS (SELECT l_quantity AS a, l_quantity + l_tax AS b, l_discount AS c FROM lineitem) SELECT 'a' AS column_a, 'b' AS column_b, round(corr(a, b), 9) AS r FROM t HAVING abs(corr(a, b)) >= 0.98""")
def correlated_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_tax")).alias("b"), F.col("l_discount").alias("c"))
    return tables.correlated_pairs(t, ["a", "b", "c"]).withColumn("r", F.round("r", 9))


@query("""WITH g AS (SELECT r_name, min(n_nationkey) AS a, max(n_nationkey) AS b, min(length(n_name)) AS c, max(length(n_name)) AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT unnest(['n_nationkey', 'len']) AS "column", unnest([max(a)::DOUBLE, max(c)::DOUBLE]) AS largest_min, unnest([min(b)::DOUBLE, min(d)::DOUBLE]) AS smallest_max, unnest([max(a) > min(b), max(c) > min(d)]) AS disjoint FROM g""")
def disjoint_ranges(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("len", F.length("n_name"))
    return tables.disjoint_ranges(n, "r_name", ["n_nationkey", "len"])


@query("SELECT p_brand, count(DISTINCT p_type) AS n_roles, min(p_type) AS a_role, max(p_type) AS b_role FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) > 1")
def role_conflict(spark, sf_dir):
    return tables.role_conflicts(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("""SELECT 'c' AS system, c_custkey AS "key", c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier""")
def union_by_name_pool(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("bal"))
    return tables.pool({"c": c, "s": s}).select("system", "key", "bal", "seg")


# lookups and features

GRID_SQL = "grid AS (SELECT i * 1.0 AS h, j * 2.0 AS r, i * i * 0.5 - j * 3.0 + i * j * 0.25 AS e FROM range(11) a(i), range(6) b(j))"


def _grid():
    return [float(i) for i in range(11)], [2.0 * j for j in range(6)], [i * i * 0.5 - j * 3.0 + i * j * 0.25 for i in range(11) for j in range(6)]


@query(f"""WITH {GRID_SQL}, p AS (SELECT l_orderkey, l_linenumber, greatest(least(l_quantity / 4, 10), 0) AS h, greatest(least(l_discount * 120, 10), 0) / 2 AS r FROM lineitem),
c AS (SELECT *, least(floor(h), 9) AS i, least(floor(r), 4) AS j FROM p)
SELECT l_orderkey, l_linenumber, a.e * (1 - (c.h - i)) * (1 - (c.r - j)) + b.e * (c.h - i) * (1 - (c.r - j)) + d.e * (1 - (c.h - i)) * (c.r - j) + f.e * (c.h - i) * (c.r - j) AS energy FROM c
JOIN grid a ON a.h = i AND a.r = 2 * j JOIN grid b ON b.h = i + 1 AND b.r = 2 * j JOIN grid d ON d.h = i AND d.r = 2 * j + 2 JOIN grid f ON f.h = i + 1 AND f.r = 2 * j + 2""")
def bilinear_lookup(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", lookup.bilinear(F.col("l_quantity") / 4, F.col("l_discount") * 120, _grid()).alias("energy"))


@query(f"""WITH {GRID_SQL}, p AS (SELECT DISTINCT l_quantity, l_discount FROM lineitem), h AS (SELECT l_quantity, arg_min(g.h, struct_pack(d := abs(g.h - l_quantity / 4), h := g.h)) AS h FROM (SELECT DISTINCT l_quantity FROM p), (SELECT DISTINCT h FROM grid) g GROUP BY l_quantity),
r AS (SELECT l_discount, arg_min(g.r, struct_pack(d := abs(g.r - l_discount * 120), r := g.r)) AS r FROM (SELECT DISTINCT l_discount FROM p), (SELECT DISTINCT r FROM grid) g GROUP BY l_discount)
SELECT p.l_quantity, p.l_discount, CAST(e AS DOUBLE) AS energy FROM p JOIN h ON h.l_quantity = p.l_quantity JOIN r ON r.l_discount = p.l_discount JOIN grid ON grid.h = h.h AND grid.r = r.r""")
def nearest_node(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount").distinct()
    return p.select("l_quantity", "l_discount", lookup.nearest_node(F.col("l_quantity") / 4, F.col("l_discount") * 120, _grid()).alias("energy"))


@query(f"""WITH {EV}, s AS (SELECT DISTINCT unit FROM ev), b AS (SELECT unit, CASE WHEN score BETWEEN 0 AND 100 THEN least(floor(score / 10), 9) END AS bin, count(*) AS n FROM ev GROUP BY ALL)
SELECT s.unit, CAST(g.bin AS BIGINT) AS bin, coalesce(b.n, 0) AS n FROM s CROSS JOIN (SELECT unnest(range(10)) AS bin) g LEFT JOIN b ON b.unit = s.unit AND b.bin = g.bin""")
def histogram_bins(spark, sf_dir):
    return features.histogram(observations(spark, sf_dir), U, "score", 0.0, 100.0, 10)


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY abs(score - 50), event_id) AS rn FROM ev) SELECT unit, event_id, score, abs(score - 50) AS distance FROM r WHERE rn = 1""")
def argmin_entity(spark, sf_dir):
    return features.innermost(observations(spark, sf_dir), U, "event_id", "score", 50.0)


@query(f"""WITH {EV}, s(site, z) AS (VALUES (0, 10.0), (1, 40.0), (2, 70.0)) SELECT unit, site, sum(exp(-((score - z) ** 2) / 200)) AS occupancy FROM ev, s GROUP BY unit, site""", occupancy=9)
def soft_occupancy(spark, sf_dir):
    sites = spark.createDataFrame([(0, 10.0), (1, 40.0), (2, 70.0)], "site int, z double")
    return features.soft_occupancy(observations(spark, sf_dir), sites, U, "score", 10.0)


@query(f"""WITH {EV}, s(site, z) AS (VALUES (0, 10.0), (1, 40.0), (2, 70.0)), o AS (SELECT unit, site, sum(exp(-((score - z) ** 2) / 200)) AS v FROM ev, s GROUP BY unit, site),
b AS (SELECT unit, coalesce(v > 0.5 AND lag(v) OVER (PARTITION BY unit ORDER BY site) > 0.5, false) AS both_ FROM o) SELECT unit, count(*) FILTER (both_) AS n_pairs FROM b GROUP BY unit""")
def adjacent_sites(spark, sf_dir):
    return features.adjacent_pairs(soft_occupancy(spark, sf_dir), U)


@query(f"""WITH {EV} SELECT a.event_id, sum(exp(-((a.score - b.score) ** 2) / 8) * b.k) / sum(exp(-((a.score - b.score) ** 2) / 8)) AS smoothed FROM ev a JOIN ev b ON a.unit = b.unit AND abs(a.score - b.score) <= 12 GROUP BY a.event_id""", smoothed=6)
def kernel_smooth(spark, sf_dir):
    return features.kernel_smooth(observations(spark, sf_dir).select("unit", "event_id", "score", "k"), U, "score", "k", 2.0).select("event_id", "smoothed")


@query(f"""WITH {EV}, g AS (SELECT unit, score, score - lag(score) OVER (PARTITION BY unit ORDER BY score) AS gap FROM ev) SELECT unit, count(*) AS n, CASE WHEN count(*) >= 2 THEN greatest(max(gap), min(score), 300 - max(score)) END AS max_gap FROM g GROUP BY unit""")
def max_gap_with_ends(spark, sf_dir):
    return features.max_gap(observations(spark, sf_dir), U, "score", 0.0, 300.0)


@query(f"""WITH {EV}, a AS (SELECT unit, event_id, score AS x, CAST(k AS DOUBLE) - 50 AS y, round(atan2(CAST(k AS DOUBLE) - 50, score), 12) AS ang FROM ev),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM a WINDOW w AS (PARTITION BY unit ORDER BY ang, event_id)),
d AS (SELECT unit, sqrt((nx - x) ** 2 + (ny - y) ** 2) AS d FROM n) SELECT unit, count(*) AS n, CASE WHEN count(*) >= 3 THEN stddev_pop(d) / nullif(avg(d), 0) END AS cv FROM d GROUP BY unit""", cv=9)
def circular_neighbour_cv(spark, sf_dir):
    d = observations(spark, sf_dir).select("unit", "event_id", F.col("score").alias("x"), (F.col("k").cast("double") - 50).alias("y"))
    return features.circular_neighbour_cv(d, U, "x", "y", "event_id")


@query(f"""WITH {EV}, s AS (SELECT unit, t AS z, score AS r FROM ev WHERE kind = 'view'), p AS (SELECT unit, event_id, t AS q FROM ev WHERE kind = 'error'),
b AS (SELECT p.event_id, p.q, arg_max(lo.r, lo.z) AS r0, max(lo.z) AS z0 FROM p LEFT JOIN s lo ON lo.unit = p.unit AND lo.z <= p.q GROUP BY p.event_id, p.q),
c AS (SELECT p.event_id, arg_min(hi.r, hi.z) AS r1, min(hi.z) AS z1 FROM p LEFT JOIN s hi ON hi.unit = p.unit AND hi.z >= p.q GROUP BY p.event_id)
SELECT b.event_id, r0 + coalesce((q - z0) / nullif(z1 - z0, 0), 0) * (r1 - r0) AS r_at FROM b JOIN c ON c.event_id = b.event_id""")
def lerp_at(spark, sf_dir):
    ev = observations(spark, sf_dir)
    s = ev.where("kind = 'view'").select("unit", F.col("t").cast("double").alias("z"), F.col("score").alias("r"))
    p = ev.where("kind = 'error'").select("unit", "event_id", F.col("t").cast("double").alias("at"))
    return features.interpolate_at(s, p, U).select("event_id", "r_at")


@query(f"WITH {EV} SELECT event_id, (score - 50) - 100 * CASE WHEN abs((score - 50) / 100 - trunc((score - 50) / 100)) = 0.5 THEN 2 * round((score - 50) / 200) ELSE round((score - 50) / 100) END AS d FROM ev")
def minimum_image_distance(spark, sf_dir):
    return observations(spark, sf_dir).select("event_id", minimum_image(F.col("score") - 50, F.lit(100.0)).alias("d"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS x, CAST(embedding[2] AS DOUBLE) * 4 AS y, CAST(embedding[3] AS DOUBLE) * 4 AS z, label FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, a.label, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS distance FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 0.2""")
def embedding_pairs_within(spark, sf_dir):
    e = F.col("embedding")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(e[i].cast("double") * 4).alias(c) for i, c in enumerate("xyz")])
    return spatial.pairs_within(v, v, ["label"], ["x", "y", "z"], 0.2, "vec_id").select("a", "b", "label", "distance")


# preprocessing, joins by name, explanation


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_tax END AS a, CAST(NULL AS DOUBLE) AS b FROM lineitem), m AS (SELECT median(a) AS ma FROM t)
SELECT l_orderkey, l_linenumber, coalesce(a, ma) AS a, 0.0::DOUBLE AS b, CAST(a IS NULL AS INT) AS a_missing, 1 AS b_missing FROM t, m""")
def impute_indicators(spark, sf_dir):
    from tidemark.operators import models

    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_tax")).alias("a"), F.lit(None).cast("double").alias("b"))
    return models.MissingEncoder(["a", "b"]).fit(t).transform(t)


@query(f"""WITH {EV}, m AS (SELECT kind, CAST(unit % 3 AS INT) AS arm, unit % 5 AS f, avg(score) AS s FROM ev GROUP BY ALL) SELECT kind, f, max(s) FILTER (arm = 0) AS arm_0, max(s) FILTER (arm = 1) AS arm_1, max(s) FILTER (arm = 2) AS arm_2 FROM m GROUP BY kind, f""", arm_0=9, arm_1=9, arm_2=9)
def oof_pivot(spark, sf_dir):
    d = observations(spark, sf_dir).withColumns({"arm": (F.col("unit") % 3).cast("int"), "f": F.col("unit") % 5})
    return d.groupBy("kind", "f").pivot("arm", [0, 1, 2]).agg(F.avg("score")).withColumnsRenamed({"0": "arm_0", "1": "arm_1", "2": "arm_2"})


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS q, l_discount * 100 - 5 AS d, l_tax * 100 - 4 AS x, 10 - l_linenumber * 4.0 AS n FROM lineitem),
p AS (SELECT *, greatest(-q, 0) + greatest(-d, 0) AS p1, greatest(-x, 0) AS p2, greatest(-n, 0) AS p3 FROM c),
a AS (SELECT *, CASE WHEN greatest(p1, p2, p3) <= 0.5 THEN 'unclear' WHEN p1 >= p2 AND p1 >= p3 THEN 'size' WHEN p2 >= p3 THEN 'tax' ELSE 'line' END AS axis FROM p)
SELECT l_orderkey, l_linenumber, axis, CASE axis WHEN 'size' THEN CASE WHEN q <= d THEN 'q' ELSE 'd' END WHEN 'tax' THEN 'x' WHEN 'line' THEN 'n' END AS driver FROM a""")
def axis_argmax_reason(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("q"), (F.col("l_discount") * 100 - 5).alias("d"), (F.col("l_tax") * 100 - 4).alias("x"), (10 - F.col("l_linenumber") * 4.0).alias("n"))
    return explain.axis_push(c, {"size": ["q", "d"], "tax": ["x"], "line": ["n"]}, 0.5).select("l_orderkey", "l_linenumber", "axis", "driver")


@query(f"""WITH {EV}, r AS (SELECT DISTINCT unit, (SELECT min(t) FROM ev) + (unit % 29) * {DAY} AS q FROM ev), n AS (SELECT r.unit, r.q, ev.t, ev.event_id, row_number() OVER (PARTITION BY r.unit ORDER BY abs(ev.t - r.q), ev.t) AS rn FROM r JOIN ev ON ev.unit = r.unit)
SELECT unit, event_id, t - q AS "off" FROM n WHERE rn = 1""")
def point_query(spark, sf_dir):
    ev = observations(spark, sf_dir)
    first = ev.agg(F.min("t")).first()[0] or 0
    r = ev.select("unit").distinct().withColumn("at", F.lit(first) + (F.col("unit") % 29) * DAY)
    return explain.point_query(ev, r, U).select("unit", "event_id", F.col("offset").alias("off"))


@query(f"""WITH {EV} SELECT unit, median(score) AS median, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3, max(score) AS top, count(*) FILTER (score >= 60) AS n_ready, avg(CAST(score >= 60 AS INT)) AS ready_frac FROM ev GROUP BY unit""", q1=6, q3=6, median=6)
def stretch_summary(spark, sf_dir):
    return explain.stretch_summary(observations(spark, sf_dir), U, "score", F.lit(60.0))


@query(f"""WITH {EV} SELECT event_id, CASE WHEN k % 10 = 0 THEN 'N/A' WHEN score >= 60 THEN 'READY' ELSE 'NOT_READY' END AS verdict FROM ev""")
def verdicts(spark, sf_dir):
    ev = observations(spark, sf_dir)
    return ev.select("event_id", explain.verdict(F.when(F.col("k") % 10 != 0, F.col("score")), F.lit(60.0)).alias("verdict"))


@query("WITH s AS (SELECT n_nationkey, sha256(concat_ws('|', 'seed', n_name)) AS h FROM nation) SELECT n_nationkey, CAST(concat('0x', h[7:8], h[5:6], h[3:4], h[1:2]) AS BIGINT) AS seed FROM s")
def derived_seeds(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", derived_seed("seed", F.col("n_name")).alias("seed"))


@query(f"""WITH {EV}, m AS (SELECT kind, round(avg(score), 6) AS mean, count(*) AS n FROM ev GROUP BY kind) SELECT kind, mean, n FROM m ORDER BY n DESC""")
def group_report(spark, sf_dir):
    d = observations(spark, sf_dir).groupBy("kind").agg(F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("n"))
    return d.select("kind", "mean", "n")


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY unit, kind ORDER BY t, event_id) AS rn FROM ev) SELECT unit, kind, event_id FROM r WHERE rn = 1""")
def first_per_key(spark, sf_dir):
    w = Window.partitionBy("unit", "kind").orderBy("t", "event_id")
    return observations(spark, sf_dir).withColumn("_r", F.row_number().over(w)).where("_r = 1").select("unit", "kind", "event_id")


# further reports


@query(f"""WITH {NEXT}, s AS (SELECT unit, t AS t_entry, (SELECT min(p.t) FROM ev p WHERE p.unit = s.unit AND p.kind = 'purchase' AND p.t > s.t) AS t_exit FROM ev s WHERE kind = 'signup'),
v AS (SELECT l.y, l.score, EXISTS (SELECT 1 FROM s WHERE s.unit = l.unit AND s.t_entry <= l.t AND l.t <= s.t_exit) AS state FROM lab l WHERE l.valid), {AP.format(by='state', src='v')} SELECT state, n_rows, n_positive, base_rate, ap, ap / base_rate AS ratio FROM ap""", ap=9, ratio=9)
def ap_by_state(spark, sf_dir):
    d = labelled(spark, sf_dir).where("valid")
    state = in_interval(spark, sf_dir).select("event_id", F.col("in_interval").alias("state"))
    return metrics.average_precision(d.join(state, "event_id"), ["state"])


@query(f"WITH {NEXT}, v AS (SELECT * FROM lab WHERE valid), {AP.format(by='unit', src='v')} SELECT count(*) AS n_units, count(ap) AS n_defined, median(ap / base_rate) AS median_ratio FROM ap", median_ratio=9)
def unit_ap_median(spark, sf_dir):
    per = metrics.average_precision(labelled(spark, sf_dir).where("valid"), U)
    return per.agg(F.count("*").alias("n_units"), F.count("ap").alias("n_defined"), F.median("ratio").alias("median_ratio"))


@query(f"""WITH {EV}, c AS (SELECT event_id, score - 50 AS a, k - 50.0 AS b, score * 0.1 - 4 AS d FROM ev), x AS (SELECT event_id, unnest(['one', 'two', 'three']) AS axis, unnest([a, b, d]) AS value, abs(a) + abs(b) + abs(d) AS w FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY -abs(value), axis) - 1 AS rank FROM x) SELECT event_id, CAST(rank AS INT) AS rank, axis, value, abs(value) / nullif(w, 0) AS share FROM r WHERE rank < 2""", share=9)
def top_axes(spark, sf_dir):
    c = observations(spark, sf_dir).select("event_id", (F.col("score") - 50).alias("a"), (F.col("k") - 50.0).alias("b"), (F.col("score") * 0.1 - 4).alias("d"))
    return explain.top_axes(c, {"one": ["a"], "two": ["b"], "three": ["d"]}, 2, ["event_id"])


@query("""WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS x, CAST(embedding[2] AS DOUBLE) * 4 AS y, label FROM embeddings)
SELECT a.label, a.vec_id, count(b.vec_id) AS n_near FROM v a LEFT JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1 GROUP BY a.label, a.vec_id""")
def coordination_counts(spark, sf_dir):
    e = F.col("embedding")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(e[i].cast("double") * 4).alias(c) for i, c in enumerate("xy")])
    return spatial.coordination(v, v, ["label"], ["x", "y"], 0.1, "vec_id")


@query("""WITH v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS x, CAST(embedding[2] AS DOUBLE) * 4 AS y, label, vec_id % 3 AS kind, CAST(vec_id % 5 AS DOUBLE) - 2 AS q FROM embeddings)
SELECT a.label, a.vec_id, b.kind, sum(b.q / greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-6)) AS potential FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1 GROUP BY a.label, a.vec_id, b.kind""", potential=6)
def potential_by_kind(spark, sf_dir):
    e = F.col("embedding")
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(e[i].cast("double") * 4).alias(c) for i, c in enumerate("xy")], (F.col("vec_id") % 3).alias("kind"), ((F.col("vec_id") % 5).cast("double") - 2).alias("q"))
    return spatial.charge_over_distance(v, v, ["label"], ["x", "y"], 0.1, "vec_id", "q", "kind")


@query(f"""WITH {LADDER}, o AS (SELECT unit, t_entry AS at FROM found WHERE entrance_observed)
SELECT event_id, CAST(EXISTS (SELECT 1 FROM o WHERE o.unit = e.unit AND o.at > e.t AND o.at <= e.t + {DAY}) AS INT) AS y FROM ev e""")
def label_entry_anchor(spark, sf_dir):
    found = events.ladder_events(ladder(spark, sf_dir), U, wrap="wrap").where("entrance_observed")
    return labels.forward_labels(observations(spark, sf_dir), found.select("unit", F.col("t_entry").alias("at")), [DAY], U).select("event_id", "y")


@query(f"""WITH {NEXT}, f AS (SELECT kind, y, CAST(score >= 40 AS DOUBLE) AS f FROM lab WHERE valid), r AS (SELECT kind, avg(f) FILTER (y = 1) AS a, avg(f) FILTER (y = 0) AS b, avg(f) AS c FROM f GROUP BY kind)
SELECT kind, a AS rate_positive, b AS rate_negative, c AS rate, (b / nullif(1 - b, 0)) / nullif(a / nullif(1 - a, 0), 0) AS odds_ratio, c > 0.95 AS near_universal FROM r""", odds_ratio=9)
def axis_specificity(spark, sf_dir):
    d = labelled(spark, sf_dir).where("valid").withColumn("fired", F.col("score") >= 40)
    return explain.axis_specificity(d, "fired", "y", ["kind"])


@query(f"""WITH {EV} SELECT 'a' AS "column", 'one' AS block, avg(abs(score - 50)) AS importance FROM ev UNION ALL SELECT 'b', 'two', avg(abs(k - 50.0)) FROM ev""", importance=6)
def global_importance(spark, sf_dir):
    c = observations(spark, sf_dir).select((F.col("score") - 50).alias("a"), (F.col("k") - 50.0).alias("b"))
    return explain.global_importance(c, ["a", "b"], {"a": "one", "b": "two"})


@query(f"""WITH {EV}, s AS (SELECT unit, score AS z, CASE WHEN k >= 20 THEN CAST(k + 0.5 AS DOUBLE) END AS r FROM ev), m AS (SELECT unit, min(r) AS r0, count(r) AS n, avg(CAST(r IS NOT NULL AS INT)) AS f FROM s GROUP BY unit)
SELECT m.unit, r0 AS r_constriction, (SELECT min(z) FROM s WHERE s.unit = m.unit AND s.r = m.r0) AS z_constriction, n AS n_search, f AS search_frac FROM m""")
def constriction(spark, sf_dir):
    s = observations(spark, sf_dir).select("unit", F.col("score").alias("z"), F.when(F.col("k") >= 20, F.col("k") + 0.5).alias("r"))
    return features.constriction(s, U)


# models: no SQL; tests hold them against independent computations


@query()
def ridge_scores(spark, sf_dir):
    """Probability of quality from length and source, calibrated on its own pooled scores."""
    from tidemark.operators import models

    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    d = d.select("doc_id", F.col("quality").alias("y"), F.log1p("n_chars").alias("length"), *[(F.col("lang") == x).cast("double").alias(x) for x in ("en", "fr")])
    d = models.Standardiser(["length", "en", "fr"]).fit(d).transform(d)
    m = models.RidgeLogistic(["length", "en", "fr"]).fit(d)
    return m.contributions(m.predict(d)).select("doc_id", "y", F.round("prob", 6).alias("prob"))


@query()
def least_squares_scores(spark, sf_dir):
    from tidemark.operators import models

    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").cast("double").alias("y"))
    return models.PartialLeastSquares(3).fit(e).predict(e).select("vec_id", F.round("score", 6).alias("score"))


@query()
def boosted_scores(spark, sf_dir):
    from tidemark.operators.boosting import BoostedTrees

    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "days"]
    days = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", "l_extendedprice", "l_discount", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("l_tax"), days.cast("double").alias("days"))
    m = BoostedTrees(columns).fit(t)
    return m.predict(t).select("l_orderkey", "l_linenumber", F.round("prob", 6).alias("prob"))


@query()
def superposed_points(spark, sf_dir):
    """Each vector as points of three numbers (zeros after the last number, where it does not fill a point), turned onto those of the smallest vec_id."""
    from tidemark.operators import kernels

    filled = F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.pmod(-F.size("embedding"), F.lit(3))))
    e = table(spark, sf_dir, "embeddings").select("vec_id", filled.alias("xyz"))
    first = e.agg(F.min_by("xyz", "vec_id")).first()[0]
    return kernels.superpose(e, first, ["vec_id"]) if first else e
