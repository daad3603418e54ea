"""Temporal operators against hand-made series and row-at-a-time versions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.keys import join_one_to_one, minimum_image, nan_to_null, refuse_infinite
from tidemark.operators import alarms, events, features, intervals, labels, metrics, splits, windows

U = ["unit"]


def ladder_frame(spark, series, r=1.0, box=None):
    rows = [("u", 1, 10 * i, float(z), float(r), box) for i, z in enumerate(series)]
    d = spark.createDataFrame(rows, "unit string, entity int, t long, z double, r double, box double")
    d = d.withColumn("zone", events.zone(F.col("z"), F.col("r"), -20.0, 20.0, -10.0, 10.0, 8.0))
    jump = F.abs(F.col("z") - F.lag("z").over(windows.ordered(["unit", "entity"]))) > F.col("box") / 2
    return d.withColumn("wrap", F.coalesce(jump, F.lit(False)))


@pytest.mark.parametrize(("series", "r", "box", "want"), [
    ([-25, -15, 0, 15, 25], 1, None, [(1, 40, True)]),
    ([-25, -15, 0, -15, -25], 1, None, []),
    ([-25, -15, 0, 15, 25], 9.5, None, []),
    ([0, 15, 25], 1, None, []),
    ([25, 15, 0, -15, -25], 1, None, [(-1, 40, True)]),
    ([25, 28, -28, -25], 1, 60.0, []),
    ([25, 28, -28, -25], 1, None, []),
    ([-25, -22, 22, 25], 1, None, []),
])
def test_ladder(spark, series, r, box, want):
    d = ladder_frame(spark, series, r, box)
    got = events.ladder_events(d, ["unit", "entity"], wrap="wrap").collect()
    assert [(e.direction, e.t_exit, e.entrance_observed) for e in got] == want
    assert events.left_censored(d, ["unit", "entity"]).first().left_censored == (series[0] == 0)


def machine(zones):
    """The state machine that the window form stands for."""
    out, origin, entry = [], None, None
    prev = None
    for t, z in enumerate(zones):
        if prev is None:
            origin = z if z in (0, 4) else None
        elif z != prev:
            if z == 2:
                entry = (t, prev in (1, 3))
            elif z in (0, 4):
                if origin == 4 - z and entry:
                    out.append((entry[0], t, entry[1], 1 if z == 4 else -1))
                origin, entry = z, None
            elif z == -9:
                origin, entry = None, None
        prev = z
    return out


def test_ladder_on_random_walks(spark):
    rng = random.Random(7)
    rows, want = [], []
    for e in range(60):
        z, zones = rng.randrange(5), []
        for _ in range(200):
            zones.append(-9 if rng.random() < 0.02 else z)
            z = max(0, min(4, z + rng.choice([-1, 0, 1, 1, -1])))
        rows += [("u", e, t, x) for t, x in enumerate(zones)]
        want += [(e, *x) for x in machine(zones)]
    d = spark.createDataFrame(rows, "unit string, entity int, t long, zone int")
    got = events.ladder_events(d, ["unit", "entity"]).collect()
    assert want and sorted((e.entity, e.t_entry, e.t_exit, e.entrance_observed, e.direction) for e in got) == sorted(want)


@pytest.mark.parametrize(("times", "exits", "last", "y", "valid"), [
    ([0, 10, 20, 30], [25], 1000, [0, 1, 1, 0], None),
    ([0, 50, 90], [], 100, [0, 0, 0], [True, True, False]),
    ([90], [95], 100, [1], [True]),
])
def test_labels(spark, times, exits, last, y, valid):
    frames = spark.createDataFrame([("u", t) for t in [*times, last]], "unit string, t long")
    ev = spark.createDataFrame([("u", t) for t in exits], "unit string, at long")
    got = {r.t: r for r in labels.forward_labels(frames, ev, [20], U).collect()}
    assert [got[t].y for t in times] == y
    if valid:
        assert [got[t].valid for t in times] == valid


def test_labels_are_monotone_and_shift_with_time(spark):
    rng = random.Random(1)
    f = [(f"u{u}", t) for u in range(5) for t in sorted(rng.sample(range(1000), 80))]
    e = [(f"u{u}", t) for u in range(5) for t in sorted(rng.sample(range(1000), 6))]
    frames, ev = spark.createDataFrame(f, "unit string, t long"), spark.createDataFrame(e, "unit string, at long")
    got = labels.forward_labels(frames, ev, [20, 50, 200], U).collect()
    by = {(r.unit, r.t, r.tau): (r.y, r.valid) for r in got}
    for u, t in f:
        assert by[u, t, 20][0] <= by[u, t, 50][0] <= by[u, t, 200][0]
        for tau in (20, 50, 200):
            y, valid = by[u, t, tau]
            assert y == any(u == v and t < x <= t + tau for v, x in e) and (valid or not y)
    moved = labels.forward_labels(frames.withColumn("t", F.col("t") + 7), ev.withColumn("at", F.col("at") + 7), [50], U).collect()
    assert {(r.unit, r.t - 7): r.y for r in moved} == {k[:2]: v[0] for k, v in by.items() if k[2] == 50}


def test_relabel(spark):
    ev = spark.createDataFrame([("u", 15)], "unit string, at long")
    table = lambda ys: spark.createDataFrame([("u", 10 * i, y) for i, y in enumerate(ys)], "unit string, t long, y int")
    assert [r.y for r in labels.relabel(table([1, 1, 1]), ev, 20, U, "y").orderBy("t").collect()] == [1, 1, 1]
    assert [r.y for r in labels.relabel(table([1, None, 0]), ev, 20, U, "y").orderBy("t").collect()] == [1, 1, 0]
    with pytest.raises(ValueError, match="binary"):
        labels.relabel(table([2, 0, 1]), ev, 20, U, "y")


def test_time_joins_equal_brute_force(spark):
    rng = random.Random(2)
    f = [("a", t) for t in range(0, 300, 7)] + [("b", t) for t in range(0, 100, 9)]
    e = [("a", rng.randrange(300)) for _ in range(12)] + [("c", 5)]
    frames, ev = spark.createDataFrame(f, "unit string, t long"), spark.createDataFrame(e, "unit string, at long")
    at = lambda u: [x for v, x in e if v == u]
    got = intervals.with_nearest(intervals.with_count(intervals.with_last(intervals.with_next(frames, ev, U), ev, U), ev, U), ev, U).collect()
    assert len(got) == len(f)
    for r in got:
        assert r.next_event == min((x for x in at(r.unit) if x > r.t), default=None)
        assert r.last_event == max((x for x in at(r.unit) if x <= r.t), default=None)
        assert r.events_so_far == sum(x <= r.t for x in at(r.unit))
        assert r.nearest_event == min(at(r.unit), key=lambda x: (abs(x - r.t), x), default=None)
    ranges = spark.createDataFrame([("a", 10, 40, 1), ("a", 35, 36, 2), ("b", 90, 200, 3)], "unit string, lo long, hi long, k int")
    for how in ("left_semi", "left_anti"):
        inside = {(r.unit, r.t) for r in intervals.points_in_ranges(frames, ranges, U, "t", "lo", "hi", 16, how).collect()}
        want = {(u, t) for u, t in f if any(u == v and lo <= t <= hi for v, lo, hi, _ in [("a", 10, 40, 1), ("a", 35, 36, 2), ("b", 90, 200, 3)]) == (how == "left_semi")}
        assert inside == want


def test_windows(spark):
    y = [0, 1, 1, 0, 1, 1, 1, 0]
    d = spark.createDataFrame([("u", t, v) for t, v in enumerate(y)], "unit string, t long, y int")
    assert windows.run_counts(d, "y", U).first().runs == 2
    two = spark.createDataFrame([("a", t, v) for t, v in enumerate([0, 0, 1, 1])] + [("b", t, v) for t, v in enumerate([1, 1, 0, 0])], "unit string, t long, y int")
    assert sum(r.runs for r in windows.run_counts(two, "y", U).collect()) == 2
    assert [r.age for r in windows.state_age(d, "y", U).orderBy("t").collect()] == [0, 0, 1, 0, 0, 1, 2, 0]
    assert [r.island for r in windows.with_islands(d, "y", U).orderBy("t").collect()] == [0, 1, 1, 2, 3, 3, 3, 4]
    p = spark.createDataFrame([("u", t, v) for t, v in enumerate([None, 0.9, None, 0.5, 0.1, 0.5, 0.95])], "unit string, t long, p double")
    assert [r.armed for r in windows.latch(p, "p", 0.8, 0.2, U).orderBy("t").collect()] == [False, True, True, True, False, False, True]
    w = windows.trailing(U, 25)
    frame = spark.createDataFrame([("u", t) for t in range(0, 100, 10)], "unit string, t long")
    assert all(r.lo >= r.t - 25 and r.hi <= r.t for r in frame.select("t", F.min("t").over(w).alias("lo"), F.max("t").over(w).alias("hi")).collect())
    assert windows.rows_per_window(frame, U, 25) == 2


def test_alarm_equals_row_loop(spark):
    rng = random.Random(4)
    rows, ev = [], []
    for u in range(12):
        rows += [(f"u{u}", t, rng.random() < 0.4) for t in range(0, 400, 10)]
        ev += [(f"u{u}", i, rng.randrange(400)) for i in range(rng.randrange(5))]
    d = spark.createDataFrame(rows, "unit string, t long, armed boolean")
    e = spark.createDataFrame(ev, "unit string, k int, at long")
    got = {r.unit: r for r in alarms.alarm_metrics(d, e, 50, U, "k").collect()}
    for u in {r[0] for r in rows}:
        series = [(t, a) for v, t, a in rows if v == u]
        eps, cur = [], None
        for t, a in series:
            if a and cur is None:
                cur = [t, t]
                eps.append(cur)
            elif a:
                cur[1] = t
            else:
                cur = None
        mine = [x for v, _, x in ev if v == u]
        leads = []
        for x in mine:
            first = next((t for t, a in series if a and x - 50 <= t < x), None)
            if first is not None:
                leads.append(x - next(a for a, z in eps if a <= first <= z))
        r = got[u]
        assert (r.n_events, r.n_episodes) == (len(mine), len(eps))
        assert r.n_empty == sum(not any(a <= x <= z + 50 for x in mine) for a, z in eps)
        assert r.warned is None if not mine else abs(r.warned - len(leads) / len(mine)) < 1e-12
        assert (r.lead_median is None) == (not leads)


def test_leave_one_out_quantile(spark):
    import numpy as np

    rng = random.Random(9)
    rows = [(u, round(rng.gauss(0, 1), 1)) for u in range(6) for _ in range(rng.randrange(1, 60))] + [(7, None)]
    d = spark.createDataFrame(rows, "unit int, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r.unit: r.threshold for r in alarms.leave_one_out_quantile(d, "unit", "v", q).collect()}
        for u in range(6):
            assert abs(got[u] - np.quantile([v for w, v in rows if w != u and v is not None], q)) < 1e-9


def test_leave_one_out_quantile_pairs_no_units(spark):
    """Units whose values lie alike must not each look at the same slice of the pool."""
    import numpy as np

    rng = random.Random(4)
    rows = [(u, round(rng.expovariate(1), 2)) for u in range(40) for _ in range(25)] + [(None, 50.0)] * 30
    d = spark.createDataFrame(rows, "unit int, v double")
    out = alarms.leave_one_out_quantile(d, "unit", "v", 0.95)
    assert "explode(sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.unit: r.threshold for r in out.collect()}
    assert got.keys() == set(range(40))
    for u in range(40):
        assert abs(got[u] - np.quantile([v for w, v in rows if w is not None and w != u], 0.95)) < 1e-9


def ap_by_hand(y, s):
    total, tp, n, out = sum(y), 0, 0, 0.0
    for v in sorted(set(s), reverse=True):
        here = [a for a, b in zip(y, s) if b == v]
        tp, n = tp + sum(here), n + len(here)
        out += sum(here) / total * tp / n
    return out


def test_metrics(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(8) / 8, int(rng.random() < 0.3)) for g in "ab" for _ in range(200)] + [("c", 0.5, 0)]
    d = spark.createDataFrame(rows, "g string, score double, y int")
    ap = {r.g: r for r in metrics.average_precision(d, ["g"]).collect()}
    auc = {r.g: r.auc for r in metrics.roc_auc(d, ["g"]).collect()}
    for g in "ab":
        y, s = [r[2] for r in rows if r[0] == g], [r[1] for r in rows if r[0] == g]
        assert abs(ap[g].ap - ap_by_hand(y, s)) < 1e-12
        wins = sum((a > b) + (a == b) / 2 for a, u in zip(s, y) if u for b, v in zip(s, y) if not v)
        assert abs(auc[g] - wins / (sum(y) * (len(y) - sum(y)))) < 1e-12
    assert ap["c"].ap is None and auc["c"] is None
    w = metrics.bootstrap_weights(d.select("g"), 30)
    total = w.groupBy("boot").agg(F.sum("w").alias("n")).collect()
    assert len(total) == 30 and all(r.n == 3 for r in total)
    boots = metrics.weighted_ap(d, w, ["g"])
    draw = {r.g: r.w for r in w.where("boot = 4").collect()}
    big = [(r[1], r[2]) for r in rows for _ in range(draw.get(r[0], 0))]
    got = boots.where("boot = 4").first().ap
    y = [b for _, b in big]
    assert got is None if sum(y) in (0, len(y)) else abs(got - ap_by_hand(y, [a for a, _ in big])) < 1e-12
    assert metrics.bootstrap_interval(boots).first().used <= 30
    import pandas as pd

    ranks = metrics.percentile_rank(d.withColumn("i", F.monotonically_increasing_id()), ["g"], "score").toPandas()
    assert (abs(ranks.pct_rank - ranks.groupby("g").score.rank(pct=True)) < 1e-12).all() and isinstance(ranks, pd.DataFrame)


def test_splits(spark):
    d = spark.createDataFrame([(g, i) for i, g in enumerate("aabbc")], "g string, t long")
    for g in "abc":
        train, test = splits.fold(d, "g", g)
        assert {r.g for r in test.collect()} == {g} and splits.overlap(train, test, ["g"]) == 0
    with pytest.raises(ValueError, match="leakage"):
        splits.refuse_overlap(d.where("t in (0, 2)"), d.where("t = 1"), ["g"])
    times = spark.createDataFrame([(t,) for t in range(0, 1000, 10)], "t long")
    rows = splits.time_blocks(times, 4, 50).collect()
    for b in range(4):
        test = [r.t for r in rows if r.block == b and r.role == "test"]
        assert test and all(t < min(test) - 40 or t > max(test) + 40 for t in (r.t for r in rows if r.block == b and r.role == "train"))
    y = spark.createDataFrame([("u", i, int(i < 10)) for i in range(1000)], "unit string, t long, y int")
    assert abs(splits.leaf_bound(y, "y", U, 2) - 2 * 10 * 0.0099) < 1e-12


def test_keys(spark):
    d = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, v double")
    assert nan_to_null(d).where("v is null").count() == 1
    with pytest.raises(Exception, match="infinite"):
        refuse_infinite(spark.createDataFrame([(float("inf"),)], "v double"), "v").collect()
    with pytest.raises(Exception, match="one-to-one"):
        join_one_to_one(d.union(d), d, ["k"]).collect()
    got = spark.createDataFrame([(5.0,), (-35.0,), (39.0,)], "z double").select(minimum_image(F.col("z") - 5, F.lit(90.0)).alias("d")).collect()
    assert [r.d for r in got] == [0.0, -40.0, 34.0]


def test_features(spark):
    d = spark.createDataFrame([("f", 1, 2.0), ("f", 2, 8.0), ("f", 3, 10.0), ("g", 4, 5.0)], "frame string, e int, z double")
    gap = {r.frame: r.max_gap for r in features.max_gap(d, ["frame"], "z", 0.0, 20.0).collect()}
    assert gap == {"f": 10.0, "g": None}
    h = {(r.frame, r.bin): r.n for r in features.histogram(d, ["frame"], "z", 0.0, 10.0, 5).collect()}
    assert h["f", 4] == 2 and h["f", 1] == 1 and h["f", 0] == 0 and len(h) == 10
    assert {r.frame: r.e for r in features.innermost(d, ["frame"], "e", "z", 9.0).collect()} == {"f": 2, "g": 4}
    flip = features.sign_flip(spark.createDataFrame([(-1, 1.0, 2.0)], "d int, a double, b double"), F.col("d"), ["a"]).first()
    assert (flip.a, flip.b) == (-1.0, 2.0)
    s = features.constriction(spark.createDataFrame([("f", 0.0, None), ("f", 1.0, 3.0), ("f", 2.0, 2.0), ("f", 3.0, 2.0)], "frame string, z double, r double"), ["frame"]).first()
    assert (s.r_constriction, s.z_constriction, s.n_search) == (2.0, 2.0, 3)


def test_frame_chemistry(spark):
    from tidemark.operators import tables

    res = spark.createDataFrame([("f", "A", 1.0), ("f", "B", 2.0), ("f", "X", 2.0), ("f", "A", 9.0)], "frame string, resname string, z double")
    scale = spark.createDataFrame([("A", 1.0), ("B", 3.0)], "resname string, h double")
    r = features.lining(res, scale, ["frame"], 0.0, 5.0).first()
    assert (r.lining_mean, r.lining_n) == (2.0, 2)
    s = spark.createDataFrame([("f", float(z), 2.0) for z in range(4)], "frame string, z double, r double")
    d = features.column_density(s, spark.createDataFrame([("f", 8)], "frame string, n int"), ["frame"]).first().density
    assert abs(d - 8 / (4 * 3.141592653589793 * 4)) < 1e-12
    water = [("f", 1, "O", 0.0, 0.0, 0.0), ("f", 1, "H", 1.0, 0.0, 1.0), ("f", 1, "H", -1.0, 0.0, 1.0)]
    schema = "frame string, resid int, element string, x double, y double, z double"
    assert features.pair_solvent(spark.createDataFrame(water, schema), ["frame"]).first().cosine == 1.0
    with pytest.raises(Exception, match="two H"):
        features.pair_solvent(spark.createDataFrame(water[:2], schema), ["frame"]).collect()
    two = spark.createDataFrame([("f", 1, 1.0), ("f", 1, 2.0), ("f", 2, 9.0), ("f", 2, 10.0)], "frame string, g int, z double")
    got = features.image_aligned(two, ["frame"], "g", ["z"], {"z": F.lit(10.0)}).where("g = 2").orderBy("z").collect()
    assert [x.z for x in got] == [-1.0, 0.0]
    m = features.mouth_counts(spark.createDataFrame([("f", 11.0), ("f", -12.0), ("f", 0.0)], "frame string, z double"), ["frame"], "z", -10.0, 10.0, 5.0, F.lit(1)).first()
    assert (m.n_upper, m.n_lower, m.n_entry) == (1, 1, 1)
    t = spark.createDataFrame([("s", "c1"), ("s", "c2"), ("w", "c9")], "system string, condition string")
    p = spark.createDataFrame([("s", "c1"), ("w", "*")], "system string, condition string")
    assert {(x.system, x.condition) for x in tables.in_pool(t, p).collect()} == {("s", "c1"), ("w", "c9")}
    with pytest.raises(Exception, match="no d for"):
        tables.lookup_all(t, spark.createDataFrame([("s", 1)], "system string, d int"), ["system"], "d").collect()
    a = spark.createDataFrame([([1.0, None, 2.0],), ([1.0, 2.0, float("nan")],)], "v array<double>")
    assert tables.complete_arrays(a, "v") == ([0], 2)
