"""Many models in shared passes against each model alone, numpy, and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiment, together
from tidemark.operators.boosting import BoostedTrees
from tidemark.operators.together import HELD, TRAIN, Boosters, Designs, Ridge, Slot, Spec

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        unit, t = i % 6, i // 6
        a, b, c = rng.normal(size=3)
        p = 1 / (1 + math.exp(-(1.6 * a - b - 0.4)))
        y = int(rng.random() < p)
        rows.append((i, unit, unit % 3, t, float(a), float(b) if i % 9 else None, float(c), y, int(rng.random() < p / 2), i % 10 != 0))
    return spark.createDataFrame(rows, "i int, unit int, fold int, t int, a double, b double, c double, y int, y2 int, valid boolean").repartition(3).persist()


LABELS = {"y": "valid", "y2": "valid"}


def _trees(nodes):
    return [(n.feature, n.cut, n.missing_left, n.value, n.cover, _trees(n.children)) for n in nodes]


def test_models_grown_together_are_those_grown_alone(table):
    slots = [Slot(f, "r", y, F.col("valid") & (F.col("fold") != f), F.col("valid") & (F.col("fold") == f)) for f in range(3) for y in ("y", "y2")]
    trains = [F.col("valid") & (F.col("fold") != f) for f in range(3)]
    make = lambda: [Spec(i, depth=d, least=0.5, rounds=6, patience=p, rate=0.3, colsample=c, subsample=s, seed=7 * i + d, base=-0.3) for i in range(6) for d, p, c, s in ((1, None, 1.0, 1.0), (3, 2, 0.67, 0.8))]
    many, alone = make(), make()
    engine = Boosters(table, COLS, slots, [0, 1, 2], trains, ["i"])
    state = engine.grow(many)
    margins = {r.i: r._margin for r in state.select("i", "_margin").collect()}
    for k in (0, 3, 6, 11):
        other = Boosters(table.repartition(5), COLS, slots, [0, 1, 2], trains, ["i"])
        one = {r.i: r._margin[0] for r in other.grow([alone[k]]).select("i", "_margin").collect()}
        assert _trees(alone[k].trees) == _trees(many[k].trees) and alone[k].losses == many[k].losses
        assert all(math.isclose(one[i], m[k]) for i, m in margins.items())
        other.free()
    assert all(len(s.trees) == 6 or len(s.losses) == s.best_round + s.patience for s in many)
    engine.free()


def test_copies_of_rows_cost_and_change_nothing(table):
    copies = table.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    slot = Slot(0, "r", "y", F.col("valid") & (F.col("fold") != 1), F.col("valid") & (F.col("fold") == 1))
    grown, read = [], []
    for d, times, keys in ((table, 1, ["i"]), (copies, 3, ["i", "copy"])):
        spec = Spec(0, depth=3, least=0.5 * times, rounds=5, rate=0.3, penalty=float(times))
        engine = Boosters(d, COLS, [slot], [0], [F.col("valid")], keys)
        out = engine.grow([spec])
        read.append(sum(r._n for r in engine._pack(False)[0].select("_n").collect()))
        margins = {r.i: r._margin[0] for r in out.collect()}
        grown.append((spec, margins, out.count()))
        engine.free()
    (one, a, n), (three, b, m) = grown
    assert read[0] == read[1] < table.count() and m == 3 * n == 3 * table.count()
    flat = lambda t: [(t.feature, t.cut, t.missing_left), *(x for c in t.children for x in flat(c))]
    assert [flat(t) for t in one.trees] == [flat(t) for t in three.trees] and np.allclose(one.losses, three.losses, rtol=1e-12)
    assert a.keys() == b.keys() and all(math.isclose(a[i], b[i], rel_tol=1e-9, abs_tol=1e-9) for i in a)


def test_margins_and_losses_are_those_of_the_trees(table):
    d = table.where("valid")
    train, watch = d.where("fold <> 1"), d.where("fold = 1")
    m = BoostedTrees(COLS, rounds=12, depth=2, rate=0.3, patience=3, bins=8).fit(train, "y", watch=watch)
    rows = m.predict(watch).select("y", "prob").collect()
    loss = -sum(math.log(r.prob if r.y else 1 - r.prob) for r in rows) / len(rows)
    assert math.isclose(loss, min(m.losses), rel_tol=1e-6) and len(m.trees) == m.losses.index(min(m.losses)) + 1


def test_tuning_chooses_what_single_fits_choose(table):
    d, starts = experiment.mark_starts(table, LABELS, ["unit"])
    plan = experiment.fold_plan(d, "fold", LABELS, inner="unit")
    assert len(plan) == 6 and all(len(e["rotations"]) == 4 and not e["blocked"] for e in plan.values())
    grid = [{"depth": 1, "k_events": 0.5}, {"depth": 3, "k_events": 1.0}]
    margins, oof, record, models = together.tune_trees(d, COLS, plan, grid, ["i", "fold"], starts, rate=0.3, rounds=8, patience=2, bins=8)
    at = (1, "y")
    entry = next(r for r in record if (r["fold"], r["label"]) == at)
    p = d.where("valid and fold <> 1").toPandas()
    edges, spec = models[at]
    found = []
    for point in grid:
        best, losses = [], []
        for g in sorted(p.unit.unique()):
            tr = p[p.unit != g]
            share = tr.y.mean()
            least = point["k_events"] * tr.y.sum() / tr._start_y.sum() * share * (1 - share)
            s = Slot(1, "x", "y", F.col("valid") & (F.col("fold") != 1) & (F.col("unit") != int(g)), F.col("valid") & (F.col("fold") != 1) & (F.col("unit") == int(g)))
            one = Spec(0, depth=point["depth"], least=float(least), rounds=8, patience=2, rate=0.3, base=together.logit(share))
            e = Boosters(d, COLS, [s], [1], [F.col("valid") & (F.col("fold") != 1)], bins=8)
            e.grow([one])
            e.free()
            best.append(one.best_round)
            losses.append(one.losses)
        m = int(np.median(best))
        found.append({**point, "M": m, "rounds": best, "score": float(np.mean([x[min(m, len(x)) - 1] for x in losses]))})
    assert [{k: v for k, v in g.items() if k != "score"} for g in entry["grid"]] == [{k: v for k, v in g.items() if k != "score"} for g in found]
    assert np.allclose([g["score"] for g in entry["grid"]], [g["score"] for g in found], rtol=1e-12)
    win = min(found, key=lambda g: g["score"])
    assert entry["chosen"] == {k: win[k] for k in ("depth", "k_events")} and entry["M"] == win["M"] == len(spec.trees)
    # margins are those of the stored model; scores of rotations cover the fold's training rows once
    m = BoostedTrees.of(COLS, edges, spec)
    want = {r.i: r.prob for r in m.predict(d).collect()}
    got = {r.i: 1 / (1 + math.exp(-r.margin)) for r in margins.where("model_fold = 1 and label = 'y'").collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)
    seen = [r.i for r in oof.where("model_fold = 1 and label = 'y'").collect()]
    assert sorted(seen) == sorted(p.i)


def test_ridges_together_equal_newton(table):
    plan = experiment.fold_plan(table, "fold", {"y": "valid"})
    cs = [0.01, 1.0, 100.0]
    margins, oof, record, models = together.tune_ridges(table, COLS, plan, cs, ["i", "fold"])
    p = table.where("valid and fold <> 2").toPandas()
    medians = [sorted(p[c].dropna())[(p[c].notna().sum() - 1) // 2] for c in COLS]
    x = np.c_[p[COLS].fillna(dict(zip(COLS, medians, strict=True))), p[COLS].isna()].astype(float)
    keep = x.std(axis=0) > 0
    z = np.c_[np.ones(len(x)), ((x - x.mean(axis=0)) / np.where(keep, x.std(axis=0), 1))[:, keep]]
    y, entry = p.y.to_numpy(), next(r for r in record if r["fold"] == 2)
    pen = np.diag([0, *[1 / entry["chosen"]["C"]] * keep.sum()])
    n, pos = len(y), y.sum()
    w = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos))) if entry["chosen"]["balanced"] else np.ones(n)
    b = np.zeros(z.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(z.T @ (z * (w * q * (1 - q))[:, None]) + pen, z.T @ (w * (q - y)) + pen @ b)
    m = models[2, "y"]
    assert np.allclose(np.array(m.theta)[np.append(True, keep)], b, atol=1e-6)
    eigen = np.linalg.eigvalsh((z * (w * q * (1 - q))[:, None]).T[1:] @ z[:, 1:])
    assert math.isclose(entry["freedom"], (eigen / (eigen + 1 / entry["chosen"]["C"])).sum(), rel_tol=1e-5)
    assert entry["freedom_at_ends"][0] < entry["freedom_at_ends"][1]
    losses = {g["C"]: g["score"] for g in entry["grid"]}
    assert entry["chosen"]["C"] == min(cs, key=lambda c: (losses[c], c)) and losses[0.01] > losses[1.0]
    got = {r.i: r.margin for r in margins.where("model_fold = 2").collect()}
    want = {r.i: r.m for r in table.select("i", m.margin().alias("m")).collect()}
    assert all(math.isclose(got[i], want[i], abs_tol=1e-9) for i in want) and len(got) == len(want)
    assert {r.i for r in oof.where("model_fold = 2").collect()} == set(p.i)


def test_balanced_weights_are_taken_where_they_lower_the_loss(spark):
    rows = [(i, i % 4, float(i % 7), int(i % 7 == 6 and i % 3 == 0), True) for i in range(280)]
    d = spark.createDataFrame(rows, "i int, fold int, a double, y int, valid boolean")
    plan = experiment.fold_plan(d, "fold", {"y": "valid"})
    for way in ("none", "balanced", "measure"):
        _, _, record, _ = together.tune_ridges(d, ["a"], plan, [1.0], ["i", "fold"], way)
        losses = [r["grid"][0]["score"] for r in record]
        if way == "measure":
            assert [r["chosen"]["balanced"] for r in record] == [b < a for a, b in zip(plain, losses_b, strict=True)]
            assert losses == pytest.approx([min(a, b) for a, b in zip(plain, losses_b, strict=True)])
        elif way == "none":
            plain = losses
        else:
            losses_b = losses


def test_component_curve_equals_nipals(table):
    plan = experiment.fold_plan(table, "fold", {"y": "valid"}, inner="unit")
    slots = plan[0, "y"]["rotations"]
    curve = together.component_curve(table, COLS, slots, 9)
    for s in slots:
        p = table.where("valid and fold <> 0").toPandas()
        held = p.unit.astype(str) == s.name
        tr, va = p[~held], p[held]
        medians = {c: sorted(tr[c].dropna())[(tr[c].notna().sum() - 1) // 2] for c in COLS}
        full = lambda q: np.c_[q[COLS].fillna(medians), q[COLS].isna()].astype(float)  # noqa: B023, E731
        x = full(tr)
        keep = x.std(axis=0) > 0
        mu, sd = x.mean(axis=0)[keep], x.std(axis=0)[keep]
        x, v = (x[:, keep] - mu) / sd, (full(va)[:, keep] - mu) / sd
        e, f = x.copy(), tr.y - tr.y.mean()
        ws, ps, qs = [], [], []
        mine = {r["k"]: r for r in curve if r["rotation"] == s.name}
        assert set(mine) == set(range(1, keep.sum() + 1))
        for k in range(1, keep.sum() + 1):
            w = e.T @ f
            w /= np.linalg.norm(w)
            u = e @ w
            pl, q = e.T @ u / (u @ u), f @ u / (u @ u)
            e = e - np.outer(u, pl)
            ws.append(w), ps.append(pl), qs.append(q)
            beta = np.array(ws).T @ np.linalg.solve(np.array(ps) @ np.array(ws).T, qs)
            assert math.isclose(mine[k]["r_model"], np.corrcoef(x @ beta, tr.y)[0, 1], abs_tol=1e-7)
            assert math.isclose(mine[k]["r_check"], np.corrcoef(v @ beta, va.y)[0, 1], abs_tol=1e-7)
    margins, _, record, models = together.tune_components(table, COLS, plan, 4, ["i", "fold"])
    rated = {k: np.mean([r["r_check"] for r in curve if r["k"] == k]) for k in range(1, 5)}
    assert record[0]["chosen"]["k"] == max(rated, key=lambda k: (round(rated[k], 12), -k))
    want = {r.i: r.m for r in table.select("i", models[0, "y"].margin().alias("m")).collect()}
    assert all(math.isclose(r.margin, want[r.i], abs_tol=1e-9) for r in margins.where("model_fold = 0").collect())


def test_one_unit_with_events_is_tuned_by_its_blocks(table):
    # only unit 0 has both classes: no rotation of the folds 1 and 2 can be judged by another unit
    d = table.withColumn("y", F.when(F.col("unit") == 0, F.col("y")).otherwise(0))
    plan = experiment.fold_plan(d, "fold", {"y": "valid"}, inner="unit", unit=["unit"], t="t", embargo=5)
    assert [plan[f, "y"]["blocked"] for f in range(3)] == [True, True, True]
    assert [s.name for s in plan[1, "y"]["rotations"]] == ["0#block0", "0#block1"] and plan[0, "y"]["rotations"] == []
    s = plan[1, "y"]["rotations"][0]
    held, train = (d.where(c).select("unit", "t").collect() for c in (s.held, s.train))
    assert {r.unit for r in held} == {0} and {r.unit for r in train} == {0, 2, 3, 5}
    assert min(r.t for r in train if r.unit == 0) >= max(r.t for r in held) + 5
    rows, record, _ = experiment.train_tuned(d, [experiment.Arm("t", "trees", COLS, {"grid": [{"depth": 1}, {"depth": 2}], "rounds": 4, "rate": 0.3, "bins": 8})], "fold", ["i"], {"y": "valid"}, inner="unit", unit=["unit"], t="t", embargo=5)
    assert {r["fold"]: r["blocked"] for r in record} == {0: True, 1: True, 2: True}
    assert [r["fold"] for r in record if "skipped" in r] == [0] and all(r["chosen"]["depth"] in (1, 2) for r in record if r["fold"])
    assert {r.fold for r in rows.select("fold").distinct().collect()} == {1, 2}


def test_the_tuned_loop(table):
    from tidemark.operators.models import Calibrator

    trees = experiment.Arm("trees", "trees", COLS, {"grid": [{"depth": 1}, {"depth": 2, "colsample": 0.7}], "rounds": 5, "patience": 2, "rate": 0.4, "bins": 8})
    arms = [trees, experiment.Arm("ridge", "ridge", [*COLS, "gone"], {"cs": [0.1, 1.0]}), experiment.Arm("pls", "pls", COLS, {"components": 3}), experiment.Arm("rule", "rule", ["b"]), experiment.Arm("none", "ridge", ["gone"])]
    rows, record, models = experiment.train_tuned(table, arms, "fold", ["i"], LABELS, inner="unit", unit=["unit"], t="t", embargo=3, leak=["unit"])
    got = rows.toPandas()
    assert len(got) == 600 * 2 * 4 and not got.duplicated(["i", "label", "arm"]).any()
    assert {r["arm"] for r in record if "skipped" in r} == {"none"} and len(models) == 3 * 3 * 2
    assert got[got.arm == "rule"].prob.isna().all() and got[got.arm != "rule"].prob.between(0, 1).all() and got[got.arm != "rule"].threshold.between(0, 1).all()
    for arm in ("trees", "ridge", "pls"):
        g = got[(got.arm == arm) & (got.label == "y") & got.valid]
        assert g[g.y == 1].prob.mean() - g[g.y == 0].prob.mean() > 0.15, arm
    with pytest.raises(ValueError, match="leakage"):
        experiment.train_tuned(table, arms, "unit", ["i"], LABELS, leak=["fold"])
    with pytest.raises(ValueError, match="itself"):
        experiment.train_tuned(table.withColumn("arm", F.lit(1)), arms, "fold", ["i", "arm"], LABELS)
    # calibrations in shared steps are those of single fits
    d = table.select("fold", "y", (1 / (1 + F.exp(-F.col("a")))).alias("score"))
    lines = {r.fold: (r.a, r.b) for r in experiment.calibrate_together(d.unionByName(d.limit(1).withColumns({"fold": F.lit(9)})), ["fold"]).collect()}
    assert set(lines) == {0, 1, 2}
    c = Calibrator().fit(d.where("fold = 1"))
    assert np.allclose(lines[1], (c.a, c.b), atol=1e-4)


def test_roles(table):
    s = Slot(0, "x", "y", F.col("fold") == 1, F.col("fold") == 2)
    r = Designs(table, COLS, [s], ["fold"]).rows.select("fold", F.col("_role")[0].alias("r")).distinct().collect()
    assert {(x.fold, x.r) for x in r} == {(0, 0), (1, TRAIN), (2, HELD)}
    assert Ridge(0).shift == 0.0
