"""Training loop, stored models, ranks in parallel, monotone trees, publishing after a crash, uneven grids."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiment, lookup, metrics, ranks, reports
from tidemark.operators.boosting import BoostedTrees
from tidemark.sources import models as stored
from tidemark.sources import sinks


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(360):
        a, b = rng.normal(size=2)
        y = int(rng.random() < 1 / (1 + np.exp(-(2 * a - 0.5))))
        unit = i % 6
        rows.append((i, unit, unit % 2, f"s{unit // 3}", float(a), float(b) if i % 7 else None, float(rng.normal()), y, i % 11 != 0))
    return spark.createDataFrame(rows, "i int, unit int, condition int, family string, a double, b double, score double, y int, valid boolean").coalesce(1).persist()


def test_folds_are_scored_by_models_of_the_others(table):
    arms = [experiment.Arm("head", "ridge", ["a", "b", "not_there"]), experiment.Arm("rule", "rule", ["score"]), experiment.Arm("none", "ridge", ["not_there"])]
    d = table.withColumn("fold", F.col("unit") % 3)
    rows, record = experiment.train_folds(d, arms, "fold", ["i"], inner="unit", leak=["unit"])
    got = {(r.i, r.arm): r for r in rows.collect()}
    assert len(got) == 720 and {r.arm for r in got.values()} == {"head", "rule"}
    assert all(0 <= r.prob <= 1 for r in got.values() if r.arm == "head") and all(r.prob is None for r in got.values() if r.arm == "rule")
    assert [e["arm"] for e in record if "skipped" in e] == ["none"] * 3
    assert all(0 < e["threshold"] < 1 for e in record if e["arm"] == "head")
    with pytest.raises(ValueError, match="leakage"):
        experiment.train_folds(d, arms[:1], "fold", ["i"], leak=["condition"])
    # the head knows, the rule does not
    ap = {r.arm: r.ap for r in reports.evaluation(rows).where("part = 'pooled'").collect()}
    assert ap["head"] > 0.7 > ap["rule"]
    final = experiment.final_model(d, arms[0], rows)
    probs = [r._arm_prob for r in final.predict(d).collect()]
    assert 0 < final.threshold < 1 and min(probs) < 0.2 and max(probs) > 0.8


def test_one_class_is_skipped_by_name(table):
    d = table.withColumns({"fold": F.col("unit") % 2, "y": F.when(F.col("unit") % 2 == 0, F.col("y")).otherwise(0)})
    rows, record = experiment.train_folds(d, [experiment.Arm("head", "pls", ["a"], {"k": 1})], "fold", ["i"], inner="unit")
    assert [e["fold"] for e in record if e.get("skipped") == "training rows of one class"] == [0]
    assert {r.fold for r in rows.select("fold").distinct().collect()} == {1}


def test_arms_of_columns_and_blocks():
    assert [(a.name, a.columns) for a in experiment.column_arms("ridge", {"control": ["a", "x"], "clock": ["z"]}, ["a", "b"])] == [("control", ["a"])]
    assert [(a.name, a.columns) for a in experiment.ablation(experiment.Arm("h", "ridge", ["a", "b", "c"]), {"one": ["a"], "two": ["b", "c"]})] == [("h-without-one", ["b", "c"]), ("h-without-two", ["a"])]


def test_ablation_trains_and_the_block_that_knows_costs_most(table):
    d = table.withColumn("fold", F.col("unit") % 3)
    arm = experiment.Arm("t", "trees", ["a", "b", "score"], {"grid": [{"depth": 1}, {"depth": 2}], "rounds": 6, "patience": 3, "rate": 0.3, "bins": 8})
    rows, record, models = experiment.train_tuned(d, [arm], "fold", ["i"], {"y": "valid"}, inner="unit")
    got = {(r.fold, r.block): r for r in experiment.ablation_losses(d, arm, record, {"knows": ["a"], "noise": ["score"], "other": ["gone"]}, "fold", ["i"], {"y": "valid"}).collect()}
    assert set(got) == {(f, b) for f in range(3) for b in ("knows", "noise")}
    assert all(got[f, "knows"].loss > got[f, "noise"].loss for f in range(3))
    # what the whole arm loses is near what it loses without noise
    p = {r.i: (r.fold, r.y, r.score) for r in rows.where("valid").collect()}
    full = {f: -np.mean([np.log(s if y else 1 - s) for g, y, s in p.values() if g == f]) for f in range(3)}
    assert all(abs(full[f] - got[f, "noise"].loss) < got[f, "knows"].loss - full[f] for f in range(3))
    # contributions of every fold's own trees add up to its margins
    from tidemark.operators import boosting

    own = {f: m for (_, f, _), m in models.items()}
    parts = boosting.fold_contributions(d, arm.columns, own, "fold", ["i"]).collect()
    scores = {r.i: r.score for r in rows.collect()}
    assert len(parts) == 360
    for r in parts:
        assert abs(sum(r.contributions.values()) - (r.margin - r.expected)) < 1e-9
        assert abs(1 / (1 + np.exp(-r.margin)) - scores[r.i]) < 1e-9


def test_transfers_and_families(table):
    arm = experiment.Arm("head", "pls", ["a", "score"], {"k": 1})
    rows, record = experiment.transfers(table, arm, "condition", "unit", ["i"])
    assert rows.count() == 360 and {(e["train"], e["test"]) for e in record} == {(0, 1), (1, 0)} and not any("skipped" in e for e in record)
    rows, record = experiment.leave_family_out(table, arm, "family", "unit", ["i"], ["score"])
    assert rows.count() == 720 and {e["arm"] for e in record} == {"head", "head-without-disjoint"}


def test_choices(table):
    d = table.withColumn("fold", F.col("unit") % 2)
    assert experiment.choose_components(d, ["a", "score"], "fold", [1, 2, 9]) in (1, 2)
    c, balanced = experiment.choose_penalty(d, ["a"], "fold", [1e-6, 1.0])
    assert c == 1.0
    # what balanced weights lose against plain ones, by single fits at the middle of the grid
    loss = {}
    for w in (False, True):
        oof, _ = experiment.out_of_fold(d, experiment.Arm("w", "ridge", ["a"], {"c": 1.0, "balanced": w}), "fold", [])
        loss[w] = -sum(np.log(r.score if r.y else 1 - r.score) for r in oof.collect())
    assert balanced == (loss[True] < loss[False])
    assert 1 <= experiment.choose_rounds(d, experiment.Arm("t", "trees", ["a"], {"rounds": 6, "patience": 2, "rate": 0.3}), "fold") <= 6


def test_stored_models_give_the_same(spark, table, tmp_path):
    for arm in (experiment.Arm("head", "ridge", ["a", "b"]), experiment.Arm("p", "pls", ["a", "b"], {"k": 2}), experiment.Arm("t", "trees", ["a", "b"], {"rounds": 3, "rate": 0.3})):
        path = stored.path_of(str(tmp_path), 5, arm.name, "1")
        assert stored.load(spark, path) is None
        first = stored.load_or_fit(spark, path, lambda arm=arm: experiment.Fitted(arm).fit(table).calibrate(table.select("score", "y").withColumn("score", F.rand(1))))
        again = stored.load_or_fit(spark, path, lambda: 1 / 0)
        a, b = ({r.i: (r._arm_score, r._arm_prob) for r in m.predict(table).collect()} for m in (first, again))
        assert a == b and again.threshold == first.threshold


def test_monotone_columns_are_monotone(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(1500):
        a, b = rng.random(), rng.random()
        p = 0.5 + 0.45 * np.sin(9 * a) * (1 if b > 0.5 else -1)
        rows.append((a, b, int(rng.random() < p)))
    d = spark.createDataFrame(rows, "a double, b double, y int").coalesce(2)
    for way in (1, -1):
        m = BoostedTrees(["a", "b"], rounds=6, depth=3, rate=0.3, monotone={"a": way}).fit(d)
        grid = spark.createDataFrame([(i, j, i / 80, j / 4) for i in range(81) for j in range(5)], "i int, j int, a double, b double")
        p = {(r.i, r.j): r.prob for r in m.predict(grid).collect()}
        assert all(way * (p[i + 1, j] - p[i, j]) >= -1e-12 for i in range(80) for j in range(5))
        assert len(set(p.values())) > 3


def test_ranks_in_parts_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(v) if k % 13 else None) for g, n in (("big", 3000), ("small", 3), (None, 40)) for k, v in enumerate(np.round(rng.normal(size=n), 2))]
    d = spark.createDataFrame(rows, "g string, v double")
    by = {g: sorted(v for h, v in rows if h == g and v is not None) for g in ("big", "small", None)}
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    for r in ranks.quantiles(d, ["g"], "v", qs).collect():
        assert r.n == len(by[r.g]) and np.allclose(list(r.q), np.quantile(by[r.g], qs))
    counted = d.groupBy("g", "v").agg(F.count("*").alias("c"))
    for down in (False, True):
        for r in ranks.running(counted, ["g"], "v", ["c"], down).collect():
            assert r.upto_c == sum(v >= r.v if down else v <= r.v for v in by[r.g]) and r.all_c == len(by[r.g])
    assert ranks.quantiles(d.limit(0), ["g"], "v", qs).count() == 0
    whole = ranks.quantiles(d, [], "v", [0.5]).first()
    assert np.isclose(whole.q[0], np.median([v for _, v in rows if v is not None]))


def test_bootstrap_takes_every_unit_alike(spark):
    units = spark.range(50).select(F.col("id").alias("unit"))
    rows = metrics.bootstrap_weights(units, 40).collect()
    per = {}
    for r in rows:
        per[r.boot] = per.get(r.boot, 0) + r.w
    assert set(per.values()) == {50} and len(per) == 40 and {r.unit for r in rows} == set(range(50))


def test_publishing_survives_both_crash_points(spark, tmp_path):
    target = (tmp_path / "out").as_uri()

    def write(text):
        with sinks.step_output(spark, target) as temp:
            sinks.write_text(spark, f"{temp}/x", text)

    write("one")
    (tmp_path / "out").rename(tmp_path / ".out.old")  # died between the renames: only the old copy is left
    with pytest.raises(RuntimeError), sinks.step_output(spark, target):
        assert (tmp_path / "out" / "x").read_text() == "one"
        raise RuntimeError
    assert (tmp_path / "out" / "x").read_text() == "one"
    (tmp_path / ".out.old").mkdir()  # died before the old copy went: the new one counts
    (tmp_path / ".out.tmp-dead").mkdir()
    write("two")
    assert (tmp_path / "out" / "x").read_text() == "two" and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_grids_need_not_be_even(spark):
    hs, rs = [0.0, 1.0, 5.0], [2.0, 2.5, 10.0]
    f = lambda h, r: 2 * h - 3 * r + 0.5 * h * r  # noqa: E731 - bilinear, so interpolation is exact
    grid = (hs, rs, [f(h, r) for h in hs for r in rs])
    d = spark.createDataFrame([(0.5, 2.2), (3.0, 9.0), (5.0, 10.0), (-1.0, 99.0), (None, 3.0)], "h double, r double")
    got = [r.b for r in d.select(lookup.bilinear(F.col("h"), F.col("r"), grid).alias("b")).collect()]
    assert np.allclose(got[:4], [f(0.5, 2.2), f(3, 9), f(5, 10), f(0, 10)]) and got[4] is None
    one = ([1.0], rs, [7.0, 8.0, 9.0])
    assert [r.b for r in d.select(lookup.bilinear(F.col("h"), F.col("r"), one).alias("b")).collect()][2] == 9.0


def test_triclinic_pairs_equal_brute_force(spark):
    from tidemark.operators.spatial import triclinic_pairs_within

    rng = np.random.default_rng(6)
    m = np.array([[9.0, 0, 0], [3.0, 8.0, 0], [-2.0, 2.5, 10.0]])
    p = rng.uniform(-15, 15, (60, 3))
    d = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "i int, x double, y double, z double").withColumn("f", F.lit(0))
    got = {(r.a, r.b): r.distance for r in triclinic_pairs_within(d, d, ["f"], ["x", "y", "z"], m.tolist(), 2.4, "i").collect()}
    shifts = np.array([(a, b, c) for a in range(-6, 7) for b in range(-6, 7) for c in range(-6, 7)]) @ m
    want = {}
    for i in range(60):
        for j in range(60):
            r = np.linalg.norm(p[i] - p[j] + shifts, axis=1).min()
            if i != j and r <= 2.4:
                want[i, j] = r
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 20
    with pytest.raises(ValueError):
        triclinic_pairs_within(d, d, ["f"], ["x", "y", "z"], m.tolist(), 5.0, "i")


def test_detection_refuses_and_keeps_what_it_found(spark):
    from tidemark.operators import detect

    rng = np.random.default_rng(2)
    r = np.concatenate([rng.normal(2.8, 0.15, 4000), rng.uniform(3.6, 6.0, 4000)])
    d = spark.createDataFrame([(float(x),) for x in r], "distance double")
    assert 3.1 < detect.coordination_cutoff(d) < 3.6
    rates = spark.createDataFrame([("k", 10, 40, 12, 4.0), ("na", 10, 3, 1, 0.3)], "s string, n_particles long, n_passes long, net long, rate double")
    assert detect.permeant(rates, "s") == ("k", 1)
    t = np.arange(1200)
    z = np.where(t % 2 == 0, -3.0, 3.0) + rng.normal(0, 0.4, 1200)
    both = spark.createDataFrame([(int(a), float(b)) for a, b in zip(t, z)], "t long, z double")
    peaks = detect.agreed_peaks(both, "z", "t")
    assert len(peaks) == 2
    one = both.withColumn("z", F.when((F.col("t") < 600) & (F.col("z") > 0), F.col("z") - 6).otherwise(F.col("z")))
    ring = spark.createDataFrame([(0, float(np.cos(a)), float(np.sin(a))) for a in np.linspace(0, 6, 6)] + [(1, float(i), 0.0) for i in range(4)], "f int, x double, y double")
    assert {r.f: r.closed for r in detect.closed_ring(ring, ["f"], "x", "y").collect()} == {0: True, 1: False}
    low, high, cylinder = detect.channel_extent(both.withColumns({"r": F.abs("z"), "f": F.col("t") % 3}), "z", "r", ["f"])
    assert low <= -3 and high >= 3 and cylinder > 4
    found, refused = detect.gathered({"cut": lambda: detect.coordination_cutoff(d), "few": lambda: detect.coordination_cutoff(d.limit(5)), "halves": lambda: detect.agreed_peaks(one, "z", "t"), "rates": lambda: detect.permeant(rates.withColumn("rate", F.lit(1.0)), "s")})
    assert set(found) == {"cut"} and set(refused) == {"few", "halves", "rates"} and refused["rates"]["partial"]["rates"]


def test_frames_of_blocks(spark):
    from tidemark.plans.frames import Block, assemble, measure, schema

    d = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 5.0)], "f int, v double")
    mean = Block("m", {"mean": "mean", "push": "signed"}, lambda t: t["rows"].groupBy("f").agg(F.avg("v").alias("mean"), F.sum("v").alias("push")), ["rows"], flips=["push"], rivals=["mean"])
    other = Block("o", {"gone": "not there"}, lambda t: t["none"], ["none"])
    tables = {"frames": spark.createDataFrame([(0,), (1,), (2,)], "f int"), "rows": d}
    assert schema([mean, other], tables) == [("mean", "m", "mean", True, False), ("push", "m", "signed", True, True), ("gone", "o", "not there", False, True)]
    got = {r.f: (r["mean"], r.push, r.gone) for r in assemble([mean, other], tables, ["f"], F.lit(-1), {"twice": lambda x: x.withColumn("mean", F.col("mean") * 2)}).collect()}
    assert got == {0: (3.0, -3.0, None), 1: (10.0, -5.0, None), 2: (None, None, None)}
    with pytest.raises(ValueError, match="mean is in m"):
        schema([mean, Block("x", {"mean": ""}, mean.compute, ["rows"])], tables)
    with pytest.raises(ValueError, match="not"):
        measure([Block("x", {"a": ""}, mean.compute, ["rows"])], tables, ["f"])
    with pytest.raises(Exception, match="several rows"):
        measure([Block("x", {"v": ""}, lambda t: t["rows"], ["rows"])], tables, ["f"]).collect()


def test_configuration_files(spark, tmp_path):
    from tidemark.plans import config

    c = config.load({"dataset": "d", "seed": 1, "labels": {"taus": [1, 2], "primary_tau": 2}}, {"seed": {"origin": "declared", "basis": "chosen"}})
    config.write(spark, str(tmp_path / "c"), c)
    assert config.read(spark, str(tmp_path / "c" / "config.json")) == c


def test_flux_that_contradicts(spark):
    from tidemark.operators.events import checked_flux

    d = spark.createDataFrame([(u, 1 if u < 3 else -1) for u in range(4) for _ in range(2)], "unit int, direction int")
    rows, way = checked_flux(d, ["unit"])
    assert way == 1 and [r.unit for r in rows.where("disagrees").collect()] == [3]
    with pytest.raises(ValueError):
        checked_flux(d, ["unit"], declared=-1)


def test_xyz_through_spark(spark, tmp_path):
    from tidemark.sources.xyz import read_xyz

    (tmp_path / "a.xyz").write_text("2\nt = 1.5\nO 0 0 0\nH 1 2 3\n\n1\nx\nK 4 5 6\n")
    got = sorted(map(tuple, read_xyz(spark, tmp_path.as_uri()).collect()))
    assert got == [("a", 1.0, 0, "K", 4.0, 5.0, 6.0), ("a", 1.5, 0, "O", 0.0, 0.0, 0.0), ("a", 1.5, 1, "H", 1.0, 2.0, 3.0)]
