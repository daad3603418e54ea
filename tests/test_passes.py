"""The training loop's jobs: how many a pass costs, and that what is shared between passes changes nothing."""

import math
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiment, held, labels, metrics, together
from tidemark.plans import composed

ARM = experiment.Arm("t", "trees", ["a", "b"], {"grid": [{"depth": 1}, {"depth": 2}], "rounds": 4, "patience": 2, "rate": 0.3, "bins": 8})


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 6, i % 3, i // 6, float(a), None if i % 7 == 0 else float(b), int(a + b > 0.3), i % 11 != 0) for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    return spark.createDataFrame(rows, "i int, unit int, fold int, t int, a double, b double, y int, valid boolean").repartition(2).persist()


def _jobs(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ablation_shares_the_rows_of_its_search(spark, table):
    cut = {"first": ["a"], "second": ["b"]}
    both, n = _jobs(spark, "shared", lambda: experiment.tuned_ablation(table, ARM, cut, "fold", ["i"], {"y": "valid"}).collect())

    def apart():
        _, record, _ = experiment.train_tuned(table, [ARM], "fold", ["i"], {"y": "valid"})
        return experiment.ablation_losses(table, ARM, record, cut, "fold", ["i"], {"y": "valid"}).collect()

    two, m = _jobs(spark, "apart", apart)
    want = {(r.fold, r.label, r.block): (r.n_rows, r.ap, r.loss) for r in two}
    assert len(both) == len(want) == 6 and n < 0.7 * m
    for r in both:
        rows, ap, loss = want[r.fold, r.label, r.block]
        assert r.n_rows == rows and math.isclose(r.ap, ap, rel_tol=1e-12) and math.isclose(r.loss, loss, rel_tol=1e-9)


def test_calibration_of_counted_rows_is_that_of_the_rows(spark, table):
    d = table.where("valid").select("fold", "y", F.round(1 / (1 + F.exp(-F.col("a"))), 1).alias("score"))
    plain, _ = _jobs(spark, "plain", lambda: {r.fold: (r.a, r.b) for r in experiment.calibrate_together(d, ["fold"]).collect()})
    counted = d.groupBy("fold", "score").agg(F.avg("y").alias("y"), F.count("*").alias("n"))
    got = {r.fold: (r.a, r.b) for r in experiment.calibrate_together(counted, ["fold"], times="n").collect()}
    assert got.keys() == plain.keys() == {0, 1, 2} and all(np.allclose(got[f], plain[f], atol=1e-8) for f in got)


def test_labels_in_columns_are_those_in_rows(spark, table):
    d = table.select("i", "unit", "t")
    events = table.where("y = 1").select("unit", F.col("t").alias("at"))
    wide = labels.label_columns(d, events, {("y3", "v3"): 3, ("y9", "v9"): 9}, ["unit"])
    rows = labels.forward_labels(d, events, [3, 9], ["unit"]).collect()
    assert {(r.i, n, r[f"y{n}"], r[f"v{n}"]) for r in wide.collect() for n in (3, 9)} == {(r.i, r.tau, r.y, r.valid) for r in rows} and wide.count() == 240


def test_every_row_of_a_repeated_key_is_scored_once(spark, table):
    twice = table.unionByName(table).withColumn("i", F.when(F.col("i") > 0, F.col("i")))
    arms = [experiment.Arm("ridge", "ridge", ["a", "b"], {"cs": [1.0]}), experiment.Arm("head", "pls", ["a", "b"], {"components": 2})]
    (rows, record, _), n = _jobs(spark, "linear", lambda: experiment.train_tuned(twice, arms, "fold", ["i"], {"y": "valid"}))
    assert rows.count() == 2 * twice.count() and rows.where("i is null").count() == 4
    assert all(r["threshold"] is not None for r in record)


def test_cuts_are_exact_quantiles_whatever_the_order(spark):
    rng = np.random.default_rng(7)
    v = [float(x) for x in rng.normal(size=30_000)]
    v[5:9] = [0.0, -0.0, math.inf, -math.inf]
    d = spark.createDataFrame([(x, None if i % 3 else 2.0, i % 2) for i, x in enumerate(v)], "v double, w double, side int")
    trains = [F.lit(True), F.col("side") == 1, F.col("side") > 1]
    for parts in (1, 5):
        got = together.fold_edges(d.repartition(parts), ["v", "w"], trains, 32)
        for own, (of_v, of_w) in zip((sorted(v), sorted(v[1::2])), got[:2], strict=True):
            assert of_v == sorted({own[math.ceil(k / 32 * len(own)) - 1] for k in range(1, 32)}) and of_w == [2.0]
        assert got[2] == [[], []]


def test_order_statistics_of_many_sets_are_those_of_each(spark):
    rng = np.random.default_rng(8)
    inside, x = rng.random((500, 7)) < 0.3, np.where(rng.random((500, 2)) < 0.2, math.nan, np.round(rng.normal(size=(500, 2)), 1))
    inside[:, 6] = False
    chunks = spark.sparkContext.parallelize([(inside[a : a + 50], x[a : a + 50]) for a in range(0, 500, 50)], 4)
    got = together.order_statistics(chunks, 7, 2, [0.1, 0.5, 1.0])
    assert np.isnan(got[6]).all()
    for i in range(6):
        for j in range(2):
            own = np.sort(x[inside[:, i] & ~np.isnan(x[:, j]), j])
            assert list(got[i, j]) == [own[math.ceil(q * len(own)) - 1] for q in (0.1, 0.5, 1.0)]


def test_lines_and_cuts_of_ordered_parts_are_those_of_all_scores(spark, table):
    arms = [ARM, experiment.Arm("ridge", "ridge", ["a", "b"], {"cs": [1.0]}), experiment.Arm("head", "pls", ["a", "b"], {"components": 2})]
    rows, record, _ = experiment.train_tuned(table, arms, "fold", ["i"], {"y": "valid"})
    plan = experiment.fold_plan(table, "fold", {"y": "valid"})
    tuned = [together.tune_trees(table, ARM.columns, plan, ARM.options["grid"], ["i", "fold"], **{k: v for k, v in ARM.options.items() if k != "grid"}), together.tune_ridges(table, ["a", "b"], plan, [1.0], ["i", "fold"]), together.tune_components(table, ["a", "b"], plan, 2, ["i", "fold"])]
    for arm, (margins, oof, _, _) in zip(arms, tuned, strict=True):
        score = F.col("margin") if arm.kind == "pls" else 1 / (1 + F.exp(-F.col("margin")))
        held = oof.join(table.select("i", "y"), "i").withColumn("score", score).persist()
        line = {r.model_fold: (r.a, r.b) for r in experiment.calibrate_together(held, ["model_fold"]).collect()}
        for e in (e for e in record if e["arm"] == arm.name):
            a, b = line[e["fold"]]
            p = F.least(F.greatest("score", F.lit(1e-7)), F.lit(1 - 1e-7))
            probs = held.where(F.col("model_fold") == e["fold"]).withColumn("prob", 1 / (1 + F.exp(-(F.log(p / (1 - p)) * a + b))))
            assert np.allclose(e["calibration"], (a, b), atol=1e-7)
            assert math.isclose(e["threshold"], metrics.f1_threshold(probs, [], "y", "prob").first().threshold, rel_tol=1e-7)
        want = {r.i: r.score for r in margins.where("model_fold = fold").withColumn("score", score).collect()}
        got = {r.i: r.score for r in rows.where(F.col("arm") == arm.name).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_a_task_holds_a_block_of_scores_not_all_of_its_own(spark):
    def made(i):
        rng = np.random.default_rng(i)
        for _ in range(60):
            value = np.round(rng.normal(size=200), 6)
            yield [(g, *held._counted(v, value > 0, np.ones(200))) for g, v in enumerate((value, np.round(value, 1)))]

    def chunks(tasks):
        """Those of the tasks; fails where more than a few are still held."""
        alive = []
        for rows in (rows for i in tasks for rows in made(i)):
            alive = [x for x in alive if x() is not None] + [weakref.ref(rows[0][1])]
            assert len(alive) < 20, "a task holds all of its scores"
            yield rows

    ordered, totals = held.in_order(spark.sparkContext.parallelize(range(2), 2).mapPartitions(chunks), 2, block=2000)
    parts = [x for part in ordered.glom().collect() for x in part]
    ordered.unpersist()
    every = [x for i in range(2) for rows in made(i) for x in rows]
    assert max(sum(len(value) for _, value, *_ in part) for part in parts) < 4000
    for g in (0, 1):
        value, tp, n = (np.concatenate([x[k] for x in every if x[0] == g]) for k in (1, 2, 3))
        own = [x for part in parts for x in part if x[0] == g]
        found, at = np.unique(value, return_inverse=True)
        assert np.array_equal(np.concatenate([x[1] for x in own]), found) and list(totals[g]) == [tp.sum(), n.sum()]
        assert np.array_equal(np.concatenate([x[2] for x in own]), np.bincount(at, tp)) and np.array_equal(np.concatenate([x[3] for x in own]), np.bincount(at, n))


def test_labels_of_own_rows_need_no_second_look(spark, table):
    d = table.select("i", "unit", "t", "y")
    taus = {("y3", "v3"): 3, ("y9", "v9"): 9}
    own = labels.own_label_columns(d, F.col("y") == 1, taus, ["unit"])
    two = labels.label_columns(d, d.where("y = 1").select("unit", F.col("t").alias("at")), taus, ["unit"])
    assert {tuple(r) for r in own.collect()} == {tuple(r) for r in two.select(*own.columns).collect()}
    read = composed.horizons(spark, "/root/testdata/sf0.001")
    assert read._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_chunks_keep_every_task_busy(spark):
    chunks = spark.sparkContext.parallelize(range(90), 9)
    cores = spark.sparkContext.defaultParallelism
    even = together.evenly(chunks)
    n = [len(part) for part in even.glom().collect()]
    assert len(n) % cores == 0 and len(n) >= 9 and sum(n) == 90 and max(n) - min(n) <= 4
    assert sorted(even.collect()) == list(range(90)) and together.evenly(spark.sparkContext.parallelize(range(9), cores)).getNumPartitions() == cores


def test_varying_columns_are_those_of_the_design():
    x = np.array([[1.0, math.nan, 5.0], [2.0, 3.0, 5.0], [math.nan, 4.0, 5.0]])
    medians, mean, scale = np.array([1.0, 3.0, 5.0]), np.arange(6) / 7, np.array([1.0, 2.0, 0.0, 3.0, 0.0, 0.0])
    use = np.append(0, 1 + np.flatnonzero(scale > 0))
    assert np.array_equal(together.varying(x.T, medians, mean, scale).T, together.design(x, medians, mean, scale)[:, use])
