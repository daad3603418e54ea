"""Models, kernels, lookups and plumbing against small independent computations."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, detect, explain, kernels, lookup, models, spatial, tables
from tidemark.plans import config
from tidemark.sources import files, sinks
from tidemark.sources.xyz import XyzSource


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    rows = []
    for unit in range(6):
        x = rng.normal(size=(120, 4))
        p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 3] - 0.5)))
        y = (rng.random(120) < p).astype(int)
        miss = rng.random((120, 4)) < 0.1
        rows += [(f"u{unit}", int(y[i]), *[None if miss[i, j] else float(x[i, j]) for j in range(4)]) for i in range(120)]
    return spark.createDataFrame(rows, "unit string, y int, a double, b double, c double, d double").persist()


COLS = ["a", "b", "c", "d"]


def test_missing_encoder(spark):
    t = spark.createDataFrame([(1.0, None), (3.0, 5.0)], "a double, b double")
    got = models.MissingEncoder(["a", "b"]).fit(t).transform(t).orderBy("a").collect()
    assert [(r.a, r.b, r.a_missing, r.b_missing) for r in got] == [(1.0, 5.0, 0, 1), (3.0, 5.0, 0, 0)]
    train = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    assert models.MissingEncoder(["a"]).fit(train).transform(spark.createDataFrame([(None,)], "a double")).first().a == 2.0
    with pytest.raises(ValueError, match="infinite"):
        models.MissingEncoder(["a"]).fit(spark.createDataFrame([(float("inf"),)], "a double"))


def test_ridge_logistic_equals_newton(planted):
    enc = models.MissingEncoder(COLS).fit(planted)
    d = enc.transform(planted)
    d = models.Standardiser(COLS).fit(d).transform(d)
    m = models.RidgeLogistic(COLS, c=0.5).fit(d)
    pdf = d.toPandas()
    x, y = np.c_[np.ones(len(pdf)), pdf[COLS].to_numpy()], pdf.y.to_numpy()
    b, pen = np.zeros(5), np.diag([0, 1, 1, 1, 1]) / 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (p - y) + pen @ b)
    assert np.allclose([m.intercept, *m.coefficients], b, atol=1e-4)
    row = m.contributions(m.predict(d)).first()
    assert abs(sum(row[f"contrib_{c}"] for c in COLS) + m.intercept - math.log(row.prob / (1 - row.prob))) < 1e-9
    losses = models.grid_search(d.where("unit in ('u0', 'u1')"), COLS, "unit", [1e-4, 1.0])
    assert losses[1.0] < losses[1e-4]


def test_grid_search_refuses_to_ignore_groups(spark):
    with pytest.raises(ValueError, match="1000 groups"):
        models.grid_search(spark.range(1001).withColumn("y", F.col("id") % 2), ["id"], "id", [])


def test_calibration(planted):
    d = planted.withColumn("score", 1 / (1 + F.exp(-2 * F.coalesce("a", F.lit(0.0)))))
    c = models.Calibrator().fit(d)
    assert c.fitted and c.a > 0
    p = c.transform(d)
    m, y = p.agg(F.avg("prob"), F.avg("y")).first()
    assert abs(m - y) < 1e-4
    iso = models.Calibrator("isotonic", 10).fit(d)
    assert iso.steps and not iso.transform(d).where("prob < 0 or prob > 1 or prob is null").count()
    assert not models.Calibrator().fit(d.where("y = 1")).fitted
    slope, _ = models.calibration_line(p)
    assert abs(slope - 1) < 1e-3


def test_partial_least_squares_equals_nipals(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 15))
    y = x @ rng.normal(size=15) + 0.3 * rng.normal(size=120)
    d = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, y double")
    for k in (1, 2, 3, 5):
        e, f, w_, p_, q_ = x - x.mean(0), y - y.mean(), [], [], []
        for _ in range(k):
            w = e.T @ f
            w /= np.linalg.norm(w)
            t = e @ w
            p, q = e.T @ t / (t @ t), f @ t / (t @ t)
            e, f = e - np.outer(t, p), f - q * t
            w_.append(w), p_.append(p), q_.append(q)
        w, p, q = np.array(w_).T, np.array(p_).T, np.array(q_)
        beta = w @ np.linalg.solve(p.T @ w, q)
        m = models.PartialLeastSquares(k).fit(d)
        assert np.allclose(m.beta, beta, atol=1e-8)
    got = m.predict(d).first().score
    assert abs(got - ((x[0] - x.mean(0)) @ beta + y.mean())) < 1e-8
    assert models.effective_freedom(d, "x", "y", 1e-3) > models.effective_freedom(d, "x", "y", 1e3)


def test_boosted_trees_and_shapley_values(planted):
    train, watch = planted.where("unit <> 'u5'"), planted.where("unit = 'u5'")
    m = boosting.BoostedTrees(COLS, rounds=6, depth=2, rate=0.3, bins=16, patience=4).fit(train, watch=watch)
    out = m.contributions(m.predict(watch)).toPandas()
    assert out[out.y == 1].prob.mean() > out[out.y == 0].prob.mean() + 0.1
    margin = np.log(out.prob / (1 - out.prob))
    shap = np.array(out.contributions.tolist())
    assert np.allclose(shap.sum(axis=1) + m.expected_margin(), margin, atol=1e-9)
    # Against the definition, over all subsets of columns.
    bins = np.array(watch.select(m._binned(watch).alias("b")).toPandas().b.tolist())[:3]

    def expected(node, row, known):
        if not node.children:
            return node.value
        if node.feature in known:
            b = row[node.feature]
            return expected(node.children[0 if (node.missing_left if b < 0 else b < node.cut) else 1], row, known)
        w = [c.cover for c in node.children]
        return sum(a * expected(c, row, known) for a, c in zip(w, node.children)) / sum(w)

    for i, row in enumerate(bins):
        for f in range(4):
            rest, total = [j for j in range(4) if j != f], 0.0
            for k in range(4):
                for s in itertools.combinations(rest, k):
                    weight = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                    total += weight * sum(expected(t, row, {*s, f}) - expected(t, row, set(s)) for t in m.trees)
            assert abs(total - shap[i, f]) < 1e-9


def test_profile_of_a_cylinder(spark):
    def rings(radius, waist=None):
        out = []
        for z in range(-10, 11):
            r = (waist if waist and z == 0 else radius) + 1.5
            out += [(r * math.cos(a), r * math.sin(a), float(z)) for a in np.linspace(0, 2 * math.pi, 24, endpoint=False)]
        return [c for p in out for c in p], [1.5] * len(out)

    frames = spark.createDataFrame([("wide", *rings(3.0), [0.0] * 3), ("waist", *rings(3.0, 1.2), [0.0] * 3)], "unit string, xyz array<double>, radii array<double>, anchor array<double>")
    got = kernels.profile(frames, [float(z) for z in range(-6, 7)] + [30.0], ["unit"], search=4.0).toPandas()
    wide = got[(got.unit == "wide") & got.r.notna()]
    assert len(wide) > 5 and wide.r.between(2.5, 3.05).all() and got[got.z == 30].r.isna().all()
    assert got[(got.unit == "waist") & (got.z == 0)].r.iloc[0] < 1.3
    r = np.array([5.0] * 9)
    for dips, n in (({4: 1.0}, 1), ({4: 1.0, 5: 1.2}, 2)):
        x = r.copy()
        for k, v in dips.items():
            x[k] = v
        assert kernels.envelope_outliers(x, np.arange(9.0), 0.05).sum() == n


def test_superposition(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(size=(10, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    moved = ref @ q + 5
    d = spark.createDataFrame([(1, moved.ravel().tolist())], "t int, xyz array<double>")
    got = np.array(kernels.superpose(d, ref.ravel().tolist(), ["t"]).first().xyz).reshape(-1, 3)
    assert np.allclose(got, ref - ref.mean(0), atol=1e-5)


def test_lookup(spark):
    hs, rs = [0.0, 1.0, 2.0], [0.0, 10.0]
    grid = (hs, rs, [h * 3 + r for h in hs for r in rs])
    p = spark.createDataFrame([(0.5, 5.0), (3.0, -1.0), (None, 1.0)], "h double, r double")
    got = p.select(lookup.bilinear(F.col("h"), F.col("r"), grid).alias("b"), lookup.nearest_node(F.col("h"), F.col("r"), grid).alias("n")).collect()
    assert [(r.b, r.n) for r in got] == [(6.5, 0.0), (6.0, 6.0), (None, None)]
    nodes = spark.createDataFrame([(h, r, h * 3 + r) for h in hs for r in rs], "h double, r double, e double")
    assert lookup.load_grid(nodes, "h", "r", "e") == grid
    with pytest.raises(ValueError, match="incomplete"):
        lookup.load_grid(nodes.where("not (h = 1 and r = 0)"), "h", "r", "e")
    line = lookup.contour(grid, 4.5)
    d = spark.createDataFrame([(0.0, 4.5)], "x double, y double").select(lookup.distance_to_segments(F.col("x"), F.col("y"), line).alias("d")).first().d
    assert line and d < 1e-9
    seg = spark.createDataFrame([(2.0, 1.0), (-3.0, 4.0)], "x double, y double").select(lookup.distance_to_segments(F.col("x"), F.col("y"), [(0.0, 0.0, 4.0, 0.0), (9.0, 9.0, 9.0, 9.0)]).alias("d")).collect()
    assert [r.d for r in seg] == [1.0, 5.0]


def test_spatial(spark):
    rng = np.random.default_rng(2)
    pts = rng.uniform(0, 10, (80, 3))
    d = spark.createDataFrame([("f", i, *map(float, p)) for i, p in enumerate(pts)], "f string, k int, x double, y double, z double")
    got = {(r.a, r.b) for r in spatial.pairs_within(d, d, ["f"], ["x", "y", "z"], 2.0, "k").collect()}
    dist = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    assert got == {(i, j) for i in range(80) for j in range(80) if i != j and dist[i, j] <= 2.0}
    per = {(r.a, r.b) for r in spatial.periodic_pairs_within(d, d, ["f"], ["x", "y", "z"], [10.0] * 3, 2.0, "k").collect()}
    delta = pts[:, None] - pts[None]
    delta -= 10 * np.rint(delta / 10)
    dist = np.sqrt((delta**2).sum(-1))
    assert per == {(i, j) for i in range(80) for j in range(80) if i != j and dist[i, j] <= 2.0}
    n = {r.k: r.n_near for r in spatial.coordination(d, d, ["f"], ["x", "y", "z"], 2.0, "k").collect()}
    assert sum(n.values()) == len(got) and len(n) == 80


def test_tables(spark):
    a = np.linspace(0, 10, 50)
    rows = [(float(v), float(2 * v - 3), float(math.sin(v))) for v in a]
    d = spark.createDataFrame(rows, "a double, b double, c double")
    assert [(r.column_a, r.column_b) for r in tables.affine_duplicates(d, ["a", "b", "c"]).collect()] == [("a", "b")]
    broken = spark.createDataFrame([(x, y + 0.5 * (i == 7), z) for i, (x, y, z) in enumerate(rows)], d.schema)
    assert tables.affine_duplicates(broken, ["a", "b", "c"]).count() == 0
    assert tables.transfer_plan({"a": 1.0, "z": 3.0}, ["a"]) == {"absent": ["z"], "importance_lost": 0.75, "refused": True}
    assert tables.align(d, ["a", "zz"], ["c"], absent="null").columns == ["c", "a", "zz"]
    with pytest.raises(ValueError, match="zz"):
        tables.align(d, ["a", "zz"], ["c"])
    assert models.active_columns(spark.createDataFrame([(1.0, 1.0, None), (1.0, 2.0, None)], "a double, b double, c double"), ["a", "b", "c"]) == ["b"]


def test_explain(spark):
    d = spark.createDataFrame([(1, -2.0, 1.0, -0.5), (2, 0.1, 0.2, 0.3)], "k int, a double, b double, c double")
    got = {r.k: r for r in explain.axis_push(d, {"one": ["a", "b"], "two": ["c"]}, 0.1).collect()}
    assert (got[1].axis, got[1].driver, got[2].axis, got[2].driver) == ("one", "a", "unclear", None)
    top = explain.top_axes(d, {"one": ["a", "b"], "two": ["c"]}, 1, ["k"]).orderBy("k").collect()
    assert [(r.k, r.axis) for r in top] == [(1, "one"), (2, "one")]


def test_detection(spark):
    atoms = [("W", i, e, 0.0) for i in range(3) for e in "OHH"] + [("K", 9, "K", 1.0)] + [("P", 10, "C", 0.0)] * 4
    kinds = {r.resname: r.kind for r in detect.classify_residues(spark.createDataFrame(atoms, "resname string, resid int, element string, charge double")).collect()}
    assert kinds == {"W": "solvent", "K": "cation", "P": "chain"}
    rng = np.random.default_rng(3)
    z = np.concatenate([rng.uniform(-9, -5, 500), rng.uniform(5, 9, 500)])
    pts = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(rng.uniform(-9, 9, 1000), rng.uniform(-9, 9, 1000), z)], "x double, y double, z double")
    pts = pts.withColumn("frame", F.floor(F.rand(1) * 2)).unionByName(spark.createDataFrame([(0.0, 0.0, 500.0, 0)], "x double, y double, z double, frame long"))
    assert detect.find_axis(pts, ["frame"]) == "z"  # whatever one stray point does
    with pytest.raises(detect.Refused):
        detect.find_axis(pts.select("frame", "x", "y", F.col("x").alias("z")), ["frame"])
    v = spark.createDataFrame([(float(x),) for x in np.concatenate([rng.normal(-3, 0.3, 800), rng.normal(3, 0.3, 600)])], "v double")
    peaks = detect.density_peaks(v, "v", -6.0, 6.0, 40)
    assert len(peaks) == 2 and abs(peaks[0] + 3) < 0.5 and abs(peaks[1] - 3) < 0.5


def test_annotations_and_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 0 5 x\n# note\n2 3.5 9\nbad 1 2\n 3 4\n")
    got = files.read_annotations(spark, str(tmp_path / "a.txt"), 1).orderBy("entity").collect()
    assert [(r.entity, r.t_entry, r.t_exit, r.entrance_observed) for r in got] == [(1, 0.0, 5.0, False), (2, 3.5, 9.0, True)]
    (tmp_path / "r.xyz").write_text("2\nt=0.5\nA 1 2 3\nB 4 5 6\n2\nt=1.5\nA 1 2 4\nB 4 5 7\n")
    spark.dataSource.register(XyzSource)
    rows = spark.read.format("xyz").load(str(tmp_path)).orderBy("t", "entity").collect()
    assert [(r.unit, r.t, r.name, r.z) for r in rows] == [("r", 0.5, "A", 3.0), ("r", 0.5, "B", 6.0), ("r", 1.5, "A", 4.0), ("r", 1.5, "B", 7.0)]
    atoms = spark.createDataFrame([(1.008,), (15.99,)], "mass double")
    el = spark.createDataFrame([("H", 1.008), ("O", 15.999)], "element string, mass double")
    assert sorted(r.element for r in files.masses_to_elements(atoms, el).collect()) == ["H", "O"]
    with pytest.raises(FileNotFoundError, match="events"):
        files.load(spark, str(tmp_path / "none"), "events")


def test_publishing(spark, tmp_path):
    target = f"{tmp_path}/{sinks.run_dir('out', 'set', 4)}/labels"
    assert "stride4" in target
    sinks.publish({"a": spark.range(3), "foreign": spark.range(1)}, target, {"x": 1})
    sinks.publish({"a": spark.range(5)}, target, {"x": 1})
    assert spark.read.parquet(f"{target}/a").count() == 5 and not files.exists(spark, f"{target}/foreign")
    assert json.loads(open(f"{target}/provenance.json").read())["config"] == {"x": 1}
    with pytest.raises(RuntimeError), sinks.step_output(spark, target) as temp:
        spark.range(1).write.parquet(f"{temp}/a")
        raise RuntimeError
    import os

    assert spark.read.parquet(f"{target}/a").count() == 5 and os.listdir(os.path.dirname(target)) == ["labels"]
    assert sinks.markdown(spark.range(1)).splitlines()[-1] == "| 0 |"


DOC = {"dataset": "d", "seed": 1, "labels": {"taus": [1, 2], "primary_tau": 2}}


@pytest.mark.parametrize(("change", "says"), [
    ({"colour": 1}, "unknown key"),
    ({"trees": {"ratte": 1}}, "unknown key"),
    ({"labels": {"taus": [1], "primary_tau": 2}}, "not among"),
    ({"seed": None}, "null"),
    ({"stride": "x"}, "not a int"),
    ({"units": ["a", "a"]}, "twice"),
])
def test_config_refuses(change, says):
    with pytest.raises(config.ConfigError, match=says):
        config.load(DOC | change)


def test_config_saves_no_defaults():
    c = config.load(DOC, {"seed": {"origin": "declared", "basis": "chosen"}})
    assert set(c.saved()["values"]) == {"dataset", "seed", "labels.taus", "labels.primary_tau"}
    with pytest.raises(config.ConfigError, match="basis"):
        config.load(DOC, {"seed": {"origin": "declared"}})
    with pytest.raises(config.ConfigError, match="both"):
        config.choose_source(c, 1, 1)


def test_streaming_monitor_equals_batch(spark, tmp_path):
    from pyspark.sql import Window

    from tidemark.operators import windows
    from tidemark.streaming.monitor import monitor

    rng = np.random.default_rng(8)
    rows = [(u, 10 * t, None if rng.random() < 0.1 else float(rng.random())) for u in range(3) for t in range(40)]
    d = spark.createDataFrame(rows, "unit long, t long, score double")
    src = str(tmp_path / "in")
    d.where("t < 200").coalesce(1).write.parquet(src)
    d.where("t >= 200").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 10).parquet(src)
    q = monitor(stream, 30, 0.6, 0.4).writeStream.format("memory").queryName("alarm").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {(r.unit, r.t): (None if r["mean"] is None else round(r["mean"], 9), r.armed) for r in spark.table("alarm").collect()}
    batch = windows.latch(d.withColumn("mean", F.avg("score").over(Window.partitionBy("unit").orderBy("t").rangeBetween(-30, 0))), "mean", 0.6, 0.4, ["unit"])
    assert got == {(r.unit, r.t): (None if r["mean"] is None else round(r["mean"], 9), r.armed) for r in batch.collect()}


def test_affine_duplicates_of_very_many_columns(spark):
    import time

    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 1990))
    base[rng.random(base.shape) < 0.02] = np.nan
    copies = np.stack([2.5 * base[:, 3] + 7, -1e6 * base[:, 10] + 3, base[:, 10], 1e-7 * base[:, 500] - 1e-3, base[:, 7] + 1e-4 * rng.normal(size=300), np.full(300, 4.0), np.full(300, np.nan)], axis=1)
    gap = base[:, 20].copy()
    gap[np.flatnonzero(~np.isnan(gap))[0]] = np.nan
    x = np.concatenate([base, copies, gap[:, None]], axis=1)
    names = [f"c{i}" for i in range(x.shape[1])]
    pdf = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    d = spark.createDataFrame([(list(r),) for r in pdf], "x array<double>").select(*[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    start = time.time()
    got = {(r.column_a, r.column_b): (r.slope, r.intercept) for r in tables.affine_duplicates(d, names).collect()}
    assert set(got) == {("c3", "c1990"), ("c10", "c1991"), ("c10", "c1992"), ("c1991", "c1992"), ("c500", "c1993")}
    assert got["c3", "c1990"] == pytest.approx((2.5, 7)) and got["c10", "c1991"] == pytest.approx((-1e6, 3)) and got["c500", "c1993"] == pytest.approx((1e-7, -1e-3))
    assert time.time() - start < 120
    assert tables.affine_duplicates(d.limit(0), names[:3]).count() == 0


def test_shapley_values_from_tables_are_those_of_the_game():
    """Rows look outcomes up; the game itself is played once per path, not once per row."""
    import numpy as np

    from tidemark.operators import boosting

    rng = np.random.default_rng(2)
    bins = rng.integers(-1, 9, (500, 5))
    steps = {2: ([(4, True, True)], 0.3), 0: ([(3, False, False), (7, True, True)], 0.45), 4: ([(5, True, False)], 0.8)}
    out = np.zeros((500, 5))
    boosting._games.cache_clear()
    boosting._add(out, bins, 1.7, steps)
    boosting._add(np.zeros((500, 5)), bins, -2.0, steps)
    assert boosting._games.cache_info().misses == 1 and boosting._games.cache_info().hits == 1
    passed = np.array([[all((b[f] < cut if b[f] >= 0 else missing) == left for cut, missing, left in tests) for f, (tests, _) in steps.items()] for b in bins])
    whole = 1.7 * passed.all(axis=1)
    assert np.allclose(out.sum(axis=1), whole - 1.7 * 0.3 * 0.45 * 0.8)
    want = 1.7 * boosting._game([p.astype(float) for p in passed.T], [0.3, 0.45, 0.8])
    assert np.allclose(out[:, [2, 0, 4]], want, rtol=1e-12) and not out[:, [1, 3]].any()
