"""Frames from particles: plans, absent particles, names; the scan of species against single tracks."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks, detect
from tidemark.plans.composed import ten_blocks


@pytest.fixture(scope="module")
def particles(spark):
    rng = random.Random(2)
    rows = []
    for unit in (0, 1):
        for t in range(12):
            for e in range(30):
                kind = ("channel", "membrane", "ion", "water")[e % 4]
                z = 0.0 if kind == "channel" else (30.0 if e % 8 < 4 else -30.0) if kind == "membrane" else rng.uniform(-40, 40)
                rows.append((unit, t, e, kind, z, rng.uniform(0, 10) if e % 7 else None, 0.0, 200.0, rng.choice([-1, 0, 1])))
    return spark.createDataFrame(rows, "unit int, t long, entity int, species string, z double, r double, y double, box double, q int").withColumn("x", F.coalesce("r", F.lit(0.0))).repartition(3).persist()


def test_ten_blocks_are_one_exchange(particles):
    plan = blocks.measure(ten_blocks(), particles, ["unit", "t"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    out = blocks.assemble(ten_blocks(), particles, ["unit", "t"], F.when(F.col("unit") == 1, -1).otherwise(1))
    assert out.columns == ["unit", "t", *[c for b in ten_blocks() for c in b.columns], "n_water_trailing", "n_water_change"]
    assert [c for c, _, _ in blocks.schema(ten_blocks())] != [] and out.count() == 24


def test_shared_aggregates_are_computed_once(particles):
    a = blocks.hydration(F.col("species") == "water", "z", "r", -30, 30, 9.0)
    b = blocks.Block("again", dict(a.sums), {"again": lambda of: of("n")})
    out = blocks.measure([a, b], particles, ["unit", "t"])
    assert out.where("n_water <> again").count() == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count(") == 1 or plan.count("count_if") <= 1


def test_frames_without_particles_of_a_kind(particles):
    d = particles.where("species = 'ion'").select("*")
    r = blocks.measure(ten_blocks(), d, ["unit", "t"]).first()
    assert r.r_min is None and r.n_water == 0 and r.wire_gap is None and r.ring_cv is None and r.ring_n == 0 and r.r_deviation is None and r.measured_frac is None
    assert blocks.measure(ten_blocks(), particles.limit(0), ["unit", "t"]).count() == 0


def test_names_are_checked():
    one = blocks.delivery(F.col("a") > 0, "z", 0, 1, 1)
    with pytest.raises(ValueError, match="n_below"):
        blocks.schema([one, blocks.Block("other", {}, {"n_below": lambda of: F.lit(1)})])
    with pytest.raises(ValueError, match="names nothing"):
        blocks.schema([blocks.Block("other", {}, {}, flips=["nothing"])])


def _tracks(spark, step):
    """A particle that climbs through the channel, one that goes round the seam, and one that stays."""
    rows = []
    for t in range(0, 60):
        rows += [("u", t, 100, "channel", 0.0, 0.0), ("u", t, 101, "membrane", 30.0, 5.0), ("u", t, 102, "membrane", -30.0, 5.0)]
        climb, round_ = -40 + step * t, 40 + step * t
        rows += [("u", t, 1, "ion", (climb + 50) % 100 - 50.0, 1.0), ("u", t, 2, "ion", (round_ + 50) % 100 - 50.0, 20.0), ("u", t, 3, "water", 5.0, 1.0)]
    return spark.createDataFrame(rows, "unit string, t long, entity int, species string, z double, x double").withColumns({"y": F.lit(0.0), "box": F.lit(100.0)})


def test_scan_counts_passes_and_refuses_wide_strides(spark):
    d = _tracks(spark, 2)
    for parts in (None, 5):
        got = {r.species: r for r in detect.crossing_scan(d, ["unit"], "entity", "species", 8.0, 1, 1000, parts=parts).collect()}
        assert (got["ion"].n_particles, got["ion"].n_passes, got["ion"].net, got["ion"].flux_sign) == (2, 1, 1, 1)
        assert got["water"].n_passes == 0 and got["water"].flux_sign == 0 and got["water"].seam_move == 0
    got = {r.species: r for r in detect.crossing_scan(d, ["unit"], "entity", "species", 8.0, 20, 1000).collect()}
    assert got["ion"].n_frames == 3 and got["ion"].seam_move == pytest.approx(0.4) and got["ion"].n_passes is None and got["water"].n_passes == 0
    short = {r.species: r for r in detect.crossing_scan(d, ["unit"], "entity", "species", 8.0, 1, 10).collect()}
    assert short["ion"].n_frames == 11 and short["ion"].n_passes == 0
    assert detect.crossing_scan(d.limit(0), ["unit"], "entity", "species", 8.0, 1, 10).count() == 0


def test_a_large_ring_is_passed_once(spark):
    """The mean of a ring's distances must not be taken anew for each of its members."""
    import numpy as np

    rng = random.Random(5)
    d = spark.createDataFrame([(0, 0, e, rng.gauss(0, 1), rng.gauss(0, 1)) for e in range(3000)], "unit int, t int, e int, x double, y double")
    out = blocks.measure([blocks.symmetry(F.lit(True), F.col("x"), F.col("y"), "e")], d, ["unit", "t"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    p = sorted((np.arctan2(r.y, r.x), r.e, r.x, r.y) for r in d.collect())
    xy = np.array([q[2:] for q in p])
    step = np.hypot(*(np.roll(xy, -1, axis=0) - xy).T)
    assert abs(out.first().ring_cv - step.std() / step.mean()) < 1e-9
