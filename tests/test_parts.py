"""Operators that cut units into parts against the same operators over whole units."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import events, intervals, parts, windows


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = []
    for unit, n in (("hot", 900), ("small", 7), ("one", 1), (None, 40)):
        for t in rng.sample(range(-3000, 9000), n):
            out.append((unit, t, rng.choice([None, rng.random()]), rng.choice([0, 0, 1, 2, 2, 3, 4, 4, -9]), rng.random() < 0.02))
    return spark.createDataFrame(out, "unit string, t long, p double, zone int, wrap boolean").repartition(4).persist()


def _same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    key = lambda r: repr(tuple(r))
    got, want = (sorted((tuple(r) for r in d.select(*columns).collect()), key=key) for d in (a, b))
    assert got == want and got


@pytest.mark.parametrize("n", [2, 7, 64])
def test_latch_age_and_ladder(rows, n):
    _same(windows.latch(rows, "p", 0.8, 0.3, ["unit"], parts=n), windows.latch(rows, "p", 0.8, 0.3, ["unit"]))
    _same(windows.state_age(rows, "zone", ["unit"], parts=n), windows.state_age(rows, "zone", ["unit"]))
    tracks = rows.where("unit is not null")
    for wrap in (None, "wrap"):
        _same(events.ladder_events(tracks, ["unit"], wrap=wrap, parts=n), events.ladder_events(tracks, ["unit"], wrap=wrap))


@pytest.mark.parametrize("n", [2, 33])
def test_events_before_and_after_with_equal_times(rows, n):
    at = rows.where("wrap or zone = 4").select("unit", F.col("t").alias("at"))
    frames = rows.select("unit", "t").unionByName(rows.select("unit", "t").limit(50)).withColumn("i", F.monotonically_increasing_id())
    each = [(f, f(frames, at, ["unit"], parts=n)) for f in (intervals.with_next, intervals.with_last, intervals.with_count)]
    for f, got in each:
        _same(got, f(frames, at, ["unit"]))
    want = intervals.with_nearest(intervals.with_count(intervals.with_last(intervals.with_next(frames, at, ["unit"]), at, ["unit"]), at, ["unit"]), at, ["unit"])
    _same(intervals.with_relations(frames, at, ["unit"], parts=n), want)


@pytest.mark.parametrize("window", [0, 37, 100_000])
def test_trailing_windows_look_back_over_parts(rows, window):
    make = {"n": lambda w: F.count("*").over(w), "low": lambda w: F.min("p").over(w), "s": lambda w: F.sum("zone").over(w)}
    w = windows.trailing(["unit"], window)
    _same(parts.trailing(rows, ["unit"], "t", window, make, 16), rows.withColumns({n: f(w) for n, f in make.items()}))


def test_running_values_of_every_kind(rows):
    w = Window.partitionBy("unit").orderBy("t")
    for down, frame, over in ((False, "rows", w.rowsBetween(Window.unboundedPreceding, 0)), (True, "before", Window.partitionBy("unit").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, -1))):
        kinds = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        got = parts.scan(rows, ["unit"], "t", {k: (k, F.col("zone") if k != "count" else F.col("p")) for k in kinds}, down, frame, 9)
        _same(got, rows.withColumns({k: f("zone" if k != "count" else "p").over(over) for k, f in kinds.items()}))
    _same(parts.previous(rows, ["unit"], "t", {"q": "p"}, 9), rows.withColumns({"q": F.lag("p").over(w), "_first": F.row_number().over(w) == 1}))
    assert parts.scan(rows.limit(0), ["unit"], "t", {"x": ("sum", F.col("zone"))}).count() == 0


def test_a_huge_unit_is_spread_over_tasks(spark):
    d = spark.range(40_000).select(F.lit("hot").alias("unit"), F.col("id").alias("t"), (F.col("id") % 7 / 7).alias("p"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = lambda x: sorted(r.n for r in x.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(x.columns[-1])).collect())
        assert sizes(windows.latch(d, "p", 0.8, 0.3, ["unit"])) == [40_000]
        for out in (windows.latch(d, "p", 0.8, 0.3, ["unit"], parts=64), parts.trailing(d, ["unit"], "t", 50, {"n": lambda w: F.count("*").over(w)}, 64)):
            assert len(sizes(out)) == 8 and max(sizes(out)) < 40_000 / 3
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("window", [0, 1, 37, 100_000])
def test_trailing_totals_are_those_of_windows(rows, window):
    d = rows.unionByName(rows.limit(60)).unionByName(rows.limit(5).withColumn("t", F.lit(None).cast("long")))
    w = windows.trailing(["unit"], window)
    want = d.withColumns({"n": F.count("p").over(w), "low": F.min("p").over(w), "top": F.max("p").over(w), "s": F.sum("zone").over(w)})
    kinds = {"n": ("count", F.col("p")), "low": ("min", F.col("p")), "top": ("max", F.col("p")), "s": ("sum", F.col("zone"))}
    got = parts.trailing_totals(d, ["unit"], "t", window, kinds, 9)
    _same(got, want)
    assert "-" + str(window) + ", currentrow" not in got._jdf.queryExecution().optimizedPlan().toString()


def _tied(spark, tmp_path):
    """Events of which every six are at the same time, under other keys."""
    import __spark_entry__  # noqa: F401

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    more = e.withColumn("copy", F.explode(F.array(*[F.lit(k) for k in range(6)])))
    more = more.withColumns({"event_id": F.col("event_id") + F.col("copy") * 1_000_000, "user_id": F.col("user_id") + F.col("copy") * 10_000}).drop("copy")
    more.orderBy("event_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["one_unit_events", "one_unit_ladder", "one_unit_trailing"])
def test_rows_of_the_same_time_follow_their_ids(spark, tmp_path, name):
    import duckdb

    import __spark_entry__

    sf = _tied(spark, tmp_path)
    got = __spark_entry__.queries()[name](spark, sf)
    assert "-21600000000, currentrow" not in got._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.execute("SET threads = 1")  # then the SQL leaves equal times in the file's order
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    con.execute(f"CREATE TABLE want AS {__spark_entry__.oracle_sql()[name]}")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM want").fetchall()
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got.select(*columns).collect()), key=key) == sorted(want, key=key) and want
