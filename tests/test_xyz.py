"""Trajectories read by ranges of lines against the plain reader."""

import random
from itertools import chain

import pytest

from tidemark.sources.xyz import frames, read_xyz


def _text(seed, n_frames=40):
    rng = random.Random(seed)
    out = []
    for f in range(n_frames):
        n = rng.choice([0, 1, 3, 5, 30]) if seed else 7
        comment = rng.choice([f"t= {f * 2.5} ps", "3", "", "12", f"step {f} t={f}", "C 1 2 3"])
        out += [str(n) if f % 3 else f"  {n} ", comment, *[f"C{k}  {rng.uniform(-9, 9):.3f} {k} {-k}.5 extra" for k in range(n)]]
        out += [""] * rng.choice([0, 0, 2])
    return "\n".join(out) + "\n" * (seed % 2)


@pytest.mark.parametrize("size", ["128m", "300b"])
def test_ranges_of_lines_give_the_same_rows(spark, tmp_path, size):
    texts = {f"run {i}+{i}" if i else "run": _text(i) for i in range(4)}
    for name, t in texts.items():
        (tmp_path / f"{name}.xyz").write_text(t, newline="\r\n" if name == "run" else "\n")
    want = sorted(chain.from_iterable(frames(iter(t.splitlines()), name) for name, t in texts.items()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        if size == "300b":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        df = read_xyz(spark, str(tmp_path))
        assert df.columns == ["unit", "t", "entity", "name", "x", "y", "z"]
        assert sorted(tuple(r) for r in df.collect()) == want
        assert {r.unit for r in read_xyz(spark, str(tmp_path / "run.xyz"), "u").collect()} == {"u"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_broken_files_are_refused(spark, tmp_path):
    for name, text, match in (("short", "3\nc\nC 0 0 0\n", "ends within a frame"), ("stray", "1\nc\nC 0 0 0\nC 1 1 1\n", "outside every frame")):
        (tmp_path / f"{name}.xyz").write_text(text)
        with pytest.raises(Exception, match=match):
            read_xyz(spark, str(tmp_path / f"{name}.xyz")).collect()
