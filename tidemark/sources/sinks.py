"""Publishing: a step's output appears whole or not at all, with a record of where it came from."""

from __future__ import annotations

import hashlib
import json
import platform
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def run_dir(root: str, dataset: str, stride: int) -> str:
    """Runs of different datasets or strides never share a folder."""
    return f"{root.rstrip('/')}/{dataset}-stride{stride}"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _rename(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"{a} cannot be renamed to {b}")


@contextmanager
def step_output(spark: SparkSession, target: str) -> Iterator[str]:
    """A folder to write to that replaces `target` when the block ends well. After a failure the old output is
    untouched and nothing else is left. What runs that died have left is put right first: an old output that was
    moved away without a new one in its place comes back, and unfinished folders go."""
    fs, path = _fs(spark, target)
    parent, name = target.rstrip("/").rsplit("/", 1)
    old = f"{parent}/.{name}.old"
    if fs.exists(path(old)):  # a run died between the two renames, or before it removed the old output
        if fs.exists(path(target)):
            fs.delete(path(old), True)
        else:
            _rename(fs, path(old), path(target))
    for stale in fs.globStatus(path(f"{parent}/.{name}.tmp-*")) or []:
        fs.delete(stale.getPath(), True)
    temp = f"{parent}/.{name}.tmp-{uuid.uuid4().hex}"
    fs.mkdirs(path(temp))
    try:
        yield temp
    except BaseException:
        fs.delete(path(temp), True)
        raise
    if fs.exists(path(target)):
        _rename(fs, path(target), path(old))
    _rename(fs, path(temp), path(target))
    fs.delete(path(old), True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, make = _fs(spark, path)
    out = fs.create(make(path), True)
    out.write(bytearray(text.encode()))
    out.close()


def provenance(spark: SparkSession, config: dict, plan: DataFrame | None = None) -> dict:
    """What produced an output: the configuration and its digest, versions, and the plan's digest."""
    text = json.dumps(config, sort_keys=True, default=str)
    out = {"config": config, "config_sha256": hashlib.sha256(text.encode()).hexdigest(), "spark": spark.version, "python": platform.python_version(), "platform": platform.platform()}
    if plan is not None:
        out["plan_sha256"] = hashlib.sha256(plan._jdf.queryExecution().logical().canonicalized().toString().encode()).hexdigest()
    return out


def publish(tables: dict[str, DataFrame], target: str, config: dict, partition_by: list[str] | None = None) -> None:
    """Write tables as Parquet, with their provenance, as one step's output."""
    spark = next(iter(tables.values())).sparkSession
    with step_output(spark, target) as temp:
        for name, df in tables.items():
            w = df.write.partitionBy(*partition_by) if partition_by else df.write
            w.parquet(f"{temp}/{name}")
        write_text(spark, f"{temp}/provenance.json", json.dumps(provenance(spark, config), indent=1, default=str))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as Markdown; a large one is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
