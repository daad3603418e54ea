"""Session plumbing shared by the corpus operators: worker imports and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scratch: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when it was not shipped with --py-files, and keep the Arrow
    batches that they get small where the session leaves their size at Spark's default."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "2000")
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    return spark


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def scratch(spark: SparkSession) -> str:
    """A folder of this application below spark.checkpoint.dir, removed when the driver exits.

    Where the setting is absent (tests, notebooks) a temporary folder of the local machine serves,
    which is only right for a local master and refused elsewhere.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = Path(tempfile.mkdtemp(prefix="tidemark-")).as_uri()
        _scratch[app] = f"{base.rstrip('/')}/tidemark-{app}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _filesystem(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone already; the folder then stays
        pass


def folder(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that no other call gets."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the scratch folder and read it again. Shuffle files that
    only this write needed go as soon as it is done."""
    spark = df.sparkSession
    path = folder(spark, name)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before them where a column (in any case) has them already."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        out.append(n)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by written() that no plan will read again."""
    for df in tables:
        fs, p = _filesystem(df.sparkSession, df._scratch_path)
        fs.delete(p, True)
