"""Scans of annotation text and documents, and tables that must exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_annotations(spark: SparkSession, path: str, direction: int = 0) -> DataFrame:
    """Events from white-space records: entity, entry, exit, anything; lines that do not parse are left out.
    An entrance counts as observed when its time is positive."""
    f = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select(f.alias("f")).where(F.size("f") >= 3)
    d = lines.select(F.expr("try_cast(f[0] AS INT)").alias("entity"), F.expr("try_cast(f[1] AS DOUBLE)").alias("t_entry"), F.expr("try_cast(f[2] AS DOUBLE)").alias("t_exit"))
    return d.where("entity is not null and t_entry is not null and t_exit is not null").withColumns({"entrance_observed": F.col("t_entry") > 0, "direction": F.lit(direction)})


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str, step: str) -> DataFrame:
    """A published table; the step to run first is named where it is absent."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is absent; run the step {step!r} first")
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame | None:
    """One document as one row; None where absent."""
    return spark.read.json(path, multiLine=True) if exists(spark, path) else None


def masses_to_elements(atoms: DataFrame, elements: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Element of each atom by mass (elements: element, mass). Masses meet in buckets; one that matches
    nothing is refused."""
    width = 1.0
    e = elements.select("element", F.col("mass").alias("_m"), F.explode(F.array(*[F.floor(F.col("mass") / width) + k for k in (-1, 0, 1)])).alias("_b"))
    a = atoms.withColumn("_b", F.floor(F.col("mass") / width)).withColumn("_k", F.monotonically_increasing_id())
    hit = a.join(e, "_b", "left").withColumn("_d", F.when(F.abs(F.col("mass") - F.col("_m")) < tolerance, F.abs(F.col("mass") - F.col("_m"))))
    best = hit.groupBy("_k", *atoms.columns).agg(F.min_by("element", "_d").alias("_e"))
    broken = F.raise_error(F.concat(F.lit("no element has the mass "), F.coalesce(F.col("mass").cast("string"), F.lit("null")))).cast("string")
    return best.withColumn("element", F.coalesce("_e", broken)).drop("_k", "_e")
