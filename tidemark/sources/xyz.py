"""A data source for multi-frame XYZ text: one row per particle and frame, one partition per file.

A frame is a line with the number of particles, a comment line that may hold `t=<number>`, and a line
`name x y z` per particle. Register with `spark.dataSource.register(XyzSource)`, then
`spark.read.format("xyz").option("unit", "run1").load(path)`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "unit string, t double, entity int, name string, x double, y double, z double"


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


def frames(lines: Iterator[str], unit: str) -> Iterator[tuple]:
    """Rows of one file; t is that of the comment line, or the frame's number."""
    frame = 0
    for line in lines:
        if not line.strip():
            continue
        m = re.search(r"\bt\s*=\s*([-+0-9.eE]+)", next(lines, ""))
        t = float(m[1]) if m else float(frame)
        for k in range(int(line)):
            name, x, y, z = next(lines).split()[:4]
            yield unit, t, k, name, float(x), float(y), float(z)
        frame += 1


class XyzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xyz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return XyzReader(self.options)


class XyzReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.unit = options["path"], options.get("unit")

    def partitions(self) -> list[InputPartition]:
        p = Path(self.path.removeprefix("file://"))
        files = sorted(x for x in p.iterdir() if x.suffix == ".xyz" and not x.name.startswith(".")) if p.is_dir() else [p]
        return [_File(str(x)) for x in files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = Path(partition.value)
        unit = self.unit or path.stem
        with path.open(encoding="utf-8") as f:
            yield from frames(f, unit)


def read_xyz(spark, path: str, unit: str | None = None):
    """The same rows by Spark's own text reader: any store that it reaches, and a large file is many tasks.

    A first pass counts the lines of each piece of a file, which numbers all lines. Lines of one whole number may begin a
    frame; walking through a file's list of these (a number per frame, not its particles) tells those that do from
    comments that look alike. Every other line finds its frame by a running value in two levels (see `parts`). Lines outside
    a frame that are not blank, and a last frame that is cut short, are errors."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.operators.parts import cut, scan

    place = F.monotonically_increasing_id()  # within a piece, lines in order
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), place.alias("id"), F.trim("value").alias("value"))
    pieces = lines.groupBy("path", "piece").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    files = Window.partitionBy("path")
    before = F.coalesce(F.sum("n").over(files.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("path", "piece", "first", before.alias("before"), F.sum("n").over(files).alias("total"))
    numbered = lines.join(pieces, ["path", "piece"]).select("path", (F.col("id") - F.col("first") + F.col("before")).alias("line"), "total", "value")
    found = numbered.where(F.col("value").rlike("^[0-9]{1,9}$")).groupBy("path").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("line", F.col("value").cast("long").alias("n")))).alias("c"))

    def walk(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for name, total, candidates in zip(batch["path"], batch["total"], batch["c"], strict=True):
                free, frame = 0, 0
                for c in candidates:
                    if c["line"] >= free:
                        free = c["line"] + 2 + c["n"]
                        out.append((name, c["line"], c["n"], frame))
                        frame += 1
                if free > total:
                    raise ValueError(f"{name} ends within a frame")
            yield pd.DataFrame(out, columns=["path", "line", "n", "frame"])

    heads = found.mapInPandas(walk, "path string, line long, n long, frame long").withColumn("head", F.struct("line", "n", "frame")).select("path", "line", "head")
    rows = cut(numbered.join(heads, ["path", "line"], "left"), "line")
    rows = scan(rows, ["path"], "line", {"now": ("last", F.col("head"))}).withColumn("k", F.col("line") - F.col("now.line") - 2)
    said = F.regexp_extract("value", r"\bt\s*=\s*([-+0-9.eE]+)", 1)
    time = F.when(F.col("k") == -1, F.when(said != "", said.cast("double")).otherwise(F.col("now.frame").cast("double")))
    rows = scan(rows, ["path"], "line", {"t": ("last", time)})
    inside = (F.col("k") >= 0) & (F.col("k") < F.col("now.n"))
    stray = F.raise_error(F.concat(F.lit("a line outside every frame of "), "path", F.lit(": "), "value")).cast("boolean")
    rows = rows.where(F.when(inside, True).when(F.col("k").isin(-2, -1) | (F.col("value") == ""), False).otherwise(stray))
    w = F.split("value", r"\s+")
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1), r"[.][^.]*$", "")
    return rows.select((F.lit(unit) if unit else stem).alias("unit"), "t", F.col("k").cast("int").alias("entity"), w[0].alias("name"), *[w[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
