"""One row per frame from blocks of measures: a block declares its columns and computes them from named tables, the
schema is computed from the blocks that apply, and frames without a measure have nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import sign_flip


@dataclass
class Block:
    """columns: names with what they mean. needs: tables that compute() is given; a block applies where all are there.
    flips: columns whose sign follows the direction. rivals: columns that stay out of a model."""

    name: str
    columns: dict[str, str]
    compute: Callable[[dict[str, DataFrame]], DataFrame]
    needs: list[str]
    flips: list[str] = field(default_factory=list)
    rivals: list[str] = field(default_factory=list)


def applying(blocks: list[Block], tables: dict[str, DataFrame]) -> list[Block]:
    return [b for b in blocks if all(n in tables for n in b.needs)]


def schema(blocks: list[Block], tables: dict[str, DataFrame]) -> list[tuple[str, str, str, bool, bool]]:
    """(column, block, meaning, applies, to the model) for every column of all blocks; a name in two blocks, or a flip or
    rival that is no column, is an error."""
    there, out, seen = {b.name for b in applying(blocks, tables)}, [], {}
    for b in blocks:
        for c in [*b.flips, *b.rivals]:
            if c not in b.columns:
                raise ValueError(f"{b.name} names {c}, which is not among its columns")
        for c, meaning in b.columns.items():
            if c in seen:
                raise ValueError(f"{c} is in {seen[c]} and in {b.name}")
            seen[c] = b.name
            out.append((c, b.name, meaning, b.name in there, c not in b.rivals))
    return out


def measure(blocks: list[Block], tables: dict[str, DataFrame], frame: list[str]) -> DataFrame:
    """A row for each frame of tables["frames"], with the columns of all blocks, null for those that do not apply. A block
    that does not give exactly its columns once per frame is an error."""
    schema(blocks, tables)
    out = tables["frames"].select(*frame).distinct()
    for b in blocks:
        if b not in applying(blocks, tables):
            out = out.withColumns({c: F.lit(None).cast("double") for c in b.columns})
            continue
        made = b.compute(tables)
        given = [c for c in made.columns if c not in frame]
        if sorted(given) != sorted(b.columns):
            raise ValueError(f"{b.name} gives {sorted(given)}, not {sorted(b.columns)}")
        once = made.groupBy(*frame).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in given])
        broken = F.raise_error(F.lit(f"{b.name} gives several rows for a frame")).cast("boolean")
        once = once.where(F.when(F.col("_n") > 1, broken).otherwise(True)).drop("_n")
        out = out.join(once, frame, "left")
    return out


def assemble(blocks: list[Block], tables: dict[str, DataFrame], frame: list[str], direction: Column, post: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Measures, then each post-processing in turn (windows over frames, baselines), then the signs of flipping columns:
    trailing operators see laboratory signs, and everything after sees those of the direction."""
    out = measure(blocks, tables, frame)
    for step in (post or {}).values():
        out = step(out)
    return sign_flip(out, direction, [c for b in blocks for c in b.flips if c in out.columns])
