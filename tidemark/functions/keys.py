"""Time keys, missing values, and joins that must be one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone; free of the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """Missing is null everywhere in this library: turn NaN into it (all floating columns by default)."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names}) if names else df


def refuse_infinite(df: DataFrame, *columns: str) -> DataFrame:
    """Infinity is an error, not a missing value."""
    checks = {c: F.when(F.abs(c) == float("inf"), F.raise_error(F.lit(f"{c} is infinite"))).otherwise(F.col(c)) for c in columns}
    return df.withColumns(checks)


def rint_ratio(numerator: Column, denominator: Column) -> Column:
    """Nearest whole ratio, halves to even."""
    return F.rint(numerator / denominator)


def minimum_image(d: Column, length: Column) -> Column:
    """Periodic displacement of least size; no box, no wrapping."""
    return F.when(length.isNull() | (length <= 0), d).otherwise(d - length * F.rint(d / length))


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, failing at run time where a key occurs twice (in the same exchange that a join on it needs)."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*[F.col(c) for c in df.columns])).alias("_row"))
    row = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key in a one-to-one join: "), F.to_json(F.struct(*keys))))).otherwise(F.col("_row"))
    return n.select(row.alias("_row")).select("_row.*")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    return unique_keys(left, keys).join(unique_keys(right, keys), keys, how)


def derived_seed(*parts: str) -> Column:
    """First four bytes, little-endian, of the SHA-256 of the parts joined by '|'."""
    h = F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]), 256)
    swapped = F.concat(*[F.substring(h, 7 - 2 * k, 2) for k in range(4)])
    return F.conv(swapped, 16, 10).cast("long")
