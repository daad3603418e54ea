"""Checks and reports on the columns of a table, and pooling of tables with different columns."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, missing share, distinct values, and verdict (missing, constant, active). One
    aggregate over the table, then one row per column."""
    aggs = [a for c in columns for a in (F.count(c).alias(f"{c}__n"), F.count_distinct(c).alias(f"{c}__d"))]
    one = df.agg(F.count("*").alias("n_rows"), *aggs)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__d").alias("n_distinct")) for c in columns]))
    out = one.select("n_rows", each.alias("c")).select("c.column", "n_rows", (1 - F.col("c.n") / F.col("n_rows")).alias("missing_frac"), "c.n_distinct")
    return out.withColumn("verdict", F.when(F.col("missing_frac") == 1, "missing").when(F.col("n_distinct") <= 1, "constant").otherwise("active"))


def indicator_audit(df: DataFrame, specs: list[tuple[str, str, float]]) -> DataFrame:
    """For (column, indicator, least): the share of rows where the value is missing although the indicator
    says that there was something to measure."""
    one = df.agg(*[F.avg((F.col(c).isNull() & (F.col(i) >= m)).cast("int")).alias(c) for c, i, m in specs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("broken_frac")) for c, _, _ in specs])).alias("c")).select("c.*")


def change_fractions(df: DataFrame, columns: list[str], unit: list[str], t: str = "t") -> DataFrame:
    """Share of rows, within units, at which each column differs from the row before."""
    from tidemark.operators.windows import ordered

    w = ordered(unit, t)
    d = df.select(*[(~F.col(c).eqNullSafe(F.lag(c).over(w))).cast("int").alias(c) for c in columns], F.row_number().over(w).alias("_i")).where("_i > 1")
    one = d.agg(*[F.avg(c).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("frac_changed")) for c in columns])).alias("c")).select("c.*")


def _over_rows(df: DataFrame, columns: list[str], each, shape: tuple[int, int], fold: str = "sum"):
    """What each(x, hashes) gives for a batch (x: rows x columns, NaN for missing; hashes of the rows), of that shape, added over all rows, or
    the greatest. Rows are read as arrays, so the plan has one expression per column."""
    import numpy as np
    import pyarrow as pa

    merge = np.add if fold == "sum" else np.maximum
    rows = df.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]).alias("x"), F.xxhash64(*columns).alias("h"))

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                part = each(x, batch.column("h").to_numpy())
                total = part if total is None else merge(total, part)
        if total is not None:
            n, w = total.shape
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * w)), pa.array(total.ravel())], names=["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg((F.sum if fold == "sum" else F.max)("v").alias("v")).toArrow()  # columns x width numbers
    out = np.full(shape[0] * shape[1], 0.0 if fold == "sum" else -np.inf)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(shape)


def affine_duplicates(df: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Pairs of columns (a, b) with b = slope * a + intercept wherever both are known, missing together, on three rows or more.

    A few passes over the rows and no expression per pair, so thousands of columns are one plan: the range of every column; sums of
    the column, brought to [0, 1] by its range, under random signs of the rows, which affine copies share up to their sign, and a
    sum that tells where it is missing; then, for the few pairs whose sums agree, the slope and the exact residual.
    Constant columns are no copies of others."""
    import numpy as np

    def ends(x, _):
        with np.errstate(all="ignore"):
            known = ~np.isnan(x)
            return np.stack([np.where(known, x, -np.inf).max(axis=0), np.where(known, -x, -np.inf).max(axis=0)], axis=1)

    hi, lo = _over_rows(df, columns, ends, (len(columns), 2), "max").T
    lo = -lo
    wide = np.isfinite(hi) & np.isfinite(lo) & (hi > lo)
    base, scale = np.where(wide, lo, 0.0), np.where(wide, hi - lo, 1.0)
    signs = 4

    def projected(x, h):
        known = ~np.isnan(x)
        z = np.where(known, (np.nan_to_num(x) - base) / scale, 0.0)
        bits = ((h.view(np.uint64)[:, None] >> np.arange(signs, dtype=np.uint64)) & np.uint64(1)).astype(float) * 2 - 1
        place = (h.view(np.uint64) >> np.uint64(24)).astype(float) / 2.0**20  # where a column is missing, as a sum of whole 2**-20
        return np.concatenate([known.sum(axis=0)[:, None].astype(float), (place @ (~known))[:, None], (z.T - 0.5 * known.T) @ bits], axis=1)

    sums = _over_rows(df, columns, projected, (len(columns), 2 + signs))
    n, missing, s = sums[:, 0], sums[:, 1], sums[:, 2:]
    near = 1e-6 * np.sqrt(np.maximum(n, 1)) + 1e-12 * n
    order = sorted((j for j in range(len(columns)) if wide[j] and n[j] >= 3), key=lambda j: (n[j], round(missing[j], 3), abs(s[j, 0])))
    pairs = []  # (column, one that it may be a copy of)
    for i, j in enumerate(order):
        for k in reversed(order[:i]):
            if n[k] != n[j] or abs(s[j, 0]) - abs(s[k, 0]) > near[j] or abs(missing[k] - missing[j]) > 1e-3:
                break
            if min(np.abs(s[j] - s[k]).max(), np.abs(s[j] + s[k]).max()) <= near[j]:
                pairs.append((max(j, k), min(j, k)))
                if len(pairs) > 50 * len(columns):
                    raise ValueError("too many columns are alike; leave copies out first")
    pairs.sort()
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, slope double, intercept double")
    b, a = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])

    def at_ends(x, _):
        out = np.full((len(pairs), 4), -np.inf)
        for col, where in ((0, lo), (2, hi)):
            hit = x[:, a] == where[a]
            out[:, col] = np.where(hit, x[:, b], -np.inf).max(axis=0, initial=-np.inf)
            out[:, col + 1] = np.where(hit, -x[:, b], -np.inf).max(axis=0, initial=-np.inf)
        return out  # the values of b where a is least and where it is greatest give the slope

    e = _over_rows(df, columns, at_ends, (len(pairs), 4), "max")
    with np.errstate(all="ignore"):
        low, high = (e[:, 0] - e[:, 1]) / 2, (e[:, 2] - e[:, 3]) / 2
        slope = (high - low) / (hi[a] - lo[a])
        intercept = low - slope * lo[a]

    def residual(x, _):
        with np.errstate(all="ignore"):
            r = np.abs(x[:, b] - slope * x[:, a] - intercept)
        odd = np.isnan(x[:, a]) != np.isnan(x[:, b])
        return np.where(odd, np.inf, np.nan_to_num(r, nan=0.0)).max(axis=0)[:, None]

    worst = _over_rows(df, columns, residual, (len(pairs), 1), "max")[:, 0]
    most = np.maximum(1.0, np.maximum(np.abs(hi[b]), np.abs(lo[b])))
    ok = np.isfinite(slope) & (worst <= tolerance * most)
    found = [(columns[k], columns[j], float(m), float(i)) for j, k, m, i, good in zip(b, a, slope, intercept, ok, strict=True) if good]
    return df.sparkSession.createDataFrame(found, "column_a string, column_b string, slope double, intercept double")


def correlated_pairs(df: DataFrame, columns: list[str], least: float = 0.98) -> DataFrame:
    """Pairs of columns with an absolute correlation of `least` or more."""
    pairs = list(itertools.combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return one.select(each.alias("c")).select("c.*").where(F.abs("r") >= least)


def disjoint_ranges(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Columns of which two groups have disjoint ranges: they tell groups apart and do not transfer."""
    g = df.groupBy(group).agg(*[x for c in columns for x in (F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi"))])
    one = g.agg(*[x for c in columns for x in (F.max(f"{c}__lo").alias(f"{c}__lo"), F.min(f"{c}__hi").alias(f"{c}__hi"))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__lo").cast("double").alias("largest_min"), F.col(f"{c}__hi").cast("double").alias("smallest_max")) for c in columns]))
    return one.select(each.alias("c")).select("c.*").withColumn("disjoint", F.col("largest_min") > F.col("smallest_max"))


def role_conflicts(df: DataFrame, name: str, role: str) -> DataFrame:
    """Names with more than one role."""
    return df.groupBy(name).agg(F.count_distinct(role).alias("n_roles"), F.min(role).alias("a_role"), F.max(role).alias("b_role")).where("n_roles > 1")


def pool(tables: dict[str, DataFrame], key: str = "system") -> DataFrame:
    """All tables by column name, absent columns null, with the name of the table in `key`."""
    out = None
    for name, t in tables.items():
        t = t.withColumn(key, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def align(df: DataFrame, columns: list[str], keys: list[str], absent: str = "error") -> DataFrame:
    """keys and exactly the columns a model wants. Those that df lacks are an error, or null with absent="null" (a
    transfer that has been judged, see `transfer_plan`)."""
    lost = [c for c in columns if c not in df.columns]
    if lost and absent != "null":
        raise ValueError("columns the model wants are absent: " + ", ".join(lost))
    return df.select(*keys, *[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def transfer_plan(importance: dict[str, float], columns: list[str], most_lost: float = 0.5) -> dict:
    """Columns of a model that a table lacks, the importance they carry, and whether a transfer is refused."""
    absent = sorted(c for c in importance if c not in columns)
    total = sum(importance.values())
    lost = sum(importance[c] for c in absent) / total if total else 0.0
    return {"absent": absent, "importance_lost": lost, "refused": lost > most_lost}


def resolve_ladder(atoms: DataFrame, by_pair: DataFrame, by_name: DataFrame, by_element: DataFrame) -> DataFrame:
    """Radius of each atom by (residue, name), else by name, else by element; one without any is refused."""
    a = atoms.join(by_pair.select("resname", "name", F.col("radius").alias("_1")), ["resname", "name"], "left")
    a = a.join(by_name.select("name", F.col("radius").alias("_2")), "name", "left").join(by_element.select("element", F.col("radius").alias("_3")), "element", "left")
    rung = F.when(F.col("_1").isNotNull(), 1).when(F.col("_2").isNotNull(), 2).when(F.col("_3").isNotNull(), 3)
    broken = F.raise_error(F.concat(F.lit("no radius for "), F.coalesce("resname", F.lit("?")), F.lit(" "), F.coalesce("name", F.lit("?")))).cast("double")
    return a.withColumns({"rung": rung, "radius": F.coalesce("_1", "_2", "_3", broken)}).drop("_1", "_2", "_3")


def lookup_all(df: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with a configured value for its key; a key without one is refused."""
    t = table.select(*keys, F.col(value).alias("_v"))
    broken = F.raise_error(F.concat(F.lit(f"no {value} for "), F.to_json(F.struct(*keys)))).cast(table.schema[value].dataType)
    return df.join(t, keys, "left").withColumn(value, F.coalesce("_v", broken)).drop("_v")


def in_pool(df: DataFrame, pool_: DataFrame, system: str = "system", condition: str = "condition") -> DataFrame:
    """Rows whose (system, condition) is listed, or whose system is listed with '*'."""
    p = pool_.groupBy(system).agg(F.collect_set(condition).alias("_c"))
    return df.join(p, system).where(F.array_contains("_c", "*") | F.array_contains("_c", F.col(condition))).drop("_c")


def complete_arrays(df: DataFrame, array: str) -> tuple[list[int], int]:
    """Places of an array column that are known and finite in every row, and how many are not."""
    e = df.select(F.posexplode_outer(array).alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.count(F.when(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")) & (F.abs("v") < float("inf")), 1)).alias("ok"))
    total = df.count()
    rows = [r for r in e.collect() if r.i is not None]
    good = sorted(r.i for r in rows if r.ok == total)
    return good, len(rows) - len(good)


def applicability(df: DataFrame, columns: dict[str, str], present: list[str]) -> DataFrame:
    """`column_profile` with the verdict "inapplicable" for columns whose subject (columns[c]) is not in this system:
    there is nothing to measure, whatever the column holds."""
    profile = column_profile(df, list(columns))
    names = [c for c, subject in columns.items() if subject not in present]
    return profile.withColumn("verdict", F.when(F.col("column").isin(names), "inapplicable").otherwise(F.col("verdict"))) if names else profile


def model_matrix(df: DataFrame, columns: dict[str, str], present: list[str], outside: list[str]) -> tuple[list[str], dict[str, str]]:
    """Columns to train on, and for every other one the reason why it is not: a score of a rival method (`outside`),
    nothing to measure, never measured, constant, or an affine function of an earlier column. Together they are all."""
    verdict = {r["column"]: r["verdict"] for r in applicability(df, columns, present).collect()}  # one row per column
    said = {"inapplicable": "nothing to measure", "missing": "never measured", "constant": "constant"}
    reasons = {c: "outside the model" for c in columns if c in outside}
    reasons |= {c: said[verdict[c]] for c in columns if c not in reasons and verdict[c] in said}
    left = [c for c in columns if c not in reasons]
    for r in affine_duplicates(df, left).collect() if len(left) > 1 else []:
        if r.column_a not in reasons:
            reasons.setdefault(r.column_b, f"affine function of {r.column_a}")
    kept = [c for c in columns if c not in reasons]
    if len(kept) + len(reasons) != len(columns):
        raise AssertionError("columns kept and left out do not add up")
    return kept, reasons


def gates(df: DataFrame, checks: dict[str, object], by: list[str]) -> DataFrame:
    """For each group and named check (a condition on rows): rows that pass, rows, and whether all and any do."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in checks.items()]))
    d = df.select(*by, each.alias("c")).groupBy(*by, "c.gate").agg(F.count_if("c.ok").alias("n_ok"), F.count("*").alias("n"))
    return d.withColumns({"all_ok": F.col("n_ok") == F.col("n"), "any_ok": F.col("n_ok") > 0})


def accepted(gates_: DataFrame, need: dict[str, str], by: list[str]) -> DataFrame:
    """Per group the number of gates that hold ("all" or "any" rows, as `need` says) and whether all do."""
    ok = F.lit(False)
    for gate, how in need.items():
        ok = F.when(F.col("gate") == gate, F.col(f"{how}_ok")).otherwise(ok)
    d = gates_.where(F.col("gate").isin(list(need))).withColumn("_ok", ok)
    return d.groupBy(*by).agg(F.count_if("_ok").alias("n_gates_ok"), (F.count_if("_ok") == len(need)).alias("accepted"))


def largest_group(df: DataFrame, by: str, within: list[str] | None = None) -> DataFrame:
    """The group with most rows, the first by name of equal ones."""
    n = df.groupBy(*(within or []), by).agg(F.count("*").alias("_n"))
    best = n.groupBy(*(within or [])).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(by).alias("g"))).alias("b"))
    return best.select(*(within or []), F.col("b.g").alias(by), (-F.col("b.n")).alias("n_rows"))


def block_importance(importance: DataFrame) -> DataFrame:
    """Importances of columns (see `explain.global_importance`) summed by block."""
    return importance.groupBy("block").agg(F.sum("importance").alias("importance"), F.count("*").alias("n_columns"))
