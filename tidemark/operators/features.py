"""Measures of one frame from its entity rows, and geometry along an axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, frame: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins, half-open but for the last, which holds its upper edge; empty bins of a seen
    frame count 0."""
    step = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1))
    inside = F.col(value).between(low, high)
    counted = df.groupBy(*frame, F.when(inside, b).alias("bin")).agg(F.count("*").alias("n"))
    all_bins = counted.select(*frame).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return all_bins.join(counted, [*frame, "bin"], "left").fillna(0, ["n"])


def innermost(df: DataFrame, frame: list[str], entity: str, z: str, centre: Column | float) -> DataFrame:
    """The frame's entity nearest to the centre, the smaller one of equals, with its place and distance."""
    d = F.abs(F.col(z) - centre)
    best = df.where(F.col(z).isNotNull()).groupBy(*frame).agg(F.min(F.struct(d.alias("d"), F.col(entity).alias("e"), F.col(z).alias("z"))).alias("b"))
    return best.select(*frame, F.col("b.e").alias(entity), F.col("b.z").alias(z), F.col("b.d").alias("distance"))


def constriction(slices: DataFrame, frame: list[str], z: str = "z", r: str = "r") -> DataFrame:
    """Least radius over the searched slices and where it first occurs; number and share of searched slices."""
    return slices.groupBy(*frame).agg(
        F.min(r).alias("r_constriction"),
        F.min(F.when(F.col(r).isNotNull(), F.struct(F.col(r), F.col(z)))).getField(z).alias("z_constriction"),
        F.count(r).alias("n_search"),
        F.avg(F.col(r).isNotNull().cast("int")).alias("search_frac"),
    )


def soft_occupancy(df: DataFrame, sites: DataFrame, frame: list[str], z: str, sigma: float) -> DataFrame:
    """Sum of Gaussian weights of a frame's entities around each site. Sites are few (checked); an entity
    meets each of them in its own row, without a join."""
    places = [(r.site, r.z) for r in sites.select("site", F.col(sites.columns[1]).alias("z")).orderBy("site").limit(257).collect()]
    if len(places) > 256:
        raise ValueError("more than 256 sites")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("site"), F.lit(float(p)).alias("p")) for s, p in places]))
    d = df.select(*frame, z, each.alias("s"))
    w = F.exp(-F.pow(F.col(z) - F.col("s.p"), 2) / (2 * sigma * sigma))
    return d.groupBy(*frame, F.col("s.site").alias("site")).agg(F.sum(w).alias("occupancy"))


def adjacent_pairs(occupancy: DataFrame, frame: list[str], site: str = "site", value: str = "occupancy") -> DataFrame:
    """Neighbouring sites that are both more than half occupied."""
    w = Window.partitionBy(*frame).orderBy(site)
    both = (F.col(value) > 0.5) & (F.lag(value).over(w) > 0.5)
    return occupancy.select(*frame, F.coalesce(both, F.lit(False)).alias("_b")).groupBy(*frame).agg(F.count_if("_b").alias("n_pairs"))


def max_gap(df: DataFrame, frame: list[str], z: str, low: float, high: float) -> DataFrame:
    """Number of entities and the largest gap along z, those to both ends included; null under two entities."""
    w = Window.partitionBy(*frame).orderBy(z)
    d = df.withColumn("_gap", F.col(z) - F.lag(z).over(w))
    g = d.groupBy(*frame).agg(F.count(z).alias("n"), F.max("_gap").alias("m"), F.min(z).alias("a"), F.max(z).alias("b"))
    return g.select(*frame, "n", F.when(F.col("n") >= 2, F.greatest("m", F.col("a") - low, F.lit(high) - F.col("b"))).alias("max_gap"))


def spread(df: DataFrame, frame: list[str], value: str) -> DataFrame:
    """Mean, and population deviation of two values or more."""
    return df.groupBy(*frame).agg(F.avg(value).alias("mean"), F.when(F.count(value) >= 2, F.stddev_pop(value)).alias("deviation"))


def circular_neighbour_cv(df: DataFrame, frame: list[str], x: str, y: str, entity: str) -> DataFrame:
    """Deviation over mean of the distances between neighbours in order of angle around the origin, the
    last one's neighbour being the first; null under three entities. Angles count to 1e-12, so that
    entities in one direction tie (the smaller entity first) whatever the platform's arctangent."""
    w = Window.partitionBy(*frame).orderBy("_angle", entity)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumn("_angle", F.round(F.atan2(y, x), 12))
    d = d.withColumn("_nx", F.coalesce(F.lead(x).over(w), F.first(x).over(whole))).withColumn("_ny", F.coalesce(F.lead(y).over(w), F.first(y).over(whole)))
    d = d.withColumn("_d", F.hypot(F.col("_nx") - F.col(x), F.col("_ny") - F.col(y)))
    return d.groupBy(*frame).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.stddev_pop("_d") / F.nullif(F.avg("_d"), F.lit(0.0))).alias("cv"))


def interpolate_at(slices: DataFrame, points: DataFrame, frame: list[str], z: str = "z", r: str = "r", at: str = "at") -> DataFrame:
    """Linear interpolation of r at places between the slices; null outside them. One pass over the union."""
    s = slices.where(F.col(r).isNotNull()).select(*frame, F.col(z).alias("_x"), F.struct(F.col(z).alias("z"), F.col(r).alias("r")).alias("_s"))
    p = points.withColumn("_x", F.col(at))
    u = p.unionByName(s, allowMissingColumns=True).withColumn("_is", F.col("_s").isNotNull())
    up = Window.partitionBy(*frame).orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*frame).orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_lo", F.max("_s").over(up)).withColumn("_hi", F.min("_s").over(down)).where(~F.col("_is"))
    t = (F.col(at) - F.col("_lo.z")) / F.nullif(F.col("_hi.z") - F.col("_lo.z"), F.lit(0.0))
    value = F.when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), F.col("_lo.r") + F.coalesce(t, F.lit(0.0)) * (F.col("_hi.r") - F.col("_lo.r")))
    return u.withColumn(f"{r}_at", value).drop("_x", "_s", "_is", "_lo", "_hi")


def kernel_smooth(df: DataFrame, frame: list[str], x: str, value: str, sigma: float, reach: float = 6.0) -> DataFrame:
    """Gaussian-weighted mean of the values around each row of its frame, over rows within `reach` sigmas. Rows
    meet in buckets of that length. Rows beyond weigh exp(-reach ** 2 / 2) at most (1.6e-8 at the default), so the mean
    is off by no more than that share of the values' range for each of them; a reach as long as the frame over
    sigma leaves none out."""
    width = reach * sigma
    a = df.withColumn("_b", F.floor(F.col(x) / width))
    b = df.select(*[F.col(c).alias(f"_f_{c}") for c in frame], F.col(x).alias("_x"), F.col(value).alias("_v"), F.explode(F.array(*[F.floor(F.col(x) / width) + k for k in (-1, 0, 1)])).alias("_c"))
    on = F.col("_b") == F.col("_c")
    for c in frame:
        on = on & (F.col(c) == F.col(f"_f_{c}"))
    w = F.exp(-F.pow(F.col(x) - F.col("_x"), 2) / (2 * sigma * sigma))
    near = a.join(b, on).where(F.abs(F.col(x) - F.col("_x")) <= width)
    keys = list(df.columns)
    return near.groupBy(*keys).agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("smoothed"))


def sign_flip(df: DataFrame, direction: Column, columns: list[str]) -> DataFrame:
    """Negate the columns where the direction is negative."""
    return df.withColumns({c: F.when(direction < 0, -F.col(c)).otherwise(F.col(c)) for c in columns})


def lining(residues: DataFrame, scale: DataFrame, frame: list[str], low: float, high: float, z: str = "z") -> DataFrame:
    """Mean scale value and number of the residues in [low, high] that the scale knows. The scale is one row
    per residue name; names it does not have are dropped."""
    s = scale.select("resname", F.col(scale.columns[1]).alias("_v"))
    d = residues.where(F.col(z).between(low, high)).join(s, "resname")
    return d.groupBy(*frame).agg(F.avg("_v").alias("lining_mean"), F.count("*").alias("lining_n"))


def column_density(slices: DataFrame, counts: DataFrame, frame: list[str], z: str = "z", r: str = "r", n: str = "n") -> DataFrame:
    """Entities per volume of the measured slices, each a disk as thick as the median spacing of the frame."""
    w = Window.partitionBy(*frame).orderBy(z)
    d = slices.withColumn("_dz", F.col(z) - F.lag(z).over(w))
    v = d.groupBy(*frame).agg(F.median("_dz").alias("_dz"), F.sum(F.pi() * F.pow(F.col(r), 2)).alias("_a"))
    return counts.join(v, frame, "left").withColumn("density", F.col(n) / F.nullif(F.col("_a") * F.col("_dz"), F.lit(0.0))).drop("_a", "_dz")


def desolvation(df: DataFrame, frame: list[str], near: Column, bulk: Column, chosen: Column) -> DataFrame:
    """1 - neighbours of the chosen entity / median neighbours of the frame's entities in bulk."""
    g = df.groupBy(*frame).agg(F.max(F.when(chosen, near)).alias("_c"), F.median(F.when(bulk, near)).alias("_b"))
    return g.select(*frame, (1 - F.col("_c") / F.nullif(F.col("_b"), F.lit(0.0))).alias("desolvation"))


def axial_asymmetry(df: DataFrame, frame: list[str], charge: str, z: str, centre: Column | float) -> DataFrame:
    """Charge above the centre less charge below it."""
    return df.groupBy(*frame).agg(F.sum(F.col(charge) * F.signum(F.col(z) - centre)).alias("asymmetry"))


def mouth_counts(df: DataFrame, frame: list[str], z: str, low: float, high: float, depth: float, direction: Column | None = None) -> DataFrame:
    """Entities up to `depth` beyond either end; the entry side follows the direction, and counts 0 without one."""
    up, down = F.col(z).between(high, high + depth), F.col(z).between(low - depth, low)
    way = direction if direction is not None else F.lit(None).cast("int")
    d = df.withColumn("_w", way)
    entry = F.when(F.col("_w") > 0, down).when(F.col("_w") < 0, up).otherwise(F.lit(False))
    return d.groupBy(*frame).agg(F.count_if(up).alias("n_upper"), F.count_if(down).alias("n_lower"), F.count_if(entry).alias("n_entry"))


def centres(df: DataFrame, frame: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """Unweighted centre of each residue or fragment."""
    return df.groupBy(*frame, *by).agg(*[F.avg(c).alias(c) for c in columns])


def image_aligned(df: DataFrame, frame: list[str], fragment: str, columns: list[str], box: dict[str, Column]) -> DataFrame:
    """Fragments moved by whole box lengths next to the frame's first fragment, each as one piece."""
    c = df.groupBy(*frame, fragment).agg(*[F.avg(x).alias(f"_c_{x}") for x in columns])
    first = Window.partitionBy(*frame).orderBy(fragment).rowsBetween(Window.unboundedPreceding, 0)
    for x in columns:
        c = c.withColumn(f"_d_{x}", F.col(f"_c_{x}") - F.first(f"_c_{x}").over(first))
    d = df.join(c.select(*frame, fragment, *[f"_d_{x}" for x in columns]), [*frame, fragment])
    moved = {x: F.col(x) - F.when(box[x] > 0, box[x] * F.rint(F.col(f"_d_{x}") / box[x])).otherwise(0.0) for x in columns}
    return d.withColumns(moved).drop(*[f"_d_{x}" for x in columns])


def pair_solvent(atoms: DataFrame, frame: list[str]) -> DataFrame:
    """Direction cosines of solvent molecules (resid, element, z, x, y): one oxygen and two hydrogens each,
    anything else is refused."""
    o, h = F.col("element") == "O", F.col("element") == "H"
    g = atoms.groupBy(*frame, "resid").agg(F.count_if(o).alias("_o"), F.count_if(h).alias("_h"), *[F.avg(F.when(o, F.col(c))).alias(f"o{c}") for c in "xyz"], *[F.avg(F.when(h, F.col(c))).alias(f"h{c}") for c in "xyz"])
    d = [F.col(f"h{c}") - F.col(f"o{c}") for c in "xyz"]
    length = F.sqrt(sum((x * x for x in d), F.lit(0.0)))
    broken = F.raise_error(F.concat(F.lit("not one O and two H in residue "), F.col("resid").cast("string"))).cast("double")
    return g.select(*frame, "resid", *[F.col(f"o{c}").alias(c) for c in "xyz"], F.when((F.col("_o") == 1) & (F.col("_h") == 2), d[2] / F.nullif(length, F.lit(0.0))).otherwise(broken).alias("cosine"))


def search_fractions(slices: DataFrame, frame: list[str], inner: Column, edge: str = "on_edge", r: str = "r") -> DataFrame:
    """Share of all slices that were measured, and of the measured inner ones whose centre is on the outermost ring."""
    found = F.col(r).isNotNull()
    return slices.groupBy(*frame).agg(F.avg(found.cast("int")).alias("search_frac"), F.avg(F.when(found & inner, F.col(edge).cast("int"))).alias("boundary_frac"))


def radius_bins(slices: DataFrame, frame: list[str], low: float, high: float, bins: int, z: str = "z", r: str = "r") -> DataFrame:
    """Per axial bin, half-open: least radius, number of measured slices, and the radius relative to the frame's least.
    Bins of a seen frame without measured slices count 0."""
    step = (high - low) / bins
    b = F.floor((F.col(z) - low) / step)
    d = slices.where((F.col(z) >= low) & (F.col(z) < high)).groupBy(*frame, b.alias("bin")).agg(F.min(r).alias("r_min"), F.count(r).alias("n_search"))
    every = slices.select(*frame).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    least = slices.groupBy(*frame).agg(F.min(r).alias("_least"))
    out = every.join(d, [*frame, "bin"], "left").join(least, frame).fillna(0, ["n_search"])
    return out.select(*frame, "bin", "r_min", "n_search", (F.col("r_min") / F.nullif(F.col("_least"), F.lit(0.0))).alias("r_relative"))


def band_cosine(residues: DataFrame, frame: list[str], low: float, high: float, cosine: str, z: str = "z") -> DataFrame:
    """Mean cosine and number of the residues in the band."""
    return residues.where(F.col(z).between(low, high)).groupBy(*frame).agg(F.avg(cosine).alias("mean_cosine"), F.count(cosine).alias("n"))


def histogram_minimum(counts: DataFrame, frame: list[str]) -> DataFrame:
    """Total and least bin of a frame's histogram."""
    return counts.groupBy(*frame).agg(F.sum("n").alias("total"), F.min("n").alias("least"))


def shell_density(counts: DataFrame, by: list[str], low: float, step: float, frames: Column) -> DataFrame:
    """Histogram counts over the volume of their spherical shell and the number of frames."""
    a = F.lit(low) + F.col("bin") * step
    volume = F.lit(4.0) / 3 * F.pi() * (F.pow(a + step, 3) - F.pow(a, 3))
    return counts.select(*by, "bin", (F.col("n") / volume / frames).alias("density"))


def wire(df: DataFrame, frame: list[str], z: str, low: float, high: float, most: float) -> DataFrame:
    """`max_gap` with whether the chain is continuous (no gap over `most`) and the gap relative to the length."""
    g = max_gap(df, frame, z, low, high)
    return g.withColumns({"continuous": F.col("max_gap") <= most, "relative_gap": F.col("max_gap") / (high - low)})


def filter_count(df: DataFrame, sites: DataFrame, frame: list[str], z: str, sigma: float) -> DataFrame:
    """Entities between the lowest site less sigma and the highest plus sigma; sites are one aggregate of two numbers."""
    low, high = sites.agg(F.min(sites.columns[1]), F.max(sites.columns[1])).first()
    inside = F.col(z).between(low - sigma, high + sigma)
    return df.groupBy(*frame).agg(F.count_if(inside).alias("n_filter"))


def wide_zone(df: DataFrame, frame: list[str], z: str, low: float, high: float, depth: float) -> DataFrame:
    """Entities in the channel or up to `depth` beyond it, and the least distance of those beyond to the nearer end."""
    beyond = F.greatest(F.lit(low) - F.col(z), F.col(z) - high)
    wide = F.col(z).between(low - depth, high + depth)
    return df.groupBy(*frame).agg(F.count_if(wide).alias("n_wide"), F.min(F.when(wide & (beyond > 0), beyond)).alias("nearest_outside"))


def lining_by_subunit(residues: DataFrame, scale: DataFrame, frame: list[str], subunit: str, low: float, high: float, z: str = "z") -> DataFrame:
    """`lining` for each subunit."""
    return lining(residues, scale, [*frame, subunit], low, high, z)


def unwrapped(df: DataFrame, unit: list[str], entity: str, columns: list[str], box: dict[str, Column], t: str = "t") -> DataFrame:
    """Places of entities without jumps across the box: each step between frames is taken as its nearest image."""
    w = Window.partitionBy(*unit, entity).orderBy(t)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for c in columns:
        step = F.col(c) - F.lag(c).over(w)
        jump = F.when(box[c] > 0, -box[c] * F.rint(step / box[c])).otherwise(0.0)
        out = out.withColumn(f"_j_{c}", F.coalesce(jump, F.lit(0.0)))
    return out.withColumns({c: F.col(c) + F.sum(f"_j_{c}").over(sofar) for c in columns}).drop(*[f"_j_{c}" for c in columns])


def centred(df: DataFrame, frame: list[str], columns: list[str], of: Column, middle: dict[str, float] | None = None) -> DataFrame:
    """Frames moved as a whole so that the chosen rows' mean is at `middle` (0)."""
    c = df.groupBy(*frame).agg(*[F.avg(F.when(of, F.col(x))).alias(f"_c_{x}") for x in columns])
    at = middle or {}
    return df.join(c, frame).withColumns({x: F.col(x) - F.col(f"_c_{x}") + at.get(x, 0.0) for x in columns}).drop(*[f"_c_{x}" for x in columns])


def wrapped(df: DataFrame, frame: list[str], residue: list[str], columns: list[str], box: dict[str, Column]) -> DataFrame:
    """Residues moved by whole box lengths, as pieces, so that their centre lies in [0, box)."""
    c = df.groupBy(*frame, *residue).agg(*[F.avg(x).alias(f"_c_{x}") for x in columns])
    d = df.join(c, [*frame, *residue])
    moved = {x: F.col(x) - F.when(box[x] > 0, box[x] * F.floor(F.col(f"_c_{x}") / box[x])).otherwise(0.0) for x in columns}
    return d.withColumns(moved).drop(*[f"_c_{x}" for x in columns])
