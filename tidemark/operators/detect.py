"""Parameters from data: kinds of groups, the axis, extents, density peaks. What is not clear is refused."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import column_quantiles


class Refused(ValueError):
    """The data do not decide; a person has to. `partial` is what was found until then."""

    def __init__(self, reason: str, partial: dict | None = None):
        super().__init__(reason)
        self.partial = partial or {}


def classify_residues(atoms: DataFrame) -> DataFrame:
    """Kind of each residue name by composition (atoms: resname, resid, element, charge): solvent (one O, two
    H), ion (single atom with a charge of 0.35 or more), lipid (over 50 atoms and 20 copies), else chain."""
    each = atoms.groupBy("resname", "resid").agg(F.count("*").alias("n"), F.sum("charge").alias("q"), F.count_if(F.col("element") == "O").alias("o"), F.count_if(F.col("element") == "H").alias("h"))
    by = each.groupBy("resname").agg(F.count("*").alias("copies"), F.max("n").alias("n"), F.avg("q").alias("charge"), F.max("o").alias("o"), F.max("h").alias("h"))
    kind = F.when((F.col("n") == 1) & (F.col("charge") >= 0.35), "cation").when((F.col("n") == 1) & (F.col("charge") <= -0.35), "anion")
    kind = kind.when((F.col("o") == 1) & (F.col("h") == 2) & (F.col("n") >= 3) & (F.col("n") <= 5), "solvent").when((F.col("n") > 50) & (F.col("copies") > 20), "lipid").otherwise("chain")
    return by.select("resname", "copies", "n", "charge", kind.alias("kind"))


def halves_means(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median of each group's values and the means of those below it and of the others; null where a half is empty."""
    d = df.join(df.groupBy(*by).agg(F.median(value).alias("median")), by)
    low = F.col(value) < F.col("median")
    return d.groupBy(*by, "median").agg(F.avg(F.when(low, F.col(value))).alias("mean_low"), F.avg(F.when(~low, F.col(value))).alias("mean_high"))


def axis_scores(points: DataFrame, frame: list[str]) -> DataFrame:
    """For each axis the mean over frames of 1 / (share of points in the band's inner third + 0.01), the band going from the
    mean of the lower half of the frame's points to that of the upper half."""
    each = points.select(*frame, F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("v")) for c in "xyz"])).alias("e")).select(*frame, "e.axis", "e.v")
    m = halves_means(each, [*frame, "axis"], "v").where("mean_low is not null and mean_high is not null")
    third = (F.col("mean_high") - F.col("mean_low")) / 3
    inside = (F.col("v") > F.col("mean_low") + third) & (F.col("v") < F.col("mean_high") - third)
    per = each.join(m, [*frame, "axis"]).groupBy(*frame, "axis").agg((1 / (F.avg(inside.cast("int")) + 0.01)).alias("s"))
    return per.groupBy("axis").agg(F.avg("s").alias("score"))


def find_axis(points: DataFrame, frame: list[str], least: float = 10.0, lead: float = 2.0) -> str:
    """Axis (x, y or z) along which points avoid the middle third between their two halves most."""
    scores = sorted(((r.score, r.axis) for r in axis_scores(points, frame).collect()), reverse=True)
    if not scores or scores[0][0] < least or (len(scores) > 1 and scores[0][0] < lead * scores[1][0]):
        raise Refused(f"no axis stands out: {scores}")
    return scores[0][1]


def extent(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> tuple[float, float]:
    """Whole numbers around two quantiles."""
    got = column_quantiles(df, [value], [low, high])
    if not got:
        raise Refused(f"no {value}")
    return float(math.floor(got[value][0])), float(math.ceil(got[value][1]))


def density_peaks(df: DataFrame, value: str, low: float, high: float, bins: int, prominence: float = 0.2) -> list[float]:
    """Centres of the peaks of a histogram smoothed over three bins that rise above both neighbouring
    valleys by a share of the maximum."""
    step = (high - low) / bins
    h = df.where(F.col(value).between(low, high)).groupBy(F.least(F.floor((F.col(value) - low) / step), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    counts = {r.bin: r.n for r in h.collect()}
    raw = [0, *[counts.get(k, 0) for k in range(bins)], 0]
    s = [sum(raw[k - 1 : k + 2]) / 3 for k in range(1, bins + 1)]
    top = max(s, default=0)
    out = []
    for k, v in enumerate(s):
        if v <= 0 or (k and s[k - 1] >= v) or (k + 1 < bins and s[k + 1] > v):
            continue
        sides = []
        for way in (range(k - 1, -1, -1), range(k + 1, bins)):
            deep = v
            for j in way:
                if s[j] > v:
                    break
                deep = min(deep, s[j])
            else:
                deep = min(deep, 0.0)
            sides.append(deep)
        if v - max(sides) >= prominence * top:
            out.append(low + (k + 0.5) * step)
    return out


def vote_direction(events: DataFrame) -> int:
    """Direction in which more events go; a tie is refused."""
    net = events.agg(F.coalesce(F.sum("direction"), F.lit(0))).first()[0]
    if not net:
        raise Refused("as many events in either direction")
    return 1 if net > 0 else -1


def motif_places(residues: DataFrame, fragment: list[str], position: str, letter: str, motif: str) -> DataFrame:
    """Where a pattern occurs in each fragment's sequence of letters, counted from 0. A fragment's sequence is
    put together in its own row; fragments are molecules, thousands of residues at most."""
    seq = residues.groupBy(*fragment).agg(F.array_sort(F.collect_list(F.struct(position, letter))).alias("s"))
    text = F.array_join(F.transform("s", lambda r: r[letter]), "")
    found = seq.select(*fragment, text.alias("sequence"))
    return found.where(F.col("sequence").rlike(motif)).withColumn("place", F.regexp_instr("sequence", F.lit(motif)) - 1)


def check_steps(frames: DataFrame, unit: list[str], t: str = "t", box: str | None = None, most_change: float = 0.1) -> DataFrame:
    """Units whose time does not rise, whose step varies, or whose box jumps."""
    w = Window.partitionBy(*unit).orderBy(t)
    d = frames.withColumn("_d", F.col(t) - F.lag(t).over(w))
    aggs = [F.count_if(F.col("_d") <= 0).alias("n_not_rising"), (F.max("_d") - F.min("_d")).alias("step_spread")]
    if box:
        d = d.withColumn("_b", F.abs(F.col(box) / F.lag(box).over(w) - 1))
        aggs.append(F.count_if(F.col("_b") > most_change).alias("n_box_jumps"))
    return d.groupBy(*unit).agg(*aggs)


def motif_layers(atoms: DataFrame, places: DataFrame, fragment: list[str], length: int, carbonyl: str, first: str) -> DataFrame:
    """Rings of oxygens of a motif: the `carbonyl` atom of each of its positions and the `first` atom (a side chain's) of
    position 0, each ring over all fragments, numbered by mean z. atoms: fragment, position, name, z; places: fragment
    and the position at which the motif begins."""
    d = atoms.join(places.select(*fragment, "place"), fragment).withColumn("offset", F.col("position") - F.col("place"))
    ring = (F.col("offset") >= 0) & (F.col("offset") < length) & ((F.col("name") == carbonyl) | ((F.col("name") == first) & (F.col("offset") == 0)))
    layers = d.where(ring).groupBy("name", "offset").agg(F.avg("z").alias("mean_z"), F.count("*").alias("n_atoms"))
    return layers.withColumn("layer", F.row_number().over(Window.orderBy("mean_z", "name", "offset")) - 1)  # a few rows for each motif position


def lining_subunits(atoms: DataFrame, frame: list[str], fragment: str, cylinder: float, centre: tuple[str, str] = ("x", "y"), least: int = 30) -> DataFrame:
    """Per frame the number of fragments of `least` atoms or more of which an atom comes within 1.5 cylinder radii of the
    atoms' mean axis."""
    x, y = centre
    c = atoms.groupBy(*frame).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"))
    r = F.hypot(F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy"))
    each = atoms.join(c, frame).groupBy(*frame, fragment).agg(F.count("*").alias("n"), F.min(r).alias("r"))
    return each.groupBy(*frame).agg(F.count_if((F.col("n") >= least) & (F.col("r") < 1.5 * cylinder)).alias("n_subunits"))


def crossing_rates(passes: DataFrame, particles: DataFrame, species: str) -> DataFrame:
    """Per species: particles, completed passes (direction 1 or -1), net passes, passes per particle, the most first."""
    n = particles.groupBy(species).agg(F.count("*").alias("n_particles"))
    p = passes.groupBy(species).agg(F.count("*").alias("n_passes"), F.sum("direction").alias("net"))
    d = n.join(p, species, "left").fillna(0, ["n_passes", "net"])
    return d.withColumn("rate", F.col("n_passes") / F.col("n_particles"))


def permeant(rates: DataFrame, species: str, least: int = 1, lead: float = 2.0) -> tuple[str, int]:
    """The species of the highest rate per particle and its direction; too few passes, a runner-up within a factor of
    `lead`, or as many passes either way are refused, with the rates that were found."""
    rows = sorted(rates.collect(), key=lambda r: (-r.rate, r[species]))  # one row per species
    found = [r.asDict() for r in rows]
    if not rows or rows[0].n_passes < least:
        raise Refused("too few passes", {"rates": found})
    if len(rows) > 1 and rows[0].rate < lead * rows[1].rate:
        raise Refused("no species stands out", {"rates": found})
    if not rows[0].net:
        raise Refused("as many passes in either direction", {"rates": found})
    return rows[0][species], 1 if rows[0].net > 0 else -1


def coordination_cutoff(distances: DataFrame, value: str = "distance", low: float = 2.0, high: float = 6.0, step: float = 0.05, window: tuple[float, float] = (2.2, 4.8), least: int = 100) -> float:
    """First minimum of the radial distribution after its highest peak in the window; fewer than `least` pairs in the
    window are refused."""
    bins = round((high - low) / step)
    b = F.floor((F.col(value) - low) / step)
    h = distances.where((F.col(value) >= low) & (F.col(value) < high)).groupBy(F.least(b, F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    counts = {r.bin: r.n for r in h.collect()}  # one row per bin
    centre = [low + (k + 0.5) * step for k in range(bins)]
    inside = [k for k in range(bins) if window[0] < centre[k] < window[1]]
    total = sum(counts.get(k, 0) for k in inside)
    if total < least:
        raise Refused(f"{total} pairs in the window", {"pairs": total})
    shell = [counts.get(k, 0) / (4 * math.pi * centre[k] ** 2) for k in range(bins)]
    peak = max(inside, key=lambda k: (shell[k], -k))
    after = [k for k in range(peak + 1, bins) if centre[k] <= window[1]]
    if not after:
        raise Refused("the highest peak is at the window's end", {"peak": centre[peak]})
    return centre[min(after, key=lambda k: (shell[k], k))]


def agreed_peaks(df: DataFrame, value: str, t: str, step: float = 0.5, prominence: float = 0.2, least: int = 200) -> list[float]:
    """`density_peaks` between the 1st and 99th percentile, refused where both halves of the time do not show as many."""
    n = df.where(F.col(value).isNotNull()).count()
    if n < least:
        raise Refused(f"{n} observations", {"observations": n})
    low, high = column_quantiles(df, [value], [0.01, 0.99])[value]
    middle = column_quantiles(df.where(F.col(value).isNotNull()), [t], [0.5])[t][0]
    bins = max(1, math.ceil((high - low) / step))
    top = low + bins * step
    a, b = (density_peaks(d, value, low, top, bins, prominence) for d in (df.where(F.col(t) < middle), df.where(F.col(t) >= middle)))
    if not a or len(a) != len(b):
        raise Refused(f"{len(a)} peaks in one half, {len(b)} in the other", {"first": a, "second": b})
    both = density_peaks(df, value, low, top, bins, prominence)
    return both if len(both) == len(a) else a


def channel_extent(df: DataFrame, z: str, r: str, frame: list[str]) -> tuple[float, float, float]:
    """Whole numbers around the 5th and 95th percentile of z, and the median of the frames' greatest r plus 1.5."""
    low, high = extent(df, z)
    widest = df.groupBy(*frame).agg(F.max(r).alias("_r"))
    return low, high, column_quantiles(widest, ["_r"], [0.5])["_r"][0] + 1.5


def closed_ring(atoms: DataFrame, frame: list[str], x: str, y: str, most: float = 120.0) -> DataFrame:
    """Whether a frame's atoms surround their own mean: the widest angle between neighbours around it is `most` degrees or
    less; a frame of less than three atoms is open."""
    c = atoms.groupBy(*frame).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"))
    d = atoms.join(c, frame).withColumn("_a", F.degrees(F.atan2(F.col(y) - F.col("_cy"), F.col(x) - F.col("_cx"))))
    gap = F.col("_a") - F.lag("_a").over(Window.partitionBy(*frame).orderBy("_a"))
    g = d.withColumn("_g", gap).groupBy(*frame).agg(F.count("*").alias("n"), F.max("_g").alias("_g"), F.min("_a").alias("_lo"), F.max("_a").alias("_hi"))
    widest = F.greatest("_g", 360 - (F.col("_hi") - F.col("_lo")))
    return g.select(*frame, "n", (F.coalesce(widest <= most, F.lit(False)) & (F.col("n") >= 3)).alias("closed"))


def gathered(steps: dict) -> tuple[dict, dict]:
    """What each step found, and what those that refused had by then: one refusal does not lose the others' results."""
    found, refused = {}, {}
    for name, step in steps.items():
        try:
            found[name] = step()
        except Refused as e:
            refused[name] = {"reason": str(e), "partial": e.partial}
    return found, refused


def crossing_scan(particles: DataFrame, unit: list[str], entity: str, species: str, cylinder: float, every: int, span: int, t: str = "t", axis: str = "z", plane: tuple[str, str] = ("x", "y"), box: str = "box", channel: str = "channel", membrane: str = "membrane", most_move: float = 0.25, parts: int | None = None) -> DataFrame:
    """Full passes of every species through the channel on frames sampled by time, by one ladder for all.

    particles: a row per unit, frame (t) and entity with its species, place and the box's length along the axis. Sampled are the
    first frames of the intervals of length `every` that begin within `span` of a unit's first frame. Places along the axis are taken
    from the mean of the `channel` rows by nearest image; the `membrane` rows' means below and above their median are the
    ends, and slab planes lie halfway between each and the middle. Every other species is followed.

    Returns per unit and species: n_frames, n_particles, n_passes, per_particle, net (upward passes less downward ones), flux_sign,
    and seam_move, the root mean square of the axial step between samples over the box's length. Where it is above `most_move`, a
    particle can cross the periodic seam between two samples unseen (steps without memory have 0.29): such a scan is refused,
    its n_passes and what follows from it are null. A species that is never sampled is absent.

    Frames are sampled by aggregates of (unit, t); what a frame measures is one exchange on it, and the ladder one on the
    particle, whose tracks are cut by time with `parts`.
    """
    from tidemark.operators import events
    from tidemark.functions.keys import minimum_image

    times = particles.select(*unit, t).distinct()
    begin = times.withColumn("_t0", F.min(t).over(Window.partitionBy(*unit)))
    begin = begin.where(F.col(t) - F.col("_t0") <= span).withColumn("_k", F.floor((F.col(t) - F.col("_t0")) / every))
    sampled = begin.groupBy(*unit, "_k").agg(F.min(t).alias(t)).drop("_k")
    frame = Window.partitionBy(*unit, t)
    is_ = lambda s: F.col(species) == s
    mean = lambda c: F.avg(F.when(is_(channel), F.col(c))).over(frame)
    d = particles.join(sampled, [*unit, t]).withColumns({"_cz": mean(axis), "_cx": mean(plane[0]), "_cy": mean(plane[1])})
    d = d.withColumns({"_z": minimum_image(F.col(axis) - F.col("_cz"), F.col(box)), "_r": F.hypot(F.col(plane[0]) - F.col("_cx"), F.col(plane[1]) - F.col("_cy"))})
    d = d.withColumn("_mid", F.median(F.when(is_(membrane), F.col("_z"))).over(frame))
    half = lambda low: F.avg(F.when(is_(membrane) & ((F.col("_z") < F.col("_mid")) if low else (F.col("_z") >= F.col("_mid"))), F.col("_z"))).over(frame)
    d = d.withColumns({"_low": half(True), "_high": half(False)}).where(~F.col(species).isin(channel, membrane))
    planes = events.zone_planes(F.col("_low"), F.col("_high"))
    d = d.withColumn("zone", events.zone(F.col("_z"), F.col("_r"), F.col("_low"), F.col("_high"), *planes, cylinder))
    track = [*unit, species, entity]
    d = d.withColumn("_before", F.lag("_z").over(Window.partitionBy(*track).orderBy(t)))
    step = minimum_image(F.col("_z") - F.col("_before"), F.col(box)) / F.col(box)
    d = d.withColumn("_wrap", F.coalesce(F.abs(F.col("_z") - F.col("_before")) > F.col(box) / 2, F.lit(False)))
    seen = d.groupBy(*unit, species).agg(F.count_distinct(t).alias("n_frames"), F.count_distinct(entity).alias("n_particles"), F.sqrt(F.avg(step * step)).alias("seam_move"))
    passes = events.ladder_events(d.select(*track, t, "zone", "_wrap"), track, t, "zone", "_wrap", parts)
    found = passes.groupBy(*unit, species).agg(F.count("*").alias("n_passes"), F.sum("direction").alias("net"))
    out = seen.join(found, [*unit, species], "left").fillna(0, ["n_passes", "net"])
    safe = F.coalesce(F.col("seam_move") <= most_move, F.lit(True))
    kept = {"n_passes": F.col("n_passes"), "per_particle": F.col("n_passes") / F.col("n_particles"), "net": F.col("net"), "flux_sign": F.signum(F.col("net")).cast("int")}
    return out.select(*unit, species, "n_frames", "n_particles", "seam_move", *[F.when(safe, v).alias(k) for k, v in kept.items()])
