"""Geometry that has no relational form: frames as arrays, a numpy kernel per frame, Spark over frames.

A frame is one row with arrays; frames are independent, so there is no shuffle here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def clearance(points: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Distance of each point (n, 3) to the nearest sphere's surface; infinite without spheres."""
    if not len(centres):
        return np.full(len(points), np.inf)
    d = np.sqrt(((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)) - radii[None, :]
    return d.min(axis=1)


class Disk:
    """Candidate centres in a plane: the axis, and rings of equal angles around it up to the search radius."""

    def __init__(self, radius: float, step: float, angles: int):
        self.rings = max(1, int(np.ceil(radius / step)))
        self.reach = self.rings * step
        turn = np.linspace(0.0, 2 * np.pi, angles, endpoint=False)
        r = np.arange(1, self.rings + 1) * step
        self.xy = np.stack([r[:, None] * np.cos(turn), r[:, None] * np.sin(turn)], axis=-1)

    def connected(self, open_: np.ndarray) -> np.ndarray:
        """Open cells (rings, angles) that the open axis reaches through open neighbours: grown from the
        inner ring until nothing is added."""
        seen = np.zeros_like(open_)
        seen[0] = open_[0]
        while True:
            grown = seen | np.roll(seen, 1, axis=1) | np.roll(seen, -1, axis=1)
            grown[1:] |= seen[:-1]
            grown[:-1] |= seen[1:]
            grown &= open_
            if (grown == seen).all():
                return seen
            seen = grown


def slice_radius(disk: Disk, xyz: np.ndarray, radii: np.ndarray, axis: np.ndarray, z: float, widest_gap: float) -> tuple[float | None, bool]:
    """Radius of the largest sphere centred in the plane and reachable from the axis, and whether its centre
    is on the outermost ring. None where the axis is covered, no sphere meets the plane, or those around the
    centre leave an angle wider than `widest_gap` degrees open."""
    at = lambda xy: np.concatenate([xy + axis, np.full((len(xy), 1), z)], axis=1)
    centre = clearance(at(np.zeros((1, 2))), xyz, radii)[0]
    if centre <= 0:
        return None, False
    rings, angles, _ = disk.xy.shape
    clear = clearance(at(disk.xy.reshape(-1, 2)), xyz, radii).reshape(rings, angles)
    inside = np.where(disk.connected(clear > 0), clear, -np.inf)
    k = int(inside.argmax())
    best, place, edge = (float(inside.flat[k]), disk.xy.reshape(-1, 2)[k], k // angles == rings - 1) if inside.flat[k] > centre else (float(centre), np.zeros(2), False)
    cut = np.abs(xyz[:, 2] - z) < radii
    d = xyz[cut, :2] - (axis + place)
    d = d[np.hypot(d[:, 0], d[:, 1]) < best + 2.0 * radii.max(initial=0.0)]
    if not len(d):
        return None, edge
    turn = np.sort(np.arctan2(d[:, 1], d[:, 0]))
    if np.degrees(np.diff(turn, append=turn[0] + 2 * np.pi).max()) > widest_gap:
        return None, edge
    return best, edge


def envelope_outliers(r: np.ndarray, z: np.ndarray, tolerance: float) -> np.ndarray:
    """Slices (NaN: not measured) that a sphere of another slice, shrunk by their distance, shows to be too
    small by more than the tolerance. Every slice is held against all that remain, until none goes."""
    gone = np.zeros(len(r), bool)
    while True:
        left = np.flatnonzero(~gone & ~np.isnan(r))
        if len(left) < 2:
            return gone
        bound = (r[left][None, :] - np.abs(z[left][:, None] - z[left][None, :])).max(axis=1)
        low = left[r[left] < bound - tolerance]
        if not len(low):
            return gone
        gone[low] = True


def profile(frames: DataFrame, offsets: list[float], keys: list[str], search: float = 6.0, step: float = 0.5, angles: int = 24, widest_gap: float = 120.0, tolerance: float = 0.05, pad: float = 8.0) -> DataFrame:
    """frames (keys, xyz array<double> of 3 n, radii array<double>, anchor array<double> of 3) to one row per
    slice: keys, z (offset), r (null where refused), boundary."""
    fields = [frames.schema[k] for k in keys]
    disk, z = Disk(search, step, angles), np.array(offsets)

    def run(batches):
        for batch in batches:
            rows, zs, rs, edges = [], [], [], []
            for i in range(batch.num_rows):
                xyz = np.array(batch.column("xyz")[i].as_py() or [], float).reshape(-1, 3)
                radii = np.array(batch.column("radii")[i].as_py() or [], float)
                anchor = np.array(batch.column("anchor")[i].as_py(), float)
                near = np.hypot(*(xyz[:, :2] - anchor[:2]).T) < disk.reach + pad + radii.max(initial=0.0)
                xyz, radii = xyz[near], radii[near]
                got = []
                for p in anchor[2] + z:
                    slab = np.abs(xyz[:, 2] - p) < pad + radii
                    got.append(slice_radius(disk, xyz[slab], radii[slab], anchor[:2], p, widest_gap) if slab.any() else (None, False))
                r = np.array([np.nan if g[0] is None else g[0] for g in got])
                r[envelope_outliers(r, z, tolerance)] = np.nan
                rows += [i] * len(z)
                zs += offsets
                rs += [None if np.isnan(x) else float(x) for x in r]
                edges += [bool(g[1]) for g in got]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(zs, pa.float64()), pa.array(rs, pa.float64()), pa.array(edges, pa.bool_())], names=[*keys, "z", "r", "boundary"])

    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("z", T.DoubleType()), T.StructField("r", T.DoubleType()), T.StructField("boundary", T.BooleanType())])
    return frames.select(*keys, "xyz", "radii", "anchor").mapInArrow(run, schema)


def superpose(frames: DataFrame, reference: list[float], keys: list[str], xyz: str = "xyz") -> DataFrame:
    """Frames moved and turned onto the reference (3 n numbers) with the least squared distance; a frame of
    another size is an error. Coordinates come back as one array<float>."""
    from pyspark.sql import types as T

    ref = np.array(reference, float).reshape(-1, 3)
    ref = ref - ref.mean(axis=0)
    schema = T.StructType([*(frames.schema[k] for k in keys), T.StructField(xyz, T.ArrayType(T.FloatType()))])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.column(xyz).to_pylist():
                p = np.array(row, float).reshape(-1, 3)
                if len(p) != len(ref):
                    raise ValueError(f"{len(p)} points in a frame, {len(ref)} in the reference")
                p = p - p.mean(axis=0)
                u, _, vt = np.linalg.svd(p.T @ ref)
                sign = np.sign(np.linalg.det(u @ vt))
                out.append((p @ u @ np.diag([1.0, 1.0, sign]) @ vt).astype(np.float32).ravel())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(out, pa.list_(pa.float32()))], names=[*keys, xyz])

    return frames.select(*keys, xyz).mapInArrow(run, schema)
