"""Scores of rows that models did not see: counted, put in order, calibrated and cut for many models in the same passes.

Scores are counted in blocks, dealt out once by ranges of (model, score), and kept; each Newton step of all calibrations is then a
job over them, and so are the thresholds. A model's scores are spread over as many parts as they need: what a task holds at once does
not grow with its rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.together import FEW, HELD, Search, added, design
from tidemark.operators.trees import assign, leaves

#: Scores of a group that a task shows the driver, for the cuts; different scores that a task counts together, and that a part has about.
SHOWN, BLOCK = 64, 1 << 19


@dataclass
class Scorer:
    """A fitted model over some of the packed columns, its (fold, label), the rotation or None, and its slot. `margins` has either
    ("trees", base, cuts, [(tree, values of its leaves)]) or ("linear", medians, mean, scale, coefficients, shift)."""

    at: tuple
    rotation: str | None
    slot: int
    pick: list[int]
    raw: bool  # the margin is the score
    margins: tuple

    def score(self, x: np.ndarray, missing: np.ndarray) -> np.ndarray:
        x, missing = x[:, self.pick], missing[:, self.pick]
        kind, *m = self.margins
        if kind == "trees":
            base, cuts, trees = m
            bins = np.empty((len(cuts), len(x)), np.int16)
            for j, e in enumerate(cuts):
                bins[j] = np.where(missing[:, j], -1, np.searchsorted(e, x[:, j], side="right"))
            out = np.full(len(x), base)
            for tree, value in trees:
                out += value[assign(tree, bins.T)]
        else:
            medians, mean, scale, theta, shift = m
            out = design(x, medians, mean, scale) @ theta - shift
        return out if self.raw else 1 / (1 + np.exp(-out))


def tree_scorers(found: Search, final: list[tuple], pick: list[int]) -> list[Scorer]:
    engine, out = found.engine, []
    for at, r, s in final:
        cuts = [np.array(e, np.float64) for e in engine.edges[engine.folds.index(at[0])]]
        out.append(Scorer(at, r, s.slot, pick, False, ("trees", s.base, cuts, [(t, np.array([x.value for x in leaves(t)])) for t in s.trees])))
    return out


def linear_scorers(medians: np.ndarray, final: list[tuple], mean: np.ndarray | None, scale: np.ndarray | None, pick: list[int], raw: bool) -> list[Scorer]:
    return [Scorer(at, r, i, pick, raw, ("linear", medians[i], mean[i], scale[i], theta, shift)) for at, r, i, theta, shift in final]


def own_scores(rows: DataFrame, kept: list[str], fold: Column, folds: list, models: list[tuple[str, Scorer]], names: list[tuple[str, str]]) -> DataFrame:
    """kept, arm, label, score of every row by its own fold's models; `rows` has `_x` and `_null`, names are the pairs of arm and label."""
    of = {(folds.index(m.at[0]), names.index((arm, m.at[1]))): m for arm, m in models}
    d = rows.select(*kept, "_x", "_null", (F.array_position(F.array(*[F.lit(f) for f in folds]), fold).cast("int") - 1).alias("_fold"))
    fields = [d.schema[c] for c in kept]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x, missing = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("_x", "_null"))
            own = batch.column("_fold").fill_null(-1).to_numpy(zero_copy_only=False)
            scores, there = np.zeros((n, len(names))), np.zeros((n, len(names)), bool)
            for (f, k), m in of.items():
                at = np.flatnonzero(own == f)
                if len(at):
                    scores[at, k], there[at, k] = m.score(x[at], missing[at]), True
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(names), pa.int32()), pa.array(scores.ravel(), mask=~there.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), lists], names=[*(f.name for f in fields), "_scores"])

    got = d.mapInArrow(run, T.StructType([*fields, T.StructField("_scores", T.ArrayType(T.DoubleType()))]))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(y).alias("label"), F.col("_scores")[k].alias("score")) for k, (a, y) in enumerate(names)]))
    return got.select(*kept, each.alias("_s")).select(*kept, "_s.*").where("score is not null")


def held_scores(chunks: RDD, models: list[tuple[int, int, Scorer]]) -> RDD:
    """Of packed rows, for each (group, column of the label, model) the logits of held rows' scores, each once, with positives and rows."""

    def run(parts):
        for role, ys, x, missing, *_ in parts:
            out = []
            for g, label, m in models:
                rows = np.flatnonzero(role[:, m.slot] == HELD)
                if len(rows):
                    p = np.clip(m.score(x[rows], missing[rows]), 1e-7, 1 - 1e-7)
                    out.append((g, *_counted(np.log(p / (1 - p)), ys[rows, label], np.ones(len(rows)))))
            yield out

    return chunks.mapPartitions(run)


def _counted(value: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    found, at = np.unique(value, return_inverse=True)
    return found, *(np.bincount(at, w, len(found)) for w in weights)


def _by_group(parts) -> list[tuple]:
    """(group, value, positives, rows) of all parts together, counts in as few bytes as they need."""
    of: dict[int, list] = {}
    for part in parts:
        for g, *x in part:
            of.setdefault(g, []).append(x)
    out = []
    for g in sorted(of):
        value, *counts = _counted(*(np.concatenate(v) for v in zip(*of.pop(g), strict=True)))
        out.append((g, value, *(c.astype(np.min_scalar_type(int(c.max()))) for c in counts)))
    return out


def _blocks(parts, block: int):
    """Scores of as many chunks together as a block holds."""
    taken, size = [], 0
    for part in parts:
        taken.append(part)
        size += sum(len(value) for _, value, *_ in part)
        if size >= block:
            yield _by_group(taken)
            taken, size = [], 0
    if taken:
        yield _by_group(taken)


def _steps(values: np.ndarray, weight: np.ndarray, start: float) -> np.ndarray:
    """SHOWN of the values at even steps of their weight, from a share of a step on: tasks of like values then show different ones."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(weight[order])
    return values[order][np.searchsorted(upto[:-1], (np.arange(SHOWN) + start) / SHOWN * upto[-1], side="right")]


def in_order(held: RDD, least: int, block: int = BLOCK) -> tuple[RDD, dict[int, np.ndarray]]:
    """The counted values dealt out by ranges of (group, value), equal ones together, each part in order; and each group's positives and rows.
    The ranges hold about equal numbers of values, a block or less, by what each task shows of its values. The caller unpersists the parts."""
    kept = held.mapPartitions(lambda parts: _blocks(parts, block)).persist(StorageLevel.MEMORY_AND_DISK)

    def shown(i, parts):
        totals: dict[int, np.ndarray] = {}
        points: dict[int, list] = {}
        for k, part in enumerate(parts):
            for g, value, tp, n in part:
                totals[g] = totals.get(g, 0) + np.array([tp.sum(), n.sum(), len(value)], np.int64)
                points.setdefault(g, []).append((_steps(value, np.ones(len(value)), k * 0.618 % 1), np.full(SHOWN, len(value) / SHOWN)))
        for g, found in points.items():
            yield g, totals[g], _steps(*(np.concatenate(v) for v in zip(*found, strict=True)), i * 0.618 % 1)

    totals: dict[int, np.ndarray] = {}
    points: dict[int, list] = {}
    for g, total, values in kept.mapPartitionsWithIndex(shown).collect():
        totals[g] = totals.get(g, 0) + total
        points.setdefault(g, []).append((values, np.full(SHOWN, total[2] / SHOWN)))
    size = sum(int(t[2]) for t in totals.values())
    n_parts = max(least, -(-size // block))
    share, filled, part = size / n_parts, 0.0, 0
    first, cuts = {}, {}
    for g in sorted(points):
        values, weight = (np.concatenate(v) for v in zip(*points[g], strict=True))
        order, found = np.argsort(values, kind="stable"), []
        first[g] = part
        for v, w in zip(values[order], weight[order], strict=True):
            filled += w
            if filled >= share and (not found or v > found[-1]):
                found.append(v)
                part, filled = part + 1, 0.0
        cuts[g] = np.array(found)

    def dealt(parts):
        for rows in parts:
            for g, value, *counts in rows:
                ends = [0, *np.searchsorted(value, cuts[g], side="right").tolist(), len(value)]
                for k, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if z > a:
                        yield first[g] + k, (g, value[a:z], *(c[a:z] for c in counts))

    dealt_out = kept.mapPartitions(dealt).partitionBy(part + 1, lambda k: k)
    ordered = dealt_out.mapPartitions(lambda rows: [_by_group([x] for _, x in rows)], preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)
    ordered.count()
    kept.unpersist()
    return ordered, {g: t[:2] for g, t in totals.items()}


def lines(chunks: RDD, n: int, groups: np.ndarray, most: int = 50) -> np.ndarray:
    """Slope and intercept of a logistic fit of y on x for each of n groups, those marked in `groups`; chunks of (group, x, share of ones, rows)."""
    at, going = np.tile([1.0, 0.0], (n, 1)), groups.copy()
    for _ in range(most):
        if not going.any():
            break

        def run(parts, at=at.copy(), going=going.copy()):
            total = np.zeros((5, n))
            for g, x, y, count in parts:
                on = going[g]
                g, x, y, count = g[on], x[on], y[on], count[on]
                q = 1 / (1 + np.exp(-(at[g, 0] * x + at[g, 1])))
                r, w = count * (q - y), count * q * (1 - q)
                total += np.stack([np.bincount(g, v, n) for v in (r * x, r, w * x * x, w * x, w)])
            yield 0, total

        ga, gb, haa, hab, hbb = added(chunks.mapPartitions(run))[0]
        det = (haa + 1e-12) * (hbb + 1e-12) - hab**2
        with np.errstate(all="ignore"):
            step = np.stack([((hbb + 1e-12) * ga - hab * gb) / det, ((haa + 1e-12) * gb - hab * ga) / det], axis=1)
        far = np.abs(step).max(axis=1)
        cut = np.minimum(1.0, 4 / np.maximum(far, 1e-300))  # steps of at most 4: the start may be far off
        at[going] -= (cut[:, None] * step)[going]
        going &= ~((far < 1e-9) | (np.abs(at[:, 0]) > 1e4))
    return at


def calibrated_cuts(chunks: RDD, models: list[tuple[int, int, Scorer]], n: int, least: int) -> dict[int, tuple[float, float, float]]:
    """Slope, intercept and the threshold of the best F1 (the lowest of equal ones) of each group's held scores; groups of one class are absent."""
    ordered, totals = in_order(held_scores(chunks, models), least)
    both = np.array([g in totals and 0 < totals[g][0] < totals[g][1] for g in range(n)])

    def whole(parts):
        for part in parts:
            if part:
                yield tuple(np.concatenate(v) for v in zip(*((np.full(len(value), g), value, tp / k, k) for g, value, tp, k in part), strict=True))

    at = lines(ordered.coalesce(max(FEW, least)).mapPartitions(whole), n, both)

    def probs(g, value):
        return 1 / (1 + np.exp(-(value * at[g, 0] + at[g, 1])))

    def tops(i, parts):
        for part in parts:
            for g, value, tp, k in part:
                if both[g]:
                    yield g, i, float(probs(g, value)[-1 if at[g, 0] >= 0 else 0]), tp.sum(), k.sum()

    # What lies above each part, and the probability that the part below begins with: equal ones are cut together.
    above: dict[tuple[int, int], tuple] = {}
    order: dict[int, list] = {}
    for g, i, *x in ordered.mapPartitionsWithIndex(tops).collect():
        order.setdefault(g, []).append((i, *x))
    for g, found in order.items():
        found.sort(reverse=bool(at[g, 0] >= 0))
        tp = k = 0.0
        for here, below in zip(found, [*found[1:], None], strict=True):
            above[g, here[0]] = tp, k, below and below[1]
            tp, k = tp + here[2], k + here[3]

    def best(i, parts):
        for part in parts:
            for g, value, tp, k in part:
                if both[g]:
                    down = slice(None, None, -1 if at[g, 0] >= 0 else 1)
                    tp0, k0, below = above[g, i]
                    p, tps, ks = probs(g, value)[down], tp0 + np.cumsum(tp[down]), k0 + np.cumsum(k[down])
                    last = np.append(p[:-1] != p[1:], below is None or p[-1] != below)
                    precision, recall = tps / ks, tps / totals[g][0]
                    f1 = np.where(last & (tps > 0), 2 * precision * recall / np.where(tps > 0, precision + recall, 1), np.where(last, 0.0, -1.0))
                    yield g, float(f1.max()), float(p[f1 == f1.max()].min())

    cut: dict[int, tuple] = {}
    for g, f1, p in ordered.mapPartitionsWithIndex(best).collect():
        cut[g] = max(cut.get(g, (-1.0, 0.0)), (f1, -p))
    ordered.unpersist()
    return {g: (float(at[g, 0]), float(at[g, 1]), -low) for g, (_, low) in cut.items()}
