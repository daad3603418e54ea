"""Boosted trees on histograms: missing values have a learned side, leaves a least weight in events.

Feature values are binned once. Each level of each tree is one Spark aggregate (see `together`, which grows any number of
models in the same passes); this is one model with its predictions and exact Shapley values.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.together import Boosters, Slot, Spec, binned, logit, slot_counts
from tidemark.operators.trees import Node, assign, leaves


class BoostedTrees:
    def __init__(self, columns: list[str], rounds: int = 100, depth: int = 3, rate: float = 0.05, penalty: float = 1.0, least_hessian: float = 1.0, bins: int = 32, patience: int | None = None, monotone: dict[str, int] | None = None):
        self.columns, self.rounds, self.depth, self.rate = columns, rounds, depth, rate
        self.penalty, self.least, self.bins, self.patience = penalty, least_hessian, bins, patience
        self.monotone = [(monotone or {}).get(c, 0) for c in columns]
        self.trees: list[Node] = []
        self.base = 0.0
        self.edges: list[list[float]] = []
        self.losses: list[float] = []

    @classmethod
    def of(cls, columns: list[str], edges: list[list[float]], spec: Spec) -> BoostedTrees:
        """One of many models that were grown together."""
        out = cls(columns, len(spec.trees), spec.depth, spec.rate, spec.penalty, spec.least)
        out.trees, out.base, out.edges, out.losses = spec.trees, spec.base, edges, spec.losses
        return out

    def _binned(self, df: DataFrame):
        """Number of edges at or below each value; -1 for missing."""
        return F.array(*binned(self.columns, self.edges))

    def fit(self, df: DataFrame, y: str = "y", watch: DataFrame | None = None) -> BoostedTrees:
        """Fit on df; with `watch` and patience, stop when its log-loss has not improved for so many rounds
        and keep the best number of trees."""
        part = lambda d, train: d.select(F.col(y).cast("int").alias("_label"), *self.columns, F.lit(train).alias("_train"))
        d = part(df, True) if watch is None else part(df, True).unionByName(part(watch, False))
        slot = Slot(0, "whole", "_label", F.col("_train"), None if watch is None else ~F.col("_train"))
        c = slot_counts(d, [slot])[0]
        if not 0 < c["p"] < c["n"]:
            raise ValueError("training rows of one class")
        self.base = logit(c["p"] / c["n"])
        grown = Boosters(d, self.columns, [slot], [0], [F.col("_train")], bins=self.bins, monotone=dict(zip(self.columns, self.monotone, strict=True)))
        spec = Spec(0, self.depth, self.least, self.rounds, self.patience, self.rate, self.penalty, base=self.base)
        grown.grow([spec])
        grown.free()
        self.edges, self.trees, self.losses = grown.edges[0], spec.trees, spec.losses
        if watch is not None and self.patience:
            self.trees = self.trees[: spec.best_round]
        return self

    def predict(self, df: DataFrame, name: str = "prob") -> DataFrame:
        """df with the probability."""
        trees, base = self.trees, self.base
        values = [np.array([x.value for x in leaves(t)]) for t in trees]

        @F.pandas_udf("double")
        def margin(b):
            bins = np.array(b.tolist(), np.int64).reshape(len(b), -1)
            out = np.full(len(b), base)
            for t, v in zip(trees, values, strict=True):
                out += v[assign(t, bins)]
            import pandas as pd

            return pd.Series(out)

        return df.withColumn(name, 1 / (1 + F.exp(-margin(self._binned(df)))))

    def contributions(self, df: DataFrame, name: str = "contributions") -> DataFrame:
        """df with Shapley values of the margin per column (an array); their sum is the margin less the
        expected margin."""
        paths = [q for t in self.trees for q in _paths(t)]
        p = len(self.columns)

        @F.pandas_udf("array<double>")
        def shap(b):
            bins = np.array(b.tolist(), np.int64).reshape(len(b), -1)
            out = np.zeros((len(bins), p))
            for value, steps in paths:
                _add(out, bins, value, steps)
            import pandas as pd

            return pd.Series(list(out))

        return df.withColumn(name, shap(self._binned(df)))

    def expected_margin(self) -> float:
        return self.base + sum(v * math.prod(z for _, z in s.values()) for t in self.trees for v, s in _paths(t))


def fold_contributions(df: DataFrame, columns: list[str], models: dict, fold: str, keys: list[str]) -> DataFrame:
    """Shapley values of every row's margin by its own fold's trees, exact, in one pass: keys, fold, margin, expected (the margin that
    knows no column) and contributions (a map by column); they sum to margin less expected. models: (edges, Spec) by fold; rows of other folds are left out."""
    import pyarrow as pa
    from pyspark.sql import types as T

    names = list(models)
    number = F.coalesce(*[F.when(F.col(fold) == F.lit(f), F.lit(i)) for i, f in enumerate(names)])
    bins = F.coalesce(*[F.when(F.col(fold) == F.lit(f), F.array(*binned(columns, models[f][0]))) for f in names])
    rows = df.select(*keys, fold, number.alias("_model"), bins.alias("_bins")).where("_model is not null")
    base = [models[f][1].base for f in names]
    paths = [[q for t in models[f][1].trees for q in _paths(t)] for f in names]
    expected = [b + sum(v * math.prod(z for _, z in s.values()) for v, s in p) for b, p in zip(base, paths, strict=True)]
    kept = [rows.schema[c] for c in [*keys, fold]]
    schema = T.StructType([*kept, T.StructField("margin", T.DoubleType()), T.StructField("expected", T.DoubleType()), T.StructField("_parts", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            model = batch.column("_model").to_numpy()
            x = batch.column("_bins").flatten().to_numpy().astype(np.int64).reshape(n, -1)
            parts, low = np.zeros((n, x.shape[1])), np.zeros(n)
            for m in np.unique(model):
                own = np.flatnonzero(model == m)
                out = np.zeros((len(own), x.shape[1]))
                for value, steps in paths[m]:
                    _add(out, x[own], value, steps)
                parts[own], low[own] = out, expected[m]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(parts.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c.name) for c in kept), pa.array(low + parts.sum(axis=1)), pa.array(low), lists], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select(*keys, fold, "margin", "expected", F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), "_parts").alias("contributions"))


def _paths(tree: Node) -> list[tuple[float, dict[int, tuple[list, float]]]]:
    """Each leaf's value and, by feature on its path, the conditions and the share of cover that meets them."""
    out = []

    def walk(node: Node, steps: dict[int, tuple[list, float]]) -> None:
        if not node.children:
            out.append((node.value, steps))
            return
        total = sum(c.cover for c in node.children) or 1.0
        for side, child in enumerate(node.children):
            tests, share = steps.get(node.feature, ([], 1.0))
            walk(child, steps | {node.feature: ([*tests, (node.cut, node.missing_left, side == 0)], share * child.cover / total)})

    walk(tree, {})
    return out


def _add(out: np.ndarray, bins: np.ndarray, value: float, steps: dict[int, tuple[list, float]]) -> None:
    """Shapley values of one leaf seen as a game in which a feature that is present passes its own
    conditions or not, and one that is absent passes with its share of cover."""
    features = list(steps)
    m = len(features)
    if not m:
        return
    passes, share = [], []
    for f in features:
        ok = np.ones(len(bins), bool)
        for cut, missing_left, left in steps[f][0]:
            b = bins[:, f]
            ok &= np.where(b < 0, missing_left, b < cut) == left
        passes.append(ok)
        share.append(steps[f][1])
    if m > MOST_TABLED:
        out[:, features] += value * _game([p.astype(float) for p in passes], share)
        return
    pattern = sum(p.astype(np.int64) << i for i, p in enumerate(passes))
    out[:, features] += (value * _games(tuple(share)))[pattern]


#: Features on a path up to which its 2 ** m outcomes are tabled.
MOST_TABLED = 6


@functools.lru_cache(100_000)
def _games(share: tuple[float, ...]) -> np.ndarray:
    """Shapley values of a leaf of value 1 for each set of features that pass, a row per set (feature i is bit i)."""
    sets = np.arange(1 << len(share))
    return _game([(sets >> i & 1).astype(float) for i in range(len(share))], list(share))


def _game(passes: list[np.ndarray], share: list[float]) -> np.ndarray:
    m, out = len(share), []
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        total = np.zeros(len(passes[0]))
        for size in range(m):
            weight = math.factorial(size) * math.factorial(m - size - 1) / math.factorial(m)
            for chosen in itertools.combinations(rest, size):
                term = np.full(len(passes[0]), weight)
                for j in rest:
                    term = term * (passes[j] if j in chosen else share[j])
                total += term
        out.append((passes[i] - share[i]) * total)
    return np.stack(out, axis=1)
