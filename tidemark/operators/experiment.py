"""The training loop: arms fitted per held-out fold, calibrated and cut on inner out-of-fold scores, named when they
cannot be fitted. Folds, arms and their parameters live on the driver; rows stay in Spark.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import metrics
from tidemark.operators.boosting import BoostedTrees
from tidemark.operators.held import calibrated_cuts, linear_scorers, lines, own_scores, tree_scorers
from tidemark.operators.models import Calibrator, MissingEncoder, PartialLeastSquares, RidgeLogistic, Standardiser, active_columns, grid_search
from tidemark.operators.splits import refuse_overlap, time_blocks
from tidemark.operators.together import Designs, Slot, ablate_trees, linear_models, pack_rows, packed, packed_counts, plan_slots, rate_components, rate_ridges, refit_trees, search_trees, settle, slot_counts, tree_models

MOST_FOLDS = 1000
#: Columns that `Fitted` adds.
SCORE, PROB = "_arm_score", "_arm_prob"


@dataclass
class Arm:
    """A way to score rows: "ridge" or "trees" over columns, "pls" over columns, or "rule", whose score is minus a
    column and which has no probability. Columns that a table lacks are left out."""

    name: str
    kind: str
    columns: list[str]
    options: dict = field(default_factory=dict)

    def without(self, columns: list[str]) -> Arm:
        return Arm(self.name, self.kind, [c for c in self.columns if c not in columns], self.options)


class Fitted:
    """An arm with what it learned: encoder, scaler, model, calibration, threshold."""

    def __init__(self, arm: Arm):
        self.arm, self.columns = arm, list(arm.columns)
        self.encoder = self.scaler = self.model = None
        self.calibrator, self.threshold = Calibrator(), None

    def fit(self, df: DataFrame, y: str = "y") -> Fitted:
        kind, options = self.arm.kind, dict(self.arm.options)
        self.columns = [c for c in self.arm.columns if c in df.columns]
        if not self.columns:
            raise ValueError("none of its columns is there")
        if kind == "rule":
            return self
        if kind == "trees":
            self.columns = active_columns(df, self.columns)
            self.model = BoostedTrees(self.columns, **options).fit(df, y)
            return self
        self.encoder = MissingEncoder(self.columns).fit(df)
        names = [*self.columns, *[f"{c}_missing" for c in self.columns]]
        d = self.encoder.transform(df)
        names = active_columns(d, names)
        if not names:
            raise ValueError("no column varies")
        self.scaler = Standardiser(names).fit(d)
        d = self.scaler.transform(d)
        if kind == "ridge":
            self.model = RidgeLogistic(names, **options).fit(d, y)
        elif kind == "pls":
            self.model = PartialLeastSquares(min(options.get("k", 2), len(names))).fit(d.withColumn("_x", F.array(*[F.col(c).cast("double") for c in names])), "_x", y)
        else:
            raise ValueError(f"an arm of unknown kind {kind}")
        return self

    def score(self, df: DataFrame, name: str = SCORE) -> DataFrame:
        """df with the raw score as a further column."""
        kept = df.columns
        if self.arm.kind == "rule":
            return df.withColumn(name, -F.col(self.columns[0]))
        if self.arm.kind == "trees":
            return self.model.predict(df, name).select(*kept, name)
        own = df.select("*", *[F.col(c).alias(f"_own_{c}") for c in self.columns])
        d = self.scaler.transform(self.encoder.transform(own))
        if self.arm.kind == "ridge":
            d = self.model.predict(d, name)
        else:
            d = self.model.predict(d.withColumn("_x", F.array(*[F.col(c).cast("double") for c in self.scaler.columns])), "_x", name)
        return d.select(*[F.col(f"_own_{c}").alias(c) if c in self.columns else F.col(c) for c in kept], name)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with the raw score and the calibrated probability (null for a rule) as further columns."""
        d = self.score(df)
        return d.withColumn(PROB, F.lit(None).cast("double")) if self.arm.kind == "rule" else self.calibrator.transform(d, SCORE, PROB)

    def calibrate(self, oof: DataFrame, y: str = "y") -> Fitted:
        """Calibration and threshold of the best F1 from scores that this model did not learn from."""
        if self.arm.kind != "rule":
            self.calibrator = Calibrator().fit(oof, "score", y)
            d = self.calibrator.transform(oof).where("prob is not null")
            self.threshold = metrics.f1_threshold(d, [], y, "prob").first().threshold
        return self


def groups_of(df: DataFrame, group: str) -> list:
    names = [r[0] for r in df.where(F.col(group).isNotNull()).select(group).distinct().orderBy(group).limit(MOST_FOLDS + 1).collect()]
    if len(names) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds; assign groups to fewer")
    return names


def out_of_fold(df: DataFrame, arm: Arm, group: str, keys: list[str], y: str = "y") -> tuple[DataFrame | None, dict]:
    """Scores of every row by a model fitted without its group, and the groups for which none could be, with why."""
    parts, skipped = [], {}
    for g in groups_of(df, group):
        train, test = df.where(~F.col(group).eqNullSafe(F.lit(g))), df.where(F.col(group) == F.lit(g))
        try:
            parts.append(Fitted(arm).fit(train, y).score(test).select(*keys, group, y, F.col(SCORE).alias("score")))
        except ValueError as e:
            skipped[g] = str(e)
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out, skipped


def choose_penalty(df: DataFrame, columns: list[str], group: str, cs: list[float], y: str = "y") -> tuple[float, bool]:
    """C of the least mean log-loss over groups, and whether balanced class weights lower the loss at the middle C."""
    losses = grid_search(df, columns, group, cs, y)
    best = min(cs, key=lambda c: (losses[c], c))
    middle = sorted(cs)[len(cs) // 2]
    p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = []
    for balanced in (False, True):
        oof, _ = out_of_fold(df, Arm("w", "ridge", columns, {"c": middle, "balanced": balanced}), group, [], y)
        loss.append(oof.agg(F.avg(-(F.col(y) * F.log(p) + (1 - F.col(y)) * F.log(1 - p)))).first()[0] if oof is not None else float("inf"))
    return best, loss[1] < loss[0]


def choose_components(df: DataFrame, columns: list[str], group: str, ks: list[int], y: str = "y") -> int:
    """Number of components with the greatest mean correlation of score and outcome over held-out groups."""
    best = (float("-inf"), 0)
    for k in sorted(k for k in ks if k <= len(columns)):
        oof, _ = out_of_fold(df, Arm("pls", "pls", columns, {"k": k}), group, [], y)
        r = oof.groupBy(group).agg(F.corr("score", y).alias("r")).agg(F.avg("r")).first()[0] if oof is not None else None
        if r is not None and r > best[0] + 1e-12:
            best = (r, k)
    if not best[1]:
        raise ValueError("no number of components can be rated")
    return best[1]


def choose_rounds(df: DataFrame, arm: Arm, group: str, y: str = "y") -> int:
    """Median over groups of the number of trees that the held-out group's loss stops at."""
    found = []
    for g in groups_of(df, group):
        train, test = df.where(~F.col(group).eqNullSafe(F.lit(g))), df.where(F.col(group) == F.lit(g))
        try:
            m = BoostedTrees(active_columns(train, arm.columns), **{"patience": 10, **arm.options}).fit(train, y, watch=test)
        except ValueError:
            continue
        found.append(len(m.trees))
    if not found:
        raise ValueError("no group can be held out")
    return max(1, sorted(found)[len(found) // 2])


def train_folds(df: DataFrame, arms: list[Arm], fold: str, keys: list[str], y: str = "y", valid: str = "valid", inner: str | None = None, leak: list[str] | None = None) -> tuple[DataFrame, list[dict]]:
    """Every arm on every fold: fitted on valid rows of the other folds, calibrated and cut on their scores out of inner
    folds (`inner`, by default the other folds themselves), applied to the fold's rows. Returns rows (keys, fold, y,
    valid, arm, score, prob) and a record for each (fold, arm) with its threshold, or the reason why it is absent.
    `leak` names columns of which no value may be on both sides."""
    rows, record = None, []
    for g in groups_of(df, fold):
        train, test = df.where(~F.col(fold).eqNullSafe(F.lit(g)) & F.col(valid)), df.where(F.col(fold) == F.lit(g))
        if leak:
            refuse_overlap(train, test, leak)
        n, p = train.agg(F.count("*"), F.coalesce(F.sum(y), F.lit(0))).first()
        for arm in arms:
            entry = {"fold": g, "arm": arm.name}
            record.append(entry)
            if arm.kind != "rule" and (not p or p == n):
                entry["skipped"] = "training rows of one class"
                continue
            try:
                fitted = Fitted(arm).fit(train, y)
                if arm.kind != "rule":
                    oof, lost = out_of_fold(train, arm, inner or fold, keys, y)
                    if oof is None:
                        raise ValueError("no inner fold can be fitted")
                    fitted.calibrate(oof, y)
                    entry |= {"threshold": fitted.threshold, "calibrated": fitted.calibrator.fitted, "inner_skipped": lost}
                part = fitted.predict(test).select(*keys, fold, y, valid, F.lit(arm.name).alias("arm"), F.col(SCORE).alias("score"), F.col(PROB).alias("prob"))
            except ValueError as e:
                entry["skipped"] = str(e)
                continue
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no arm could be fitted on any fold")
    return rows, record


MOST_SLOTS = 2000


def mark_starts(df: DataFrame, labels: dict[str, str], unit: list[str], t: str = "t") -> tuple[DataFrame, dict[str, str]]:
    """df with a column per label that marks the first valid positive row of each run in a unit, and their names."""
    w, names = Window.partitionBy(*unit).orderBy(t), {}
    for y, valid in labels.items():
        names[y] = f"_start_{y}"
        on = F.when(F.col(valid), F.col(y) == 1)
        df = df.withColumn(names[y], (on & ~F.coalesce(F.last(on, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).cast("int"))
    return df, names


def fold_plan(df: DataFrame, fold: str, labels: dict[str, str], inner: str | None = None, unit: list[str] | None = None, t: str = "t", embargo: int | None = None, blocks: int = 2) -> dict:
    """Training sets of every (fold, label): the valid rows of other folds, and its rotations, which hold out one group of `inner`
    (by default the other folds) after the other. Where no rotation has both classes on both sides and units are given, each unit of both
    classes is cut into blocks of equal duration instead, and each block is held out once, with rows nearer than the embargo
    left out; the entry is then marked as blocked. Rows without a group only train."""
    plan = _whole_plan(df, fold, labels, inner or fold)
    if unit is not None and embargo is not None:
        _cut_blocks(df, plan, slot_counts(df, plan_slots(plan)[0]), unit, t, embargo, blocks)
    return plan


def _packed_plan(df: DataFrame, fold: str, labels: dict[str, str], inner: str | None, unit: list[str] | None, t: str, embargo: int | None, blocks: int, starts: dict[str, str] | None, columns: list[str]) -> tuple[dict, RDD, list[dict]]:
    """fold_plan, and the packed rows of its slots with their counts."""
    plan = _whole_plan(df, fold, labels, inner or fold)
    chunks = pack_rows(df, columns, slots := plan_slots(plan)[0], starts)
    counts = packed_counts(chunks, slots)
    if unit is not None and embargo is not None and _cut_blocks(df, plan, counts, unit, t, embargo, blocks):
        chunks.unpersist()
        chunks = pack_rows(df, columns, slots := plan_slots(plan)[0], starts)
        counts = packed_counts(chunks, slots)
    return plan, chunks, counts


def _whole_plan(df: DataFrame, fold: str, labels: dict[str, str], inner: str) -> dict:
    found = df.select(F.col(fold).alias("f"), F.col(inner).alias("g")).distinct().limit((MOST_FOLDS + 1) * 12).collect()
    folds = sorted({r.f for r in found if r.f is not None})
    if len(folds) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds; assign groups to fewer")
    pairs = [r for r in found if r.g is not None]
    groups = sorted({r.g for r in pairs})
    if len(folds) * len(groups) * len(labels) > MOST_SLOTS or len(pairs) > MOST_FOLDS * 10:
        raise ValueError(f"more than {MOST_SLOTS} training sets; give fewer folds, or `inner` groups")
    plan = {}
    for f in folds:
        here = [g for g in groups if any(r.g == g and r.f != f for r in pairs)]
        for y, valid in labels.items():
            whole = ~F.col(fold).eqNullSafe(F.lit(f)) & F.col(valid)
            rotations = [Slot(f, str(g), y, whole & ~F.col(inner).eqNullSafe(F.lit(g)), whole & (F.col(inner) == F.lit(g))) for g in here]
            plan[f, y] = {"whole": Slot(f, "whole", y, whole), "rotations": rotations, "blocked": False}
    return plan


def _cut_blocks(df: DataFrame, plan: dict, counts: list[dict], unit: list[str], t: str, embargo: int, blocks: int) -> bool:
    """Cuts units into blocks where no rotation has both classes on both sides, and tells whether there were any."""
    first, cut = plan_slots(plan)[1], []
    for at, e in plan.items():
        if not any(0 < c["p"] < c["n"] and 0 < c["q"] < c["m"] for c in counts[first[at] + 1 : first[at] + 1 + len(e["rotations"])]):
            cut.append(at)
    for at in cut:
        plan[at]["rotations"], plan[at]["blocked"] = _block_slots(df, at, plan[at]["whole"].train, unit, t, embargo, blocks), True
    return bool(cut)


def _block_slots(df: DataFrame, at: tuple, train, unit: list[str], t: str, embargo: int, blocks: int) -> list[Slot]:
    f, y = at
    span = df.where(train).groupBy(*unit).agg(F.min(t).alias("_a"), F.max(t).alias("_z"), F.min(y).alias("_lo"), F.max(y).alias("_hi")).where("_lo <> _hi")
    rows = span.orderBy(*unit).limit(MOST_FOLDS + 1).collect()
    if len(rows) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} units to cut into blocks; give inner groups")
    out = []
    for r in rows:
        same, width = F.lit(True), (r["_z"] - r["_a"]) / blocks
        for u in unit:
            same = same & F.col(u).eqNullSafe(F.lit(r[u]))
        for b in range(blocks):
            lo, hi = r["_a"] + width * b, r["_a"] + width * (b + 1)
            inside = (F.col(t) >= lo) & ((F.col(t) < hi) if b < blocks - 1 else (F.col(t) <= hi))
            far = (F.col(t) < lo - embargo) | (F.col(t) >= hi + embargo)
            out.append(Slot(f, "/".join(str(r[u]) for u in unit) + f"#block{b}", y, train & (~same | (far & ~inside)), train & same & inside))
    return out


def calibrate_together(oof: DataFrame, by: list[str], score: str = "score", y: str = "y", most: int = 50, times: str | None = None) -> DataFrame:
    """by, a, b: slope and intercept of a logistic fit of y on the logit of the score, for all groups in the same Newton steps, one
    job each over packed rows. Groups of one class are left out. Groups are few: models, not units. `times` names a column of how many rows a row
    stands for; y is then the share of ones among them."""
    p = F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    d = oof.where(F.col(score).isNotNull() & F.col(y).isNotNull()).select(*by, F.log(p / (1 - p)).alias("_l"), F.col(y).cast("double").alias("_y"), (F.col(times) if times else F.lit(1)).cast("double").alias("_w"))
    spark, schema = oof.sparkSession, T.StructType([*(oof.schema[c] for c in by), T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])
    both = d.groupBy(*by).agg(F.min("_y").alias("lo"), F.max("_y").alias("hi")).where("lo < 1 and hi > 0").limit(MOST_SLOTS * 10 + 1).collect()
    if len(both) > MOST_SLOTS * 10:
        raise ValueError("too many groups to calibrate")
    names = [tuple(r[c] for c in by) for r in both]
    if not names:
        return spark.createDataFrame([], schema)
    numbers = spark.createDataFrame([(*k, i) for i, k in enumerate(names)], T.StructType([*schema.fields[: len(by)], T.StructField("_g", T.IntegerType())]))
    chunks = packed(d.join(F.broadcast(numbers), by), {"_g": np.int32, "_l": np.float64, "_y": np.float64, "_w": np.float64})
    at = lines(chunks, len(names), np.ones(len(names), bool), most)
    chunks.unpersist()
    return spark.createDataFrame([(*k, *map(float, v)) for k, v in zip(names, at, strict=True)], schema)


def train_tuned(df: DataFrame, arms: list[Arm], fold: str, keys: list[str], labels: dict[str, str], inner: str | None = None, unit: list[str] | None = None, t: str = "t", embargo: int | None = None, blocks: int = 2, leak: list[str] | None = None, seed: int = 0) -> tuple[DataFrame, list[dict], dict]:
    """Every arm tuned, fitted, calibrated and cut in every fold for every label (a horizon: its name and that of its validity).

    Arms: "trees" with options grid (a list of points), rounds, patience, rate; "ridge" with cs, weighting; "pls" with components; "rule".
    All folds, labels, rotations and grid points of an arm share their passes over the rows (see `together`). Scores of rotations
    calibrate (a logistic fit on the logit) and give the threshold of the best F1, both from rows their models did not see.
    Returns rows (keys, fold, label, y, valid, arm, score, prob, threshold) of each fold's own rows, a record for each (arm, fold, label) with what
    was chosen or why it is absent, and the models by (arm, fold, label)."""
    clash = {"label", "model_fold", "rotation", "margin", "arm", "score", "prob", "threshold", "a", "b"} & {*keys, fold}
    if clash:
        raise ValueError(f"columns that the result has itself: {sorted(clash)}")
    starts = None
    if unit is not None:
        df, starts = mark_starts(df, labels, unit, t)
    df = settle(df.withColumn("_truth", _truth(labels)))  # every arm reads it, several times
    _refuse_leaks(df, fold, leak)
    among = list(dict.fromkeys(c for a in arms if a.kind != "rule" for c in a.columns if c in df.columns))
    plan, chunks, counts = _packed_plan(df, fold, labels, inner, unit, t, embargo, blocks, starts, among)
    slots, _ = plan_slots(plan)
    scores, scorers, record, models, designs = [], [], [], {}, {}
    for arm in arms:
        columns, o = [c for c in arm.columns if c in df.columns], arm.options
        if not columns:
            record += [{"arm": arm.name, "fold": f, "label": y, "skipped": "none of its columns is there"} for f, y in plan]
            continue
        if arm.kind == "rule":
            each = F.explode(F.array(*[F.lit(y) for y in labels])).alias("label")
            scores.append(df.where(F.col(fold).isNotNull()).select(*keys, fold, "_truth", each, F.lit(arm.name).alias("arm"), (-F.col(columns[0]).cast("double")).alias("score")))
            record += [{"arm": arm.name, "fold": f, "label": y} for f, y in plan]
            continue
        pick = [among.index(c) for c in columns]
        if arm.kind == "trees":
            found = search_trees(df, columns, plan, o.get("grid", [{}]), [*keys, fold], starts, seed=seed, counts=counts, chunks=chunks, among=among, **{k: v for k, v in o.items() if k != "grid"})
            final = refit_trees(found, plan, seed)[1]
            found.engine.free()
            said, made, own = list(found.record.values()), tree_scorers(found, final, pick), tree_models(found, final)
        elif arm.kind in ("ridge", "pls"):
            d = designs.get(tuple(columns)) or designs.setdefault(tuple(columns), Designs(df, columns, slots, chunks=chunks, among=among))
            final, said, mean, scale = rate_ridges(d, plan, o.get("cs", [1.0]), o.get("weighting", "measure"), counts) if arm.kind == "ridge" else rate_components(d, plan, o.get("components", 2))
            made, own = linear_scorers(d.medians, final, mean, scale, pick, arm.kind == "pls"), linear_models(d, columns, final, mean, scale)
        else:
            raise ValueError(f"an arm of unknown kind {arm.kind}")
        record += [{"arm": arm.name} | r for r in said]
        models |= {(arm.name, *at): m for at, m in own.items()}
        scorers += [(arm.name, m) for m in made]
    whole = [(arm, m) for arm, m in scorers if m.rotation is None]
    if whole:
        names = [(arm, y) for arm in dict.fromkeys(arm for arm, _ in whole) for y in labels]
        x = [F.col(c).cast("double") for c in among]
        rows = df.select(*keys, fold, "_truth", F.array(*x).alias("_x"), F.array(*[v.isNull() for v in x]).alias("_null"))
        scores.append(own_scores(rows, [*keys, fold, "_truth"], F.col(fold), list(dict.fromkeys(f for f, _ in plan)), whole, names).select(*keys, fold, "_truth", "label", "arm", "score"))
    if not scores:
        raise ValueError("no arm could be fitted on any fold")
    rows = _told(functools.reduce(lambda a, b: a.unionByName(b), scores), labels)
    settled = []
    if whole:
        groups = list(dict.fromkeys((arm, *m.at) for arm, m in scorers))
        label_of = list(dict.fromkeys(s.y for s in slots))
        cut = calibrated_cuts(chunks, [(groups.index((arm, *m.at)), label_of.index(m.at[1]), m) for arm, m in scorers if m.rotation is not None], len(groups), df.sparkSession.sparkContext.defaultParallelism)
        settled = [(*groups[g], *v) for g, v in sorted(cut.items())]
    chunks.unpersist()
    known = {r[:3]: r[3:] for r in settled}
    for entry in record:
        if (v := known.get((entry["arm"], entry["fold"], entry["label"]))) is not None:
            entry["calibration"], entry["threshold"] = v[:2], v[2]
    if not whole:
        return rows.select(*keys, fold, "label", "y", "valid", "arm", "score", F.lit(None).cast("double").alias("prob"), F.lit(None).cast("double").alias("threshold")), record, models
    p = F.least(F.greatest(F.col("score"), F.lit(1e-7)), F.lit(1 - 1e-7))
    prob = 1 / (1 + F.exp(-(F.log(p / (1 - p)) * F.col("a") + F.col("b"))))
    schema = T.StructType([T.StructField("arm", T.StringType()), df.schema[fold], T.StructField("label", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in ("a", "b", "threshold")]])
    rows = rows.join(F.broadcast(df.sparkSession.createDataFrame(settled, schema)), ["arm", fold, "label"], "left")
    return rows.select(*keys, fold, "label", "y", "valid", "arm", "score", prob.alias("prob"), "threshold"), record, models


def _truth(labels: dict[str, str]) -> Column:
    """Each label with its validity, in the order of the labels."""
    return F.array(*[F.struct(F.col(y).alias("y"), F.col(v).alias("valid")) for y, v in labels.items()])


def _told(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """df with y and valid of the label that a row names, out of the `_truth` that it carries."""
    own = F.coalesce(*[F.when(F.col("label") == y, F.col("_truth")[i]) for i, y in enumerate(labels)])
    return df.withColumn("_truth", own).withColumns({"y": F.col("_truth.y"), "valid": F.col("_truth.valid")}).drop("_truth")


def _refuse_leaks(df: DataFrame, fold: str, leak: list[str] | None) -> None:
    for c in leak or []:  # no value in two folds
        n = df.where(F.col(fold).isNotNull()).groupBy(c).agg(F.min(fold).alias("a"), F.max(fold).alias("z")).where("a <> z").limit(1).count()
        if n:
            raise ValueError(f"leakage: values of {c} in several folds")


def _losses(margins: DataFrame, fold: str, labels: dict[str, str]) -> DataFrame:
    """fold, label, block, rows, average precision and log-loss from margins with their `_truth`."""
    by = [fold, "label", "block"]
    d = _told(margins.where(F.col("model_fold") == F.col(fold)), labels).where("valid").withColumn("score", 1 / (1 + F.exp(-F.col("margin"))))
    d = settle(d.select(*by, "y", "score"))
    p = F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = d.groupBy(*by).agg(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("loss"))
    return metrics.average_precision(d, by).select(*by, "n_rows", "ap").join(loss, by)


def ablation_losses(df: DataFrame, arm: Arm, record: list[dict], blocks: dict[str, list[str]], fold: str, keys: list[str], labels: dict[str, str], unit: list[str] | None = None, t: str = "t", **options) -> DataFrame:
    """What a tuned arm of trees loses without each block of columns, refitted at each fold's own choice: fold, label, block, rows, log-loss and
    average precision on the fold's own valid rows. `record` is the arm's, of train_tuned."""
    starts = None
    if unit is not None:
        df, starts = mark_starts(df, labels, unit, t)
    df = settle(df.withColumn("_truth", _truth(labels)))
    plan = {at: {"whole": e["whole"], "rotations": []} for at, e in fold_plan(df, fold, labels).items()}
    columns = [c for c in arm.columns if c in df.columns]
    took = {k: v for k, v in arm.options.items() if k in ("rate", "penalty", "bins", "monotone")} | options
    margins = ablate_trees(df, columns, plan, [r for r in record if r["arm"] == arm.name], blocks, [*keys, fold], starts, carried=["_truth"], **took)
    if margins is None:
        raise ValueError("no block of columns can be left out")
    return _losses(margins, fold, labels)


def tuned_ablation(df: DataFrame, arm: Arm, blocks: dict[str, list[str]], fold: str, keys: list[str], labels: dict[str, str], inner: str | None = None, unit: list[str] | None = None, t: str = "t", embargo: int | None = None, leak: list[str] | None = None, seed: int = 0) -> DataFrame:
    """ablation_losses of an arm at the choices that train_tuned makes for it: the search over the rotations and the refits without blocks share one
    table and its packed rows; the arm's own scores, calibrations and thresholds, which no loss needs, are not made."""
    starts = None
    if unit is not None:
        df, starts = mark_starts(df, labels, unit, t)
    df = settle(df.withColumn("_truth", _truth(labels)))
    _refuse_leaks(df, fold, leak)
    plan = fold_plan(df, fold, labels, inner, unit, t, embargo)
    columns, o = [c for c in arm.columns if c in df.columns], arm.options
    found = search_trees(df, columns, plan, o.get("grid", [{}]), [*keys, fold], starts, seed=seed, carried=["_truth"], **{k: v for k, v in o.items() if k != "grid"})
    took = {k: v for k, v in o.items() if k in ("rate", "penalty", "bins", "monotone")}
    margins = ablate_trees(df, columns, plan, list(found.record.values()), blocks, [*keys, fold], starts, search=found, **took)
    found.engine.free()
    if margins is None:
        raise ValueError("no block of columns can be left out")
    return _losses(margins, fold, labels)


def ablation(arm: Arm, blocks: dict[str, list[str]]) -> list[Arm]:
    """The arm without each of the blocks of columns, named after the block."""
    out = []
    for name, columns in blocks.items():
        a = arm.without(columns)
        a.name = f"{arm.name}-without-{name}"
        out.append(a)
    return out


def column_arms(kind: str, subsets: dict[str, list[str]], columns: list[str], **options) -> list[Arm]:
    """Arms over subsets of columns as far as a table has them; empty ones are left out."""
    have = {n: [c for c in cs if c in columns] for n, cs in subsets.items()}
    return [Arm(n, kind, cs, options) for n, cs in have.items() if cs]


def final_model(df: DataFrame, arm: Arm, oof: DataFrame, y: str = "y", valid: str = "valid") -> Fitted:
    """The arm on all valid rows, calibrated on the pooled out-of-fold scores."""
    return Fitted(arm).fit(df.where(valid), y).calibrate(oof.where((F.col("arm") == arm.name) & F.col(valid)), y)


def fit_elsewhere(train: DataFrame, test: DataFrame, arm: Arm, group: str, keys: list[str], y: str = "y", valid: str = "valid") -> tuple[DataFrame, Fitted]:
    """Fit, calibrate and cut on one table, score another: (keys, y, valid, score, prob, threshold)."""
    t = train.where(valid)
    oof, _ = out_of_fold(t, arm, group, [], y)
    if oof is None and arm.kind != "rule":
        raise ValueError("no group of the training table can be held out")
    f = Fitted(arm).fit(t, y)
    if arm.kind != "rule":
        f.calibrate(oof, y)
    return f.predict(test).select(*keys, y, valid, F.col(SCORE).alias("score"), F.col(PROB).alias("prob"), F.lit(f.threshold).cast("double").alias("threshold")), f


def transfers(df: DataFrame, arm: Arm, condition: str, group: str, keys: list[str], y: str = "y", valid: str = "valid") -> tuple[DataFrame | None, list[dict]]:
    """Every ordered pair of conditions: trained on one, scored on the other, both directions in one table."""
    names, out, record = groups_of(df, condition), None, []
    for a in names:
        for b in names:
            if a == b:
                continue
            entry = {"train": a, "test": b}
            record.append(entry)
            try:
                part, f = fit_elsewhere(df.where(F.col(condition) == F.lit(a)), df.where(F.col(condition) == F.lit(b)), arm, group, keys, y, valid)
            except ValueError as e:
                entry["skipped"] = str(e)
                continue
            entry["threshold"] = f.threshold
            part = part.withColumns({"trained_on": F.lit(a), "tested_on": F.lit(b)})
            out = part if out is None else out.unionByName(part)
    return out, record


def leave_family_out(df: DataFrame, arm: Arm, family: str, group: str, keys: list[str], disjoint: list[str], y: str = "y", valid: str = "valid") -> tuple[DataFrame | None, list[dict]]:
    """Each family scored by a model of the others, with all columns and without those whose ranges tell families apart."""
    out, record = None, []
    for a in (arm, Arm(f"{arm.name}-without-disjoint", arm.kind, [c for c in arm.columns if c not in disjoint], arm.options)):
        for f in groups_of(df, family):
            entry = {"family": f, "arm": a.name}
            record.append(entry)
            try:
                part, _ = fit_elsewhere(df.where(~F.col(family).eqNullSafe(F.lit(f))), df.where(F.col(family) == F.lit(f)), a, group, keys, y, valid)
            except ValueError as e:
                entry["skipped"] = str(e)
                continue
            part = part.withColumns({"family": F.lit(f), "arm": F.lit(a.name)})
            out = part if out is None else out.unionByName(part)
    return out, record


def event_rotations(df: DataFrame, blocks: int, embargo: int, unit: list[str], y: str = "y", t: str = "t") -> DataFrame:
    """Rotations for few units with events: each unit of both classes is cut into time blocks with an embargo, and each
    block is once validated on while the rest of the unit trains. Rows of other units always train: they have a null
    block and belong to every rotation."""
    both = df.groupBy(*unit).agg((F.min(y) != F.max(y)).alias("_both")).where("_both").drop("_both")
    cut = time_blocks(df.join(both, unit), blocks, embargo, unit, t)
    rest = df.join(both, unit, "left_anti").withColumns({"block": F.lit(None).cast("int"), "role": F.lit("train")})
    return cut.unionByName(rest)


def contributions(df: DataFrame, fitted: dict, fold: str, keys: list[str], columns: list[str]) -> DataFrame | None:
    """Parts of the margin of every row by its own fold's ridge model, put together over folds; columns that a model did
    not use have 0."""
    out = None
    for g, f in fitted.items():
        d = f.scaler.transform(f.encoder.transform(df.where(F.col(fold) == F.lit(g))))
        d = f.model.contributions(d)
        part = d.select(*keys, fold, *[(F.col(f"contrib_{c}") if f"contrib_{c}" in d.columns else F.lit(0.0)).alias(f"contrib_{c}") for c in columns])
        out = part if out is None else out.unionByName(part)
    return out
