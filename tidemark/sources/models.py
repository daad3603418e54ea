"""Fitted models as JSON files, by name and key (horizon, variant, version)."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from tidemark.operators.boosting import BoostedTrees
from tidemark.operators.experiment import Arm, Fitted
from tidemark.operators.models import Calibrator, MissingEncoder, PartialLeastSquares, RidgeLogistic, Standardiser
from tidemark.operators.together import Linear
from tidemark.operators.trees import Node
from tidemark.sources.sinks import _fs, step_output, write_text

PLAIN = {"ridge": RidgeLogistic, "pls": PartialLeastSquares, "linear": Linear, "encoder": MissingEncoder, "scaler": Standardiser, "calibrator": Calibrator}


def _node(x: Node) -> dict:
    return {"feature": x.feature, "cut": x.cut, "missing_left": bool(x.missing_left), "value": x.value, "cover": x.cover, "children": [_node(c) for c in x.children]}


def _tree(d: dict) -> Node:
    return Node(d["feature"], d["cut"], d["missing_left"], d["value"], d["cover"], children=[_tree(c) for c in d["children"]])


def _out(x) -> dict | None:
    if x is None:
        return None
    if isinstance(x, BoostedTrees):
        return {"kind": "trees", "state": {k: v for k, v in x.__dict__.items() if k != "trees"}, "trees": [_node(t) for t in x.trees]}
    kind = next((k for k, c in PLAIN.items() if isinstance(x, c)), None)
    if kind is None:
        raise TypeError(f"a {type(x).__name__} cannot be stored")
    return {"kind": kind, "state": {k: v.tolist() if isinstance(v, np.ndarray | np.generic) else v for k, v in x.__dict__.items()}}


def _back(d: dict | None):
    if d is None:
        return None
    kind = BoostedTrees if d["kind"] == "trees" else PLAIN[d["kind"]]
    x = kind.__new__(kind)
    x.__dict__.update(d["state"])
    if isinstance(x, BoostedTrees):
        x.trees = [_tree(t) for t in d["trees"]]
    if isinstance(x, PartialLeastSquares):
        x.__dict__.update({k: np.array(v) for k, v in x.__dict__.items() if isinstance(v, list)})
    if isinstance(x, Standardiser):
        x.at = {c: tuple(v) for c, v in x.at.items()}
    if isinstance(x, Calibrator) and x.steps is not None:
        x.steps = tuple(x.steps)
    return x


def path_of(root: str, tau: int, variant: str, version: str) -> str:
    return f"{root.rstrip('/')}/{variant}-tau{tau}-v{version}"


def save(spark: SparkSession, path: str, fitted: Fitted) -> None:
    """The folder appears whole or not at all."""
    doc = {"arm": fitted.arm.__dict__, "columns": fitted.columns, "threshold": fitted.threshold, **{n: _out(getattr(fitted, n)) for n in ("encoder", "scaler", "model", "calibrator")}}
    with step_output(spark, path) as folder:
        write_text(spark, f"{folder}/model.json", json.dumps(doc))


def load(spark: SparkSession, path: str) -> Fitted | None:
    """The model, or None where none is stored."""
    fs, make = _fs(spark, path)
    at = make(f"{path}/model.json")
    if not fs.exists(at):
        return None
    doc = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/model.json", wholetext=True).collect()))  # one file
    out = Fitted(Arm(**doc["arm"]))
    out.columns, out.threshold = doc["columns"], doc["threshold"]
    for n in ("encoder", "scaler", "model", "calibrator"):
        setattr(out, n, _back(doc[n]))
    return out


def load_or_fit(spark: SparkSession, path: str, fit) -> Fitted:
    """The stored model; else that of fit(), which is then stored."""
    found = load(spark, path)
    if found is None:
        found = fit()
        save(spark, path, found)
    return found
