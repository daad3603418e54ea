"""Trees over binned columns: nodes, leaves, and where rows end."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    feature: int = -1
    cut: int = 0  # bins below go left
    missing_left: bool = True
    value: float = 0.0
    cover: float = 0.0
    low: float = -math.inf  # bounds of the values below it, from monotone splits above
    high: float = math.inf
    children: list[Node] = field(default_factory=list)


def _route(node: Node, bins: np.ndarray, path: list[int], out: np.ndarray, rows: np.ndarray) -> None:
    if not node.children:
        out[rows] = path[0]
        path[0] += 1
        return
    b = bins[rows, node.feature]
    left = np.where(b < 0, node.missing_left, b < node.cut)
    _route(node.children[0], bins, path, out, rows[left])
    _route(node.children[1], bins, path, out, rows[~left])


def leaves(node: Node) -> list[Node]:
    return [node] if not node.children else [x for c in node.children for x in leaves(c)]


def assign(tree: Node, bins: np.ndarray) -> np.ndarray:
    """Leaf of each row, numbered from the left."""
    out = np.zeros(len(bins), np.int64)
    _route(tree, bins, [0], out, np.arange(len(bins)))
    return out
