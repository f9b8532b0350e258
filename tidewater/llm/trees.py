"""Fitted MLlib tree ensembles as flat arrays, for scoring inside a pass that already holds the features."""

from __future__ import annotations

import numpy as np


def flatten(model) -> list[dict[str, np.ndarray]]:
    """One dict of arrays per tree: feature (-1 at a leaf), threshold, left, right, value."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        rows: list[list[float]] = []

        def add(node) -> int:
            at = len(rows)
            rows.append([-1, 0.0, at, at, node.prediction() * weight])
            if hasattr_java(node, "InternalNode"):
                split = node.split()
                left, right = add(node.leftChild()), add(node.rightChild())
                rows[at][:4] = [split.featureIndex(), split.threshold(), left, right]
            return at

        add(tree._java_obj.rootNode())
        a = np.array(rows, dtype=np.float64)
        out.append({"feature": a[:, 0].astype(np.int32), "threshold": a[:, 1], "left": a[:, 2].astype(np.int32),
                    "right": a[:, 3].astype(np.int32), "value": a[:, 4]})
    return out


def hasattr_java(node, kind: str) -> bool:
    return node.getClass().getSimpleName() == kind


def margin(trees: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Weighted sum of the trees' predictions for each row of ``x``."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=np.int32)
        while True:
            f = t["feature"][at]
            inner = f >= 0
            if not inner.any():
                break
            left = x[rows, np.maximum(f, 0)] <= t["threshold"][at]
            at = np.where(inner, np.where(left, t["left"][at], t["right"][at]), at)
        total += t["value"][at]
    return total
