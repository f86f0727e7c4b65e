"""Trees of fitted forests as plain values, and as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """An inner node (feature <= threshold goes left) or, without children, a leaf with its prediction."""

    value: float
    feature: int = -1
    left: Node | None = None
    right: Node | None = None


def forest(model) -> list[Node]:
    """The trees of a fitted tree ensemble, read from its description."""
    trees: list[Node] = []
    lines = iter(line.strip() for line in model.toDebugString.splitlines()[1:])
    for line in lines:
        if line.startswith("Tree"):
            trees.append(_node(lines))
    return trees


def _node(lines) -> Node:
    line = next(lines)
    if line.startswith("Predict"):
        return Node(float(line.split(":")[1]))
    m = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    left = _node(lines)
    next(lines)  # Else
    return Node(float(m[2]), int(m[1]), left, _node(lines))


def prediction(tree: Node, features: list[Column]) -> Column:
    if tree.left is None:
        return F.lit(tree.value)
    return F.when(features[tree.feature] <= tree.value, prediction(tree.left, features)).otherwise(prediction(tree.right, features))


def share_of_votes(trees: list[Node], features: list[Column]) -> Column:
    """Share of the trees that predict 1."""
    total = F.lit(0.0)
    for tree in trees:
        total = total + prediction(tree, features)
    return total / len(trees)


def paths(tree: Node, above: tuple = ()) -> list[tuple]:
    """All paths from the root to a node below it: tuples of (feature, is_above, threshold)."""
    if tree.left is None:
        return []
    found = []
    for child, is_above in ((tree.left, False), (tree.right, True)):
        path = (*above, (tree.feature, is_above, tree.value))
        found += [path, *paths(child, path)]
    return found
