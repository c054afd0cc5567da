"""Isolation forest (Liu, Ting and Zhou, ICDM 2008): fitted on sub-samples drawn by
position, one Spark group per tree, and scored in one pass without a shuffle.

A tree is a heap-shaped table: node ``i`` has the children ``2i+1`` (below the
threshold) and ``2i+2``. Its size is fixed by the sub-sample, not by the data.
"""

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.operators.labels import FEATURES
from hearthlog.operators.ordering import Numbered, with_position
from hearthlog.settings import SAMPLE_PER_TREE, TREES

# Workers need not have this package: what they run travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EULER_GAMMA = 0.5772156649
NODE_SCHEMA = "tree int, node int, feature int, threshold double, path double, size int"


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER_GAMMA) - 2.0 * (n - 1) / n


@dataclass(frozen=True)
class Forest:
    """``nodes`` follows ``NODE_SCHEMA``; a leaf has feature -1, its path length and the
    number of sampled points in it."""

    nodes: pd.DataFrame
    psi: int
    features: tuple[str, ...] = FEATURES

    @property
    def depth(self) -> int:
        return int(math.floor(math.log2(self.nodes["node"].max() + 1))) if len(self.nodes) else 0


def grow_tree(points: np.ndarray, rng: np.random.Generator) -> list[tuple[int, int, float, float, int]]:
    """``(node, feature, threshold, path, size)`` of one tree over ``points``."""
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes = []
    pending = [(0, points, 0)]
    while pending:
        node, part, depth = pending.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth == limit or len(varying) == 0:
            nodes.append((node, -1, 0.0, depth + average_path(len(part)), len(part)))
            continue
        feature = int(varying[rng.integers(len(varying))])
        # in (low, high], so that neither side is empty
        threshold = low[feature] + (high[feature] - low[feature]) * (1.0 - rng.random())
        if not low[feature] < threshold <= high[feature]:
            threshold = high[feature]
        below = part[:, feature] < threshold
        nodes.append((node, feature, float(threshold), 0.0, 0))
        pending.append((2 * node + 1, part[below], depth + 1))
        pending.append((2 * node + 2, part[~below], depth + 1))
    return nodes


def draw_positions(total: int, trees: int, psi: int, seed: int) -> pd.DataFrame:
    """``tree, slot, _position``: for each tree on its own, ``min(psi, total)`` different
    positions out of ``total``."""
    drawn = [
        np.random.default_rng([seed, tree, 1]).choice(total, size=min(psi, total), replace=False)
        for tree in range(trees)
    ]
    return pd.DataFrame(
        [(tree, slot, int(at)) for tree, own in enumerate(drawn) for slot, at in enumerate(own)],
        columns=["tree", "slot", "_position"],
    )


def draw_samples(
    points: DataFrame,
    key: list[str],
    features: list[str],
    trees: int,
    psi: int,
    seed: int,
    numbered: Numbered | None = None,
) -> tuple[DataFrame, int]:
    """``tree, slot, features`` of the sampled points, and the sample size.

    The rows that have all features are numbered in order of ``key``, unless ``numbered``
    has them with a ``_position`` already, and each tree draws positions: one rule for
    any number of rows, that neither partitions nor copies change.
    """
    if numbered is None:
        names = list(dict.fromkeys([*key, *features]))
        table = with_position(points.dropna(subset=features).select(*names), names, "_position")
        numbered = Numbered(table, table.count())
    drawn = draw_positions(numbered.total, trees, psi, seed)
    positions = points.sparkSession.createDataFrame(drawn, "tree int, slot int, _position bigint")
    values = [F.col(f).cast("double").alias(f) for f in features]
    # As many rows as trees times the sample size.
    sample = numbered.table.join(F.broadcast(positions), "_position").select("tree", "slot", *values)
    return sample, min(psi, numbered.total)


def fit_forest(
    points: DataFrame,
    key: list[str],
    features: tuple[str, ...] = FEATURES,
    trees: int = TREES,
    sample_per_tree: int = SAMPLE_PER_TREE,
    seed: int = 0,
    numbered: Numbered | None = None,
) -> Forest:
    """Fit on the rows of ``points`` that have all features; ``key`` orders them."""
    names = list(features)
    sample, psi = draw_samples(points, key, names, trees, sample_per_tree, seed, numbered)
    if psi == 0:
        return Forest(pd.DataFrame(columns=["tree", "node", "feature", "threshold", "path", "size"]), 0, tuple(names))

    def grow(tree: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) != psi:
            raise ValueError(f"tree {tree[0]} got {len(rows)} of {psi} rows")
        ordered = rows.sort_values("slot")[names].to_numpy(dtype=float)
        nodes = grow_tree(ordered, np.random.default_rng([seed, int(tree[0])]))
        return pd.DataFrame(nodes, columns=["node", "feature", "threshold", "path", "size"]).assign(
            tree=int(tree[0])
        )[["tree", "node", "feature", "threshold", "path", "size"]]

    # The sample is small in bytes but not in work: without a number of partitions
    # all trees would be merged into one task.
    tasks = min(trees, points.sparkSession.sparkContext.defaultParallelism)
    spread = sample.repartition(tasks, "tree")
    # At most trees x (2 x sample - 1) nodes, whatever the size of the data.
    nodes = spread.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()
    if nodes["tree"].nunique() != trees:
        raise ValueError(f"{nodes['tree'].nunique()} of {trees} trees were grown")
    return Forest(nodes.sort_values(["tree", "node"], ignore_index=True), psi, tuple(names))


def _full_trees(forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Per tree: feature, threshold and path by heap position, with every leaf
    carried down to the last level so that all walks have the same length."""
    depth = forest.depth
    size = 2 ** (depth + 1) - 1
    names, tree = np.unique(forest.nodes["tree"].to_numpy(), return_inverse=True)
    node, split, cut, length = (
        forest.nodes[c].to_numpy() for c in ("node", "feature", "threshold", "path")
    )
    feature = np.zeros((len(names), size), dtype=np.int64)
    threshold = np.full((len(names), size), np.inf)
    path = np.zeros((len(names), size))
    inner = split >= 0
    feature[tree[inner], node[inner]] = split[inner]
    threshold[tree[inner], node[inner]] = cut[inner]
    tree, node, length = tree[~inner], node[~inner], length[~inner]
    while len(node):
        path[tree, node] = length
        node = 2 * node + 1
        tree, node, length = tree[node < size], node[node < size], length[node < size]
    return feature, threshold, path, depth


def mean_path(
    rows: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray, depth: int
) -> np.ndarray:
    """Path length of every row, averaged over the trees: all rows take a step at once."""
    count, width = rows.shape
    values, start = np.ascontiguousarray(rows).ravel(), np.arange(count) * width
    node, at = np.empty(count, dtype=np.int64), np.empty(count, dtype=np.int64)
    value, cut, total = np.empty(count), np.empty(count), np.zeros(count)
    for tree_feature, tree_threshold, tree_path in zip(feature, threshold, path):
        node.fill(0)
        for _ in range(depth):
            tree_feature.take(node, out=at, mode="clip")
            at += start
            values.take(at, out=value, mode="clip")
            tree_threshold.take(node, out=cut, mode="clip")
            node += node
            node += 1
            node += value >= cut
        total += tree_path.take(node)
    return total / len(feature)


def with_forest_score(points: DataFrame, forest: Forest, name: str = "iforest_score") -> DataFrame:
    """Add the score ``0.5 - s``: the lower, the more unusual. Null if a feature is null."""
    if forest.psi == 0:  # no row had all features
        return points.withColumn(name, F.lit(None).cast("double"))
    model = points.sparkSession.sparkContext.broadcast(_full_trees(forest))
    scale = average_path(forest.psi) or 1.0

    def score_batches(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = model.value
        for batch in batches:
            rows = np.stack([c.to_numpy(dtype=float) for c in batch], axis=1)
            score = 0.5 - np.exp2(-mean_path(rows, *trees) / scale)
            score[np.isnan(rows).any(axis=1)] = np.nan
            yield pd.Series(score)

    udf = F.pandas_udf(_typed(score_batches), "double")
    score = udf(*[F.col(f).cast("double") for f in forest.features])
    complete = F.lit(True)
    for f in forest.features:
        complete = complete & F.col(f).isNotNull()
    return points.withColumn(name, F.when(complete, score))


def _typed(function):
    """Annotations that ``pandas_udf`` reads to choose the iterator form."""
    function.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, ...]],
        "return": Iterator[pd.Series],
    }
    return function
