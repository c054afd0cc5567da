"""Gradient-boosted trees for a yes or no.

A tree grows level by level, each from sums over all rows: of gradients and of weights,
by node, feature and bin. Rows stay where they are; a pass over them hands back these sums
alone, whose number does not depend on the rows'.
"""

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32
TREES, DEPTH, RATE = 40, 3, 0.3
MARGIN_STEPS, MARGIN_END = 64, 30  # margins are rounded to steps of 1/64, up to 30
# Sums are of whole multiples of 2**-36, so that their order changes nothing: a double
# holds them up to a weight of 2**17 in all.
UNIT = 2.0**36


class Trees(NamedTuple):
    """Heap-shaped trees of one depth: ``feature`` and ``cut`` of the inner nodes
    (rows at or below the cut go left), ``value`` of the leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float
    scale: tuple[float, float]  # calibration: probability = sigmoid(a * margin + b)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _node_of(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Of each row its node on a level, counted from 0; ``columns`` has a row per feature."""
    node = np.zeros(columns.shape[1], dtype=np.int8)
    for level in range(levels):
        first, right = 2**level - 1, np.zeros(columns.shape[1], dtype=bool)
        for at in range(2**level):
            if cut[first + at] < np.inf:
                right |= (node == at) & (columns[feature[first + at]] > cut[first + at])
        node = 2 * node + right
    return node


def margins_of_columns(model: Trees, columns: np.ndarray) -> np.ndarray:
    total, depth = np.full(columns.shape[1], model.start), int(np.log2(model.value.shape[1])) if len(model.value) else 0
    for feature, cut, value in zip(model.feature, model.cut, model.value):
        total += value[_node_of(columns, feature, cut, depth)]
    return total


def in_steps(margin: np.ndarray) -> np.ndarray:
    """Margins as whole steps."""
    return np.rint(np.clip(margin, -MARGIN_END, MARGIN_END) * MARGIN_STEPS).astype(np.int64)


class Growing(NamedTuple):
    """A tree's levels so far, in bins: rows of a bin at or below the cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    levels: int


def level_sums(model: Trees, tree: Growing, columns: np.ndarray, yes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sums by node, feature, bin of gradient and of weight, in units, over binned rows."""
    p = _sigmoid(margins_of_columns(model, columns))
    node = _node_of(columns, tree.feature, tree.cut, tree.levels).astype(np.int64)
    parts = np.rint(weight * (yes - p) * UNIT), np.rint(weight * p * (1 - p) * UNIT)
    out = np.zeros((2**tree.levels, len(columns), BINS, 2))
    for f, column in enumerate(columns):
        for i, part in enumerate(parts):
            out[:, f, :, i] = np.bincount(node * BINS + column, part, 2**tree.levels * BINS).reshape(-1, BINS)
    return out


def grow(
    starts: list[float], sums: Callable[[list[Trees], list[Growing]], np.ndarray], trees: int, depth: int, rate: float
) -> list[Trees]:
    """Newton boosting on the logistic loss, a model per start; all grow in step, so that
    one call of ``sums`` serves them. Cuts are numbers of bins."""
    inner = 2**depth - 1
    empty = np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1))
    models = [Trees(*empty, start, (1.0, 0.0)) for start in starts]
    for _ in range(trees):
        growing = [Growing(np.zeros(inner, np.int64), np.full(inner, np.inf), 0) for _ in models]
        values = [np.zeros(inner + 1) for _ in models]
        for level in range(depth):
            found = sums(models, growing) / UNIT
            for m, tree in enumerate(growing):
                for at in range(2**level):
                    below = np.cumsum(found[m, at], axis=1)  # feature, bin, (gradient, weight)
                    g, w = below[:, :-1, 0], below[:, :-1, 1]
                    g_all, w_all = below[0, -1]
                    gain = g**2 / (w + 1) + (g_all - g) ** 2 / (w_all - w + 1) - g_all**2 / (w_all + 1)
                    f, k = np.unravel_index(int(gain.argmax()), gain.shape)
                    left = g_all, w_all
                    if gain[f, k] > 1e-6:
                        tree.feature[2**level - 1 + at], tree.cut[2**level - 1 + at] = f, k
                        left = g[f, k], w[f, k]
                    if level == depth - 1:
                        values[m][2 * at] = rate * left[0] / (left[1] + 1)
                        values[m][2 * at + 1] = rate * (g_all - left[0]) / (w_all - left[1] + 1)
            growing = [tree._replace(levels=level + 1) for tree in growing]
        models = [
            m._replace(feature=np.vstack([m.feature, t.feature]), cut=np.vstack([m.cut, t.cut]), value=np.vstack([m.value, v]))
            for m, t, v in zip(models, growing, values)
        ]
    return models


def with_cuts(model: Trees, cuts: list[np.ndarray]) -> Trees:
    """The model with cuts of values in place of numbers of bins."""
    cut = model.cut.copy()
    for place in np.argwhere(np.isfinite(cut)):
        place = tuple(place)
        own, k = cuts[model.feature[place]], int(cut[place])
        cut[place] = own[k] if k < len(own) else np.inf
    return model._replace(cut=cut)


def bins_of(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of the values, a row per feature: how many cuts lie below."""
    return np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)]).astype(np.int8)


def _start(yes: float, no: float) -> float:
    return float(np.log((yes + 1) / (no + 1)))


def fit_trees(
    rows: np.ndarray, yes: np.ndarray, held_out: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE
) -> Trees:
    """The fit of a table that one process holds; the margin is then calibrated to a
    probability on the rows of ``held_out`` (Platt's method)."""
    x, y = rows[~held_out], yes[~held_out].astype(float)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(1) for f in range(rows.shape[1])]
    columns, ones = bins_of(x, cuts), np.ones(len(x))

    def sums(models: list[Trees], growing: list[Growing]) -> np.ndarray:
        return np.stack([level_sums(m, t, columns, y, ones) for m, t in zip(models, growing)])

    model = with_cuts(grow([_start(y.sum(), len(y) - y.sum())], sums, trees, depth, rate)[0], cuts)
    steps = in_steps(margins(model, rows[held_out])) / MARGIN_STEPS
    return model._replace(scale=calibrate(steps, yes[held_out], np.ones(len(steps))))


SUMS = "model int, place int, gradient double, weight double"
STEPS = "label int, step int, yes boolean, weight double, n bigint"


class Binned(NamedTuple):
    """Rows of ``bins array<tinyint>, label int, fold int, weight double, n bigint``, each
    for ``n`` of the corpus that together weigh ``weight``. ``table`` is read once a level,
    so it should be a staged one; few rows may be ``held`` by the driver instead, with the
    same result. All weights together are below 2**17."""

    table: DataFrame
    features: int
    held: pa.Table | None = None

    def _summed(self, work: Callable, schema: str, keys: list[str], sums: list[str]) -> pa.Table:
        """Sums of what ``work`` makes of columns, labels, folds, weights and numbers."""
        features, names = self.features, [f.split()[0] for f in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins = batch.column(0).flatten().to_numpy().reshape(-1, features)
                    found = work(np.ascontiguousarray(bins.T), *[batch.column(i).to_numpy() for i in range(1, 5)])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

        if self.held is not None:
            made = pa.Table.from_batches(run(self.held.combine_chunks().to_batches()))
            return made.group_by(keys).aggregate([(c, "sum") for c in sums]).rename_columns([*keys, *sums])
        rows = self.table.select("bins", "label", "fold", "weight", "n")
        return rows.mapInArrow(run, schema).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).toArrow()

    def level(self, of: list[tuple[int, int]], models: list[Trees], growing: list[Growing]) -> np.ndarray:
        """``level_sums`` of a model per label and fold, over the rows outside the fold."""

        def work(columns, label, fold, weight, n) -> list[np.ndarray]:
            outside = {f: np.flatnonzero(fold != f) for f in {f for _, f in of}}
            parts = {f: (np.ascontiguousarray(columns[:, at]), label[at], weight[at]) for f, at in outside.items()}
            found = []
            for m, (own, f) in enumerate(of):
                part, labels, weights = parts[f]
                flat = level_sums(models[m], growing[m], part, labels == own, weights).reshape(-1, 2)
                place = np.flatnonzero(flat.any(axis=1)).astype(np.int32)
                found.append((np.full(len(place), m, np.int32), place, flat[place, 0], flat[place, 1]))
            return [np.concatenate(c) for c in zip(*found)]

        got = self._summed(work, SUMS, ["model", "place"], ["gradient", "weight"])
        out = np.zeros((len(models), 2 ** growing[0].levels * self.features * BINS, 2))
        for i, name in enumerate(("gradient", "weight")):
            out[got["model"].to_numpy(), got["place"].to_numpy(), i] = got[name].to_numpy()
        return out.reshape(len(models), -1, self.features, BINS, 2)

    def steps(self, of: list[tuple[int, int]], models: list[Trees]) -> pa.Table:
        """``label, step, yes, weight, n``: the rows by the margin that the model which
        has not seen them gives, a row per label, step and class."""

        def work(columns, label, fold, weight, n) -> list[np.ndarray]:
            found = []
            for (own, f), model in zip(of, models):
                at = np.flatnonzero(fold == f)
                pair = 2 * in_steps(margins_of_columns(model, columns[:, at])) + (label[at] == own)
                pairs, place = np.unique(pair, return_inverse=True)
                counts = np.zeros(len(pairs), np.int64)
                np.add.at(counts, place, n[at])
                units = np.bincount(place, np.rint(weight[at] * UNIT), len(pairs))
                found.append((np.full(len(pairs), own, np.int32), (pairs // 2).astype(np.int32), pairs % 2 == 1, units, counts))
            return [np.concatenate(c) for c in zip(*found)]

        return self._summed(work, STEPS, ["label", "step", "yes"], ["weight", "n"])


class Fitted(NamedTuple):
    """A label's models, one per fold, and what they give to the rows of their folds:
    steps of the margin, classes and numbers of rows."""

    models: dict[int, Trees]
    step: np.ndarray
    yes: np.ndarray
    n: np.ndarray


def fit_trees_over(
    binned: Binned, labels: list[int], folds: int, trees: int = TREES, depth: int = DEPTH, rate: float = RATE
) -> list[Fitted]:
    """Models of each label against all other rows, from all rows. A model has not seen the
    rows of its fold, and those of all folds calibrate the margins (Platt's method)."""
    whole = binned.table.groupBy("label", "fold").agg(F.sum(F.round(F.col("weight") * UNIT)).alias("w"))
    weights = {(r["label"], r["fold"]): r["w"] / UNIT for r in whole.collect()}
    of = [(label, fold) for label in labels for fold in range(folds)]
    starts = []
    for own, fold in of:
        seen = [(k, w) for (k, f), w in sorted(weights.items()) if f != fold]
        starts.append(_start(sum(w for k, w in seen if k == own), sum(w for k, w in seen if k != own)))
    models = grow(starts, lambda m, g: binned.level(of, m, g), trees, depth, rate)
    all_steps, found = binned.steps(of, models), []
    for label in labels:
        own = all_steps.filter(pc.equal(all_steps["label"], label)).sort_by([("step", "ascending"), ("yes", "ascending")])
        step, yes, weight, n = [own[c].to_numpy() for c in ("step", "yes", "weight", "n")]
        scale = calibrate(step / MARGIN_STEPS, yes.astype(bool), weight / UNIT)
        calibrated = {fold: m._replace(scale=scale) for (k, fold), m in zip(of, models) if k == label}
        found.append(Fitted(calibrated, step, yes.astype(bool), n))
    return found


def calibrate(margin: np.ndarray, yes: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    if not len(yes) or yes.all() or not yes.any():
        return 1.0, 0.0
    # Platt's targets keep the fit finite where the classes are separable.
    n_yes, n_no = weight[yes].sum(), weight[~yes].sum()
    high, low = (n_yes + 1) / (n_yes + 2), 1 / (n_no + 2)
    target, design, found = np.where(yes, high, low), np.stack([margin, np.ones(len(margin))], 1), np.array([1.0, 0.0])
    for _ in range(100):  # Newton's steps, kept short: far out the curve is flat
        p = _sigmoid(design @ found)
        slope = design.T @ (weight * (p - target)) + 1e-3 * (found - [1.0, 0.0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        found = found - step * min(1.0, 0.2 / max(np.abs(step).max(), 1e-12))
    return float(found[0]), float(found[1])


def margins(model: Trees, rows: np.ndarray) -> np.ndarray:
    return margins_of_columns(model, rows.T)


def odds_of_steps(model: Trees, step: np.ndarray) -> np.ndarray:
    a, b = model.scale
    return a * (step / MARGIN_STEPS) + b


def log_odds(model: Trees, rows: np.ndarray) -> np.ndarray:
    return odds_of_steps(model, in_steps(margins(model, rows)))


def probabilities(model: Trees, rows: np.ndarray) -> np.ndarray:
    return _sigmoid(log_odds(model, rows))
