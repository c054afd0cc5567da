"""An isolation forest as boxes, and as steps over the time of day.

A leaf is a box over label code, sine and cosine, closed below and open above. Sine and
cosine both come from the time of day, so for one code the mean path is a step function
of that time, which changes only where some box begins or ends. Codes between which no
box ends share their function. There are as many steps as the forest has leaf edges,
whatever the number of readings: a reading looks up the cell that its time lies in, and
finds its step among the few that begin there.
"""

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.functions.clock import MICROS_PER_SECOND, micros_of_bin
from hearthlog.operators import lookup as lookups
from hearthlog.operators.forest import Forest, _full_trees, average_path, mean_path, with_forest_score
from hearthlog.operators.labels import FEATURES
from hearthlog.operators.lookup import lookup
from hearthlog.settings import DAY_SECONDS
from hearthlog.staging import Staged, stage_measured

# Workers need not have this package: what they run travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP_BYTES = 64  # of a step in the table, with its share of the row
STEPS_PER_CELL = 2  # on average


class Steps(NamedTuple):
    """``range, cell, at, score``: the steps that begin within a cell, and the scores
    before, between and behind them. ``starts`` has the first code of each range."""

    table: Staged
    starts: list[int]
    cells: int
    most: int  # steps that begin in one cell


def leaf_boxes(forest: Forest) -> pd.DataFrame:
    """``tree, lo1, hi1, lo2, hi2, ..., h``: the leaves, with infinite ends where a side is
    open. A point lies in the one box of a tree with ``lo <= x < hi`` for each feature."""
    width = len(forest.features)
    rows = []
    for tree, nodes in forest.nodes.groupby("tree"):
        by_place = {n.node: n for n in nodes.itertuples()}
        pending = [(0, np.full(width, -np.inf), np.full(width, np.inf))]
        while pending:
            place, low, high = pending.pop()
            node = by_place[place]
            if node.feature < 0:
                rows.append((int(tree), *np.stack([low, high], axis=1).ravel(), node.path))
                continue
            below, above = high.copy(), low.copy()
            below[node.feature] = min(high[node.feature], node.threshold)
            above[node.feature] = max(low[node.feature], node.threshold)
            pending += [(2 * place + 1, low, below), (2 * place + 2, above, high)]
    ends = [f"{end}{i + 1}" for i in range(width) for end in ("lo", "hi")]
    return pd.DataFrame(rows, columns=["tree", *ends, "h"])


def angles(at: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Sine and cosine at microseconds of the period, as the exact ``cyclical`` has them."""
    angle = at / float(period) * 2.0 * np.pi
    return np.sin(angle), np.cos(angle)


def crossings(thresholds: np.ndarray, which: int, period: int) -> list[np.ndarray]:
    """For each threshold, the first microsecond behind each change between below it and
    not below it, of the sine (0) or the cosine (1). Both only rise or only fall within
    a quarter of the period, so each quarter is halved until the change is found."""
    below = lambda at: angles(at, period)[which] < thresholds
    quarters = [-(-period * q // 4) for q in range(4)] + [period]
    found, changed = [], []
    for first, last in zip(quarters, quarters[1:]):
        if first == last:
            continue
        low, high = np.full(len(thresholds), first), np.full(len(thresholds), last - 1)
        start = below(low)
        if first:
            found.append(low.copy())
            changed.append(start != below(low - 1))
        changed.append(start != below(high))
        for _ in range(int(last - first).bit_length()):
            middle = (low + high + 1) // 2
            same = below(middle) == start
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        found.append(high + 1)
    places, changed = np.array(found, np.int64).T, np.array(changed, bool).T
    return [own[kept] for own, kept in zip(places, changed)]


def code_ranges(boxes: pd.DataFrame) -> list[int]:
    """The first code of each range of codes that no box parts, from the smallest on."""
    edges = boxes[["lo1", "hi1"]].to_numpy().ravel()
    return sorted({0, *[int(np.ceil(e)) for e in edges if np.isfinite(e) and e > 0]})


def forest_steps(
    spark: SparkSession, forest: Forest, period_seconds: float = DAY_SECONDS, limit_bytes: int | None = None
) -> Steps | None:
    """The steps of each range of codes, by the cells of the period that they lie in.

    None if the leaves that the ranges meet, which are about as many as the steps, are
    too many for a table of ``limit_bytes``, by default as much as a lookup broadcasts.
    """
    limit = lookups.BROADCAST_LIMIT_BYTES if limit_bytes is None else limit_bytes
    period = int(round(period_seconds * MICROS_PER_SECOND))
    boxes = leaf_boxes(forest)
    starts = code_ranges(boxes)
    lows, highs = np.sort(boxes["lo1"].to_numpy()), np.sort(boxes["hi1"].to_numpy())
    meeting = np.searchsorted(lows, starts, side="right") - np.searchsorted(highs, starts, side="right")
    if int(meeting.sum()) * STEP_BYTES > limit or starts[-1] * STEP_BYTES > limit:
        return None
    cells = 1 << max(0, int(meeting.mean() / STEPS_PER_CELL)).bit_length()
    cuts = {}
    for feature in (1, 2):
        own = forest.nodes.loc[forest.nodes["feature"] == feature, "threshold"].unique()
        cuts |= {(feature, t): at for t, at in zip(own.tolist(), crossings(own, feature - 1, period))}
    model = spark.sparkContext.broadcast((boxes.drop(columns="tree").to_numpy(), cuts, _full_trees(forest)))
    scale = average_path(forest.psi) or 1.0

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges, cuts, trees = model.value
        opens = -(-np.arange(cells, dtype=np.int64) * period // cells)
        for batch in batches:
            for number, code in batch.itertuples(index=False):
                own = edges[(edges[:, 0] <= code) & (code < edges[:, 1])]
                ends = {(f, t) for f, low in ((1, 2), (2, 4)) for t in own[:, low : low + 2].ravel() if np.isfinite(t)}
                at = np.array(sorted({0, *[c for end in ends for c in cuts[end]]}), np.int64)
                sine, cosine = angles(at, period)
                score = 0.5 - np.exp2(-mean_path(np.stack([np.full(len(at), float(code)), sine, cosine], axis=1), *trees) / scale)
                new = np.concatenate([[True], score[1:] != score[:-1]])
                at, score = at[new], score[new]
                first = np.searchsorted(at, opens, side="right") - 1
                last = np.append(np.searchsorted(at, opens[1:], side="left") - 1, len(at) - 1)
                rows = [(number, cell, at[a + 1 : b + 1].tolist(), score[a : b + 1].tolist()) for cell, (a, b) in enumerate(zip(first, last))]
                yield pd.DataFrame(rows, columns=["range", "cell", "at", "score"])

    tasks = min(len(starts), 4 * spark.sparkContext.defaultParallelism)
    listed = spark.createDataFrame([(i, s) for i, s in enumerate(starts)], "range int, code int").repartition(tasks)
    table = stage_measured(listed.mapInPandas(steps, "range int, cell long, at array<long>, score array<double>"), "forest_steps")
    most = table.table.agg(F.max(F.size("at"))).first()[0]
    return Steps(table, starts, cells, most)


def with_forest_score_by_time(
    points: DataFrame,
    forest: Forest,
    ts: str = "dt",
    code: str = FEATURES[0],
    period_seconds: float = DAY_SECONDS,
    name: str = "iforest_score",
) -> DataFrame:
    """As ``with_forest_score`` of a forest over ``FEATURES``, from the label code and the
    time itself: a broadcast look-up and some comparisons, without Python.
    The scores are the same for a forest fitted on exact features (see ``cyclical``).

    Null if the time or the code is. A forest with too many steps to be broadcast, or
    over a period that is not of whole microseconds, is scored in Python; ``points`` must
    then have the features.
    """
    if forest.psi == 0:  # no row had all features
        return points.withColumn(name, F.lit(None).cast("double"))
    if tuple(forest.features) != FEATURES:
        raise ValueError(f"the steps need a forest over {FEATURES}")
    whole = float(period_seconds * MICROS_PER_SECOND).is_integer()
    steps = forest_steps(points.sparkSession, forest, period_seconds) if whole else None
    if steps is None:
        return with_forest_score(points, forest, name)
    period = int(round(period_seconds * MICROS_PER_SECOND))
    here = micros_of_bin(F.col(ts), period_seconds)
    # No box ends at a code below 0 or beyond the last range's first.
    last = steps.starts[-1]
    bounded = F.when(F.col(code) > last, last).when(F.col(code) < 0, 0).otherwise(F.col(code)).cast("int")
    cell = F.call_function("div", F.col("_here") * F.lit(steps.cells), F.lit(period))
    placed = points.withColumns({"_here": here, "_range": bounded}).withColumn("_cell", cell)
    if steps.starts != list(range(len(steps.starts))):
        spans = zip(steps.starts, [s - 1 for s in steps.starts[1:]] + [last])
        ranges = points.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spans)], "_number int, a int, b int")
        # No more rows than labels.
        by_code = ranges.select("_number", F.explode(F.sequence("a", "b")).alias("_range"))
        placed = lookup(placed, by_code, ["_range"], facts_bytes=STEP_BYTES * last).withColumn("_range", F.col("_number")).drop("_number")
    facts = steps.table.table.toDF("_range", "_cell", "_at", "_scores")
    found = lookup(placed, facts, ["_range", "_cell"], facts_bytes=steps.table.bytes)
    begun = [F.when(F.get("_at", F.lit(i)) <= F.col("_here"), 1).otherwise(0) for i in range(steps.most)]
    return found.withColumn(name, F.get("_scores", sum(begun, start=F.lit(0)))).select(*points.columns, name)
