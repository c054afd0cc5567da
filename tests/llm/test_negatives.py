"""Hard negatives against plain loops over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthlog.llm.negatives import mine_hard_negatives
from hearthlog.llm.rtree import Search, pack

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, positives=5, negatives=10, low=30, high=90):
    usable = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable[(key, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector))] = 1
    width = max([len(v) for _, _, v in usable], default=0)
    table = [(key, label, np.array(v + (0,) * (width - len(v)), dtype=object)) for key, label, v in usable]
    found = []
    for key, label, vector in table:
        if key % 100:
            continue
        scored = sorted((-sum(vector * v), k, l) for k, l, v in table if k != key)
        same = [(k, -s) for s, k, l in scored if l == label][:positives]
        for positive, best in same:
            fits = [(k, -s) for s, k, l in scored if l != label and low * best <= 100 * -s <= high * best]
            found += [(key, positive, r + 1, k, best, s) for r, (k, s) in enumerate(fits[:negatives])]
    return sorted(found)


def mined(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).withColumn("anchor", F.lit("x")).withColumn("tile", F.lit(1.5))
    found = mine_hard_negatives(table, F.col("id") % 100 == 0, **options)
    return sorted(map(tuple, found.collect()))


def table_of(n, seed, width=6, labels=4, ties=False):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.3, (n, width))
    if ties:
        vectors = np.round(vectors * 4) / 4
        vectors[: n // 3] = vectors[0]
    return [(int(i) * 10, v.tolist(), int(l)) for i, (v, l) in enumerate(zip(vectors, rng.integers(0, labels, n)))]


@pytest.mark.parametrize("ties", [False, True])
def test_against_loops_with_small_trees(spark, ties):
    rows = table_of(400, 3 + ties, ties=ties)
    assert mined(spark, rows, subtree_rows=37, anchor_chunk=7, leaf_rows=5) == expected(rows)


def test_one_tree(spark):
    rows = table_of(600, 9, labels=2)
    assert mined(spark, rows) == expected(rows)


def test_odd_rows(spark):
    rows = table_of(120, 5, width=3)
    rows += rows[:15]  # repeats
    rows += [(0, [0.5, 0.5, 0.5], 1), (10, [0.1, 0.2, 0.3], 0)]  # an id again, with other values
    rows += [(None, [0.1, 0.2, 0.3], 1), (5000, None, 1), (5100, [0.1, 0.1, 0.1], None), (5200, [None, 0.1, 0.1], 1)]
    rows += [(5300, [float("nan"), 0.1, 0.1], 2), (5400, [float("inf"), 0.1, 0.1], 2), (5500, [], 3), (5600, [0.4], 1), (-100, [0.3, 0.2, 0.9], 2)]
    assert mined(spark, rows, subtree_rows=16, anchor_chunk=5, leaf_rows=4) == expected(rows)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [0.1], 1)]) == []
    assert mined(spark, [(0, [], 1), (1, [], 1), (2, [], 2)]) == expected([(0, [], 1), (1, [], 1), (2, [], 2)]) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, [(0, [0.5], 1), (1, [-0.5], 1), (2, [-0.4], 2)]) == []  # a window below zero is empty


def test_too_large_raises(spark):
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_boxes_are_left_out():
    """Rows in clusters: most boxes cannot hold any of the first rows."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 100, (50, 4))
    vectors = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 1, (10_000, 4)))
    ids, labels = np.arange(10_000), np.zeros(10_000, np.int64)
    tree = pack(ids, labels, vectors, 50)
    assert sorted(tree.ids.tolist()) == ids.tolist() and len(tree.levels[-1].first) == 1
    who = np.arange(0, 10_000, 500)
    wide = np.full((len(who), 1), np.inf)
    search = Search(ids[who], labels[who], vectors[who], -wide, wide, 5, True)
    search.visit(tree)
    assert search.rows < 0.3 * len(who) * 10_000
    for row, at in enumerate(who):
        scores = vectors @ vectors[at]
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != at)[:5]
        own = search.owner == row
        assert sorted(zip(-search.score[own], search.found[own])) == best
