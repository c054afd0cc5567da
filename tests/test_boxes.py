"""The forest as boxes and as steps against the walk through its trees."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import START
from pyspark.sql import functions as F

from hearthlog.operators import boxes, forest, labels

PERIOD = 86_400_000_000


def log_of(spark, rows):
    data = [(i, None if s is None else START + dt.timedelta(seconds=s), name) for i, (s, name) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, dt timestamp_ntz, sensor string")


def fitted(spark, n=2000, names=7, whole=False, trees=30):
    rng = np.random.default_rng(n + names)
    seconds = rng.uniform(0, 20 * 86400, n)
    if whole:  # times of day that repeat
        seconds = np.round(seconds / 900) * 900
    points = labels.with_features(log_of(spark, [(float(s), f"s{rng.integers(names)}") for s in seconds]), exact=True)
    return points, forest.fit_forest(points, ["dt", "sensor", "id"], trees=trees, seed=5)


def test_each_point_lies_in_one_box_of_a_tree(spark):
    points, model = fitted(spark, 500)
    table = boxes.leaf_boxes(model)
    assert len(table) == (model.nodes["feature"] < 0).sum()
    rows = np.array(points.select(*labels.FEATURES).collect(), dtype=float)
    walked = forest.mean_path(rows, *forest._full_trees(model))
    low, high = (table[[f"{end}{i}" for i in (1, 2, 3)]].to_numpy() for end in ("lo", "hi"))
    inside = ((rows[:, None] >= low) & (rows[:, None] < high)).all(axis=2)
    for tree in range(30):
        assert (inside[:, (table["tree"] == tree).to_numpy()].sum(axis=1) == 1).all()
    assert np.allclose(inside @ table["h"].to_numpy() / 30, walked, atol=1e-12)


def test_crossings_are_the_first_places_behind_a_change():
    period = 1000
    thresholds = np.array([-1.0, -0.9999, -0.5, 0.0, 1e-9, 0.3, 0.9999, 1.0, 1.5])
    for which in (0, 1):
        values = boxes.angles(np.arange(period), period)[which]
        for threshold, found in zip(thresholds, boxes.crossings(thresholds, which, period)):
            below = values < threshold
            assert found.tolist() == (np.flatnonzero(below[1:] != below[:-1]) + 1).tolist()


@pytest.mark.parametrize("n,names,whole", [(2000, 7, False), (2000, 40, True), (3, 2, False), (1, 1, False), (300, 1, True)])
def test_steps_score_as_the_trees_do(spark, n, names, whole):
    points, model = fitted(spark, n, names, whole)
    later = log_of(spark, [(s / 7.0, f"s{s % names}") for s in range(0, 900_000, 611)] + [(s * 900.0, "s0") for s in range(200)])
    seen = points.select("sensor").unionByName(spark.createDataFrame([("zz",)], "sensor string"))
    later = labels.with_features(later.unionByName(log_of(spark, [(5.0, None)])), labels=seen, exact=True)
    for table in (points, later):
        scored = boxes.with_forest_score_by_time(forest.with_forest_score(table, model, "walked"), model, name="looked_up")
        assert scored.where(~F.col("walked").eqNullSafe(F.col("looked_up"))).count() == 0


def test_nulls_and_codes_beyond_all_boxes(spark):
    points, model = fitted(spark, 400)
    clash = points.withColumns({"range": F.lit("x"), "cell": F.lit(1.5), "at": F.lit(2), "score": F.lit(True)})
    assert boxes.with_forest_score_by_time(clash, model).columns == [*clash.columns, "iforest_score"]
    odd = spark.createDataFrame([(1, START, None), (2, None, 3), (3, START, 10_000), (4, START, 6)], "id int, dt timestamp_ntz, sensorEnc long")
    rows = {r["id"]: r["iforest_score"] for r in boxes.with_forest_score_by_time(odd, model).collect()}
    assert rows[1] is None and rows[2] is None and rows[3] == rows[4]


def test_empty_forest_and_other_periods(spark):
    points, model = fitted(spark, 300)
    empty = forest.Forest(model.nodes.head(0), 0)
    assert boxes.with_forest_score_by_time(points, empty).where("iforest_score is not null").count() == 0
    for period in (3600.0, 7 * 86400.0, 10 / 3):
        shifted = labels.with_features(points.select("id", "dt", "sensor"), period_seconds=period, exact=True)
        own = forest.fit_forest(shifted, ["dt", "sensor", "id"], trees=10, seed=1)
        both = boxes.with_forest_score_by_time(forest.with_forest_score(shifted, own, "walked"), own, period_seconds=period, name="looked_up")
        assert both.where(~F.col("walked").eqNullSafe(F.col("looked_up"))).count() == 0


def test_large_forests_are_scored_in_python(spark, monkeypatch):
    points, model = fitted(spark, 300)
    monkeypatch.setattr(boxes, "STEP_BYTES", 1 << 40)
    assert boxes.forest_steps(spark, model) is None
    scored = boxes.with_forest_score_by_time(forest.with_forest_score(points, model, "walked"), model, name="looked_up")
    assert scored.where("walked != looked_up").count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    points, model = fitted(spark, 300)
    ready = spark.createDataFrame([(1, START, 2)], "id int, dt timestamp_ntz, sensorEnc long")
    plan = boxes.with_forest_score_by_time(ready, model)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    for name in ("ArrowEvalPython", "MapIn", "NestedLoop", "Exchange hashpartitioning", "Exchange range"):
        assert name not in plan


def test_other_features_raise(spark):
    nodes = pd.DataFrame([(0, 0, -1, 0.0, 1.0)], columns=["tree", "node", "feature", "threshold", "path"])
    with pytest.raises(ValueError, match="steps need"):
        boxes.with_forest_score_by_time(spark.range(1), forest.Forest(nodes, 4, ("a", "b")))
