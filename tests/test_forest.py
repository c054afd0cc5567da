"""Labels, features and the isolation forest."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import at, make_log

from hearthlog.operators import forest, labels

KEY = ["dt", "sensor", "id"]


def planted(spark):
    """500 readings of two sensors near noon and one of Z at three in the morning."""
    rng = random.Random(5)
    rows = [(43200 + rng.gauss(0, 1200), rng.choice("AB")) for _ in range(500)]
    return make_log(spark, [*rows, (10800, "Z")])


def test_label_codes_are_alphabetical_with_nulls_last(spark):
    log = make_log(spark, [(0, "b"), (1, "a"), (2, None), (3, "C"), (4, "b")])
    coded = labels.with_label_code(log)
    assert {r["id"]: r["sensorEnc"] for r in coded.collect()} == {0: 2, 1: 1, 2: 3, 3: 0, 4: 2}


def test_cyclical_features(spark):
    log = make_log(spark, [(0, "A"), (21600, "A"), (64800.5, "A"), (None, "A")])
    found = {r["id"]: r for r in labels.with_cyclical(log).collect()}
    for i, seconds in enumerate([0, 21600, 64800.5]):
        angle = seconds / 86400 * 2 * math.pi
        assert found[i]["sinTransform"] == pytest.approx(math.sin(angle), abs=1e-9)
        assert found[i]["cosTransform"] == pytest.approx(math.cos(angle), abs=1e-9)
    assert found[3]["sinTransform"] is None


def test_cyclical_features_ignore_the_session_zone(spark):
    skipped = 69 * 86400 + 2.5 * 3600  # does not exist in New York
    found = labels.with_cyclical(make_log(spark, [(skipped, "A")])).first()
    assert found["sinTransform"] == pytest.approx(math.sin(2.5 / 24 * 2 * math.pi), abs=1e-9)


def test_average_path():
    assert [forest.average_path(n) for n in (0, 1, 2)] == [0, 0, 1]
    assert forest.average_path(256) == pytest.approx(10.244771, abs=1e-6)


def test_trees_separate_all_points_or_reach_the_limit():
    points = np.random.default_rng(1).random((256, 3))
    nodes = {n: (f, path) for n, f, _, path, _ in forest.grow_tree(points, np.random.default_rng(2))}
    assert max(nodes) <= 2 ** (8 + 1) - 2
    for node, (feature, _) in nodes.items():
        assert (feature >= 0) == (2 * node + 1 in nodes) == (2 * node + 2 in nodes)
    same = forest.grow_tree(np.ones((10, 3)), np.random.default_rng(0))
    assert same == [(0, -1, 0.0, forest.average_path(10), 10)]


def test_scores_equal_a_walk_through_the_nodes(spark):
    points = labels.with_features(planted(spark)).cache()
    model = forest.fit_forest(points, KEY, trees=20, seed=3)
    tables = [dict(zip(t["node"], t.itertuples())) for _, t in model.nodes.groupby("tree")]

    def walk(row):
        x, total = [row[f] for f in labels.FEATURES], 0.0
        for table in tables:
            node = 0
            while table[node].feature >= 0:
                node = 2 * node + (1 if x[table[node].feature] < table[node].threshold else 2)
            total += table[node].path
        return 0.5 - 2 ** (-total / len(tables) / forest.average_path(model.psi))

    for row in forest.with_forest_score(points, model).collect():
        assert row["iforest_score"] == pytest.approx(walk(row), abs=1e-12)
        assert -0.5 <= row["iforest_score"] <= 0.5


def test_planted_reading_has_the_lowest_score(spark):
    points = labels.with_features(planted(spark))
    scored = forest.with_forest_score(points, forest.fit_forest(points, KEY))
    lowest = scored.orderBy("iforest_score").first()
    assert lowest["sensor"] == "Z" and lowest["iforest_score"] < -0.15


@pytest.mark.parametrize("trees, per_tree", [(10, 256), (4, 32)])
def test_forest_does_not_depend_on_partitions(spark, trees, per_tree):
    log = labels.with_features(planted(spark)).cache()
    fits = [
        forest.fit_forest(log.repartition(n), KEY, trees=trees, sample_per_tree=per_tree, seed=9)
        for n in (1, 8)
    ]
    pd.testing.assert_frame_equal(fits[0].nodes, fits[1].nodes)
    assert fits[0].psi == min(per_tree, 501)
    other = forest.fit_forest(log, KEY, trees=trees, sample_per_tree=per_tree, seed=10)
    assert not other.nodes.equals(fits[0].nodes)


@pytest.mark.parametrize("rows", [40, 100, 639, 640, 9000])
def test_every_tree_draws_on_its_own(spark, rows):
    """The same rule below and above trees x sample size."""
    points = labels.with_features(make_log(spark, [(60 * i, f"s{i % 9}") for i in range(rows)]))
    sample, psi = forest.draw_samples(points, KEY, list(labels.FEATURES), 10, 64, 1)
    found = sample.toPandas()
    assert psi == min(64, rows)
    assert found.groupby("tree").size().to_dict() == {t: psi for t in range(10)}
    own = found.groupby("tree")[["sinTransform", "cosTransform", "sensorEnc"]].apply(lambda t: len(t.drop_duplicates()))
    assert rows > 1440 or (own == psi).all()


def test_copies_of_few_readings_are_scored(spark):
    log = make_log(spark, [(i % 5, "A") for i in range(40)]).drop("id")
    many = log.crossJoin(spark.range(5000)).drop("id")
    points = labels.with_features(many)
    model = forest.fit_forest(points, ["dt", "sensor"], trees=4, sample_per_tree=32)
    assert model.psi == 32 and model.nodes["size"].sum() == 4 * 32
    scored = forest.with_forest_score(points, model)
    assert scored.where("iforest_score is null").count() == 0 and scored.count() == 200_000


def test_null_times_are_not_scored(spark):
    points = labels.with_features(make_log(spark, [(i, "A") for i in range(50)] + [(None, "A")]))
    scored = forest.with_forest_score(points, forest.fit_forest(points, KEY, trees=5))
    assert [r["id"] for r in scored.where("iforest_score is null").collect()] == [50]
    empty = points.limit(0)
    assert forest.with_forest_score(empty, forest.fit_forest(empty, KEY)).count() == 0
    nothing = points.where("dt is null")
    scored = forest.with_forest_score(nothing, forest.fit_forest(nothing, KEY))
    assert scored.first()["dt"] is None and scored.first()["iforest_score"] is None
    assert at(None) is None
