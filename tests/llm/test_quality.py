import random

import numpy as np
from pyspark.sql import functions as F

from hearthlog.llm import quality


def slope_by_differences(at, loss):
    found = np.zeros_like(at)
    for i in range(len(at)):
        step = np.zeros_like(at)
        step[i] = 1e-6
        found[i] = (loss(at + step)[0] - loss(at - step)[0]) / 2e-6
    return found


def test_loss_slope():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 4, 30)
    rows, columns = np.repeat(np.arange(30), 3), rng.integers(0, 5, 90)
    loss = lambda x: quality._loss(x, grades, rows, columns, 4)
    at = rng.normal(size=8) * 0.5
    assert np.allclose(loss(at)[1], slope_by_differences(at, loss), rtol=1e-4, atol=1e-4)


def test_model_orders_grades():
    rng = np.random.default_rng(3)
    slots, grades = [], []
    for _ in range(1500):
        grade = rng.integers(0, 3)
        faults = [1, 2, 3][: 2 - grade] if grade < 2 else []
        slots.append(np.array([*faults, *rng.integers(10, 400, 20)], dtype=np.int32))
        grades.append(grade)
    model = quality.fit_ordinal([np.unique(s) for s in slots], np.array(grades))
    assert (np.diff(model.thresholds) > 0).all()
    expected = [quality.judge(quality.score_of(np.array(s), model), model)[0] for s in ([1, 2], [1], [])]
    assert expected == sorted(expected) and expected[0] < 0.5 and expected[2] > 1.5
    assert quality.judge(0.0, quality.fit_ordinal([], np.empty(0, np.int64))) == (0.0, 1.0)


def corpus(rng, n):
    words = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        junk, toxic = rng.random() < 0.15, rng.random() < 0.15
        if junk:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["awful", "nasty"]))
        rows.append((i, " ".join(text)))
        marks.append((i, int(not junk), int(toxic)))
    return rows, marks


def test_held_out_accuracy_and_odd_rows(spark):
    rows, marks = corpus(random.Random(1), 1200)
    odd = [(5000, None), (5001, ""), (None, rows[0][1]), (5002, "word1 word2 " * 40000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows + odd], "doc_id long, text string, expected_grade double, judged string").repartition(5)
    rated = marks[:800] + [(None, 1, 0), (7, None, 0), (9, 1, None), (marks[5][0], 0, 1)]
    labels = spark.createDataFrame(rated, "doc_id long, quality int, toxic int")
    ratings = labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    kept = quality.select_quality(docs, ratings)
    assert kept.schema == docs.schema
    ids = {r["doc_id"] for r in kept.collect()}
    held = marks[800:]
    assert np.mean([(i in ids) == (q == 1 and x == 0) for i, q, x in held]) > 0.97
    empty = docs.where("false")
    assert quality.select_quality(empty, ratings).count() == 0
    assert quality.select_quality(docs, ratings.where("false")).count() == docs.count()


def test_partitions_do_not_matter(spark):
    rows, marks = corpus(random.Random(2), 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ratings = spark.createDataFrame([(i, q + 1 - x) for i, q, x in marks], "doc_id long, grade int")
    one, many = (quality.fit_quality(docs.repartition(n), ratings) for n in (1, 7))
    assert one.weights == many.weights and (one.thresholds == many.thresholds).all()


def test_the_model_runs_once_per_text(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    scored = quality.with_quality(docs, quality.Model({}, np.array([0.0, 1.0]))).where("top_chance >= 0.1")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_rated_id_on_many_rows_counts_once(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(i, "word word") for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(1, 30)], "doc_id long, grade int")
    once = docs.where("doc_id > 1 or text = 'text 0'")
    one, many = (quality.fit_quality(d, ratings) for d in (once, docs))
    assert one.weights == many.weights and (one.thresholds == many.thresholds).all()
