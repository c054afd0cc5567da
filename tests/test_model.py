"""Summaries of runs for any split, and a model that outlives its log."""

import random

import pytest
from conftest import make_log
from pyspark.sql import functions as F

from hearthlog.operators import markov, summaries
from hearthlog.plans import jobs, model
from hearthlog.settings import Settings

DAY = 86_400
ORDER = ["dt", "sensor", "id"]


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, 3, 9]) * DAY + rng.randrange(DAY // 600) * 600, rng.choice(["A", "B", "C", None])) for _ in range(600)]
    return make_log(spark, rows + [(None, "A"), (None, None), (None, "B")]).cache()


@pytest.mark.parametrize("cuts", [[], [DAY], [5, DAY + 7, 2 * DAY], [0, 9 * DAY, 20 * DAY]])
def test_summaries_of_any_split_add_up(spark, log, tmp_path, cuts):
    path = str(tmp_path / "summary")
    seconds = F.coalesce(F.unix_timestamp(F.col("dt").cast("timestamp")), F.lit(2**40))
    base = F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    ends = [-(10**9), *cuts, 10**15]
    for low, high in zip(ends, ends[1:]):
        part = log.where((seconds - base >= low) & (seconds - base < high))
        summaries.append_summary(summaries.summarise(part, ORDER), path)
    found = summaries.transitions_of(summaries.read_summary(spark, path))
    expected = markov.transition_table(markov.with_next_sensor(log, ORDER))
    assert rows_of(found.withColumn("p", F.round("p", 12))) == rows_of(expected.withColumn("p", F.round("p", 12)))


def test_overlapping_runs_raise(spark, log, tmp_path):
    path = str(tmp_path / "summary")
    for part in ("id % 2 = 0", "id % 2 = 1"):
        summaries.append_summary(summaries.summarise(log.where(part), ORDER), path)
    with pytest.raises(Exception, match="runs overlap on 2024-01-01"):
        summaries.transitions_of(summaries.read_summary(spark, path))


def test_the_model_scores_its_own_log_as_the_job_does(spark, log, tmp_path):
    settings = Settings(trees=8, forest_seed=3)
    fitted = model.fit_model(log, ORDER, settings)
    model.save_model(fitted, str(tmp_path / "model"))
    again = model.load_model(spark, str(tmp_path / "model"))
    own = jobs.score(log, ORDER, settings).select("id", "markov_prob", "iforest_score")
    for one in (fitted, again):
        scored = model.apply_model(one, log, ORDER).select("id", "markov_prob", "iforest_score")
        assert rows_of(scored) == rows_of(own)


def test_unseen_labels_and_transitions(spark, tmp_path):
    seen = make_log(spark, [(0, "A"), (1, "B"), (2, "A"), (3, "A"), (4, "C")])
    one = model.fit_model(seen, ORDER, Settings(trees=5))
    later = make_log(spark, [(10, "A"), (11, "B"), (12, "C"), (13, "new"), (14, "A"), (15, None), (16, "B"), (17, "B")])
    rows = {r["id"]: r for r in model.apply_model(one, later, ORDER).collect()}
    known = [r["markov_prob"] for _, r in sorted(rows.items())]
    # A>B 1/3; B>C unseen; C leads nowhere in the model; new unknown; A>null; null>B; B>B unseen; last
    assert known == [pytest.approx(1 / 3), 0.0, None, None, None, None, 0.0, None]
    assert rows[3]["iforest_score"] is not None and rows[5]["iforest_score"] is not None
    assert model.apply_model(one, later.where("false"), ORDER).count() == 0
    empty = model.fit_model(seen.where("false"), ORDER, Settings(trees=5))
    model.save_model(empty, str(tmp_path / "empty"))
    assert model.apply_model(model.load_model(spark, str(tmp_path / "empty")), later, ORDER).where("iforest_score is not null or markov_prob is not null").count() == 0
