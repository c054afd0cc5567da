"""No plan sends a whole log through one partition."""

import re

import pytest
from conftest import make_log

from hearthlog.operators import cleaning, days, labels, markov, ordering
from hearthlog.plans import jobs


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "readings")
    make_log(spark, [(60 * i, f"s{i % 5}") for i in range(3000)]).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_debounce_is_one_exchange_with_partial_aggregation(log):
    text = plan(cleaning.debounce(log, ["id"]))
    assert text.count("Exchange") == 1
    assert "partial_min" in text and "Window" not in text


def test_clean_exchanges_once(spark, log):
    delays = spark.createDataFrame([("s1", 2.0)], "sensor string, delay double")
    text = plan(jobs.clean(log, delays, ["id"]))
    assert len(re.findall(r" Exchange (hash|range|Single)", text)) == 1
    assert "BroadcastHashJoin" in text


def test_scoring_neither_shuffles_nor_collects_the_log(log):
    """What is left after the staged layout is scans, broadcasts and the window
    over one row per chunk."""
    text = plan(markov.with_markov_prob(log, ["dt", "sensor", "id"]))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text
    single = re.findall(r"Exchange SinglePartition.*\n.*\n(?:.*\n)?.*Scan parquet \[(.*?)\]", text)
    assert all("_chunk" in columns and "dt#" not in columns for columns in single)
    assert text.count("SinglePartition") == 1
    assert "_edge" in text and "EqualTo(_edge,true)" in text


def test_features_are_a_broadcast_lookup(log):
    text = plan(labels.with_features(log))
    assert "SortMergeJoin" not in text and "hashpartitioning" not in text.split("Broadcast")[0]


def test_day_tables_read_two_columns(log):
    text = plan(days.day_bounds(days.last_days(log, 3)))
    assert "ReadSchema: struct<dt:timestamp_ntz>" in text
    assert "GreaterThanOrEqual(dt" in text
    assert "partial_count" in text


def test_the_order_takes_one_exchange_of_the_log(log):
    text = plan(ordering._pass(log, ["dt", "sensor", "id"], ["sensor"], 1, None))
    assert text.count("Exchange") == 1 and "Exchange rangepartitioning" in text and "Window" not in text
