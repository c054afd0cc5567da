"""Both ways of joining with a fact table give the same rows."""

import pytest
from conftest import make_log

from hearthlog.operators.lookup import lookup
from hearthlog.staging import measure, stage_measured


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_shuffled_lookup_equals_broadcast(spark, how):
    sensors = ["H"] * 600 + [f"s{i}" for i in range(50)] * 4 + [None] * 200
    log = make_log(spark, [(i, s) for i, s in enumerate(sensors)])
    facts = spark.createDataFrame(
        [("H", 1)] + [(f"s{i}", i) for i in range(0, 70, 2)], "sensor string, fact int"
    )
    small = lookup(log, facts, ["sensor"], how)
    large = lookup(log, facts, ["sensor"], how, limit_bytes=0)
    assert set(small.columns) == set(large.columns)
    order = sorted(small.columns)
    rows = lambda df: sorted(df.select(order).collect(), key=str)
    assert rows(small) == rows(large)
    assert "Broadcast" in small._jdf.queryExecution().toString()


def test_hot_key_is_spread(spark):
    log = make_log(spark, [(i, "H") for i in range(4000)] + [(i, f"s{i}") for i in range(4000)])
    facts = spark.createDataFrame([("H", 1)], "sensor string, fact int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup(log, facts, ["sensor"], limit_bytes=0)
        sizes = joined.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 8000
    assert max(sizes) < 4000


def test_measured_bytes_grow_with_the_table(spark):
    one = spark.createDataFrame([("abc", 1)], "sensor string, fact int")
    assert 0 < measure(one).bytes < measure(one.union(one)).bytes
    assert measure(one.union(one)).rows == 2
    assert measure(one.limit(0)) == (0, 0)


def test_size_taken_while_writing(spark):
    log = make_log(spark, [(i, f"s{i}") for i in range(500)])
    staged = stage_measured(log, "facts")
    assert staged.bytes == measure(log).bytes and staged.table.count() == 500
    assert stage_measured(log.where("id > 900").groupBy("sensor").count(), "none").bytes == 0


def test_limit_is_read_when_called(spark, monkeypatch):
    log = make_log(spark, [(1, "a"), (2, "b")])
    facts = spark.createDataFrame([("a", 1)], "sensor string, fact int")
    monkeypatch.setattr("hearthlog.operators.lookup.BROADCAST_LIMIT_BYTES", 0)
    joined = lookup(log, facts, ["sensor"])
    assert "SortMergeJoin" in joined._jdf.queryExecution().toString()
    assert sorted((r["sensor"], r["fact"]) for r in joined.collect()) == [("a", 1), ("b", None)]
