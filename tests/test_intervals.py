"""Readings in intervals against the nested loop."""

import random

import pytest
from conftest import at, make_log
from pyspark.sql import functions as F

from hearthlog.operators import lookup
from hearthlog.operators.intervals import readings_in_intervals


def spans_of(spark, rows):
    return spark.createDataFrame([(i, at(a), at(b)) for i, (a, b) in enumerate(rows)], "span int, start timestamp_ntz, end timestamp_ntz")


@pytest.mark.parametrize("limit", [None, 0])
def test_against_the_nested_loop(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(lookup.lookup, "__defaults__", ("left", None, limit, None))
    rng = random.Random(8)
    log = make_log(spark, [(rng.uniform(-90_000, 500_000), "A") for _ in range(700)] + [(1000, "A")] * 200 + [(None, "A")])
    rows = [(s := rng.uniform(-90_000, 500_000), s + 60 * 2 ** rng.uniform(-8, 13)) for _ in range(80)]
    rows += [(1000, 1000), (1000, 1000), (900, 100), (None, 5), (5, None), (0, 60), (0, 120), (-90_000, 5 * 10**7)]
    spans = spans_of(spark, rows)
    found = readings_in_intervals(log, spans)
    assert found.columns == [*log.columns, *spans.columns]
    expected = log.join(spans, F.col("dt").between(F.col("start"), F.col("end")))
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides_and_clashing_names(spark):
    log, spans = make_log(spark, [(1, "A")]), spans_of(spark, [(0, 2)])
    assert readings_in_intervals(log, spans).count() == 1
    assert readings_in_intervals(log.where("false"), spans).count() == 0
    assert readings_in_intervals(log, spans.where("false")).count() == 0
    with pytest.raises(ValueError, match="both have"):
        readings_in_intervals(log, spans.withColumnRenamed("span", "id"))


@pytest.mark.parametrize("limit", [None, 0])
def test_totals_against_the_grouped_nested_loop(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(lookup.lookup, "__defaults__", ("left", None, limit, None))
    rng = random.Random(9)
    log = make_log(spark, [(rng.choice([rng.uniform(-900, 5000), rng.randrange(0, 4000, 500)]), "A") for _ in range(600)] + [(None, "A")])
    # Sums of all readings pass a bigint, and some intervals hold nulls alone.
    log = log.withColumn("big", F.when(F.col("id") % 2 == 0, F.lit(2**62) - F.col("id")).when(F.col("id") % 3 == 0, F.col("id") - F.lit(2**62)))
    rows = [(s := rng.choice([rng.uniform(-900, 5000), rng.randrange(0, 4000, 500)]), s + rng.choice([0, 0.5, 10, 500, 3000])) for _ in range(150)]
    rows += [(1000, 1000), (900, 100), (None, 5), (5, None), (-9000, 9 * 10**7)]
    spans = spans_of(spark, rows).selectExpr("nullif(span % 40, 7) as one", "span % 3 as two", "start", "end")
    met = log.join(spans, F.col("dt").between(F.col("start"), F.col("end")))
    expected = met.groupBy("one", "two").agg(F.count("*").alias("m"), F.sum("id").alias("ids"), F.sum(F.col("big").cast("decimal(38,0)")).alias("big"))
    fits = expected.where("big is null or abs(big) < 9000000000000000000").withColumn("big", F.col("big").cast("long"))
    found = readings_in_intervals(log, spans, per=["one", "two"], count="m", sums={"ids": "id"})
    assert found.columns == ["one", "two", "m", "ids"]
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.drop("big").collect()))
    kept = spans.join(fits.select("one", "two"), spans.one.eqNullSafe(fits.one) & spans.two.eqNullSafe(fits.two), "left_semi")
    found = readings_in_intervals(log, kept, per=["one", "two"], count="m", sums={"ids": "id", "big": "big"})
    assert sorted(map(str, found.collect())) == sorted(map(str, fits.collect()))
    assert readings_in_intervals(log.where("false"), spans, per=["one"]).count() == 0
    assert readings_in_intervals(log, spans.where("false"), per=["one"]).count() == 0
    with pytest.raises(ValueError, match="whole numbers"):
        readings_in_intervals(log, spans, per=["one"], sums={"s": "sensor"})


def test_totals_make_no_pairs(spark):
    n = 300_000  # 90 thousand million pairs
    log = spark.range(n).selectExpr("id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 1000) as dt")
    spans = spark.range(n).selectExpr(
        "id as span", "timestamp_ntz'2023-12-31' as start", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 2000) as end"
    )
    found = readings_in_intervals(log, spans, per=["span"], sums={"ids": "id"})
    whole, row = n * (n - 1) // 2, F.least(F.col("span") % 2000, F.lit(999)) + 1
    assert found.count() == n
    assert found.where(F.col("n") != row * (n // 1000)).count() == 0
    assert found.where("span % 2000 >= 999").select("ids").distinct().collect() == [(whole,)]


def test_the_query_makes_no_pairs(spark, tmp_path, monkeypatch):
    import test_queries

    spark.range(3000).selectExpr(
        "id as event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id % 700) as ts", "60L as user_id",
        "if(id % 3 = 0, 'purchase', 'view') as event_type", "1.0D as value", "'' as props",
    ).write.parquet(f"{tmp_path}/events.parquet")
    rows, plain = [], test_queries.entry.intervals.readings_in_intervals

    def counted(*args, **kwargs):
        found = plain(*args, **kwargs)
        rows.append(found.count())
        return found

    monkeypatch.setattr(test_queries.entry.intervals, "readings_in_intervals", counted)
    found = test_queries.entry.QUERIES["interval_overlay"](spark, str(tmp_path))
    assert rows == [1000]  # a row per span, not one per span and reading
    assert found.agg(F.min("n")).first()[0] > 1
