"""Pairs at one time, kept as lists."""

import random

from conftest import make_log
from pyspark.sql import functions as F

from hearthlog.operators.attach import count_pairs, expand_pairs, factor_by_time


def test_pairs_equal_the_join_and_grow_with_the_input(spark):
    rng = random.Random(2)
    rows = [(rng.choice([5, 5, 5, 6, 7, None]), rng.choice("ABC")) for _ in range(900)]
    log = make_log(spark, rows).withColumns({"v": F.col("id") % 300, "p": F.when(F.col("id") % 11 > 0, F.col("id") % 200 / 200)})
    factored = factor_by_time(log, log, "v", "p", piece_values=16)
    for side in (factored.readings, factored.scores):
        assert side.select(F.sum(F.size("entries"))).first()[0] <= 900
        assert side.select(F.max(F.size("entries"))).first()[0] < 64
    low = lambda v: v < 40
    small = lambda p: p < 0.1
    other = log.select("dt", F.col("p").alias("signal"))
    joined = log.select("dt", F.col("v").alias("value")).join(other, "dt").where((F.col("value") < 40) & (F.col("signal") < 0.1))
    counts = joined.groupBy("dt").agg(F.count("*").alias("n_pairs"))
    pairs = joined.groupBy("dt", "value", "signal").agg(F.count("*").alias("n_pairs"))
    assert sorted(map(str, count_pairs(factored, low, small).collect())) == sorted(map(str, counts.collect()))
    assert sorted(map(str, expand_pairs(factored, low, small).collect())) == sorted(map(str, pairs.collect()))


def test_empty_sides(spark):
    log = make_log(spark, [(1, "A"), (None, "B")]).withColumn("p", F.lit(0.5))
    nothing = factor_by_time(log, log.where("false"), "id", "p")
    assert count_pairs(nothing, lambda v: v >= 0, lambda p: p >= 0).count() == 0
    assert expand_pairs(nothing, lambda v: v >= 0, lambda p: p >= 0).count() == 0
