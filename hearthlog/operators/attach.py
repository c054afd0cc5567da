"""Attaching a separate score table to the readings it was computed from."""

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.operators.lookup import lookup
from hearthlog.staging import stage, stage_measured


def attach_by_key(readings: DataFrame, scores: DataFrame, key: list[str]) -> DataFrame:
    """Left join on ``key``, which must be unique in ``scores``; repeated keys raise.

    Readings with a null in the key match nothing, a key that very many readings have is
    split.
    """
    known = stage_measured(scores.dropna(subset=key), "scores")
    repeated = known.table.groupBy(*key).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"several scores for {repeated[0].asDict()}")
    columns = [*readings.columns, *[c for c in scores.columns if c not in key]]
    return lookup(readings, known.table, key, "left", facts_bytes=known.bytes).select(*columns)


def attach_by_time(
    readings: DataFrame, scores: DataFrame, signals: list[str], ts: str = "dt"
) -> DataFrame:
    """A row per reading with what the scores of its time say: ``n_scores``, and the
    smallest and largest of each signal (``<signal>_min``, ``<signal>_max``).

    Readings at one time share all their scores. Pairing each with each would grow with
    the square of the readings at one time, so the scores of a time are summed up first.
    A reading without a time, or with a time that has no scores, has none.
    """
    ends = [
        f(signal).alias(f"{signal}_{name}") for signal in signals for f, name in ((F.min, "min"), (F.max, "max"))
    ]
    facts = scores.where(F.col(ts).isNotNull()).groupBy(ts).agg(F.count("*").alias("n_scores"), *ends)
    added = [c for c in facts.columns if c != ts and c != "n_scores"]
    return lookup(readings, facts, [ts], "left").select(
        *readings.columns, F.coalesce("n_scores", F.lit(0)).alias("n_scores"), *added
    )


class Factored(NamedTuple):
    """What readings and scores at equal times pair up to, as one table for each side:
    the time, ``piece``, and ``entries``, a list of ``value, n``."""

    readings: DataFrame
    scores: DataFrame
    ts: str


def _side(table: DataFrame, ts: str, value: str, piece_values: int) -> DataFrame:
    counted = table.where(F.col(ts).isNotNull()).groupBy(ts, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    staged = stage(counted, "side")
    large = staged.groupBy(ts).agg(F.count("*").alias("_values")).where(F.col("_values") > piece_values)
    pieces = F.coalesce(F.ceil(F.col("_values") / piece_values), F.lit(1))
    cut = lookup(staged, large, [ts]).withColumn("piece", F.pmod(F.xxhash64("value"), pieces).cast("int"))
    return cut.groupBy(ts, "piece").agg(F.collect_list(F.struct("value", "n")).alias("entries"))


def factor_by_time(
    readings: DataFrame, scores: DataFrame, value: str, signal: str, ts: str = "dt", piece_values: int = 1024
) -> Factored:
    """The pairs of all readings with all scores of their time, as far as ``value`` of the
    one and ``signal`` of the other tell them apart, without making them: both sides as
    lists, of about ``piece_values`` different values at most. As long as the input."""
    sides = _side(readings, ts, value, piece_values), _side(scores, ts, signal, piece_values)
    return Factored(stage(sides[0], "readings_by_time"), stage(sides[1], "scores_by_time"), ts)


def _kept(table: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    entries = F.filter("entries", lambda e: F.coalesce(keep(e["value"]), F.lit(False)))
    return table.withColumn("entries", entries).where(F.size("entries") > 0)


def count_pairs(
    factored: Factored, keep_reading: Callable[[Column], Column], keep_score: Callable[[Column], Column]
) -> DataFrame:
    """``<ts>, n_pairs``: for each time, the pairs of which both sides pass; times without
    any are left out. A condition that is null does not pass."""
    ts = factored.ts

    def totals(table: DataFrame, keep: Callable[[Column], Column], name: str) -> DataFrame:
        n = F.aggregate("entries", F.lit(0).cast("bigint"), lambda total, e: total + e["n"])
        return _kept(table, keep).groupBy(ts).agg(F.sum(n).alias(name))

    both = totals(factored.readings, keep_reading, "_r").join(totals(factored.scores, keep_score, "_s"), ts)
    return both.select(ts, (F.col("_r") * F.col("_s")).alias("n_pairs"))


def expand_pairs(
    factored: Factored, keep_reading: Callable[[Column], Column], keep_score: Callable[[Column], Column]
) -> DataFrame:
    """``<ts>, value, signal, n_pairs``: the different pairs of which both sides pass. Only
    these are made, a piece of one side with a piece of the other at a time."""
    ts = factored.ts
    scores = _kept(factored.scores, keep_score).select(ts, F.col("entries").alias("_scores"))
    met = lookup(_kept(factored.readings, keep_reading), scores, [ts], "inner")
    one = met.select(ts, F.explode("entries").alias("_r"), "_scores").select(ts, "_r", F.explode("_scores").alias("_s"))
    return one.select(
        ts, F.col("_r.value").alias("value"), F.col("_s.value").alias("signal"), (F.col("_r.n") * F.col("_s.n")).alias("n_pairs")
    )
