"""Transition counts from summaries of runs, so that new readings do not sort the log again.

A run is what a batch has of one day: its first and last reading and the counts of its
transitions. Batches that follow each other in time can be summarised one by one, cut
anywhere: the counts of all runs add up, and what leads from one run to the next is one
more transition.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearthlog.functions.clock import bin_of
from hearthlog.operators.markov import shares
from hearthlog.operators.ordering import with_neighbour
from hearthlog.settings import DAY_SECONDS
from hearthlog.staging import stage, stage_measured


class Summary(NamedTuple):
    """``runs``: ``day, first_key, first_sensor, last_key, last_sensor, n``, a row per run.
    ``pairs``: ``day, sensor, next_sensor, n``, the transitions within runs."""

    runs: DataFrame
    pairs: DataFrame


def _key(order: list[str]) -> Column:
    """What sorts as the columns do with nulls last."""
    return F.struct(*[part for c in order for part in (F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(c))])


def summarise(log: DataFrame, order: list[str], sensor: str = "sensor", bin_seconds: float = DAY_SECONDS) -> Summary:
    """Summarise a batch: the days of ``order[0]``, readings without a time a run of their
    own that comes last. ``order`` should tell any two readings apart."""
    day = bin_of(F.col(order[0]), bin_seconds)
    named = list(dict.fromkeys([*order, sensor]))
    laid = stage(with_neighbour(log.select(*named), order, [order[0], sensor], "_next"), "runs")
    dated = laid.withColumn("day", day)
    runs = dated.groupBy("day").agg(
        F.min(_key(order)).alias("first_key"),
        F.min_by(F.struct(sensor), _key(order)).alias("_first"),
        F.max(_key(order)).alias("last_key"),
        F.max_by(F.struct(sensor), _key(order)).alias("_last"),
        F.count("*").alias("n"),
    )
    following = bin_of(F.col(f"_next.{order[0]}"), bin_seconds)
    within = dated.where(F.col("_next").isNotNull() & F.col("day").eqNullSafe(following))
    pairs = within.groupBy("day", F.col(sensor).alias("sensor"), F.col(f"_next.{sensor}").alias("next_sensor")).agg(F.count("*").alias("n"))
    ends = [F.col(f"_{end}.{sensor}").alias(f"{end}_sensor") for end in ("first", "last")]
    return Summary(runs.select("day", "first_key", ends[0], "last_key", ends[1], "n"), pairs)


def append_summary(summary: Summary, path: str) -> None:
    """Add the runs of a batch to those below ``path``; earlier ones are not read."""
    summary.pairs.write.mode("append").parquet(f"{path}/pairs")
    summary.runs.write.mode("append").parquet(f"{path}/runs")


def read_summary(spark: SparkSession, path: str) -> Summary:
    return Summary(spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/pairs"))


def merged_pairs(summary: Summary) -> DataFrame:
    """``sensor, next_sensor, n`` over all runs. Runs that overlap in time raise: their
    days have to be summarised in one batch."""
    in_time = Window.orderBy("first_key")  # over a row per run
    met = summary.runs.select(
        "day", "last_key", F.col("last_sensor").alias("sensor"), F.lead(F.struct("first_key", "first_sensor")).over(in_time).alias("_next")
    ).where(F.col("_next").isNotNull())
    refuse = F.raise_error(F.concat(F.lit("runs overlap on "), F.coalesce(F.col("day").cast("string"), F.lit("no day")))).cast("bigint")
    once = F.when(F.col("last_key") < F.col("_next.first_key"), F.lit(1).cast("bigint")).otherwise(refuse)
    between = met.select("sensor", F.col("_next.first_sensor").alias("next_sensor"), once.alias("n"))
    every = summary.pairs.select("sensor", "next_sensor", "n").unionByName(between)
    return every.groupBy("sensor", "next_sensor").agg(F.sum("n").alias("n"))


def transitions_of(summary: Summary) -> DataFrame:
    """The transition table of all readings that were summarised."""
    return shares(stage_measured(merged_pairs(summary), "pairs"))
