"""First-order Markov transition probabilities."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.operators.lookup import lookup
from hearthlog.operators.ordering import with_neighbour
from hearthlog.staging import Staged, stage_measured


def with_next_sensor(log: DataFrame, order: list[str], sensor: str = "sensor") -> DataFrame:
    """Add ``next_sensor``: the sensor of the next reading of the whole log."""
    return (
        with_neighbour(log, order, [sensor], "_next")
        .withColumn("next_sensor", F.col(f"_next.{sensor}"))
        .drop("_next")
    )


def pair_counts(log_with_next: DataFrame, sensor: str = "sensor") -> DataFrame:
    """``sensor, next_sensor, n`` of all readings, nulls included."""
    return log_with_next.groupBy(sensor, "next_sensor").agg(F.count("*").alias("n"))


def shares(pairs: Staged, sensor: str = "sensor") -> DataFrame:
    """``sensor, next_sensor, n, p`` where p is the share among what follows ``sensor``.

    A sensor that very many others follow is one row of totals, and there are no more
    bytes of totals than of pairs.
    """
    known = pairs.table.dropna(subset=[sensor, "next_sensor"])
    totals = known.groupBy(sensor).agg(F.sum("n").alias("_total"))
    joined = lookup(known, totals, [sensor], "inner", facts_bytes=pairs.bytes)
    return joined.select(sensor, "next_sensor", "n", (F.col("n") / F.col("_total")).alias("p"))


def transition_table(log_with_next: DataFrame, sensor: str = "sensor") -> DataFrame:
    return shares(stage_measured(pair_counts(log_with_next, sensor), "pairs"), sensor)


def fit_transitions(pairs: Staged, sensor: str = "sensor") -> Staged:
    """The transition table of counted pairs, computed once and kept."""
    return stage_measured(shares(pairs, sensor), "transitions")


def with_transition_prob(
    log_with_next: DataFrame,
    transitions: Staged,
    sensor: str = "sensor",
    limit_bytes: int | None = None,
) -> DataFrame:
    """Add ``markov_prob``: the probability of the transition out of each reading."""
    facts = transitions.table.select(sensor, "next_sensor", F.col("p").alias("markov_prob"))
    known = transitions.table.select(sensor, "next_sensor", F.col("n").alias("_rows"))
    return lookup(
        log_with_next,
        facts,
        [sensor, "next_sensor"],
        facts_bytes=transitions.bytes,
        limit_bytes=limit_bytes,
        key_rows=known,
    ).select(*log_with_next.columns, "markov_prob")


def with_markov_prob(
    log: DataFrame, order: list[str], sensor: str = "sensor", limit_bytes: int | None = None
) -> DataFrame:
    """Add ``next_sensor`` and ``markov_prob``.

    The probability is null for the last reading and wherever this sensor or the
    next one is null. ``order`` should tell any two readings apart.
    """
    ordered = with_next_sensor(log, order, sensor)
    pairs = stage_measured(pair_counts(ordered, sensor), "pairs")
    return with_transition_prob(ordered, fit_transitions(pairs, sensor), sensor, limit_bytes)
