"""Joins of a log with a table of per-key facts.

The log may have a key that holds a third of its rows, and the fact table grows
with the number of sensors or transitions, so neither a blind broadcast nor a
plain shuffle is safe.
"""

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.staging import stage, stage_measured

BROADCAST_LIMIT_BYTES = 128 * 1024 * 1024


def lookup(
    log: DataFrame,
    facts: DataFrame,
    on: list[str],
    how: str = "left",
    facts_bytes: int | None = None,
    limit_bytes: int | None = None,
    key_rows: DataFrame | None = None,
) -> DataFrame:
    """Join ``log`` with ``facts`` on equal keys.

    Facts of no more than ``limit_bytes``, by default ``BROADCAST_LIMIT_BYTES``, are
    broadcast and the log is not shuffled.
    Larger ones meet the log in a shuffle with salted hot keys. Facts whose size is not
    given are staged, so that measuring them does not compute them twice. ``key_rows``
    has the key and ``_rows``, how many rows of the log have it, if that is known.
    """
    if facts_bytes is None:
        facts, facts_bytes = stage_measured(facts, "facts")
    if facts_bytes <= (BROADCAST_LIMIT_BYTES if limit_bytes is None else limit_bytes):
        return log.join(F.broadcast(facts), on, how)
    return _salted_join(log, facts, on, how, key_rows)


def _salted_join(
    log: DataFrame, facts: DataFrame, on: list[str], how: str, key_rows: DataFrame | None
) -> DataFrame:
    """Spread each key with more rows than an average partition over several.

    There are fewer such keys than partitions, so their table is broadcast, and
    only their facts are repeated. The salt is a hash of the whole row and stays
    the same when a task is run again. Rows with a null key match nothing and are
    spread over all partitions.
    """
    partitions = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = key_rows
    if counts is None:
        counts = stage(log.dropna(subset=on).groupBy(*on).agg(F.count("*").alias("_rows")), "key_counts")
    fair_share = (counts.agg(F.sum("_rows")).first()[0] or 0) / partitions
    hot = counts.where(F.col("_rows") > fair_share).select(
        *on, F.ceil(F.col("_rows") / F.lit(max(fair_share, 1.0))).cast("int").alias("_salts")
    )
    spread = F.pmod(
        F.xxhash64(*[F.col(c) for c in log.columns]),
        F.when(reduce(or_, [F.col(c).isNull() for c in on]), F.lit(partitions)).otherwise(
            F.coalesce("_salts", F.lit(1))
        ),
    )
    last_salt = F.coalesce("_salts", F.lit(1)) - 1
    salted_log = log.join(F.broadcast(hot), on, "left").withColumn("_salt", spread.cast("int"))
    salted_facts = facts.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), last_salt))
    )
    joined = salted_log.drop("_salts").join(
        salted_facts.drop("_salts").hint("merge"), [*on, "_salt"], how
    )
    return joined.drop("_salt")
