"""Connected components of a graph that no task holds whole.

Alternating large and small stars (Kiveris, Lattanzi, Mirrokni, Rastogi and
Vassilvitskii, 2014): every round links neighbours to the smallest node around, until
each component is a star. Rounds are as many as the logarithm of the longest path.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.operators.lookup import lookup
from hearthlog.staging import Staged, stage_measured


def _smallest(pairs: DataFrame) -> Staged:
    least = F.least(F.col("a"), F.min("b"))
    return stage_measured(pairs.groupBy("a").agg(least.alias("least")), "smallest")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _smallest(both)
    larger = lookup(both.where("b > a"), least.table, ["a"], "inner", facts_bytes=least.bytes)
    return larger.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _smallest(down)
    moved = lookup(down, least.table, ["a"], "inner", facts_bytes=least.bytes)
    return (
        moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
        .unionByName(least.table.select("a", F.col("least").alias("b")))
        .where("a != b")
        .distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> Staged:
    """``node, root`` of the nodes in ``edges`` (``a, b``) but the roots themselves;
    a root is the smallest node of its component."""
    current = stage_measured(edges.where("a != b").select("a", "b").distinct(), "edges")
    state = _state(current.table)
    while state[0]:
        wide = stage_measured(_large_star(current.table), "edges")
        current = stage_measured(_small_star(wide.table), "edges")
        before, state = state, _state(current.table)
        if before == state:
            break
    return Staged(current.table.select(F.col("a").alias("node"), F.col("b").alias("root")), current.bytes)
