"""Neighbours and positions in one total order, without a single-task window.

Rows are range-partitioned on the order columns and sorted, which splits hot instants
and hot sensors as long as the order columns tell rows apart. Each range is a chunk. A
task passes over its chunk in Arrow batches and hands each row its neighbour; what lies
beyond the chunk comes from a table with one row per chunk. The log is exchanged once:
a window would ask for a second exchange, as the planner cannot see that a range is one
partition.
"""

import sys
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog.staging import stage

# Workers need not have this package: what they run travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _chunked(log: DataFrame, order: list[str]) -> DataFrame:
    """``log`` in chunks, each in order; nulls last."""
    chunks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in order]
    return log.repartitionByRange(chunks, *keys).sortWithinPartitions(*keys)


def _ends(batch: pa.RecordBatch, places: list[int], at: int) -> list[pa.Array]:
    return [batch.column(p).slice(at, 1) for p in places]


def _neighbours(columns: list[pa.Array], beyond: list[pa.Array] | None, step: int) -> pa.StructArray:
    """Each row's neighbour. ``beyond`` is that of the last row, or of the first one for
    ``step=-1``; without it that row has none."""
    n, moved = len(columns[0]), []
    for at, column in enumerate(columns):
        end = pa.nulls(1, column.type) if beyond is None else beyond[at]
        moved.append(pa.concat_arrays([column.slice(1), end] if step > 0 else [end, column.slice(0, n - 1)]))
    missing = [False] * n
    missing[-1 if step > 0 else 0] = beyond is None
    names = [f"f{i}" for i in range(len(columns))]
    return pa.StructArray.from_arrays(moved, names, mask=pa.array(missing))


def _pass(log: DataFrame, order: list[str], pick: list[str], step: int, counts: Column | None) -> DataFrame:
    """Columns of ``log``, then ``_near``: the neighbour within the chunk, ``_edge``: the
    row that the adjoining chunk sees, ``_chunk``, and ``_rank``: the counted rows so far,
    null if not counted."""
    fields = [T.StructField(f"f{i}", log.schema[c].dataType) for i, c in enumerate(pick)]
    laid_out = _chunked(log.withColumn("_counts", F.lit(False) if counts is None else counts), order)
    schema = T.StructType(
        [
            *log.schema.fields,
            T.StructField("_near", T.StructType(fields)),
            T.StructField("_edge", T.BooleanType()),
            T.StructField("_chunk", T.IntegerType()),
            T.StructField("_rank", T.LongType()),
        ]
    )
    places = [log.columns.index(c) for c in pick]
    width = len(log.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, seen = TaskContext.get().partitionId(), 0
        before, held = None, None

        def finish(after: list[pa.Array] | None) -> pa.RecordBatch:
            nonlocal seen
            n, counted = held.num_rows, held.column(width)
            near = _neighbours([held.column(p) for p in places], after if step > 0 else before, step)
            edge = [False] * n
            edge[0 if step > 0 else -1] = (before if step > 0 else after) is None
            rank = pc.add(pc.cumulative_sum(pc.cast(counted, pa.int64())), seen)
            seen += pc.sum(counted).as_py()
            columns = [
                *held.columns[:width], near, pa.array(edge), pa.array([chunk] * n, pa.int32()),
                pc.if_else(counted, rank, pa.scalar(None, pa.int64())),
            ]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    yield finish(_ends(batch, places, 0))
                    before = _ends(held, places, held.num_rows - 1)
                held = batch
        if held is not None:
            yield finish(None)

    return laid_out.mapInArrow(run, schema)


def _before(counts: DataFrame) -> DataFrame:
    """``_chunk, _before``: rows counted in all earlier chunks."""
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_chunk", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))


class Numbered(NamedTuple):
    """Rows, and how many of them have a number."""

    table: DataFrame
    total: int


def with_neighbour(
    log: DataFrame,
    order: list[str],
    pick: list[str],
    name: str,
    step: int = 1,
    number: tuple[str, Column] | None = None,
) -> DataFrame | Numbered:
    """Add ``name``: a struct of the ``pick`` columns of the next row in ``order``
    (``step=1``) or the previous one (``step=-1``).

    The struct is null only where there is no such row; its fields may be null.
    Nulls order last. With ``number``, a name and a condition, the rows for which the
    condition holds are also numbered from 0 in this order, and their count is returned.
    """
    counts = F.coalesce(number[1], F.lit(False)) if number else None
    staged = stage(_pass(log, order, pick, step, counts), "neighbour")
    own = F.struct(*[F.col(c).alias(f"f{i}") for i, c in enumerate(pick)])
    toward = F.lead if step > 0 else F.lag
    # One row per non-empty chunk, so never more than spark.sql.shuffle.partitions.
    beyond = staged.where("_edge").select("_chunk", toward(own).over(Window.orderBy("_chunk")).alias("_beyond"))
    kind = T.StructType([T.StructField(c, log.schema[c].dataType) for c in pick])
    found = staged.join(F.broadcast(beyond), "_chunk", "left").withColumn(
        name, F.coalesce("_near", "_beyond").cast(kind)
    )
    if not number:
        return found.select(*log.columns, name)
    per_chunk = stage(staged.groupBy("_chunk").agg(F.count("_rank").alias("_rows")), "chunks")
    numbered = found.join(F.broadcast(_before(per_chunk)), "_chunk").withColumn(
        number[0], F.col("_before") + F.col("_rank") - 1
    )
    total = per_chunk.agg(F.sum("_rows")).first()[0] or 0
    return Numbered(numbered.select(*log.columns, name, number[0]), total)


def with_position(table: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``: the number of rows before this one in ``order``."""
    staged = stage(_pass(table, order, order[:1], 1, F.lit(True)), "position")
    before = _before(staged.groupBy("_chunk").agg(F.count("*").alias("_rows")))
    return staged.join(F.broadcast(before), "_chunk").select(
        *table.columns, (F.col("_before") + F.col("_rank") - 1).cast("bigint").alias(name)
    )


def with_running_totals(table: DataFrame, by: str, totals: dict[str, str]) -> DataFrame:
    """Add, for each column named in ``totals``, its sum up to this row in the order of
    ``by``, whose values must differ. The columns may not be null."""
    staged = stage(_chunked(table, [by]).withColumn("_chunk", F.spark_partition_id()), "running")
    # One row per non-empty chunk, so never more than spark.sql.shuffle.partitions.
    per_chunk = staged.groupBy("_chunk").agg(*[F.sum(c).cast(table.schema[c].dataType).alias(c) for c in totals])
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = per_chunk.select("_chunk", *[F.sum(c).over(earlier).alias(f"_before_{n}") for c, n in totals.items()])
    so_far = Window.partitionBy("_chunk").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def total(column: str, name: str) -> Column:
        kind = table.schema[column].dataType
        return (F.sum(column).over(so_far).cast(kind) + F.coalesce(F.col(f"_before_{name}"), F.lit(0)).cast(kind)).cast(kind)

    return staged.join(F.broadcast(before), "_chunk").select(*table.columns, *[total(c, n).alias(n) for c, n in totals.items()])
