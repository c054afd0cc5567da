"""Readings within intervals of any length.

Time is cut into cells of several widths, each twice the one before. An interval stands
in the cells of the width that its own length comes to, one to three of them, and a
reading in one cell of each width that is in use: so each of them meets at most once,
and neither long intervals nor short ones make many rows.

Where only totals are asked, no pair is made: those of the readings up to an interval's
end less those before its start are what it holds.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.functions.clock import MICROS_PER_SECOND, micros
from hearthlog.operators.lookup import lookup
from hearthlog.operators.ordering import with_running_totals

BASE_SECONDS = 60.0
WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


def _cell(at: Column, width: Column) -> Column:
    return F.call_function("div", at - F.pmod(at, width), width)


def _width(base: int, level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(base).cast("long"), level)


def readings_in_intervals(
    readings: DataFrame,
    intervals: DataFrame,
    ts: str = "dt",
    start: str = "start",
    end: str = "end",
    base_seconds: float = BASE_SECONDS,
    per: Sequence[str] = (),
    count: str = "n",
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """A row per reading and interval with ``start <= ts <= end``: the columns of both,
    whose names must differ. A null time or bound meets nothing, nor does an interval
    that ends before it starts. ``base_seconds`` is the smallest width.

    With ``per``, columns of the intervals, these rows are grouped by them: ``count`` is
    their number and ``sums`` names sums of the readings' whole numbers, null where all
    are. The work then grows with readings and intervals, not with their pairs."""
    shared = {c.lower() for c in readings.columns} & {c.lower() for c in intervals.columns}
    if shared:
        raise ValueError(f"both have {sorted(shared)}")
    if per:
        return _totals(readings, intervals, ts, start, end, list(per), count, dict(sums or {}))
    base = int(round(base_seconds * MICROS_PER_SECOND))
    first, last = micros(F.col(start)), micros(F.col(end))
    level = F.greatest(F.lit(0), F.ceil(F.log2((last - first) / F.lit(base)))).cast("int")
    placed = intervals.where(F.col(start) <= F.col(end)).withColumn("_level", F.when(first == last, 0).otherwise(level))
    width = _width(base, F.col("_level"))
    spread = placed.withColumn("_cell", F.explode(F.sequence(_cell(first, width), _cell(last, width))))
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # a few dozen at most
    each = F.explode(F.array(*[F.lit(v) for v in levels])) if levels else F.explode(F.array().cast("array<int>"))
    dated = readings.where(F.col(ts).isNotNull()).withColumn("_level", each)
    dated = dated.withColumn("_cell", _cell(micros(F.col(ts)), _width(base, F.col("_level"))))
    met = lookup(dated, spread, ["_level", "_cell"], "inner").where(F.col(ts).between(F.col(start), F.col(end)))
    return met.select(*readings.columns, *intervals.columns)


def _totals(
    readings: DataFrame, intervals: DataFrame, ts: str, start: str, end: str, per: list[str], count: str, sums: dict[str, str]
) -> DataFrame:
    """Instants, of readings and of bounds, stand once each in the order that the totals
    run in, so one that very many share is no heavier than others. The sums run as
    decimals: those of all readings may pass what an interval's own do not."""
    for column in sums.values():
        if readings.schema[column].dataType.simpleString() not in WHOLE_NUMBERS:
            raise ValueError(f"{column!r} has no whole numbers")
    bounds = intervals.where(F.col(start) <= F.col(end)).select(
        *[F.col(c).alias(f"_per{i}") for i, c in enumerate(per)],
        F.explode(F.array(F.struct(F.col(start).alias("_at"), F.lit(-1).alias("_sign")), F.struct(F.col(end).alias("_at"), F.lit(1).alias("_sign")))).alias("_b"),
    ).select("*", "_b.*").drop("_b")
    # ``_v0`` counts the readings; of each sum, one is the sum and one counts what it adds.
    own = [F.lit(1).cast("bigint")]
    for column in sums.values():
        own += [F.coalesce(F.col(column), F.lit(0)).cast("decimal(20,0)"), F.col(column).isNotNull().cast("bigint")]
    values = [f"_v{i}" for i in range(len(own))]
    dated = readings.where(F.col(ts).isNotNull()).select(F.col(ts).alias("_at"), *[v.alias(n) for v, n in zip(own, values)])
    empty = bounds.select("_at", *[F.lit(0).cast(dated.schema[v].dataType).alias(v) for v in values])
    wide = ["decimal(38,0)" if dated.schema[v].dataType.simpleString().startswith("decimal") else "bigint" for v in values]
    instants = dated.unionByName(empty).groupBy("_at").agg(*[F.sum(v).cast(w).alias(v) for v, w in zip(values, wide)])
    running = with_running_totals(instants, "_at", {v: f"_to{i}" for i, v in enumerate(values)})
    # What a bound adds: all up to an end, less all before a start.
    sides = running.select("_at", *[F.array(-(F.col(f"_to{i}") - F.col(v)), F.col(f"_to{i}")).alias(v) for i, v in enumerate(values)])
    met = lookup(bounds, sides, ["_at"], "inner")
    of_side = {v: F.element_at(v, F.when(F.col("_sign") < 0, 1).otherwise(2)) for v in values}
    found = met.groupBy(*[f"_per{i}" for i in range(len(per))]).agg(*[F.sum(of_side[v]).alias(v) for v in values])
    named = [F.when(F.col(f"_v{2 * i + 2}") > 0, F.col(f"_v{2 * i + 1}")).cast("bigint").alias(name) for i, name in enumerate(sums)]
    return found.where("_v0 > 0").select(*[F.col(f"_per{i}").alias(c) for i, c in enumerate(per)], F.col("_v0").alias(count), *named)
