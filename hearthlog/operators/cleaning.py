"""Noise removal, debouncing, delay correction and the split by sensor role."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.functions.clock import MICROS_PER_SECOND, earlier, micros, seconds_to_micros
from hearthlog.operators.lookup import lookup
from hearthlog.operators.ordering import with_neighbour
from hearthlog.settings import DEBOUNCE_SECONDS, NOISE_LABEL


def drop_noise(log: DataFrame, sensor: str = "sensor", noise: str = NOISE_LABEL) -> DataFrame:
    """Drop readings of the noise label; readings without a sensor stay."""
    return log.where(~F.col(sensor).eqNullSafe(F.lit(noise)))


def with_gap(log: DataFrame, tie: list[str], ts: str = "dt", sensor: str = "sensor") -> DataFrame:
    """Add ``gap_us``: microseconds since the previous reading of the same sensor."""
    ordered = with_neighbour(log, [sensor, ts, *tie], [sensor, ts], "_previous", step=-1)
    gap = micros(F.col(ts)) - micros(F.col(f"_previous.{ts}"))
    return ordered.withColumn(
        "gap_us", F.when(F.col(sensor) == F.col(f"_previous.{sensor}"), gap)
    ).drop("_previous")


def debounce(
    log: DataFrame,
    tie: list[str],
    seconds: float = DEBOUNCE_SECONDS,
    ts: str = "dt",
    sensor: str = "sensor",
) -> DataFrame:
    """Keep a reading only if the sensor's previous raw reading is ``seconds`` or
    more before it. Of readings at one time the first by ``tie`` counts as first.

    Time is cut into cells as wide as the gap. Only the first reading of a sensor
    in a cell can be kept, and it is kept unless the last reading of the cell
    before is too close. So one aggregation by sensor and cell decides everything:
    bursts and copies collapse before the shuffle, and no group grows with the
    number of readings of a sensor. Readings without a sensor or a time are never
    debounced and pass by.
    """
    width = int(round(seconds * MICROS_PER_SECOND))
    if width <= 0:
        return log
    undated = F.col(ts).isNull() | F.col(sensor).isNull()
    rest = [c for c in log.columns if c not in (ts, sensor, *tie)]
    dated = log.where(~undated).select(
        sensor,
        F.col(ts).alias("_time"),
        F.struct(ts, *tie, *rest).alias("_row"),
        F.window(ts, f"{width} microseconds").alias("_cell"),
    )
    no_row = F.lit(None).cast(dated.schema["_row"].dataType)
    no_time = F.lit(None).cast("timestamp_ntz")
    # Each reading counts in its own cell, and as the predecessor in the next one.
    own = F.struct(
        F.col("_cell.start").alias("cell"), F.col("_row").alias("row"), no_time.alias("earlier")
    )
    later = F.struct(
        F.col("_cell.end").alias("cell"), no_row.alias("row"), F.col("_time").alias("earlier")
    )
    # The cell leads the key: times sort faster than labels that are often equal.
    cells = (
        dated.select(sensor, F.explode(F.array(own, later)).alias("_entry"))
        .groupBy("_entry.cell", sensor)
        .agg(F.min("_entry.row").alias("_row"), F.max("_entry.earlier").alias("_earlier"))
    )
    gap = micros(F.col(f"_row.{ts}")) - micros(F.col("_earlier"))
    kept = cells.where(F.col("_row").isNotNull() & (gap.isNull() | (gap >= width)))
    return kept.select(
        *[F.col(sensor) if c == sensor else F.col(f"_row.{c}").alias(c) for c in log.columns]
    ).unionByName(log.where(undated))


def shift_delays(
    log: DataFrame, delays: DataFrame, ts: str = "dt", sensor: str = "sensor"
) -> DataFrame:
    """Move the readings of delayed sensors back in time.

    ``delays`` has ``sensor`` and ``delay`` in seconds. The time before the shift
    stays in ``dt_raw``: the order of readings is decided by it.
    """
    facts = delays.select(F.col("sensor").alias(sensor), seconds_to_micros(F.col("delay")).alias("_delay"))
    moved = F.when(F.col("_delay").isNull(), F.col(ts)).otherwise(earlier(F.col(ts), F.col("_delay")))
    return (
        lookup(log, facts, [sensor])
        .withColumns({"dt_raw": F.col(ts), ts: moved})
        .select(*log.columns, "dt_raw")
    )


def only_sensors(log: DataFrame, sensors: DataFrame, sensor: str = "sensor") -> DataFrame:
    names = sensors.select(F.col("sensor").alias(sensor)).distinct()
    return lookup(log, names, [sensor], "left_semi").select(*log.columns)


def without_sensors(log: DataFrame, sensors: DataFrame, sensor: str = "sensor") -> DataFrame:
    """The complement of ``only_sensors``; readings without a sensor stay."""
    names = sensors.select(F.col("sensor").alias(sensor)).distinct()
    return lookup(log, names, [sensor], "left_anti").select(*log.columns)


def with_role(log: DataFrame, appliances: DataFrame, sensor: str = "sensor") -> DataFrame:
    """Add ``role``: ``appliance`` or ``activity``, for writing both in one pass."""
    names = appliances.select(F.col("sensor").alias(sensor)).distinct().withColumn("_hit", F.lit(True))
    role = F.when(F.col("_hit"), F.lit("appliance")).otherwise(F.lit("activity"))
    return lookup(log, names, [sensor]).withColumn("role", role).select(*log.columns, "role")
