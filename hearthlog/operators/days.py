"""Day-level views of a signal over the last days that have readings.

A day may be any bin of time: with ``bin_seconds`` of six hours, ``day`` is the start of
a quarter of a day and everything else follows it.

The views take the readings that ``last_days`` kept, so that the days are looked for
once. Day tables have one row per calendar day, and rasters at most one per day and
cell: windows over them and broadcasts of them do not grow with the readings.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.functions.clock import MICROS_PER_SECOND, as_time, bin_of, day_label, micros_of_bin
from hearthlog.operators.lookup import lookup
from hearthlog.operators.reports import is_unusual
from hearthlog.settings import DAY_SECONDS, DAYS_KEPT


def last_days(
    log: DataFrame, days: int = DAYS_KEPT, ts: str = "dt", bin_seconds: float = DAY_SECONDS
) -> DataFrame:
    """Readings of the last ``days`` calendar days that have any.

    Every non-empty day from the oldest kept one on is kept, so a plain filter on
    the time does it, and reaches the scan.
    """
    kept = (
        log.where(F.col(ts).isNotNull())
        .select(bin_of(F.col(ts), bin_seconds).alias("day"))
        .distinct()
        .orderBy(F.desc("day"))
        .limit(days)
    )
    oldest = kept.agg(as_time(F.min("day")).cast("string")).first()[0]
    if oldest is None:
        return log.where(F.lit(False))
    return log.where(F.col(ts) >= as_time(F.lit(oldest)))


def day_bounds(log: DataFrame, ts: str = "dt", bin_seconds: float = DAY_SECONDS) -> DataFrame:
    """``day, day_start, day_end, title, n_points``: one row per non-empty day."""
    return (
        log.where(F.col(ts).isNotNull())
        .groupBy(bin_of(F.col(ts), bin_seconds).alias("day"))
        .agg(
            F.min(ts).alias("day_start"),
            F.max(ts).alias("day_end"),
            F.count("*").alias("n_points"),
        )
        .withColumn("title", day_label(F.col("day_start")))
    )


def numbered_days(bounds: DataFrame) -> DataFrame:
    """Add ``tile_no``: 0 for the oldest of the kept days."""
    position = F.row_number().over(Window.orderBy("day")) - 1
    return bounds.withColumn("tile_no", position.cast("bigint"))


def overlay(
    anomalies: DataFrame, bounds: DataFrame, ts: str = "dt", bin_seconds: float = DAY_SECONDS
) -> DataFrame:
    """Anomalies that lie between the first and the last reading of their day.

    A day's bounds lie within the day, so the day is an equi-join key.
    """
    facts = bounds.select("day", "day_start", "day_end")
    dated = anomalies.withColumn("day", bin_of(F.col(ts), bin_seconds))
    return lookup(dated, facts, ["day"], "inner").where(
        F.col(ts).between(F.col("day_start"), F.col("day_end"))
    )


def overlay_counts(
    bounds: DataFrame, anomalies: DataFrame, ts: str = "dt", bin_seconds: float = DAY_SECONDS
) -> DataFrame:
    """Add ``n_overlaid`` and ``has_anomalies`` to every day, including days without any."""
    counts = overlay(anomalies, bounds, ts, bin_seconds).groupBy("day").agg(F.count("*").alias("_n"))
    count = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    return (
        bounds.join(counts, "day", "left")
        .withColumns({"n_overlaid": count, "has_anomalies": count > 0})
        .drop("_n")
    )


def daily_tiles(
    kept: DataFrame, signal: str, threshold: float, ts: str = "dt", bin_seconds: float = DAY_SECONDS
) -> DataFrame:
    """One row per reading of the kept days, with its day's tile. Null signals stay."""
    facts = numbered_days(day_bounds(kept, ts, bin_seconds)).select("day", "tile_no", "day_start", "day_end")
    return (
        kept.withColumn("day", bin_of(F.col(ts), bin_seconds))
        .join(F.broadcast(facts), "day")  # one row per day
        .select(
            "day",
            "tile_no",
            F.col(ts).alias("dt"),
            F.col(signal).cast("double").alias("value"),
            is_unusual(signal, threshold).alias("is_anomaly"),
            F.lit(float(threshold)).alias("threshold"),
            "day_start",
            "day_end",
        )
    )


def daily_signals(
    kept: DataFrame, thresholds: dict[str, float], ts: str = "dt", bin_seconds: float = DAY_SECONDS
) -> DataFrame:
    """``day, n_points`` and for each signal ``<signal>_n, <signal>_low, <signal>_high``:
    its anomalies and its range, of all kept days in one pass."""
    added = []
    for signal, threshold in thresholds.items():
        added.append(F.count_if(is_unusual(signal, threshold)).alias(f"{signal}_n"))
        added += [F.min(signal).alias(f"{signal}_low"), F.max(signal).alias(f"{signal}_high")]
    dated = kept.where(F.col(ts).isNotNull())
    return dated.groupBy(bin_of(F.col(ts), bin_seconds).alias("day")).agg(F.count("*").alias("n_points"), *added)


def anomaly_counts(signals: DataFrame, signal: str) -> DataFrame:
    """``day, n_points, n_anomalies, rate`` of one signal of ``daily_signals``."""
    n = F.col(f"{signal}_n")
    return signals.select("day", "n_points", n.alias("n_anomalies"), (n / F.col("n_points")).alias("rate"))


def daily_anomaly_counts(
    kept: DataFrame, signal: str, threshold: float, ts: str = "dt", bin_seconds: float = DAY_SECONDS
) -> DataFrame:
    """``day, n_points, n_anomalies, rate`` over the kept days."""
    return anomaly_counts(daily_signals(kept, {signal: threshold}, ts, bin_seconds), signal)


def ranges(signals: DataFrame, names: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """The range of each signal over all days of ``daily_signals``."""
    ends = [f(f"{name}_{end}") for name in names for f, end in ((F.min, "low"), (F.max, "high"))]
    found = signals.agg(*ends).first()
    return {name: (found[2 * i], found[2 * i + 1]) for i, name in enumerate(names)}


def tile_rasters(
    kept: DataFrame,
    thresholds: dict[str, float],
    limits: dict[str, tuple[float | None, float | None]],
    columns: int = 24,
    rows: int = 20,
    ts: str = "dt",
    bin_seconds: float = DAY_SECONDS,
) -> DataFrame:
    """``signal, day, xb, yb, n_points, n_anomalies``: the rasters of several signals in
    one pass. ``limits`` has the range that all days of a signal share."""
    per_column = F.lit(bin_seconds * MICROS_PER_SECOND / columns)
    drawn = [
        F.when(
            F.col(signal).isNotNull(),
            F.struct(
                F.lit(signal).alias("signal"),
                _grid_row(F.col(signal), *limits[signal], rows).alias("yb"),
                is_unusual(signal, threshold).alias("unusual"),
            ),
        )
        for signal, threshold in thresholds.items()
    ]
    points = kept.where(F.col(ts).isNotNull()).select(
        bin_of(F.col(ts), bin_seconds).alias("day"),
        F.floor(micros_of_bin(F.col(ts), bin_seconds) / per_column).cast("int").alias("xb"),
        F.explode(F.array_compact(F.array(*drawn))).alias("point"),
    )
    return (
        points.groupBy("point.signal", "day", "xb", "point.yb")
        .agg(F.count("*").alias("n_points"), F.count_if("point.unusual").alias("n_anomalies"))
    )


def tile_raster(
    kept: DataFrame,
    signal: str,
    threshold: float,
    columns: int = 24,
    rows: int = 20,
    ts: str = "dt",
    bin_seconds: float = DAY_SECONDS,
) -> DataFrame:
    """``day, xb, yb, n_points, n_anomalies`` on a grid of time of day by signal.

    All days share the range of the signal over the kept days. Only cells with
    points are listed; null signals have no place in the grid.
    """
    limits = ranges(daily_signals(kept, {signal: threshold}, ts, bin_seconds), [signal])
    found = tile_rasters(kept, {signal: threshold}, limits, columns, rows, ts, bin_seconds)
    return found.drop("signal")


def _grid_row(value: Column, low: float | None, high: float | None, rows: int) -> Column:
    if low is None or low == high:
        return F.lit(0)
    share = (value - F.lit(low)) / (F.lit(high) - F.lit(low))
    return F.least(F.floor(share * rows), F.lit(rows - 1)).cast("int")


def number_deviation(daily_counts: DataFrame) -> DataFrame:
    """Add ``number_z``: the robust z of a day's anomaly count among the kept days.

    The median absolute deviation is scaled to a standard deviation of a normal
    distribution. Null where the deviation is zero.
    """
    every_day = Window.partitionBy()
    spread = 1.4826 * F.median(F.abs(F.col("n_anomalies") - F.col("_median"))).over(every_day)
    return (
        daily_counts.withColumn("_median", F.median("n_anomalies").over(every_day))
        .withColumn("_spread", spread)
        .withColumn(
            "number_z",
            F.when(F.col("_spread") > 0, (F.col("n_anomalies") - F.col("_median")) / F.col("_spread")),
        )
        .drop("_median", "_spread")
    )


def shape_deviation(raster: DataFrame) -> DataFrame:
    """``day, shape_tv, shape_rank``: total-variation distance between a day's
    normalised raster and the mean of the other days' rasters, largest first.

    Null when there is one day only. With p the day's share of a cell and m the
    others' mean share, sum |p - m| over all cells is 1 + sum(|p - m| - m) over the
    day's own cells, because the m of a day add up to 1 and p is 0 elsewhere.
    """
    points = F.sum("n_points").over(Window.partitionBy("day"))
    shares = raster.withColumn("_p", F.col("n_points") / points)
    days = raster.groupBy("day").agg(F.lit(1).alias("_one"))
    days = days.select("day", F.count("*").over(Window.partitionBy()).alias("_days"))
    in_cell = F.sum("_p").over(Window.partitionBy("xb", "yb"))
    mean = F.when(F.col("_days") > 1, (in_cell - F.col("_p")) / (F.col("_days") - 1))
    distance = (F.lit(1.0) + F.sum(F.abs(F.col("_p") - F.col("_m")) - F.col("_m"))) / 2
    return (
        shares.join(F.broadcast(days), "day")  # one row per day
        .withColumn("_m", mean)
        .groupBy("day")
        .agg(distance.alias("shape_tv"))
        .withColumn(
            "shape_rank",
            F.rank().over(Window.orderBy(F.round("shape_tv", 12).desc_nulls_last())).cast("bigint"),
        )
    )
