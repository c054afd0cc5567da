"""Readings whose signal is below a threshold."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def select_signal(scored: DataFrame, signal: str, *others: str) -> DataFrame:
    """Project ``others`` and a signal chosen by name."""
    if signal not in scored.columns:
        raise ValueError(f"no signal {signal!r} among {scored.columns}")
    return scored.select(*others, signal)


def is_unusual(signal: str, threshold: float):
    """True below the threshold; a null signal is not unusual."""
    return F.coalesce(F.col(signal) < F.lit(float(threshold)), F.lit(False))


def point_anomalies(
    scored: DataFrame,
    signal: str,
    threshold: float,
    ts: str = "dt",
    sensor: str = "sensor",
    place: Sequence[str] = (),
) -> DataFrame:
    """``dt, sensor, signal`` of the readings below the threshold, over all history.

    ``place`` names columns to keep that tell equal rows apart when they are sorted.
    """
    chosen = select_signal(scored, signal, *place, ts, sensor)
    return chosen.where(F.col(signal) < F.lit(float(threshold))).select(ts, sensor, signal, *place)


def in_time_order(anomalies: DataFrame, ts: str = "dt") -> DataFrame:
    """Sort by time, then by every other column."""
    rest = [F.col(c).asc_nulls_last() for c in anomalies.columns if c != ts]
    return anomalies.orderBy(F.col(ts).asc_nulls_last(), *rest)
