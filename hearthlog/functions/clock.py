"""Time expressions. Every time is a TIMESTAMP_NTZ, so no session zone matters."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlog.settings import DAY_SECONDS

MICROS_PER_SECOND = 1_000_000


def as_time(col: Column) -> Column:
    return col.cast("timestamp_ntz")


def _epoch() -> Column:
    return as_time(F.lit("1970-01-01 00:00:00"))


def event_time(
    date: Column, time: Column, strict: bool = True, pattern: str | None = None
) -> Column:
    """Parse ``date`` and ``time`` text; null if either is null.

    ``pattern`` is for text that is not in ISO order, such as ``dd/MM/yyyy HH:mm:ss``.
    Text that is no timestamp raises, or becomes null when ``strict`` is off.
    """
    text = F.concat(date, F.lit(" "), time)
    if pattern:
        fits = F.try_to_timestamp(text, F.lit(pattern)).isNotNull()
        parsed = F.when(fits, F.to_timestamp_ntz(text, F.lit(pattern)))
    else:
        parsed = text.try_cast("timestamp_ntz")
    if not strict:
        return parsed
    refuse = F.raise_error(F.concat(F.lit("not a timestamp: "), text)).cast("timestamp_ntz")
    return F.coalesce(parsed, F.when(text.isNotNull(), refuse))


def micros(ts: Column) -> Column:
    """Whole microseconds since 1970.

    By way of an interval: TIMESTAMPDIFF and UNIX_MICROS would read the time in the
    session zone and move hours that a change to summer time skips.
    """
    seconds = (ts - _epoch()).cast("interval second").cast("decimal(18,6)")
    return (seconds * MICROS_PER_SECOND).cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    return micros(ts) / F.lit(float(MICROS_PER_SECOND))


def seconds_to_micros(seconds: Column) -> Column:
    return F.round(seconds * MICROS_PER_SECOND).cast("bigint")


def earlier(ts: Column, by_micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", -by_micros, ts)


def cyclical(ts: Column, period_seconds: float = DAY_SECONDS, exact: bool = False) -> tuple[Column, Column]:
    """Sine and cosine of the position of ``ts`` within a repeating period.

    Seconds since 1970 are so many that the values of equal positions differ by about
    1e-11. With ``exact`` they do not, if the period is of whole microseconds.
    """
    if exact and float(period_seconds * MICROS_PER_SECOND).is_integer():
        turns = micros_of_bin(ts, period_seconds) / F.lit(float(period_seconds * MICROS_PER_SECOND))
    else:
        turns = epoch_seconds(ts) / F.lit(float(period_seconds))
    angle = turns * F.lit(2.0) * F.lit(math.pi)
    return F.sin(angle), F.cos(angle)


def day_of(ts: Column) -> Column:
    return F.to_date(ts)


def bin_of(ts: Column, seconds: float = DAY_SECONDS) -> Column:
    """The bin that a time lies in: its date, or the start of a bin of another width.

    Bins are counted from 1970, so a width that divides the day starts anew at midnight.
    """
    if seconds == DAY_SECONDS:
        return day_of(ts)
    return earlier(ts, micros_of_bin(ts, seconds))


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def micros_of_bin(ts: Column, seconds: float = DAY_SECONDS) -> Column:
    return F.pmod(micros(ts), F.lit(int(round(seconds * MICROS_PER_SECOND))))
