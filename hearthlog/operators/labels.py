"""Integer codes for sensor labels, and the features of the forest."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.functions.clock import cyclical
from hearthlog.operators.lookup import lookup
from hearthlog.operators.ordering import with_position
from hearthlog.settings import DAY_SECONDS
from hearthlog.staging import measure

FEATURES = ("sensorEnc", "sinTransform", "cosTransform")


def label_codes(log: DataFrame, sensor: str = "sensor") -> DataFrame:
    """``sensor, code``: distinct labels in alphabetical order, from 0."""
    labels = log.select(sensor).dropna().distinct()
    return with_position(labels, [sensor], "code")


def with_label_code(
    log: DataFrame, sensor: str = "sensor", name: str = "sensorEnc", labels: DataFrame | None = None
) -> DataFrame:
    """Add the code of the label; readings without a sensor get the code after the last.

    ``labels`` is a smaller table with all labels, if there is one.
    """
    codes = label_codes(log if labels is None else labels, sensor)
    size = measure(codes)
    return (
        lookup(log, codes, [sensor], facts_bytes=size.bytes)
        .withColumn(name, F.coalesce(F.col("code"), F.lit(size.rows)).cast("bigint"))
        .select(*log.columns, name)
    )


def with_cyclical(
    log: DataFrame, ts: str = "dt", period_seconds: float = DAY_SECONDS, exact: bool = False
) -> DataFrame:
    sine, cosine = cyclical(F.col(ts), period_seconds, exact)
    return log.withColumns({"sinTransform": sine, "cosTransform": cosine})


def with_features(
    log: DataFrame,
    ts: str = "dt",
    sensor: str = "sensor",
    period_seconds: float = DAY_SECONDS,
    labels: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """Add ``sensorEnc, sinTransform, cosTransform``; ``exact`` as in ``cyclical``."""
    return with_label_code(with_cyclical(log, ts, period_seconds, exact), sensor, labels=labels)
