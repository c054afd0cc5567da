"""Stage datasets, reports and views.

Datasets of readings are partitioned by day, so that reading some days opens only their
files, and which days there are is known from the names of the folders.
"""

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthlog.functions.clock import day_of
from hearthlog.operators.days import last_days
from hearthlog.operators.reports import in_time_order, is_unusual
from hearthlog.settings import DAY_SECONDS, DAYS_KEPT
from hearthlog.sources import folders
from hearthlog.staging import stage

# Fixed value: how a time is written in a report.
REPORT_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"

DAY = "day"
ROW_GROUP_BYTES = 16 * 1024 * 1024
_HEADER_PART = "part--header.csv"  # by name before all numbered parts


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_by_role(log: DataFrame, path: str, ts: str = "dt") -> None:
    """Write both roles in one pass; each role and day is a partition of the dataset.

    Rows are laid out by role and time first, which splits a day or an instant that has
    very many of them and leaves few files a day.
    """
    dated = log.withColumn(DAY, day_of(F.col(ts)))
    keys = [F.col("role"), F.col(ts), F.xxhash64(*log.columns)]
    laid_out = dated.repartitionByRange(*keys)
    folders.replace(log.sparkSession, path, lambda new: laid_out.write.partitionBy("role", DAY).parquet(new))


def read_role(spark: SparkSession, path: str, role: str) -> DataFrame:
    """One role of a dataset of ``write_by_role``; the other role is not read."""
    return read_table(spark, path).where(F.col("role") == role).drop("role", DAY)


def write_days(
    log: DataFrame,
    path: str,
    ts: str = "dt",
    thresholds: dict[str, float] | None = None,
    row_group_bytes: int = ROW_GROUP_BYTES,
) -> None:
    """Write a dataset partitioned by day, which replaces what is at ``path``. Rows that
    are not roughly in time order should be laid out first: a task writes a file a day.

    With ``thresholds``, rows with a signal below its own come first in each file, and so
    share row groups: a report of a signal skips the groups of which all values are larger.
    """
    dated = log.withColumn(DAY, day_of(F.col(ts)))
    if thresholds:
        unusual = reduce(or_, [is_unusual(signal, threshold) for signal, threshold in thresholds.items()])
        dated = dated.sortWithinPartitions(F.col(DAY), unusual.desc(), F.col(ts))
    writer = dated.write.option("parquet.block.size", row_group_bytes)
    folders.replace(log.sparkSession, path, lambda new: writer.partitionBy(DAY).parquet(new))


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """A dataset of ``write_days`` as it was written."""
    return read_table(spark, path).drop(DAY)


def listed_days(spark: SparkSession, path: str) -> list[str]:
    """The days that a dataset has readings of, oldest first, from its folders alone.
    ``path`` may be a dataset of ``write_days``, or a role's folder of ``write_by_role``."""
    names = folders.listed(spark, f"{path.rstrip('/')}/{DAY}=*")
    days = [name.partition("=")[2] for name in names]
    return [d for d in days if d != "__HIVE_DEFAULT_PARTITION__"]


def read_last_days(
    spark: SparkSession, path: str, days: int = DAYS_KEPT, ts: str = "dt", bin_seconds: float = DAY_SECONDS
) -> DataFrame:
    """As ``last_days`` of a dataset of ``write_days``, without opening older files and
    without looking for the days in them."""
    # The last bins lie in no more than so many of the last days that have readings.
    span = 1 if bin_seconds <= DAY_SECONDS else math.ceil(bin_seconds / DAY_SECONDS) + 1
    near = listed_days(spark, path)[-days * span :] if days > 0 else []
    table = read_table(spark, path)
    if not near:
        return table.where(F.lit(False)).drop(DAY)
    kept = table.where(F.col(DAY) >= F.lit(near[0]).cast("date")).drop(DAY)
    return kept if bin_seconds == DAY_SECONDS else last_days(kept, days, ts, bin_seconds)


def write_table(df: DataFrame, path: str) -> None:
    """Replace the dataset at ``path``, which ``df`` may read: see ``folders.replace``."""
    folders.replace(df.sparkSession, path, df.write.parquet)


def number_text(value: Column) -> Column:
    """A double as reports have it: without an exponent from 0.0001 up to 1e16, and with
    one of two digits or more elsewhere."""
    text, size = value.cast("string"), F.abs(value)
    plain = F.rtrim(text.cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    power = F.split_part(text, F.lit("E"), F.lit(2)).cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    digits = F.greatest(F.lit(2), F.length(F.abs(power).cast("string")))
    short = F.concat(F.regexp_replace(F.split_part(text, F.lit("E"), F.lit(1)), r"\.0$", ""), sign, F.lpad(F.abs(power).cast("string"), digits, F.lit("0")))
    within = (size >= 1e-4) & (size < 1e16)
    return F.when(~text.contains("E"), text).when(within, plain).otherwise(short)


def write_report(anomalies: DataFrame, path: str, place: Sequence[str] = (), single: bool = False) -> None:
    """A folder of CSV parts. One after the other by name they are one CSV in order of
    time: the header is a part of its own, the others have none.

    The columns of ``place`` take part in the sort, so that equal readings can go to
    several parts, and are not written. With ``single`` the parts are also copied into
    the file ``<path>.csv``; they are sorted as before, by many tasks.
    """
    spark = anomalies.sparkSession
    ordered = in_time_order(anomalies).drop(*place)
    doubles = [c for c, kind in ordered.dtypes if kind == "double"]
    ordered = ordered.withColumns({c: F.when(~F.isnan(c), number_text(F.col(c))) for c in doubles})

    def write(new: str) -> None:
        ordered.write.option("timestampNTZFormat", REPORT_TIME).csv(new)
        folders.write_text(spark, f"{new}/{_HEADER_PART}", ",".join(ordered.columns) + "\n")

    folders.replace(spark, path, write)
    if single:
        folders.join_files(spark, path, folders.listed(spark, f"{path}/part-*"), f"{path}.csv")


def read_report(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """A report by its parts, or one that ends in ``.csv`` as a single file."""
    schema = T.StructType.fromDDL("dt timestamp_ntz, sensor string").add(signal, "double")
    reader = spark.read.schema(schema).option("timestampNTZFormat", REPORT_TIME)
    if path.endswith(".csv"):
        return reader.option("header", True).csv(path)
    return reader.option("pathGlobFilter", "part-[0-9]*").csv(path)


def publish(df: DataFrame, name: str, once: bool = False) -> None:
    """Name a view for SQL: lazy, or over a staged copy that is computed once."""
    (stage(df, name) if once else df).createOrReplaceTempView(name)
