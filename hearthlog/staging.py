"""Intermediate tables in the folder that all executors share.

A staged table cuts the lineage and survives the loss of executors. It is also
what makes a partition number usable as data: once written, it cannot change
when a later step reads it again.
"""

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def stage_root(spark: SparkSession) -> str:
    """The folder that holds staged tables; all executors must reach it.

    ``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``, else one
    under the warehouse, which every session has and a cluster shares. A warehouse on
    the machine's own disk serves a local session only.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    on_disk = re.match(r"(file:)?/(?!/)|file:///", warehouse)
    if on_disk and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return f"{warehouse}/stages"


_scope: ContextVar[str] = ContextVar("hearthlog_stage_scope", default="")


def _folder(spark: SparkSession) -> str:
    return f"{stage_root(spark)}/hearthlog-{spark.sparkContext.applicationId}"


def new_stage_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{_scope.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside on leaving: for jobs whose results are then written.

    Lazy frames made inside must not be read after it.
    """
    inner = f"{_scope.get()}scope-{uuid.uuid4().hex}/"
    token = _scope.set(inner)
    try:
        yield
    finally:
        _scope.reset(token)
        _delete(spark, f"{_folder(spark)}/{inner}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the written table."""
    spark = df.sparkSession
    path = new_stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Staged(NamedTuple):
    """A staged table and the bytes of its rows, as ``row_bytes`` counts them."""

    table: DataFrame
    bytes: int


def row_bytes(columns: list[str]) -> Column:
    """Bytes of the values of a row, plus a fixed overhead per value."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in columns]
    return sum(sizes, start=F.lit(32)).cast("bigint")


class Size(NamedTuple):
    rows: int
    bytes: int


def measure(facts: DataFrame) -> Size:
    """Rows, and the bytes of their values plus a fixed overhead per value."""
    found = facts.agg(F.count(F.lit(1)), F.sum(row_bytes(facts.columns))).first()
    return Size(found[0], found[1] or 0)


def stage_measured(df: DataFrame, name: str) -> Staged:
    """Stage ``df`` and take its size while it is written.

    Tasks that run again may be counted again, so the size can only be too large.
    """
    seen = Observation()
    table = stage(df.observe(seen, F.sum(row_bytes(df.columns)).alias("bytes")), name)
    found = seen.get
    return Staged(table, (found["bytes"] or 0) if "bytes" in found else measure(table).bytes)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stages(spark: SparkSession) -> None:
    """Delete every table this application has staged."""
    _delete(spark, _folder(spark))
