import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # a zone with summer time: nothing may depend on it
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("stages")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(seconds):
    """The time ``seconds`` after the start of 2024."""
    return None if seconds is None else START + dt.timedelta(seconds=seconds)


def seconds_of(time):
    return None if time is None else (time - START).total_seconds()


def make_log(spark, rows, events=False):
    """``rows`` of (seconds, sensor[, event]); ``id`` is the input order."""
    schema = "id long, dt timestamp_ntz, sensor string, event string"
    data = [(i, at(r[0]), r[1], r[2] if len(r) > 2 else "ON") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, schema)
