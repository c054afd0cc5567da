"""Sensor metadata: one nested JSON document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA_SCHEMA = "vibration map<string, struct<Delay: double>>, appliances string"


def _required(name: str, value, type_name: str):
    return F.coalesce(value, F.raise_error(F.lit(f"metadata lacks {name}")).cast(type_name))


def read_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(sensor, delay)`` of the delayed sensors and ``(sensor)`` of the appliances.

    ``appliances`` may be a list of names or an object whose keys are the names.
    A missing key raises when the tables are read.
    """
    document = (
        spark.read.schema(METADATA_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    )
    vibration = _required("vibration", F.col("vibration"), "map<string, struct<Delay: double>>")
    delays = document.select(F.explode(vibration).alias("sensor", "info")).select(
        "sensor", _required("Delay", F.col("info.Delay"), "double").alias("delay")
    )
    listed = _required("appliances", F.col("appliances"), "string")
    names = F.when(F.ltrim(listed).startswith("{"), F.json_object_keys(listed)).otherwise(
        F.from_json(listed, "array<string>")
    )
    return delays, document.select(F.explode(names).alias("sensor"))
