"""The log of raw readings: CSV without a header."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.functions.clock import event_time
from hearthlog.sources.quoted import quoted_records

RAW_SCHEMA = "event string, date string, time string, sensor string"
RAW_COLUMNS = ("event", "date", "time", "sensor")

# Columns that give the place of a row in its files, in order.
INPUT_ORDER = ["input_file", "input_block", "input_row"]

# Texts that mean "missing" in a CSV field.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def read_raw(
    spark: SparkSession, path: str, multi_line: bool = False, strict: bool = True
) -> DataFrame:
    """``event, date, time, sensor`` as text, with the place of each row in the input.

    Files count in the order of their paths. The row number counts within a scan
    task, so it orders the rows of a block. Missing fields at the end of a line are
    null; a line with a fifth field raises when it is read, unless ``strict`` is off,
    which drops the field. Quoted fields may hold line breaks with ``multi_line`` only,
    which reads the lines once more (see ``quoted``).
    """
    schema = f"{RAW_SCHEMA}, surplus string"
    if multi_line:
        placed = quoted_records(spark, path)
        raw = placed.select(F.from_csv("record", schema, {"escape": '"'}).alias("fields"), *INPUT_ORDER).select("fields.*", *INPUT_ORDER)
    else:
        raw = spark.read.schema(schema).option("escape", '"').csv(path).select(
            "*",
            F.col("_metadata.file_path").alias("input_file"),
            F.col("_metadata.file_block_start").alias("input_block"),
            F.monotonically_increasing_id().alias("input_row"),
        )
    fields = {c: F.when(~F.col(c).isin(MISSING_TEXTS), F.col(c)) for c in RAW_COLUMNS}
    if strict:
        refuse = F.raise_error(F.concat(F.lit("more than four fields: "), F.col("surplus"))).cast("string")
        fields["event"] = F.when(F.col("surplus").isNull(), fields["event"]).otherwise(refuse)
    return raw.select(*[field.alias(c) for c, field in fields.items()], *INPUT_ORDER)


def with_event_time(raw: DataFrame, strict: bool = True, pattern: str | None = None) -> DataFrame:
    """Put the parsed time first, as ``dt``."""
    parsed = event_time(F.col("date"), F.col("time"), strict, pattern)
    return raw.select(parsed.alias("dt"), "*")
