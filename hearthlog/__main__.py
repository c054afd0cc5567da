"""``python -m hearthlog LOG METADATA OUT``: clean, score and report a log.

Every setting is an option, such as ``--days-kept 14``. Submit it with ``spark-submit``
to run on a cluster; ``spark.checkpoint.dir`` names the folder that all executors share.
"""

import argparse
from dataclasses import fields

from pyspark.sql import SparkSession

from hearthlog.plans.jobs import run_all
from hearthlog.settings import Settings


def parse(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="hearthlog", description=__doc__.split("\n\n")[0])
    parser.add_argument("log", help="CSV file or folder")
    parser.add_argument("metadata", help="JSON file of the sensors")
    parser.add_argument("out", help="folder for the results")
    for field in fields(Settings):
        option = "--" + field.name.replace("_", "-")
        if isinstance(field.default, bool):
            parser.add_argument(option, action="store_true")
        else:
            kind = str if field.default is None else type(field.default)
            parser.add_argument(option, type=kind, default=field.default)
    return parser.parse_args(arguments)


def main(arguments: list[str] | None = None) -> None:
    given = parse(arguments)
    settings = Settings(**{f.name: getattr(given, f.name) for f in fields(Settings)})
    spark = SparkSession.builder.appName("hearthlog").getOrCreate()
    run_all(spark, given.log, given.metadata, given.out, settings)


if __name__ == "__main__":
    main()
