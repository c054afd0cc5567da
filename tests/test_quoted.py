"""Records with line breaks from split files against the reader that does not split."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from hearthlog.sources.quoted import open_after, quoted_records
from hearthlog.sources.readings import read_raw


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b"}
    held = {n: spark.conf.get(n) for n in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in held.items():
        spark.conf.set(name, value)


@pytest.mark.parametrize("line,inside,expected", [
    ("a,b", False, False), ("a,b", True, True), ('"a,b', False, True), ('a"', True, False), ('a""', True, True), ('a""",x', True, False),
    ('a",b,"c', True, True), ('5" pipe,"x"', False, False), ('"a"b,"c', False, True), ('"a"\r', False, False), ('""', False, False),
    ('""', True, True), ('"', True, False), ('"', False, True), ("", True, True), ("", False, False), ('x,"",""""', False, False),
])
def test_open_after(line, inside, expected):
    assert open_after(line, inside) is expected


def fields(df):
    return sorted(tuple("" if v is None else v for v in r) for r in df.select("event", "date", "time", "sensor").collect())


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_against_the_reader_that_does_not_split(spark, tmp_path, small_blocks, seed, end):
    rng = random.Random(seed)
    rows, pieces = [], ["x", "long word " * 20, "\n", "\n\n", '"', ",", "é", " ", "line\nbreak\n" * 30]
    for name in ("one", "two"):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=end)
        for i in range(90):
            event = "".join(rng.choice(pieces) for _ in range(rng.choice([1, 1, 1, 2, 5])))
            rows.append((f"{name}{i} {event}.", "2024-01-01", f"00:00:{i % 60:02}", rng.choice(["A", "", "B\nC"])))
            writer.writerow(rows[-1])
            if rng.random() < 0.05:
                out.write(end)  # an empty line
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode())
    found = read_raw(spark, str(tmp_path), multi_line=True)
    whole = spark.read.schema("event string, date string, time string, sensor string").option("escape", '"').option("multiLine", True).csv(str(tmp_path))
    assert fields(found) == sorted(rows)
    if end == "\n":  # the other reader keeps the carriage returns
        assert fields(found) == fields(whole)
    order = [r["event"].split()[0] for r in found.orderBy("input_file", "input_block", "input_row").collect()]
    assert order == [f"{n}{i}" for n in ("one", "two") for i in range(90)]
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.select(F.spark_partition_id()).distinct().count() > 8


def test_open_quote_at_the_end_and_empty_files(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text('ON,d,t,A\n"open,d,t\n' + "more\n" * 200)
    found = [r["record"] for r in quoted_records(spark, str(tmp_path)).orderBy("input_row").collect()]
    assert found == ["ON,d,t,A", '"open,d,t\n' + "\n".join(["more"] * 200)]
    assert quoted_records(spark, str(tmp_path / "a.csv")).count() == 0
