"""Every registered query against its SQL, on the smallest test tables."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")

spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    return repr(float(value)) if isinstance(value, float) else str(value)


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(entry.SQL))
def test_query_equals_sql(spark, duck, name):
    found = entry.QUERIES[name](spark, str(DATA))
    expected = duck.execute(entry.SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert comparable(found.columns, found.collect()) == comparable(names, expected.fetchall())


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.SQL)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 412
    assert [r["dt"] for r in rows] == sorted(r["dt"] for r in rows)
