"""The text queries that SQL can express against their SQL."""

import duckdb
import pytest

from hearthlog.llm import queries

DATA = "/root/testdata/sf0.001"


def comparable(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    expected = duck.execute(queries.SQL[name])
    names = [d[0] for d in expected.description]
    found = queries.QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(names)
    assert comparable(found.columns, found.collect()) == comparable(names, expected.fetchall())
