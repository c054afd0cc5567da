import pyarrow as pa
import pytest

from hearthlog.llm import common

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def largest_batch(df):
    def rows(batches):
        for batch in batches:
            yield {"bytes": [batch.column(0).cast(pa.binary()).nbytes], "rows": [batch.num_rows]}

    found = common.over_batches(df, rows, "bytes long, rows long").collect()
    return max((r["bytes"] for r in found), default=0), sum(r["rows"] for r in found)


@pytest.fixture
def own_setting(spark):
    before = spark.conf.get(NAME, None)
    spark.conf.unset(NAME)
    yield spark.conf
    spark.conf.unset(NAME)
    if before is not None:
        spark.conf.set(NAME, before)


def test_batches_of_long_texts_are_bounded(spark, own_setting):
    texts = spark.range(3000, numPartitions=1).selectExpr("repeat('long ', 2000) AS text")
    size, rows = largest_batch(texts)
    assert rows == 3000
    assert size < common.BATCH_BYTES + 100_000


def test_one_text_longer_than_a_batch_is_whole(spark, own_setting):
    texts = spark.range(3, numPartitions=1).selectExpr("repeat('x', 6000000) AS text")
    size, rows = largest_batch(texts)
    assert rows == 3 and size >= 6_000_000


def test_no_rows(spark, own_setting):
    assert largest_batch(spark.createDataFrame([], "text string")) == (0, 0)


def test_a_bound_of_the_session_stays(spark, own_setting):
    own_setting.set(NAME, "123456")
    largest_batch(spark.createDataFrame([("a",)], "text string"))
    assert own_setting.get(NAME) == "123456b" or own_setting.get(NAME) == "123456"
