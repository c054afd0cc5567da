"""Order, next sensor and transition probabilities."""

import random
from collections import Counter

from conftest import make_log
from pyspark.sql import Window
from pyspark.sql import functions as F

from hearthlog.operators import cleaning, markov, ordering

ORDER = ["dt", "sensor", "id"]


def by_id(df, column):
    return {r["id"]: r[column] for r in df.collect()}


def test_next_sensor_is_global(spark):
    day = 86400
    log = make_log(spark, [(0, "A"), (day, "A"), (day + 9, "B")])
    scored = markov.with_markov_prob(log, ORDER)
    assert by_id(scored, "next_sensor") == {0: "A", 1: "B", 2: None}
    assert by_id(scored, "markov_prob") == {0: 0.5, 1: 0.5, 2: None}


def test_null_sensors_have_no_probability(spark):
    scored = markov.with_markov_prob(make_log(spark, [(0, "A"), (1, None), (2, "B"), (3, "A")]), ORDER)
    assert by_id(scored, "next_sensor") == {0: None, 1: "B", 2: "A", 3: None}
    assert by_id(scored, "markov_prob") == {0: None, 1: None, 2: 1.0, 3: None}


def test_order_is_decided_before_the_delay_shift(spark):
    log = make_log(spark, [(10, "A"), (12, "V"), (20, "B")])
    delays = spark.createDataFrame([("V", 5.0)], "sensor string, delay double")
    shifted = cleaning.shift_delays(log, delays)
    found = by_id(markov.with_next_sensor(shifted, ["dt_raw", "sensor", "id"]), "next_sensor")
    assert found == {0: "V", 1: "B", 2: None}


def test_transitions_skip_appliances(spark):
    log = make_log(spark, [(0, "A"), (5, "P"), (10, "B")])
    appliances = spark.createDataFrame([("P",)], "sensor string")
    found = markov.with_next_sensor(cleaning.without_sensors(log, appliances), ORDER)
    assert by_id(found, "next_sensor") == {0: "B", 2: None}


def messy_log(spark, n=3000):
    """A third of the readings at one instant; null times and sensors, copies."""
    rng = random.Random(11)
    rows = []
    for _ in range(n):
        moment = rng.choice([500.0, None, rng.randrange(20000) / 2, rng.randrange(20000) / 2])
        rows.append((moment, rng.choice(["A", "A", "B", "C", None])))
    return make_log(spark, rows)


def test_neighbours_equal_a_global_window(spark):
    log = messy_log(spark).cache()
    keys = [F.col(c).asc_nulls_last() for c in ORDER]
    expected = log.select(
        "id",
        F.lead("id").over(Window.orderBy(*keys)).alias("after"),
        F.lag("id").over(Window.orderBy(*keys)).alias("before"),
    )
    after = ordering.with_neighbour(log, ORDER, ["id", "sensor"], "n")
    before = ordering.with_neighbour(log, ORDER, ["id"], "n", step=-1)
    assert by_id(after.select("id", "n.id").toDF("id", "n"), "n") == by_id(expected, "after")
    assert by_id(before.select("id", "n.id").toDF("id", "n"), "n") == by_id(expected, "before")


def test_positions_equal_a_global_window(spark):
    log = messy_log(spark, 500)
    keys = [F.col(c).asc_nulls_last() for c in ORDER]
    expected = log.withColumn("p", F.row_number().over(Window.orderBy(*keys)) - 1)
    assert by_id(ordering.with_position(log, ORDER, "p"), "p") == by_id(expected, "p")


def test_one_row_and_no_rows(spark):
    one = make_log(spark, [(0, "A")])
    assert by_id(markov.with_markov_prob(one, ORDER), "markov_prob") == {0: None}
    assert markov.with_markov_prob(one.limit(0), ORDER).count() == 0


def test_probabilities_equal_brute_force(spark):
    log = messy_log(spark)
    rows = sorted(
        log.collect(),
        key=lambda r: (r["dt"] is None, str(r["dt"]), r["sensor"] is None, r["sensor"] or "", r["id"]),
    )
    pairs = [
        (a["sensor"], b["sensor"]) for a, b in zip(rows, rows[1:]) if a["sensor"] and b["sensor"]
    ]
    out, count = Counter(a for a, _ in pairs), Counter(pairs)
    expected = {rows[-1]["id"]: None}
    for a, b in zip(rows, rows[1:]):
        pair = (a["sensor"], b["sensor"])
        expected[a["id"]] = count[pair] / out[pair[0]] if None not in pair else None
    assert by_id(markov.with_markov_prob(log, ORDER), "markov_prob") == expected


def test_probabilities_out_of_a_sensor_add_up(spark):
    table = markov.transition_table(markov.with_next_sensor(messy_log(spark), ORDER))
    for row in table.groupBy("sensor").agg(F.sum("p").alias("total")).collect():
        assert abs(row["total"] - 1) < 1e-12


def test_chunks_are_even_on_a_hot_instant(spark):
    """Also when almost every reading has the same time and the same sensor."""
    log = make_log(spark, [(5, "A")] * 7000 + [(i, "B") for i in range(1000)])
    laid_out = ordering._chunked(log, ORDER).withColumn("chunk", F.spark_partition_id())
    sizes = [r["count"] for r in laid_out.groupBy("chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000
