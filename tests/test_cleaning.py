"""Noise, debouncing, delays and roles."""

import random

import pytest
from conftest import at, make_log, seconds_of
from pyspark.sql import functions as F

from hearthlog.operators import cleaning


def times(df):
    return sorted((seconds_of(r["dt"]), r["sensor"]) for r in df.collect())


def test_noise_filter_keeps_readings_without_sensor(spark):
    log = make_log(spark, [(0, "A"), (1, None), (2, "YYY")])
    assert {r["sensor"] for r in cleaning.drop_noise(log).collect()} == {"A", None}


def test_debounce_compares_with_the_previous_raw_reading(spark):
    log = make_log(spark, [(0, "A"), (1.5, "A"), (3.0, "A"), (4.5, "A"), (7.0, "A")])
    assert times(cleaning.debounce(log, ["id"])) == [(0, "A"), (7.0, "A")]


def test_debounce_gap_is_strict_and_spares_readings_without_sensor_or_time(spark):
    log = make_log(spark, [(0, "A"), (2.0, "A"), (1, "B"), (3, None), (3.5, None), (None, "A"), (None, "A")])
    assert cleaning.debounce(log, ["id"]).count() == 7
    close = make_log(spark, [(0, "A"), (1.999999, "A")])
    assert times(cleaning.debounce(close, ["id"])) == [(0, "A")]


def test_debounce_keeps_the_first_of_a_tie(spark):
    log = make_log(spark, [(0, "A", "ON"), (0, "A", "OFF"), (1, "A", "OFF")])
    assert [r["event"] for r in cleaning.debounce(log, ["id"]).collect()] == ["ON"]
    assert [r["event"] for r in cleaning.debounce(log, ["event"]).collect()] == ["OFF"]


def test_debounce_before_1970_and_with_columns_in_place(spark):
    log = make_log(spark, [(-2e9, "A"), (-2e9 + 1, "A"), (-2e9 + 3.5, "A")])
    kept = cleaning.debounce(log, ["id"])
    assert kept.columns == log.columns
    assert times(kept) == [(-2e9, "A"), (-2e9 + 3.5, "A")]


def test_no_debounce_for_zero_seconds(spark):
    log = make_log(spark, [(0, "A"), (0, "A")])
    assert cleaning.debounce(log, ["id"], seconds=0).count() == 2


@pytest.mark.parametrize("seconds", [0.5, 2, 60])
def test_debounce_equals_brute_force_on_hot_keys(spark, seconds):
    """Half of the readings are of one sensor, a quarter at one instant."""
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        sensor = rng.choice(["H", "H", "H", "a", "b", None])
        moment = 1000 if rng.random() < 0.25 else rng.randrange(0, 20000) / 4
        rows.append((moment, sensor))
    rows += [(None, "a")] * 5
    expected, last = [], {}
    for i, (t, s) in sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0] or 0, r[0])):
        if t is None or s is None or s not in last or t - last[s] >= seconds:
            expected.append(i)
        if t is not None and s is not None:
            last[s] = t
    found = cleaning.debounce(make_log(spark, rows), ["id"], seconds)
    assert sorted(r["id"] for r in found.collect()) == sorted(expected)


def test_debouncing_twice_changes_nothing(spark):
    rng = random.Random(3)
    log = make_log(spark, [(rng.randrange(400) / 2, rng.choice("AB")) for _ in range(300)])
    once = cleaning.debounce(log, ["id"])
    twice = cleaning.debounce(once, ["id"])
    assert sorted(r["id"] for r in once.collect()) == sorted(r["id"] for r in twice.collect())


def test_gap_per_sensor(spark):
    log = make_log(spark, [(0, "A"), (1, "B"), (5.5, "A"), (5.5, "A"), (9, None), (10, None), (None, "A")])
    found = {r["id"]: r["gap_us"] for r in cleaning.with_gap(log, ["id"]).collect()}
    assert found == {0: None, 1: None, 2: 5_500_000, 3: 0, 4: None, 5: None, 6: None}


def test_gap_across_many_chunks(spark):
    rows = [(3 * i, f"s{i % 7}") for i in range(2000)]
    found = cleaning.with_gap(make_log(spark, rows), ["id"]).collect()
    assert {r["gap_us"] for r in found if r["id"] >= 7} == {21_000_000}
    assert [r["gap_us"] for r in found if r["id"] < 7] == [None] * 7


def test_delays_move_only_their_sensor(spark):
    log = make_log(spark, [(10, "A"), (12, "V"), (20, None), (None, "V")])
    delays = spark.createDataFrame([("V", 1.25), ("W", 9.0)], "sensor string, delay double")
    shifted = {r["id"]: r for r in cleaning.shift_delays(log, delays).collect()}
    assert [seconds_of(shifted[i]["dt"]) for i in range(4)] == [10, 10.75, 20, None]
    assert [seconds_of(shifted[i]["dt_raw"]) for i in range(4)] == [10, 12, 20, None]


def test_delays_ignore_the_session_zone(spark):
    # 02:30 on 10 March 2024 does not exist in New York
    log = make_log(spark, [(69 * 86400 + 2.5 * 3600 + 30, "V")])
    delays = spark.createDataFrame([("V", 30.0)], "sensor string, delay double")
    moved = cleaning.shift_delays(log, delays).first()["dt"]
    assert moved == at(69 * 86400 + 2.5 * 3600)


def test_roles_split_without_losing_readings(spark):
    log = make_log(spark, [(0, "A"), (1, "P"), (2, None), (3, "P")])
    appliances = spark.createDataFrame([("P",), ("P",), ("Q",)], "sensor string")
    assert cleaning.only_sensors(log, appliances).count() == 2
    rest = cleaning.without_sensors(log, appliances)
    assert {r["sensor"] for r in rest.collect()} == {"A", None}
    roles = cleaning.with_role(log, appliances)
    assert [r["role"] for r in roles.orderBy("id").collect()] == [
        "activity", "appliance", "activity", "appliance",
    ]
    assert roles.where(F.col("role") == "activity").count() == rest.count()
