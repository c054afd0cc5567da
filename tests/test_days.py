"""Reports, day tables and the comparison of days."""

import datetime as dt

import pytest
from conftest import make_log, seconds_of
from pyspark.sql import functions as F

from hearthlog.operators import attach, days, reports
from hearthlog.sources import tables

DAY = 86400


def signal_log(spark, rows):
    """(seconds, value) as a scored log."""
    from conftest import at

    data = [(i, at(t), "A", v) for i, (t, v) in enumerate(rows)]
    return spark.createDataFrame(data, "id long, dt timestamp_ntz, sensor string, p double")


def test_anomalies_are_strictly_below_and_never_null(spark):
    scored = signal_log(spark, [(0, 0.1), (1, 0.2), (2, None), (None, 0.0)])
    found = reports.in_time_order(reports.point_anomalies(scored, "p", 0.2)).collect()
    assert [(seconds_of(r["dt"]), r["p"]) for r in found] == [(0, 0.1), (None, 0.0)]
    with pytest.raises(ValueError):
        reports.point_anomalies(scored, "q", 0.2)


def test_equal_anomalies_go_to_several_parts(spark, tmp_path):
    """Readings equal in all that is reported, as a log without sensors has them."""
    scored = spark.range(4000).selectExpr(
        "id", "timestamp_ntz'2024-01-01 00:00:00' as dt", "cast(null as string) as sensor", "0.1D as p"
    )
    path = str(tmp_path / "report")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_report(reports.point_anomalies(scored, "p", 0.5, place=["id"]), path, ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [len(f.read_text().splitlines()) for f in (tmp_path / "report").glob("part-0*")]
    assert sum(sizes) == 4000 and max(sizes) < 1500
    assert tables.read_report(spark, path, "p").columns == ["dt", "sensor", "p"]


def test_last_days_skip_empty_ones_and_the_report_does_not(spark):
    held = [d if d < 20 else d + 5 for d in range(40)]
    scored = signal_log(spark, [(d * DAY + 60, 0.0) for d in held] + [(None, 0.0)])
    tiles = days.daily_tiles(days.last_days(scored, 30), "p", 0.5).collect()
    assert sorted((r["dt"] - dt.datetime(2024, 1, 1)).days for r in tiles) == held[10:]
    assert sorted(r["tile_no"] for r in tiles) == list(range(30))
    assert reports.point_anomalies(scored, "p", 0.5).count() == 41


def test_last_days_of_nothing(spark):
    assert days.last_days(signal_log(spark, [(None, 1.0)])).count() == 0


def test_filter_on_days_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "scored")
    signal_log(spark, [(d * DAY, 0.1 * d) for d in range(9)]).write.parquet(path)
    plan = days.last_days(spark.read.parquet(path), 3)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(dt,2024-01-07T00:00)" in plan
    plan = reports.point_anomalies(spark.read.parquet(path), "p", 0.3)._jdf.queryExecution()
    assert "LessThan(p,0.3)" in plan.toString()


def test_tiles_keep_null_signals(spark):
    scored = signal_log(spark, [(10, None), (20, None), (DAY + 5, 0.1), (DAY + 9, 0.9)])
    found = {r["id"]: r for r in days.daily_tiles(scored, "p", 0.5).join(scored, "dt").collect()}
    assert [found[i]["tile_no"] for i in range(4)] == [0, 0, 1, 1]
    assert [found[i]["is_anomaly"] for i in range(4)] == [False, False, True, False]
    assert seconds_of(found[3]["day_start"]) == DAY + 5 and seconds_of(found[2]["day_end"]) == DAY + 9


def test_day_equi_join_equals_the_bare_range_join(spark):
    log = signal_log(spark, [(i * 977.5, (i % 10) / 10) for i in range(900)])
    found = reports.point_anomalies(log, "p", 0.3)
    bounds = days.day_bounds(days.last_days(log, 5))
    fast = days.overlay(found, bounds).select("dt", "day").collect()
    bare = found.join(bounds, F.col("dt").between(F.col("day_start"), F.col("day_end")))
    assert sorted(fast) == sorted(bare.select("dt", "day").collect()) and fast


def test_overlay_counts_keep_days_without_anomalies(spark):
    log = signal_log(spark, [(0, 0.1), (9, 0.2), (DAY, 0.9)])
    found = days.overlay_counts(days.day_bounds(log), reports.point_anomalies(log, "p", 0.5))
    got = {r["title"]: (r["n_overlaid"], r["has_anomalies"]) for r in found.collect()}
    assert got == {"2024-01-01": (2, True), "2024-01-02": (0, False)}


def test_raster_counts_every_drawn_point(spark):
    rows = [(0, 0.0), (DAY - 0.000001, 1.0), (43200, 0.5), (43201, None), (DAY, 0.25)]
    cells = days.tile_raster(signal_log(spark, rows), "p", 0.3, columns=24, rows=4).collect()
    assert sorted((r["day"].day, r["xb"], r["yb"], r["n_points"], r["n_anomalies"]) for r in cells) == [
        (1, 0, 0, 1, 1), (1, 12, 2, 1, 0), (1, 23, 3, 1, 0), (2, 0, 1, 1, 1),
    ]


def test_raster_of_a_constant_signal(spark):
    cells = days.tile_raster(signal_log(spark, [(0, 0.5), (1, 0.5)]), "p", 0.3).collect()
    assert [(r["yb"], r["n_points"]) for r in cells] == [(0, 2)]
    nothing = days.tile_raster(signal_log(spark, [(0, None)]), "p", 0.3)
    assert nothing.count() == 0


def test_shifted_day_has_the_largest_shape_distance(spark):
    day = [(h * 3600.0, 0.1 * (h % 5)) for h in (6, 7, 8, 12, 17)]
    rows = [(d * DAY + t + (21600 if d == 2 else 0), v) for d in range(3) for t, v in day]
    raster = days.tile_raster(signal_log(spark, rows), "p", 0.05)
    found = {r["day"].day: r for r in days.shape_deviation(raster).collect()}
    assert found[3]["shape_rank"] == 1 and found[1]["shape_rank"] == found[2]["shape_rank"] == 2
    assert found[1]["shape_tv"] < found[3]["shape_tv"] <= 1


def test_shape_distance_equals_brute_force(spark):
    rows = [(i * 5003.0 % (4 * DAY), (i * 37 % 100) / 100) for i in range(400)]
    raster = days.tile_raster(signal_log(spark, rows), "p", 0.05).collect()
    cells = {(r["xb"], r["yb"]) for r in raster}
    names = sorted({r["day"] for r in raster})
    counts = {(r["day"], r["xb"], r["yb"]): r["n_points"] for r in raster}
    share = {}
    for d in names:
        total = sum(counts.get((d, *c), 0) for c in cells)
        share[d] = {c: counts.get((d, *c), 0) / total for c in cells}
    found = days.shape_deviation(days.tile_raster(signal_log(spark, rows), "p", 0.05)).collect()
    for r in found:
        others = [d for d in names if d != r["day"]]
        mean = {c: sum(share[d][c] for d in others) / len(others) for c in cells}
        expected = sum(abs(share[r["day"]][c] - mean[c]) for c in cells) / 2
        assert r["shape_tv"] == pytest.approx(expected, abs=1e-12)


def test_one_day_has_no_shape_distance(spark):
    found = days.shape_deviation(days.tile_raster(signal_log(spark, [(0, 0.1), (9, 0.2)]), "p", 1.0))
    assert [r["shape_tv"] for r in found.collect()] == [None]


def test_number_deviation(spark):
    counts = spark.createDataFrame([(i, 10, n) for i, n in enumerate([1, 2, 2, 3, 9])], "day int, n_points long, n_anomalies long")
    found = {r["day"]: r["number_z"] for r in days.number_deviation(counts).collect()}
    assert found[4] == pytest.approx(7 / 1.4826) and found[1] == 0
    flat = days.number_deviation(counts.withColumn("n_anomalies", F.lit(2)))
    assert {r["number_z"] for r in flat.collect()} == {None}


def test_scores_attached_by_key_keep_readings_with_null_keys(spark):
    log = make_log(spark, [(0, "A"), (0, None), (1, "A"), (2, "B")])
    scores = log.where("sensor = 'A'").select("dt", "sensor", F.col("id").cast("double").alias("p"))
    found = {r["id"]: r["p"] for r in attach.attach_by_key(log, scores, ["dt", "sensor"]).collect()}
    assert found == {0: 0.0, 1: None, 2: 2.0, 3: None}


def test_scores_attached_by_time(spark):
    log = signal_log(spark, [(0, 0.5), (0, 0.25), (0, 0.5), (7, 0.125), (None, 0.75)])
    found = attach.attach_by_time(log.drop("p"), log.where("id != 3"), ["p"])
    by_id = {r["id"]: (r["n_scores"], r["p_min"], r["p_max"]) for r in found.collect()}
    assert by_id == {i: (3, 0.25, 0.5) for i in range(3)} | {3: (0, None, None), 4: (0, None, None)}
    by_key = attach.attach_by_key(log.drop("p"), log.select("id", "p"), ["id"])
    assert by_key.count() == 5


def test_scores_of_one_instant_do_not_multiply(spark):
    log = signal_log(spark, [(0, i / 2000) for i in range(2000)])
    assert attach.attach_by_time(log.drop("p"), log, ["p"]).count() == 2000


def test_a_repeated_score_key_raises(spark):
    log = signal_log(spark, [(0, 0.5), (0, 0.25)])
    with pytest.raises(ValueError, match="several scores"):
        attach.attach_by_key(log.drop("p"), log.select("dt", "p"), ["dt"])
