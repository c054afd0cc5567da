"""Datasets by day, replacement that loses nothing, reports in order."""

import pandas as pd
import pytest
from conftest import make_log
from pyspark.sql import functions as F

from hearthlog.operators import days, reports
from hearthlog.sources import folders, tables

DAY = 86_400


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture(scope="module")
def by_day(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days") / "log")
    held = [0, 1, 2, 5, 6, 9, 14, 15, 40]
    log = make_log(spark, [(d * DAY + h * 3600, "A") for d in held for h in (0, 7, 23)] + [(None, "A")])
    tables.write_days(log, path)
    return log, path


def test_days_come_from_the_listing(spark, by_day):
    log, path = by_day
    assert tables.listed_days(spark, path) == [f"2024-01-{d + 1:02}" for d in (0, 1, 2, 5, 6, 9, 14, 15)] + ["2024-02-10"]
    assert sorted(map(str, tables.read_days(spark, path).collect())) == sorted(map(str, log.collect()))


def jobs_run(spark, work):
    """The number of Spark jobs of some work."""
    context, group = spark.sparkContext, f"count-{id(work)}"
    context.setJobGroup(group, "")
    try:
        return work(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("n,seconds", [(4, DAY), (100, DAY), (5, 3600.0), (2, 5 * DAY), (3, 1.5 * DAY), (0, DAY)])
def test_last_days_open_only_their_files(spark, by_day, n, seconds):
    log, path = by_day
    found = tables.read_last_days(spark, path, n, bin_seconds=seconds)
    expected = days.last_days(log, n, bin_seconds=seconds) if n else log.where("false")
    assert found.columns == log.columns and ids(found) == ids(expected)
    if n == 4:
        found, started = jobs_run(spark, lambda: tables.read_last_days(spark, path, n))
        assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().executedPlan().toString()
        assert "(day#" in found._jdf.queryExecution().executedPlan().toString()
        assert started <= 1  # of reading the schema: none looks for the days
        assert len({r["f"] for r in found.select(F.input_file_name().alias("f")).collect()}) <= 4 * 3


def test_roles_by_day(spark, tmp_path):
    log = make_log(spark, [(d * DAY, s) for d in range(5) for s in "AB"]).withColumn("role", F.when(F.col("sensor") == "A", "x").otherwise("y"))
    path = str(tmp_path / "roles")
    tables.write_by_role(log, path)
    assert len(tables.listed_days(spark, f"{path}/role=x")) == 5
    assert ids(tables.read_role(spark, path, "x")) == [0, 2, 4, 6, 8]
    assert ids(tables.read_last_days(spark, f"{path}/role=y", 2)) == [7, 9]


def test_a_hot_instant_goes_to_several_files(spark, tmp_path):
    log = spark.range(4000).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' as dt", "'x' as role")
    path = tmp_path / "hot"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_by_role(log, str(path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [len(pd.read_parquet(f)) for f in path.glob("role=x/day=2024-01-01/*.parquet")]
    assert sum(sizes) == 4000 and max(sizes) < 1500


def test_a_failing_write_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.write_table(spark.range(5), path)
    bad = spark.range(1000).select(F.when(F.col("id") < 900, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    with pytest.raises(Exception, match="no"):
        tables.write_table(bad, path)
    assert ids(tables.read_table(spark, path)) == list(range(5))
    assert [p.name for p in tmp_path.iterdir()] == ["table"]


def test_a_dataset_can_be_replaced_from_itself(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.write_table(spark.range(6), path)
    for _ in range(2):
        tables.write_table(tables.read_table(spark, path).where("id > 1").selectExpr("id - 1 as id"), path)
    assert ids(tables.read_table(spark, path)) == [1, 2, 3]


def test_rows_left_aside_are_put_back(spark, tmp_path):
    path = str(tmp_path / "table")
    tables.write_table(spark.range(3), path)
    (tmp_path / "table").rename(tmp_path / ".table.old")  # as if a job had ended between its two moves
    assert folders.recover(spark, path) and ids(tables.read_table(spark, path)) == [0, 1, 2]
    assert not folders.recover(spark, path)
    (tmp_path / "table").rename(tmp_path / ".table.old")
    with pytest.raises(ZeroDivisionError):
        folders.replace(spark, path, lambda new: 1 / 0)
    assert ids(tables.read_table(spark, path)) == [0, 1, 2]


def test_parts_by_name_are_one_csv_in_order(spark, tmp_path):
    log = make_log(spark, [((i * 7919) % 5000 / 2, f"s{i % 3}") for i in range(3000)] + [(None, None)])
    scored = log.withColumn("p", F.col("id") / 8192)
    path = tmp_path / "report"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_report(reports.point_anomalies(scored, "p", 0.3, place=["id"]), str(path), ["id"], single=True)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(path.glob("part-*"))
    assert len(parts) > 4 and parts[0].read_text() == "dt,sensor,p\n"
    text = "".join(p.read_text() for p in parts)
    assert (tmp_path / "report.csv").read_text() == text
    frame = pd.DataFrame([(r["dt"], r["sensor"], r["p"]) for r in scored.where("p < 0.3").collect()], columns=["dt", "sensor", "p"])
    frame["dt"] = frame["dt"].map(lambda t: None if pd.isna(t) else f"{t:%Y-%m-%d %H:%M:%S.%f}")
    assert text == frame.sort_values(["dt", "sensor", "p"]).to_csv(index=False)
    for place in (str(path), f"{path}.csv"):
        assert tables.read_report(spark, place, "p").count() == len(frame)


def test_numbers_are_written_as_in_reports(spark):
    values = [0.1, 1.0, 0.0, -0.5, 1e-3, 0.00085, -1.23e-4, 1e-4, 9.99e-5, 1.5e-5, 2e-10, 1e-300, 1e7, 12345678.9, 1e15, 1e16, 1.5e22, 0.19 / 3, 1 / 7e3]
    table = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in table.select(tables.number_text(F.col("v"))).collect()] == [repr(v) for v in values]


def rows_scanned(df):
    """Rows that the scan of a collected frame handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_a_report_skips_row_groups_without_low_scores(spark, tmp_path):
    scored = spark.range(0, 200_000, 1, 4).selectExpr(
        "id", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id div 100000 as int), 0, 0, id % 86400) as dt",
        "concat('s', id % 50) as sensor", "rand(1) as p", "rand(2) - 0.5 as q",
    )
    low = {"p": 0.01, "q": -0.49}
    plain, laid = str(tmp_path / "plain"), str(tmp_path / "laid")
    tables.write_days(scored, plain, row_group_bytes=65536)
    tables.write_days(scored, laid, thresholds=low, row_group_bytes=65536)
    for signal, threshold in low.items():
        found = reports.point_anomalies(tables.read_days(spark, laid), signal, threshold)
        assert rows_scanned(found) < 0.25 * rows_scanned(reports.point_anomalies(tables.read_days(spark, plain), signal, threshold))
        assert found.count() == scored.where(F.col(signal) < threshold).count()
