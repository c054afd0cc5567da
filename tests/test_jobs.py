"""Sources, sinks and the whole jobs."""

import json

import pytest
from conftest import seconds_of
from pyspark.sql import functions as F

from hearthlog import Settings
from hearthlog.plans import jobs
from hearthlog.sources import metadata, readings, tables
from hearthlog.staging import drop_stages, new_stage_path, stage, stage_root

LINES = [
    "ON,2024-01-01,00:00:00.5,A",
    "OFF,2024-01-01,00:00:01,A",
    "ON,2024-01-01,00:00:12,V",
    "ON,2024-01-01,00:00:20,B",
    "ON,2024-01-01,00:00:21,YYY",
    "ON,2024-01-01,00:00:22,P",
    "ON,2024-01-01,00:00:23,",
    "ON,2024-01-01,00:00:24,A",
    "ON,,00:00:24,A",
]


@pytest.fixture
def inputs(tmp_path):
    csv, meta = tmp_path / "log.csv", tmp_path / "meta.json"
    csv.write_text("\n".join(LINES) + "\n")
    meta.write_text(json.dumps({"vibration": {"V": {"Delay": 11.9, "Room": 1}}, "appliances": ["P"]}, indent=1))
    return str(csv), str(meta)


def test_csv_is_read_as_text_with_its_order(spark, inputs):
    raw = readings.with_event_time(readings.read_raw(spark, inputs[0]))
    rows = raw.orderBy(*readings.INPUT_ORDER).collect()
    assert raw.columns[:5] == ["dt", "event", "date", "time", "sensor"]
    assert [r["sensor"] for r in rows] == ["A", "A", "V", "B", "YYY", "P", None, "A", "A"]
    assert [seconds_of(r["dt"]) for r in rows] == [0.5, 1, 12, 20, 21, 22, 23, 24, None]


def test_rows_are_ordered_by_file_and_place(spark, tmp_path):
    for name in ("b 2.csv", "a%é.csv", "c.csv"):
        lines = [f"{name} {i},2024-01-01,00:00:00,A" for i in range(300)]
        (tmp_path / name).write_text("\n".join(lines[: 300 if name != "c.csv" else 3]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        raw = readings.read_raw(spark, str(tmp_path))
        rows = [r["event"] for r in raw.orderBy(*readings.INPUT_ORDER).collect()]
        assert raw.select("input_block").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = [("a%é.csv", 300), ("b 2.csv", 300), ("c.csv", 3)]
    assert rows == [f"{name} {i}" for name, n in expected for i in range(n)]


def test_bad_times_raise_unless_lenient(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("ON,yesterday,noon,A\n")
    raw = readings.read_raw(spark, str(path))
    assert readings.with_event_time(raw, strict=False).first()["dt"] is None
    with pytest.raises(Exception, match="not a timestamp"):
        readings.with_event_time(raw).collect()


def test_times_by_pattern(spark, tmp_path):
    path = tmp_path / "day_first.csv"
    # the second time does not exist in New York
    path.write_text("ON,02/01/2024,00:00:01.5,A\nON,10/03/2024,02:30:00.0,A\nON,soon,,A\nON,soon,1,A\n")
    raw = readings.read_raw(spark, str(path))
    lenient = readings.with_event_time(raw, strict=False, pattern="dd/MM/yyyy HH:mm:ss.S")
    times = [seconds_of(r["dt"]) for r in lenient.orderBy("input_row").collect()]
    assert times == [86401.5, 69 * 86400 + 9000, None, None]
    with pytest.raises(Exception, match="not a timestamp"):
        readings.with_event_time(raw, pattern="dd/MM/yyyy HH:mm:ss.S").collect()


@pytest.mark.parametrize("appliances", [["P", "Q"], {"P": 1, "Q": {"x": 2}}])
def test_metadata_forms(spark, tmp_path, appliances):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"vibration": {"V": {"Delay": 3}}, "appliances": appliances}))
    delays, names = metadata.read_metadata(spark, str(path))
    assert [tuple(r) for r in delays.collect()] == [("V", 3.0)]
    assert sorted(r["sensor"] for r in names.collect()) == ["P", "Q"]


@pytest.mark.parametrize("document, key", [({"appliances": []}, "vibration"), ({"vibration": {}}, "appliances"), ({"vibration": {"V": {}}, "appliances": []}, "Delay")])
def test_metadata_without_a_key_raises(spark, tmp_path, document, key):
    path = tmp_path / "m.json"
    path.write_text(json.dumps(document))
    delays, names = metadata.read_metadata(spark, str(path))
    with pytest.raises(Exception, match=f"metadata lacks {key}"):
        delays.collect()
        names.collect()


def test_prepare_data(spark, inputs, tmp_path):
    out = str(tmp_path / "cleaned")
    jobs.prepare_data(spark, *inputs, out)
    activity = tables.read_role(spark, out, "activity")
    found = {seconds_of(r["dt_raw"]): (seconds_of(r["dt"]), r["sensor"], r["event"]) for r in activity.collect()}
    assert found == {
        0.5: (0.5, "A", "ON"), 12: (0.1, "V", "ON"), 20: (20, "B", "ON"), 23: (23, None, "ON"),
        24: (24, "A", "ON"), None: (None, "A", "ON"),
    }
    assert [r["sensor"] for r in tables.read_role(spark, out, "appliance").collect()] == ["P"]
    assert "PartitionFilters: [isnotnull(role" in activity._jdf.queryExecution().toString()


def test_scores_follow_the_order_before_the_shift(spark, inputs, tmp_path):
    cleaned, scored = str(tmp_path / "cleaned"), str(tmp_path / "scored")
    jobs.prepare_data(spark, *inputs, cleaned)
    with pytest.raises(ValueError):
        jobs.get_scores(spark, cleaned, cleaned)
    jobs.get_scores(spark, cleaned, scored, Settings(trees=5))
    rows = tables.read_table(spark, scored).orderBy("dt_raw", "input_row").collect()
    by_time = {seconds_of(r["dt_raw"]): r for r in rows}
    # A V B null A A: A is followed by V and by A, V by B, B by null
    assert by_time[0.5]["markov_prob"] == 0.5 and by_time[12]["markov_prob"] == 1.0
    assert by_time[20]["markov_prob"] is None and by_time[23]["markov_prob"] is None
    assert by_time[24]["markov_prob"] == 0.5 and by_time[None]["markov_prob"] is None
    assert by_time[None]["iforest_score"] is None and by_time[20]["iforest_score"] is not None


def test_run_all_reports_both_signals(spark, inputs, tmp_path):
    out = str(tmp_path)
    reports = jobs.run_all(spark, *inputs, out, Settings(trees=5, markov_threshold=0.6))
    assert set(reports) == {"markov_prob", "iforest_score"}
    written = tables.read_report(spark, f"{out}/markov_prob_anomalies", "markov_prob")
    assert sorted(map(str, written.collect())) == sorted(map(str, reports["markov_prob"].anomalies.collect()))
    assert written.count() == 2
    day = reports["markov_prob"].days.first()
    assert (day["n_points"], day["n_anomalies"], day["shape_tv"]) == (5, 2, None)
    assert reports["iforest_score"].tiles.count() == 5
    text = "".join(p.read_text() for p in sorted((tmp_path / "markov_prob_anomalies").glob("part-*"))).splitlines()
    assert text[0] == "dt,sensor,markov_prob"
    assert "2024-01-01 00:00:00.500000,A,0.5" in text


def stages_left(spark):
    path = new_stage_path(spark, "x").rsplit("/", 1)[0]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []


def test_nothing_is_left_after_a_run(spark, inputs, tmp_path):
    drop_stages(spark)
    reports = jobs.run_all(spark, *inputs, str(tmp_path), Settings(trees=5, bin_seconds=3600.0))
    assert stages_left(spark) == []
    for report in reports.values():
        assert report.tiles.count() == 5 and report.raster.count() > 0 and report.days.count() == 1


def test_the_log_is_parsed_once_and_scored_in_three_reads(spark, inputs, tmp_path, monkeypatch):
    plans = []
    for name in ("write_by_role", "write_days"):
        write = getattr(jobs, name)
        monkeypatch.setattr(jobs, name, lambda df, path, w=write, **how: (plans.append(df._jdf.queryExecution().toString()), w(df, path, **how)))
    jobs.run_all(spark, *inputs, str(tmp_path), Settings(trees=5))
    assert not any("FileScan csv" in p for p in plans)


def test_surplus_fields_raise(spark, tmp_path):
    path = tmp_path / "wide.csv"
    path.write_text("ON,2024-01-01,00:00:00,A,EXTRA\nON,2024-01-01\n")
    with pytest.raises(Exception, match="more than four fields: EXTRA"):
        readings.read_raw(spark, str(path)).collect()
    rows = readings.read_raw(spark, str(path), strict=False).orderBy("input_row").collect()
    assert [tuple(r)[:4] for r in rows] == [("ON", "2024-01-01", "00:00:00", "A"), ("ON", "2024-01-01", None, None)]


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('"ON\nX",2024-01-01,00:00:00,B\nOFF,2024-01-01,00:00:01,B\n')
    rows = readings.read_raw(spark, str(path), multi_line=True).orderBy("input_row").collect()
    assert [(r["event"], r["sensor"]) for r in rows] == [("ON\nX", "B"), ("OFF", "B")]


def test_command_line(spark, inputs, tmp_path):
    from hearthlog import __main__ as command

    given = command.parse([*inputs, "out", "--days-kept", "3", "--multi-line", "--bin-seconds", "3600"])
    assert (given.days_kept, given.multi_line, given.bin_seconds, given.time_pattern) == (3, True, 3600.0, None)
    command.main([*inputs, str(tmp_path / "out"), "--trees", "3"])
    assert tables.read_table(spark, f"{tmp_path}/out/scored").count() == 6


def test_views(spark):
    tables.publish(spark.range(3), "three")
    assert spark.sql("select sum(id) as s from three").first()["s"] == 3
    tables.publish(spark.range(3).select(F.rand().alias("r")), "drawn", once=True)
    assert spark.table("drawn").collect() == spark.table("drawn").collect()


def test_a_cluster_needs_a_shared_folder(spark):
    class Nowhere:
        class conf:
            get = staticmethod(lambda key, default="file:/somewhere": default)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage_root(Nowhere)


def test_stages_live_in_the_shared_folder(spark, tmp_path):
    root = spark.conf.get("spark.checkpoint.dir")
    assert stage_root(spark) == root
    path = new_stage_path(spark, "x")
    assert path.startswith(root)
    staged = stage(spark.range(5), "kept")
    assert staged.count() == 5 and staged.inputFiles()[0].replace("file://", "").startswith(root)


def test_drop_stages(spark):
    path = new_stage_path(spark, "gone")
    spark.range(1).write.parquet(path)
    drop_stages(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
