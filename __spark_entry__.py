
from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.functions.clock import as_time
from hearthlog.operators import attach, boxes, cleaning, days, forest, intervals, labels, markov, reports, summaries
from hearthlog.plans import jobs, model
from hearthlog.settings import Settings
from hearthlog.sources import metadata, readings, tables
from hearthlog.staging import new_stage_path, stage

ORDER = ["dt", "sensor", "event_id"]
RAW_ORDER = ["dt_raw", "sensor", "event_id"]
EV_THRESHOLD = 0.19  # the default of 0.01 finds nothing among five sensors
EV_FOREST_THRESHOLD = -0.05
METADATA = {
    "vibration": {"click": {"Delay": 30}, "view": {"Delay": 1.5}},
    "appliances": ["purchase", "signup"],
}

# ---------------------------------------------------------------- inputs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, sensor=None, *extra: str) -> DataFrame:
    sensor = F.col("event_type") if sensor is None else sensor
    return _table(spark, sf_dir, "events").select(
        "event_id", as_time(F.col("ts")).alias("dt"), sensor.alias("sensor"), *extra
    )


def _fine_sensor():
    """100 sensors: event type and user group."""
    return F.concat_ws("_", "event_type", (F.col("user_id") % 20).cast("string"))


def _patchy_sensor():
    """Sensors with nulls."""
    return F.nullif(F.col("event_type"), F.lit("error"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with many readings at one time."""
    return _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("event_id"),
        as_time(F.col("o_orderdate")).alias("dt"),
        F.col("o_orderpriority").alias("sensor"),
    )


def _csv_log(spark: SparkSession, sf_dir: str) -> str:
    """The events as a headerless CSV log, written by Spark in order of ``event_id``."""
    path = new_stage_path(spark, "log")
    _events(spark, sf_dir).orderBy("event_id").select(
        F.col("event_id").cast("string").alias("event"),
        F.date_format("dt", "yyyy-MM-dd").alias("date"),
        F.date_format("dt", "HH:mm:ss.SSSSSS").alias("time"),
        F.nullif(F.col("sensor"), F.lit("error")).alias("sensor"),
    ).write.csv(path)
    return path


def _metadata(spark: SparkSession) -> str:
    path = new_stage_path(spark, "metadata")
    spark.createDataFrame([(json.dumps(METADATA),)], "value string").coalesce(1).write.text(path)
    return path


def _markov(log: DataFrame) -> DataFrame:
    """Cleaned, scored readings."""
    return markov.with_markov_prob(
        cleaning.debounce(cleaning.drop_noise(log), ["event_id"]), ORDER
    )


def _staged_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored dataset that the day reports read."""
    return stage(_markov(_events(spark, sf_dir)), "scored")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


# ---------------------------------------------------------------- SQL blocks


def _sql_events(sensor: str = "event_type", extra: str = "") -> str:
    return f"raw AS (SELECT event_id, ts AS dt, {sensor} AS sensor{extra} FROM events)"


_SQL_FINE = "event_type || '_' || CAST(user_id % 20 AS VARCHAR)"
_SQL_PATCHY = "nullif(event_type, 'error')"
_SQL_ORDERS = (
    "raw AS (SELECT o_orderkey AS event_id, CAST(o_orderdate AS TIMESTAMP) AS dt,"
    " o_orderpriority AS sensor FROM orders)"
)


def _sql_debounce(seconds: float = 2, source: str = "raw", target: str = "log") -> str:
    return f"""gaps AS (
      SELECT *, CASE WHEN sensor IS NOT NULL THEN epoch_us(dt) - epoch_us(lag(dt) OVER (
        PARTITION BY sensor ORDER BY dt, event_id)) END AS gap FROM {source}),
    {target} AS (SELECT * EXCLUDE (gap) FROM gaps WHERE gap IS NULL OR gap >= {int(seconds * 1e6)})"""


def _sql_markov(source: str = "log", ts: str = "dt") -> str:
    return f"""seq AS (
      SELECT *, lead(sensor) OVER (ORDER BY {ts} NULLS LAST, sensor NULLS LAST, event_id) AS next_sensor
      FROM {source}),
    counted AS (
      SELECT sensor, next_sensor, count(*) AS n FROM seq
      WHERE sensor IS NOT NULL AND next_sensor IS NOT NULL GROUP BY ALL),
    transitions AS (
      SELECT *, n / CAST(sum(n) OVER (PARTITION BY sensor) AS DOUBLE) AS p FROM counted),
    scored AS (
      SELECT seq.*, transitions.p AS markov_prob FROM seq
      LEFT JOIN transitions USING (sensor, next_sensor))"""


_SQL_DELAYS = "delays(sensor, delay) AS (VALUES ('click', 30.0), ('view', 1.5))"


def _sql_clean() -> str:
    """Debounced patchy events with their delays, ``dt_raw`` and role."""
    return f"""{_sql_events(_SQL_PATCHY)}, {_SQL_DELAYS}, {_sql_debounce(target="quiet")},
    cleaned AS (
      SELECT event_id, dt - to_microseconds(CAST(coalesce(delay, 0) * 1000000 AS BIGINT)) AS dt,
             sensor, dt AS dt_raw,
             CASE WHEN sensor IN ('purchase', 'signup') THEN 'appliance' ELSE 'activity' END AS role
      FROM quiet LEFT JOIN delays USING (sensor))"""


def _sql_last_days(n: int, source: str = "scored") -> str:
    return f"""kept AS (
      SELECT *, CAST(dt AS DATE) AS day FROM {source} WHERE CAST(dt AS DATE) IN (
        SELECT DISTINCT CAST(dt AS DATE) AS d FROM {source} ORDER BY d DESC LIMIT {n}))"""


def _sql_raster(signal: str, threshold: float, columns: int = 24, rows: int = 20) -> str:
    return f"""edges AS (SELECT min({signal}) AS low, max({signal}) AS high FROM kept),
    raster AS (
      SELECT day,
             CAST(floor((epoch_us(dt) % 86400000000) / CAST({86400e6 / columns} AS DOUBLE)) AS INTEGER) AS xb,
             CAST(least(floor(({signal} - low) / (high - low) * {rows}), {rows - 1}) AS INTEGER) AS yb,
             count(*) AS n_points,
             count(*) FILTER (WHERE {signal} < {threshold}) AS n_anomalies
      FROM kept, edges WHERE {signal} IS NOT NULL GROUP BY ALL)"""


_SQL_NUMBER = """middle AS (SELECT median(n_anomalies) AS med FROM daily),
    spread AS (
      SELECT any_value(med) AS med, 1.4826 * median(abs(n_anomalies - med)) AS mad FROM daily, middle)"""

_SQL_SHAPE = """shares AS (
      SELECT day, xb, yb, n_points / CAST(sum(n_points) OVER (PARTITION BY day) AS DOUBLE) AS p FROM raster),
    grid AS (
      SELECT d.day, c.xb, c.yb, coalesce(s.p, 0) AS p
      FROM (SELECT DISTINCT day FROM shares) d CROSS JOIN (SELECT DISTINCT xb, yb FROM shares) c
      LEFT JOIN shares s ON s.day = d.day AND s.xb = c.xb AND s.yb = c.yb),
    apart AS (
      SELECT *, (sum(p) OVER (PARTITION BY xb, yb) - p)
                / ((SELECT count(DISTINCT day) FROM shares) - 1) AS m FROM grid),
    shapes AS (SELECT day, sum(abs(p - m)) / 2 AS tv FROM apart GROUP BY day)"""


_SQL_IN_RANGE = "TRUE AS has_score, TRUE AS in_range"


def _score_checked(scored, name="iforest_score"):
    """The score depends on the seed; that there is one, and its range, do not."""
    in_range = F.col(name).between(-0.5, 0.5)
    return scored.withColumns({"has_score": F.col(name).isNotNull(), "in_range": in_range}).drop(name)


# ---------------------------------------------------------------- queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


@_query(
    "csv_roundtrip",
    f"""WITH {_sql_events(_SQL_PATCHY)}
    SELECT dt, CAST(event_id AS VARCHAR) AS event, sensor FROM raw""",
)
def _csv_roundtrip(spark, sf_dir):
    raw = readings.read_raw(spark, _csv_log(spark, sf_dir))
    return readings.with_event_time(raw).select("dt", "event", "sensor")


@_query(
    "csv_line_breaks",
    """SELECT ts AS dt, CASE WHEN event_id % 3 = 0 THEN 'a' || chr(10) || '"' || CAST(event_id AS VARCHAR) || ',' || chr(10) || chr(10)
                         ELSE CAST(event_id AS VARCHAR) END AS event,
           event_type || CASE WHEN event_id % 7 = 0 THEN chr(10) || 'x' ELSE '' END AS sensor FROM events""",
)
def _csv_line_breaks(spark, sf_dir):
    """A log with line breaks in quoted fields, in files of several blocks."""
    path = new_stage_path(spark, "quoted")
    log = _events(spark, sf_dir)
    number = F.col("event_id").cast("string")
    broken = F.concat(F.lit('"a\n""'), number, F.lit(',\n\n"'))
    log.orderBy("event_id").select(
        F.concat_ws(
            ",",
            F.when(F.col("event_id") % 3 == 0, broken).otherwise(number),
            F.date_format("dt", "yyyy-MM-dd"),
            F.date_format("dt", "HH:mm:ss.SSSSSS"),
            F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('"'), F.col("sensor"), F.lit('\nx"'))).otherwise(F.col("sensor")),
        ).alias("value")
    ).coalesce(2).write.text(path)
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        raw = readings.read_raw(spark, path, multi_line=True)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    return readings.with_event_time(raw).select("dt", "event", "sensor")


@_query(
    "noise_filter",
    f"""WITH {_sql_events(_SQL_PATCHY)}
    SELECT event_id, dt, sensor FROM raw WHERE sensor IS DISTINCT FROM 'signup'""",
)
def _noise_filter(spark, sf_dir):
    return cleaning.drop_noise(_events(spark, sf_dir, _patchy_sensor()), noise="signup")


@_query(
    "sensor_gap",
    f"""WITH {_sql_events(_SQL_PATCHY)}, {_sql_debounce()}
    SELECT event_id, dt, sensor, CAST(gap AS BIGINT) AS gap_us FROM gaps""",
)
def _sensor_gap(spark, sf_dir):
    return cleaning.with_gap(_events(spark, sf_dir, _patchy_sensor()), ["event_id"])


@_query(
    "debounce",
    f"WITH {_sql_events()}, {_sql_debounce()} SELECT event_id, dt, sensor FROM log",
)
def _debounce(spark, sf_dir):
    return cleaning.debounce(_events(spark, sf_dir), ["event_id"])


@_query(
    "debounce_wide",
    f"WITH {_sql_events(_SQL_PATCHY)}, {_sql_debounce(60)} SELECT event_id, dt, sensor FROM log",
)
def _debounce_wide(spark, sf_dir):
    return cleaning.debounce(_events(spark, sf_dir, _patchy_sensor()), ["event_id"], seconds=60)


@_query(
    "debounce_ties",
    f"WITH {_SQL_ORDERS}, {_sql_debounce()} SELECT event_id, dt, sensor FROM log",
)
def _debounce_ties(spark, sf_dir):
    return cleaning.debounce(_orders(spark, sf_dir), ["event_id"])


@_query(
    "delay_shift",
    f"""WITH {_sql_events()}, {_SQL_DELAYS}
    SELECT event_id, dt - to_microseconds(CAST(coalesce(delay, 0) * 1000000 AS BIGINT)) AS dt,
           sensor, dt AS dt_raw FROM raw LEFT JOIN delays USING (sensor)""",
)
def _delay_shift(spark, sf_dir):
    delays, _ = metadata.read_metadata(spark, _metadata(spark))
    return cleaning.shift_delays(_events(spark, sf_dir), delays)


@_query(
    "appliance_split_semi",
    f"""WITH {_sql_events(_SQL_PATCHY)}
    SELECT * FROM raw WHERE sensor IN ('purchase', 'signup')""",
)
def _appliance_split_semi(spark, sf_dir):
    _, appliances = metadata.read_metadata(spark, _metadata(spark))
    return cleaning.only_sensors(_events(spark, sf_dir, _patchy_sensor()), appliances)


@_query(
    "appliance_split_anti",
    f"""WITH {_sql_events(_SQL_PATCHY)}
    SELECT * FROM raw WHERE sensor IS NULL OR sensor NOT IN ('purchase', 'signup')""",
)
def _appliance_split_anti(spark, sf_dir):
    _, appliances = metadata.read_metadata(spark, _metadata(spark))
    return cleaning.without_sensors(_events(spark, sf_dir, _patchy_sensor()), appliances)


@_query(
    "prepare_data",
    f"""WITH {_sql_clean()}
    SELECT dt, CAST(event_id AS VARCHAR) AS event, sensor, dt_raw, role FROM cleaned""",
)
def _prepare_data(spark, sf_dir):
    out = new_stage_path(spark, "cleaned")
    jobs.prepare_data(spark, _csv_log(spark, sf_dir), _metadata(spark), out)
    return tables.read_table(spark, out).select("dt", "event", "sensor", "dt_raw", "role")


@_query(
    "cyclical_features",
    f"""WITH {_sql_events()}
    SELECT event_id, dt, round(sin(epoch(CAST(dt AS TIMESTAMP)) / 86400.0 * 2 * pi()), 9) AS "sinTransform",
           round(cos(epoch(CAST(dt AS TIMESTAMP)) / 86400.0 * 2 * pi()), 9) AS "cosTransform" FROM raw""",
)
def _cyclical_features(spark, sf_dir):
    featured = labels.with_cyclical(_events(spark, sf_dir).select("event_id", "dt"))
    return _rounded(featured, "sinTransform", "cosTransform")


@_query(
    "ml_view",
    f"""WITH {_sql_events()}
    SELECT CAST(dt AS DATE) AS day, count(*) AS n,
           count(*) FILTER (WHERE sin(epoch(dt) / 86400.0 * 2 * pi()) > 0) AS n_morning
    FROM raw GROUP BY 1""",
)
def _ml_view(spark, sf_dir):
    tables.publish(labels.with_cyclical(_events(spark, sf_dir)), "ml_data")
    return spark.sql(
        """SELECT to_date(dt) AS day, count(*) AS n, count_if(sinTransform > 0) AS n_morning
        FROM ml_data GROUP BY 1"""
    )


@_query(
    "label_encode",
    f"""WITH {_sql_events("nullif(" + _SQL_FINE + ", 'error_7')")},
    codes AS (
      SELECT sensor, CAST(row_number() OVER (ORDER BY sensor) - 1 AS BIGINT) AS code
      FROM (SELECT DISTINCT sensor FROM raw WHERE sensor IS NOT NULL))
    SELECT event_id, sensor, coalesce(code, (SELECT count(*) FROM codes)) AS "sensorEnc"
    FROM raw LEFT JOIN codes USING (sensor)""",
)
def _label_encode(spark, sf_dir):
    log = _events(spark, sf_dir, F.nullif(_fine_sensor(), F.lit("error_7")))
    return labels.with_label_code(log.select("event_id", "sensor"))


@_query(
    "next_sensor",
    f"""WITH {_sql_events(_SQL_PATCHY)}, {_sql_markov("raw")}
    SELECT event_id, dt, sensor, next_sensor FROM seq WHERE next_sensor IS NOT NULL""",
)
def _next_sensor(spark, sf_dir):
    log = _events(spark, sf_dir, _patchy_sensor())
    return markov.with_next_sensor(log, ORDER).dropna(subset=["next_sensor"])


@_query(
    "transition_matrix",
    f"""WITH {_sql_events()}, {_sql_debounce()}, {_sql_markov()}
    SELECT sensor, next_sensor, n, p FROM transitions""",
)
def _transition_matrix(spark, sf_dir):
    log = cleaning.debounce(_events(spark, sf_dir), ["event_id"])
    return markov.transition_table(markov.with_next_sensor(log, ORDER))


@_query(
    "transition_matrix_sx",
    f"""WITH {_sql_events(_SQL_FINE)}, {_sql_debounce()}, {_sql_markov()}
    SELECT sensor, next_sensor, n, p FROM transitions""",
)
def _transition_matrix_sx(spark, sf_dir):
    log = cleaning.debounce(_events(spark, sf_dir, _fine_sensor()), ["event_id"])
    return markov.transition_table(markov.with_next_sensor(log, ORDER))


@_query("transition_matrix_by_runs", SQL["transition_matrix"])
def _transition_matrix_by_runs(spark, sf_dir):
    """Three batches, cut within days, summarised one by one and merged."""
    path = new_stage_path(spark, "summary")
    log = stage(cleaning.debounce(_events(spark, sf_dir), ["event_id"]), "log")
    cuts = [F.lit(t).cast("timestamp_ntz") for t in ("2024-01-09 13:20:00", "2024-01-20 02:00:00")]
    batches = [F.col("dt") < cuts[0], (F.col("dt") >= cuts[0]) & (F.col("dt") < cuts[1]), F.col("dt") >= cuts[1]]
    for batch in batches:
        summaries.append_summary(summaries.summarise(log.where(batch), ORDER), path)
    return summaries.transitions_of(summaries.read_summary(spark, path))


_LATER = "TIMESTAMP '2024-01-21 00:00:00'"


@_query(
    "model_later_days",
    f"""WITH {_sql_events(_SQL_PATCHY)}, {_sql_debounce(target="quiet")},
    log AS (SELECT * FROM quiet WHERE dt < {_LATER} AND (sensor <> 'signup' OR sensor IS NULL)), {_sql_markov()},
    later AS (
      SELECT *, lead(sensor) OVER (ORDER BY dt NULLS LAST, sensor NULLS LAST, event_id) AS following
      FROM quiet WHERE dt >= {_LATER})
    SELECT event_id, dt, later.sensor, following AS next_sensor,
           round(CASE WHEN following IS NOT NULL AND later.sensor IN (SELECT sensor FROM transitions) THEN coalesce(p, 0) END, 9) AS markov_prob,
           {_SQL_IN_RANGE}
    FROM later LEFT JOIN transitions t ON t.sensor = later.sensor AND t.next_sensor = following""",
)
def _model_later_days(spark, sf_dir):
    """A model of twenty days that lack a sensor, saved, read and applied to the others."""
    path = new_stage_path(spark, "model")
    log = stage(cleaning.debounce(_events(spark, sf_dir, _patchy_sensor()), ["event_id"]), "log")
    early = F.col("dt") < F.lit("2024-01-21").cast("timestamp_ntz")
    seen = log.where(early & ~F.col("sensor").eqNullSafe(F.lit("signup")))
    model.save_model(model.fit_model(seen, ORDER, Settings(trees=20)), path)
    scored = model.apply_model(model.load_model(spark, path), log.where(~early), ORDER)
    return _score_checked(_rounded(scored, "markov_prob"))


@_query(
    "markov_prob",
    f"""WITH {_sql_events(_SQL_PATCHY)}, {_sql_debounce()}, {_sql_markov()}
    SELECT event_id, dt, sensor, next_sensor, round(markov_prob, 9) AS markov_prob FROM scored""",
)
def _markov_prob(spark, sf_dir):
    return _rounded(_markov(_events(spark, sf_dir, _patchy_sensor())), "markov_prob")


@_query(
    "markov_ties",
    f"""WITH {_SQL_ORDERS}, {_sql_markov("raw")}
    SELECT event_id, dt, sensor, next_sensor, round(markov_prob, 9) AS markov_prob FROM scored""",
)
def _markov_ties(spark, sf_dir):
    return _rounded(markov.with_markov_prob(_orders(spark, sf_dir), ORDER), "markov_prob")


@_query(
    "markov_anomalies",
    f"""WITH {_sql_events()}, {_sql_debounce()}, {_sql_markov()}
    SELECT dt, sensor, round(markov_prob, 9) AS markov_prob FROM scored
    WHERE markov_prob < {EV_THRESHOLD} ORDER BY dt NULLS LAST""",
)
def _markov_anomalies(spark, sf_dir):
    scored = _markov(_events(spark, sf_dir))
    found = reports.point_anomalies(scored, "markov_prob", EV_THRESHOLD, place=["event_id"])
    return reports.in_time_order(_rounded(found, "markov_prob")).drop("event_id")


@_query(
    "markov_anomalies_sx",
    f"""WITH {_sql_events(_SQL_FINE)}, {_sql_debounce()}, {_sql_markov()}
    SELECT dt, sensor, round(markov_prob, 9) AS markov_prob FROM scored
    WHERE markov_prob < 0.01 ORDER BY dt NULLS LAST""",
)
def _markov_anomalies_sx(spark, sf_dir):
    scored = _markov(_events(spark, sf_dir, _fine_sensor()))
    limit = Settings().markov_threshold
    found = reports.point_anomalies(scored, "markov_prob", limit, place=["event_id"])
    return reports.in_time_order(_rounded(found, "markov_prob")).drop("event_id")


@_query(
    "markov_after_clean",
    f"""WITH {_sql_clean()}, activity AS (SELECT * FROM cleaned WHERE role = 'activity'),
    {_sql_markov("activity", "dt_raw")}
    SELECT event_id, dt, sensor, dt_raw, next_sensor, round(markov_prob, 9) AS markov_prob FROM scored""",
)
def _markov_after_clean(spark, sf_dir):
    delays, appliances = metadata.read_metadata(spark, _metadata(spark))
    cleaned = jobs.clean(_events(spark, sf_dir, _patchy_sensor()), delays, ["event_id"])
    activity = cleaning.without_sensors(cleaned, appliances)
    return _rounded(markov.with_markov_prob(activity, RAW_ORDER), "markov_prob")


@_query(
    "score_attach_key",
    f"""WITH {_sql_events(_SQL_PATCHY)}, {_sql_debounce()}, {_sql_markov()}
    SELECT event_id, dt, sensor, round(markov_prob, 9) AS markov_prob FROM scored""",
)
def _score_attach_key(spark, sf_dir):
    log = cleaning.debounce(_events(spark, sf_dir, _patchy_sensor()), ["event_id"])
    scores = markov.with_markov_prob(log, ORDER).dropna(subset=["sensor"])
    scores = scores.select("dt", "sensor", "markov_prob")
    return _rounded(attach.attach_by_key(log, scores, ["dt", "sensor"]), "markov_prob")


@_query(
    "score_attach_dt",
    f"""WITH {_SQL_ORDERS}, {_sql_markov("raw")},
    facts AS (
      SELECT dt, count(*) AS n_scores, min(markov_prob) AS markov_prob_min, max(markov_prob) AS markov_prob_max
      FROM scored GROUP BY dt)
    SELECT event_id, dt, sensor, coalesce(n_scores, 0) AS n_scores,
           round(markov_prob_min, 9) AS markov_prob_min, round(markov_prob_max, 9) AS markov_prob_max
    FROM raw LEFT JOIN facts USING (dt)""",
)
def _score_attach_dt(spark, sf_dir):
    log = _orders(spark, sf_dir)
    found = attach.attach_by_time(log, markov.with_markov_prob(log, ORDER), ["markov_prob"])
    return _rounded(found, "markov_prob_min", "markov_prob_max")


_SQL_PAIRS = f"""WITH {_SQL_ORDERS}, {_sql_markov("raw")},
    pairs AS (
      SELECT raw.dt, raw.event_id % 40 AS value, round(markov_prob, 9) AS signal FROM raw JOIN scored USING (dt)
      WHERE raw.event_id % 40 < 15 AND round(markov_prob, 9) < 0.2)"""


def _pairs(spark, sf_dir):
    log = stage(_orders(spark, sf_dir).withColumn("value", F.col("event_id") % 40), "log")
    scores = _rounded(markov.with_markov_prob(log, ORDER), "markov_prob")
    return attach.factor_by_time(log, scores, "value", "markov_prob", piece_values=8)


@_query("pair_counts_by_time", _SQL_PAIRS + "SELECT dt, count(*) AS n_pairs FROM pairs GROUP BY dt")
def _pair_counts_by_time(spark, sf_dir):
    """How many pairs of a reading and a score at one time are low on both sides."""
    return attach.count_pairs(_pairs(spark, sf_dir), lambda v: v < 15, lambda p: p < 0.2)


@_query("pairs_by_time", _SQL_PAIRS + "SELECT dt, value, signal, count(*) AS n_pairs FROM pairs GROUP BY dt, value, signal")
def _pairs_by_time(spark, sf_dir):
    return attach.expand_pairs(_pairs(spark, sf_dir), lambda v: v < 15, lambda p: p < 0.2)


@_query("markov_prob_salted", SQL["markov_prob"])
def _markov_prob_salted(spark, sf_dir):
    """As ``markov_prob``, with a transition table that is too large to broadcast."""
    log = cleaning.debounce(cleaning.drop_noise(_events(spark, sf_dir, _patchy_sensor())), ["event_id"])
    return _rounded(markov.with_markov_prob(log, ORDER, limit_bytes=0), "markov_prob")


@_query(
    "scores_table",
    f"""WITH {_sql_events()}, {_sql_debounce()}, {_sql_markov()}
    SELECT sensor, count(*) AS n, round(min(markov_prob), 9) AS least FROM scored GROUP BY sensor""",
)
def _scores_table(spark, sf_dir):
    """A computed table under a name, read by SQL."""
    tables.publish(_markov(_events(spark, sf_dir)), "scores", once=True)
    found = spark.sql("SELECT sensor, count(*) AS n, min(markov_prob) AS least FROM scores GROUP BY sensor")
    return _rounded(found, "least")


@_query(
    "csv_report",
    f"""WITH {_sql_events(_SQL_FINE)}, {_sql_debounce()}, {_sql_markov()}
    SELECT dt, sensor, round(markov_prob, 9) AS markov_prob FROM scored WHERE markov_prob < 0.01""",
)
def _csv_report(spark, sf_dir):
    out = new_stage_path(spark, "report")
    scored = _markov(_events(spark, sf_dir, _fine_sensor()))
    place = ["event_id"]
    tables.write_report(reports.point_anomalies(scored, "markov_prob", 0.01, place=place), out, place)
    return _rounded(tables.read_report(spark, out, "markov_prob"), "markov_prob")


@_query(
    "last_n_days",
    f"""WITH {_sql_events()}, {_sql_last_days(7, "raw")} SELECT event_id, dt, sensor FROM kept""",
)
def _last_n_days(spark, sf_dir):
    return days.last_days(_events(spark, sf_dir), 7)


@_query("last_days_pruned", SQL["last_n_days"])
def _last_days_pruned(spark, sf_dir):
    """The same from a dataset by day, of which only these days are opened."""
    path = new_stage_path(spark, "by_day")
    tables.write_days(_events(spark, sf_dir), path)
    return tables.read_last_days(spark, path, 7)


@_query(
    "last_bins_pruned",
    f"""WITH {_sql_events()},
    binned AS (SELECT *, epoch_us(dt) // 21600000000 AS bin FROM raw)
    SELECT event_id, dt, sensor FROM binned WHERE bin IN (SELECT DISTINCT bin FROM binned ORDER BY bin DESC LIMIT 10)""",
)
def _last_bins_pruned(spark, sf_dir):
    """The last ten bins of six hours of a dataset by day."""
    path = new_stage_path(spark, "by_day")
    tables.write_days(_events(spark, sf_dir), path)
    return tables.read_last_days(spark, path, 10, bin_seconds=6 * 3600.0)


@_query("replace_in_place", SQL["debounce"])
def _replace_in_place(spark, sf_dir):
    """A dataset that is replaced by what is computed from it."""
    path = new_stage_path(spark, "log")
    tables.write_table(_events(spark, sf_dir), path)
    tables.write_table(cleaning.debounce(tables.read_table(spark, path), ["event_id"]), path)
    return tables.read_table(spark, path)


@_query("csv_report_single", SQL["csv_report"])
def _csv_report_single(spark, sf_dir):
    """The report as one file, copied from its sorted parts."""
    out = new_stage_path(spark, "report")
    found = reports.point_anomalies(_markov(_events(spark, sf_dir, _fine_sensor())), "markov_prob", 0.01, place=["event_id"])
    tables.write_report(found, out, ["event_id"], single=True)
    return _rounded(tables.read_report(spark, f"{out}.csv", "markov_prob"), "markov_prob")


@_query(
    "day_bounds",
    f"""WITH {_sql_events()}
    SELECT CAST(dt AS DATE) AS day, min(dt) AS day_start, max(dt) AS day_end, count(*) AS n_points,
           strftime(min(dt), '%Y-%m-%d') AS title,
           CAST(row_number() OVER (ORDER BY CAST(dt AS DATE)) - 1 AS BIGINT) AS tile_no
    FROM raw GROUP BY 1""",
)
def _day_bounds(spark, sf_dir):
    return days.numbered_days(days.day_bounds(_events(spark, sf_dir)))


_SQL_BOUNDS = """bounds AS (
      SELECT CAST(dt AS DATE) AS day, min(dt) AS day_start, max(dt) AS day_end FROM kept GROUP BY 1)"""


@_query(
    "day_overlay",
    f"""WITH {_sql_events()}, {_sql_debounce()}, {_sql_markov()}, {_sql_last_days(10)}, {_SQL_BOUNDS}
    SELECT s.dt, s.sensor, round(s.markov_prob, 9) AS markov_prob, b.day, b.day_start, b.day_end
    FROM scored s JOIN bounds b ON s.dt >= b.day_start AND s.dt <= b.day_end
    WHERE s.markov_prob < {EV_THRESHOLD}""",
)
def _day_overlay(spark, sf_dir):
    scored = _staged_markov(spark, sf_dir)
    found = reports.point_anomalies(scored, "markov_prob", EV_THRESHOLD)
    bounds = days.day_bounds(days.last_days(scored, 10))
    return _rounded(days.overlay(found, bounds), "markov_prob").select(
        "dt", "sensor", "markov_prob", "day", "day_start", "day_end"
    )


@_query(
    "day_overlay_counts",
    f"""WITH {_sql_events(extra=", value")}, {_sql_last_days(10, "raw")}, {_SQL_BOUNDS}
    SELECT b.day, b.day_start, b.day_end, count(s.dt) AS n_overlaid, count(s.dt) > 0 AS has_anomalies
    FROM bounds b LEFT JOIN (SELECT dt FROM raw WHERE value < 0.05) s
      ON s.dt >= b.day_start AND s.dt <= b.day_end GROUP BY ALL""",
)
def _day_overlay_counts(spark, sf_dir):
    log = _events(spark, sf_dir, None, "value")
    bounds = days.day_bounds(days.last_days(log, 10)).select("day", "day_start", "day_end")
    return days.overlay_counts(bounds, reports.point_anomalies(log, "value", 0.05))


@_query(
    "interval_overlay",
    f"""WITH {_sql_events(extra=", user_id, value")},
    spans AS (
      SELECT event_id AS span_id, dt - to_minutes(user_id % 97) AS span_start, dt + to_hours(user_id % 61) AS span_end
      FROM raw WHERE sensor = 'purchase')
    SELECT span_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM raw JOIN spans
      ON dt BETWEEN span_start AND span_end WHERE value < 2.0 GROUP BY span_id""",
)
def _interval_overlay(spark, sf_dir):
    """Readings in spans of a minute to days around others, which no bin holds whole."""
    log = _events(spark, sf_dir, None, "user_id", "value")
    back = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("user_id") % 97).cast("int"))
    forth = F.make_dt_interval(F.lit(0), (F.col("user_id") % 61).cast("int"))
    spans = log.where("sensor = 'purchase'").select(
        F.col("event_id").alias("span_id"), (F.col("dt") - back).alias("span_start"), (F.col("dt") + forth).alias("span_end")
    )
    low = reports.point_anomalies(log, "value", 2.0, place=["event_id"])
    return intervals.readings_in_intervals(
        low, spans, start="span_start", end="span_end", per=["span_id"], count="n", sums={"ids": "event_id"}
    )


@_query(
    "daily_tiles",
    f"""WITH {_sql_events()}, {_sql_debounce()}, {_sql_markov()}, {_sql_last_days(20)}
    SELECT day, CAST(dense_rank() OVER (ORDER BY day) - 1 AS BIGINT) AS tile_no, dt,
           round(markov_prob, 9) AS value, coalesce(markov_prob < {EV_THRESHOLD}, false) AS is_anomaly,
           CAST({EV_THRESHOLD} AS DOUBLE) AS threshold,
           min(dt) OVER (PARTITION BY day) AS day_start, max(dt) OVER (PARTITION BY day) AS day_end
    FROM kept""",
)
def _daily_tiles(spark, sf_dir):
    kept = days.last_days(_staged_markov(spark, sf_dir), 20)
    return _rounded(days.daily_tiles(kept, "markov_prob", EV_THRESHOLD), "value")


_SQL_DAILY = f"""daily AS (
      SELECT day, count(*) AS n_points, count(*) FILTER (WHERE markov_prob < {EV_THRESHOLD}) AS n_anomalies
      FROM kept GROUP BY day)"""


@_query(
    "daily_anomaly_counts",
    f"""WITH {_sql_events()}, {_sql_debounce()}, {_sql_markov()}, {_sql_last_days(30)}, {_SQL_DAILY}
    SELECT day, n_points, n_anomalies, n_anomalies / CAST(n_points AS DOUBLE) AS rate FROM daily""",
)
def _daily_anomaly_counts(spark, sf_dir):
    kept = days.last_days(_staged_markov(spark, sf_dir))
    return days.daily_anomaly_counts(kept, "markov_prob", EV_THRESHOLD)


@_query(
    "tile_raster",
    f"""WITH {_sql_events(extra=", value")}, {_sql_last_days(30, "raw")}, {_sql_raster("value", 2.0)}
    SELECT day, xb, yb, n_points, n_anomalies FROM raster""",
)
def _tile_raster(spark, sf_dir):
    return days.tile_raster(days.last_days(_events(spark, sf_dir, None, "value")), "value", 2.0)


@_query(
    "day_number_deviation",
    f"""WITH {_sql_events()}, {_sql_debounce()}, {_sql_markov()}, {_sql_last_days(30)}, {_SQL_DAILY},
    {_SQL_NUMBER}
    SELECT day, n_points, n_anomalies,
           round(CASE WHEN mad > 0 THEN (n_anomalies - med) / mad END, 9) AS number_z
    FROM daily, spread""",
)
def _day_number_deviation(spark, sf_dir):
    kept = days.last_days(_staged_markov(spark, sf_dir))
    counts = days.daily_anomaly_counts(kept, "markov_prob", EV_THRESHOLD)
    return _rounded(days.number_deviation(counts).drop("rate"), "number_z")


@_query(
    "day_shape_deviation",
    f"""WITH {_sql_events(extra=", value")}, {_sql_last_days(30, "raw")}, {_sql_raster("value", 2.0)},
    {_SQL_SHAPE}
    SELECT day, round(tv, 9) AS shape_tv, rank() OVER (ORDER BY round(tv, 12) DESC) AS shape_rank
    FROM shapes""",
)
def _day_shape_deviation(spark, sf_dir):
    kept = days.last_days(_events(spark, sf_dir, None, "value"))
    raster = days.tile_raster(kept, "value", 2.0)
    return _rounded(days.shape_deviation(raster), "shape_tv")


# A forest written by hand: (tree, node, feature, threshold, path).
FIXED_FOREST = [
    (0, 0, 0, 2.0, 0.0), (0, 1, 1, 0.25, 0.0), (0, 2, -1, 0.0, 1.5),
    (0, 3, -1, 0.0, 4.0), (0, 4, -1, 0.0, 2.0),
    (1, 0, 2, -0.5, 0.0), (1, 1, -1, 0.0, 3.25), (1, 2, 0, 3.0, 0.0),
    (1, 5, -1, 0.0, 6.0), (1, 6, 1, 0.9, 0.0), (1, 13, -1, 0.0, 5.0), (1, 14, -1, 0.0, 2.5),
]
_SQL_FEATURES = """features AS (
      SELECT event_id, CAST(dense_rank() OVER (ORDER BY sensor) - 1 AS DOUBLE) AS enc,
             sin(epoch(dt) / 86400.0 * 2 * pi()) AS s, cos(epoch(dt) / 86400.0 * 2 * pi()) AS c FROM raw)"""


@_query(
    "iforest_fixed_forest",
    f"""WITH {_sql_events()}, {_SQL_FEATURES},
    paths AS (
      SELECT event_id,
             CASE WHEN enc >= 2 THEN 1.5 WHEN s < 0.25 THEN 4.0 ELSE 2.0 END
             + CASE WHEN c < -0.5 THEN 3.25 WHEN enc < 3 THEN 6.0 WHEN s < 0.9 THEN 5.0 ELSE 2.5 END AS total
      FROM features)
    SELECT event_id, round(0.5 - power(2, -(total / 2)
             / (2 * (ln(255) + 0.5772156649) - 2 * 255.0 / 256)), 9) AS iforest_score FROM paths""",
)
def _iforest_fixed_forest(spark, sf_dir):
    nodes = pd.DataFrame(FIXED_FOREST, columns=["tree", "node", "feature", "threshold", "path"])
    points = labels.with_features(_events(spark, sf_dir))
    scored = forest.with_forest_score(points, forest.Forest(nodes, 256))
    return _rounded(scored, "iforest_score").select("event_id", "iforest_score")


# The same forest as boxes: (tree, lo1, hi1, lo2, hi2, lo3, hi3, h); codes are small.
_SQL_BOXES = """boxes(tree, lo1, hi1, lo2, hi2, lo3, hi3, h) AS (VALUES
      (0, -9, 2, -9, 0.25, -9, 9, 4.0), (0, -9, 2, 0.25, 9, -9, 9, 2.0), (0, 2, 999, -9, 9, -9, 9, 1.5),
      (1, -9, 999, -9, 9, -9, -0.5, 3.25), (1, -9, 3, -9, 9, -0.5, 9, 6.0),
      (1, 3, 999, -9, 0.9, -0.5, 9, 5.0), (1, 3, 999, 0.9, 9, -0.5, 9, 2.5))"""


@_query(
    "iforest_box_scores",
    f"""WITH {_sql_events()}, {_SQL_FEATURES}, {_SQL_BOXES}
    SELECT event_id, round(0.5 - power(2, -(avg(h) / (2 * (ln(255) + 0.5772156649) - 2 * 255.0 / 256))), 9) AS iforest_score
    FROM features JOIN boxes ON enc >= lo1 AND enc < hi1 AND s >= lo2 AND s < hi2 AND c >= lo3 AND c < hi3
    GROUP BY event_id""",
)
def _iforest_box_scores(spark, sf_dir):
    """The fixed forest as steps over the time of day, without Python and without a join."""
    nodes = pd.DataFrame(FIXED_FOREST, columns=["tree", "node", "feature", "threshold", "path"])
    points = labels.with_label_code(_events(spark, sf_dir))
    scored = boxes.with_forest_score_by_time(points, forest.Forest(nodes, 256))
    return _rounded(scored, "iforest_score").select("event_id", "iforest_score")


@_query("iforest_both_scorers", f"WITH {_sql_events(_SQL_FINE)} SELECT event_id, TRUE AS agree FROM raw")
def _iforest_both_scorers(spark, sf_dir):
    """A fitted forest: whether its steps give a reading the score of its trees."""
    points = labels.with_features(_events(spark, sf_dir, _fine_sensor()), exact=True)
    model = forest.fit_forest(points, ORDER, seed=42)
    both = boxes.with_forest_score_by_time(forest.with_forest_score(points, model, "walked"), model, name="looked_up")
    return both.select("event_id", (F.round("walked", 9) == F.round("looked_up", 9)).alias("agree"))


def _forest_scored(spark, sf_dir):
    points = labels.with_features(_events(spark, sf_dir))
    return forest.with_forest_score(points, forest.fit_forest(points, ORDER, seed=42))


@_query("iforest_scores", f"WITH {_sql_events()} SELECT event_id, dt, sensor, {_SQL_IN_RANGE} FROM raw")
def _iforest_scores(spark, sf_dir):
    return _score_checked(_forest_scored(spark, sf_dir).select("event_id", "dt", "sensor", "iforest_score"))


@_query("iforest_anomalies", f"WITH {_sql_events()} SELECT event_id, dt, sensor, TRUE AS as_expected FROM raw")
def _iforest_anomalies(spark, sf_dir):
    """For each reading, whether the report has it exactly if its score is below the threshold."""
    scored = stage(_forest_scored(spark, sf_dir), "scored")
    place = ["event_id"]
    found = reports.point_anomalies(scored, "iforest_score", EV_FOREST_THRESHOLD, place=place)
    report = reports.in_time_order(found).select("event_id", F.lit(True).alias("reported"))
    below = F.col("iforest_score") < EV_FOREST_THRESHOLD
    matched = scored.join(report, "event_id", "left")
    return matched.select(
        "event_id", "dt", "sensor", (F.coalesce("reported", F.lit(False)) == below).alias("as_expected")
    )


@_query(
    "iforest_sample",
    f"""WITH {_sql_events()}
    SELECT CAST(tree AS INTEGER) AS tree, least(256, count(*)) AS n_rows, least(256, count(*)) AS n_slots
    FROM raw, range(100) AS t(tree) GROUP BY tree""",
)
def _iforest_sample(spark, sf_dir):
    points = labels.with_features(_events(spark, sf_dir))
    sample, _ = forest.draw_samples(points, ORDER, list(labels.FEATURES), 100, 256, 42)
    return sample.groupBy("tree").agg(
        F.count("*").alias("n_rows"), F.count_distinct("slot").alias("n_slots")
    )


@_query(
    "iforest_trees",
    f"""WITH {_sql_events()}
    SELECT CAST(tree AS INTEGER) AS tree, least(256, count(*)) AS points, TRUE AS leaves_fit, TRUE AS depth_fits
    FROM raw, range(100) AS t(tree) GROUP BY tree""",
)
def _iforest_trees(spark, sf_dir):
    """Per tree: the points in its leaves, one more leaf than inner nodes, and its depth."""
    points = labels.with_features(_events(spark, sf_dir))
    model = forest.fit_forest(points, ORDER, seed=42)
    nodes = spark.createDataFrame(model.nodes, forest.NODE_SCHEMA)
    leaf = F.col("feature") < 0
    return nodes.groupBy("tree").agg(
        F.sum(F.col("size").cast("bigint")).alias("points"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("leaves_fit"),
        (F.max("node") <= 2 ** (8 + 1) - 2).alias("depth_fits"),
    )


@_query(
    "score_all",
    f"""WITH raw AS (SELECT event_id, ts AS dt, {_SQL_FINE} AS sensor FROM events),
    {_SQL_DELAYS}, {_sql_debounce(target="quiet")},
    activity AS (
      SELECT event_id, dt - to_microseconds(CAST(coalesce(delay, 0) * 1000000 AS BIGINT)) AS dt, sensor,
             dt AS dt_raw
      FROM quiet LEFT JOIN delays USING (sensor) WHERE sensor NOT IN ('purchase', 'signup')),
    {_sql_markov("activity", "dt_raw")}
    SELECT event_id, dt, sensor, dt_raw, round(sin(epoch(dt) / 86400.0 * 2 * pi()), 9) AS "sinTransform",
           round(cos(epoch(dt) / 86400.0 * 2 * pi()), 9) AS "cosTransform",
           round(markov_prob, 9) AS markov_prob, {_SQL_IN_RANGE} FROM scored""",
)
def _score_all(spark, sf_dir):
    """Both scores of a cleaned log."""
    delays, appliances = metadata.read_metadata(spark, _metadata(spark))
    cleaned = jobs.clean(_events(spark, sf_dir, _fine_sensor()), delays, ["event_id"])
    scored = jobs.score(cleaning.without_sensors(cleaned, appliances), RAW_ORDER)
    return _score_checked(_rounded(scored, "sinTransform", "cosTransform", "markov_prob"))


@_query(
    "signal_days",
    f"""WITH {_sql_events()}, {_sql_debounce()}, {_sql_markov()}, {_sql_last_days(30)}, {_SQL_DAILY},
    {_SQL_NUMBER}, {_sql_raster("markov_prob", EV_THRESHOLD)}, {_SQL_SHAPE}
    SELECT day, n_points, n_anomalies, n_anomalies / CAST(n_points AS DOUBLE) AS rate,
           round(CASE WHEN mad > 0 THEN (n_anomalies - med) / mad END, 9) AS number_z,
           round(tv, 9) AS shape_tv, rank() OVER (ORDER BY round(tv, 12) DESC) AS shape_rank
    FROM daily CROSS JOIN spread LEFT JOIN shapes USING (day)""",
)
def _signal_days(spark, sf_dir):
    report = jobs.probability_signal(_staged_markov(spark, sf_dir), "markov_prob", EV_THRESHOLD)
    return _rounded(report.days, "number_z", "shape_tv")


@_query(
    "end_to_end_markov",
    f"""WITH {_sql_clean()}, activity AS (SELECT * FROM cleaned WHERE role = 'activity'),
    {_sql_markov("activity", "dt_raw")}
    SELECT dt, sensor, round(markov_prob, 9) AS markov_prob FROM scored WHERE markov_prob < 0.6""",
)
def _end_to_end_markov(spark, sf_dir):
    out = new_stage_path(spark, "run")
    settings = Settings(markov_threshold=0.6, forest_threshold=EV_FOREST_THRESHOLD)
    run = jobs.run_all(spark, _csv_log(spark, sf_dir), _metadata(spark), out, settings)
    return _rounded(run["markov_prob"].anomalies, "markov_prob")


@_query(
    "end_to_end",
    f"""WITH {_sql_clean()}, activity AS (SELECT * FROM cleaned WHERE role = 'activity'),
    {_sql_markov("activity", "dt_raw")}
    SELECT dt, sensor, count(*) AS n, count(*) FILTER (WHERE markov_prob < 0.6) AS n_unlikely,
           TRUE AS forest_as_expected FROM scored GROUP BY dt, sensor""",
)
def _end_to_end(spark, sf_dir):
    """Both written reports next to the scored readings: how many of a time and sensor
    the Markov report has, and whether the forest's has those below its threshold."""
    out = new_stage_path(spark, "run")
    settings = Settings(markov_threshold=0.6, forest_threshold=EV_FOREST_THRESHOLD)
    jobs.run_all(spark, _csv_log(spark, sf_dir), _metadata(spark), out, settings)
    one = F.lit(1).cast("bigint")
    no = F.lit(0).cast("bigint")
    scored = tables.read_table(spark, f"{out}/scored").select(
        "dt", "sensor", one.alias("n"), no.alias("m"),
        (F.col("iforest_score") < EV_FOREST_THRESHOLD).cast("bigint").alias("f"),
    )
    unlikely = tables.read_report(spark, f"{out}/markov_prob_anomalies", "markov_prob")
    isolated = tables.read_report(spark, f"{out}/iforest_score_anomalies", "iforest_score")
    found = scored.unionByName(
        unlikely.select("dt", "sensor", no.alias("n"), one.alias("m"), no.alias("f"))
    ).unionByName(isolated.select("dt", "sensor", no.alias("n"), no.alias("m"), (-one).alias("f")))
    return found.groupBy("dt", "sensor").agg(
        F.sum("n").alias("n"), F.sum("m").alias("n_unlikely"), (F.sum("f") == 0).alias("forest_as_expected")
    )


@_query(
    "quarter_day_counts",
    f"""WITH {_sql_events(extra=", value")},
    binned AS (SELECT *, make_timestamp(epoch_us(dt) // 21600000000 * 21600000000) AS bin FROM raw),
    kept AS (
      SELECT * FROM binned WHERE bin IN (SELECT DISTINCT bin FROM binned ORDER BY bin DESC LIMIT 40))
    SELECT bin AS day, count(*) AS n_points, count(*) FILTER (WHERE value < 2.0) AS n_anomalies,
           count(*) FILTER (WHERE value < 2.0) / CAST(count(*) AS DOUBLE) AS rate FROM kept GROUP BY bin""",
)
def _quarter_day_counts(spark, sf_dir):
    """Bins of six hours instead of days."""
    width = 6 * 3600.0
    kept = days.last_days(_events(spark, sf_dir, None, "value"), 40, bin_seconds=width)
    return days.daily_anomaly_counts(kept, "value", 2.0, bin_seconds=width)


# ---------------------------------------------------------------- contract


def _text_queries() -> tuple[dict, dict]:
    """Queries and SQL of the text operators, which may not be installed."""
    try:
        import corpus_pipeline
        from hearthlog.llm import queries as text
    except ModuleNotFoundError as missing:
        if missing.name in ("corpus_pipeline", "hearthlog.llm"):
            return {}, {}
        raise
    sql = dict(text.SQL)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return text.QUERIES | {"pipeline": corpus_pipeline.run}, sql


def entry(spark: SparkSession) -> DataFrame:
    """Unlikely sensor transitions of the events, in time order."""
    return _markov_anomalies(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | _text_queries()[0]


def oracle_sql() -> dict[str, str]:
    return SQL | _text_queries()[1]
