"""The whole jobs: clean, score, report, compare days."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.operators.boxes import with_forest_score_by_time
from hearthlog.operators.cleaning import debounce, drop_noise, shift_delays, with_role
from hearthlog.operators.days import (
    anomaly_counts,
    daily_signals,
    daily_tiles,
    last_days,
    number_deviation,
    ranges,
    shape_deviation,
    tile_rasters,
)
from hearthlog.operators.forest import fit_forest
from hearthlog.operators.labels import with_cyclical, with_features
from hearthlog.operators.markov import fit_transitions, pair_counts, with_transition_prob
from hearthlog.operators.ordering import Numbered, with_neighbour
from hearthlog.operators.reports import point_anomalies
from hearthlog.settings import Settings
from hearthlog.sources.metadata import read_metadata
from hearthlog.sources.readings import INPUT_ORDER, read_raw, with_event_time
from hearthlog.sources.tables import (
    read_days,
    read_last_days,
    read_role,
    read_table,
    write_by_role,
    write_days,
    write_report,
    write_table,
)
from hearthlog.staging import stage, stage_measured, stage_scope

MARKOV, FOREST = "markov_prob", "iforest_score"

# Pre-shift time decides the order, then the sensor, then the place in the input.
LOG_ORDER = ["dt_raw", "sensor", *INPUT_ORDER]


def clean(raw: DataFrame, delays: DataFrame, tie: list[str], settings: Settings = Settings()) -> DataFrame:
    """Noise removal, debouncing and delay correction of a log with ``dt`` and ``sensor``."""
    heard = drop_noise(raw, noise=settings.noise_label)
    return shift_delays(debounce(heard, tie, settings.debounce_seconds), delays)


def prepare_data(
    spark: SparkSession, csv: str, metadata: str, out: str, settings: Settings = Settings()
) -> None:
    """Clean a CSV log into a dataset with the roles ``activity`` and ``appliance``.

    The text is parsed once, into a stage that debouncing reads with filters that
    reach it.
    """
    with stage_scope(spark):
        delays, appliances = read_metadata(spark, metadata)
        text = read_raw(spark, csv, settings.multi_line)
        timed = stage(with_event_time(text, pattern=settings.time_pattern).drop("date", "time"), "parsed")
        cleaned = clean(timed, delays, INPUT_ORDER, settings)
        write_by_role(with_role(cleaned, appliances), out)


def score(log: DataFrame, order: list[str] = LOG_ORDER, settings: Settings = Settings()) -> DataFrame:
    """Add features and both scores.

    Each score is computed in the lineage of its reading, so none has to be joined
    back. The log is laid out in order once; both fits and the scoring read that.
    """
    # The staged layout is read three times: for the pairs, the samples and the scores.
    laid_out = with_neighbour(log, order, ["sensor"], "_next", number=("_position", F.col("dt").isNotNull()))
    ordered = laid_out.table.withColumn("next_sensor", F.col("_next.sensor")).drop("_next")
    pairs = stage_measured(pair_counts(ordered), "pairs")
    period = settings.period_seconds
    # The forest sees equal times of day as equal, and can be scored by the time.
    featured = with_features(ordered, period_seconds=period, labels=pairs.table, exact=True)
    forest = fit_forest(
        featured,
        order,
        trees=settings.trees,
        sample_per_tree=settings.sample_per_tree,
        seed=settings.forest_seed,
        numbered=Numbered(featured, laid_out.total),
    )
    likely = with_transition_prob(featured, fit_transitions(pairs))
    scored = with_forest_score_by_time(likely, forest, period_seconds=period)
    return with_cyclical(scored, period_seconds=period).select(
        *log.columns, "sinTransform", "cosTransform", MARKOV, FOREST
    )


def _thresholds(settings: Settings) -> dict[str, float]:
    return {MARKOV: settings.markov_threshold, FOREST: settings.forest_threshold}


def get_scores(spark: SparkSession, cleaned: str, out: str, settings: Settings = Settings()) -> None:
    """Score the activity readings of ``cleaned`` into a new dataset, by day."""
    if cleaned.rstrip("/") == out.rstrip("/"):
        raise ValueError("the scored dataset needs a path of its own")
    with stage_scope(spark):
        scored = score(read_role(spark, cleaned, "activity"), settings=settings)
        write_days(scored, out, thresholds=_thresholds(settings))


@dataclass(frozen=True)
class SignalReport:
    """The report of one signal: the anomalies of all history and the kept days."""

    anomalies: DataFrame
    tiles: DataFrame
    raster: DataFrame
    days: DataFrame


def probability_signals(
    scored: DataFrame,
    thresholds: dict[str, float],
    out: str | None = None,
    settings: Settings = Settings(),
    kept: DataFrame | None = None,
) -> dict[str, SignalReport]:
    """Report several signals, reading the kept days twice for all of them.

    ``kept`` has the readings of the last days, if they need not be looked for.

    With ``out``, each report's anomalies, raster and days are written below that
    folder and read from there.
    """
    if kept is None:
        kept = last_days(scored, settings.days_kept, bin_seconds=settings.bin_seconds)
    daily = stage(daily_signals(kept, thresholds, bin_seconds=settings.bin_seconds), "daily")
    rasters = stage(
        tile_rasters(
            kept, thresholds, ranges(daily, list(thresholds)), settings.raster_columns, settings.raster_rows,
            bin_seconds=settings.bin_seconds,
        ),
        "rasters",
    )
    reports = {}
    for signal, threshold in thresholds.items():
        raster = rasters.where(F.col("signal") == signal).drop("signal")
        counts = number_deviation(anomaly_counts(daily, signal))
        days = counts.join(shape_deviation(raster), "day", "left")
        if out:
            place = [c for c in INPUT_ORDER if c in scored.columns]
            write_report(point_anomalies(scored, signal, threshold, place=place), f"{out}/{signal}_anomalies", place, settings.single_report)
            raster = _written(raster, f"{out}/{signal}_raster")
            days = _written(days, f"{out}/{signal}_days")
        reports[signal] = SignalReport(
            point_anomalies(scored, signal, threshold),
            daily_tiles(kept, signal, threshold, bin_seconds=settings.bin_seconds),
            raster,
            days,
        )
    return reports


def _written(df: DataFrame, path: str) -> DataFrame:
    write_table(df, path)
    return read_table(df.sparkSession, path)


def probability_signal(
    scored: DataFrame, signal: str, threshold: float, out: str | None = None, settings: Settings = Settings()
) -> SignalReport:
    """Report one signal."""
    return probability_signals(scored, {signal: threshold}, out, settings)[signal]


def run_all(
    spark: SparkSession, csv: str, metadata: str, out: str, settings: Settings = Settings()
) -> dict[str, SignalReport]:
    """Clean, score and report both signals below the folder ``out``; nothing else stays."""
    prepare_data(spark, csv, metadata, f"{out}/cleaned", settings)
    get_scores(spark, f"{out}/cleaned", f"{out}/scored", settings)
    scored = read_days(spark, f"{out}/scored")
    kept = read_last_days(spark, f"{out}/scored", settings.days_kept, bin_seconds=settings.bin_seconds)
    with stage_scope(spark):
        return probability_signals(scored, _thresholds(settings), out, settings, kept)
