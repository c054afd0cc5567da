"""Parameters of the pipeline, with the defaults the results depend on."""

from dataclasses import dataclass

# Fixed values.
NOISE_LABEL = "YYY"
DEBOUNCE_SECONDS = 2.0
DAY_SECONDS = 24.0 * 60.0 * 60.0
TREES = 100
SAMPLE_PER_TREE = 256
MARKOV_THRESHOLD = 0.01
FOREST_THRESHOLD = -0.15
DAYS_KEPT = 30


@dataclass(frozen=True)
class Settings:
    time_pattern: str | None = None  # of "date time"; ISO if not given
    noise_label: str = NOISE_LABEL
    debounce_seconds: float = DEBOUNCE_SECONDS
    period_seconds: float = DAY_SECONDS
    trees: int = TREES
    sample_per_tree: int = SAMPLE_PER_TREE
    forest_seed: int = 0
    markov_threshold: float = MARKOV_THRESHOLD
    forest_threshold: float = FOREST_THRESHOLD
    days_kept: int = DAYS_KEPT
    bin_seconds: float = DAY_SECONDS  # of what a report calls a day
    multi_line: bool = False  # quoted fields may hold line breaks
    single_report: bool = False  # each report also as one CSV file
    raster_columns: int = 24
    raster_rows: int = 20
