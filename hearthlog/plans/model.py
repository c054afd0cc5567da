"""A model that is fitted once, saved, and applied to later readings."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.operators.boxes import with_forest_score_by_time
from hearthlog.operators.forest import NODE_SCHEMA, Forest, fit_forest
from hearthlog.operators.labels import label_codes, with_cyclical
from hearthlog.operators.lookup import lookup
from hearthlog.operators.markov import fit_transitions, pair_counts, with_next_sensor
from hearthlog.operators.ordering import Numbered, with_neighbour
from hearthlog.settings import Settings
from hearthlog.sources import folders
from hearthlog.staging import Staged, measure, stage_measured


class Model(NamedTuple):
    """``labels``: ``sensor, code``. ``transitions``: ``sensor, next_sensor, n, p``."""

    labels: Staged
    transitions: Staged
    forest: Forest
    period_seconds: float


def _coded(log: DataFrame, labels: Staged, sensor: str) -> DataFrame:
    """Add ``sensorEnc``; labels without a code, and null, get the one after the last."""
    known = labels.table.select(F.col("sensor").alias(sensor), "code")
    code = F.coalesce("code", F.lit(labels.table.count())).cast("bigint").alias("sensorEnc")
    return lookup(log, known, [sensor], facts_bytes=labels.bytes).select(*log.columns, code)


def fit_model(log: DataFrame, order: list[str], settings: Settings = Settings(), ts: str = "dt", sensor: str = "sensor") -> Model:
    """Fit the transitions, the label codes and the forest on ``log``, as ``score`` does."""
    laid_out = with_neighbour(log, order, [sensor], "_next", number=("_position", F.col(ts).isNotNull()))
    ordered = laid_out.table.withColumn("next_sensor", F.col(f"_next.{sensor}")).drop("_next")
    pairs = stage_measured(pair_counts(ordered, sensor), "pairs")
    labels = stage_measured(label_codes(pairs.table, sensor).select(F.col(sensor).alias("sensor"), "code"), "labels")
    period = settings.period_seconds
    featured = _coded(with_cyclical(ordered, ts, period, exact=True), labels, sensor)
    forest = fit_forest(
        featured,
        order,
        trees=settings.trees,
        sample_per_tree=settings.sample_per_tree,
        seed=settings.forest_seed,
        numbered=Numbered(featured, laid_out.total),
    )
    transitions = fit_transitions(pairs, sensor)
    named = transitions.table.withColumnRenamed(sensor, "sensor")
    return Model(labels, Staged(named, transitions.bytes), forest, period)


def apply_model(
    model: Model, log: DataFrame, order: list[str], ts: str = "dt", sensor: str = "sensor", score: str = "iforest_score"
) -> DataFrame:
    """``log`` with ``next_sensor``, ``markov_prob`` and the forest's score.

    A transition that the model has not seen has probability 0 if it knows the sensor
    that it leads out of, and none if it does not. A label that it has not seen has the
    code after the last, as a reading without a sensor does. What follows a reading is
    looked for within ``log``.
    """
    ordered = with_next_sensor(log, order, sensor)
    facts = model.transitions.table.select(F.col("sensor").alias(sensor), "next_sensor", "p")
    likely = lookup(ordered, facts, [sensor, "next_sensor"], facts_bytes=model.transitions.bytes)
    # No more sensors than transitions.
    sources = model.transitions.table.select(F.col("sensor").alias(sensor)).distinct().withColumn("_known", F.lit(True))
    likely = lookup(likely, sources, [sensor], facts_bytes=model.transitions.bytes)
    unseen = F.when(F.col("_known") & F.col("next_sensor").isNotNull(), F.lit(0.0))
    likely = likely.withColumn("markov_prob", F.coalesce("p", unseen)).select(*log.columns, "next_sensor", "markov_prob")
    coded = with_cyclical(_coded(likely, model.labels, sensor), ts, model.period_seconds, exact=True)
    scored = with_forest_score_by_time(coded, model.forest, ts, period_seconds=model.period_seconds, name=score)
    return scored.select(*likely.columns, score)


def save_model(model: Model, path: str) -> None:
    """Replace what is at ``path`` by the model's tables."""
    spark = model.labels.table.sparkSession
    nodes = model.forest.nodes.assign(size=model.forest.nodes.get("size", 0))
    facts = [(model.forest.psi, list(model.forest.features), model.period_seconds)]

    def write(new: str) -> None:
        model.labels.table.write.parquet(f"{new}/labels")
        model.transitions.table.write.parquet(f"{new}/transitions")
        columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
        spark.createDataFrame(nodes[columns].astype(object).values.tolist(), NODE_SCHEMA).coalesce(1).write.parquet(f"{new}/nodes")
        spark.createDataFrame(facts, "psi int, features array<string>, period double").coalesce(1).write.parquet(f"{new}/facts")

    folders.replace(spark, path, write)


def load_model(spark: SparkSession, path: str) -> Model:
    folders.recover(spark, path)
    labels, transitions = (spark.read.parquet(f"{path}/{name}") for name in ("labels", "transitions"))
    facts = spark.read.parquet(f"{path}/facts").first()
    # No more nodes than the forest was given.
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"], ignore_index=True)
    forest = Forest(nodes, facts["psi"], tuple(facts["features"]))
    return Model(Staged(labels, measure(labels).bytes), Staged(transitions, measure(transitions).bytes), forest, facts["period"])
