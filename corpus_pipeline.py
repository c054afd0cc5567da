"""From raw documents to packed training sequences.

The stages in order: choose documents by quality, drop repeated passages of lines, keep
one document of each group of near-duplicates, drop what a benchmark has leaked into,
and pack the rest. ``run`` writes what each stage keeps as a table in the shared folder
and reads it again, so that a lost executor repeats a part of one stage only.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.llm import decontamination, lines, packing, quality, simhash
from hearthlog.llm.common import fresh_names, id_text, text_hash
from hearthlog.llm.queries import word_encoder
from hearthlog.operators.lookup import lookup
from hearthlog.staging import stage, stage_measured

# Most stages look at other documents, and none of them in a way that SQL can follow.
ORACLE_SQL = None


def choose_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that likely have the best grade, by the ratings in ``labels``.

    The model is fitted on the rated documents among ``docs``; without any it keeps all.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.select_quality(docs, ratings)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of lines that stand elsewhere before; no row is dropped."""
    return lines.drop_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash: 3-word shingles, at most 3 bits."""
    return simhash.drop_near_duplicates(docs, simhash.LINK_BITS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty stands in a benchmark window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(decontamination.benchmark_matches(docs, benchmark))
    row_id, row_mark = fresh_names(docs, "row_id", "row_mark")
    leaked = stage_measured(
        found.where("contaminated").select(id_text(F.col("doc_id")).alias(row_id), F.col("text_hash").alias(row_mark)).distinct(),
        "contaminated",
    )
    marked = docs.withColumns({row_id: id_text(F.col("doc_id")), row_mark: text_hash(F.col("text"))})
    return lookup(marked, leaked.table, [row_id, row_mark], "left_anti", facts_bytes=leaked.bytes).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence of 2048 tokens."""
    return packing.pack(docs, word_encoder())


STAGES = [
    ("quality", choose_by_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Any stage may get an empty table and null ids and
    texts, and keeps columns that it does not know."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
