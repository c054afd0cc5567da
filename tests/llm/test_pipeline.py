import importlib.util
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
pipeline = importlib.util.module_from_spec(spec)
spec.loader.exec_module(pipeline)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after every stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {"documents": docs}
    for name, apply in pipeline.STAGES:
        apply(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        kept[name] = docs = spark.read.parquet(f"{folder}/{name}")
    return kept


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    for name in names[:-1]:
        assert stages[name].schema == stages["documents"].schema


def test_stages_drop_what_they_should(spark, stages):
    count = {name: df.count() for name, df in stages.items()}
    assert count["documents"] >= count["quality"] == count["line_dedup"] >= count["near_dedup"] >= count["decontamination"] > 0
    texts = [r["text"] for r in stages["near_dedup"].collect()]
    assert len(set(texts)) == len(texts)
    packed = {r["doc_id"] for r in stages["packing"].select("doc_id").distinct().collect()}
    assert packed == {r["doc_id"] for r in stages["decontamination"].collect()}


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    columns = ["doc_id", "start", "length", "doc_tokens"]
    found = pipeline.run(spark, DATA)
    assert found.columns == stages["packing"].columns
    totals = lambda df: sorted(map(tuple, df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()))
    assert totals(found.select(columns)) == totals(stages["packing"].select(columns))


def test_empty_and_odd_tables(spark, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    odd = spark.createDataFrame(
        [(1, None, None, "a", 1), (1, None, None, "a", 1), (None, "some text", "en", "b", 2), (2, "", "en", None, None), (3, "word " * 60000, "xx", "b", 3)],
        "doc_id long, text string, lang string, rank string, n_chars long",
    )
    for docs, n in ((odd.where("false"), 0), (odd, 3)):
        for _, apply in pipeline.STAGES[:-1]:
            docs = apply(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns
        assert docs.count() == n
        packed = pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == n
