"""Rearranged texts against slices of lists of lines."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthlog.llm import queries
from hearthlog.llm.fill_in_middle import boundaries, boundary_index, fill_in_middle, fit_pieces, offset_at, predicted, restored

DATA = "/root/testdata/sf0.001"


def expected(key, text, fim=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(part) for part in (lines[:a], lines[a:b], lines[b:]))
    if h4 % 100 < spm:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=80), st.booleans(), st.integers(0, 20))
def test_pieces_are_within_the_error(sizes, ended, error):
    text = "\n".join("x" * s for s in sizes) + "\n" * ended
    ends = boundaries(text)
    assert ends.tolist() == [0, *np.cumsum([len(line) for line in re.findall(r"[^\n]*\n|[^\n]+", text)]).tolist()]
    pieces = fit_pieces(ends, error)
    off = np.abs(ends - predicted(np.arange(len(ends)), *pieces))
    assert off.max() <= error + 1


def test_even_lines_are_one_piece():
    assert len(fit_pieces(boundaries("ten chars\n" * 100_000))[0]) == 1


def test_offsets_from_the_index(spark):
    texts = ["a\nbb\n\nccc", "", None, "\n\n\n", "é😀\n" * 40 + "x" * 3000 + "\n" + "y\n" * 200, "no end"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = table.withColumn("index", boundary_index(F.col("text"), 5))
    found = found.withColumn("rank", F.explode(F.sequence(F.lit(0), F.col("index.n"))))
    rows = found.select("id", "rank", offset_at(F.col("index"), F.col("rank")).alias("offset")).collect()
    by_text = {}
    for row in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        by_text.setdefault(row["id"], []).append(row["offset"])
    assert by_text == {i: boundaries(t or "").tolist() for i, t in enumerate(texts)}


@pytest.mark.parametrize("fim, spm", [(100, 50), (40, 50), (100, 0), (0, 0)])
def test_against_lists_of_lines(spark, fim, spm):
    odd = ["", None, "\n", "one line", "a\nb", "a\n\n\nb\n", "has <P> in it\nx", "<S>", "x<M>\n", "<\nP>\n<S\n", "é\n😀\nü", "\r\n\r\n", "z\n" * 5000, "w" * 70_000]
    rows = [(i, odd[i % len(odd)], "clash", "clash") for i in range(60)] + [(None, "a\nb\nc\n", "", "")] + [(3, "one line", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output string")
    found = fill_in_middle(docs, fim_percent=fim, spm_percent=spm, error=3).withColumn("back", restored(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"] or -1, r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in found.collect()), key=repr)
    assert got == sorted(((k or -1, *expected(k, t, fim, spm)) for k, t, *_ in rows), key=repr)
    assert all(r["back"] == (expected(r["doc_id"], None)[4] if r["n"] == 0 else r["back"]) for r in found.collect())
    whole = {(r["doc_id"] or -1, r["back"]) for r in found.collect()}
    assert whole == {(k or -1, t or "") for k, t, *_ in rows}


def test_query_and_plan(spark):
    found = queries.op13_fill_in_middle(spark, DATA)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    rows = {r["doc_id"]: r for r in found.collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        n, form, prefix, middle, output = expected(doc["doc_id"], doc["text"])
        row = rows[doc["doc_id"]]
        assert (row["n"], row["form"], row["prefix_chars"], row["middle_chars"]) == (n, form, prefix, middle)
        assert row["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert row["restored_sha256"] == hashlib.sha256((doc["text"] or "").encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    assert fill_in_middle(docs).collect() == []
