"""Counts of prefixes against the tokenizer itself, prefix by prefix."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearthlog.llm import queries, token_counts
from hearthlog.llm.token_counts import Prefixes, count_tokens, longest_prefix, tokens_of_prefix

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
DATA = "/root/testdata/sf0.001"


def plain_count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def known():
    return Prefixes(PATH)


def counts(known, text):
    return [int(n) for part in known.running(text) for n in part]


TEXTS = [
    "", " ", "a", "he'll we've I'd they're it's", "x'l", "''ll", "!'ll 'll\n'll \t'd", "a   b", "a \n\n b\n\n\nc   ", "\n'tis '  't",
    "1234567 12.5%", "naïve café — ‘quoted’ … 東京 ١٢٣ 😀😀  x  y\x85z\x1c\x1d a", "a<|endoftext|>b  <|endoftext|>  c!!<|endoftext|><|endoftext|>",
    "<|endof <|endoftext|", " " * 40 + "x" + "=" * 70, "supercalifragilisticexpialidocious" * 3, "ab" * 60 + "́é", "\U00010940\U00011db1 ࢏՘a",
]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(known, text):
    assert counts(known, text) == [plain_count(text[: i + 1]) for i in range(len(text))]


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aelrstvdm' \n\t.,!1é<|>\xa0"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_every_prefix_of_random_texts(text):
    known = token_counts.prefix_counter(PATH)
    assert counts(known, text) == [plain_count(text[: i + 1]) for i in range(len(text))]


def test_long_texts_go_in_blocks(monkeypatch, known):
    text = "one two  three\n\n'll " * 50
    whole = counts(known, text)
    monkeypatch.setattr(token_counts, "LONG_TEXT", 10)
    monkeypatch.setattr(token_counts, "BLOCK", 3)
    assert counts(known, text) == whole
    long = ("word " * 40_000) + "x" * 40_000
    assert counts(known, long)[-1] == plain_count(long)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STRETCHES_KEPT", 3)
    monkeypatch.setattr(token_counts, "MOST_PAIRS_KEPT", 3)
    small = Prefixes(PATH)
    text = "many different words stand here, ninety-nine of them"
    assert counts(small, text)[-1] == plain_count(text)
    assert len(small) == 3 and len(small.pairs) <= 3


def test_columns(spark):
    texts = ["one two three four", None, "", "one two three four", "naïve  \n<|endoftext|>" * 3]
    docs = spark.createDataFrame([(i if i else None, t, 7, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, seen string")
    found = count_tokens(docs, PATH, limit=3, prefixes=True)
    rows = found.withColumns(
        {
            "second": tokens_of_prefix(F.col("prefix_tokens"), F.lit(2)),
            "all": tokens_of_prefix(F.col("prefix_tokens"), F.lit(10_000)),
            "cut": longest_prefix(F.col("prefix_tokens"), F.lit(3)),
        }
    ).collect()
    assert len(rows) == 5
    for row, text in zip(sorted(rows, key=lambda r: r["doc_id"] or 0), texts):
        text = text or ""
        every = [plain_count(text[: i + 1]) for i in range(len(text))]
        assert row["prefix_tokens"] == every
        assert row["n_bytes"] == len(text.encode()) and row["n_tokens"] == row["all"] == plain_count(text)
        assert row["over_limit"] == (plain_count(text) > 3)
        assert row["chars_in_limit"] == row["cut"] == max([i + 1 for i, n in enumerate(every) if n <= 3], default=0)
        assert row["second"] == plain_count(text[:2])
    assert count_tokens(docs.where("false")).collect() == []


def test_query(spark):
    found = {r["doc_id"]: r for r in queries.op12_token_counts(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(found) == len(docs)
    for doc in docs:
        text, row = doc["text"] or "", found[doc["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), plain_count(text))
        assert row["over_limit"] == (row["n_tokens"] > 512)
        assert plain_count(text[: row["chars_in_limit"]]) <= 512
