import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hearthlog.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def letter_encoder():
    """One id per byte."""

    def make():
        import numpy

        return lambda text: numpy.frombuffer(text, "u1").astype("<u4").tobytes()

    return make


letters = letter_encoder()


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plan_places_every_id_once_and_fills_the_sequences(counts):
    parts, used = defaultdict(list), defaultdict(list)
    for p in packing.plan_packs(counts, 64):
        for rank in range(p.first, p.last):
            parts[p.length, rank].append((p.cut_start, p.cut_length))
            used[p.sequence + rank - p.first].append((p.offset, p.cut_length))
    assert set(parts) == {(length, r) for length, n in counts.items() for r in range(n)}
    for (length, _), cuts in parts.items():
        at = 0
        for start, size in sorted(cuts):
            assert start == at and size > 0
            at += size
        assert at == length
    rest = []
    for slots in used.values():
        at = 0
        for offset, size in sorted(slots):
            assert offset == at
            at += size
        if at != 64:
            rest.append(at)
    assert sorted(used) == list(range(len(used)))
    assert sum(rest) < 64 and len(set(rest)) == len(rest)
    assert all(size & (size - 1) == 0 for size in rest)


def test_longest_first_into_the_shortest_pack():
    found = Counter()
    for n, lengths in packing.pack_histogram({7: 1, 6: 1, 3: 1}, 10):
        found[tuple(lengths)] += n
    assert found == {(6, 3): 1, (7,): 1}


@pytest.mark.parametrize(
    "text",
    ["", " ", "Hello, world.", "it's we're DON'T", "a1b2 3.14!!", "É. ñandú, über?", "x y z", "éa",
     "<|endoftext|> a", "ΑΣ. Σ", "İstanbul ǅ.", "a\x1cb", "...,,", "naïve’s", "日本語 text.", "a.b,c!"],
)
def test_ids_equal_those_of_the_whole_text(text):
    whole = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.word_ids(PATH)(text.encode()), "<u4").tolist() == whole


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_those_of_any_text(text):
    whole = packing.kept_by_worker("test_tokenizer", lambda: Tokenizer.from_file(PATH))
    expected = whole.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.word_ids(PATH)(text.encode()), "<u4").tolist() == expected


def test_pieces_of_documents(spark):
    rows = [(i, "abcdefghij" * (i % 7) + "x" * (i % 3)) for i in range(300)] + [(None, None), (5, "again"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = packing.pack(docs, letters, width=16).collect()
    sequences, totals = defaultdict(list), Counter()
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        totals[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == 4 * r["length"]
    for slots in sequences.values():
        assert sum(size for _, size in slots) <= 16
        at = 0
        for offset, size in sorted(slots):
            assert offset == at
            at += size
    expected = Counter()
    for doc_id, text in rows:
        expected[doc_id] += len(text or "") + 1
    assert totals == expected
    one = sorted((r["start"], bytes(r["ids"])) for r in found if r["doc_id"] == 6)
    ids = letters()(rows[6][1].encode()) + np.array([1], "<u4").tobytes()
    assert zlib.crc32(b"".join(part for _, part in one)) == zlib.crc32(ids)
