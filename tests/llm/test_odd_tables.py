"""Empty tables, tables of nulls and of copies, and ids that are not numbers."""

import numpy as np
import pytest
import xxhash

from hearthlog.llm import (
    decontamination,
    fill_in_middle,
    fingerprints,
    licenses,
    lines,
    packing,
    personal_data,
    simhash,
    substrings,
    token_counts,
)
from hearthlog.operators import lookup


def bytes_as_ids():
    def make():
        import numpy

        return lambda text: numpy.frombuffer(text, "u1").astype("<u4").tobytes()

    return make


OPERATORS = {
    "packing": lambda docs, items: packing.pack(docs, bytes_as_ids(), width=8),
    "fingerprints": lambda docs, items: fingerprints.fingerprint_documents(docs),
    "simhash": lambda docs, items: simhash.link_documents(docs),
    "near": lambda docs, items: simhash.drop_near_duplicates(docs),
    "tokens": lambda docs, items: token_counts.count_tokens(docs),
    "middle": lambda docs, items: fill_in_middle.fill_in_middle(docs),
    "licenses": lambda docs, items: licenses.scan_licenses(docs),
    "decontamination": lambda docs, items: decontamination.benchmark_matches(docs, items),
    "substrings": lambda docs, items: substrings.drop_repeated_strings(docs),
    "lines": lambda docs, items: lines.drop_repeated_lines(docs),
    "personal": lambda docs, items: personal_data.find_personal_data(docs),
}
SCHEMA = "doc_id {id}, text string, ids binary, chunk int, place string, run boolean, block int, spans int, n_chars long"


@pytest.mark.parametrize("limit", [lookup.BROADCAST_LIMIT_BYTES, 0])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_tables(spark, monkeypatch, name, limit):
    monkeypatch.setattr(lookup, "BROADCAST_LIMIT_BYTES", limit)
    apply = OPERATORS[name]
    items = spark.createDataFrame([(1, "one item")], "item_id long, text string")
    filler = (b"", 1, None, True, 2, 3, 4)
    docs = spark.createDataFrame([(None, None, *filler)] * 3 + [("b", "same", *filler)] * 2, SCHEMA.format(id="string"))
    assert apply(docs.where("false"), items.where("false")).collect() == []
    rows = apply(docs, items).collect()
    if name == "packing":  # pieces may be cut
        assert sum(r["length"] for r in rows) == 3 * 1 + 2 * 5
    else:
        assert len(rows) == (2 if name == "near" else 5)
    assert {r["doc_id"] for r in rows} == {None, "b"}


def test_linked_documents(spark):
    rows = [(5, "a b c d"), (3, "a b c d"), (None, "a b c d"), (9, None), (8, ""), (7, " \n"), (2, "x " * 30000), (1, "one")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, fp int")
    found = {(r["doc_id"]): r for r in simhash.link_documents(docs.repartition(3)).collect()}
    assert {d: found[d]["component_id"] for d in found} == {5: 3, 3: 3, None: 3, 9: 7, 8: 7, 7: 7, 2: 2, 1: 1}
    assert found[7]["fp"] == 0
    assert np.int64(found[1]["fp"]) == np.uint64(xxhash.xxh64_intdigest("one", 42)).view(np.int64)
    alone = simhash.link_documents(docs.where("doc_id is null")).first()
    assert alone["component_id"] is None
