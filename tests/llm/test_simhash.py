import random

import numpy as np
import pytest
import xxhash

from hearthlog.llm import simhash
from hearthlog.llm.components import connected


def naive_components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(200 - i, 201 - i) for i in range(40)]
    links += [(500, 500 + i) for i in range(1, 80)] + [(900, 900), (55, 579)]
    edges = spark.createDataFrame(links, "a long, b long")
    found = {r["node"]: r["root"] for r in connected(edges).table.collect()}
    expected = naive_components(links, {n for link in links for n in link})
    assert found == {n: r for n, r in expected.items() if n != r}
    assert connected(edges.where("false")).table.count() == 0


def test_fingerprint_is_the_majority_of_shingle_hashes():
    text = "One two\tthree  four\nfive one two three"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.simhash(simhash.shingle_hashes(text.encode(), 3)) == expected
    assert simhash.simhash(simhash.shingle_hashes(b"A b", 3)) == xxhash.xxh64_intdigest("a b", 42)
    assert simhash.simhash(simhash.shingle_hashes(b" \n", 3)) == 0
    assert simhash.shingle_hashes("É ü".encode(), 3)[0] == xxhash.xxh64_intdigest("É ü", 42)


def flipped(rng, value, bits):
    for bit in rng.sample(range(64), bits):
        value ^= 1 << bit
    return value


@pytest.mark.parametrize("allowed,skewed,small", [(3, False, 48), (3, True, 48), (6, False, 2), (10, True, 48)])
def test_links_are_those_of_brute_force(spark, monkeypatch, allowed, skewed, small):
    monkeypatch.setattr(simhash, "SMALL_BUCKET", small)
    monkeypatch.setattr(simhash, "BLOCK", 150)  # large buckets are split
    rng = random.Random(allowed)
    mask = 0x0000FFFF00FF00FF if skewed else 2**64 - 1  # many bits are never set
    prints = {rng.getrandbits(64) & mask for _ in range(600)} | {0}
    for _ in range(60):
        center = rng.choice(sorted(prints))
        prints |= {flipped(rng, center, rng.randint(1, allowed + 2)) for _ in range(8)}
    values = np.array(sorted(prints), dtype=np.uint64)
    links = [(int(a), int(b)) for i, a in enumerate(values) for b in values[i + 1 :][np.bitwise_count(values[i + 1 :] ^ a) <= allowed]]
    table = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(7)
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.close_fingerprints(table, allowed).collect()]
    nodes = set(map(int, values))
    assert naive_components(found, nodes) == naive_components(links, nodes)


def test_plan_keeps_the_pigeonhole_sum():
    rng = np.random.default_rng(1)
    bits = (rng.random((5000, 64)) < np.linspace(0.02, 0.98, 64)).astype(float)
    for n in (1000, 10**6, 10**9):
        for allowed in (3, 10):
            parts = simhash.plan_parts(n, bits.T @ bits * (n / 5000), allowed)
            assert sum(p.reach for p in parts) == allowed - len(parts) + 1
            assert sorted(b for p in parts for b in p.bits) == list(range(64))


def naive_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def documents(rng):
    """Groups of copies with few changes, texts without words, rows that repeat."""
    rows = []
    for g in range(25):
        base = [rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(rng.choice([40, 300, 900]))]
        for _ in range(g % 6 + 1):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows) + 10, rng.choice([" ", "\n"]).join(copy)))
    rows += [(i, None if i % 2 else " ") for i in range(4, 9)]
    return rows + [(10, rows[0][1])] * 3 + [(None, "no id at all stands here")] * 2 + [(None, None), (None, rows[3][1])]


@pytest.mark.parametrize("allowed", [0, 3])
def test_one_document_of_each_group_stays(spark, allowed):
    rows = documents(random.Random(4))
    values = [naive_fingerprint(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= allowed]
    group = naive_components(links, range(len(rows)))
    expected = {}
    for at, (key, _) in enumerate(rows):
        held = expected.get(group[at])
        if key is not None and (held is None or key < held):
            expected[group[at]] = key
        expected.setdefault(group[at], None)
    assert len(expected) < len(rows) - 20
    docs = spark.createDataFrame([(*r, f"s{i}", i) for i, r in enumerate(rows)], "doc_id long, text string, row_id string, mark int")
    found = simhash.drop_near_duplicates(docs.repartition(4), allowed)
    assert found.columns == docs.columns
    none_last = lambda keys: sorted(keys, key=lambda k: (k is None, k or 0))
    assert none_last(r["doc_id"] for r in found.collect()) == none_last(expected.values())
    linked = simhash.link_documents(docs, allowed).collect()
    named = lambda pairs: sorted((k or -1, c or -1) for k, c in pairs)
    assert named((r["doc_id"], r["component_id"]) for r in linked) == named((k, expected[group[at]]) for at, (k, _) in enumerate(rows))


def test_no_plan_raises(spark, monkeypatch):
    monkeypatch.setattr(simhash, "plan_parts", lambda *_: [])
    with pytest.raises(ValueError, match="no plan"):
        simhash.close_fingerprints(spark.range(3).withColumnRenamed("id", "fp"))
