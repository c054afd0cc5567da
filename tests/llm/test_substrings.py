import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthlog.llm import substrings
from hearthlog.llm.suffixes import common_prefixes, suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_is_sorted(symbols):
    order = suffix_array(symbols)
    assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    shared = common_prefixes(symbols, order)
    for at in range(1, len(order)):
        a, b = symbols[order[at - 1] :], symbols[order[at] :]
        assert shared[at] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("symbols", [[7] * 500, [1, 2] * 300, list(range(400)), list(range(400, 0, -1))])
def test_suffix_array_of_regular_texts(symbols):
    assert suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def corpus(rng):
    letters = "abcdeé "
    new = lambda n: "".join(rng.choices(letters, k=n))
    passages = [new(rng.randint(60, 400)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(new(rng.randint(0, 120)))
            passage = rng.choice(passages)
            start = rng.randint(0, len(passage) // 2)
            parts.append(passage[start : rng.randint(start, len(passage))] if rng.random() < 0.6 else passage)
        texts.append("".join(parts))
    texts += ["", None, "a" * 1500, "ab" * 700, "x" * 199, "y" * 200, texts[3], texts[3], "ab" * 90, new(30000)]
    return texts


@pytest.mark.parametrize("block", [4000, 3])
def test_removed_bytes_are_those_of_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK", block)
    texts = corpus(random.Random(block))
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int, anchor string").repartition(6)
    found = {r["doc_id"]: r for r in substrings.drop_repeated_strings(docs).collect()}
    expected = brute([(t or "").encode() for t in texts], 200)
    for i, e in enumerate(expected):
        r = found[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == e, i


def contexts_of_one_anchor(spark, n):
    """Contexts that all have the anchor, and many of them its surroundings too."""
    rng, anchor, rows = random.Random(n), bytes(range(200, 200 + substrings.K)), []
    stock = [bytes(rng.choices(b"ab", k=170)) for _ in range(4)]
    for number in range(n):
        left, right = rng.choice(stock), rng.choice(stock)
        put = lambda b: bytes([*b[: (at := rng.randrange(len(b)))], 99, *b[at + 1 :]])
        left, right = (put(left), put(right)) if number % 5 else (left, right)
        first = rng.randint(2, 168)  # farthest distance
        left, right = left[-first:], right[: rng.randint(168 - first, 168)]
        value = left + anchor + right
        rows.append((7, number, value, len(left), min(len(value) - substrings.LENGTH, len(left))))
    return [r for r in rows if r[4] >= 0]


@pytest.mark.parametrize("block", [4000, 60, 3])
def test_one_anchor_of_many_contexts(spark, monkeypatch, block):
    """Whether compared at once, by pieces or by strings, the same starts are repeated, and
    a context makes as many rows as there are pieces at most."""
    monkeypatch.setattr(substrings, "BLOCK", block)
    rows = contexts_of_one_anchor(spark, 400)
    contexts = spark.createDataFrame(rows, "anchor long, context long, bytes binary, at int, last int").repartition(5)
    large = substrings.stage_measured(
        contexts.groupBy("anchor").count().where(f"count > {block}").select("anchor"), "large"
    )
    assert bool(large.bytes) == (block < 400)
    got = {
        (r["context"], far)
        for r in substrings._compared(contexts, large, substrings.LENGTH).collect()
        for far in range(r["near"], r["far"] + 1)
    }
    seen = Counter()
    strings = {}
    for _, context, value, at, last in rows:
        for start in range(last + 1):
            strings[context, at - start] = at - start, value[start : start + substrings.LENGTH]
    seen = Counter(strings.values())
    assert got == {k for k, v in strings.items() if seen[v] > 1} and got
    assert substrings._pieces(contexts, substrings.LENGTH).count() <= substrings.PIECES * len(rows)


def test_anchors_of_texts_longer_than_a_stretch(monkeypatch):
    monkeypatch.setattr(substrings, "PLACE_BITS", 9)
    rng = random.Random(8)
    text = b"".join(rng.choice([b" " * 300, bytes(rng.choices(b"abc", k=90)) * 3, bytes(rng.choices(range(256), k=120))]) for _ in range(40))
    hashes = substrings._gram_hashes(text).tolist()
    grams, got = substrings.LENGTH - substrings.K + 1, {}
    for place, _, first, last in zip(*(c.tolist() for c in substrings.anchors(text))):
        got |= dict.fromkeys(range(first, last + 1), place)
    for start in range(len(text) - substrings.LENGTH + 1):
        assert got[start] == min(range(start, start + grams), key=lambda p: (hashes[p] >> 9, -p))
