import collections
import random

import pytest
from pyspark.sql import functions as F

from hearthlog.llm import decontamination as dc
from hearthlog.llm.common import letter_words


def brute(docs, items, window):
    windows = {}
    for item, text in items:
        words = letter_words((text or "").encode())
        for at in range(max(1, len(words) - window + 1)) if words else ():
            windows.setdefault(tuple(words[at : at + window]), set()).add(item)
    out = []
    for doc_id, text in docs:
        words, hit, found = letter_words((text or "").encode()), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(words) - size + 1):
                own = windows.get(tuple(words[at : at + size]))
                if own is not None:
                    hit.update(range(at, at + size))
                    found |= own
        names = sorted(str(f) for f in found if f is not None)
        out.append((str(doc_id), len(words), len(hit), names, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out)


def brute_near(docs, items):
    """Items by the words of every document, one word at a time."""
    split = lambda text: letter_words((text or "").encode())
    counts = collections.Counter(w for _, text in docs for w in split(text))
    out = []
    for doc_id, text in docs:
        at = collections.defaultdict(list)
        for place, word in enumerate(split(text)):
            at[word].append(place)
        found = set()
        for item, item_text in items:
            terms = list(dict.fromkeys(split(item_text)))
            rarest = sorted((t for t in terms if counts[t]), key=lambda t: counts[t])[: dc.NEAR_TERMS]
            if not terms or len(rarest) < min(dc.NEAR_TERMS, len(terms)):
                continue
            if any(all(any(abs(q - p) <= dc.SLOP for q in at[t]) for t in rarest) for p in at[rarest[0]]):
                found.add(item)
        out.append((str(doc_id), len(split(text)), sorted(str(f) for f in found if f is not None)))
    return sorted(out)


@pytest.mark.parametrize("block_words,shard_words", [(2_000_000, 1_000_000), (300, 200)])
def test_hits_are_those_of_brute_force(spark, monkeypatch, block_words, shard_words):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(dc, "SHARD_WORDS", shard_words)
    rng = random.Random(shard_words)
    new = lambda n: [rng.choice(["the", "of", "a"]) if rng.random() < 0.4 else f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(new(rng.choice([3, 12, 13, 30])))) for i in range(30)]
    items += [(31, items[3][1]), (32, None), (33, " ,. "), (None, "an item of four words"), (34, "the the the the")]
    docs = []
    for i in range(80):
        words = new(rng.randint(0, 60))
        for _ in range(rng.randrange(3)):
            source = (rng.choice(items)[1] or "").split()
            at = rng.randint(0, len(words))
            words[at:at] = source if rng.random() < 0.6 else source[: len(source) // 2]
        docs.append((i, ", ".join(words).title()))
    docs += [(100, None), (101, ""), (None, items[0][1]), (7, docs[7][1]), (7, docs[7][1]), (102, "x " * 30000 + items[4][1])]
    table = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, text string, shard int, term string").repartition(3)
    tests = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, item int")
    found = dc.contamination(dc.benchmark_matches(table, tests)).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], sorted(r["items"]), r["contaminated"]) for r in found)
    assert got == brute(docs, items, dc.WINDOW)
    near = sorted((str(r["doc_id"]), r["n_words"], sorted(r["near_items"])) for r in found)
    assert near == brute_near(docs, items) and any(n for *_, n in near)
    assert all(r["n_near"] == len(r["near_items"]) for r in found)


@pytest.mark.parametrize("partitions", [1, 2])
def test_no_match_reaches_from_one_document_to_the_next(spark, partitions):
    text = "zebra quartz violin hammer ocean pepper candle orbit"
    halves = [(1, text[:20]), (2, text[20:]), (3, "none")]
    table = spark.createDataFrame(halves, "doc_id long, text string").repartition(partitions)
    tests = spark.createDataFrame([(9, text)], "item_id long, text string")
    assert dc.benchmark_matches(table, tests).where("size(near_items) > 0").count() == 0


def test_blocks_are_bounded_and_copies_of_items_count_once(spark, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", 500)
    tests = spark.range(2000).selectExpr("cast(id as string) item", "encode(repeat('ab ', 10), 'utf-8') text")
    tests = tests.withColumn("size", F.octet_length("text").cast("long"))
    blocks = dc.blocks_of(tests)
    assert blocks[0][0] == 0 and all(b[0] == a[1] + 1 for a, b in zip(blocks, blocks[1:])) and blocks[-1][1] == blocks[-1][2] - 1
    for first, last, n in blocks:
        assert tests.where(dc._bucket(n).between(first, last)).agg(F.sum("size")).first()[0] <= 1000
    same = spark.range(5000).selectExpr("1 as item_id", "'one and the same item' as text")
    docs = spark.createDataFrame([(1, "one and the same item")], "doc_id long, text string")
    row = dc.contamination(dc.benchmark_matches(docs, same)).first()
    assert (row["n_items"], row["n_near"], row["n_hit"], len(row["spans"])) == (1, 1, 5, 1)


def test_near_items_survive_small_edits(spark):
    text = "zebra quartz violin hammer ocean pepper candle orbit meadow lantern copper thunder walnut"
    table = spark.createDataFrame([(1, text.replace("ocean", "wide ocean")), (2, "nothing here")], "doc_id long, text string")
    tests = spark.createDataFrame([(9, text)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in dc.benchmark_matches(table, tests).collect()}
    assert rows[1]["items"] == [] and rows[1]["near_items"] == ["9"] and rows[2]["near_items"] == []
    assert dc.benchmark_matches(table, tests.where("false")).where("size(items) > 0").count() == 0
    assert dc.benchmark_matches(table.where("false"), tests).count() == 0
