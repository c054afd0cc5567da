"""Benchmark passages in training documents, found with a positional inverted index.

The training documents are cut into shards of bounded size, and each shard's token
postings (term, positions) are stored, for the terms that the benchmark uses. The
postings' lengths say how frequent each term is in the whole corpus. A test window is
looked up from its rarest term on: the lists of its terms, moved back by their offset
in the window, are intersected until nothing is left. What remains are the exact
places of the window. Proximity matches intersect the lists of an item's rarest terms
with some slack instead.
"""

import sys
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import letter_words, over_batches, text_bytes, text_hash
from hearthlog.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
SLOP = 26  # words from the rarest term of a proximity match to any other of its terms
NEAR_TERMS = 4  # of an item's rarest terms, all must be near the rarest one
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 2_000_000  # of the benchmark; more are matched in several blocks
BUCKETS = 16  # a block is put together from such parts

INDEX = (
    "shard long, term int, n int, positions binary, doc_id array<{key}>, text_hash array<long>,"
    " n_words array<int>"
)
FOUND = (
    "doc_id {key}, text_hash long, n_words long, spans array<struct<first: int, last: int>>,"
    " items array<string>, near_items array<string>"
)


class TestSet(NamedTuple):
    """A block of the benchmark. ``windows`` maps the terms of a window to its items."""

    terms: dict[bytes, int]
    windows: dict[tuple[int, ...], list[int]]
    items: list[str]
    item_terms: list[tuple[int, ...]]


class Search(NamedTuple):
    """What a shard is searched for, by the term that it must have: the rarest one."""

    windows: dict[int, list[tuple[tuple[int, ...], tuple[int, ...], list[int]]]]  # terms, order, items
    near: dict[int, list[tuple[tuple[int, ...], int]]]  # rarest terms, item
    items: list[str]


def make_search(tests: TestSet, rarity: np.ndarray) -> Search:
    """Windows and proximity terms from their rarest term on; equally rare ones go by place.

    A term that no document has ends a window. Proximity leaves such terms out: it asks for
    the ``NEAR_TERMS`` rarest of those that occur, all terms of an item with fewer, and
    for nothing if too few of them occur.
    """
    windows, near = defaultdict(list), defaultdict(list)
    counts = rarity.tolist()
    for terms, owners in tests.windows.items():
        order = tuple(sorted(range(len(terms)), key=lambda at: counts[terms[at]]))
        if counts[terms[order[0]]]:
            windows[terms[order[0]]].append((terms, order, owners))
    for item, terms in enumerate(tests.item_terms):
        rarest = tuple(sorted((t for t in terms if counts[t]), key=lambda t: counts[t])[:NEAR_TERMS])
        if len(rarest) == min(NEAR_TERMS, len(terms)):
            near[rarest[0]].append((rarest, item))
    return Search(dict(windows), dict(near), tests.items)


def make_test_set(rows: list[tuple[str, bytes]], window: int = WINDOW) -> TestSet:
    terms: dict[bytes, int] = {}
    windows, items, item_terms = defaultdict(list), [], []
    for item, text in rows:
        ids = [terms.setdefault(w, len(terms)) for w in letter_words(text)]
        if not ids:
            continue
        for at in range(max(1, len(ids) - window + 1)):
            windows[tuple(ids[at : at + window])].append(len(items))
        items.append(item)
        item_terms.append(tuple(dict.fromkeys(ids)))
    return TestSet(terms, dict(windows), items, item_terms)


def _gap(window: int) -> int:
    return max(window, SLOP)


def postings(docs: DataFrame, terms, window: int, key: str, text: str) -> DataFrame:
    """The index: a row per shard and test term, and one (term -1) with the shard's documents.

    Positions count words within a shard; documents lie so far apart that neither a
    window nor a proximity match reaches from one to the next.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ("shard", "term", "n", "positions", "doc_id", "text_hash", "n_words")

    def close(shard, keys, found):
        ids = np.concatenate(found) if found else np.empty(0, np.int32)
        order = np.argsort(ids, kind="stable").astype(np.int32)
        ids = ids[order]
        cuts = np.flatnonzero(np.diff(ids, prepend=-2))
        out = [(shard, -1, len(keys), None, *map(list, zip(*keys)))]
        for first, last in zip(cuts, [*cuts[1:], len(ids)]):
            if ids[first] >= 0:
                steps = np.diff(order[first:last], prepend=0)
                out.append(
                    (shard, int(ids[first]), int(last - first), steps.astype("<i4").tobytes(), None, None, None)
                )
        return dict(zip(names, zip(*out)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        term_of, shard = terms.value.get, TaskContext.get().partitionId() << 24
        apart = np.full(_gap(window), -1, np.int32)
        keys, found, size = [], [], 0
        for batch in batches:
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, mark, value in zip(ids, marks, text_bytes(batch, "_text")):
                words = letter_words(value or b"")
                keys.append((doc_id, mark, len(words)))
                found.append(np.fromiter((term_of(w, -1) for w in words), np.int32, len(words)))
                found.append(apart)
                size += len(words) + len(apart)
                if size > SHARD_WORDS:
                    yield close(shard, keys, found)
                    shard, keys, found, size = shard + 1, [], [], 0
        if keys:
            yield close(shard, keys, found)

    chosen = docs.select(
        F.col(key).alias("doc_id"), text_hash(F.col(text)).alias("_mark"), F.col(text).alias("_text")
    )
    return over_batches(chosen, rows, INDEX.format(key=kind))


def places_of(window: tuple[int, ...], order: tuple[int, ...], lists: dict[int, np.ndarray]) -> np.ndarray:
    """Where all terms of ``window`` stand in a row; ``order`` has the rarest first."""
    starts = None
    for at in order:
        there = lists.get(window[at])
        if there is None:
            return np.empty(0, np.int64)
        if starts is None:
            starts = there - at
            continue
        wanted = starts + at
        slot = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
        starts = starts[there[slot] == wanted]
        if not len(starts):
            break
    return starts


def near_places(terms: tuple[int, ...], lists: dict[int, np.ndarray], slop: int) -> np.ndarray:
    """Places of the first term with all others at most ``slop`` words away."""
    around = lists.get(terms[0])
    if around is None:
        return np.empty(0, np.int64)
    for term in terms[1:]:
        there = lists.get(term)
        if there is None:
            return np.empty(0, np.int64)
        first = np.searchsorted(there, around - slop)
        around = around[(first < len(there)) & (there[np.minimum(first, len(there) - 1)] <= around + slop)]
        if not len(around):
            break
    return around


def match_shard(shard: pd.DataFrame, search: Search, window: int) -> pd.DataFrame:
    """A row per document of the shard: its hit spans and the items found in it."""
    head = shard[shard["term"] < 0].iloc[0]
    n_words = np.asarray(head["n_words"], dtype=np.int64)
    base = np.cumsum(n_words + _gap(window)) - (n_words + _gap(window))
    lists = {
        int(term): np.cumsum(np.frombuffer(blob, "<i4")).astype(np.int64)
        for term, blob in zip(shard["term"], shard["positions"])
        if term >= 0
    }
    starts, lengths, items, near = [], [], defaultdict(set), defaultdict(set)
    for term in lists:
        for terms, order, owners in search.windows.get(term, ()):
            found = places_of(terms, order, lists)
            if len(found):
                starts.append(found)
                lengths.append(np.full(len(found), len(terms)))
                for doc in np.unique(np.searchsorted(base, found, side="right") - 1):
                    items[int(doc)].update(owners)
        for rarest, item in search.near.get(term, ()):
            found = near_places(rarest, lists, SLOP)
            for doc in np.unique(np.searchsorted(base, found, side="right") - 1):
                near[int(doc)].add(item)
    spans = defaultdict(list)
    if starts:
        start, length = np.concatenate(starts), np.concatenate(lengths)
        doc = np.searchsorted(base, start, side="right") - 1
        order = np.argsort(start, kind="stable")
        for d, first, last in zip(doc[order], start[order], (start + length)[order]):
            own, first, last = spans[int(d)], int(first - base[d]), int(last - base[d])
            if own and first <= own[-1]["last"]:
                own[-1]["last"] = max(last, own[-1]["last"])
            else:
                own.append({"first": first, "last": last})
    named = lambda found, d: sorted({search.items[i] for i in found.get(d, ()) if search.items[i] is not None})
    count = range(len(n_words))
    return pd.DataFrame(
        {
            "doc_id": list(head["doc_id"]),
            "text_hash": list(head["text_hash"]),
            "n_words": n_words,
            "spans": [spans.get(d, []) for d in count],
            "items": [named(items, d) for d in count],
            "near_items": [named(near, d) for d in count],
        }
    )


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which may overlap."""
    step = lambda seen, s: F.struct(
        F.greatest(seen["end"], s["last"]).alias("end"),
        (seen["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(seen["end"], s["first"]))).alias("n"),
    )
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(F.array_sort(spans), start, step)["n"].cast("long")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("item", "text"), F.lit(n))


def blocks_of(tests: DataFrame) -> list[tuple[int, int, int]]:
    """First and last bucket of every block, and the number of buckets.

    A block has ``BLOCK_WORDS`` words at most, as a text has no more words than half its
    bytes, unless a single bucket has more, which takes an item of about that size.
    """
    limit = 2 * BLOCK_WORDS
    total = tests.agg(F.sum("size")).first()[0] or 0
    n = max(1, BUCKETS * -(-total // limit))
    # One row per bucket.
    sizes = dict(tests.groupBy(_bucket(n)).agg(F.sum("size")).collect())
    blocks, first, held = [], 0, 0
    for bucket in range(n):
        own = sizes.get(bucket, 0)
        if held and held + own > limit:
            blocks.append((first, bucket - 1, n))
            first, held = bucket, 0
        held += own
    return [*blocks, (first, n - 1, n)]


def benchmark_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, text_hash, n_words, spans, items, near_items``: a row per document.

    ``spans`` are the runs of words inside exact places of a window (``window``
    consecutive words of an item, or all words of a shorter one), ``items`` the items
    with such places, and ``near_items`` those with a proximity match: an occurrence of
    the rarest of the item's terms that has each of the next rarest, ``NEAR_TERMS`` in
    all, at most ``SLOP`` words before or after it. Only terms that the documents have
    count for that, and an item of which too few occur has no such match. A null or
    empty text has no words; a null item id is not listed, its text is searched for.
    Rows alike stay rows of their own, except that their order is not kept; other
    columns are not read. An empty benchmark matches nothing.
    """
    tests = (
        benchmark.select(
            F.col(item).cast("string").alias("item"), F.encode(F.coalesce(item_text, F.lit("")), "utf-8").alias("text")
        )
        .distinct()
        .withColumn("size", F.octet_length("text").cast("long"))
    )
    tests = stage(tests, "benchmark")
    parts = blocks_of(tests)
    blocks = len(parts)
    results = []
    for first, last, n in parts:
        part = tests.where(_bucket(n).between(first, last)).orderBy("item", "text")
        rows = [(r["item"], bytes(r["text"])) for r in part.collect()]  # bounded by the block
        test_set = make_test_set(rows, window)
        results.append(_match_block(docs, test_set, window, key, text))
    if blocks == 1:
        return results[0]
    together = results[0]
    for other in results[1:]:
        together = together.unionByName(other)
    # Rows alike meet here; each block has seen as many of them.
    merged = together.groupBy("doc_id", "text_hash", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
        (F.count("*") / blocks).cast("int").alias("_copies"),
    )
    return merged.withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")


def _match_block(docs: DataFrame, test_set: TestSet, window: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    terms = spark.sparkContext.broadcast(test_set.terms)
    index = stage(postings(docs, terms, window, key, text), "postings")
    counts = index.where("term >= 0").groupBy("term").agg(F.sum("n").alias("n")).collect()
    rarity = np.zeros(len(test_set.terms), dtype=np.int64)
    for row in counts:  # one row per term of the block
        rarity[row["term"]] = row["n"]

    search = spark.sparkContext.broadcast(make_search(test_set, rarity))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        return match_shard(rows, search.value, window)

    kind = docs.schema[key].dataType.simpleString()
    return index.groupBy("shard").applyInPandas(match, FOUND.format(key=kind))


def contamination(matches: DataFrame) -> DataFrame:
    """Add ``n_hit``, ``n_items``, ``n_near`` and ``contaminated``: one word in twenty or more is hit."""
    hit = F.col("n_hit")
    return matches.withColumn("n_hit", covered(F.col("spans"))).withColumns(
        {
            "n_items": F.size("items").cast("long"),
            "n_near": F.size("near_items").cast("long"),
            "contaminated": (hit > 0) & (hit * 20 >= F.col("n_words")),
        }
    )
