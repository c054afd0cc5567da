"""Document fingerprints from closed syncmers (Edgar, 2021).

A k-mer is an anchor if the smallest of its inner s-mers is its first or its last one.
That depends on the k-mer alone, so an anchor stays one wherever its characters stand,
and the anchors of a text that is put together from parts of others are those of the
parts, but for a few around the seams. A fingerprint keeps all anchors of the text,
with their first positions; two are compared by the anchors that they share in the same
order.
"""

import bisect
import hashlib
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import over_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K, S = 16, 6  # characters
BATCH_ROWS, BATCH_CHARS = 1000, 2_000_000
_ODD = 0x9E3779B97F4A7C15


class Anchors(NamedTuple):
    """Hash and first character of every anchor, in order of position."""

    hashes: np.ndarray
    places: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> list[np.uint64]:
    return [np.uint64(pow(_ODD, j + 1, 2**64)) for j in range(n)]


def closed_syncmers(text: str, k: int = K, s: int = S) -> Anchors:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) < k:
        return Anchors(np.empty(0, np.uint32), np.empty(0, np.int64))
    n, inner = len(codes), k - s + 1
    hashes = np.zeros(n - s + 1, dtype=np.uint64)
    for j, power in enumerate(_powers(s)):
        hashes += codes[j : n - s + 1 + j] * power
    hashes = _mixed(hashes)
    # smallest of each `inner` consecutive s-mers, from smallest of 2, 4, 8 ...
    least, span = hashes, 1
    while 2 * span <= inner:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < inner:
        least = np.minimum(least[: len(hashes) - inner + 1], least[inner - span :])
    places = np.flatnonzero((hashes[: len(least)] == least) | (hashes[inner - 1 :] == least))
    found = np.zeros(len(places), dtype=np.uint64)
    for j, power in enumerate(_powers(k)):
        found += codes[places + j] * power
    return Anchors((_mixed(found) >> np.uint64(32)).astype(np.uint32), places)


def joined(head: Anchors, tail: Anchors, cut: int, taken: int, head_text: str, tail_text: str, k: int = K) -> Anchors:
    """Anchors of the first ``cut`` characters of one text followed by the first
    ``taken`` of another, from the anchors of the two."""
    h = np.searchsorted(head.places, cut - k, side="right")
    t = np.searchsorted(tail.places, taken - k, side="right")
    left = max(0, cut - k + 1)
    seam = closed_syncmers(head_text[left:cut] + tail_text[: min(taken, k - 1)], k)
    return Anchors(
        np.concatenate([head.hashes[:h], seam.hashes, tail.hashes[:t]]),
        np.concatenate([head.places[:h], seam.places + left, tail.places[:t] + cut]),
    )


def sketch(anchors: Anchors, text_of) -> list[tuple[int, int]]:
    """All different anchors, each at its first place, by place.

    A text without anchors has one: all of it.
    """
    if not len(anchors.hashes):
        text = text_of()
        whole = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
        return [(int.from_bytes(whole[:4], "little"), 0)] if text else []
    first: dict[int, int] = {}
    for h, place in zip(anchors.hashes.tolist(), anchors.places.tolist()):
        first.setdefault(h, place)
    return list(first.items())


def written(anchors: list[tuple[int, int]]) -> str:
    return ",".join([f"{h:08x}:{p}" for h, p in anchors])


def likeness(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> float:
    """Share of their characters' anchors that two texts have in common, in one order.

    1 for two empty texts.
    """
    if not a or not b:
        return float(len(a) == len(b))
    at = dict(b)
    ends: list[int] = []  # the shortest ends of rising runs: the longest one counts
    for h, _ in a:
        if (there := at.get(h)) is not None:
            if not ends or there > ends[-1]:
                ends.append(there)
            else:
                ends[bisect.bisect_left(ends, there)] = there
    return 2 * len(ends) / (len(a) + len(b))


def _place(doc_id: Column, text: Column) -> Column:
    """A row's place: larger ones come first, and those without an id last.

    Texts with one id go by their hashes, so that a hot id can be split.
    """
    return F.struct(doc_id.alias("id"), F.bitwise_not(F.xxhash64(text)).alias("turn"))


def _chunk_of(place: Column, starts: Column | None, n: int) -> Column:
    """How many of the ``n`` falling ``starts`` are not below ``place``."""
    if starts is None:
        return F.lit(0)
    steps = [1 << b for b in reversed(range(n.bit_length()))]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda seen, step: F.when(F.get(starts, seen + step - 1) >= place, seen + step).otherwise(seen),
    )


FOUND = (
    "doc_id {key}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    A row per row of ``docs``. The next document of one is that with the next smaller
    id, after the last the first; the edited text has its second half replaced by the
    start of the next document. Documents with one id follow each other in order of
    the hashes of their texts, those without an id come last. A null text is an empty one.
    Other columns are not read.

    The texts are shuffled once, into ranges of ids and hashes, so that rows with one id
    or none are split. (Copies of one row stay together; the task fingerprints them once.)
    The first document of each range also goes to the range before, which needs it as its
    last document's next one.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_of = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    placed = rows_of.withColumn("_place", _place(F.col("doc_id"), F.col("_text")))
    ranges = placed.select("_place").repartitionByRange(partitions, F.desc("_place"))
    # One row per range.
    heads = ranges.groupBy(F.spark_partition_id()).agg(F.max("_place").alias("first")).select("first.*").collect()
    heads.sort(key=lambda r: (r["id"] is not None, r["id"] if r["id"] is not None else 0, r["turn"]), reverse=True)
    kind = docs.schema[key].dataType
    bounds = [F.struct(F.lit(r["id"]).cast(kind).alias("id"), F.lit(r["turn"]).cast("long").alias("turn")) for r in heads]
    last = max(len(bounds) - 1, 0)
    place = F.col("_place")
    chunk = _chunk_of(place, F.array(*bounds[1:]) if last else None, last)
    top = place.eqNullSafe(bounds[0]) if bounds else F.lit(False)
    starts_chunk = place.eqNullSafe(F.get(F.array(*bounds), F.col("_own"))) if bounds else F.lit(False)
    own = F.struct(F.col("_own").alias("chunk"), F.lit(False).alias("ahead"))
    before = F.struct(F.when(top, F.lit(last)).otherwise(F.col("_own") - 1).alias("chunk"), F.lit(True).alias("ahead"))
    laid_out = (
        placed.withColumn("_own", chunk)
        .withColumn("_at", F.explode(F.when(starts_chunk, F.array(own, before)).otherwise(F.array(own))))
        .select("doc_id", "_text", "_place", F.col("_at.chunk").alias("_chunk"), F.col("_at.ahead").alias("_ahead"))
        .repartitionById(max(partitions, last + 1), "_chunk")
        .sortWithinPartitions("_ahead", F.desc("_place"), "_text")
        .select("doc_id", "_text", "_ahead")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, size, last = [], 0, None
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(3))
            for doc_id, value, ahead in zip(*columns):
                if last is not None and last[1] == value:
                    here = (doc_id, *last[1:])  # a copy
                else:
                    here = (doc_id, value, found := closed_syncmers(value), sketch(found, lambda v=value: v))
                if last is not None:
                    out.append(_compared(last, here))
                    size += len(last[1])
                    if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield dict(zip(names, zip(*out)))
                        out, size = [], 0
                last = None if ahead else here
                if ahead:
                    break  # only the first of those ahead is next to ours
            else:
                continue
            break
        for _ in batches:
            pass
        if out:
            yield dict(zip(names, zip(*out)))

    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    return over_batches(laid_out, rows, FOUND.format(key=docs.schema[key].dataType.simpleString()))


def _compared(this: tuple, following: tuple) -> tuple:
    doc_id, text, anchors, own = this
    _, next_text, next_anchors, next_own = following
    gone = len(text) // 2
    cut, taken = len(text) - gone, min(gone, len(next_text))
    edited = text[:cut] + next_text[:taken]
    after = sketch(joined(anchors, next_anchors, cut, taken, text, next_text), lambda: edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return (doc_id, len(text), digest, written(own), written(after), likeness(own, after), likeness(own, next_own))
