"""Byte strings that stand in a corpus more than once, found with suffix arrays.

Every string of the length looked for holds an anchor, its k-gram of smallest hash,
and equal strings hold it at the same place. So strings are compared among those of one
anchor only, and only where the anchor is repeated. The bytes around an occurrence that
its strings can reach are its context. Where all contexts of an anchor are alike,
everything repeats. Where they differ, their stretches between the places at which any
two of them part become symbols, and a suffix array of the contexts in these symbols
gives for each start the longest string that another context shares.

An anchor of very many contexts is split by what stands around it: strings that have it
at distances of one piece share the bytes that all of them reach, so each context goes to
one group for each piece, whatever the number of contexts. Where many contexts agree in
these bytes too, the few strings of the piece are counted themselves.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import over_batches, text_bytes
from hearthlog.llm.suffixes import common_prefixes, suffix_array
from hearthlog.operators.lookup import lookup
from hearthlog.staging import Staged, stage, stage_measured

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200  # bytes
K = 32  # bytes of an anchor
BLOCK = 4000  # contexts that are compared at one time
PIECES = 8  # of the distances from start to anchor, where an anchor has more contexts
PLACE_BITS = 20  # of a place within the stretch of a text that is looked at together
_ODDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

# ---------------------------------------------------------------- anchors


def _gram_hashes(text: bytes) -> np.ndarray:
    words = np.zeros(len(text) - 7, np.uint64)  # eight bytes from every place
    for shift in range(8):
        count = (len(text) - shift) // 8
        words[shift::8] = np.frombuffer(text, "<u8", count, shift)
    n = len(text) - K + 1
    found = np.zeros(n, np.uint64)
    for at, odd in zip(range(0, K, 8), _ODDS):
        found += words[at : at + n] * np.uint64(odd)
    found ^= found >> np.uint64(31)
    found *= np.uint64(_ODDS[3])
    found ^= found >> np.uint64(29)
    found *= np.uint64(_ODDS[1])
    return found ^ (found >> np.uint64(32))


def _least_places(hashes: np.ndarray, grams: int, bits: int) -> np.ndarray:
    """For each run of ``grams`` hashes the place of the smallest, of equal ones the last."""
    low = np.uint64((1 << bits) - 1)
    least, span = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64)), 1
    starts = len(hashes) - grams + 1
    while 2 * span <= grams:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    least = np.minimum(least[:starts], least[grams - span : grams - span + starts])
    return (low - (least & low)).astype(np.int64)


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and hash of each anchor, and the first and last start of the strings that
    it is the anchor of: the smallest hash in the string, of equal ones the last."""
    if len(text) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    hashes = _gram_hashes(text)
    grams = length - K + 1  # of a string
    starts = len(text) - length + 1
    bits = max(PLACE_BITS, (2 * grams).bit_length())
    step = (1 << bits) - grams + 1  # strings of a stretch, whose places fit the bits
    place = np.concatenate([
        _least_places(hashes[at : at + step + grams - 1], grams, bits) + at for at in range(0, starts, step)
    ])
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], starts) - 1
    return place[first], hashes[place[first]], first, last


# ---------------------------------------------------------------- contexts of one anchor


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Side:
    """One side of the contexts, away from the anchor, cut where any two of them part."""

    def __init__(self, strings: list[bytes]):
        order = sorted(range(len(strings)), key=strings.__getitem__)
        shared = [0, *[_shared(strings[a], strings[b]) for a, b in zip(order, order[1:])], 0]
        self.reach = [0] * len(strings)  # of each: the most that it shares with another one
        for at, x in enumerate(order):
            self.reach[x] = max(shared[at], shared[at + 1])
        self.cuts = sorted({s for s in shared if s})
        self._order, self._shared = order, shared

    def symbols(self, chosen: set[int]) -> dict[int, list[tuple[int, int]]]:
        """For each of the chosen its stretches, nearest first, named by number and class."""
        found: dict[int, list[tuple[int, int]]] = {x: [] for x in chosen}
        for number, cut in enumerate(self.cuts):
            kind = 0
            for at, x in enumerate(self._order):
                kind += self._shared[at] < cut
                if x in found and self.reach[x] >= cut:
                    found[x].append((number, kind))
        return found


def repeated_starts(contexts: list[tuple[bytes, int, int]], length: int = LENGTH) -> dict[int, list[tuple[int, int]]]:
    """Which strings of the contexts of one anchor stand in another context too.

    A context is its bytes, the place of the anchor in them and the last start of a
    string. The result has runs of distances (smallest, largest) from start to anchor.
    """
    left = Side([c[:at][::-1] for c, at, _ in contexts])
    right = Side([c[at:] for c, at, _ in contexts])
    chosen = {x for x in range(len(contexts)) if left.reach[x] + right.reach[x] >= length}
    if len(chosen) < 2:
        return {}
    before, after = left.symbols(chosen), right.symbols(chosen)
    names: dict[tuple, int] = {}
    text: list[int] = []
    starts: list[tuple[int, int, int]] = []  # context, its first symbol, its anchor's symbol
    for x in sorted(chosen):
        first = len(text)
        text += [names.setdefault((0, s), len(names)) for s in reversed(before[x])]
        anchor = len(text)
        text.append(names.setdefault((1,), len(names)))
        text += [names.setdefault((2, s), len(names)) for s in after[x]]
        text.append(names.setdefault((3, x), len(names)))  # ends a match
        starts.append((x, first, anchor))
    order = suffix_array(text)
    shared = [*common_prefixes(text, order), 0]
    longest = [0] * len(text)
    for at, start in enumerate(order):
        longest[start] = max(shared[at], shared[at + 1])
    found: dict[int, list[tuple[int, int]]] = {}
    for x, first, anchor in starts:
        context, place, last = contexts[x]
        runs: list[tuple[int, int]] = []
        for start in range(anchor, first - 1, -1):
            stretches = anchor - start  # to the left
            beyond = longest[start] - stretches - 1  # to the right of the anchor
            if beyond < 0:
                break
            reach = right.cuts[beyond - 1] if beyond else 0
            near = left.cuts[stretches - 2] + 1 if stretches > 1 else min(stretches, 1)
            far = left.cuts[stretches - 1] if stretches else 0
            low, high = max(near, length - reach, place - last), min(far, place)
            if low <= high:
                if runs and runs[-1][1] + 1 == low:
                    runs[-1] = (runs[-1][0], high)
                else:
                    runs.append((low, high))
        if runs:
            found[x] = runs
    return found


# ---------------------------------------------------------------- Spark

MARK = ["mark", "mark2"]  # two hashes of a text; equal texts share their fate
OCCURRENCE = "mark long, mark2 long, place int, first int, last int, anchor long, context long"


def _marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"), F.xxhash64(value).alias("mark"),
        F.xxhash64(F.lit(1), value).alias("mark2"), value.alias("_text"),
    )


def _occurrences(marked: DataFrame, length: int) -> DataFrame:
    """A row per anchor, with the hash of its context."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from xxhash import xxh3_64_intdigest

        names = ("place", "first", "last", "anchor")
        for batch in batches:
            found, sizes, contexts = [], [], []
            for value in text_bytes(batch, "_text"):
                place, hashes, first, last = anchors(value, length)
                found.append((place, first, last, hashes))
                sizes.append(len(place))
                contexts += [
                    xxh3_64_intdigest(value[a:b], p - a)
                    for a, b, p in zip(first.tolist(), (last + length).tolist(), place.tolist())
                ]
            if contexts:
                out = {name: np.concatenate(column) for name, column in zip(names, zip(*found))}
                out = {name: out[name].astype(np.int32) for name in names[:3]} | {"anchor": out["anchor"].view(np.int64)}
                out["context"] = np.array(contexts, dtype=np.uint64).view(np.int64)
                for at, name in enumerate(MARK):
                    out[name] = np.repeat(batch.column(at).to_numpy(zero_copy_only=False), sizes)
                yield out

    return over_batches(marked.select(*MARK, "_text"), rows, OCCURRENCE)


def _contexts(marked: DataFrame, wanted: DataFrame, wanted_bytes: int, length: int) -> DataFrame:
    """The bytes of the wanted occurrences: ``anchor, context, bytes, at, last``."""
    texts = lookup(marked.select(*MARK, "_text"), wanted, MARK, "inner", facts_bytes=wanted_bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("anchor", "context", "bytes", "at", "last")
        for batch in batches:
            out, size = [], 0
            for value, occurrences in zip(text_bytes(batch, "_text"), batch.column(1).to_pylist()):
                for o in occurrences:
                    first, last = o["first"], o["last"]
                    out.append((o["anchor"], o["context"], value[first : last + length], o["place"] - first, last - first))
                    size += last - first + length
                if size > 8_000_000:
                    yield dict(zip(names, zip(*out)))
                    out, size = [], 0
            if out:
                yield dict(zip(names, zip(*out)))

    return over_batches(texts.select("_text", "own"), rows, "anchor long, context long, bytes binary, at int, last int")


def _pieces(contexts: DataFrame, length: int) -> DataFrame:
    """A row per context and piece of distances that its strings have: ``low`` and ``high``
    of these, and ``group``, the hash of the anchor, the piece and the bytes that all strings
    of the piece have in common around the anchor."""
    cuts = [(length - K + 1) * j // PIECES for j in range(PIECES + 1)]
    nearest, farthest = F.col("at") - F.col("last"), F.col("at")
    pieces = []
    for low, high in ((a, b - 1) for a, b in zip(cuts, cuts[1:]) if a < b):
        core = F.substring("bytes", F.col("at") - low + 1, F.lit(low + length - high))
        piece = F.struct(
            F.xxhash64("anchor", F.lit(low), core).alias("group"),
            F.greatest(F.lit(low), nearest).alias("low"), F.least(F.lit(high), farthest).alias("high"),
        )
        pieces.append(F.when((nearest <= high) & (farthest >= low), piece))
    found = contexts.withColumn("piece", F.explode(F.array_compact(F.array(*pieces))))
    return found.select("piece.group", "anchor", "context", "bytes", "at", "last", "piece.low", "piece.high")


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """``anchor, context, near, far`` of the strings of each piece that several contexts have,
    by 128 bits of hash: a row per string, and none per pair."""
    string = F.substring("bytes", F.col("at") - F.col("far") + 1, F.lit(length))
    hashed = ["anchor", "far", "one", "two"]
    strings = stage(
        pieces.withColumn("far", F.explode(F.sequence("low", "high")))
        .select("anchor", "context", "far", F.xxhash64(string).alias("one"), F.xxhash64(F.lit(1), string).alias("two")),
        "strings",
    )
    repeated = stage_measured(
        strings.groupBy(*hashed).agg((F.min("context") < F.max("context")).alias("several")).where("several").select(*hashed),
        "repeated_strings",
    )
    again = lookup(strings, repeated.table, hashed, "inner", facts_bytes=repeated.bytes)
    return again.select("anchor", "context", F.col("far").alias("near"), "far")


def _compared(contexts: DataFrame, large: Staged, length: int) -> DataFrame:
    """``anchor, context, near, far``: runs of distances of repeated strings. ``large`` has
    the anchors of more than ``BLOCK`` contexts."""
    columns = ["group", "anchor", "context", "bytes", "at", "last"]
    whole = contexts.withColumn("group", F.xxhash64("anchor"))
    if not large.bytes:
        return _by_suffixes(whole.select(*columns), length)
    whole = stage(whole, "context_bytes")
    some = lookup(whole, large.table, ["anchor"], "left_anti", facts_bytes=large.bytes)
    many = lookup(whole, large.table, ["anchor"], "left_semi", facts_bytes=large.bytes)
    pieces = stage(_pieces(many.drop("group"), length), "pieces")
    dense = stage_measured(
        pieces.groupBy("group").agg(F.count_distinct("context").alias("n")).where(F.col("n") > BLOCK).select("group"), "dense"
    )
    sparse = lookup(pieces, dense.table, ["group"], "left_anti", facts_bytes=dense.bytes)
    found = _by_suffixes(some.select(*columns).unionByName(sparse.select(*columns)), length)
    if not dense.bytes:
        return found
    return found.unionByName(_counted(lookup(pieces, dense.table, ["group"], "left_semi", facts_bytes=dense.bytes), length))


def _by_suffixes(grouped: DataFrame, length: int) -> DataFrame:
    """``anchor, context, near, far`` by a suffix array for each ``group``."""
    partitions = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = grouped.repartition(partitions, "group").sortWithinPartitions("group")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        current, own = None, {}

        def close():
            own_contexts = list(own.values())
            found = repeated_starts([c[2:] for c in own_contexts], length) if len(own) > 1 else {}
            return [(*own_contexts[x][:2], near, far) for x, runs in found.items() for near, far in runs]

        for batch in batches:
            out = []
            for group, *row in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if group != current:
                    out += close()
                    current, own = group, {}
                own.setdefault(row[1], row)  # of copies that were read twice one is enough
            if out:
                yield dict(zip(names, zip(*out)))
        if out := close():
            yield dict(zip(names, zip(*out)))

    names = ("anchor", "context", "near", "far")
    return over_batches(gathered, rows, "anchor long, context long, near int, far int")


def repeated_spans(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``mark, mark2, spans``: for each text with any, the bytes inside strings of
    ``length`` bytes that start anywhere else too, as runs (first, end) that may overlap."""
    marked = _marked(docs, key, text)
    occurrences = stage(_occurrences(marked, length), "anchors")
    anchored = stage_measured(
        occurrences.groupBy("anchor")
        .agg((F.min("context") == F.max("context")).alias("alike"), F.count("*").alias("n"))
        .where("n > 1")
        .select("anchor", "alike"),
        "repeated_anchors",
    )
    candidates = lookup(occurrences, anchored.table, ["anchor"], "inner", facts_bytes=anchored.bytes)
    # Contexts that are not alike, with one occurrence of each to read its bytes from.
    place = F.struct(*MARK, "place", "first", "last")
    varied = stage_measured(
        candidates.where(~F.col("alike")).groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(place).alias("one")),
        "contexts",
    )
    wanted = stage_measured(
        varied.table.select("one.mark", "one.mark2", F.struct("anchor", "context", "one.place", "one.first", "one.last").alias("o"))
        .groupBy(*MARK)
        .agg(F.collect_list("o").alias("own")),
        "wanted",
    )
    large = stage_measured(
        varied.table.groupBy("anchor")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > BLOCK)
        .select("anchor"),
        "large_anchors",
    )
    runs = _compared(_contexts(marked, wanted.table, wanted.bytes, length), large, length)
    # What stands in several places as it is repeats from end to end.
    whole = varied.table.where("n > 1").select(
        "anchor", "context", (F.col("one.place") - F.col("one.last")).alias("near"), (F.col("one.place") - F.col("one.first")).alias("far")
    )
    judged = stage_measured(
        runs.unionByName(whole).groupBy("anchor", "context").agg(F.collect_set(F.struct("near", "far")).alias("runs")), "judged"
    )
    several = lookup(candidates.where(~F.col("alike")), judged.table, ["anchor", "context"], "inner", facts_bytes=judged.bytes)
    span = lambda first, end: F.struct(first.cast("int").alias("first"), end.cast("int").alias("end"))
    place, near, far = F.col("place"), F.col("run.near"), F.col("run.far")
    spans = (
        several.select(*MARK, "place", F.explode("runs").alias("run"))
        .select(*MARK, span(place - far, place - near + length).alias("span"))
        .unionByName(candidates.where("alike").select(*MARK, span(F.col("first"), F.col("last") + length).alias("span")))
    )
    return spans.groupBy(*MARK).agg(F.collect_set("span").alias("spans"))


RESULT = "doc_id {key}, n_bytes long, n_removed long, n_spans long, kept binary"


def drop_repeated_strings(
    docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept``: a row per row of ``docs``.

    ``kept`` are the bytes of the UTF-8 text outside all strings of ``length`` bytes
    that start anywhere else in the table too, also in the same text; ``n_spans`` counts
    the maximal runs that go. Cuts may fall inside characters. A null text is an empty
    one; rows that agree in their text repeat each other. Other columns are not read.
    """
    marked = _marked(docs, key, text)
    spans = stage_measured(repeated_spans(docs, length, key, text), "spans")
    found = lookup(marked, spans.table, MARK, "left", facts_bytes=spans.bytes).select("doc_id", "_text", "spans")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
        for batch in batches:
            out = []
            for doc_id, value, own in zip(batch.column(0).to_pylist(), text_bytes(batch, "_text"), batch.column(2).to_pylist()):
                runs: list[list[int]] = []
                for first, end in sorted((s["first"], s["end"]) for s in own or ()):
                    if runs and first <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], end)
                    else:
                        runs.append([first, end])
                cuts = [0, *[b for run in runs for b in run], len(value)]
                kept = b"".join([value[a:b] for a, b in zip(cuts[::2], cuts[1::2])])
                out.append((doc_id, len(value), len(value) - len(kept), len(runs), kept))
            if out:
                yield dict(zip(names, zip(*out)))

    return over_batches(found, rows, RESULT.format(key=docs.schema[key].dataType.simpleString()))
