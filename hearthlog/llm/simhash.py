"""Near-duplicates by SimHash, with the generalised pigeonhole principle (Qin, Xiao,
Wang and Wang, 2018).

The 64 bits are cut into parts, bits that go together in one part. If the parts get
thresholds that add up to (bits allowed) - (parts) + 1, then two fingerprints that are
close agree in some part up to its threshold. How many parts there are and how the
thresholds are dealt out is found by dynamic programming on the number of candidates
to expect, from the frequency of every bit over all fingerprints. Each fingerprint
stands in the bucket of its value in every part and visits the buckets around it that
the threshold reaches; whoever meets there is compared bit by bit.
"""

import math
import sys
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import fresh_names, id_text, in_blocks, over_batches, text_bytes, text_hash
from hearthlog.llm.components import connected
from hearthlog.operators.lookup import lookup
from hearthlog.staging import stage, stage_measured

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
SHINGLE = 3
SEED = 42
LINK_BITS = 3
MOST_PARTS = 12
MOST_VISITS = 4000  # buckets around its own that a fingerprint may visit in one part
ROW_COST, PAIR_COST = 3e-6, 3e-9  # seconds for a row in the shuffle and for a comparison
BLOCK = 20_000  # fingerprints of a bucket that one task compares; larger buckets are split
SMALL_BUCKET = 48

# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, or of all words if there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    joined, ends, end = b" ".join(words), [], -1
    for word in words:
        end += len(word) + 1
        ends.append(end)
    starts = [0, *[e + 1 for e in ends]]
    last = ends[size - 1 :] or ends[-1:]
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last))


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in more than half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, mark, fp``: a row per row of ``docs``; ``mark`` is a hash of the text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [simhash(shingle_hashes(t or b"", size)) for t in text_bytes(batch, "_text")]
            if found:
                yield {
                    "doc_id": batch.column(0),
                    "mark": batch.column(1),
                    "fp": np.array(found, dtype=np.uint64).view(np.int64),
                }

    chosen = docs.select(F.col(key).alias("doc_id"), text_hash(F.col(text)).alias("mark"), F.col(text).alias("_text"))
    return over_batches(chosen, rows, f"doc_id {docs.schema[key].dataType.simpleString()}, mark long, fp long")


# ---------------------------------------------------------------- plan


class Part(NamedTuple):
    """Bits of a part, and the distance within it that is looked for (-1: none)."""

    bits: tuple[int, ...]
    reach: int


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for any two bits in how many both are set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            bits = np.unpackbits(
                batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64).astype("<u8").view(np.uint8).reshape(-1, 8),
                axis=1, bitorder="little",
            ).astype(np.float32)
            n += len(bits)
            both += np.rint(bits.T @ bits).astype(np.int64)
        yield {"at": range(-1, BITS * BITS), "n": [n, *both.ravel().tolist()]}

    # As many rows as pairs of bits.
    found = over_batches(prints.select("fp"), rows, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = {r["at"]: r["n"] for r in found}
    pairs = [counts.get(at, 0) for at in range(BITS * BITS)]
    return counts.get(-1, 0), np.array(pairs, dtype=float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Parts of about equal size; each grows by the bit most correlated with its own."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    alike = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = list(range(BITS)), []
    for part in range(parts):
        size = len(left) // (parts - part)
        group = [left.pop(0)]
        while len(group) < size:
            best = max(left, key=lambda b: (alike[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        groups.append(tuple(sorted(group)))
    return groups


def plan_parts(n: int, both: np.ndarray, allowed: int) -> list[Part]:
    """The parts and reaches with the least expected cost."""
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)  # chance that two fingerprints differ in a bit
    best: tuple[float, list[Part]] = (math.inf, [])
    for parts in range(1, MOST_PARTS + 1):
        groups = group_bits(n, both, parts)
        # costs[i] = cost of reach i - 1
        states: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for group in groups:
            chance = np.ones(1)
            for bit in group:
                chance = np.convolve(chance, [1 - differ[bit], differ[bit]])
            costs, visits = [0.0], 0
            for reach in range(min(allowed, len(group)) + 1):
                visits += math.comb(len(group), reach)
                if visits > MOST_VISITS:
                    break
                pairs = n * (n - 1) / 2 * chance[: reach + 1].sum()
                costs.append(n * (visits + 1) / 2 * ROW_COST + pairs * PAIR_COST)
            following: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, reaches) in states.items():
                for up, more in enumerate(costs):
                    if total + up <= allowed + 1 and cost + more < following.get(total + up, (math.inf,))[0]:
                        following[total + up] = (cost + more, [*reaches, up - 1])
            states = following
        if allowed + 1 in states and states[allowed + 1][0] < best[0]:
            cost, reaches = states[allowed + 1]
            best = (cost, [Part(g, r) for g, r in zip(groups, reaches)])
    return best[1]


# ---------------------------------------------------------------- buckets


def part_values(prints: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    value = np.zeros(len(prints), np.uint64)
    for at, bit in enumerate(bits):
        value |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(at)
    return value


def bucket_rows(prints: np.ndarray, parts: list[Part], visits: bool) -> Iterator[dict]:
    """Every fingerprint in its own bucket of every part, and as a visitor in those
    around it that have a larger value (the other half visits here)."""
    for number, part in enumerate(parts):
        if part.reach < 0:
            continue
        own = part_values(prints, part.bits)
        yield {
            "part": np.full(len(own), number, np.int32), "value": own.view(np.int64),
            "fp": prints.view(np.int64), "member": np.ones(len(own), bool),
        }
        values, whose = [], []
        for flips in range(1, part.reach + 1 if visits else 1):
            for places in combinations(range(len(part.bits)), flips):
                there = own ^ np.uint64(sum(1 << p for p in places))
                up = there > own
                values.append(there[up])
                whose.append(prints[up])
        if values:
            value, fp = np.concatenate(values), np.concatenate(whose)
            yield {
                "part": np.full(len(fp), number, np.int32), "value": value.view(np.int64),
                "fp": fp.view(np.int64), "member": np.zeros(len(fp), bool),
            }


def small_bucket_links(bucket: np.ndarray, fp: np.ndarray, member: np.ndarray, allowed: int):
    """Links within runs of equal ``bucket``: each row against those after it."""
    found, at, step = [], np.arange(len(fp)), 0
    while len(at):
        step += 1
        at = at[at + step < len(fp)]
        at = at[bucket[at] == bucket[at + step]]
        close = (np.bitwise_count(fp[at] ^ fp[at + step]) <= allowed) & (member[at] | member[at + step])
        found.append((fp[at[close]], fp[at[close] + step]))
    return found


def large_bucket_links(fp: np.ndarray, member: np.ndarray, allowed: int):
    """A spanning forest: from each member reached, only what is not reached yet is compared."""
    left, found = np.argsort(~member, kind="stable"), []  # members first
    while len(left) and member[left[0]]:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            here = reached.pop()
            if not member[here]:
                # two visitors meet in another bucket; members around this one are compared with it
                close = (np.bitwise_count(fp[left] ^ fp[here]) <= allowed) & member[left]
            else:
                close = np.bitwise_count(fp[left] ^ fp[here]) <= allowed
            if close.any():
                near = left[close]
                found.append((np.full(len(near), fp[here]), fp[near]))
                left = left[~close]
                reached.extend(near.tolist())
    return found


def bucket_links(bucket: np.ndarray, fp: np.ndarray, member: np.ndarray, allowed: int):
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    sizes = np.diff([*cuts, len(bucket)])
    small = np.repeat(sizes <= SMALL_BUCKET, sizes)
    found = small_bucket_links(bucket[small], fp[small], member[small], allowed)
    for first, size in zip(cuts[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET]):
        own = slice(first, first + size)
        found += large_bucket_links(fp[own], member[own], allowed)
    return found


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node that is not the smallest of its group, with the smallest."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        following = label.copy()
        np.minimum.at(following, a, least)
        np.minimum.at(following, b, least)
        np.minimum.at(following, label[a], least)
        np.minimum.at(following, label[b], least)
        following = following[following]
        if (following == label).all():
            break
        label = following
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def close_fingerprints(prints: DataFrame, allowed: int = LINK_BITS) -> DataFrame:
    """``a, b``: links between different fingerprints (column ``fp``, distinct) with at
    most ``allowed`` differing bits, as many as connect all that such links connect."""
    n, both = bit_counts(prints)
    parts = plan_parts(n, both, allowed)
    if n and not parts:
        raise ValueError(f"no plan finds fingerprints at {allowed} bits")

    def spread(visits: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for at in range(0, len(own), 1000):
                    yield from bucket_rows(own[at : at + 1000], parts, visits)

        return over_batches(prints.select("fp"), rows, "part int, value long, fp long, member boolean")

    large = stage_measured(
        spread(False)
        .groupBy("part", "value")
        .agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        .where("blocks > 1"),
        "large_buckets",
    )
    rows = in_blocks(spread(True), ["part", "value"], large, "fp", ~F.col("member"))
    partitions = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gathered = (
        rows.select(F.xxhash64("part", "value", "block").alias("bucket"), "fp", "member")
        .repartition(partitions, "bucket")
        .sortWithinPartitions("bucket")
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rest = None  # of the last bucket, which may go on
        found: list = []

        def close(last: bool):
            nonlocal rest
            bucket = rest[0]
            end = len(bucket) if last else int(np.searchsorted(bucket, bucket[-1]))
            found.extend(bucket_links(*[c[:end] for c in rest], allowed))
            rest = tuple(c[end:] for c in rest)

        for batch in batches:
            new = (
                batch.column(0).to_numpy(zero_copy_only=False),
                batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64),
                batch.column(2).to_numpy(zero_copy_only=False),
            )
            rest = new if rest is None else tuple(np.concatenate(c) for c in zip(rest, new))
            close(False)
        if rest is not None and len(rest[0]):
            close(True)
        if found:
            a, b = forest(*[np.concatenate(side) for side in zip(*found)])
            yield {"a": _signed(a), "b": _signed(b)}

    return over_batches(gathered, links, "a long, b long")


def _rooted(prints: DataFrame, allowed: int) -> DataFrame:
    """``prints``, one row for each fingerprint, with the ``root`` of its component."""
    roots = connected(close_fingerprints(prints, allowed))
    found = lookup(prints, roots.table.withColumnRenamed("node", "fp"), ["fp"], facts_bytes=roots.bytes)
    return stage(found.select(*prints.columns, F.coalesce("root", "fp").alias("root")), "rooted")


def link_documents(docs: DataFrame, allowed: int = LINK_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: a row per row of ``docs``.

    Documents whose fingerprints differ in at most ``allowed`` bits are linked; the
    component is named by the smallest id that can be reached, null if none has one. A
    null text is an empty one, of fingerprint zero. Other columns are not read.
    """
    prints = stage(fingerprints(docs, key, text).drop("mark"), "fingerprints")
    # Copies count once from here on.
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    rooted = _rooted(distinct, allowed)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = stage_measured(
        lookup(rooted.select("fp", "root"), named, ["root"], "inner").select("fp", "component_id"), "classes"
    )
    return lookup(prints, facts.table, ["fp"], "left", facts_bytes=facts.bytes).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, allowed: int = LINK_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``link_documents``, that with the
    smallest id (null last), with all columns as they are.

    Exact copies are a component, and so are all texts without words, null texts among
    them. Of rows that agree in id and text one stays.
    """
    prints = stage(fingerprints(docs, key, text).withColumn("id", id_text(F.col("doc_id"))), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id", "mark"))
    distinct = stage(prints.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "distinct_fingerprints")
    rooted = _rooted(distinct, allowed)
    groups = rooted.groupBy("root").agg(F.min("first").alias("best"), F.sum("n").alias("n")).where("n > 1")
    # The fingerprints of all groups of several rows, with the row that stays.
    stays = stage_measured(
        lookup(rooted.select("fp", "root"), groups, ["root"], "inner").select(
            "fp", F.col("best.id").alias("stays_id"), F.col("best.mark").alias("stays_mark")
        ),
        "stays",
    )
    grouped = stage(
        lookup(prints.select("fp", "id", "mark"), stays.table, ["fp"], "inner", facts_bytes=stays.bytes)
        .withColumn("stays", (F.col("id") == F.col("stays_id")) & (F.col("mark") == F.col("stays_mark")))
        .groupBy("id", "mark", "stays")
        .agg(F.count("*").alias("n")),
        "grouped",
    )
    row_id, row_mark = fresh_names(docs, "row_id", "row_mark")
    key_of = [F.col("id").alias(row_id), F.col("mark").alias(row_mark)]
    dropped = stage_measured(grouped.where("not stays").select(*key_of), "dropped")
    marked = docs.withColumns({row_id: id_text(F.col(key)), row_mark: text_hash(F.col(text))})
    kept = lookup(marked, dropped.table, [row_id, row_mark], "left_anti", facts_bytes=dropped.bytes)
    # Rows alike in id and text: only these, which are few, are shuffled.
    alike = stage_measured(grouped.where("stays and n > 1").select(*key_of), "alike")
    if alike.bytes:
        twins = lookup(kept, alike.table, [row_id, row_mark], "left_semi", facts_bytes=alike.bytes)
        others = lookup(kept, alike.table, [row_id, row_mark], "left_anti", facts_bytes=alike.bytes)
        kept = others.unionByName(twins.dropDuplicates([row_id, row_mark]))
    return kept.select(*docs.columns)
