"""Packing documents into training sequences of one width.

Shortest-pack-first histogram packing (Krell, Kosec, Perez and Fitzgibbon, 2021):
what is packed are the counts of lengths, not documents. Lengths are placed longest
first, each into the pack that is shortest so far among those it fits in. At the end
the emptiest packs are taken apart again and their pieces are cut to fill the gaps
that are left in the others, so that all sequences are full. The plan has a few
thousand rows whatever the number of documents; pieces find their place in it by
their rank among the pieces of their length.
"""

import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm.common import kept_by_worker, over_batches, text_bytes
from hearthlog.operators.lookup import lookup
from hearthlog.staging import stage, stage_measured

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 2048
END_ID = 1
BATCH_BYTES = 8 * 1024 * 1024
MOST_WORDS_KEPT = 600_000  # of a worker's memory of word ids: the first, so the frequent ones

# ---------------------------------------------------------------- ids


def _byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: printable
    bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_BYTE_LETTERS = _byte_letters()


def _composed(word: str) -> bool:
    """Latin letters that are their own composed form and whose lower case is one letter."""
    return all(c < "\u0130" or "\u0130" < c < "\u0240" for c in word)


class WordIds(dict):
    """Ids of a run of characters without ASCII white space, as little-endian integers.

    For byte-level tokenizers that lower-case, split at white space and wherever
    letters meet something else, and mark the ends of words. Words of letters go
    straight to the merges; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def word(self, word: str) -> bytes:
        """Ids of a lower-case word of letters, which the tokenizer does not split."""
        shown = "".join([_BYTE_LETTERS[b] for b in word.encode()]) if not word.isascii() else word
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], dtype="<u4").tobytes()

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def __missing__(self, run: bytes) -> bytes:
        core = run.rstrip(b".,;:!?")
        word = core.decode("utf-8", "replace")
        plain = word.isalpha() and (word.isascii() or _composed(word))
        if plain and len(core) < len(run):
            found = self[core] + self[run[len(core) :]]
        elif plain:
            found = self.word(word.lower())
        else:
            found = self.whole(run)
        if len(self) < MOST_WORDS_KEPT:
            self[run] = found
        return found


def word_ids(path: str) -> Callable[[bytes], bytes]:
    """Text to ids with the tokenizer in the file ``path``, lower-casing and dropping
    white space; the ids equal those of encoding the text in one go."""
    known = kept_by_worker(f"word_ids_{path}", lambda: WordIds(path))

    def encode(text: bytes) -> bytes:
        if b"<|" in text:
            return known.whole(text)
        return b"".join(map(known.__getitem__, text.lower().split()))

    return encode


# ---------------------------------------------------------------- plan


class Place(NamedTuple):
    """Pieces of ``length`` with ranks in [first, last): the part of each that starts
    at ``cut_start`` goes to sequence ``sequence + rank - first`` at ``offset``."""

    length: int
    first: int
    last: int
    cut_start: int
    cut_length: int
    sequence: int
    offset: int


def pack_histogram(counts: dict[int, int], width: int) -> list[tuple[int, list[int]]]:
    """Shortest-pack-first: ``(packs, lengths in the pack)`` for each pattern."""
    by_space: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        left, space = counts[length], width
        while left:
            while space >= length and not by_space[space]:
                space -= 1
            if space < length:  # no open pack has room: open packs that are full of this length
                per_pack = width // length
                if left >= per_pack:
                    by_space[width - per_pack * length].append((left // per_pack, [length] * per_pack))
                if left % per_pack:
                    by_space[width - left % per_pack * length].append((1, [length] * (left % per_pack)))
                break
            packs, pattern = by_space[space].pop()
            if packs > left:
                by_space[space].append((packs - left, pattern))
            used = min(packs, left)
            by_space[space - length].append((used, [*pattern, length]))
            left -= used
    return [entry for space in sorted(by_space, reverse=True) for entry in by_space[space]]


def plan_packs(counts: dict[int, int], width: int) -> list[Place]:
    """Where the pieces of each length go. All sequences are full but the last few,
    whose lengths are different powers of two."""
    packs = [(n, lengths, width - sum(lengths)) for n, lengths in pack_histogram(counts, width)]
    undo = -(-sum(n * space for n, _, space in packs) // width)
    places, rank, sequence = [], defaultdict(int), 0
    loose: list[tuple[int, int, int, int, int]] = []  # length, first, last, start and rest to place
    gaps: list[tuple[int, int, int, int]] = []  # sequence, packs, offset, space

    def take(length: int, n: int) -> int:
        rank[length] += n
        return rank[length] - n

    for n, lengths, space in packs:  # the emptiest first
        apart = min(n, undo)
        undo -= apart
        if apart:
            for length in lengths:
                first = take(length, apart)
                loose.append((length, first, first + apart, 0, length))
        if n > apart:
            offset = 0
            for length in lengths:
                first = take(length, n - apart)
                places.append(Place(length, first, first + n - apart, 0, length, sequence, offset))
                offset += length
            if space:
                gaps.append((sequence, n - apart, offset, space))
            sequence += n - apart
    rest = sum((last - first) * size for _, first, last, _, size in loose)
    rest -= sum(n * space for _, n, _, space in gaps)
    for power in reversed(range(width.bit_length())):
        if rest >> power & 1:
            gaps.insert(0, (sequence, 1, 0, 1 << power))
            sequence += 1
    while loose:
        length, first, last, start, size = loose.pop()
        to, n, offset, space = gaps.pop()
        both, part = min(last - first, n), min(size, space)
        places.append(Place(length, first, first + both, start, part, to, offset))
        if last - first > both:
            loose.append((length, first + both, last, start, size))
        if n > both:
            gaps.append((to + both, n - both, offset, space))
        if size > part:
            loose.append((length, first, first + both, start + part, size - part))
        if space > part:
            gaps.append((to, both, offset + part, space - part))
    return places


# ---------------------------------------------------------------- Spark

PIECES = "doc_id {key}, start long, ids binary, length int, doc_tokens long, chunk long, chunk_rank long"


def cut_documents(
    docs: DataFrame,
    encoder: Callable[[], Callable[[bytes], bytes]],
    width: int = WIDTH,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Ids of every document, with an end mark, in pieces of at most ``width``.

    ``chunk_rank`` numbers the pieces of one length that a task has made.
    """
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([END_ID], dtype="<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encode, chunk, seen = encoder(), TaskContext.get().partitionId(), defaultdict(int)
        names = ("doc_id", "start", "ids", "length", "doc_tokens", "chunk", "chunk_rank")
        out, size = [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), text_bytes(batch, "_text")):
                ids = encode(value or b"") + end
                for at in range(0, len(ids), 4 * width):
                    part = ids[at : at + 4 * width]
                    length = len(part) // 4
                    out.append((doc_id, at // 4, part, length, len(ids) // 4, chunk, seen[length]))
                    seen[length] += 1
                    size += len(part)
                if size > BATCH_BYTES:
                    yield dict(zip(names, zip(*out)))
                    out, size = [], 0
        if out:
            yield dict(zip(names, zip(*out)))

    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    return over_batches(chosen, rows, PIECES.format(key=kind))


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[bytes], bytes]],
    width: int = WIDTH,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, start, length, doc_tokens, sequence_id, offset, ids``: a row per piece.

    ``encoder`` makes, on a worker, the function from UTF-8 text to little-endian
    32-bit ids. A null text is an empty one and still has its end mark. Rows with the
    same id are documents of their own. Other columns of ``docs`` are not read. An
    empty table gives no sequences.
    """
    spark = docs.sparkSession
    pieces = stage(cut_documents(docs, encoder, width, key, text), "pieces")
    # At most as many rows as tasks for one length, so no window grows with the documents.
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage_measured(
        pieces.groupBy("chunk", "length")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))),
        "piece_counts",
    )
    # No more rows than the width.
    counts = {r["length"]: r["n"] for r in sizes.table.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(
        [tuple(p) for p in plan_packs(counts, width)],
        "length int, first long, last long, cut_start int, cut_length int, sequence long, offset long",
    )
    ranked = lookup(
        pieces, sizes.table.select("chunk", "length", "before"), ["chunk", "length"], "inner",
        facts_bytes=sizes.bytes,
    ).withColumn("rank", F.col("before") + F.col("chunk_rank"))
    # The plan is bounded by the width.
    placed = ranked.join(F.broadcast(plan), "length").where(
        (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last"))
    )
    whole = F.col("cut_length") == F.col("length")
    part = F.substring(F.col("ids"), F.col("cut_start") * 4 + 1, F.col("cut_length") * 4)
    return placed.select(
        "doc_id",
        (F.col("start") + F.col("cut_start")).alias("start"),
        F.col("cut_length").cast("long").alias("length"),
        "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset",
        F.when(whole, F.col("ids")).otherwise(part).alias("ids"),
    )
