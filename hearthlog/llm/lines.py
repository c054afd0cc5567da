"""Repeated passages of lines.

Those of more than ``WORDS`` words, on one line or several, are all found: from every
line, and up to every line, the shortest such run is looked for elsewhere. Shorter ones
are cut at places that the lines themselves choose: a rolling hash over the hashes of
the last lines decides where a chunk ends, so that a line put in or taken out moves the
cuts around it only. What several documents share is compared byte by byte; of each
passage, the first stays and the others go.
"""

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import fresh_names, id_text, over_batches, text_bytes, text_hash
from hearthlog.operators.lookup import lookup
from hearthlog.staging import Staged, stage, stage_measured

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_LINES = 2  # with something on them, of a chunk
ONE_CUT_IN = 3  # lines, on average, from the least on
WORDS = 50  # passages of more are found wherever they begin and end
SLICE_ROWS = 200  # of a batch, that a task has as Python objects
ROLLING = 2  # lines that decide whether a chunk ends
_MASK, _ODD = 2**64 - 1, 0x9E3779B97F4A7C15


def chunks(text: bytes) -> list[tuple[int, int, int]]:
    """``(first byte, end byte, lines)`` of the chunks of a text, in order and without
    gaps. Blank lines belong to the line before them."""
    from xxhash import xxh64_intdigest

    found, start, at, lines = [], 0, 0, 0
    last = [0] * ROLLING
    parts = text.split(b"\n")
    for number, line in enumerate(parts):
        end = at + len(line) + (number + 1 < len(parts))
        if line.strip():
            if lines >= LEAST_LINES and cut:
                found.append((start, at, lines))
                start, lines = at, 0
            last = [*last[1:], xxh64_intdigest(line, 7)]
            rolled = 0
            for value in last:
                rolled = (rolled * _ODD + value) & _MASK
            cut = (rolled >> 17) % ONE_CUT_IN == 0
            lines += 1
        at = end
    if at > start or not found:
        found.append((start, at, lines))
    return found


def _key(chunk: bytes) -> bytes:
    """Chunks are compared without the line break that may end them."""
    return chunk.rstrip(b"\n")


def passages(text: bytes) -> list[tuple[int, int, bytes]]:
    """``(first line, end line, bytes)`` of what is looked for elsewhere; blank lines do
    not count.

    From every line the shortest run of more than ``WORDS`` words, and up to every line
    the shortest one: a line of any longer run lies in one of these that is within the
    run, so what they cover together is covered whole. Shorter passages are found as
    chunks of several lines.
    """
    starts, ends, words, at = [], [], [], 0
    for line in text.split(b"\n"):
        if count := len(line.split()):
            starts.append(at)
            ends.append(at + len(line))
            words.append(count)
        at += len(line) + 1
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    found, line = [], 0
    for first, end, lines in chunks(text):
        if lines >= LEAST_LINES and total[line + lines] - total[line] <= WORDS:
            found.append((line, line + lines, _key(text[first:end])))
        line += lines
    if total[-1] <= WORDS:
        return found
    upto = np.searchsorted(total, total[:-1] + WORDS, "right")  # of the run from each line
    upto = upto[upto < len(total)]
    since = np.searchsorted(total, total[1:] - WORDS, "left") - 1  # of the run up to each line
    runs = list(enumerate(upto.tolist()))
    known = set(runs)
    runs += [(a, b) for b, a in enumerate(since.tolist(), 1) if a >= 0 and (a, b) not in known]
    return found + [(a, b, text[starts[a] : ends[b - 1]]) for a, b in runs]


OCCURRENCE = "id string, mark long, at int, upto int, one long, two long"
SUSPECT = "one long, two long, passage binary"


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(id_text(F.col(key)).alias("id"), text_hash(F.col(text)).alias("mark"), F.col(text).alias("_text"))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few rows at a time, as Python objects take much more room than Arrow."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _hashes(found: list[bytes]) -> dict:
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join([xxh3_128_digest(own) for own in found]), "<i8").reshape(-1, 2)
    return {"one": both[:, 0], "two": both[:, 1]}


def _occurrences(keyed: DataFrame) -> DataFrame:
    """A row per passage: its document, first and end line, and two hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, own = [], []
        for batch in _slices(batches):
            for doc_id, mark, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch, "_text")):
                found = passages(value or b"")
                out += [(doc_id, mark, at, upto) for at, upto, _ in found]
                own.append(_hashes([passage for *_, passage in found]))
                if len(out) >= 20_000:
                    yield columns_of(out, own)
                    out, own = [], []
        if out:
            yield columns_of(out, own)

    def columns_of(out: list, own: list) -> dict:
        return dict(zip(names, zip(*out))) | {n: np.concatenate([o[n] for o in own]) for n in ("one", "two")}

    names = ("id", "mark", "at", "upto")
    return over_batches(keyed, rows, OCCURRENCE)


def _suspects(keyed: DataFrame, wanted: Staged) -> DataFrame:
    """Hashes and bytes of the ``wanted`` passages, which has those of each document."""
    texts = lookup(keyed, wanted.table, ["id", "mark"], "inner", facts_bytes=wanted.bytes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out, size = [], 0
        for batch in _slices(batches):
            for value, own in zip(text_bytes(batch, "_text"), batch.column("own").to_pylist()):
                chosen = {(o["at"], o["upto"]) for o in own}
                for at, upto, passage in passages(value or b""):
                    if (at, upto) in chosen:
                        out.append(passage)
                        size += len(passage)
                        if size > 8_000_000:
                            yield _hashes(out) | {"passage": out}
                            out, size = [], 0
        if out:
            yield _hashes(out) | {"passage": out}

    return over_batches(texts.select("_text", "own"), rows, SUSPECT)


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, mark, at, upto``: the lines to remove, by document, first and end.

    The first occurrence of a passage is that in the document with the shortest, then
    smallest id (null first), so numbers count in order; in one document the earliest.
    It stays, and so does what overlaps it.
    """
    where = F.struct(F.length("id").alias("size"), "id", "mark", "at", "upto")
    keyed = _keyed(docs, key, text)
    found = stage(_occurrences(keyed), "passages")
    hashes = ["one", "two"]
    often = stage_measured(found.groupBy(*hashes).count().where("count > 1").select(*hashes), "repeated_passages")
    suspects = stage(lookup(found, often.table, hashes, "left_semi", facts_bytes=often.bytes), "suspects")
    # Bytes are read in the documents that have suspects, and of these only.
    wanted = suspects.groupBy("id", "mark").agg(F.collect_set(F.struct("at", "upto")).alias("own"))
    read = _suspects(keyed, stage_measured(wanted, "wanted_passages"))
    same = read.groupBy(*hashes).agg((F.min("passage") == F.max("passage")).alias("same")).where("same")
    sure = stage_measured(same.select(*hashes), "sure_passages")
    again = stage(lookup(suspects, sure.table, hashes, "inner", facts_bytes=sure.bytes), "occurrences")
    first = stage_measured(again.groupBy(*hashes).agg(F.min(where).alias("first")), "first_occurrences")
    overlaps = (F.col("id") == F.col("first.id")) & (F.col("mark") == F.col("first.mark")) & (F.col("at") < F.col("first.upto"))
    later = lookup(again, first.table, hashes, "inner", facts_bytes=first.bytes).where(~overlaps)
    return later.select("id", "mark", "at", "upto").distinct()


def without_chunks(text: bytes, numbers: set[int]) -> bytes:
    """The text without those chunks; the line break before a last one goes with it."""
    found = chunks(text)
    kept = b"".join([text[first:end] for at, (first, end, _) in enumerate(found) if at not in numbers])
    if len(found) - 1 in numbers and not text.endswith(b"\n"):
        kept = kept[:-1] if kept.endswith(b"\n") else kept
    return kept


def without_lines(text: bytes, runs: Iterable[tuple[int, int]]) -> bytes:
    """The text without those lines (first, end), blank ones not counted; the blank lines
    after a line go with it, and so does the line break before a last one."""
    starts, at = [], 0
    for line in text.split(b"\n"):
        if line.strip():
            starts.append(at)
        at += len(line) + 1
    gone = np.zeros(len(starts), bool)
    for first, end in runs:
        gone[first:end] = True
    if not gone.any():
        return text
    bounds = [0, *starts[1:], len(text)]
    kept = b"".join([text[a:b] for a, b, out in zip(bounds, bounds[1:], gone.tolist()) if not out])
    if gone[-1] and not text.endswith(b"\n"):
        kept = kept[:-1] if kept.endswith(b"\n") else kept
    return kept


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: str | None = "n_chars"
) -> DataFrame:
    """``docs`` without the passages of lines that stand elsewhere before.

    A passage is any run of lines, or one line, of more than ``WORDS`` words; of shorter
    ones only whole chunks of several lines are found. Each stays once. Rows that agree in id and text are treated as one
    document and stay alike. No row is dropped: a text may become empty; null stays
    null. ``size``, if there is such a column, is set to the new number of characters.
    Other columns are kept as they are.
    """
    gone = repeated_passages(docs, key, text).groupBy("id", "mark").agg(F.collect_list(F.struct("at", "upto")).alias("gone"))
    gone = stage_measured(gone, "removals")
    row_id, row_mark, numbers = fresh_names(docs, "row_id", "row_mark", "removed")
    marked = docs.withColumns({row_id: id_text(F.col(key)), row_mark: text_hash(F.col(text))})
    found = lookup(marked, gone.table.toDF(row_id, row_mark, numbers), [row_id, row_mark], "left", facts_bytes=gone.bytes)

    @F.pandas_udf("string")
    def shorter(texts: pd.Series, removed: pd.Series) -> pd.Series:
        runs = lambda r: [(one["at"], one["upto"]) for one in r]
        return pd.Series([
            t if t is None or r is None else without_lines(t.encode("utf-8", "surrogatepass"), runs(r)).decode("utf-8", "surrogatepass")
            for t, r in zip(texts, removed)
        ])

    after = F.when(F.col(numbers).isNull(), F.col(text)).otherwise(
        shorter(F.when(F.col(numbers).isNotNull(), F.col(text)), F.col(numbers))
    )
    changed = found.withColumn(text, after)
    if size and size in docs.columns:
        kind = docs.schema[size].dataType
        changed = changed.withColumn(
            size, F.when(F.col(numbers).isNull(), F.col(size)).otherwise(F.length(text)).cast(kind)
        )
    return changed.select(*docs.columns)
