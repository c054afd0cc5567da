"""Documents rearranged for fill-in-the-middle training, cut between lines.

Where the k-th line of a text ends comes from a learned index of its boundaries: straight
pieces that are nowhere more than ``ERROR`` characters off predict the offset, and the
stored residual corrects it exactly. The pieces are grown line by line, as long as one
slope fits all of their boundaries. They are in whole numbers, so that what Python fits
and what Spark evaluates agree bit by bit.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import fresh_names

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 7
FIM_PERCENT, SPM_PERCENT = 100, 50
ERROR = 100  # characters that a piece may be off
SHIFT = 16  # slopes are in units of 2^-16 characters a line
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

INDEX = "n int, firsts array<int>, offsets array<int>, slopes array<long>, residuals array<int>"


def boundaries(text: str) -> np.ndarray:
    """Where the lines of a text end, in characters, from 0 for the start on. A line
    ends behind its line feed; the last one need not have any."""
    lines = text.split("\n")
    ends = np.cumsum([0, *[len(line) + 1 for line in lines]])
    ends[-1] -= 1
    return ends if lines[-1] else ends[:-1]


def fit_pieces(ends: np.ndarray, error: int = ERROR) -> tuple[list[int], list[int], list[int]]:
    """First rank, offset there and slope of each straight piece: the slopes that keep
    within ``error`` of all boundaries of a piece narrow to a cone until none is left."""
    firsts, offsets, slopes = [], [], []
    values, rank, n = ends.tolist(), 0, len(ends)
    while rank < n:
        start, first = values[rank], rank
        least, most = 0.0, float("inf")
        rank += 1
        while rank < n:
            run, rise = rank - first, values[rank] - start
            low, high = (rise - error) / run, (rise + error) / run
            if low > most or high < least:
                break
            least, most = max(least, low), min(most, high)
            rank += 1
        firsts.append(first)
        offsets.append(start)
        slopes.append(0 if most == float("inf") else round((least + most) / 2 * (1 << SHIFT)))
    return firsts, offsets, slopes


def predicted(ranks: np.ndarray, firsts: list[int], offsets: list[int], slopes: list[int]) -> np.ndarray:
    piece = np.searchsorted(np.array(firsts), ranks, side="right") - 1
    rise = np.array(slopes, np.int64)[piece] * (ranks - np.array(firsts, np.int64)[piece])
    return np.array(offsets, np.int64)[piece] + (rise >> SHIFT)


def boundary_index(text: Column, error: int = ERROR) -> Column:
    """``n, firsts, offsets, slopes, residuals``: the lines of a text, the pieces, and what
    each of the ``n + 1`` boundaries lies off. A null text is an empty one."""

    def fitted(batches: Iterator) -> Iterator:
        for texts in batches:
            rows = []
            for one in texts:
                ends = boundaries(one or "")
                pieces = fit_pieces(ends, error)
                off = ends - predicted(np.arange(len(ends)), *pieces)
                rows.append((len(ends) - 1, *pieces, off.tolist()))
            yield pd.DataFrame(rows, columns=["n", "firsts", "offsets", "slopes", "residuals"])

    fitted.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Not to be copied into each expression that reads it.
    return F.pandas_udf(fitted, INDEX).asNondeterministic()(text)


def offset_at(index: Column, rank: Column) -> Column:
    """The offset of a boundary by its rank, from 0: predicted, then corrected."""
    piece = F.size(F.filter(index["firsts"], lambda first: first <= rank)) - 1
    rise = F.get(index["slopes"], piece) * (rank - F.get(index["firsts"], piece)).cast("long")
    off = F.get(index["residuals"], rank.cast("int"))
    return (F.get(index["offsets"], piece).cast("long") + F.shiftright(rise, SHIFT) + off).cast("long")


def drawn(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 for a document, from its id; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""

    def between(start: str, end: str | None) -> Column:
        rest = F.substring(output, F.locate(start, output) + len(start), F.length(output))
        return F.substring_index(rest, end, 1) if end else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
    error: int = ERROR,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, pieces, output``: a row per row of
    ``docs``.

    A text of ``n`` lines is cut behind two of its boundaries, drawn from the hash of its
    id, into prefix, middle and suffix. In form ``psm`` the output is ``<P>`` prefix
    ``<S>`` suffix ``<M>`` middle, in form ``spm`` ``<S>`` suffix ``<P>`` prefix ``<M>``
    middle. Form ``plain`` leaves the text as it is: an empty one, one that holds a mark,
    and those that are not drawn; it has no cuts (null). ``pieces`` is the number of
    straight pieces of the boundary index.

    A null text is an empty one, a null id is hashed as an empty one. Rows that repeat
    are rows of their own, other columns are not read.
    """
    kept, index = fresh_names(docs.select(F.col(key).alias("doc_id")), "text", "index")
    chosen = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias(kept))
    indexed = chosen.withColumn(index, boundary_index(F.col(kept), error))
    one, two, three, four = drawn(F.col("doc_id"), seed)
    n = F.col(f"{index}.n")
    first, second = F.pmod(one, n + 1), F.pmod(two, n + 1)
    marked = F.col(kept).contains(PREFIX) | F.col(kept).contains(SUFFIX) | F.col(kept).contains(MIDDLE)
    plain = (F.col(kept) == "") | marked | (F.pmod(three, F.lit(100)) >= fim_percent)
    form = F.when(plain, F.lit("plain")).when(F.pmod(four, F.lit(100)) < spm_percent, F.lit("spm")).otherwise(F.lit("psm"))
    cut = indexed.select(
        "doc_id",
        kept,
        n.cast("long").alias("n"),
        form.alias("form"),
        F.size(f"{index}.firsts").alias("pieces"),
        offset_at(F.col(index), F.least(first, second)).alias("_cut"),
        offset_at(F.col(index), F.greatest(first, second)).alias("_end"),
    )
    plain = F.col("form") == "plain"
    start, end = F.col("_cut").cast("int"), F.col("_end").cast("int")
    prefix = F.substring(F.col(kept), F.lit(1), start)
    middle = F.substring(F.col(kept), start + 1, end - start)
    suffix = F.substring(F.col(kept), end + 1, F.length(kept))
    parts = {"psm": (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), "spm": (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)}
    output = F.col(kept)
    for name, listed in parts.items():
        joined = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in listed])
        output = F.when(F.col("form") == name, joined).otherwise(output)
    return cut.select(
        "doc_id",
        "n",
        "form",
        F.when(~plain, F.col("_cut")).alias("prefix_chars"),
        F.when(~plain, F.col("_end") - F.col("_cut")).alias("middle_chars"),
        "pieces",
        output.alias("output"),
    )
