"""CSV records whose quoted fields hold line breaks, from files that are split.

Whether a line break ends a record depends on the quotes before it, back to the start
of the file. A task reads a block of lines and follows both cases, that the block starts
outside and inside a quoted field; what each block does to either is a row of a small
table, from which follows how every block starts. Records of one line, nearly all, are
then complete; only the lines of the others are shuffled, to be joined across blocks.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthlog.operators.lookup import lookup
from hearthlog.staging import stage, stage_measured

# Workers need not have this package: what they run travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LINES = "file string, block long, row long, value string"
_CASE = "struct<open: boolean, after: boolean, owner: long>"


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open behind a line, given whether one is before it.

    A field is quoted if it starts with a quote. A quote within that is neither doubled
    nor followed by a comma or the end makes the rest of the field a plain one.
    """
    at, quoted = 0, inside
    while True:
        if quoted:
            quote = line.find('"', at)
            if quote < 0:
                return True
            behind = line[quote + 1 : quote + 2]
            if behind == '"':
                at = quote + 2
                continue
            at = quote + 1
        elif line[at : at + 1] == '"':
            at, quoted = at + 1, True
            continue
        comma = line.find(",", at)
        if comma < 0:
            return False
        at, quoted = comma + 1, False


def _followed(rows: np.ndarray, lines: list[tuple[int, str]], inside: bool, owner: int):
    """Of the lines of a block in one case: whether a field is open before and behind
    each, and the row where its record starts, -1 for before the block. ``lines`` has
    those with a quote and their places; the others change nothing."""
    before, start = np.empty(len(rows), bool), 0
    for place, line in lines:
        before[start : place + 1] = inside
        inside, start = open_after(line, inside), place + 1
    before[start:] = inside
    behind = np.append(before[1:], inside)
    owners = np.maximum.accumulate(np.append(owner, np.where(before, -1, rows)))[1:]
    return before, behind, owners


def _with_cases(lines: DataFrame) -> DataFrame:
    """Add ``outside`` and ``inside``: the line if its block starts so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            files, blocks, rows = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            marked = pc.fill_null(pc.match_substring(batch.column(3), '"'), False).to_numpy(zero_copy_only=False)
            quoted = [(i, batch.column(3)[i].as_py()) for i in np.flatnonzero(marked).tolist()]
            cuts = [i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]]
            parts = []
            for first, last in zip([0, *cuts], [*cuts, len(files)]):
                if (files[first], blocks[first]) != key:
                    key, state = (files[first], blocks[first]), [(False, -1), (True, -1)]
                own = [(i - first, line) for i, line in quoted if first <= i < last]
                found = [_followed(rows[first:last], own, inside, owner) for inside, owner in state]
                state = [(bool(behind[-1]), int(owners[-1])) for _, behind, owners in found]
                parts.append(found)
            cases = [
                pa.StructArray.from_arrays([pa.array(np.concatenate([p[case][i] for p in parts])) for i in range(3)], ["open", "after", "owner"])
                for case in range(2)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cases], ["file", "block", "row", "value", "outside", "inside"])

    return lines.mapInArrow(run, f"{_LINES}, outside {_CASE}, inside {_CASE}")


def _starts(lines: DataFrame) -> DataFrame:
    """``file, block, starts_inside, from_block, from_row``: how each block starts, and
    where the record that is open there does."""
    last = lambda case: F.max_by(case, "row").alias(case)
    ends = lines.groupBy("file", "block").agg(last("outside"), last("inside"))
    listed = ends.select("file", "block", *[F.col(f"{case}.{part}").alias(f"{case}_{part}") for case in ("outside", "inside") for part in ("after", "owner")])

    def follow(blocks: pd.DataFrame) -> pd.DataFrame:
        inside, place, rows = False, (-1, -1), []
        for b in blocks.sort_values("block").itertuples():
            rows.append((b.file, b.block, inside, *place))
            after, owner = (b.inside_after, b.inside_owner) if inside else (b.outside_after, b.outside_owner)
            inside, place = bool(after), (b.block, owner) if owner >= 0 else place
        return pd.DataFrame(rows, columns=["file", "block", "starts_inside", "from_block", "from_row"])

    # A group has a row for each block of a file.
    return listed.groupBy("file").applyInPandas(follow, "file string, block long, starts_inside boolean, from_block long, from_row long")


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """``input_file, input_block, input_row, record``: the records of CSV files, with the
    place of their first line. Lines end with a line feed, with or without a carriage
    return before it; empty ones between records are none. A quote that is never closed
    makes the rest of its file one record."""
    text = spark.read.option("lineSep", "\n").text(path)
    placed = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    # Written once: the blocks must be the same in the steps that follow.
    lines = stage(_with_cases(placed), "lines")
    starts = stage_measured(_starts(lines), "block_starts")
    case = F.when(F.col("starts_inside"), F.col("inside")).otherwise(F.col("outside"))
    known = lookup(lines, starts.table, ["file", "block"], "inner", facts_bytes=starts.bytes).withColumn("case", case)
    alone = ~F.col("case.open") & ~F.col("case.after")
    whole = known.where(alone).select("file", "block", "row", "value")
    here = F.col("case.owner") >= 0
    parts = known.where(~alone).select(
        "file",
        F.when(here, F.col("block")).otherwise(F.col("from_block")).alias("of_block"),
        F.when(here, F.col("case.owner")).otherwise(F.col("from_row")).alias("of_row"),
        F.struct("block", "row", "value").alias("line"),
    )
    # A group is one record.
    ordered = F.transform(F.sort_array(F.collect_list("line")), lambda line: line["value"])
    joined = parts.groupBy("file", F.col("of_block").alias("block"), F.col("of_row").alias("row")).agg(F.array_join(ordered, "\n").alias("value"))
    record = F.regexp_replace("value", "\r$", "")
    records = whole.unionByName(joined).select(
        F.col("file").alias("input_file"), F.col("block").alias("input_block"), F.col("row").alias("input_row"), record.alias("record")
    )
    return records.where("record != ''")
