"""What the operators share: words, row keys and tasks over Arrow batches."""

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.operators.lookup import lookup
from hearthlog.staging import Staged

# Workers need not have this package: what they run travels with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCH_BYTES = 4_000_000  # of rows that a Python worker is sent at a time

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def letter_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, with A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def text_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a text column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def kept_by_worker(name: str, make: Callable):
    """A value that a Python worker makes once and keeps for its later tasks."""
    holder = sys.modules.setdefault("_hearthlog_worker", types.ModuleType("_hearthlog_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def bound_batches(df: DataFrame) -> None:
    """Arrow batches of the session end at ``BATCH_BYTES``, unless it has a bound of its
    own. Spark's 10,000 rows are a few megabytes of ids and many of long texts, which the
    executor and its workers hold several times over."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))


def over_batches(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator], schema: str):
    """``mapInArrow``, where ``rows`` yields dictionaries of columns."""
    bound_batches(df)
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, fields)


def _arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def text_hash(text: Column) -> Column:
    """With the document's id, the key of a row: rows that agree in both are the same.

    A null text counts as an empty one.
    """
    return F.xxhash64(F.coalesce(text, F.lit("")))


def id_text(key: Column) -> Column:
    """An id as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as tell them from the table's own."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


def bounded_sample(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The ``n`` rows, or all if there are fewer, with the smallest hashes of the columns
    ``by``, which should tell the rows apart.

    A cut at the hash that a few more rows than ``n`` stay below keeps tasks from
    sending ``n`` rows each. It is wide enough that fewer stay in no practical case.
    """
    total = df.count()
    hashed = F.xxhash64(F.lit(11), *by)
    share = min(1.0, (n + 8 * n**0.5 + 64) / max(total, 1))
    below = hashed <= F.lit(int(-(2**63) + share * (2**64 - 1))).cast("long") if share < 1 else F.lit(True)
    return df.where(below).orderBy(hashed, *by).limit(n)


def in_blocks(
    rows: DataFrame, group: list[str], counts: Staged, spread: str, visitor: Column | None = None
) -> DataFrame:
    """Add ``block``: large groups in parts, such that any two of a group meet in one.

    ``counts`` has the number of ``blocks`` of the large groups, from ``spread`` comes
    the share that a row belongs to. A row goes to a block for each pair of its own
    share with another one, a visitor, which need not meet other visitors, to every
    share's own block. No block holds more than two shares.
    """
    visitor = F.lit(False) if visitor is None else visitor
    n = F.coalesce("blocks", F.lit(1))
    share = F.pmod(F.xxhash64(spread), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda q: F.least(share, q) * n + F.greatest(share, q))
    everywhere = F.transform(F.sequence(F.lit(0), n - 1), lambda q: q * n + q)
    joined = lookup(rows, counts.table, group, "left", facts_bytes=counts.bytes)
    blocks = F.when(n == 1, F.array(F.lit(0))).when(visitor, everywhere).otherwise(pairs)
    return joined.withColumn("block", F.explode(blocks)).drop("blocks")
