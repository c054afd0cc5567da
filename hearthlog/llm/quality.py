"""Document quality by ordinal regression on graded ratings.

A cumulative-link model: one weight for each hashed feature of a text, shared by all
grades, and ordered thresholds between them; the chance of grade k or less is
sigmoid(threshold_k - score). From it follow the expected grade and the chance of the
best one, by which documents are selected.
"""

import re
import sys
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import bound_batches, bounded_sample, fresh_names, letter_words, over_batches, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSIONS = 1 << 22
SAMPLE = 10_000  # rated documents that the model is fitted on
LEAST_CHANCE = 0.5  # of the best grade, for a document to stay
ROUNDS, SHRINK = 100, 0.3
LEAST_EVIDENCE = 12.0  # that a feature tells the grades apart, for it to get a weight
MARKS = re.compile(rb"[!-/:-@\[-`{-~]+")
MOST_WORDS_KEPT = 500_000  # of a task's memory of word features


class Model(NamedTuple):
    weights: dict[int, float]  # of the features that have one
    thresholds: np.ndarray  # rising; one fewer than grades


def _bin(share: float) -> int:
    return int(np.log2(1 + 1000 * share))


def _slot(kind: bytes, value: bytes) -> int:
    return zlib.crc32(kind + value) % DIMENSIONS


def style(text: bytes) -> set[bytes]:
    """What the text is like beside its words."""
    size = max(len(text), 1)
    marks = MARKS.findall(text)
    found = {b"run" + m for m in marks if 1 < len(m) < 9}
    counts: dict[bytes, int] = {}
    for mark in marks:
        counts[mark[:1]] = counts.get(mark[:1], 0) + 1
    found |= {b"mark%b%d" % (m, _bin(n / size)) for m, n in counts.items()}
    capitals = size - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = size - len(text.translate(None, b"0123456789"))
    lines = text.split(b"\n")
    found.add(b"capitals%d" % _bin(capitals / size))
    found.add(b"digits%d" % _bin(digits / size))
    found.add(b"repeats%d" % _bin(1 - len(set(lines)) / len(lines)))
    found.add(b"size%d" % len(text).bit_length())
    words = text.split()
    found.add(b"variety%d" % (8 * len(set(words)) // max(len(words), 1)))
    return found


class Slots(dict):
    """The feature number of a word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS_KEPT:
            self.clear()
        self[word] = slot = _slot(b"w", word)
        return slot


def feature_slots(text: bytes, slots: Slots) -> np.ndarray:
    """Numbers of the features that a text has, each once."""
    words = [slots[w] for w in set(letter_words(text))]
    return np.unique(np.array(words + [_slot(b"s", s) for s in style(text)], dtype=np.int32))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _loss(at: np.ndarray, grades: np.ndarray, rows: np.ndarray, columns: np.ndarray, levels: int):
    """Penalised negative log likelihood and its slope. ``at`` holds the first
    threshold, the logs of the steps to the next ones, and the weights."""
    edge = levels - 1
    weights, steps = at[edge:], np.exp(at[1:edge])
    limits = np.cumsum([at[0], *steps])
    score = np.bincount(rows, weights[columns], len(grades))
    padded = np.concatenate([[-np.inf], limits, [np.inf]])
    high, low = _sigmoid(padded[grades + 1] - score), _sigmoid(padded[grades] - score)
    high[grades == edge], low[grades == 0] = 1.0, 0.0
    chance = np.maximum(high - low, 1e-12)
    up, down = high * (1 - high) / chance, low * (1 - low) / chance
    by_limit = np.zeros(edge)
    np.add.at(by_limit, grades[grades < edge], -up[grades < edge])
    np.add.at(by_limit, grades[grades > 0] - 1, down[grades > 0])
    tails = np.cumsum(by_limit[::-1])[::-1]
    by_weight = np.bincount(columns, (up - down)[rows], len(weights)) + SHRINK * weights
    loss = -np.log(chance).sum() + SHRINK / 2 * (weights**2).sum()
    return loss, np.concatenate([tails[:1], tails[1:] * steps, by_weight])


def _descend(at: np.ndarray, loss) -> np.ndarray:
    """Limited-memory BFGS with a step that is halved until the loss falls."""
    value, slope = loss(at)
    memory: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        way, used = -slope, []
        for moved, turned in reversed(memory):
            used.append(moved @ way / (moved @ turned))
            way = way - used[-1] * turned
        if memory:
            moved, turned = memory[-1]
            way = way * (moved @ turned) / (turned @ turned)
        for (moved, turned), part in zip(memory, reversed(used)):
            way = way + moved * (part - turned @ way / (moved @ turned))
        step = 1.0 if memory else 1.0 / max(np.abs(slope).sum(), 1e-9)
        while step > 1e-10:
            following, new = loss(at + step * way)
            if following <= value + 1e-4 * step * (slope @ way):
                break
            step /= 2
        else:
            break
        moved, turned = step * way, new - slope
        if moved @ turned > 1e-12:
            memory = [*memory[-9:], (moved, turned)]
        done = value - following < 1e-7 * abs(value)
        at, value, slope = at + moved, following, new
        if done:
            break
    return at


def _evidence(columns: np.ndarray, best: np.ndarray, share: float) -> np.ndarray:
    """Log-likelihood ratio of each feature whose rows get the best grade less often than
    others. Features in favour have none: in long texts common words would outvote a fault."""
    good = np.bincount(columns[best], minlength=DIMENSIONS).astype(float)
    bad = np.bincount(columns[~best], minlength=DIMENSIONS).astype(float)
    part = lambda n, p: np.where(n > 0, n * np.log(np.maximum(n, 1) / np.maximum((good + bad) * p, 1e-9)), 0.0)
    against = bad > (good + bad) * (1 - share)
    return np.where(against, 2 * (part(good, share) + part(bad, 1 - share)), 0.0)


def fit_ordinal(slots: list[np.ndarray], grades: np.ndarray) -> Model:
    """Weights and thresholds of least loss; features that tell nothing have no weight.

    Grades count from 0; those that no row has get no room between thresholds.
    """
    levels = int(grades.max()) + 1 if len(grades) else 1
    if levels == 1:
        return Model({}, np.empty(0))
    sizes = np.array([len(s) for s in slots], dtype=np.int64)
    columns, rows = np.concatenate(slots), np.repeat(np.arange(len(slots)), sizes)
    telling = _evidence(columns, grades[rows] == levels - 1, (grades == levels - 1).mean()) >= LEAST_EVIDENCE
    rows, columns = rows[telling[columns]], columns[telling[columns]]
    used, columns = np.unique(columns, return_inverse=True)
    below = np.array([(grades <= k).mean() for k in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    cut = np.log(below / (1 - below))
    start = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-2)), np.zeros(len(used))])
    at = _descend(start, lambda x: _loss(x, grades, rows, columns, levels))
    return Model(dict(zip(used.tolist(), at[levels - 1 :].tolist())), np.cumsum([at[0], *np.exp(at[1 : levels - 1])]))


def score_of(slots: np.ndarray, model: Model) -> float:
    return sum(model.weights.get(s, 0.0) for s in slots.tolist())


def judge(score: float, model: Model) -> tuple[float, float]:
    """Expected grade, and the chance of the best grade."""
    over = 1 - _sigmoid(model.thresholds - score)
    return float(over.sum()), float(over[-1]) if len(over) else 1.0


def grade(quality: Column, toxic: Column) -> Column:
    """2 for good prose that is not toxic, one less for each fault; null if a mark is."""
    return (F.lit(1) + quality - toxic).cast("int")


def fit_quality(
    docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text"
) -> Model:
    """Fit on at most ``sample`` rated documents, chosen by a hash of their ids.

    ``ratings`` has ``doc_id, grade``. A document with several ratings counts with the
    lowest, an id with several texts with the first of them in their order; null ids and
    grades do not count.
    """
    graded = ratings.dropna(subset=["doc_id", "grade"]).groupBy("doc_id").agg(F.min("grade").alias("_grade"))
    rated = bounded_sample(graded, sample, "doc_id").withColumnRenamed("doc_id", "_rated")
    # The sample's size is a parameter.
    texts = docs.select(F.col(key).alias("_rated"), F.col(text).alias("_text")).join(F.broadcast(rated), "_rated")
    # One row for each id, whatever its rows are: the ratings bound what is collected.
    chosen = texts.groupBy("_rated").agg(F.first("_grade").alias("_grade"), F.min("_text").alias("_text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        slots = Slots()
        for batch in batches:
            texts = text_bytes(batch, "_text")
            if texts:
                yield {"grade": batch.column(1).cast(pa.int32()), "slots": [feature_slots(t or b"", slots).tobytes() for t in texts]}

    found = over_batches(chosen.select("_text", "_grade"), rows, "grade int, slots binary").collect()
    found.sort(key=lambda r: (r["grade"], bytes(r["slots"])))  # the order of partitions must not count
    return fit_ordinal([np.frombuffer(r["slots"], np.int32) for r in found], np.array([r["grade"] for r in found], dtype=np.int64))


def with_quality(
    docs: DataFrame, model: Model, grade_name: str = "expected_grade", chance_name: str = "top_chance", text: str = "text"
) -> DataFrame:
    """``docs`` with the expected grade and the chance of the best one; a null text is
    an empty one, and all other columns are kept."""
    bound_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        import pandas as pd

        model, slots = shared.value, Slots()
        for texts in batches:
            found = [
                judge(score_of(feature_slots((t or "").encode("utf-8", "surrogatepass"), slots), model), model)
                for t in texts
            ]
            yield pd.DataFrame(found, columns=["expected", "chance"], dtype=float)

    import pandas as pd

    scored.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    # Not to be copied into a filter on the chance, which would run the model twice.
    judged = F.pandas_udf(scored, "expected double, chance double").asNondeterministic()
    [name] = fresh_names(docs, "judged")
    found = docs.withColumn(name, judged(F.col(text)))
    return found.withColumns({grade_name: F.col(f"{name}.expected"), chance_name: F.col(f"{name}.chance")}).drop(name)


def select_quality(
    docs: DataFrame, ratings: DataFrame, least_chance: float = LEAST_CHANCE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` whose chance of the best grade is at least ``least_chance``, with their
    columns only. Without ratings of several grades all documents stay."""
    names = fresh_names(docs, "expected_grade", "top_chance")
    scored = with_quality(docs, fit_quality(docs, ratings, key=key, text=text), *names, text=text)
    return scored.where(F.col(names[1]) >= least_chance).select(*docs.columns)
