"""Personal data in texts: rules that always count, and scored candidates.

High-recall generators propose spans that may overlap. Boosted trees judge each by its
format and its surroundings; they are trained on candidates of the corpus itself,
where those that a rule confirms are the examples, some of them rewritten the way
people write around rules. Calibrated thresholds choose what to redact. Trees,
calibration and thresholds come from all candidates, by sums that Spark takes.
"""

import re
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthlog.llm.boosting import BINS, Binned, Fitted, Trees, bins_of, fit_trees_over, log_odds, odds_of_steps, with_cuts
from hearthlog.llm.common import over_batches
from hearthlog.staging import stage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

EVEN_WEIGHT = 4_000  # of each kind and class in the trees, where more share it evenly
PRECISION = 0.99  # that a threshold must reach on candidates held out
LEAST_CHANCE = 0.9  # below it nothing is redacted, whatever the threshold
LEAST_EXAMPLES = 20  # of each class in the corpus, else nothing is added
FOLDS = 4  # a candidate is judged by trees that three of them fit, without its own
HELD_VECTORS = 50_000  # so many different features at most are passed over by the driver

# Generators, each with the kind it proposes.
WRITTEN_OUT = re.compile(r"[A-Za-z0-9._+-]{2,64} ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{2,64}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}){1,3}")
DIGITS = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[ ().-]{0,2}[0-9]){6,24}(?![A-Za-z0-9])")
CUES = (
    ("mail", "contact", "write", "@"),
    ("ip", "host", "server", "address"),
    ("card", "visa", "credit", "payment"),
    ("phone", "tel", "call", "mobile", "fax"),
)


class Span(NamedTuple):
    kind: int
    start: int
    end: int


def passes_luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> list[Span]:
    """Matches of the pattern, looked for around each at sign only."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_PART:
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            found.append(Span(0, start, match.end()))
            end = match.end()
        at = text.find("@", max(at + 1, end))
    return found


def rule_spans(text: str) -> list[Span]:
    """What the rules find: by kind, then by start; matches of one kind do not overlap."""
    found = _emails(text) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in [p.lstrip("0") for p in m[0].split(".")]):
            found.append(Span(1, *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and passes_luhn(digits):
            found.append(Span(2, *m.span()))
    if "+" in text:
        found += [Span(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def features(text: str, start: int, end: int) -> tuple[float, ...]:
    """Format of a span, and what stands around it."""
    span, digits = text[start:end], _digits(text[start:end])
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    before, after = text[max(0, start - 24) : start].lower(), text[end : end + 2]
    return (
        len(span), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1],
        span.count("."), span.count("-"), span.count(" "), span.count("(") + span.count(")"),
        float(span[0] == "+"), float("@" in span), float("at)" in span or "at]" in span),
        float(bool(digits) and passes_luhn(digits)), max([int(g) for g in re.findall(r"[0-9]{1,9}", span)] or [0]) > 255,
        len(set(digits)), float(before[-1:].isalnum()), float(after[:1].isalnum()),
        *[float(any(cue in before for cue in cues)) for cues in CUES],
    )


def proposals(text: str) -> list[Span]:
    """Spans of the generators; they may overlap the rules' and each other."""
    found = [Span(0, *m.span()) for m in WRITTEN_OUT.finditer(text)] if "@" in text or "at)" in text or "at]" in text else []
    for m in DIGITS.finditer(text):
        n = len(_digits(m[0]))
        kind = 1 if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", m[0]) else 2 if n > 15 else 3
        found.append(Span(kind, *m.span()))
    return found


def rewritten(text: str, span: Span) -> tuple[float, ...] | None:
    """Features of a confirmed span as people write it around rules."""
    own = text[span.start : span.end]
    other = own.replace("@", " (at) ") if span.kind == 0 else re.sub(r"^\+[0-9]{1,3}[ .-]?", "", own) if span.kind == 3 else own
    if other == own or len(_digits(other)) < 7 and span.kind == 3:
        return None
    changed = text[max(0, span.start - 24) : span.start]
    return features(changed + other + text[span.end : span.end + 2], len(changed), len(changed) + len(other))


FOUND = (
    "doc_id {key}, _base array<struct<kind: int, start: int, end: int>>,"
    " _more array<struct<kind: int, start: int, end: int, features: array<float>, confirmed: boolean, drill: boolean>>"
)


class Covered:
    """The union of spans, as disjoint stretches in order."""

    def __init__(self, spans: Iterable[Span] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for span in sorted(spans, key=lambda s: s.start):
            if self.ends and span.start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], span.end)
            else:
                self.starts.append(span.start)
                self.ends.append(span.end)

    def meets(self, span: Span) -> bool:
        at = bisect_right(self.ends, span.start)
        return at < len(self.starts) and self.starts[at] < span.end

    def add(self, span: Span) -> None:
        """A span that meets none."""
        at = bisect_right(self.starts, span.start)
        self.starts.insert(at, span.start)
        self.ends.insert(at, span.end)


def _look(text: str) -> tuple[list[dict], list[dict]]:
    base, more = rule_spans(text), []
    of_kind = [Covered(b for b in base if b.kind == kind) for kind in range(len(KINDS))]
    for span in proposals(text):
        sure = of_kind[span.kind].meets(span)
        more.append(span._asdict() | {"features": features(text, span.start, span.end), "confirmed": sure, "drill": False})
    for span in base:
        if drill := rewritten(text, span):
            more.append(span._asdict() | {"features": drill, "confirmed": True, "drill": True})
    return [b._asdict() for b in base], more


class Judge(NamedTuple):
    """The trees of a kind, by fold, and the least log odds to redact at; no kind without
    enough examples."""

    trees: dict[int, dict[int, Trees]]
    limits: dict[int, float]


def _cuts(vectors: DataFrame, weights: dict[tuple[int, bool], float], features: int) -> list[np.ndarray]:
    """The values of each feature below which a whole number of 32nds of the weight lies,
    over all ``vectors``. They are counted as whole numbers per class, so their order
    changes nothing; a feature has no more values than the longest text has characters."""
    classes = sorted(weights)
    values = vectors.select("kind", "confirmed", "n", F.posexplode("features").alias("f", "value")).groupBy("f", "value")
    own = [F.sum(F.when((F.col("kind") == k) & (F.col("confirmed") == sure), F.col("n")).otherwise(0)) for k, sure in classes]
    counted = values.agg(*[c.alias(f"n{i}") for i, c in enumerate(own)])
    up_to = Window.partitionBy("f").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("f")

    def weighed(part: Callable[[int], Column]) -> Column:
        return sum((part(i) * F.lit(weights[c]) for i, c in enumerate(classes)), start=F.lit(0.0))

    below = weighed(lambda i: F.sum(f"n{i}").over(up_to))
    before = weighed(lambda i: F.sum(f"n{i}").over(up_to) - F.col(f"n{i}"))
    total = weighed(lambda i: F.sum(f"n{i}").over(whole))
    part = counted.select("f", "value", F.floor(below * BINS / total).alias("to"), F.floor(before * BINS / total).alias("from"))
    found: list[list[float]] = [[] for _ in range(features)]
    for r in part.where((F.col("to") > F.col("from")) & (F.col("from") < BINS - 1)).collect():  # 31 a feature at most
        found[r["f"]].append(r["value"])
    return [np.array(sorted(own)) for own in found]


def _limit(fitted: Fitted) -> float | None:
    """The least log odds at which the precision still holds, over all candidates."""
    odds = odds_of_steps(fitted.models[0], fitted.step)
    order = np.argsort(-odds, kind="stable")
    last = np.append(odds[order][1:] != odds[order][:-1], True) if len(odds) else np.zeros(0, bool)
    n = fitted.n[order]
    right, all_ = np.cumsum(n * fitted.yes[order])[last], np.cumsum(n)[last]
    precise = np.flatnonzero(right >= PRECISION * all_)
    return float(odds[order][last][precise[-1]]) if len(precise) else None


def fit_judge(candidates: DataFrame, held_vectors: int = HELD_VECTORS) -> Judge:
    """The judge of all ``candidates``, with ``kind, features, confirmed, fold``.

    Confirmed ones are examples of their kind and counterexamples of the others. Rows
    weigh so that a kind and class with very many has no more say in the trees than one
    with few; the precision of a threshold counts candidates as they are. Equal candidates
    are passed over as one, with their number: by Spark, a pass for each level of the
    trees, or by the driver where no more than ``held_vectors`` differ."""
    grouped = candidates.groupBy("kind", "confirmed", "fold", "features").agg(F.count("*").alias("n"))
    vectors = stage(grouped, "vectors")
    of_class = vectors.groupBy("kind", "confirmed").agg(F.sum("n"), F.count("*")).collect()  # eight at most
    counts = {(r[0], r[1]): r[2] for r in of_class}
    labels = []
    for kind in range(len(KINDS)):
        examples = counts.get((kind, True), 0)
        if min(examples, sum(counts.values()) - examples) >= LEAST_EXAMPLES:
            labels.append(kind)
    if not labels:
        return Judge({}, {})
    weights = {c: min(1.0, EVEN_WEIGHT / n) for c, n in counts.items()}
    features = len(vectors.select("features").first()[0])
    cuts = _cuts(vectors, weights, features)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if batch.num_rows:
                bins = bins_of(batch.column(0).flatten().to_numpy().reshape(-1, features), cuts)
                starts = np.arange(batch.num_rows + 1, dtype=np.int32) * features
                columns = dict(zip(("kind", "confirmed", "fold", "n"), batch.columns[1:]))
                yield columns | {"bins": pa.ListArray.from_arrays(starts, pa.array(bins.T.ravel()))}

    schema = "kind int, confirmed boolean, fold int, bins array<tinyint>, n bigint"
    alike = over_batches(vectors.select("features", "kind", "confirmed", "fold", "n"), binned, schema)
    alike = alike.groupBy("kind", "confirmed", "fold", "bins").agg(F.sum("n").alias("n"))
    weight = F.lit(0.0)
    for (kind, sure), w in weights.items():
        weight = F.when((F.col("kind") == kind) & (F.col("confirmed") == sure), F.lit(w)).otherwise(weight)
    label = F.when(F.col("confirmed"), F.col("kind")).otherwise(-1).alias("label")
    table = stage(alike.select("bins", label, "fold", (weight * F.col("n")).alias("weight"), "n"), "binned")
    held = table.toArrow() if sum(r[3] for r in of_class) <= held_vectors else None
    trees, limits = {}, {}
    for kind, found in zip(labels, fit_trees_over(Binned(table, features, held), labels, FOLDS)):
        limit = _limit(found)
        if limit is not None:
            trees[kind] = {fold: with_cuts(m, cuts) for fold, m in found.models.items()}
            limits[kind] = max(float(np.log(LEAST_CHANCE / (1 - LEAST_CHANCE))), limit)
    return Judge(trees, limits)


def choose(base: list[Span], more: list[Span], chances: list[float]) -> list[Span]:
    """The rules' spans, and the likeliest candidates that overlap nothing chosen."""
    chosen, covered = list(base), Covered(base)
    for span, _ in sorted(zip(more, chances), key=lambda e: (-e[1], e[0])):
        if not covered.meets(span):
            covered.add(span)
            chosen.append(span)
    return sorted(chosen)


def sampled(candidates: DataFrame, each: int) -> list[tuple[int, list[float], bool, float]]:
    """``(kind, features, confirmed, weight)`` of at most ``each`` candidates of every kind
    and class, those with the smallest hashes of their places: a rare kind has all of its
    own, however many the others are. For looking at them: the judge is fitted on all."""
    of = ["kind", "confirmed"]
    counts = {tuple(r[:2]): r[2] for r in candidates.groupBy(*of).agg(F.count("*")).collect()}  # eight at most
    hashed = F.xxhash64(F.lit(11), "by")
    taken = F.lit(False)
    for (kind, sure), n in counts.items():
        # A few more than needed lie below the cut, so that fewer stay in no practical case.
        share = (each + 8 * each**0.5 + 64) / n
        below = F.lit(True) if share >= 1 else hashed <= F.lit(int(-(2**63) + share * (2**64 - 1))).cast("long")
        taken = taken | ((F.col("kind") == kind) & (F.col("confirmed") == sure) & below)
    rows = candidates.where(taken).select(*of, "features", hashed.alias("hash"), "by").collect()
    found, used = [], dict.fromkeys(counts, 0)
    for r in sorted(rows, key=lambda r: (r["hash"], tuple(r["by"]))):
        own = (r["kind"], r["confirmed"])
        if used[own] < each:
            used[own] += 1
            found.append(r)
    return [(r["kind"], r["features"], r["confirmed"], counts[r["kind"], r["confirmed"]] / used[r["kind"], r["confirmed"]]) for r in found]


RESULT = "doc_id {key}, base array<struct<kind: string, start: int, end: int>>, spans array<struct<kind: string, start: int, end: int>>"


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans``: a row per row of ``docs``.

    ``base`` are the rules' spans and ``spans`` all of them, by kind and start, in code
    points with the end excluded. Rules of different kinds may overlap; added spans
    overlap nothing. A null text is an empty one. Other columns are not read. Where the
    corpus has too few examples of a kind, nothing is added to the rules.
    """
    kind_of_key = docs.schema[key].dataType.simpleString()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = [_look(t or "") for t in batch.column(1).to_pylist()]
            if found:
                yield {"doc_id": batch.column(0).to_pylist(), "_base": [b for b, _ in found], "_more": [m for _, m in found]}

    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    seen = stage(over_batches(chosen, look, FOUND.format(key=kind_of_key)), "candidates")
    # A document's candidates, and what is rewritten of them, are of one fold.
    seen = seen.withColumn("_fold", F.pmod(F.xxhash64(F.lit(11), "doc_id", "_more"), F.lit(FOLDS)).cast("int"))
    candidates = seen.select("_fold", F.explode("_more").alias("c"))
    judge = fit_judge(candidates.select("c.kind", "c.features", "c.confirmed", F.col("_fold").alias("fold")))

    def spans(rows) -> list[dict]:
        return [{"kind": KINDS[s.kind], "start": s.start, "end": s.end} for s in rows]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {"doc_id": batch.column(0).to_pylist(), "base": [], "spans": []}
            for base, more, fold in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                base = [Span(**b) for b in base]
                open_ = [m for m in more if not m["drill"] and not m["confirmed"] and m["kind"] in judge.trees]
                likely, chances = [], []
                for kind in {m["kind"] for m in open_}:
                    own = [m for m in open_ if m["kind"] == kind]
                    odds = log_odds(judge.trees[kind][fold], np.array([m["features"] for m in own], dtype=float))
                    for m, p in zip(own, odds):
                        if p >= judge.limits[kind]:
                            likely.append(Span(m["kind"], m["start"], m["end"]))
                            chances.append(float(p))
                out["base"].append(spans(base))
                out["spans"].append(spans(choose(base, likely, chances)))
            if out["base"]:
                yield out

    return over_batches(seen, decide, RESULT.format(key=kind_of_key))


def redact(text: str, spans: list[Span]) -> str:
    """The text with a mark for each span's kind; of overlapping spans the union goes."""
    out, end = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= end:
            out += [text[end : span.start], f"[{KINDS[span.kind]}]"]
        end = max(end, span.end)
    return "".join([*out, text[end:]])
