"""URL filtering: rules first, else a classifier over segmented host and path words.

Host labels are words written together. A unigram model of the pages' own words splits
them by Viterbi search, and multinomial naive Bayes, trained on the pages that the
rules decide, judges the words of host and path by their odds and the classes' sizes.
"""

import math
import sys
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import over_batches
from hearthlog.operators.lookup import lookup
from hearthlog.staging import stage, stage_measured

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHORT = 24  # letters of the parts that are looked up; longer words are found by their first
SMOOTHING = 1.0
WORD = r"[a-zß-öø-ÿ]+"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str  # after the first slash

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


# Fixed values.
RULES = (
    Rule("allow", "com", ""),
    Rule("block", "example.com", "en/"),
    Rule("allow", "www.example.com", "en/"),
    Rule("block", "net", "es/"),
    Rule("block", "net", "fr/"),
)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, CAPITALS, SMALL), path


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        on_host = (host == rule.host) | host.endswith("." + rule.host)
        fits = on_host & path.startswith("/" + rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def word_counts(texts: DataFrame, html: str) -> DataFrame:
    """``word, n`` over the visible words of all pages."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return (
        texts.select(F.explode(F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def segment(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely words of ``run``: words of ``counts``, and unknown stretches, whose
    chance falls tenfold a letter. Neither has a longest length."""
    lengths = sorted({len(word) for word in counts})
    unknown, letter = math.log(10 / total), math.log(10)
    best: list[tuple[float, int]] = [(0.0, 0)]
    opened = (0.0, 0)  # of all places so far, the best for an unknown stretch to start at
    for end in range(1, len(run) + 1):
        found = (opened[0] + unknown - end * letter, opened[1])
        for size in lengths:
            if size > end:
                break
            if n := counts.get(run[end - size : end], 0):
                found = max(found, (best[end - size][0] + math.log(n / total), end - size))
        best.append(found)
        opened = max(opened, (found[0] + end * letter, end))
    words, end = [], len(run)
    while end:
        start = best[end][1]
        words.append(run[start:end])
        end = start
    return words[::-1]


def parts(run: str) -> set[str]:
    """The stretches of a run of up to ``SHORT`` letters."""
    return {run[start : start + size] for size in range(1, SHORT + 1) for start in range(len(run) - size + 1)}


def _segments(runs: DataFrame, counts: DataFrame, counts_bytes: int, total: int) -> DataFrame:
    """``run, words`` for distinct runs of letters; each asks for the counts of its own
    parts only. Words longer than any part are asked for by how they start."""
    placed = stage(runs.withColumn("place", F.monotonically_increasing_id()), "host_runs")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for place, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = sorted(parts(run))
                for at in range(0, len(words), 10_000):
                    own = words[at : at + 10_000]
                    yield {"place": [place] * len(own), "word": own}

    asked = over_batches(placed.select("place", "run"), ask, "place long, word string")
    known = lookup(asked, counts, ["word"], "inner", facts_bytes=counts_bytes)
    long = counts.where(F.length("word") > SHORT).select(F.substring("word", 1, SHORT).alias("word"), F.col("word").alias("_whole"), "n")
    begun = lookup(asked.where(F.length("word") == SHORT), long, ["word"], "inner").select("place", F.col("_whole").alias("word"), "n")
    # A run has as many parts as its length allows, whatever the number of pages.
    gathered = stage_measured(known.unionByName(begun).groupBy("place").agg(F.collect_list(F.struct("word", "n")).alias("known")), "known_parts")
    found = lookup(placed, gathered.table, ["place"], "left", facts_bytes=gathered.bytes)

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for run, own in batches:
            yield pd.Series([segment(r, {} if ks is None else {k["word"]: k["n"] for k in ks}, total) for r, ks in zip(run, own)])

    return found.select("run", split("run", "known").alias("words"))


def _runs_of(host: Column) -> Column:
    return F.regexp_extract_all(F.lower(host), F.lit(WORD), F.lit(0))


def filter_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_odds``: a row per row of ``pages``.

    ``rule`` is the longest rule that fits, or null; then the classifier gives the
    verdict, from the log odds ``block_odds``. Without pages on both sides of the rules
    it allows. A null url, or one without ``://``, has an empty host and path. Other
    columns are not read.
    """
    chosen = pages.select(F.col(key).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("_url"))
    host, path = split_url(F.col("_url"))
    split = chosen.withColumns({"host": host, "path": path})
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = split.withColumns({"rule": rule, "_ruled": verdict})
    # Copies of a url, and there may be very many, count but are judged once.
    places = stage(
        judged.groupBy("host", "path", "rule", "_ruled").agg(F.count("*").alias("n")), "places"
    )
    counts = stage_measured(word_counts(pages, html), "word_counts")
    total = counts.table.agg(F.sum("n")).first()[0] or 1
    hosts = places.select("host").distinct().withColumn("_runs", _runs_of(F.col("host")))
    runs = hosts.select(F.explode("_runs").alias("run")).distinct()
    segments = stage_measured(_segments(runs, counts.table, counts.bytes, total), "segments")
    host_words = stage_measured(
        lookup(hosts.select("host", F.explode("_runs").alias("run")), segments.table, ["run"], "inner", facts_bytes=segments.bytes)
        .groupBy("host")
        .agg(F.flatten(F.collect_list("words")).alias("host_words")),
        "host_words",
    )
    in_path = F.regexp_extract_all(F.lower("path"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    tokens = F.concat(
        F.transform(F.coalesce("host_words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)),
        F.transform(in_path, lambda w: F.concat(F.lit("p:"), w)),
    )
    worded = stage(
        lookup(places, host_words.table, ["host"], "left", facts_bytes=host_words.bytes).withColumn("tokens", tokens),
        "worded",
    )
    odds, prior = _log_odds(worded)
    scored = stage_measured(
        lookup(
            worded.where("rule is null").select("host", "path", F.explode("tokens").alias("token")),
            odds, ["token"], "inner",
        )
        .groupBy("host", "path")
        .agg(F.sum("odds").alias("block_odds")),
        "scored",
    )
    found = lookup(judged, scored.table, ["host", "path"], "left", facts_bytes=scored.bytes)
    # A page without any known word is judged by the sizes of the classes alone.
    found = found.withColumn("block_odds", F.when(F.col("rule").isNull(), F.lit(prior) + F.coalesce("block_odds", F.lit(0.0))))
    learned = F.when(F.col("block_odds") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("_ruled", learned).alias("verdict"),
        F.round("block_odds", 9).alias("block_odds"),
    )


def _log_odds(worded: DataFrame) -> tuple[DataFrame, float]:
    """``token, odds``: log of the token's chance among blocked words to that among allowed
    ones; and the log of the blocked pages to the allowed ones."""
    ruled = worded.where("_ruled is not null").select("_ruled", "n", F.explode("tokens").alias("token"))
    counted = stage(
        ruled.groupBy("token").agg(
            F.sum(F.when(F.col("_ruled") == "block", F.col("n")).otherwise(0)).alias("blocked"),
            F.sum(F.when(F.col("_ruled") == "allow", F.col("n")).otherwise(0)).alias("allowed"),
        ),
        "token_counts",
    )
    blocked, allowed, size = counted.agg(F.sum("blocked"), F.sum("allowed"), F.count("*")).first()
    if not blocked or not allowed:
        return counted.where("false").select("token", F.lit(0.0).alias("odds")), 0.0
    pages = {r[0]: r[1] for r in worded.where("_ruled is not null").groupBy("_ruled").agg(F.sum("n")).collect()}
    chance = lambda n, all_: (F.col(n) + SMOOTHING) / F.lit(all_ + SMOOTHING * size)
    odds = counted.select("token", F.log(chance("blocked", blocked) / chance("allowed", allowed)).alias("odds"))
    return odds, math.log(pages["block"] / pages["allow"])
