"""License notices in texts, found with a positional index of rare words.

The templates' words are weighted by their inverse document frequency over all
documents and indexed with their positions in the templates. Of each template that a
file may have, the rarest words that the file has are looked up. Each proposes the places
where the template would have to start; these postings are intersected, and the places on
which at least two words agree are verified: the mandatory phrases must stand there, and
most of the weight.
"""

import math
import sys
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthlog.llm.common import letter_words, over_batches, text_bytes

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INDEX_WORDS = 3  # of a template, looked up in a file
AGREEING = 2  # of them that must propose a place, fewer only if fewer are looked up
SLACK = 2  # words by which a notice may be shifted against its template
LEAST_SHARE = 0.6  # of a template's weight that a notice has


class Template(NamedTuple):
    label: str
    text: str
    mandatory: tuple[str, ...]


# Phrases that always name their license.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public notices of common licenses, short forms and whole ones.
TEMPLATES = [
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ("permission is hereby granted", "without restriction including without limitation")),
    Template("mit", "spdx license identifier mit", ("spdx license identifier mit",)),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license",)),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("apache license", "in compliance with the license")),
    Template("apache-2", "spdx license identifier apache 2 0", ("spdx license identifier apache 2 0",)),
    Template("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license", "version 3")),
    Template("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ("gnu general public license", "version 2")),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use", "source and binary forms")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistribution and use", "must retain the above copyright notice")),
    Template("bsd", "released under the bsd license", ("bsd license",)),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under a creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
    Template("cc0", "released into the public domain under cc0 1 0 universal", ("cc0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]


class Notice(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    mandatory: tuple[tuple[bytes, ...], ...]
    exact: bool  # the words stand in a row and nothing else counts


class Index(NamedTuple):
    notices: list[Notice]
    ranked: list[list[bytes]]  # the words of each notice, rarest first
    postings: list[dict[bytes, list[int]]]  # where they stand in it
    needed: list[set[bytes]]  # the words of its mandatory phrases
    weight: dict[bytes, float]


def notices_of(templates: list[Template], phrases: dict[str, str]) -> list[Notice]:
    words = lambda text: tuple(letter_words(text.encode()))
    exact = [Notice(label, words(p), (words(p),), True) for p, label in phrases.items()]
    return exact + [Notice(t.label, words(t.text), tuple(map(words, t.mandatory)), False) for t in templates]


def build_index(notices: list[Notice], doc_counts: dict[bytes, int], n_docs: int) -> Index:
    weight = {
        w: math.log((n_docs + 1) / (doc_counts.get(w, 0) + 1)) + 1e-3 for n in notices for w in n.words
    }
    ranked, postings = [], []
    for notice in notices:
        places: dict[bytes, list[int]] = defaultdict(list)
        for at, word in enumerate(notice.words):
            places[word].append(at)
        ranked.append(sorted(places, key=lambda w: (-weight[w], w)))
        postings.append(dict(places))
    needed = [{w for phrase in n.mandatory for w in phrase} for n in notices]
    return Index(notices, ranked, postings, needed, weight)


def _has(words: list[bytes], phrase: tuple[bytes, ...], first: int, last: int) -> bool:
    size = len(phrase)
    return any(
        words[at] == phrase[0] and tuple(words[at : at + size]) == phrase
        for at in range(max(0, first), min(last, len(words)) - size + 1)
    )


def looked_up(present: set[bytes], index: Index) -> dict[int, list[bytes]]:
    """By notice, the words to look up: the rarest of its words that the file has.

    Notices are left out if the file lacks a word of a mandatory phrase or has too little
    of the weight, wherever in it the words stand. One place of its rarest word gives away
    an exact phrase.
    """
    found = {}
    for number, notice in enumerate(index.notices):
        if not index.needed[number] <= present:
            continue
        own = [w for w in index.ranked[number] if w in present]
        if notice.exact:
            found[number] = own[:1]
        elif sum(index.weight[w] for w in notice.words if w in present) >= LEAST_SHARE * _total(notice, index):
            found[number] = own[:INDEX_WORDS]
    return found


def _total(notice: Notice, index: Index) -> float:
    return sum(index.weight[w] for w in notice.words)


def agreed_starts(proposals: list[tuple[int, bytes]], least: int) -> list[int]:
    """Proposed starts that ``least`` different words propose, their own word among them,
    at most ``SLACK`` places from them. ``proposals`` are in order."""
    found, counts = [], defaultdict(int)
    head = tail = 0
    for start, _ in proposals:
        while head < len(proposals) and proposals[head][0] <= start + SLACK:
            counts[proposals[head][1]] += 1
            head += 1
        while proposals[tail][0] < start - SLACK:
            word = proposals[tail][1]
            counts[word] -= 1
            if not counts[word]:
                del counts[word]
            tail += 1
        if len(counts) >= least and (not found or found[-1] != start):
            found.append(start)
    return found


def share_at(words: list[bytes], start: int, notice: Notice, index: Index) -> float:
    """Share of the notice's weight that stands about ``start``; 0 without its phrases."""
    first, end = max(0, start - SLACK), start + len(notice.words) + SLACK
    if not all(_has(words, phrase, first, end) for phrase in notice.mandatory):
        return 0.0
    there = set(words[first:end]) if end > 0 else set()
    return sum(index.weight[w] for w in notice.words if w in there) / _total(notice, index)


def scan(words: list[bytes], index: Index) -> tuple[list[tuple[str, int]], dict[str, float]]:
    """Places of the exact phrases, and the best score of every label."""
    wanted = looked_up(set(words) & index.weight.keys(), index)
    places: list[tuple[str, int]] = []
    best: dict[str, float] = {}
    if not wanted:
        return places, best
    positions: dict[bytes, list[int]] = {w: [] for own in wanted.values() for w in own}
    for position, word in enumerate(words):
        if word in positions:
            positions[word].append(position)
    for number, own in wanted.items():
        notice, postings = index.notices[number], index.postings[number]
        if notice.exact:
            at = postings[own[0]][0]
            starts = (p - at for p in positions[own[0]] if p >= at)
            there = [s for s in starts if tuple(words[s : s + len(notice.words)]) == notice.words]
            places += [(notice.label, s) for s in there]
            if there:
                best[notice.label] = 1.0
            continue
        proposals = sorted((p - at, w) for w in own for at in postings[w] for p in positions[w])
        for start in agreed_starts(proposals, min(AGREEING, len(own))):
            share = share_at(words, start, notice, index)
            if share >= LEAST_SHARE and share > best.get(notice.label, 0.0):
                best[notice.label] = share
    return places, best


def document_counts(docs: DataFrame, vocabulary: set[bytes], text: str) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of the vocabulary stands, and all documents."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts, n = defaultdict(int), 0
        for batch in batches:
            for value in text_bytes(batch, "_text"):
                n += 1
                for word in vocabulary.intersection(letter_words(value or b"")):
                    counts[word] += 1
        yield {"word": [None, *counts], "n": [n, *counts.values()]}

    found = over_batches(docs.select(F.col(text).alias("_text")), rows, "word binary, n long")
    # One row per word of the vocabulary, which is fixed.
    counts = {r["word"] and bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return counts, counts.pop(None, 0)


FOUND = (
    "doc_id {key}, n_words long, n_base long, first_word long, last_word long, base_labels string,"
    " labels string, score double"
)


def scan_licenses(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: list[Template] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    A row per row of ``docs``. ``n_base`` counts the places of the exact ``phrases``,
    ``first_word`` and ``last_word`` are the smallest and largest of them (null without
    any), ``labels`` adds those of the templates of which ``LEAST_SHARE`` of the weight
    stands at one agreed place, and ``score`` is the best such share, 1 for an exact
    phrase, 0 for none. Every agreed place is judged. A null text is an empty one. Other columns are not read.
    """
    notices = notices_of(templates, phrases)
    counts, n_docs = document_counts(docs, {w for n in notices for w in n.words}, text)
    index = build_index(notices, counts, n_docs)
    names = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), text_bytes(batch, "_text")):
                words = letter_words(value or b"")
                places, best = scan(words, index)
                at = [start for _, start in places]
                base = ",".join(sorted({label for label, _ in places}))
                out.append((doc_id, len(words), len(at), min(at, default=None), max(at, default=None),
                            base, ",".join(sorted(best)), max(best.values(), default=0.0)))
            if out:
                yield dict(zip(names, zip(*out)))

    chosen = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    return over_batches(chosen, rows, FOUND.format(key=docs.schema[key].dataType.simpleString()))
