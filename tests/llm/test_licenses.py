import random
from collections import Counter

import pytest

from hearthlog.llm import licenses
from hearthlog.llm.common import letter_words


def base(text):
    words = [w.decode() for w in letter_words((text or "").encode())]
    places = []
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        places += [(label, i) for i in range(len(words)) if words[i : i + len(own)] == own]
    at = [i for _, i in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for label, _ in places}))


TEXTS = [
    None, "", "mit license", "Released under the MIT License.", "mit mit under the mit the mit license",
    "Licensed under the Apache License, Version 2.0. " * 3, "CC BY-NC 4.0 and under the MIT license",
    "This work is licensed under the GNU General Public License, version 3.",
    "the license of version 3 public under general gnu", "Er kommt mit der Version 2 ohne Lizenz.",
    "word " * 60000 + "under the MIT license", "é under the mit license ü",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
]


def test_places_and_labels(spark):
    docs = spark.createDataFrame([(i % 11, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    found = licenses.scan_licenses(docs.repartition(3)).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], str(r["first_word"]), str(r["last_word"]), r["base_labels"]) for r in found)
    want = []
    for i, text in enumerate(TEXTS):
        n, k, first, last, labels = base(text)
        want.append((i % 11, n, k, str(first), str(last), labels))
    assert got == sorted(want)
    by_text = {(r["n_words"], r["labels"]) for r in found}
    assert (12, "gpl-3") in by_text
    assert (len(TEXTS[-1].split()), "mit") in by_text
    assert (9, "") in by_text and (8, "") in by_text
    for r in found:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def naive_scores(words, notices, weight):
    """Best share of each label, by trying every place of the text for every template."""
    best = {}
    for n in notices:
        size = len(n.words)
        if n.exact:
            if any(tuple(words[i : i + size]) == n.words for i in range(len(words))):
                best[n.label] = 1.0
            continue
        own = sorted({w for w in n.words if w in words}, key=lambda w: (-weight[w], w))[: licenses.INDEX_WORDS]
        for start in range(-size, len(words) + 1):
            near = range(start - licenses.SLACK, start + licenses.SLACK + 1)
            spots = {(w, s) for w in own for at, t in enumerate(n.words) if t == w for s in near if 0 <= s + at < len(words) and words[s + at] == w}
            proposed = any(s == start for _, s in spots)
            if not proposed or len({w for w, _ in spots}) < min(licenses.AGREEING, len(own)):
                continue
            first, end = max(0, start - licenses.SLACK), max(0, start + size + licenses.SLACK)
            there = words[first:end]
            if not all(any(tuple(there[i : i + len(p)]) == p for i in range(len(there))) for p in n.mandatory):
                continue
            share = sum(weight[w] for w in n.words if w in there) / sum(weight[w] for w in n.words)
            if share >= licenses.LEAST_SHARE:
                best[n.label] = max(share, best.get(n.label, 0.0))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_scores_are_those_of_every_place(seed):
    rng = random.Random(seed)
    notices = licenses.notices_of(licenses.TEMPLATES, licenses.PHRASES)
    vocabulary = sorted({w for n in notices for w in n.words})
    weight_counts = {w: rng.randrange(1000) for w in vocabulary}
    index = licenses.build_index(notices, weight_counts, 1000)
    seen = Counter()
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(40))
        for _ in range(rng.randrange(3)):
            notice = list(rng.choice(notices).words)
            for _ in range(rng.randrange(4)):  # words put in, left out and replaced
                at = rng.randrange(len(notice))
                notice[at : at + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(3))
                notice = notice or [b"mit"]
            at = rng.randint(0, len(words))
            words[at:at] = notice
        found = licenses.scan(words, index)[1]
        assert found == pytest.approx(naive_scores(words, notices, index.weight))
        seen.update(found)
    assert len(seen) > 5


def test_words_must_agree_on_a_place():
    notices = licenses.notices_of(licenses.TEMPLATES, {})
    index = licenses.build_index(notices, {}, 1000)
    text = "gnu general public license " + "word " * 50 + "licensed under the version 3"
    assert licenses.scan(letter_words(text.encode()), index)[1] == {}
    late = "Licensed under GNU General Public License, version 9. Licensed under, as said, the GNU General Public License, version 3."
    assert set(licenses.scan(letter_words(late.encode()), index)[1]) == {"gpl-3"}
    assert licenses.agreed_starts([(0, b"a"), (2, b"a"), (5, b"b"), (9, b"a")], 2) == []
    assert licenses.agreed_starts([(0, b"a"), (2, b"b"), (3, b"a"), (5, b"a")], 2) == [0, 2, 3]


@pytest.mark.parametrize("template", [t for t in licenses.TEMPLATES if len(t.text.split()) > 30])
def test_whole_notices_in_real_layout(template):
    words = template.text.split()
    lines = [" * " + " ".join(words[i : i + 9]).capitalize() + "," for i in range(0, len(words), 9)]
    notices = licenses.notices_of(licenses.TEMPLATES, licenses.PHRASES)
    found = licenses.scan(letter_words(("x = 1\n" * 500 + "\n".join(lines) + "\ny = 2" * 500).encode()), licenses.build_index(notices, {}, 10))[1]
    assert found[template.label] == 1.0
