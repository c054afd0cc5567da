import random

import pytest
from pyspark.sql import functions as F

from hearthlog.llm import lines
from hearthlog.operators import lookup
from hearthlog.staging import stage_measured


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(2)
    body = [f"line {rng.random()}" for _ in range(200)]
    text = "\n".join(body).encode()
    found = lines.chunks(text)
    assert [a for a, _, _ in found[1:]] == [b for _, b, _ in found[:-1]]
    assert (found[0][0], found[-1][1]) == (0, len(text))
    assert all(n >= lines.LEAST_LINES for _, _, n in found[:-1])
    shifted = "\n".join(["something new", *body]).encode()
    own = {text[a:b] for a, b, _ in found}
    again = {shifted[a:b] for a, b, _ in lines.chunks(shifted)}
    assert len(own & again) > 0.9 * len(own)
    assert lines.chunks(b"") == [(0, 0, 0)]
    assert lines.chunks(b"\n\n") == [(0, 2, 0)]


def expected_texts(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, len(str(r[0])), str(r[0]))):
        data, gone = (text or "").encode(), set()
        for at, (a, b, n) in enumerate(lines.chunks(data)):
            if n >= lines.LEAST_LINES:
                chunk = data[a:b].rstrip(b"\n")
                if chunk in seen:
                    gone.add(at)
                seen.add(chunk)
        out[doc_id, text] = text if not gone else lines.without_chunks(data, gone).decode()
    return out


def test_repeated_passages_go_and_the_first_stays(spark):
    rng = random.Random(1)
    passage = [[f"p{i} {j} é" for j in range(8)] for i in range(3)]
    rows = []
    for i in range(40):
        own = [f"own {i} {j} {rng.random()}" for j in range(rng.randrange(6))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + rng.choice([[], *passage]) + own[at:]) + rng.choice(["", "\n", "\n\n"])))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, rows[5][1]), (104, rows[5][1]), (None, rows[7][1])]
    docs = spark.createDataFrame(
        [(a, t, "x", len(t or ""), i) for i, (a, t) in enumerate(rows)],
        "doc_id long, text string, id string, n_chars long, at int",
    ).repartition(4)
    found = lines.drop_repeated_lines(docs)
    assert found.schema == docs.schema
    got = sorted((r["at"], r["text"], r["n_chars"], r["id"]) for r in found.collect())
    want = expected_texts(rows)
    assert [g[0] for g in got] == list(range(len(rows)))
    for at, text, size, other in got:
        assert text == want[rows[at]] and size == len(text or "") and other == "x"
    assert any(text != rows[at][1] for at, text, _, _ in got)


def without_long_runs(rows):
    """By comparing all runs of lines, without chunks: what is left of each text."""
    first, out = {}, []
    for number, text in enumerate(rows):
        body = text.split("\n")
        gone = set()
        for a in range(len(body)):
            for b in range(a + 1, len(body) + 1):
                if len(" ".join(body[a:b]).split()) > 50:
                    there = first.setdefault("\n".join(body[a:b]), (number, a, b))
                    if there[0] != number or a >= there[2]:
                        gone |= set(range(a, b))
        out.append("\n".join(line for at, line in enumerate(body) if at not in gone))
    return out


def test_bytes_are_read_of_suspects_only(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(i, "\n".join([f"own {i} {j} " + "w " * 30 for j in range(20)] + [shared] * (i < 2))) for i in range(20)]
    keyed = lines._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    wanted = keyed.where("id in ('=0', '=1')").select("id", "mark", F.expr("array(named_struct('at', 20, 'upto', 21)) own"))
    found = lines._suspects(keyed, stage_measured(wanted, "wanted")).collect()
    assert [bytes(r["passage"]).decode() for r in found] == [shared] * 2


@pytest.mark.parametrize("limit", [None, 0])
def test_every_passage_of_more_than_fifty_words_goes(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(lookup, "BROADCAST_LIMIT_BYTES", limit)
    rng = random.Random(4)
    line = lambda n: " ".join(f"w{rng.random()}" for _ in range(n))
    passages = [[line(60)], [line(26), line(26)], [line(17) for _ in range(3)], [line(60), line(3)], [line(4), line(60)],
                [line(13) for _ in range(4)], [line(7) for _ in range(8)], [line(51)], [line(30)] * 3, [line(30), line(20)]]
    rows = [passages[0][0], passages[0][0], "\n".join([line(30)] * 9)]
    for _ in range(80):
        own = [line(rng.choice([2, 20, 60])) for _ in range(rng.randrange(4))]
        at = rng.randint(0, len(own))
        rows.append("\n".join(own[:at] + rng.choice(passages) + own[at:]))
    short = {r for r in rows if len(r.split()) <= 50}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    got = [r["text"] for r in lines.drop_repeated_lines(docs).orderBy("doc_id").collect()]
    want = without_long_runs(rows)
    for before, after, expected in zip(rows, got, want):
        if before not in short and passages[9][0] not in before:  # 50 words: left to the chunks
            assert after == expected
    assert want[1] == "" == got[1] and got[2].count("\n") == 1
