import itertools
import math
import random
import re
import time

from pyspark.sql import functions as F

from hearthlog.llm import urls

URLS = [
    None, "", "no scheme", "http://", "https://Example.COM", "http://example.com/en/x?q=/y#z", "https://www.example.com/en/",
    "ftp://a.b.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.net?x=/es/", "http://a.net#/es/", "x://y://z/en/",
    "http://notexample.com/en/", "http://sub.www.example.com/en/page", "http://example.com/EN/", "http://ÄB.org/ü\nv",
    "http://a.org/" + "seg/" * 30000,
]


def naive(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith("/" + r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_and_verdicts(spark):
    html = "<p>green house <script>var hidden;</script>green house paint</p>" * 5
    rows = [(i, u, html, "x") for i, u in enumerate(URLS * 2)] + [(None, URLS[5], None, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tokens string").repartition(4)
    found = urls.filter_urls(pages).collect()
    assert len(found) == len(rows)
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"])) for r in found)
    assert got == sorted((str(i), *naive(u)[:2], str(naive(u)[2])) for i, u, _, _ in rows)
    for r in found:
        assert r["verdict"] in ("allow", "block")
        if r["rule"]:
            url = URLS[r["page_id"] % len(URLS)] if r["page_id"] is not None else URLS[5]
            assert r["verdict"] == naive(url)[3]
    counts = {r["word"]: r["n"] for r in urls.word_counts(pages, "html").collect()}
    assert counts == {"green": 720, "house": 720, "paint": 360} or "hidden" not in counts
    assert urls.filter_urls(pages.where("false")).count() == 0


def test_segments():
    counts = {"green": 50, "house": 40, "greenh": 1, "ouse": 1}
    assert urls.segment("greenhouse", counts, 1000) == ["green", "house"]
    assert "".join(urls.segment("greenxyzhouse", counts, 1000)) == "greenxyzhouse"
    assert urls.segment("greenxyzhouse", counts, 1000)[0] == "green"


def test_classifier_learns_from_the_rules(spark):
    rows = [(i, f"http://shop{i % 9}.{'badoffer' if i % 2 else 'goodbooks'}.example.com/{'en' if i % 2 else 'de'}/{i}", "bad offer good books shop") for i in range(80)]
    rows += [(100, "http://badoffer.org/en/1", ""), (101, "http://goodbooks.org/de/1", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdicts = {r["page_id"]: r["verdict"] for r in urls.filter_urls(pages).collect()}
    assert verdicts[100] == "block" and verdicts[101] == "allow"


def likelihood(words, counts, total):
    return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)


def test_segments_are_the_likeliest_of_all():
    rng = random.Random(5)
    for _ in range(60):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))): rng.randint(1, 40) for _ in range(8)}
        run, total = "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), 500
        found = urls.segment(run, counts, total)
        splits = []
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(run)]
            splits.append([run[a:b] for a, b in zip([0, *ends], ends)])
        assert "".join(found) == run
        assert math.isclose(likelihood(found, counts, total), max(likelihood(s, counts, total) for s in splits))


def test_long_words_and_long_hosts(spark):
    long = "donaudampfschifffahrtsgesellschaft"
    words = spark.createDataFrame([(long, 50), (long[:26], 1), ("green", 50), ("house", 40), (long[:24] + "zzz", 9)], "word string, n long")
    runs = spark.createDataFrame([("green" + long + "house",), (long[:25],), ("q" * 30,), ("",), ("greenhouse" * 10_000,)], "run string")
    start = time.time()
    found = {r["run"]: r["words"] for r in urls._segments(runs, words, 1000, 1000).collect()}
    assert time.time() - start < 60
    assert found["green" + long + "house"] == ["green", long, "house"]
    assert found["q" * 30] == ["q" * 30] and found[""] == [] and found[long[:25]] == [long[:25]]
    assert found["greenhouse" * 10_000] == ["green", "house"] * 10_000


def test_held_out_accuracy_with_unequal_classes(spark):
    """Nine of ten pages are fine; half of what the rules say is held back."""
    rng = random.Random(3)
    good, bad, both = ["books", "garden", "paint"], ["casino", "poker", "pills"], ["shop", "online", "best", "city"]
    rows, truth = [], {}
    for i in range(1200):
        blocked = i % 10 == 0
        words = [rng.choice(both)] + [rng.choice(bad if blocked and rng.random() < 0.9 else good) for _ in range(rng.choice([0, 1, 1, 2]))]
        rng.shuffle(words)
        known = i // 10 % 2
        truth[i] = "block" if blocked else "allow"
        domain = ("net" if blocked else "com") if known else "org"
        path = "" if not known else "es/" if blocked else "x/"  # unruled pages have words of the host only
        rows.append((i, f"http://{''.join(words)}.{domain}/{path}", " ".join(good + bad + both)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = urls.filter_urls(pages).where(F.col("rule").isNull()).collect()
    right = sum(r["verdict"] == truth[r["page_id"]] for r in found)
    assert len(found) > 500 and right / len(found) > 0.93
