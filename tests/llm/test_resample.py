from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import resample


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return words, words + [a + b" " + b for a, b in zip(words, words[1:], strict=False)]


def plain(docs, target, percent=25, least=20):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(crc32(f) % 10000 for f in features(x)[1])
    for x in target:
        t.update(crc32(f) % 10000 for f in features(x)[1])
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for i, x in docs:
        words, f = features(x)
        w = sum(gain[crc32(y) % 10000] for y in f) // len(f) if f else 0
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(f), w, score, None, len(words)])
    may = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for rank, r in enumerate(may[: len(may) * percent // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


def corpus(n=300):
    rng = np.random.default_rng(3)
    names = [f"wort{i}" for i in range(60)] + ["Größe", "naïve", "O'Neil", "x_y", "漢字", "3.14"]
    return [(i, " ".join(rng.choice(names, rng.integers(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("span", [resample.RANGE, 17])
def test_against_plain_loops(spark, span):
    docs = corpus() + [(900, None), (901, ""), (902, "..."), (None, "a b " * 30), (7, "twice " * 25), (7, "twice " * 25), (7, "twice " * 25)]
    target = ["wort1 wort2 wort3 Größe", "naïve wort1", None]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, rank int").repartition(6)
    out = resample.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"), span=span).collect()
    assert Counter(tuple(r) for r in out) == plain(docs, target)
    ranks = sorted(r["rank"] for r in out if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 40


def test_all_ties_are_ranked_in_many_ranges(spark):
    """One id and one text in every row: ranks are still 1 to n, and no range holds all rows."""
    df = spark.createDataFrame([(5, "one two " * 12)] * 200, "doc_id long, text string")
    rows = spark.createDataFrame([(1,)] * 200, "k int")
    assert sorted(r["rank"] for r in resample.ranked(rows, [rows.k], 10).collect()) == list(range(1, 201))
    out = resample.resampled(df, df.limit(1), span=10).collect()
    assert sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 51))


def test_long_text_in_parts(monkeypatch):
    text = ("alpha Beta, gamma-delta;" * 500).encode()
    whole = resample.buckets_of(text)
    monkeypatch.setattr(resample, "PART", 64)
    parts = resample.buckets_of(text)
    assert whole[0] == parts[0] == 2000 and all((a == b).all() for a, b in zip(whole[1:], parts[1:], strict=True))
    assert int(whole[2].sum()) == 3999


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resampled(none, none).count() == 0
    some = spark.createDataFrame(corpus(30), "doc_id long, text string")
    assert Counter(tuple(r) for r in resample.resampled(some, none).collect()) == plain(corpus(30), [])


def test_text_ids_and_other_settings(spark):
    df = spark.createDataFrame([(f"k{i}", t) for i, t in corpus(80)], "name string, body string")
    out = resample.resampled(df, df.limit(3), percent=50, least_words=5, seed=9, doc_id="name", text="body", buckets=100)
    assert out.schema["doc_id"].dataType.simpleString() == "string" and out.filter("rank is not null").count() == sum(len(t.split()) >= 5 for _, t in corpus(80)) // 2
