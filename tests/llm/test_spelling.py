from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import spelling


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, factor=10):
    """All pairs."""
    rows = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= factor * n else None
        rows[w] = [form, None, n, len(others), words[form] if form else None]
    for w in rows:
        at = w
        while rows[at][0]:
            at = rows[at][0]
        rows[w][1] = at
    return {(w, *r) for w, r in rows.items()}


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    words = {}
    for _ in range(250):
        w = "".join(rng.choice(list("abé"), rng.integers(3, 7)))
        words[w] = int(10 ** rng.uniform(0, 5))
    words |= {"aaaaaa": 5, "aaaaa": 50, "aaaaaaa": 500, "漢字かな": 3, "漢字かた": 40}
    out = spelling.variants(table(spark, words), partition=200).collect()
    assert {tuple(r) for r in out} == plain(words) and len(out) == len(words)


def test_ties_and_chains(spark):
    words = {"abcdefg": 1, "abcdefx": 10, "abcdexx": 100, "abcdxxx": 1000, "abcxxxx": 10_000, "abxxxxx": 100_000, "qbcdefg": 10}
    out = {r.word: r for r in spelling.variants(table(spark, words)).collect()}
    assert out["abcdefg"].form == "abcdefx" and out["abcdefg"].n_near == 2 and out["abcdefg"].root == "abxxxxx"
    assert out["abxxxxx"].root == "abxxxxx" and out["abxxxxx"].form is None


def test_equal_keys_of_different_strings_do_not_link(spark, monkeypatch):
    """Every key is the same: strings alone decide."""

    def all_alike(words, partition):
        rows = words.collect()
        found = [(rows[i].wid, int(p), int(k), 0) for _, at, place, kind in spelling.deletion_keys([r.word for r in rows]) for i, p, k in zip(at, place, kind, strict=True)]
        return spark.createDataFrame(found, "wid long, place int, kind byte, key long")

    monkeypatch.setattr(spelling, "candidates", all_alike)
    words = {"kitten": 5, "sitten": 60, "sittin": 700, "kittens": 1, "mitte": 9, "itten": 3, "knitten": 2}
    assert {tuple(r) for r in spelling.variants(table(spark, words)).collect()} == plain(words)


def test_parts_of_a_text(monkeypatch):
    text = ("Straßenbahn,kitchens " * 9 + "x" * 40 + " naïvetés").encode()
    whole = spelling.words_of("1", text)
    monkeypatch.setattr(spelling, "PART", 3)
    assert spelling.words_of("1", text) == whole and len(whole) >= 4


def test_vocabulary(spark):
    rng = np.random.default_rng(0)
    names = ["Straßenbahn", "straßenbahn", "Größenwahn", "kitchen", "KITCHEN", "kitchens", "short", "ÀÉÎõüÿ×", "mañana_manana", "o'clockwise"]
    docs = [(i % 150 if i != 3 else None, " ".join(rng.choice(names, 12)) + ("," if i % 2 else "漢")) for i in range(200)] + [(999, None), (998, "")]
    want = Counter()
    for i, t in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, word string")
    assert {tuple(r) for r in spelling.vocabulary(df).collect()} == {(w, n) for w, n in want.items() if n >= 2}


def test_long_words_have_the_same_keys(monkeypatch):
    """Made chunk by chunk, the keys of a word are those made at once."""
    words = ["abcabccabba" * 3, "aaaaaaaaaaaa", "xyz"]
    rows = lambda: sorted(z for k, i, p, d in spelling.deletion_keys(words) for z in zip(k.tolist(), i.tolist(), p.tolist(), d.tolist(), strict=True))
    once = rows()
    monkeypatch.setattr(spelling, "CHUNK", 5)
    assert rows() == once and len(once) == sum(map(len, words)) + sum(len(re.findall(r"(.)\1*", w)) for w in words) + 3


def test_a_very_long_word(spark):
    w = "ab" * 40_000
    words = {w: 3, w[:-1]: 40, w[:700] + "x" + w[701:]: 2, "a" * 90_000: 1, "a" * 89_999: 30}
    out = {r.word: r for r in spelling.variants(table(spark, words)).collect()}
    assert out[w].n_near == 2 and out[w].form == w[:-1] and out[w[:700] + "x" + w[701:]].form is None
    assert out["a" * 90_000].root == "a" * 89_999


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(none)).count() == 0
