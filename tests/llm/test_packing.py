from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import packing


def plain(sizes, sources, clusters, capacity, per_source):
    """Best fit by looking at every bin."""
    bins, out = [], []
    often = Counter(clusters)
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [b for b in bins if b["left"] >= n and b["sources"][s] < per_source and not (often[c] > 1 and c in b["clusters"])]
        best = min(fits, key=lambda b: (b["left"], b["id"]), default=None)
        if best is None:
            best = {"id": len(bins), "left": capacity, "sources": Counter(), "clusters": set()}
            bins.append(best)
        out.append((best["id"], capacity - best["left"]))
        best["left"] -= n
        best["sources"][s] += 1
        best["clusters"].add(c)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tightest_compatible_bin(seed):
    rng = np.random.default_rng(seed)
    n = 300
    sizes = sorted(rng.integers(1, 64, n).tolist(), reverse=True)
    sources = [f"s{0 if rng.random() < 0.4 else rng.integers(1, 6)}" for _ in range(n)]
    clusters = rng.integers(0, 80, n).tolist()
    per = int(rng.integers(1, 4))
    assert list(zip(*packing.pack(sizes, sources, clusters, 64, per), strict=True)) == plain(sizes, sources, clusters, 64, per)


def test_table(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "hot" if i % 3 else f"s{i}") for i in range(200)] + [(500, "w " * 250, "s"), (501, None, None), (502, " \n", "s"), (7, "w " * 3, "hot"), (7, "w " * 3, "hot"), (None, "one two", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = packing.packed(df, capacity=100, per_source=3, shard=60).collect()
    words = Counter()
    bins, sources = defaultdict(int), defaultdict(Counter)
    of = {i: s for i, _, s in rows}
    for r in out:
        words[r.doc_id] += r.n_words or 0
        if r.bin is not None:
            bins[r.bin] += r.n_words
            sources[r.bin][of[r.doc_id]] += 1
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    assert words == want and max(bins.values()) <= 100
    assert max(n for b, c in sources.items() for n in c.values()) <= 3
    assert {r.doc_id for r in out if r.bin is None} == {501, 502}
    assert sorted(r.piece for r in out if r.doc_id == 500) == [0, 1, 2]
    spans = defaultdict(list)
    for r in out:
        if r.bin is not None:
            spans[r.bin].append((r.start, r.start + r.n_words))
    assert all(a[1] <= b[0] for x in spans.values() for a, b in zip(sorted(x), sorted(x)[1:], strict=False))


def test_copies_do_not_share_a_bin(spark):
    df = spark.createDataFrame([(i, "same text here", f"s{i}") for i in range(12)], "doc_id long, text string, source string")
    assert packing.packed(df).select("bin").distinct().count() == 12


def test_empty_table(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_repeated_and_null_ids_fill_bins_of_their_own(spark):
    """Rows as long as a bin or longer, with one id or none: no bin holds more than its capacity."""
    rows = [(7, "w " * 100, "s"), (7, "v " * 100, "s"), (None, "x " * 250, "s"), (None, "y " * 250, None)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=100).collect()
    bins = Counter()
    for r in out:
        bins[r.bin] += r.n_words
    assert max(bins.values()) == 100 and sum(bins.values()) == 700 and len(out) == 8


def test_ids_keep_their_value(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a b", "s"), (None, "c d e", "s"), (big + 2, "f", "s")], "doc_id long, text string, source string")
    assert {r.doc_id for r in packing.packed(df).collect()} == {big, big + 2, None}
    text = df.selectExpr("cast(doc_id as string) as doc_id", "text", "source", "1 as bin", "2 as row", "3 as shard")
    assert {r.doc_id for r in packing.packed(text).collect()} == {str(big), str(big + 2), None}


def test_many_sources_need_few_bits():
    n = 3000
    bins, _ = packing.pack([1] * n, [f"s{i % 1500}" for i in range(n)], list(range(n)), 64, 8)
    assert max(Counter(bins).values()) == 64
