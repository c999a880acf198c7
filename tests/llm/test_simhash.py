from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, prints):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {ids[i]: min(groups[find(i)]) for i in range(len(ids))}


TEXTS = ["", None, "a", "A", "a b", "a b c", "É é É", "a b c d e", "A B C D E", "a b c d f", " \t\n", "w " * 70_000, "x y z " * 5]


def test_fingerprints_equal_the_plain_form():
    assert [int(x) for x in simhash.fingerprints(TEXTS)] == [plain_fingerprint(t) for t in TEXTS]


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{i}" for i in rng.integers(0, 500, 120)) for _ in range(25)]
    rows, n = [], 100
    for t in base:
        for _ in range(4):
            w = t.split()
            if rng.random() < 0.7:
                w[int(rng.integers(0, len(w)))] = "zz"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(i, t) for i, t in enumerate(TEXTS) if i != 11]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    assert got == plain_components([i for i, _ in rows], prints)
    # a small bucket limit takes the way for large buckets, with the same result
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df, most=2).collect()} == got


def test_large_buckets_lose_no_link(spark):
    # one bit apart each: a chain that shares most blocks; any two within three steps link
    prints = [0]
    for b in range(40):
        prints.append(prints[-1] ^ (1 << b))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for most in (3, 7, 20_000):
        roots = simhash.components(simhash.links(df, most)).collect()
        assert {r.root for r in roots} == {min(signed)} and len(roots) == len(prints) - 1


def test_forest_connects_what_links():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 12, 400).astype(np.uint64))
    a, b = simhash.forest(x)
    want = plain_components(x.tolist(), x.tolist())
    group = {}
    for r, m in zip(a.tolist(), b.tolist(), strict=True):
        group[m] = r
    assert {v: group.get(v, v) for v in x.tolist()} == want


def test_repeats_nulls_and_extra_columns(spark):
    df = spark.createDataFrame([(5, "a b c d", "x"), (5, "a b c d", "x"), (None, "a b c d", None), (9, "a b c d", "y"), (7, None, None)], "doc_id long, text string, fp string")
    rows = simhash.near_duplicates(df).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 5), (5, 5), (5, 5), (7, 7), (9, 5)]
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 5, 5, 7]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_masks_cover_all_close_pairs():
    rng = np.random.default_rng(2)
    masks = [m & ((1 << 64) - 1) for m in simhash._masks()]
    assert len(masks) == 20 and all(bin(m).count("1") >= 31 for m in masks)
    for _ in range(500):
        flips = sum(1 << int(b) for b in rng.choice(64, 3, replace=False))
        assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("text", TEXTS[:11])
def test_shingle_counts(text):
    words = (text or "").encode().split()
    assert len(simhash.shingle_hashes(text)) == (0 if not words else max(1, len(words) - 2))
