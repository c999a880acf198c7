from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lines


def plain(texts, least):
    """Drop by counting keys in a dictionary."""
    held = Counter()
    for t in texts:
        held.update({lines.key_of(x) for x in (t or "").encode().split(b"\n")} - {b""})
    out = []
    for t in texts:
        rows = (t or "").encode().split(b"\n")
        kept = [r for r in rows if held[lines.key_of(r)] < least]
        out.append((b"\n".join(kept).decode(), len(rows), len(rows) - len(kept)))
    return out


def made(seed, n=400):
    rng = np.random.default_rng(seed)
    common = [f"Common line {i}" for i in range(30)]
    texts = []
    for i in range(n):
        rows = [f"own {i} {j}" for j in range(rng.integers(0, 4))] + [common[k] for k in rng.integers(0, 30, rng.integers(0, 3))] + (["HOT \r"] if i % 3 == 0 else []) + ([""] if i % 5 == 0 else [])
        rng.shuffle(rows)
        texts.append("\n".join(rows))
    return texts + [None, "", "\n\n", " hot\t", "hot\nHot\nhot", "À HOT", "à hot"] + ["same text\nhot\nand copies"] * 40


@pytest.mark.parametrize(("keys", "probes"), [(250_000, 1_000_000), (20, 15)])
def test_against_counting(spark, keys, probes):
    """Many blocks; small shards and few probes a task: many shards, the hot line's shard in pieces."""
    texts = made(1)
    df = spark.createDataFrame([(i, t, f"x{i}", 1, "h") for i, t in enumerate(texts)], "doc_id long, text string, c1 string, block int, drops string").repartition(24)
    out = {r.doc_id: r for r in lines.deduplicated(df, 10, keys=keys, probes=probes).collect()}
    want = plain(texts, 10)
    assert len(out) == len(texts) and sum(n for _, _, n in want) > 200
    for i, w in enumerate(want):
        assert (out[i].text, out[i].n_lines, out[i].n_dropped) == w
        assert (out[i].c1, out[i].block, out[i].drops) == (f"x{i}", 1, "h")


def test_repeated_null_and_clashing(spark):
    df = spark.createDataFrame([(1, "a\nown", "x")] * 6 + [(None, "A ", "x")] * 4 + [(2, None, "x")], "doc_id long, text string, n_lines string")
    rows = lines.deduplicated(df, 10).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in rows) == {(1, "own", 2, 1): 6, (None, "", 1, 1): 4, (2, "", 1, 0): 1}


def test_empty_table(spark):
    assert lines.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text(spark):
    big = "\n".join(f"line {i}" for i in range(400_000))
    df = spark.createDataFrame([(0, big + "\nhot")] + [(i, "hot") for i in range(1, 10)], "doc_id long, text string")
    row = lines.deduplicated(df).filter("doc_id = 0").first()
    assert (row.n_lines, row.n_dropped, row.text) == (400_001, 1, big)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_arrays_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    pairs = np.unique(rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64), axis=0)
    counts = rng.integers(1, 1000, len(pairs))
    arrays = lines.Arrays(*lines.Arrays.built(pairs, counts))
    assert sorted(arrays.numbers(pairs).tolist()) == list(range(len(pairs)))
    assert arrays.probe(pairs).tolist() == counts.tolist()
    assert not arrays.probe(rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)).any()


def test_pairs_that_share_a_half():
    """Keys equal in one half of the hash are still told apart."""
    pairs = np.array([[7, i] for i in range(300)] + [[i, 7] for i in range(300) if i != 7], np.uint64)
    arrays = lines.Arrays(*lines.Arrays.built(pairs, np.arange(len(pairs))))
    assert arrays.probe(pairs).tolist() == list(range(len(pairs)))
