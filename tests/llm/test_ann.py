from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def brute(ids, x, queries, top=20):
    out = {}
    for q in queries:
        s = (x * x[ids.index(q)]).sum(axis=1)
        order = sorted((-v, i) for v, i in zip(s, ids, strict=True) if i != q)[:top]
        out[q] = [(i, -v) for v, i in order]
    return out


def table(spark, n=1500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(0, 0.6, (n, dim))
    x[n // 2 : n // 2 + n // 3] = x[0]  # copies: a third of all rows
    x = x.astype(np.float32).astype(np.float64)
    return list(range(n)), x, spark.createDataFrame([(i, [float(v) for v in r], "x") for i, r in enumerate(x)], "vec_id long, embedding array<float>, score string")


def test_recall_scores_and_ties(spark):
    ids, x, df = table(spark)
    rows = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    want = brute(ids, x, [i for i in ids if i % 20 == 0])
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    for q, found in got.items():
        assert q not in [i for i, _ in found] and found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert np.allclose([s for _, s in found], [float((x[q] * x[i]).sum()) for i, _ in found], atol=1e-9)
    hits = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert hits >= 0.9
    # queries that are copies find the smallest ids of their copies first
    copy = next(q for q in want if 750 <= q < 1250)
    assert [i for i, _ in got[copy]][:5] == [i for i, _ in want[copy]][:5]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []), (20, [1.0, 1.0]), (None, [1.0, 1.0]), (8, [None, 1.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]


def test_empty_table(spark):
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(4)
    book = ann.Codebook(rng.normal(0, 1, (400, 8)), 9)
    held = np.ones((9, 9))
    held[2, 3] = 0
    d1, d2 = book.sums(rng.normal(0, 1, (1, 8)))
    cells, last = book.walk(d1[0], d2[0], held, 81)
    sums = [d1[0, i] + d2[0, j] for i, j in cells]
    assert len(set(cells)) == 80 and (2, 3) not in cells and sums == sorted(sums) and last >= sums[-1]
    some, edge = book.walk(d1[0], d2[0], held, 10)
    assert some == cells[:10] and edge == sums[9]


def test_many_parts_and_blocks(spark, monkeypatch):
    """Small blocks and parts give what one block gives, up to which cells are passed."""
    _, _, df = table(spark)
    condition = F.col("vec_id") % 20 == 0
    whole = sorted(map(tuple, ann.search(df, condition).collect()))
    monkeypatch.setattr(ann, "BYTES", 8 * 16 * 64)
    monkeypatch.setattr(ann, "LEAST_BLOCK", 64)
    assert sorted(map(tuple, ann.search(df, condition).collect())) == whole


def test_ids_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (2, [0.1, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    # each row is a query of its own
    assert got == [(0, 1, 1, 1.0), (0, 1, 2, 1.0), (0, 2, 1, 0.1), (0, 2, 2, 0.1)]


@pytest.mark.parametrize("counts", [[5, 5, 5], [9000, 1, 2], [1, 4096, 4000, 100], [0, 0]])
def test_blocks_hold_what_they_may(counts):
    at, cuts = ann._blocks(np.array(counts, float)[:, None], 4096)
    size = {}
    for i, n in enumerate(counts):
        for c in range(cuts[i]):
            size[at[i] + c] = size.get(at[i] + c, 0) + n / cuts[i]
    assert max(size.values()) <= 4096
