from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest

from tidemark.llm import quality


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", None, " ", "a", "a b c d e f g h " * 3, "a " * 15, "x y \x1c z\x85", "é𝕏 #|#\n\n \n#\n#", "one two three four five six seven eight nine one two three four five six seven eight", "w " * 30_000, "a\r\nb\r\na\r\n", " ".join(f"w{i}" for i in range(20_000))]


@pytest.mark.parametrize("i", range(len(TEXTS)))
def test_counts_equal_the_plain_form(i):
    assert quality.counts_of(TEXTS[i]) == plain(TEXTS[i])


def test_random_repeats():
    rng = np.random.default_rng(5)
    for _ in range(60):
        t = " ".join(rng.choice(["a", "b"], int(rng.integers(0, 60))).tolist())
        assert quality.counts_of(t) == plain(t)


def make(spark, n=900):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), int(rng.integers(2, 9))))
    rows = [(i, " ".join(word() for _ in range(int(rng.integers(40, 400)))), "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 40}") for i in range(n)]
    rows += [(10_000 + i, " ".join(word() + "###" for _ in range(100)), "en", "hot") for i in range(20)]
    rows += [(20_000, None, "en", "hot"), (20_001, "few words", None, None), (20_002, "a b c d e f g h " * 10, "en", "hot")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_outliers_go_and_the_rest_stays(spark):
    out = {r.doc_id: r for r in quality.judged(make(spark)).collect()}
    assert np.mean([out[i].kept for i in range(900)]) > 0.995
    assert not any(out[10_000 + i].kept for i in range(20))
    assert [out[i].base_failed for i in (20_000, 20_001, 20_002)] == [True] * 3 and not out[20_002].kept


def table_of(spark, groups):
    return spark.createDataFrame([(g, *map(float, r)) for g, x in groups.items() for r in x], "g string, " + ", ".join(f"{n} double" for n in quality.STATISTICS))


def test_estimate_resists_contamination(spark):
    rng = np.random.default_rng(7)
    good, bad = rng.normal(0, 1, (800, 5)), rng.normal(12, 0.5, (200, 5))
    r = quality.estimates(table_of(spark, {"g": np.concatenate((good, bad))})).first()
    assert np.abs(r.m).max() < 0.3
    spread = np.diag(np.linalg.inv(np.reshape(r.p, (5, 5)))) - np.square(quality.FLOOR)
    assert 0.6 < spread.min() and spread.max() < 1.5


def least_determinant(x, h):
    """Every subset of h rows."""
    factor = quality._chi2_factor(x.shape[1], h / len(x))
    ridge = np.diag(np.square(quality.FLOOR))
    return min(np.linalg.slogdet(np.cov(x[list(rows)].T, bias=True) * factor + ridge)[1] for rows in combinations(range(len(x)), h))


@pytest.mark.parametrize("seed", range(4))
def test_search_against_all_subsets(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate((rng.normal(0, 1, (12, 5)), rng.normal(5, 3, (4, 5))))
    assert quality.searched(x, 0.75)[0][0] == pytest.approx(least_determinant(x, 12), abs=1e-6)
    assert quality.searched(x[::-1], 0.75)[0][0] == quality.searched(x, 0.75)[0][0]


def test_large_groups_settle_over_all_rows(spark):
    """A sample starts the search, steps over all rows end it: as good as a search over all rows in memory."""
    rng = np.random.default_rng(9)
    groups = {"a": np.concatenate((rng.normal(0, 1, (900, 5)), rng.normal(6, 1, (250, 5)))), "b": rng.normal(3, 2, (500, 5)), "c": rng.normal(1, 1, (60, 5)), "same": np.ones((400, 5))}
    found = {r.g: r for r in quality.estimates(table_of(spark, groups), small=100).collect()}
    assert found.keys() == groups.keys()
    for g, x in groups.items():
        best = quality.searched(x)[0]
        mine = -np.linalg.slogdet(np.reshape(found[g].p, (5, 5)))[1]
        assert mine == pytest.approx(best[0], abs=0.05), g
        assert np.abs(np.array(found[g].m) - best[1]).max() < 0.1, g


def test_repeated_rows_and_clashing_names(spark):
    df = make(spark, 200).selectExpr("*", "'x' as kept", "'y' as n_words", "1 as g", "2 as m", "'z' as _all")
    out = quality.judged(df.unionByName(df)).collect()
    assert len(out) == 2 * df.count() and {r.m for r in out} == {2} and {r._all for r in out} == {"z"}
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add((r.kept, r.distance))
    assert all(len(v) == 1 for v in by.values())


def test_empty_table(spark):
    assert quality.judged(make(spark).limit(0)).count() == 0


def test_every_group_with_enough_rows_has_its_own_estimate(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # one source of short words and 60 documents among large sources of long words
    word = lambda k: "".join(rng.choice(list("abcdefgh"), k))
    rows = [(i, " ".join(word(9) for _ in range(int(rng.integers(60, 120)))), "en", f"s{i % 2}") for i in range(500)]
    rows += [(1000 + i, " ".join(word(2) + "#" for _ in range(int(rng.integers(60, 120)))), "en", "small") for i in range(60)]
    rows += [(2000 + i, " ".join(word(9) for _ in range(80)), "en", f"t{i % 3}") for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    whole = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert all(whole[1000 + i].kept for i in range(60))
