"""Quality rules: base counts of each text, then robust multivariate outliers.

Base counts are exact and cover whole texts. From them come transformed statistics (STATISTICS). For each
language and source a minimum-covariance-determinant estimate is made of the documents that pass the base
rules: of all subsets that hold the share H of a group, the one whose covariance has the least determinant
gives mean and covariance. The search is the usual fast one. From START small random subsets and from the
medians, concentration steps (take the share H that is nearest, estimate again) run until the determinant
settles, and the least determinant wins. A group of up to about SMALL documents is searched as a whole, in one
task. A larger one is searched on a sample of that size; its KEPT best estimates then go through concentration
steps over all of its documents, each step two grouped jobs (the distance within which the share H lies, and
sums of what is inside), until none settles further.

Covariances carry the squares of FLOOR on their diagonal, in determinants and distances alike (a regularised
estimate): a statistic that is nearly constant in a group, such as repeated lines, has a determinant at all and
rejects nothing by its noise. Groups with fewer than LEAST documents that pass the base rules, too few for an
estimate in five dimensions, take their language's estimate, and languages with fewer that of the whole corpus,
made the same way, however few there are. A document is rejected if its Mahalanobis distance exceeds CUT, or if
a base rule fails.

Null texts count as empty: no words, base_failed. Null language and null source are groups of their own.
Repeated rows count as often as they occur. An empty table gives an empty result. Columns named like the
added ones are replaced; extra ones pass through.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Transformed statistics: mean word length, symbols a word, duplicate lines a word, share of repeated words, length.
STATISTICS = {
    "z_length": "ln(1D + n_words)",
    "z_word": "ln((1D + word_chars) / (1D + n_words))",
    "z_symbol": "ln(1D + 20D * n_symbols / (1D + n_words))",
    "z_lines": "ln(1D + 20D * n_dup_lines / (1D + n_words))",
    "z_repeat": "ln(1D + 5D * n_repeat_words / (1D + n_words))",
}
#: Passing documents that an estimate needs; documents that one task searches; random starts; estimates of a sample that go on.
LEAST, SMALL, START, KEPT = 30, 1500, 40, 3
H = 0.75  # share of a group that the estimate rests on
SETTLED = 1e-3  # a step that lowers the logarithm of the determinant by less is the last
CUT = 6.5  # in consistent standard deviations
#: The least standard deviation of each statistic, so that a statistic that is almost constant in a group rejects nothing by its noise.
FLOOR = (0.3, 0.1, 0.25, 0.25, 0.25)
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of `window` words found twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(ids) == len(words):
        return 0
    # ranks of runs of 1, 2, 4 and 8 words: exact, by sorting pairs of ranks
    rank, length = np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), 1
    while length < window:
        step = min(length, window - length)
        pair = rank[: rank.size - step] * (rank.max() + 1) + rank[step:]
        kinds, rank = np.unique(pair, return_inverse=True)
        length += step
        if kinds.size == rank.size:
            return 0
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: twice.size] += twice
    edge[window : window + twice.size] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts_of(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the six white-space characters of the rule
    chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def counted(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with the five counts (long)."""
    return common.with_columns_of_text(docs, text, [(n, T.LongType(), pa.int64()) for n in COUNTS], lambda x: [list(c) for c in zip(*map(counts_of, x), strict=True)] or [[]] * 5, keep_text)


def _chi2_factor(d: int, h: float) -> float:
    """Consistency factor of a covariance taken from the inner share h, by a fixed numerical integral of chi-square densities."""
    x = np.linspace(1e-6, 80, 400_001)

    def below(k: int) -> np.ndarray:
        density = x ** (k / 2 - 1) * np.exp(-x / 2) / (2 ** (k / 2) * math.gamma(k / 2))
        return np.cumsum(density) * (x[1] - x[0])

    q = int(np.searchsorted(below(d), h))
    return float(h / below(d + 2)[q])


def _estimate(n: float, sums: np.ndarray, products: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and regularised covariance from a count, sums and the upper triangle of sums of products."""
    d = len(sums)
    mean = sums / n
    cov = np.zeros((d, d))
    cov[np.triu_indices(d)] = products
    cov = (cov + np.triu(cov, 1).T) / n - np.outer(mean, mean)
    return mean, cov * factor + np.diag(np.square(FLOOR))


def _settled(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int, factor: float, steps: int = 1000) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration steps over the rows of x, until the determinant falls no further (or `steps`): its logarithm, mean, covariance."""
    last = np.inf
    for _ in range(steps):
        z = x - mean
        inner = x[np.argsort(np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z), kind="stable")[:h]]
        mean, cov = inner.mean(axis=0), np.cov(inner.T, bias=True).reshape(x.shape[1], -1) * factor + np.diag(np.square(FLOOR))
        now = float(np.linalg.slogdet(cov)[1])
        if now >= last - 1e-12:
            return now, mean, cov
        last = now
    return last, mean, cov


def searched(x: np.ndarray, h: float = H, keep: int = 1, start: int = START) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The `keep` least determinants found, with mean and covariance. Rows are put in order first, so the result doesn't depend on how they came."""
    x = x[np.lexsort(x.T)]
    n, d = x.shape
    inside, factor, rng = min(n, int(np.ceil(h * n))), _chi2_factor(d, h), np.random.default_rng(n)
    spread = np.maximum(np.subtract(*np.quantile(x, (0.75, 0.25), axis=0)) / 1.349, FLOOR)
    starts = [(np.median(x, axis=0), np.diag(np.square(spread)))]
    for _ in range(start if n > d + 1 else 0):
        some = x[rng.choice(n, d + 1, replace=False)]
        starts.append((some.mean(axis=0), np.cov(some.T, bias=True) + np.diag(np.square(FLOOR))))
    short = sorted((_settled(x, m, c, inside, factor, 2) for m, c in starts), key=lambda t: t[0])[:10]
    return sorted((_settled(x, m, c, inside, factor) for _, m, c in short), key=lambda t: t[0])[:keep]


_MODEL = "g string, k int, m array<double>, p array<double>, fall double, det double"


def _models(rows: list[tuple]) -> pa.Table:
    """rows: group, number, (log determinant, mean, covariance), by how much the last step lowered it."""
    columns = {"g": pa.string(), "k": pa.int32(), "m": pa.list_(pa.float64()), "p": pa.list_(pa.float64()), "fall": pa.float64(), "det": pa.float64()}
    values = [[g, k, m.tolist(), np.linalg.inv(c).ravel().tolist(), fall, det] for g, k, (det, m, c), fall in rows]
    return pa.table([pa.array(v, t) for v, t in zip(zip(*values, strict=True) if values else [[]] * 6, columns.values(), strict=True)], names=list(columns))


def estimates(stats: DataFrame, h: float = H, small: int = SMALL) -> DataFrame:
    """A table of g, m, p (mean and inverse covariance of each group). stats: columns g (group) and STATISTICS; only groups that are to be estimated.

    No task gets more than a bounded sample of a group; joins with the estimates, one row a group, are left to the planner."""
    names, factor = list(STATISTICS), _chi2_factor(len(STATISTICS), h)
    stats = stats.select("g", *names, F.monotonically_increasing_id().alias("_row"))
    stats = common.materialize(stats, "quality-statistics")
    sizes = common.materialize(stats.groupBy("g").agg(F.count("*").alias("n")), "quality-sizes")
    sample = common.stratified_sample(stats, "g", "_row", small, sizes).join(sizes, "g")

    def search(table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(c).to_numpy() for c in names])
        whole = len(x) == table.column("n")[0].as_py()
        return _models([(table.column("g")[0].as_py(), k, found, 0.0 if whole else np.inf) for k, found in enumerate(searched(x, h, 1 if whole else KEPT))])

    models = common.materialize(sample.groupBy("g").applyInArrow(search, _MODEL), "quality-models")
    done = models.filter("fall = 0").select("g", "m", "p")
    moving, step = models.filter("fall > 0"), 0
    large = common.materialize(stats.join(moving.select("g").distinct(), "g", "left_semi"), "quality-large")
    while moving.limit(1).count():
        at = large.join(moving, "g").withColumn("distance2", F.expr(_distance2()))
        cuts = at.groupBy("g", "k").agg(F.percentile_approx("distance2", h, 10_000).alias("cut"), F.first("det").alias("before")).withColumnsRenamed({"g": "_g", "k": "_k"})
        inner = at.join(common.materialize(cuts, "quality-cuts"), (F.col("g") == F.col("_g")) & (F.col("k") == F.col("_k"))).filter("distance2 <= cut")
        products = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]]
        sums = inner.groupBy("g", "k").agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in names]).alias("s"), F.array(*products).alias("q"), F.first("before").alias("before"))

        def solved(batches, first=step == 0):
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    mean, cov = _estimate(r["n"], np.array(r["s"]), np.array(r["q"]), factor)
                    det = float(np.linalg.slogdet(cov)[1])
                    rows.append((r["g"], r["k"], (det, mean, cov), np.inf if first else max(0.0, r["before"] - det)))
                yield from _models(rows).to_batches()

        step += 1
        moved = common.materialize(sums.mapInArrow(solved, _MODEL), "quality-models")
        if step == 2:  # the best of each group goes on alone
            best = moved.groupBy("g").agg(F.min_by("k", F.struct("det", "k")).alias("k"))
            moved = common.materialize(moved.join(best, ["g", "k"]).select(*moved.columns), "quality-models")
        over = (F.col("fall") < SETTLED) & F.lit(step >= 2)
        done, moving = done.unionByName(moved.filter(over).select("g", "m", "p")), moved.filter(~over)
    return common.materialize(done, "quality-models")


def _distance2() -> str:
    """SQL: the squared Mahalanobis distance of the statistics from the estimate m, p."""
    d, z = len(STATISTICS), [f"({n} - m[{i}])" for i, n in enumerate(STATISTICS)]
    return " + ".join(f"p[{i * d + j}] * {z[i]} * {z[j]}" for i in range(d) for j in range(d))


def judged(docs: DataFrame, text: str = "text", cut: float = CUT, keep_text: bool = False) -> DataFrame:
    """docs with the counts, base_failed, distance (Mahalanobis) and kept. Needs columns lang and source."""
    added = [*COUNTS, "base_failed", "distance", "kept"]
    base = counted(docs.drop(*[c for c in added if c in docs.columns]), text, keep_text)
    base = common.materialize(base, "quality-counts")
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    fine = F.concat_ws("\u0001", key("lang"), key("source"))
    # one name space for the groups of all three levels
    fine, wide = F.concat(F.lit("fine"), fine), F.concat(F.lit("lang"), key("lang"))
    # what came in travels under names of its own, so that nothing clashes
    own = {c: f"_own{i}" for i, c in enumerate(c for c in base.columns if c not in COUNTS)}
    whole = base.select(*COUNTS, *[F.col(c).alias(n) for c, n in own.items()], failed.alias("base_failed"), fine.alias("_fine"), wide.alias("_lang"))
    stats = [F.expr(e).alias(n) for n, e in STATISTICS.items()]
    passed = whole.filter("not base_failed").select("_fine", "_lang", *stats)
    # which groups need an estimate: each of LEAST documents, and above it what documents of smaller ones turn to
    sizes = common.materialize(passed.groupBy("_fine", "_lang").agg(F.count("*").alias("n")), "quality-groups")
    langs = common.materialize(sizes.groupBy("_lang").agg(F.sum("n").alias("n"), F.min("n").alias("least")), "quality-languages")
    needed = sizes.filter(F.col("n") >= LEAST).select(F.col("_fine").alias("g"))
    needed = needed.unionByName(langs.filter((F.col("least") < LEAST) & (F.col("n") >= LEAST)).select(F.col("_lang").alias("g")))
    needed = needed.unionByName(langs.filter(F.col("n") < LEAST).select(F.lit("all").alias("g")).distinct())
    leveled = passed.select(F.explode(F.array("_fine", "_lang", F.lit("all"))).alias("g"), *STATISTICS)
    models = estimates(leveled.join(common.materialize(needed, "quality-needed"), "g", "left_semi"))
    placed = whole.withColumn("_all", F.lit("all")).select("*", *stats)
    for key in ("_fine", "_lang", "_all"):
        placed = placed.join(models.select(F.col("g").alias(key), F.col("m").alias(f"{key}_m"), F.col("p").alias(f"{key}_p")), key, "left")
    placed = placed.withColumns({c: F.coalesce(*[F.col(f"{k}_{c}") for k in ("_fine", "_lang", "_all")]) for c in "mp"})
    out = placed.withColumn("distance", F.expr(f"sqrt(greatest(0D, {_distance2()}))")).withColumn("kept", F.expr(f"not base_failed and coalesce(distance <= {cut!r}D, true)"))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in base.columns], "base_failed", "distance", "kept")
