"""Joins by name, by signature and by similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import string_similarity

#: Pairs beyond which no similarity matching is tried.
TABLE_PAIRS, COLUMN_PAIRS = 10_000, 500_000


def outer_by_name(left: DataFrame, right: DataFrame, name: str, more: Sequence[str] = ()) -> DataFrame:
    """Full outer join on the trimmed, case-sensitive name (and `more` columns): status matched, onlyA or onlyB."""
    side = lambda df, flag: df.select(F.trim(F.col(name)).alias(name), *more, F.lit(True).alias(flag)).distinct()
    both = side(left, "in_a").join(side(right, "in_b"), [name, *more], "full_outer")
    return both.select(name, *more, F.when(F.col("in_b").isNull(), "onlyA").when(F.col("in_a").isNull(), "onlyB").otherwise("matched").alias("status"))


def keyed_objects(left: DataFrame, right: DataFrame, keys: Sequence[str], kind: str = "kind", definition: str = "definition") -> DataFrame:
    """Full outer join of objects: same, kind mismatch, definition mismatch, onlyA or onlyB."""
    side = lambda df, s: df.select(*keys, F.col(kind).alias(f"kind_{s}"), F.col(definition).alias(f"definition_{s}"), F.lit(True).alias(s))
    both = side(left, "a").join(side(right, "b"), list(keys), "full_outer")
    status = F.when(F.col("b").isNull(), "onlyA").when(F.col("a").isNull(), "onlyB").when(~F.col("kind_a").eqNullSafe(F.col("kind_b")), "kindMismatch").when(~F.col("definition_a").eqNullSafe(F.col("definition_b")), "definitionMismatch").otherwise("same")
    return both.withColumn("status", status).drop("a", "b")


def two_stage(left: DataFrame, right: DataFrame, first: str, second: str, group: Sequence[str] = ()) -> DataFrame:
    """Match on `first`, then what is left on `second`; each side once. Result: left_id, right_id, stage.

    Both sides need an id; of several with one signature the smallest ids pair off in order."""
    order = Window.partitionBy(*group, second).orderBy("id")
    a, b = left.select("id", first, second, *group), right.select("id", first, second, *group)
    one = a.withColumnRenamed("id", "left_id").drop(second).join(b.withColumnRenamed("id", "right_id").drop(second), [first, *group]).select("left_id", "right_id", F.lit(1).alias("stage"))
    left_over = a.join(one.select(F.col("left_id").alias("id")), "id", "left_anti").withColumn("n", F.row_number().over(order)).withColumnRenamed("id", "left_id").drop(first)
    right_over = b.join(one.select(F.col("right_id").alias("id")), "id", "left_anti").withColumn("n", F.row_number().over(order)).withColumnRenamed("id", "right_id").drop(first)
    two = left_over.join(right_over, [second, "n", *group], "full_outer").select("left_id", "right_id", F.when(F.col("left_id").isNotNull() & F.col("right_id").isNotNull(), 2).alias("stage"))
    return one.unionByName(two)


def within_budget(left: DataFrame, right: DataFrame, most: int = TABLE_PAIRS) -> bool:
    """Whether the pairs stay within the budget; only most + 1 rows of each side are counted."""
    a, b = (df.select(F.lit(1)).limit(most + 1).count() for df in (left, right))
    return a * b <= most


def scored_pairs(left: DataFrame, right: DataFrame, score: Column | None = None) -> DataFrame:
    """All pairs of two metadata tables (id, name, ...), columns l and r (structs), score rounded to 0.1 of 100. Call within_budget() first."""
    pairs = left.select(F.struct("*").alias("l")).join(F.broadcast(right.select(F.struct("*").alias("r"))), F.lit(True))
    value = score if score is not None else string_similarity(F.col("l.name"), F.col("r.name")) * 100
    return pairs.withColumn("score", F.floor(value * 10 + F.lit(0.5)) / F.lit(10.0))


def mutual_best(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (left_id, right_id, score) that are each other's best at `least` or more; ties go to the smaller id of the other side."""
    by_left = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    by_right = Window.partitionBy("right_id").orderBy(F.desc("score"), "left_id")
    return pairs.withColumn("rl", F.row_number().over(by_left)).withColumn("rr", F.row_number().over(by_right)).filter((F.col("rl") == 1) & (F.col("rr") == 1) & (F.col("score") >= least)).select("left_id", "right_id", "score")


def match_renames(pairs: DataFrame, accept: float, suggest: float) -> tuple[DataFrame, DataFrame]:
    """Rounds of mutual bests until nothing more is accepted or blocked: (accepted, candidates).

    pairs: left_id, right_id, score, allowed. A mutual best that is not allowed is blocked as a pair, not as
    items. Candidates are the mutual bests at `suggest` or more among what is left, blocked pairs included.
    Pairs are within the budget (metadata), so they are scored and collected once, and the loop runs on the driver."""
    pairs = pairs.select("left_id", "right_id", "score", "allowed")
    rows = {(r.left_id, r.right_id): (r.score, r.allowed) for r in pairs.collect()}
    accepted: list[tuple] = []
    blocked: set = set()
    while True:
        open_pairs = {p: v for p, v in rows.items() if p not in blocked and v[0] >= accept}
        hits = _bests(open_pairs)
        good = [p for p in hits if rows[p][1]]
        blocked |= set(hits) - set(good)
        if not hits:
            break
        accepted += [(*p, rows[p][0]) for p in good]
        left, right = {a for a, _ in good}, {b for _, b in good}
        rows = {p: v for p, v in rows.items() if p[0] not in left and p[1] not in right}
    rest = [(*p, rows[p][0]) for p in _bests({p: v for p, v in rows.items() if v[0] >= suggest})]
    schema = pairs.drop("allowed").schema
    return pairs.sparkSession.createDataFrame(accepted, schema), pairs.sparkSession.createDataFrame(rest, schema)


def _bests(pairs: dict) -> list[tuple]:
    best_left: dict = {}
    best_right: dict = {}
    for (a, b), (score, _) in sorted(pairs.items()):
        if a not in best_left or score > best_left[a][0]:
            best_left[a] = (score, b)
        if b not in best_right or score > best_right[b][0]:
            best_right[b] = (score, a)
    return [(a, b) for a, (_, b) in sorted(best_left.items()) if best_right[b][1] == a]
