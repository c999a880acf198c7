"""Set operations on tables and token sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

LEFT, RIGHT = 1_000, 2_000  # rows of a block and of a part, about, that token_similarity compares in one group


def appeared_resolved(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys only in the later run (appeared) and only in the earlier one (resolved)."""
    keys = list(key)
    new = after.select(*keys).distinct().join(before.select(*keys), keys, "left_anti").withColumn("status", F.lit("appeared"))
    gone = before.select(*keys).distinct().join(after.select(*keys), keys, "left_anti").withColumn("status", F.lit("resolved"))
    return new.unionByName(gone)


def multiset_similarity(bags: DataFrame, pairs: DataFrame, group: str, item: str) -> DataFrame:
    """Sum of minima over sum of maxima of item counts, for given pairs (a, b) of groups; 1 if both are empty."""
    counts = bags.groupBy(group, item).agg(F.count("*").alias("n"))
    sizes = counts.groupBy(group).agg(F.sum("n").alias("size"))
    shared = pairs.join(counts.withColumnRenamed(group, "a").withColumnRenamed("n", "x"), "a").join(counts.withColumnRenamed(group, "b").withColumnRenamed("n", "y"), ["b", item]).groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("shared"))
    sized = pairs.join(sizes.select(F.col(group).alias("a"), F.col("size").alias("sa")), "a", "left").join(sizes.select(F.col(group).alias("b"), F.col("size").alias("sb")), "b", "left").join(shared, ["a", "b"], "left")
    s, a, b = (F.coalesce(F.col(c), F.lit(0)) for c in ("shared", "sa", "sb"))
    return sized.select("a", "b", F.when(a + b == 0, F.lit(1.0)).otherwise(s.cast("double") / (a + b - s)).alias("similarity"))


def token_similarity(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str) -> DataFrame:
    """Jaccard similarity of the sets of lower-case words of every left and right row that share one: left_id, right_id, similarity. Pairs that share none have 0 and no row.

    Nearly all pairs share a word, so blocks of some LEFT rows meet parts of some RIGHT rows, each pair of the two in one group that counts shared words in numpy: what is
    shuffled is the sets, not pairs. Rows of one id are one set. Words are compared by 64-bit hashes."""
    words = F.array_distinct(F.transform(F.filter(F.split(F.lower(text), " "), lambda w: w != ""), lambda w: F.xxhash64(w)))
    sets = [df.select(F.col(key).alias("id"), words.alias("value")).filter("id is not null and size(value) > 0") for df, key in ((left, left_id), (right, right_id))]
    blocks, parts = (max(1, -(-df.count() // n)) for df, n in ((left, LEFT), (right, RIGHT)))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    tasks = min(blocks * parts, 20_000)
    a = sets[0].withColumn("block", mine(blocks)).select("*", every(parts).alias("part")).repartition(tasks, "block", "part")
    b = sets[1].withColumn("part", mine(parts)).select("*", every(blocks).alias("block")).repartition(tasks, "block", "part")

    def distinct(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Ids, and each distinct token of each with its id's place."""
        ids = rows["id"].combine_chunks().unique()
        place = pc.index_in(rows["id"], ids).to_numpy()
        n = pc.list_value_length(rows["value"]).to_numpy()
        row, token = np.repeat(place, n).astype(np.int64), pc.list_flatten(rows["value"]).to_numpy()
        if len(ids) < len(rows):
            by = np.lexsort((token, row))
            row, token = row[by], token[by]
            new = np.append(True, (np.diff(row) != 0) | (token[1:] != token[:-1]))
            row, token = row[new], token[new]
        return ids, row, token

    def shared(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
        if not len(x) or not len(y):
            return
        (xs, x_row, x_token), (ys, y_row, y_token) = distinct(x), distinct(y)
        x_n, y_n = np.bincount(x_row, minlength=len(xs)), np.bincount(y_row, minlength=len(ys))
        by = np.argsort(x_token, kind="stable")
        token, start, often = np.unique(x_token[by], return_index=True, return_counts=True)
        owners = x_row[by]
        at = np.searchsorted(token, y_token)
        at[at == len(token)] = 0
        known = token[at] == y_token
        y_row, at = y_row[known], at[known]
        of = np.argsort(y_row, kind="stable")
        y_row, at = y_row[of], at[of]
        for first in range(0, len(ys), 256):
            lo, hi = np.searchsorted(y_row, [first, first + 256])
            n = often[at[lo:hi]]
            ends = np.cumsum(n)
            owner = owners[np.arange(n.sum()) + np.repeat(start[at[lo:hi]] - (ends - n), n)]
            count = np.bincount(np.repeat(y_row[lo:hi] - first, n) * len(xs) + owner)
            pair = np.flatnonzero(count)
            i, j, both = pair % len(xs), pair // len(xs) + first, count[pair]
            yield pa.RecordBatch.from_arrays([xs.take(pa.array(i)), ys.take(pa.array(j)), pa.array(both / (x_n[i] + y_n[j] - both))], names=["left", "right", "similarity"])

    kinds = [s.schema["id"].dataType.simpleString() for s in sets]
    whole = lambda x, y: pa.Table.from_batches(shared(x, y), empty)
    empty = pa.schema([("left", to_arrow_type(sets[0].schema["id"].dataType)), ("right", to_arrow_type(sets[1].schema["id"].dataType)), ("similarity", pa.float64())])
    found = a.groupBy("block", "part").cogroup(b.groupBy("block", "part")).applyInArrow(whole, f"left {kinds[0]}, right {kinds[1]}, similarity double")
    return found.select(F.col("left").alias(left_id), F.col("right").alias(right_id), "similarity")


def structure_diff(before: DataFrame, after: DataFrame, key: Sequence[str], shape: str, parent: str | None = None) -> DataFrame:
    """Items (key, shape) that are gone, added or changed; children of parents that are gone as a whole are left out."""
    keys = list(key)
    both = before.select(*keys, F.col(shape).alias("before"), F.lit(True).alias("b")).join(after.select(*keys, F.col(shape).alias("after"), F.lit(True).alias("a")), keys, "full_outer")
    status = F.when(F.col("a").isNull(), "gone").when(F.col("b").isNull(), "added").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    out = both.withColumn("status", status).filter("status is not null").drop("a", "b")
    if parent is None:
        return out
    lost = before.select(parent).distinct().join(after.select(parent).distinct(), parent, "left_anti")
    return out.filter("status <> 'gone'").unionByName(out.filter("status = 'gone'").join(lost, parent, "left_anti"))


def shared_columns(left: Sequence[str], right: Sequence[str]) -> dict[str, list[str]]:
    """Columns of both sides, and of one side alone, in the left's order."""
    return {"shared": [c for c in left if c in right], "only_left": [c for c in left if c not in right], "only_right": [c for c in right if c not in left]}


def in_list(df: DataFrame, rows: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Rows whose tuple of columns is in a given list (a bounded argument, so it is broadcast)."""
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(list(rows), kinds)), list(columns), "left_semi")


def differs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where two columns are distinct, nulls counting as equal."""
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def count_per_parent(parents: DataFrame, children: DataFrame, key: str, name: str = "children") -> DataFrame:
    """A scalar subquery a row, as an aggregate and a left join."""
    return parents.join(children.groupBy(key).agg(F.count("*").alias(name)), key, "left").fillna(0, subset=[name])
