"""Row data compared by a tree of checksums over key ranges: only ranges that differ are read again.

One scan of each side sums the rows' digests by narrow key ranges, which are the leaves; a node above is the sum of
its children. The trees are compared from the root down, children of differing nodes alone. Key intervals of the
nodes at which the descent ends are pushed into a second scan of both sides, whose rows are compared key by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize
from . import rowdiff

FANOUT, DEPTH = 16, 5  # 16 ** 5 leaves, about a million, each with rows
INTERVALS = 200  # key intervals that the second scan filters by


def position(key: str, kind: T.DataType) -> Column:
    """A whole number that never falls as the key rises: integers as they are, days, microseconds, or the first seven bytes of a text."""
    if isinstance(kind, T.IntegralType):
        return F.col(key).cast("decimal(20,0)")
    if isinstance(kind, T.DateType):
        return F.unix_date(key).cast("decimal(20,0)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key).cast("decimal(20,0)")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(key), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("decimal(20,0)")
    raise TypeError(f"keys of type {kind.simpleString()} have no ranges")


def leaves(df: DataFrame, key: str, columns: Sequence[str], low: int, width: int) -> DataFrame:
    """node, n, a, b, first, last: rows, sums of two parts of the rows' digests, and the least and greatest key of each leaf. Null keys are left out."""
    part = lambda at: F.sum(F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(20,0)"))
    at = F.floor((position(key, df.schema[key].dataType) - F.lit(low).cast("decimal(20,0)")) / width).cast("long")
    rows = df.filter(F.col(key).isNotNull()).select(at.alias("node"), F.col(key).alias("k"), rowdiff.digest(columns).alias("d"))
    return rows.groupBy("node").agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"), F.min("k").alias("first"), F.max("k").alias("last"))


def levels(tree: DataFrame, fanout: int, depth: int) -> DataFrame:
    """All nodes: level (0: root), node, n, a, b, first, last."""
    every = tree.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("up"))
    power = F.pow(F.lit(float(fanout)), F.col("up")).cast("long")
    return every.groupBy((depth - F.col("up")).alias("level"), F.floor(F.col("node") / power).cast("long").alias("node")).agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")], F.min("first").alias("first"), F.max("last").alias("last"))


def differing(left: DataFrame, right: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, most: int = INTERVALS) -> tuple[int, DataFrame]:
    """(level, nodes that differ: node, first, last) of two trees of levels(), the deepest at which at most `most` nodes differ."""
    found, level = None, 0
    for at in range(depth + 1):
        a, b = (t.filter(F.col("level") == at).drop("level") for t in (left, right))
        if found is not None:
            under = found.select(F.col("node").alias("parent"))
            a, b = (t.join(under, F.floor(t.node / fanout) == F.col("parent"), "left_semi") for t in (a, b))
        sums = lambda t, s: t.select("node", F.struct("n", "a", "b").alias(f"sums_{s}"), F.col("first").alias(f"first_{s}"), F.col("last").alias(f"last_{s}"))
        both = sums(a, "a").join(sums(b, "b"), "node", "full_outer").filter(~F.col("sums_a").eqNullSafe(F.col("sums_b")))
        below = materialize(both.select("node", F.least("first_a", "first_b").alias("first"), F.greatest("last_a", "last_b").alias("last")), "rowtree-nodes")
        if at and below.count() > most:
            break
        found, level = below, at
    return level, found


def tree_diff(source: DataFrame, target: DataFrame, key: str, values: Sequence[str], more_keys: Sequence[str] = (), fanout: int = FANOUT, depth: int = DEPTH, most: int = INTERVALS) -> DataFrame:
    """The rows of keyed_diff() that aren't the same. key leads the key columns and gives the ranges; null keys are left out."""
    columns = [key, *more_keys, *values]
    ends = [df.agg(F.min(key).alias("first"), F.max(key).alias("last")) for df in (source, target)]
    both = ends[0].unionByName(ends[1]).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    kind = source.schema[key].dataType
    low, high = both.select(position("first", kind), position("last", kind)).first()
    if low is None:
        low = high = 0
    width = max(1, -(-(int(high) - int(low) + 1) // fanout**depth))
    trees = [materialize(levels(leaves(df, key, columns, int(low), width), fanout, depth), "rowtree") for df in (source, target)]
    _, nodes = differing(*trees, fanout, depth, most)
    again = [df.filter(_within(key, nodes)) for df in (source, target)]
    return rowdiff.keyed_diff(*again, [key, *more_keys], values).filter("verdict <> 'same'")


def _within(key: str, nodes: DataFrame) -> Column:
    """The key is in one of the nodes' intervals: literals, so that the scan skips what lies between them. Nodes are few, neighbours become one."""
    merged: list[list] = []
    for r in nodes.orderBy("node").collect():
        if merged and r["node"] == merged[-1][2] + 1:
            merged[-1][1:] = [r["last"], r["node"]]
        else:
            merged.append([r["first"], r["last"], r["node"]])
    inside = [F.col(key).between(F.lit(a), F.lit(b)) for a, b, _ in merged] or [F.lit(False)]
    while len(inside) > 1:  # a balanced tree: no deep nesting
        inside = [x | y for x, y in zip(inside[::2], inside[1::2], strict=False)] + inside[len(inside) - len(inside) % 2 :]
    return inside[0]
