"""Reachability, ancestors and order in dependency graphs: rounds over what the last one found, to the fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialize


def _kept(df: DataFrame) -> DataFrame:
    return materialize(df, "graph")


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Everything reachable from `start` (node) over edges (parent, child): node, depth (the least). Nodes once found are not followed again, so cycles end."""
    edges = _kept(edges.select("parent", "child").distinct())
    new = found = _kept(start.select("node").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not new.isEmpty():
        depth += 1
        reached = new.join(edges, new.node == edges.parent).select(F.col("child").alias("node")).distinct()
        new = _kept(reached.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        found = _kept(found.unionByName(new))
    return found


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) over edges (child, parent): every ancestor of every child, with its least depth. A pair once found isn't followed again, so cycles end; a node is no ancestor of its own."""
    edges = _kept(edges.select("child", "parent").distinct())
    new = found = _kept(edges.filter("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    depth = 1
    while not new.isEmpty():
        depth += 1
        reached = new.join(edges, new.ancestor == edges.child).select("node", F.col("parent").alias("ancestor")).filter("node <> ancestor").distinct()
        new = _kept(reached.join(found, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        found = _kept(found.unionByName(new))
    return found


def folded(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """Each table with the highest ancestor that is among the tables, itself if none: so partitions aren't counted twice."""
    up = ancestors(edges).join(tables.select(F.col("table").alias("ancestor")), "ancestor", "left_semi")
    top = up.groupBy("node").agg(F.max_by("ancestor", F.struct("depth", "ancestor")).alias("top"))
    return tables.join(top.withColumnRenamed("node", "table"), "table", "left").withColumn("top", F.coalesce("top", "table"))


def topological_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node) with depth: 0 without dependencies, else one more than the deepest of them; order by depth, then node.

    edges: node depends on `needs`; needs that are not among the nodes don't count. Raises ValueError if there is a cycle."""
    edges = _kept(edges.select("node", "needs").distinct())
    new = found = _kept(nodes.select("node").distinct().withColumn("depth", F.lit(0)))
    most, depth = found.count(), 0
    while not new.isEmpty():
        # a path of as many edges as there are nodes comes back to one of them
        if depth >= most:
            raise ValueError("dependencies have a cycle")
        depth += 1
        reached = new.join(edges.select(F.col("node").alias("_node"), "needs"), F.col("node") == F.col("needs")).select(F.col("_node").alias("node")).distinct()
        new = _kept(reached.withColumn("depth", F.lit(depth)))
        found = _kept(found.unionByName(new).groupBy("node").agg(F.max("depth").alias("depth")))
    return found


def dependents(*edges: tuple[str, DataFrame]) -> DataFrame:
    """Union of edge tables (object, depends_on), each with its kind; by object depended on, its dependents in order."""
    union = None
    for kind, df in edges:
        part = df.select(F.col("depends_on"), F.struct(F.lit(kind).alias("kind"), F.col("object")).alias("d"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy("depends_on").agg(F.sort_array(F.collect_set("d")).alias("dependents"))
