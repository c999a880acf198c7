from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import rowdiff, rowtree


def pair(spark, key, n=4000):
    a = spark.range(n).select(key.alias("k"), F.concat(F.lit("row "), "id").alias("v"), F.col("id"))
    b = a.filter("id % 997 <> 5").withColumn("v", F.when(F.col("id").isin(70, 71, 3999), "other").otherwise(F.col("v")))
    more = spark.createDataFrame([(n + 1,)], "id long").select(key.alias("k"), F.lit("new").alias("v"), "id")
    return a, b.unionByName(more)


KEYS = {
    "long": "id * 7 - 900", "wide": "id * 1000000000000007", "day": "date_add(DATE '1960-01-01', cast(id as int))",
    "time": "timestamp_micros(id * 1234567)", "text": "concat('ü', lpad(id, 6, '0'))", "alike": "concat('same beginning ', id)",
}


@pytest.mark.parametrize(("kind", "most"), [("long", 1), *((k, 200) for k in KEYS)])
def test_equals_the_keyed_diff(spark, kind, most):
    a, b = pair(spark, F.expr(KEYS[kind]))
    want = {tuple(r) for r in rowdiff.keyed_diff(a, b, ["k"], ["v"]).filter("verdict <> 'same'").collect()}
    got = rowtree.tree_diff(a, b, "k", ["v"], fanout=8, depth=3, most=most).collect()
    assert {tuple(r) for r in got} == want and len(want) == len(got) == 9


def scanned(df):
    """Rows that the scans of an executed query gave out."""
    df.collect()
    plan, rows = df._jdf.queryExecution().executedPlan(), 0
    found = [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan]
    while found:
        node = found.pop()
        name = node.nodeName()
        if name.endswith("QueryStage"):
            found.append(node.plan())
        if name.startswith("Scan parquet"):
            rows += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        found += [children.apply(i) for i in range(children.size())]
    return rows


def test_equal_ranges_are_not_read_again(spark, tmp_path):
    """Forty files of 1,000 keys; three keys of two files differ: the second scan gives out the rows of those files at most."""
    a, _ = pair(spark, F.col("id"), 40_000)
    for side, df in (("a", a), ("b", a.withColumn("v", F.when(F.col("id").isin(70, 71, 20_500), "other").otherwise(F.col("v"))))):
        df.repartitionByRange(40, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / side))
    out = rowtree.tree_diff(*(spark.read.parquet(str(tmp_path / s)) for s in "ab"), "k", ["v"], fanout=16, depth=2)
    assert 0 < scanned(out) <= 2 * 2 * 1500 and {r.k for r in out.collect()} == {70, 71, 20_500}


def test_more_keys_nulls_and_empty_sides(spark):
    a = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (None, 1, "x")], "k int, j int, v string")
    b = spark.createDataFrame([(1, 1, "a"), (1, 2, "c"), (2, 1, None), (3, 1, "d")], "k int, j int, v string")
    rows = lambda x, y: {(r.k, r.j, r.verdict) for r in rowtree.tree_diff(x, y, "k", ["v"], ["j"], depth=1).collect()}
    assert rows(a, b) == {(1, 2, "changed"), (3, 1, "targetOnly")}
    none = a.limit(0)
    assert rows(none, none) == set() and rows(none, b) == {(1, 1, "targetOnly"), (1, 2, "targetOnly"), (2, 1, "targetOnly"), (3, 1, "targetOnly")}
    assert rows(a, a) == set()
