from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import prefix


@pytest.fixture(scope="module")
def events(spark):
    """One key holds a third of the rows; nulls among keys, orders and values; ties in the first order column."""
    r = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(1000))
    key = F.when(F.col("id") % 3 == 0, "hot").when(r(1) < 40, None).otherwise(F.concat(F.lit("k"), r(2) % 30))
    value = F.when(r(3) < 700, r(4))
    made = spark.range(3000).select("id", key.alias("k"), F.when(r(5) > 10, (r(5) % 500).cast("int")).alias("t"), value.alias("v"))
    return spark.createDataFrame([tuple(x) for x in made.collect()], made.schema)


@pytest.mark.parametrize("rows", [37, 200, 10_000])
def test_equals_the_window_form(events, rows):
    cut = prefix.pieced(events, ["k"], ["t", "id"], rows)
    assert ("_piece" in cut.columns) == (rows < 1000)
    if rows < 1000:  # the hot key is in many tasks
        hot = {r["_piece"]: r["count"] for r in cut.filter("k = 'hot'").groupBy("_piece").count().collect()}
        assert sum(hot.values()) == 1000 and len(hot) > 1000 / rows / 2 and max(hot.values()) < 3 * rows
    w = Window.partitionBy("k").orderBy("t", "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    forms = {
        "m": (prefix.max_before(cut, ["k"], ["t", "id"], "v", "m"), F.max("v").over(before)),
        "s": (prefix.sum_through(cut, ["k"], ["t", "id"], "v", "s"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))),
        "l": (prefix.last_before(cut, ["k"], ["t", "id"], "v", "l"), F.last("v", ignorenulls=True).over(before)),
    }
    for name, (found, window) in forms.items():
        assert Counter(tuple(r) for r in found.select("id", name).collect()) == Counter(tuple(r) for r in events.select("id", window.alias(name)).collect()), name
    found = prefix.row_before(cut, ["k"], ["t", "id"], "v", "b").select("id", "b.v", F.col("b").isNull().alias("none"))
    want = events.select("id", F.lag("v").over(w).alias("v"), (F.row_number().over(w) == 1).alias("none"))
    assert Counter(tuple(r) for r in found.collect()) == Counter(tuple(r) for r in want.collect())


def test_several_keys_and_empty(spark, events):
    two = events.withColumn("j", F.col("id") % 2)
    cut = prefix.pieced(two, ["k", "j"], ["t", "id"], 100)
    w = Window.partitionBy("k", "j").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    assert Counter(tuple(r) for r in prefix.max_before(cut, ["k", "j"], ["t", "id"], "v", "m").select("id", "m").collect()) == Counter(tuple(r) for r in two.select("id", F.max("v").over(w)).collect())
    none = prefix.pieced(events.limit(0), ["k"], ["t", "id"])
    assert prefix.last_before(none, ["k"], ["t", "id"], "v", "l").count() == 0


def test_histories_in_pieces(spark, events):
    """The operators that use it give the same in pieces as in one."""
    from tidemark.operators import history

    df = events.filter("t is not null").withColumns({"s": F.element_at(F.array(*map(F.lit, ("drifted", "in_sync", "unreachable"))), (F.pmod(F.xxhash64("id", F.lit("s")), F.lit(3)) + 1).cast("int")), "f": F.when(F.col("v").isNotNull(), F.concat(F.lit("f"), F.col("v") % 3))})
    for run in (lambda n: history.below_high_water(df, "k", ["t", "id"], "v", rows=n), lambda n: history.last_known(df, ["k"], ["t", "id"], "f", rows=n), lambda n: history.recorded_outcomes(df, "k", ["t", "id"], "s", "f", rows=n)):
        one, cut = run(10_000), run(90)
        assert one.columns == cut.columns and Counter(tuple(r) for r in one.collect()) == Counter(tuple(r) for r in cut.collect())


def test_rounds_of_cuts(spark, monkeypatch):
    """No row meets more cut points than a round has, however many pieces there are; many rows of one value, and nulls, end the rounds."""
    monkeypatch.setattr(prefix, "FAN", 8)
    written = []
    monkeypatch.setattr(prefix, "materialize", lambda df, label, keep=prefix.materialize: written.append((label, out := keep(df, label))) or out)
    t = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 2 == 0, 7_777).otherwise(F.pmod(F.xxhash64("id"), F.lit(5_000)))
    df = spark.range(6_000).select("id", F.lit("k").alias("k"), t.alias("t"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(99)).alias("v"))
    cut = prefix.pieced(df, ["k"], ["t", "id"], 20)
    found = prefix.sum_through(cut, ["k"], ["t", "id"], "v", "s").select("id", "s")
    want = df.select("id", F.sum("v").over(Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, want.collect()))
    assert max(r[0] for label, table in written if label == "prefix-cuts" for r in table.select(F.max(F.size("_cuts"))).collect()) < 8
    sizes = {r["_piece"]: r["count"] for r in cut.filter("t < 7777").groupBy("_piece").count().collect()}
    assert len(sizes) > 60 and max(sizes.values()) <= 60
