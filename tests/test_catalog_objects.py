from __future__ import annotations

from tidemark.sources import objects


def test_policies_and_their_switch(spark):
    extract = spark.createDataFrame([("t", "p1", "PERMISSIVE", "ALL", ["b", "a"], "x", None), ("u", "p2", "RESTRICTIVE", "SELECT", None, None, "y"), ("v", "p3", "PERMISSIVE", "ALL", [], None, None), ("script_patch", "p4", "PERMISSIVE", "ALL", [], None, None)], "table string, name string, mode string, command string, roles array<string>, using string, with_check string")
    switch = spark.createDataFrame([("t", True, False), ("u", False, True)], "table string, enabled boolean, forced boolean")
    rows = {r.name: r for r in objects.policies(extract, switch).collect()}
    assert {k: (r.permissive, r.roles, r.enforced) for k, r in rows.items()} == {"p1": (True, ["a", "b"], True), "p2": (False, None, False), "p3": (True, [], False)}


def test_sequences_of_the_tools_tables_are_hidden(spark):
    s = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sequence string")
    depends = spark.createDataFrame([("a", "t", 1, "a"), ("b", "script_patch", 1, "i"), ("c", "script_patch", 1, "n"), ("d", "t", 9, "i")], "sequence string, table string, number int, kind string")
    attributes = spark.createDataFrame([("t", 1, "id")], "table string, number int, column string")
    rows = sorted(tuple(r) for r in objects.sequences(s, depends, attributes).fillna("-").select("sequence", "owned_by_table", "owned_by_column").collect())
    assert rows == [("a", "t", "id"), ("c", "-", "-"), ("d", "t", "-")]


def test_empty_extracts(spark):
    none = lambda kind: spark.createDataFrame([], kind)
    extract = "routine_id int, name string, letter string, arguments array<int>, language string, definition string"
    assert objects.routines(none(extract), none("type_id int, type string"), none("routine_id int")).count() == 0
    one = spark.createDataFrame([(1, "f", "f", None, "sql", "x"), (2, "g", "p", [7, 7], "sql", "y"), (3, "h", "w", [], "c", "z")], extract)
    types = spark.createDataFrame([(7, "text")], "type_id int, type string")
    assert sorted(r.identity for r in objects.routines(one, types, none("routine_id int")).collect()) == ["f()", "g(text, text)"]
    classes = spark.createDataFrame([("t", "r", False, None), ("i", "i", False, None)], "table string, kind string, is_partition boolean, bounds string")
    rows = objects.partitioning(classes, none("table string, letter string, key string"), none("child string, parent string, position int")).collect()
    assert [(r.table, r.strategy, r.inherits) for r in rows] == [("t", None, None)]
