"""Queries whose fault shows only on keys or sizes that the small tables don't have, against their DuckDB SQL."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import oracles, queries, scratch, tasks
from tidemark.functions import sqltext
from tidemark.plans import advice


def same_as_sql(spark, name, top, **tables):
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{top}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{top}/{table}.parquet')")
    found = queries.QUERIES[name](spark, str(top))
    columns = ", ".join(f'"{c}"' for c in found.columns)
    want = con.sql(f"SELECT {columns} FROM ({oracles.ORACLES[name]})").fetchall()
    assert want and Counter(map(repr, map(tuple, found.collect()))) == Counter(map(repr, want))


ORDERS = """SELECT k AS o_orderkey, k % 7 AS o_custkey, 'O' AS o_orderstatus, k % 1000 + 0.5::DOUBLE AS o_totalprice, TIMESTAMP '1998-02-06' + to_days((k % 90)::INT) AS o_orderdate,
    CASE WHEN k % 11 <> 0 THEN (k % 5) || '-P' END AS o_orderpriority FROM (SELECT i + j * 1000000 AS k FROM range(500) AS a(i), range(3) AS b(j))"""


def test_orders_whose_shifted_keys_meet_others(spark, tmp_path):
    """Keys over a million: the other side's added orders have keys that the source has with another priority, or with none."""
    same_as_sql(spark, "data_compare_summary", tmp_path, orders=ORDERS)


@pytest.mark.parametrize("name", ["script_steps", "script_grades", "script_readings", "part_query_findings", "part_filters", "order_plan_steps", "order_plan_findings", "order_plan_scores"])
def test_python_work_is_spread(spark, monkeypatch, name):
    """Texts that Python reads are dealt over tasks by their number: their tables are one small file, and joins of them are coalesced."""
    monkeypatch.setattr(tasks, "ROWS", 60)
    ran = []
    monkeypatch.setattr(scratch, "materialize", lambda df, label, keep=scratch.materialize: ran.append(df) or keep(df, label))
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    python = [x for x in [*ran, df] if "Eval" in (plan := x._jdf.queryExecution().executedPlan().toString()) or "InPandas" in plan or "InArrow" in plan]
    assert python and all("REPARTITION_BY_NUM" in x._jdf.queryExecution().executedPlan().toString() for x in python)
    if not ran:
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_a_script_is_read_once():
    """review() is grade(), destroys() and might_fail(), also for names that hold what separates words."""
    for text in ("DROP TABLE t; DELETE FROM u", 'ALTER TABLE t ADD COLUMN "set\0not\0null" int', "DO $$ BEGIN EXECUTE x; ALTER TABLE t ADD CONSTRAINT c UNIQUE (a); END $$", "", "ALTER TABLE t ALTER a SET NOT NULL"):
        assert sqltext.review(text) == (*sqltext.grade(text), sqltext.destroys(text), sqltext.might_fail(text))
    assert sqltext.grade('ALTER TABLE t ADD COLUMN "set\0not\0null" int') == ("additive", None, None)


def test_advice_on_a_table_with_many_indexes(spark):
    """Rules on two indexes of a table are joins on columns: none pairs all indexes of a table. Names that differ and names that don't, empty and null lists."""
    kind = "table string, index string, columns array<string>, is_unique boolean, valid boolean, supports string"
    lists = [["a"], ["a"], ["a", "b"], ["b", "a"], ["b"], [], None, ["a", "b", "c"], ["a", None], ["c"]]
    rows = [(f"t{i % 2}", f"i{i % 17:02d}", lists[i % 10], None if i == 7 else i % 3 == 0, i % 7 != 0, "u" if i % 5 == 0 else None) for i in range(60)] + [("t3", "x", ["a"], False, True, None), ("t3", "x", ["a", "b"], False, True, None)]
    keys = [("t0", "f1", ["b", "a"]), ("t0", "f2", ["z"]), ("t1", "f3", ["c", "b", "a"]), ("t1", "f4", ["c", "b"]), ("t3", "f5", []), ("t0", "f6", None), ("t1", "f7", ["b"])]
    empty = lambda schema: spark.createDataFrame([], schema)
    found = advice.structural(empty("table string, has_primary_key boolean"), empty("table string, column string, type string, default string, in_primary_key boolean"), spark.createDataFrame(rows, kind), spark.createDataFrame(keys, "table string, name string, columns array<string>"))
    ok = [r for r in rows if r[4]]
    text = lambda c: sorted(map(str, c))
    dup = {r for r in map(repr, (a for a in ok for b in ok if a[0] == b[0] and a[2] is not None and a[2] == b[2] and a[3] is not None and a[3] == b[3] and a[1] > b[1] and a[5] is None))}
    red = {r for r in map(repr, (a for a in ok for b in ok if a[0] == b[0] and a[2] and b[2] and len(a[2]) < len(b[2]) and b[2][: len(a[2])] == a[2] and a[3] is False and a[1] != b[1] and a[5] is None))}
    bare = {k[1] for k in keys if not any(k[0] == b[0] and k[2] is not None and b[2] is not None and text(b[2][: max(1, len(k[2]))]) == text(k[2]) for b in ok)}
    got = [(r.advice, r.subject) for r in found.collect()]
    count = lambda name: sum(a == name for a, _ in got)
    assert count("duplicate-index") == len(dup) > 5 and count("redundant-index") == len(red) > 3 and {s for a, s in got if a == "foreign-key-not-indexed"} == bare
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in line]
    assert len(joins) == 4 and all(line.count(" = ") + line.count(" <=> ") >= 2 for line in joins)  # never on the table alone
