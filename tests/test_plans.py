from __future__ import annotations

import json

import pytest

from tidemark.functions import sqltext
from tidemark.plans import advice, findings, steps

PLAN = {"Plan": {"Node Type": "Nested Loop", "Plan Rows": 10, "Total Cost": 1100.0, "Plans": [
    {"Node Type": "Seq Scan", "Relation Name": "a", "Filter": "(x = 1)", "Plan Rows": 100, "Total Cost": 100.0},
    {"Node Type": "Index Scan", "Relation Name": "b", "Plan Rows": 1, "Total Cost": 8.0},
]}}


@pytest.fixture(scope="module")
def flat(spark):
    return steps.weighed(steps.flattened(spark.createDataFrame([("p", json.dumps([PLAN])), ("q", None)], "plan_id string, plan string"))).cache()


def test_tree_becomes_steps(flat):
    rows = {r.step_id: r for r in flat.collect()}
    assert [(rows[i].depth, rows[i].parent_id) for i in (1, 2, 3)] == [(0, None), (1, 1), (1, 1)]
    assert rows[3].estimated_runs == 100 and rows[3].inner_side
    assert rows[3].self_cost == 800 and rows[1].self_cost == 200 and rows[2].self_cost == 100
    assert abs(sum(r.share for r in rows.values()) - 1) < 1e-9 and rows[3].heaviest and not rows[1].heaviest


def test_findings_and_score(spark, flat):
    sizes = spark.createDataFrame([("a", 1_000_000.0), ("b", 50.0)], "relation string, rows double")
    found = findings.plan_findings(flat, sizes)
    assert {(r.step_id, r.finding) for r in found.collect()} == {(2, "seq-scan")}
    r = steps.scored(flat, found, sizes).first()
    # 12 for the finding; the scan's share (0.09) is not material; the inner side runs too seldom to count
    assert (r.score, r.band) == (88, "good")
    assert findings.reads_only(flat).first().reads_only


@pytest.mark.parametrize("sql,why", [("SELECT 1", None), ("", "empty"), ("SELECT 1; SELECT 2", "several-statements"), ("UPDATE t SET a = 1", "not-a-query"), ("SELECT * FROM t FOR UPDATE", "locks"), ("SELECT pg_sleep(1)", None), ("SELECT pg_try_advisory_lock(1)", "denied-function"), ("SELECT \"dblink_open\" (1)", "denied-function"), ("SELECT dblink_url FROM t", None), ("WITH x AS (DELETE FROM t RETURNING *) SELECT * FROM x", "writes"), ("SELECT 'delete from t'", None)])
def test_gate(sql, why):
    assert findings.gate(sql) == why


@pytest.mark.parametrize(
    "sql,name",
    [
        ("SELECT * FROM t", "select-star"), ("SELECT a FROM t WHERE b LIKE '%x'", "leading-wildcard"), ("SELECT a FROM t WHERE lower(b) = 'x'", "function-on-column"), ("SELECT a FROM t WHERE b NOT IN (SELECT c FROM u)", "not-in-subquery"),
        ("SELECT a FROM t, u", "comma-join"), ("SELECT a FROM t ORDER BY a", "order-by-no-limit"), ("SELECT a FROM t LIMIT 5 OFFSET 5000", "deep-offset"), ("SELECT DISTINCT a FROM t GROUP BY a", "unnecessary-distinct"),
        ("SELECT count(*) FROM t", "unfiltered-count"), ("DELETE FROM t", "missing-where"), ("SELECT 1 FROM a " + "JOIN b USING (x) " * 6, "many-joins"),
    ],
)
def test_text_findings(sql, name):
    assert name in findings.text_findings(sql)
    assert findings.text_findings("SELECT a FROM t WHERE b = 1") == []


def test_searched():
    assert findings.searched("((status = 'a'::text) AND (created >= '2024-01-01'::date) AND (t.kind = 3))") == (["kind", "status"], "created")
    assert findings.searched("((a = 1) OR (b = 2))") == ([], None)


def test_advice(spark):
    tables = spark.createDataFrame([("t", False, False, 20_000_000), ("u", True, False, 5)], "table string, has_primary_key boolean, partitioned boolean, rows long")
    cols = spark.createDataFrame([("t", "at", "timestamp without time zone", None, False), ("t", "flag", "boolean", None, False), ("u", "id", "text", "nextval('x')", True)], "table string, column string, type string, default string, in_primary_key boolean")
    ix = spark.createDataFrame(
        [("t", "i1", ["a"], False, True, False, 1, 0, 40, None), ("t", "i2", ["a"], False, True, False, 1, 5, 40, None), ("t", "i3", ["a", "b"], False, True, False, 1, 5, 40, None), ("t", "i4", ["flag"], False, False, False, 1, 5, 40, None)],
        "table string, index string, columns array<string>, is_unique boolean, valid boolean, partitioned boolean, size long, scans long, stats_days int, supports string",
    )
    fks = spark.createDataFrame([("t", "f1", ["z"]), ("t", "f2", ["b", "a"])], "table string, name string, columns array<string>")
    found = {(r.advice, r.subject) for r in advice.structural(tables, cols, ix, fks).collect()}
    assert found == {("no-primary-key", "t"), ("foreign-key-not-indexed", "f1"), ("duplicate-index", "i2"), ("redundant-index", "i1"), ("redundant-index", "i2"), ("boolean-index", "i4"), ("timestamp-without-timezone", "at"), ("serial-not-identity", "id"), ("text-primary-key", "id")}
    stats = spark.createDataFrame([("t", 100000, 50, 50 * 100000, 1, 100000, 50000, None, 10, 90000)], "table string, rows long, seq_scans long, seq_rows long, index_scans long, live long, dead long, last_analyzed timestamp, hits long, reads long")
    assert {r.advice for r in advice.statistical(stats, ix).collect()} == {"sequential-scan-heavy", "dead-tuples", "never-analyzed", "low-cache-hit", "unused-index", "invalid-index"}
    assert [(r.advice, r.subject) for r in advice.partitioning(tables, cols).collect()] == [("partition-by-date", "at")]
    both = advice.structural(tables, cols, ix, fks).unionByName(advice.statistical(stats, ix))
    assert advice.without_repeats(both).filter("subject = 'i1'").count() == 1


def test_table_functions_over_null_and_empty_texts(spark):
    sqltext.register(spark)
    steps.register(spark)
    df = spark.createDataFrame([(1, None), (2, ""), (3, ";;"), (4, "select ';'; drop table t;")], "id int, s string")
    assert [tuple(r) for r in spark.sql("SELECT id, x.step, x.kind FROM {df}, LATERAL sql_steps(s) AS x ORDER BY id, step", df=df).collect()] == [(4, 1, "query"), (4, 2, "drop")]
    plans = spark.createDataFrame([(1, None), (2, ""), (3, '{"Plan": {"Node Type": "Limit", "Plans": [{"Node Type": "Sort", "Plan Rows": 3, "Total Cost": 5}]}}')], "id int, p string")
    rows = spark.sql("SELECT id, x.step_id, x.parent_id, x.node_type, x.estimated_rows FROM {p}, LATERAL plan_steps(p) AS x ORDER BY step_id", p=plans).collect()
    assert [tuple(r) for r in rows] == [(3, 1, None, "Limit", None), (3, 2, 1, "Sort", 3.0)]


def test_steps_without_a_relation_keep_their_rows(spark):
    rows = [("p", 1, None), ("p", 2, "t"), ("q", 1, None), ("q", 2, "u"), (None, 1, None)]
    found = steps.sized(spark.createDataFrame(rows, "plan_id string, step_id int, relation string"), spark.createDataFrame([("t", 5.0), (None, 7.0), ("p", 9.0)], "relation string, rows double"))
    assert found.columns == ["plan_id", "step_id", "relation", "table_rows"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(*r, 5.0 if r[2] == "t" else None) for r in rows], key=repr)
