from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tidemark.operators import history, migration, schema_diff
from tidemark.sources import catalog

from test_operators import BASE, columns  # noqa: I001


def sides(spark):
    a = columns(spark, {"author": [*BASE["author"], ("bio", "text", True)], "post": [("id", "integer", False)], "tag": [("id", "bigint", False), ("label", "varchar(60)", False)]})
    b = columns(spark, {"author": BASE["author"], "tag": [("id", "integer", False), ("label", "varchar(60)", True), ("old", "text", True)], "zzz": [("x", "bytea", True)]})
    return a, b


def test_statements_in_order(spark):
    a, b = sides(spark)
    order = spark.createDataFrame([("post", 1), ("zzz", 2)], "node string, depth int")
    script = migration.in_order(migration.statements(a, b, order)).collect()
    assert [r.sql for r in script] == [
        'CREATE TABLE "post" ("id" integer NOT NULL)', 'ALTER TABLE "author" ADD COLUMN "bio" text', 'ALTER TABLE "tag" ALTER COLUMN "id" TYPE bigint', 'ALTER TABLE "tag" ALTER COLUMN "label" SET NOT NULL', 'ALTER TABLE "tag" DROP COLUMN "old"', 'DROP TABLE "zzz"',
    ]
    assert [r.destructive for r in script] == [False] * 4 + [True] * 2 and script[0].depth == 1 and script[-1].depth == -2


def test_safe_mode_and_levels(spark):
    a, b = sides(spark)
    script = migration.statements(a, b)
    uses = spark.createDataFrame([("v", "tag")], "object string, depends_on string")
    assert {(r.sql.split()[0], r.why) for r in migration.held_back(script, uses).collect()} == {("ALTER", "destructive"), ("DROP", "destructive"), ("ALTER", "still used")}
    assert migration.safe(script, uses).count() == 2
    assert migration.level(script).first().level == "breaking" and migration.level(script.limit(0)).first().level == "patch"
    back, lossy = migration.rollback(a, b)
    assert lossy.count() == 2 and back.filter("kind = 'create-table'").count() == 1
    report = schema_diff.compare(a, b)
    assert migration.structural_level(report["tables"], report["columns"]).first().level == "breaking"
    same = schema_diff.compare(a, a)
    assert migration.structural_level(same["tables"], same["columns"]).first().level == "patch"


def test_fingerprints(spark):
    a, b = sides(spark)
    report = schema_diff.compare(a, b)
    lines = migration.difference_lines(report["tables"], report["columns"])
    got = migration.drift_fingerprint(lines).first()
    assert got.fingerprint == hashlib.sha1("\n".join(sorted(r.line for r in lines.collect())).encode()).hexdigest() and got.differences == 6
    script = migration.statements(a, b)
    assert migration.approval_fingerprint(script).first() == migration.approval_fingerprint(script.repartition(3)).first()


def test_risk_and_newest_alert(spark):
    scripts = spark.createDataFrame([(1, "DELETE FROM t"), (2, "ALTER TYPE m ADD VALUE IF NOT EXISTS 'x'")], "id int, sql string")
    rows = {r.id: r for r in migration.run_risk(scripts).collect()}
    assert rows[1].destroys == ["DELETE"] and rows[2].adds_enum and rows[2].grade.level == "patch"
    df = spark.createDataFrame([("k", 1, "in_sync", "a"), ("k", 2, "drifted", "b"), ("k", 3, "drifted", "b")], "key string, id int, status string, fp string")
    assert [(r.alert, r.id) for r in migration.newest_alerts(history.alerts(df, "key", ["id"], "status", "fp"), "key", "id").collect()] == [("drifted", 2)]


def test_more_of_the_catalog(spark):
    snap = spark.range(1).select(F.expr("array(named_struct('key', 'i', 'table', 't', 'definition', 'd'))").alias("indexes"), F.expr("cast(null as array<struct<key:string,table:string,definition:string>>)").alias("triggers"))
    kinds = {"index": "indexes", "trigger": "triggers"}
    assert catalog.objects_of(snap, kinds).count() == 1
    assert {(r.kind, r.recorded) for r in catalog.recorded(snap, kinds).collect()} == {("index", True), ("trigger", False)}
    labels = spark.createDataFrame([("m", "b", 2), ("m", "a", 1)], "type string, label string, position int")
    assert catalog.enum_labels(labels).first().json == '["a","b"]'
    edges = spark.createDataFrame([("c", "p2", 2), ("c", "p1", 1)], "child string, parent string, position int")
    assert catalog.inheritance(edges).first().inherits == ["p1", "p2"]
