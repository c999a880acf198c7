from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import migration, object_diff, schema_diff
from tidemark.sources import catalog


def objects(spark, rows):
    """rows: kind, table, name, definition, and optionally signature, is_unique, grants"""
    return spark.createDataFrame([(*r, *[None, None, None][len(r) - 4 :]) for r in rows], object_diff.OBJECTS)


def test_constraints_match_by_name_then_by_meaning(spark):
    left = objects(spark, [("UNIQUE", "t", "u_new", "UNIQUE (a)", "a"), ("FOREIGN KEY", "t", "f", "REFERENCES x (id)", "b->x->id"), ("CHECK", "t", "c2", "CHECK (a > 0)"), ("CHECK", "t", "c9", "CHECK (b > 0)"), ("PRIMARY KEY", "t", "p", "PRIMARY KEY (id)", "id")])
    right = objects(spark, [("UNIQUE", "t", "u_old", "UNIQUE (a)", "a"), ("FOREIGN KEY", "t", "f", "REFERENCES y (id)", "b->y->id"), ("CHECK", "t", "c1", "CHECK  (a > 0)"), ("UNIQUE", "t", "gone", "UNIQUE (z)", "z"), ("PRIMARY KEY", "t", "p", "PRIMARY KEY  (id)", "id")])
    got = {(r.name, r.right_name): (r.status, r.severity) for r in object_diff.matched_constraints(left, right).collect()}
    assert got == {("u_new", "u_old"): ("renamed", "safe"), ("f", "f"): ("changed", "breaking"), ("c2", "c1"): ("renamed", "safe"), ("c9", None): ("onlyA", "breaking"), (None, "gone"): ("onlyB", "breaking"), ("p", "p"): ("matched", "safe")}


LEFT = [
    ("INDEX", "t", "i1", "CREATE UNIQUE INDEX i1 ON t (a)", None, True), ("INDEX", "t", "i2", "CREATE INDEX i2 ON t (b)", None, False), ("VIEW", None, "v", "SELECT 2"), ("SEQUENCE", None, "s", "INCREMENT BY 2"), ("EXTENSION", None, "e", "1.10"),
    ("TRIGGER", "t", "tr", "CREATE TRIGGER tr BEFORE INSERT ON t EXECUTE FUNCTION f()"), ("POLICY", "t", "po", "CREATE POLICY po ON t"), ("COLLATION", None, "co", "(locale = 'de')"), ("ROUTINE", None, "f", "CREATE OR REPLACE FUNCTION f() ..."),
    ("PRIVILEGES", None, "t", None, None, None, ["app:SELECT"]), ("ROW SECURITY", "t", "t", "ENABLE ROW LEVEL SECURITY"), ("UNIQUE", "t", "u", "UNIQUE (a)", "a"), ("TYPE", None, "mood", "ENUM ('a', 'b')"),
]
RIGHT = [
    ("INDEX", "t", "i2", "CREATE INDEX i2 ON t (c)", None, False), ("INDEX", "t", "i3", "CREATE INDEX i3 ON t (d)", None, False), ("VIEW", None, "v", "SELECT 1"), ("SEQUENCE", None, "s", "INCREMENT BY 1"), ("EXTENSION", None, "e", "1.9"),
    ("COLLATION", None, "co", "(locale = 'fr')"), ("MATERIALIZED VIEW", None, "mv", "SELECT 3"), ("PRIVILEGES", None, "t", None, None, None, ["app:SELECT", "app:DELETE"]), ("DOMAIN", None, "d", "int"),
]


def test_objects_and_their_severities(spark):
    got = {(r.kind, r.name): (r.status, r.severity, r.manual) for r in object_diff.compared(objects(spark, LEFT), objects(spark, RIGHT)).collect()}
    assert got == {
        ("INDEX", "i1"): ("onlyA", "breaking", False), ("INDEX", "i2"): ("changed", "safe", False), ("INDEX", "i3"): ("onlyB", "safe", False), ("VIEW", "v"): ("changed", "breaking", False), ("SEQUENCE", "s"): ("changed", "info", False),
        ("EXTENSION", "e"): ("changed", "info", False), ("TRIGGER", "tr"): ("onlyA", "info", False), ("POLICY", "po"): ("onlyA", "breaking", False), ("COLLATION", "co"): ("changed", "breaking", True), ("ROUTINE", "f"): ("onlyA", "info", False),
        ("PRIVILEGES", "t"): ("changed", "breaking", False), ("ROW SECURITY", "t"): ("onlyA", "info", False), ("UNIQUE", "u"): ("onlyA", "breaking", False), ("TYPE", "mood"): ("onlyA", "info", False),
        ("MATERIALIZED VIEW", "mv"): ("onlyB", "breaking", False), ("DOMAIN", "d"): ("onlyB", "breaking", False),
    }


def test_object_statements_in_order(spark):
    script = object_diff.object_statements(object_diff.compared(objects(spark, LEFT), objects(spark, RIGHT)))
    rows = [(r.kind, r.sql) for r in migration.in_order(script).collect()]
    assert rows == [
        ("alter-extension", 'ALTER EXTENSION "e" UPDATE TO 1.10'), ("manual", "-- MANUAL: change collation \"co\" to (locale = 'de')"), ("create-type", "CREATE TYPE \"mood\" AS ENUM ('a', 'b')"), ("drop-materialized-view", 'DROP MATERIALIZED VIEW "mv"'), ("drop-view", 'DROP VIEW "v"'),
        ("alter-sequence", 'ALTER SEQUENCE "s" INCREMENT BY 2'), ("create-routine", "CREATE OR REPLACE FUNCTION f() ..."), ("drop-index", 'DROP INDEX "i2"'), ("drop-index", 'DROP INDEX "i3"'), ("add-constraint", 'ALTER TABLE "t" ADD CONSTRAINT "u" UNIQUE (a)'),
        ("create-index", "CREATE UNIQUE INDEX i1 ON t (a)"), ("create-index", "CREATE INDEX i2 ON t (b)"), ("create-trigger", "CREATE TRIGGER tr BEFORE INSERT ON t EXECUTE FUNCTION f()"), ("create-policy", "CREATE POLICY po ON t"),
        ("alter-row-security", 'ALTER TABLE "t" ENABLE ROW LEVEL SECURITY'), ("create-view", 'CREATE VIEW "v" AS SELECT 2'), ("revoke", 'REVOKE DELETE ON "t" FROM "app"'), ("drop-domain", 'DROP DOMAIN "d"'),
    ]


def test_versions_go_forward(spark):
    df = spark.createDataFrame([("1.9", "1.10"), ("1.10", "1.9"), ("1.0", "1.0.0"), ("1.a", "1.b"), ("2", "2.1")], "b string, a string")
    assert [r.f for r in df.select(object_diff.forward(F.col("b"), F.col("a")).alias("f")).collect()] == [True, False, False, False, True]


def columns(spark, rows):
    return spark.createDataFrame([(t, c, i, kind, True, None, None, None, False, [], []) for i, (t, c, kind) in enumerate(rows, 1)], catalog.COLUMNS)


def test_renamed_columns(spark):
    left = columns(spark, [("t", "id", "int"), ("t", "email_address", "varchar(80)"), ("t", "note", "text")])
    right = columns(spark, [("t", "id", "int"), ("t", "email_adress", "varchar(60)"), ("t", "amount", "numeric")])
    found = {r.column: r for r in schema_diff.compare(left, right)["columns"].collect()}
    assert found["email_address"].status == "renamed" and found["email_address"].renamed_from == "email_adress"
    assert [c.kind for c in found["email_address"].changes] == ["size"]
    assert found["note"].status == "onlyA" and found["amount"].status == "onlyB"
    sql = [r.sql for r in migration.in_order(migration.statements(left, right)).collect()]
    assert sql[0] == 'ALTER TABLE "t" RENAME COLUMN "email_adress" TO "email_address"' and 'DROP COLUMN "amount"' in sql[-1] and not any("DROP COLUMN \"email" in s for s in sql)


def test_computed_columns_and_sequence_options(spark):
    one = columns(spark, [("t", "a", "int"), ("t", "b", "int")])
    with_ = lambda c, s: one.withColumns({"computed": F.lit(c), "sequenceOptions": F.lit(s)})
    kinds = [c.kind for r in schema_diff.column_changes(with_("a + 1", "INCREMENT BY 1"), with_("a + 2", "INCREMENT BY 5")).collect() for c in r.changes]
    assert sorted(kinds) == ["computed"] * 2 + ["sequenceOptions"] * 2
    assert not [c for r in schema_diff.column_changes(with_("a", None).withColumn("computed", F.lit(None).cast("string")), with_("b", "x")).collect() for c in r.changes]


def test_grades_and_safe_mode_of_object_scripts(spark):
    """Dropping a view, a type or a unique index breaks, and safe mode keeps what something that stays still uses."""
    left = objects(spark, [("INDEX", "t", "i", "CREATE INDEX i ON t (a)", None, False)])
    right = objects(spark, [("VIEW", None, "v", "SELECT 1"), ("VIEW", None, "w", "SELECT * FROM v"), ("TYPE", None, "mood", "ENUM ('a')"), ("INDEX", "t", "i", "CREATE INDEX i ON t (b)", None, False)])
    script = object_diff.object_statements(object_diff.compared(left, right))
    level = lambda s: migration.level(s).first().level
    assert level(script) == "breaking" and level(script.filter("kind = 'drop-type'")) == "breaking"
    assert level(script.filter("object = 'i'")) == "additive" and level(script.filter("kind = 'drop-index'")) == "patch" and level(script.limit(0)) == "patch"
    unique = object_diff.object_statements(object_diff.compared(left.limit(0), objects(spark, [("INDEX", "t", "u", "CREATE UNIQUE INDEX u ON t (a)", None, True)])))
    assert level(unique) == "breaking"
    rows = object_diff.object_statements(object_diff.compared(left.limit(0), objects(spark, [("MATERIALIZED VIEW", None, "m", "SELECT 1")])))
    assert level(rows) == "patch" and migration.level(rows, allow_data_loss=True).first().level == "breaking" and not migration.script_lossless(rows).first().lossless
    note = object_diff.object_statements(object_diff.compared(objects(spark, [("COLLATION", None, "c", "(locale = 'de')")]), objects(spark, [("COLLATION", None, "c", "(locale = 'fr')")])))
    assert [r.kind for r in note.collect()] == ["manual"] and level(note) == "patch"
    held = lambda pairs: {(r.object, r.why) for r in migration.held_back(script, spark.createDataFrame(pairs, "object string, depends_on string")).collect()}
    assert held([("w", "v")]) == set()  # w goes as well
    assert held([("w", "v"), ("x", "w")]) == {("v", "still used"), ("w", "still used")}  # x stays, so w stays, so v stays
    assert held([("a", "mood")]) == {("mood", "still used")}
    assert {r.object for r in migration.safe(script, spark.createDataFrame([("a", "mood")], "object string, depends_on string")).collect()} == {"v", "w", "i"}


def test_one_script_in_dependency_order(spark):
    left, right = columns(spark, [("t", "id", "int"), ("t", "note", "text")]), columns(spark, [("t", "id", "int")])
    views = [("VIEW", None, "a_top", "SELECT * FROM z_base"), ("VIEW", None, "z_base", "SELECT 1")]
    uses = spark.createDataFrame([("a_top", "z_base")], "object string, depends_on string")
    made = [r.object for r in migration.in_order(object_diff.script(left, right, objects(spark, views), objects(spark, []), uses)).collect()]
    assert made == ["note", "z_base", "a_top"]
    gone = [r.object for r in migration.in_order(object_diff.script(right, left, objects(spark, []), objects(spark, views), uses)).collect()]
    assert gone == ["a_top", "z_base", "note"]


def test_enum_labels_in_order(spark):
    from tidemark.operators import enums

    pairs = [("ENUM ('a', 'b')", "ENUM ('x', 'a', 'y', 'z', 'b', 'it''s')"), ("ENUM ('a', 'b')", "ENUM ('b', 'a', 'c')"), ("ENUM ('a', 'b')", "ENUM ('a')"), ("ENUM ('a')", "ENUM ('a')"), ("ENUM ()", "ENUM ('n')"), ("int", "ENUM ('a')"), ("ENUM ('d', 'a', 'c', 'b')", "ENUM ('a', 'b', 'c', 'd')")]
    df = spark.createDataFrame(pairs, "b string, a string")
    b, a = enums.labels(F.col("b")), enums.labels(F.col("a"))
    got = [(r.v, r.n) for r in df.select(enums.verdict(b, a).alias("v"), enums.kept_in_order(b, a).alias("n")).collect()]
    assert [v for v, _ in got][:5] == ["grown", "reordered", "removed", "same", "grown"]
    assert got[0][1] == 2 and got[1][1] == 1 and got[6] == ("reordered", 2)
    sql = df.limit(1).select(enums.statements(F.lit('"m"'), b, a).alias("s")).first().s
    assert sql == ["""ALTER TYPE "m" ADD VALUE 'x' BEFORE 'a'""", """ALTER TYPE "m" ADD VALUE 'y' BEFORE 'b'""", """ALTER TYPE "m" ADD VALUE 'z' BEFORE 'b'""", """ALTER TYPE "m" ADD VALUE 'it''s'"""]
    sides = [objects(spark, [("TYPE", None, "m", t), ("TYPE", None, "k", u)]) for t, u in (("ENUM ('a', 'b')", "ENUM ('a')"), ("ENUM ('b')", "ENUM ('a', 'b')"))]
    script = object_diff.object_statements(object_diff.compared(*sides))
    assert [(r.kind, r.sql) for r in migration.in_order(script).collect()] == [("manual", "-- MANUAL: change type \"k\" to ENUM ('a')"), ("alter-type", "ALTER TYPE \"m\" ADD VALUE 'a' BEFORE 'b'")]
