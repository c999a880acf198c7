from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import sqltext as S
from tidemark.functions import text as X
from tidemark.functions import versions as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_similarity_and_rounding(spark):
    assert value(spark, X.string_similarity(F.lit("abc"), F.lit("abd"))) == pytest.approx(2 / 3)
    assert value(spark, X.string_similarity(F.lit(""), F.lit(""))) == 1
    assert value(spark, X.round_score(F.lit(56.25))) == 56.3
    assert value(spark, X.normalized(F.lit("  A\n b "))) == "a b"


def test_fnv_and_fingerprint(spark):
    assert value(spark, X.fnv1a(F.lit("hello"))) == "4f9f2cab"
    assert value(spark, X.normalized_query(F.lit("SELECT  1 -- x\n FROM t WHERE a='it''s' /* c */"))) == "select ? from t where a=?"


def test_types(spark):
    assert value(spark, X.base_type(F.lit("varchar(120)[]"))) == "varchar[]"
    for before, after, narrower in (("varchar(200)", "varchar(100)", True), ("varchar(100)", "varchar(200)", False), ("varchar", "varchar(5)", True), ("numeric(10,2)", "numeric(10,4)", True), ("text", "integer", False)):
        assert value(spark, X.narrows(F.lit(before), F.lit(after))) is narrower


def test_formats(spark):
    assert [value(spark, X.format_bytes(F.lit(n))) for n in (0, 1023, 1024, 5 * 1024**3)] == ["0 B", "1023 B", "1.0 KB", "5.0 GB"]
    assert value(spark, X.spreadsheet_safe(F.lit("=1+1"))) == "'=1+1"


def test_versions(spark):
    texts = ["1.0.0-alpha", "v1.0.0", "1.0.0-rc.2", "1.0.0-rc.10", "0.9", "1.0.0.1", "1.0.0-rc.beta"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r.v for r in df.orderBy(V.sort_key(F.col("v"))).collect()] == ["0.9", "1.0.0-alpha", "1.0.0-rc.2", "1.0.0-rc.10", "1.0.0-rc.beta", "v1.0.0", "1.0.0.1"]
    assert value(spark, V.key_text(F.lit("v1.2"))) == "1.2.0" == value(spark, V.key_text(F.lit("1.2.0.0")))
    assert value(spark, V.bumped(F.lit("1.2.3"), F.lit("additive"))) == "1.3.0"
    assert value(spark, V.step_level(F.lit("1.2.3"), F.lit("2.0"))) == "breaking"


def test_mask_and_split():
    sql = "INSERT INTO t VALUES ('a;b'); -- c; d\nDO $x$ BEGIN EXECUTE 'z'; END $x$; /* /* ; */ */ SELECT E'\\';' , \"a;b\""
    assert len(S.split(sql)) == 3
    assert len(S.masked(sql)) == len(sql)
    assert S.split(";;  ; -- only a comment") == []


@pytest.mark.parametrize(
    "sql,level,label",
    [
        ("ALTER TABLE t DROP COLUMN a", "breaking", "DROP COLUMN"),
        ("ALTER TABLE t DROP legacy", "breaking", "DROP COLUMN"),
        ("drop   table if exists x", "breaking", "DROP TABLE"),
        ("ALTER TABLE t ADD COLUMN a int", "additive", None),
        ("CREATE TABLE t (a int)", "additive", None),
        ("SELECT 'DROP TABLE x'", "patch", None),
        ("ALTER TABLE t ALTER COLUMN a TYPE bigint", "breaking", "ALTER COLUMN … TYPE"),
        ("DO $$ BEGIN EXECUTE 'drop table t'; END $$", "breaking", "EXECUTE in a DO block"),
        ("DO $$ BEGIN DROP TABLE t; END $$", "breaking", "DROP TABLE"),
        ("ALTER TYPE e ADD VALUE 'x'", "patch", None),
        ("GRANT SELECT ON t TO app", "patch", None),
        ("ALTER TABLE t ADD note text", "additive", None),
        ("ALTER TABLE c NO INHERIT p", "breaking", "NO INHERIT"),
        ("ALTER TABLE t ADD CONSTRAINT c CHECK (a > 0) NO INHERIT", "breaking", "ADD CONSTRAINT"),
        ("DROP ROUTINE f", "breaking", "DROP ROUTINE"),
        ("DROP ROLE r", "breaking", "DROP"),
        ("SET SCHEMA 'x'", "patch", None),
        ("ALTER TABLE t SET SCHEMA x", "breaking", "SET SCHEMA"),
        ("DROP TRIGGER a ON t; CREATE TRIGGER a BEFORE INSERT ON public.t EXECUTE FUNCTION f()", "additive", None),
        ('DROP TRIGGER "A" ON t; CREATE TRIGGER a BEFORE INSERT ON t EXECUTE FUNCTION f()', "breaking", "DROP TRIGGER"),
        ("DROP INDEX i; CREATE INDEX i ON t (a)", "additive", None),
        ("DROP INDEX i, j; CREATE INDEX i ON t (a)", "breaking", "DROP INDEX"),
        ("ALTER TABLE t ALTER a ADD GENERATED ALWAYS AS IDENTITY", "breaking", "ALTER COLUMN … GENERATED/IDENTITY"),
        ("DROP INDEX i; DROP TABLE t", "breaking", "DROP TABLE"),
    ],
)
def test_grade(sql, level, label):
    assert S.grade(sql)[:2] == (level, label)


def test_warnings():
    assert S.destroys("TRUNCATE t; DELETE FROM u WHERE 1=1; DROP TYPE v CASCADE; DROP VIEW w CASCADE") == ["TRUNCATE", "DELETE", "DROP … CASCADE"]
    assert S.destroys("DROP VIEW w CASCADE") == []
    assert S.might_fail("ALTER TABLE t ADD COLUMN a int NOT NULL; ALTER TABLE t ADD COLUMN b int NOT NULL DEFAULT 1") == ["NOT NULL column with no default"]
    assert S.might_fail("ALTER TABLE t ADD COLUMN b int NOT NULL DEFAULT 1") == []
    assert S.transaction_control("BEGIN; SELECT 1; COMMIT") == ["COMMIT"]
    assert S.transaction_control("SAVEPOINT a; SELECT CASE WHEN a THEN 1 END; INSERT INTO t VALUES ('ROLLBACK')") == []
    assert S.transaction_control("SELECT 1; END AND NO CHAIN; PREPARE TRANSACTION 'x'") == ["END", "PREPARE TRANSACTION"]
    assert S.transaction_control("SET standard_conforming_strings = off") == ["standard_conforming_strings"]
    assert S.change_type("-- Change-type: additive\nDROP TABLE t")[:3] == ("additive", "additive", True)
    assert S.change_type("-- Change-type: additive\nDROP INDEX i") == ("additive", "additive", False, None)
    assert S.enum_additions("ALTER TYPE mood ADD VALUE IF NOT EXISTS 'ok'; SELECT 1")[0][0] == "mood"


def test_headers():
    sql = S.stamped("-- Note: hi\nSELECT 1", "Change-type", "patch")
    assert S.header(sql, "Change-type") == "patch" and S.header(sql, "Note") == "hi"
    assert S.header("SELECT 1\n-- Note: late", "Note") is None
    assert S.header(S.stamped(sql, "Note", "new"), "Note") == "new"


def test_definitions_and_names():
    assert S.normalized_definition("SELECT  'a  b'  FROM app.t", "app") == "SELECT 'a  b' FROM t"
    assert S.quoted('a"b') == '"a""b"'
    assert len(S.index_name("t" * 80, ["c"], set()).encode()) == 63
    assert S.index_name("t", ["c"], {"t_c_idx"}) == "t_c_idx2"


def test_udfs(spark):
    df = spark.createDataFrame([("DROP TABLE t",), (None,)], "sql string")
    u = S.udfs()
    rows = df.select(u["sql_grade"]("sql").alias("g"), u["sql_destroys"]("sql").alias("d")).collect()
    assert rows[0].g.level == "breaking" and rows[0].d == ["DROP TABLE"] and rows[1].d is None
    assert "sql_split" in S.register(spark)
    assert spark.sql("SELECT size(sql_split('a; b')) AS n").first().n == 2
