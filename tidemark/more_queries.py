"""Queries of the operators on catalogs, objects, ledgers, sinks, streams and SQL texts, each beside its DuckDB SQL.

Catalog extracts are derived from the provided tables: regions stand for schemas or tables, nations for columns,
customers and suppliers for objects that depend on them."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import sqltext
from .functions import versions as V
from .operators import activity, graph, history, ledger, migration, object_diff, rollups, rowdiff, schema_diff, series, sets
from .plans import advice, findings, steps
from .sources import catalog, export
from .streaming import changes

MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def keep(f):
        MORE[f.__name__] = (f, sql)
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _sql_values(rows: list[tuple], names: str) -> str:
    """The rows as SQL, for results that are stated rather than computed."""
    one = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


# catalogs


@query("SELECT DISTINCT lower(r_name) AS schema FROM region WHERE lower(r_name) <> 'asia'")
def list_schemas(spark, d):
    system = _values(spark, [("pg_catalog",), ("information_schema",), ("pg_toast",)], "schema string")
    return catalog.list_schemas(_t(spark, d, "region").select(F.lower("r_name").alias("schema")).unionByName(system), ["asia"])


@query("""SELECT 'nation' AS "table", column_name AS "column", CAST(row_number() OVER () AS INT) AS ordinal FROM (DESCRIBE nation) UNION ALL SELECT 'region', column_name, CAST(row_number() OVER () AS INT) FROM (DESCRIBE region)""")
def columns_of_files(spark, d):
    return catalog.columns_of(spark, {t: _t(spark, d, t).schema for t in ("nation", "region")}).select("table", "column", "ordinal")


def _attributes(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("table"), F.col("n_nationkey").alias("number"), F.col("n_name").alias("column"))


def _keys(spark, d, name: str):
    """One object a region, over its nations from the last to the first, and a number that no column has."""
    by = _attributes(spark, d).groupBy("table").agg(F.reverse(F.array_sort(F.collect_list("number"))).alias("k"))
    return by.select(F.concat(F.lit(f"{name}_"), "table").alias(name), "table", F.concat("k", F.array(F.lit(999))).alias("key"))


@query("""SELECT 'constraint_' || r_name AS "constraint", r_name AS "table", 'u' AS kind, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS columns FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def constraint_columns(spark, d):
    found = catalog.constraints(_keys(spark, d, "constraint").withColumn("kind", F.lit("u")), _attributes(spark, d))
    return found.withColumn("columns", F.array_join("columns", ","))


@query("""SELECT 'index_' || r_name AS "index", r_name AS "table", r_regionkey % 2 = 0 AS is_unique, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS columns FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY ALL""")
def index_columns(spark, d):
    unique = _t(spark, d, "region").select(F.col("r_name").alias("table"), (F.col("r_regionkey") % 2 == 0).alias("is_unique"))
    own = _values(spark, [("index_ASIA",)], "constraint string")
    found = catalog.indexes(_keys(spark, d, "index").join(unique, "table"), _attributes(spark, d), own)
    return found.withColumn("columns", F.array_join("columns", ","))


@query("SELECT c_mktsegment AS view, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS depends_on FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def view_sources(spark, d):
    reads = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("view"), F.col("n_name").alias("source"))
    return catalog.view_sources(reads).withColumn("depends_on", F.array_join("depends_on", ","))


@query("""SELECT 'object' AS kind, n_name AS name, g.grantee, g.privilege FROM nation LEFT JOIN (VALUES ('app', 'SELECT'), ('job', 'INSERT')) g(grantee, privilege) ON n_nationkey % 3 <> 0
    UNION ALL SELECT 'schema', r_name, 'app', 'USAGE' FROM region UNION ALL SELECT 'default', 'x', 'job', 'SELECT'""")
def privilege_rows(spark, d):
    grant = lambda *g: F.array(*[F.struct(F.lit(a).alias("grantee"), F.lit(b).alias("privilege")) for a, b in g])
    objects = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 != 0, grant(("app", "SELECT"), ("job", "INSERT"))).alias("acl"))
    return catalog.privileges(objects, _t(spark, d, "region").select(F.col("r_name").alias("name"), grant(("app", "USAGE")).alias("acl")), spark.range(1).select(F.lit("x").alias("name"), grant(("job", "SELECT")).alias("acl")))


@query("""SELECT n_name AS "table", n_nationkey AS seq_scan, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10 END AS heap_read, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS has_stats FROM nation""")
def table_statistics(spark, d):
    n, s = _t(spark, d, "nation"), _t(spark, d, "supplier")
    tables = n.select(F.col("n_name").alias("table"), F.col("n_nationkey").alias("seq_scan"))
    io = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("table"), (F.col("n_nationkey") * 10).alias("heap_read"))
    return catalog.with_statistics(tables, io, s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("table")))


@query("""SELECT n_name AS child, string_agg(r_name, ',' ORDER BY r_regionkey) AS inherits FROM nation JOIN region ON r_regionkey <= n_regionkey GROUP BY 1""")
def inherited_from(spark, d):
    edges = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("r_regionkey") <= F.col("n_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"), F.col("r_regionkey").alias("position"))
    return catalog.inheritance(edges).withColumn("inherits", F.array_join("inherits", ","))


@query("""SELECT r_name AS type, string_agg(n_name, ', ' ORDER BY n_nationkey) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def enum_labels(spark, d):
    return catalog.enum_labels(_attributes(spark, d).select(F.col("table").alias("type"), F.col("column").alias("label"), F.col("number").alias("position"))).select("type", "text")


_VERSION_TABLES = [("schema_version",), ("Migrations",), ("app_versions",), ("orders",), ("flyway_schema_history",)]


@query(_sql_values([("flyway_schema_history",), ("Migrations",), ("schema_version",), ("app_versions",)], '"table"'))
def version_tables(spark, d):
    return catalog.version_tables(_values(spark, _VERSION_TABLES, "table string"), ["flyway_schema_history", "migrations"])


@query("""SELECT DISTINCT version, applied_at FROM (SELECT o_orderpriority AS version, strftime(o_orderdate, '%Y-%m-%d') AS applied_at FROM orders ORDER BY applied_at DESC, version DESC LIMIT 100)""")
def version_rows(spark, d):
    # the limit is the feature: the newest rows of a ledger
    return catalog.version_rows(_t(spark, d, "orders").select(F.col("o_orderpriority").alias("version"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("applied_at")), 100)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 'unstamped' WHEN n_nationkey % 6 < 5 THEN 'older' ELSE 'current' END AS gap, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'neither side recorded it' WHEN n_nationkey % 2 = 0 THEN 'the left side did not record it' WHEN n_nationkey % 3 = 0 THEN 'the right side did not record it' END AS why FROM nation")
def snapshot_format_gaps(spark, d):
    k = F.col("n_nationkey")
    return _t(spark, d, "nation").select("n_nationkey", catalog.format_gap(F.when(k % 6 != 0, k % 6)).alias("gap"), catalog.comparable(F.when(k % 2 != 0, 1), F.when(k % 3 != 0, 1)).alias("why"))


@query("SELECT c_mktsegment AS name, CAST(count(*) AS INT) AS tables, 0 AS views FROM customer GROUP BY 1")
def snapshot_counts(spark, d):
    snapshot = _t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.collect_list("c_custkey").alias("tables")).withColumn("views", F.lit(None).cast("array<int>"))
    return rollups.snapshot_counts(snapshot, ["tables", "views"])


def _sizes(spark, d):
    k = F.col("n_nationkey")
    return _t(spark, d, "nation").select(F.col("n_name").alias("table"), (k * 1000).alias("total_bytes"), (k * 100).alias("index_bytes"), (k * 7).alias("rows"), F.when(k % 5 != 0, F.lit("2024-01-01")).alias("last_analyzed"))


@query("SELECT sum(n_nationkey * 1000)::BIGINT AS total_bytes, sum(n_nationkey * 100)::BIGINT AS index_bytes, CASE WHEN bool_or(n_nationkey % 5 = 0 AND n_nationkey > 0) THEN NULL ELSE sum(n_nationkey * 7)::BIGINT END AS estimated_rows FROM nation")
def schema_sizes(spark, d):
    return rollups.schema_sizes(_sizes(spark, d))


@query("""SELECT n_name AS "table", n_nationkey * 1000 AS total_bytes, CASE WHEN n_nationkey % 5 = 0 AND n_nationkey > 0 THEN NULL ELSE n_nationkey * 7 END AS rows FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'CHINA', 'PERU', 'NATION_5', 'NATION_6', 'NATION_10')""")
def table_sizes(spark, d):
    return rollups.table_sizes(_sizes(spark, d), ["FRANCE", "GERMANY", "CHINA", "PERU", "NATION_5", "NATION_6", "NATION_10"])


# objects and columns of two sides


def _constraint_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    """Suppliers as unique constraints: every third one is renamed, every seventh is missing, every eleventh covers something else under its name."""
    s, k = _t(spark, d, "supplier"), F.col("s_suppkey")
    side = lambda name, covers: s.select(F.lit("UNIQUE").alias("kind"), F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("table"), name.alias("name"), F.concat(F.lit("UNIQUE ("), covers, F.lit(")")).alias("definition"), covers.alias("signature"), F.lit(None).cast("boolean").alias("is_unique"), F.lit(None).cast("array<string>").alias("grants"))
    left = side(F.col("s_name"), F.concat(F.lit("c"), k.cast("string")))
    right = side(F.when(k % 3 == 0, F.concat("s_name", F.lit("_old"))).otherwise(F.col("s_name")), F.concat(F.when(k % 11 == 0, "d").otherwise("c"), k.cast("string")))
    return left, right.filter(F.regexp_extract("signature", r"\d+", 0).cast("int") % 7 != 0)


@query("""SELECT s_name AS name, s_name || CASE WHEN s_suppkey % 3 = 0 THEN '_old' ELSE '' END AS right_name, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' WHEN s_suppkey % 11 = 0 THEN 'changed' ELSE 'matched' END AS status, CASE WHEN s_suppkey % 3 <> 0 AND s_suppkey % 11 = 0 THEN 'breaking' ELSE 'safe' END AS severity FROM supplier WHERE s_suppkey % 7 <> 0 AND NOT (s_suppkey % 33 = 0)
    UNION ALL SELECT s_name, NULL, 'onlyA', 'breaking' FROM supplier WHERE s_suppkey % 7 = 0 OR s_suppkey % 33 = 0
    UNION ALL SELECT NULL, s_name || '_old', 'onlyB', 'breaking' FROM supplier WHERE s_suppkey % 33 = 0 AND s_suppkey % 7 <> 0""")
def constraint_changes(spark, d):
    return object_diff.matched_constraints(*_constraint_sides(spark, d)).select("name", "right_name", "status", "severity")


def _index_sides(spark, d) -> tuple[DataFrame, DataFrame]:
    p, k = _t(spark, d, "part"), F.col("p_partkey")
    side = lambda column: p.select(F.lit("INDEX").alias("kind"), F.col("p_brand").alias("table"), F.concat(F.lit("i"), k.cast("string")).alias("name"), F.concat(F.lit("CREATE INDEX i"), k.cast("string"), F.lit(" ON t ("), column, F.lit(")")).alias("definition"), F.lit(None).cast("string").alias("signature"), (k % 4 == 0).alias("is_unique"), F.lit(None).cast("array<string>").alias("grants"))
    return side(F.lit("a")).filter("cast(substring(name, 2) as int) % 5 <> 0"), side(F.when(k % 3 == 0, "b").otherwise("a")).filter("cast(substring(name, 2) as int) % 7 <> 0")


_INDEXES = """x AS (SELECT p_partkey AS k, 'i' || p_partkey AS name, p_partkey % 4 = 0 AS u, p_partkey % 5 = 0 AS no_l, p_partkey % 7 = 0 AS no_r, p_partkey % 3 = 0 AS other FROM part),
    y AS (SELECT *, CASE WHEN no_r THEN 'onlyA' WHEN no_l THEN 'onlyB' WHEN other THEN 'changed' ELSE 'matched' END AS status FROM x WHERE NOT (no_l AND no_r))"""


@query(f"WITH {_INDEXES} SELECT name, status, CASE WHEN status = 'matched' THEN 'safe' WHEN u THEN 'breaking' WHEN status = 'onlyA' THEN 'info' ELSE 'safe' END AS severity FROM y")
def object_changes(spark, d):
    return object_diff.compared(*_index_sides(spark, d)).select("name", "status", "severity")


@query(f"""WITH {_INDEXES} SELECT 'create-index' AS kind, name AS object, 'CREATE INDEX ' || name || ' ON t (a)' AS sql FROM y WHERE status IN ('onlyA', 'changed')
    UNION ALL SELECT 'drop-index', name, 'DROP INDEX "' || name || '"' FROM y WHERE status IN ('onlyB', 'changed')""")
def object_script(spark, d):
    return object_diff.object_statements(object_diff.compared(*_index_sides(spark, d))).select("kind", "object", "sql")


_COLUMNS_LEFT = [("t", "email_address", "varchar(80)"), ("t", "id", "int"), ("t", "note", "text"), ("u", "created_at", "timestamp")]
_COLUMNS_RIGHT = [("t", "email_adress", "varchar(60)"), ("t", "id", "int"), ("t", "amount", "numeric"), ("u", "created_at", "timestamp")]


def _small(spark, rows):
    return _values(spark, [(t, c, i, kind, True, None, None, None, False, [], []) for i, (t, c, kind) in enumerate(rows, 1)], catalog.COLUMNS)


@query(_sql_values([("t", "email_address", "renamed", "email_adress", "size"), ("t", "note", "onlyA", None, None), ("t", "amount", "onlyB", None, None)], '"table", "column", status, renamed_from, kind'))
def column_renames(spark, d):
    found = schema_diff.compare(_small(spark, _COLUMNS_LEFT), _small(spark, _COLUMNS_RIGHT))["columns"]
    return found.select("table", "column", "status", "renamed_from", F.explode_outer("changes").alias("c")).select("table", "column", "status", "renamed_from", "c.kind")


@query(_sql_values([("renames", 'ALTER TABLE "t" RENAME COLUMN "email_adress" TO "email_address"'), ("column-adds", 'ALTER TABLE "t" ADD COLUMN "note" text'), ("column-alters", 'ALTER TABLE "t" ALTER COLUMN "email_address" TYPE varchar(80)'), ("column-drops", 'ALTER TABLE "t" DROP COLUMN "amount"')], "phase, sql"))
def rename_script(spark, d):
    phases = F.array(*map(F.lit, migration.PHASES))
    return migration.statements(_small(spark, _COLUMNS_LEFT), _small(spark, _COLUMNS_RIGHT)).select(F.get(phases, F.col("phase")).alias("phase"), "sql")


@query("SELECT FALSE AS lossless, 1::BIGINT AS warnings")
def rollback_lossless(spark, d):
    return migration.lossless(_small(spark, _COLUMNS_LEFT), _small(spark, _COLUMNS_RIGHT))


@query("SELECT s_suppkey, 'a,b->' || CASE WHEN s_nationkey % 2 = 0 THEN chr(0) || 'own' || chr(0) ELSE 'other' END || '->' || s_name || '->id' AS signature FROM supplier")
def foreign_signatures(spark, d):
    schema = F.when(F.col("s_nationkey") % 2 == 0, "app").otherwise("other")
    signature = schema_diff.foreign_signature(schema, F.lit("app"), F.col("s_name"), F.array(F.lit("a"), F.lit("b")), F.array(F.lit("id")))
    return _t(spark, d, "supplier").select("s_suppkey", signature.alias("signature"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'safe' WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 0 THEN 'breaking' ELSE 'safe' END AS severity FROM part")
def added_column_severities(spark, d):
    k = F.col("p_partkey")
    return _t(spark, d, "part").select("p_partkey", object_diff.added_column_severity(k % 2 != 0, F.when(k % 3 == 0, "0"), F.when(k % 5 == 0, "always")).alias("severity"))


# rows of two sides


@query("SELECT n_nationkey, n_name FROM nation WHERE CAST(n_nationkey AS VARCHAR) IN ('3', '17', '24') ")
def keys_as_text(spark, d):
    return rowdiff.matching_rows(_t(spark, d, "nation"), ["n_nationkey"], [["3"], ["17"], ["24"], ["x"]]).select("n_nationkey", "n_name")


@query("SELECT 'nation' AS table_name, 'source' AS side, count(*) AS row_count FROM nation UNION ALL SELECT 'orders', 'source', count(*) FROM orders")
def one_sided_counts(spark, d):
    return rowdiff.one_sided_counts({t: _t(spark, d, t) for t in ("nation", "orders")}, "source")


@query("SELECT md5(string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey)) AS fingerprint FROM nation")
def manifest_digest(spark, d):
    return rowdiff.ordered_fingerprint(_t(spark, d, "nation"), F.col("n_nationkey"), F.col("n_name"))


@query("SELECT DISTINCT o_clerk AS name FROM (SELECT CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_clerk FROM orders) WHERE o_clerk IS NOT NULL")
def application_names(spark, d):
    return _t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("name")).filter("name is not null").distinct()


# ledgers and history


def _ledgers(spark, d):
    v = lambda n: F.concat(F.lit("1."), F.col(n).cast("string"))
    registry = _t(spark, d, "part").filter("p_size <= 30").select(F.col("p_brand").alias("family"), v("p_size").alias("version"))
    return registry, _t(spark, d, "part").filter("p_size <= 12 and p_partkey % 3 = 0").select(F.col("p_brand").alias("family"), v("p_size").alias("version"))


_LEDGER = """r AS (SELECT DISTINCT p_brand AS family, p_size FROM part WHERE p_size <= 30), p AS (SELECT DISTINCT p_brand AS family, p_size FROM part WHERE p_size <= 12 AND p_partkey % 3 = 0), top AS (SELECT family, max(p_size) AS top FROM p GROUP BY 1),
    s AS (SELECT r.family, r.p_size, CASE WHEN p.p_size IS NOT NULL THEN 'applied' WHEN top IS NULL OR r.p_size > top THEN 'pending' ELSE 'skipped' END AS status FROM r LEFT JOIN p USING (family, p_size) LEFT JOIN top USING (family))"""


@query(f"WITH {_LEDGER} SELECT family, '1.' || p_size AS version, status FROM s")
def ledger_status_versions(spark, d):
    return ledger.ledger_status(*_ledgers(spark, d), "family", "version")


@query(f"WITH {_LEDGER} SELECT family, '1.' || p_size AS version, status FROM s WHERE status = 'pending' AND p_size <= 20")
def pending_through(spark, d):
    return ledger.pending_through(ledger.ledger_status(*_ledgers(spark, d), "family", "version"), "family", "version", F.lit("1.20"))


@query("""WITH a AS (SELECT DISTINCT p_brand AS n, p_size AS v FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT p_brand AS n, p_size AS v FROM part WHERE p_partkey % 3 = 0)
    SELECT n AS script_name, '1.' || v || '.0' AS version, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'extra' ELSE 'diverged' END AS status FROM a FULL JOIN b USING (n, v) WHERE a.v IS NULL OR b.v IS NULL OR v % 5 = 0""")
def ledger_differences(spark, d):
    side = lambda keep, text: _t(spark, d, "part").filter(keep).select(F.col("p_brand").alias("script_name"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version"), F.when(F.col("p_size") % 5 == 0, text).otherwise("same").alias("sql_content")).distinct()
    return ledger.ledger_diff(side("p_partkey % 2 = 0", "a"), side("p_partkey % 3 = 0", "b"))


@query("SELECT p_brand AS script_name, '1.' || p_size AS version, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS step FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size > 9)")
def rollback_steps(spark, d):
    applied = _t(spark, d, "part").select(F.col("p_brand").alias("script_name"), F.concat(F.lit("1."), F.col("p_size").cast("string")).alias("version")).distinct()
    return ledger.rollback_plan(applied, "1.9").select("script_name", "version", F.col("step").cast("long").alias("step"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'applied' WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 THEN 'refused' ELSE 'failed' END AS outcome FROM orders")
def attempt_outcomes(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select("o_orderkey", F.when(k % 4 != 0, F.col("o_orderdate")).alias("finished_at"), (F.col("o_orderstatus") == "F").alias("ok"), F.when(k % 3 == 0, 404).otherwise(500).alias("status"), F.when(k % 5 == 0, 0).otherwise(2).alias("ran"))
    return o.select("o_orderkey", activity.attempt_outcome(o).alias("outcome"))


@query("""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS b, CASE WHEN p_partkey % 4 <> 0 THEN 20 END AS a FROM part),
    y AS (SELECT p_partkey, CASE WHEN b IS NOT NULL AND a IS NOT NULL THEN a / b WHEN b IS NULL AND a IS NULL THEN 1.5 END AS r FROM x)
    SELECT p_partkey, CASE WHEN r IS NULL THEN 'unknown' WHEN r >= 1.2 THEN 'slower' WHEN r <= 1 / 1.2 THEN 'faster' ELSE 'same' END AS verdict FROM y""")
def measured_comparison(spark, d):
    k = F.col("p_partkey")
    verdict = history.measured_compare(F.when(k % 3 != 0, F.col("p_size")), F.when(k % 4 != 0, 20), F.lit(2.0), F.lit(3.0))
    return _t(spark, d, "part").select("p_partkey", verdict.alias("verdict"))


@query("SELECT count(*) AS checks, count(*) FILTER (event_type = 'click') AS drifted, round((count(*) FILTER (event_type = 'click'))::DOUBLE / count(*), 9) AS share FROM events")
def drift_share(spark, d):
    return series.drift_share(_t(spark, d, "events").select((F.col("event_type") == "click").alias("drifted"))).withColumn("share", F.round("share", 9))


@query("SELECT count(DISTINCT f) AS prints, count(*) AS families FROM (SELECT list_sort(list(k)) AS f FROM (SELECT l_suppkey, l_linenumber || ':' || l_returnflag AS k FROM lineitem) GROUP BY l_suppkey)")
def run_fingerprints(spark, d):
    prints = _t(spark, d, "lineitem").groupBy("l_suppkey").agg(rollups.run_fingerprint(F.col("l_linenumber").cast("string"), F.col("l_returnflag")).alias("f"))
    return prints.agg(F.countDistinct("f").alias("prints"), F.count("*").alias("families"))


@query("""WITH s AS (SELECT o_orderkey AS pid, CASE WHEN o_orderkey % 5 = 0 THEN 'blocked' WHEN o_orderkey % 3 = 0 THEN 'idle-in-transaction' WHEN o_custkey >= 60 THEN 'long-running' ELSE 'running' END AS kind FROM orders)
    SELECT count(*) AS total, count(*) FILTER (kind = 'blocked') AS blocked, count(*) FILTER (kind = 'idle-in-transaction') AS idle, count(*) FILTER (kind = 'long-running') AS long, FALSE AS any_hidden FROM s""")
def session_summary(spark, d):
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select(k.alias("pid"), F.when(k % 5 == 0, "Lock").alias("wait_event_type"), F.when(k % 3 == 0, "idle in transaction").otherwise("active").alias("state"), F.col("o_custkey").alias("query_seconds"), F.lit(1).alias("state_seconds"), F.lit("SELECT 1").alias("query"))
    return activity.session_summary(activity.session_kind(o))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'everyone' WHEN n_nationkey % 3 = 0 THEN 'unknown' WHEN n_nationkey % 2 = 0 THEN 'applies' ELSE 'other' END AS audience FROM nation")
def script_targeting(spark, d):
    k = F.col("n_nationkey")
    header = F.when(k % 5 != 0, F.array(F.when(k % 2 == 0, " App").otherwise("other")))
    return _t(spark, d, "nation").select("n_nationkey", activity.targeting(header, F.when(k % 3 != 0, F.array(F.lit("app"), F.lit("job")))).alias("audience"))


@query("SELECT p_partkey, p_size, CASE WHEN p_size < 10 THEN 'breaking' WHEN p_size < 20 THEN 'high' WHEN p_size < 30 THEN 'low' ELSE 'safe' END AS severity FROM part")
def findings_in_order(spark, d):
    n = F.col("p_size")
    return object_diff.shown_first(_t(spark, d, "part").select("p_partkey", "p_size", F.when(n < 10, "breaking").when(n < 20, "high").when(n < 30, "low").otherwise("safe").alias("severity")), "severity", "p_partkey")


# sinks


@query("""SELECT '"' || n_nationkey || '","' || n_name || '","' || CASE WHEN n_nationkey % 2 = 0 THEN 'a ""b""' ELSE '' END || '"' AS line FROM nation""")
def csv_lines(spark, d):
    return export.csv_lines(_t(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, 'a "b"').alias("note")))


@query("SELECT s_suppkey, n_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2")
def appended_with_parent(spark, d):
    parents = _t(spark, d, "nation").filter("n_regionkey <> 2")
    return export.appended_with_parent(_t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), parents, "n_nationkey", ["n_name"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS name FROM nation WHERE n_nationkey % 3 <> 0 OR n_nationkey % 2 = 0")
def upserted(spark, d):
    n = _t(spark, d, "nation")
    return export.upserted(n.filter("n_nationkey % 3 <> 0").select("n_nationkey", F.col("n_name").alias("name")), n.filter("n_nationkey % 2 = 0").select("n_nationkey", F.lit("new").alias("name")), ["n_nationkey"])


@query("SELECT v.run, v.left_id, v.right_id, a.n_name AS left_name, b.n_name AS right_name, r_name AS set_name FROM (VALUES (1, 3, 4, 0), (2, 5, 6, 9), (3, 7, 99, 1)) v(run, left_id, right_id, set_id) JOIN nation a ON a.n_nationkey = left_id JOIN nation b ON b.n_nationkey = right_id LEFT JOIN region ON r_regionkey = set_id")
def inserted_runs(spark, d):
    rows = _values(spark, [(1, 3, 4, 0), (2, 5, 6, 9), (3, 7, 99, 1)], "run int, left_id int, right_id int, set_id int")
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    named = lambda s: n.select(F.col("n_nationkey").alias(f"{s}_id"), F.col("n_name").alias(f"{s}_name"))
    return rows.join(named("left"), "left_id").join(named("right"), "right_id").join(r.select(F.col("r_regionkey").alias("set_id"), F.col("r_name").alias("set_name")), "set_id", "left").drop("set_id")


# streams, run to their end


def _streamed(spark, d, operator: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """operator over events as a stream, with what is there read once; the result as a table."""
    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(source if _is_folder(spark, source) else f"{d}/event[s].parquet")
    out = f"{scratch.root(spark)}/{label}-{os.urandom(6).hex()}"
    result = operator(stream)
    changes.tick(result, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/rows")


def _is_folder(spark, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


@query("SELECT event_id AS id, user_id FROM events")
def stream_without_repeats(spark, d):
    return _streamed(spark, d, lambda e: changes.without_late_repeats(e.select(F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("ts"))).select("id", "user_id"), "stream-repeats")


@query("""WITH e AS (SELECT *, date_trunc('day', ts)::DATE AS day FROM events) SELECT day, count(*) AS runs, max(value) AS max_value FROM e WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1""")
def stream_daily(spark, d):
    return _streamed(spark, d, lambda e: changes.daily(e.select(F.col("ts").cast("timestamp").alias("ts"), "value")), "stream-daily")


# SQL texts: what is expected is stated

SCRIPTS = [
    (1, "ALTER TABLE t DROP legacy"), (2, "CREATE UNIQUE INDEX CONCURRENTLY i ON t (a)"), (3, "DROP INDEX i; CREATE INDEX i ON t (a)"), (4, "-- Change-type: additive\nDROP TABLE t"), (5, "DO $$ BEGIN EXECUTE 'drop table t'; END $$"), (6, "SELECT 'DROP TABLE x'"),
    (7, "DELETE FROM t; COMMIT"), (8, "ALTER TABLE t ADD COLUMN a int NOT NULL"), (9, "DROP TYPE m CASCADE"), (10, "MERGE INTO t USING u ON a = b WHEN MATCHED THEN DELETE"), (11, "ALTER TYPE mood ADD VALUE IF NOT EXISTS 'x'; GRANT SELECT ON t TO a"), (12, "TRUNCATE t; END"),
]


def _scripts(spark):
    return _values(spark, SCRIPTS, "id int, sql string")


@query(_sql_values([
    (1, "breaking", "DROP COLUMN", None), (2, "breaking", "CREATE UNIQUE INDEX", None), (3, "additive", None, None), (4, "breaking", "DROP TABLE", None), (5, "breaking", "EXECUTE in a DO block", "the SQL it runs changes nothing that exists"), (6, "patch", None, None),
    (7, "patch", None, None), (8, "additive", None, None), (9, "breaking", "DROP TYPE", None), (10, "patch", None, None), (11, "patch", None, None), (12, "patch", None, None),
], "id, level, label, unless"))
def sql_grades(spark, d):
    return _scripts(spark).select("id", sqltext.udfs()["sql_grade"]("sql").alias("g")).select("id", "g.level", "g.label", "g.unless")


@query(_sql_values([
    (1, "DROP COLUMN", "", ""), (2, "", "UNIQUE index", ""), (3, "", "", ""), (4, "DROP TABLE", "", ""), (5, "EXECUTE (cannot be read)", "", ""), (6, "", "", ""), (7, "DELETE", "", "COMMIT"),
    (8, "", "NOT NULL column with no default", ""), (9, "DROP … CASCADE", "", ""), (10, "DELETE", "", ""), (11, "", "", ""), (12, "TRUNCATE", "", "END"),
], "id, destroys, might_fail, control"))
def sql_warnings(spark, d):
    u = sqltext.udfs()
    return _scripts(spark).select("id", *[F.array_join(u[f]("sql"), ",").alias(n) for f, n in (("sql_destroys", "destroys"), ("sql_might_fail", "might_fail"), ("sql_transaction_control", "control"))])


@query(_sql_values([(1, 1, "alter"), (2, 1, "create"), (3, 1, "drop"), (3, 2, "create"), (4, 1, "drop"), (5, 1, "block"), (6, 1, "query"), (7, 1, "data"), (7, 2, "other"), (8, 1, "alter"), (9, 1, "drop"), (10, 1, "data"), (11, 1, "alter"), (11, 2, "other"), (12, 1, "data"), (12, 2, "other")], "id, step, kind"))
def sql_steps(spark, d):
    u = sqltext.udfs()
    steps = _scripts(spark).select("id", F.posexplode(u["sql_split"]("sql")).alias("step", "statement"))
    return steps.select("id", (F.col("step") + 1).alias("step"), u["sql_step_kind"]("statement").alias("kind"))


@query(_sql_values([(1, None, "breaking", True), (2, None, "breaking", True), (3, None, "additive", False), (4, "additive", "additive", True), (5, None, "breaking", True), (6, None, "patch", False), (7, None, "patch", False), (8, None, "additive", False), (9, None, "breaking", True), (10, None, "patch", False), (11, None, "patch", False), (12, None, "patch", False)], "id, declared, recorded, counts_as_breaking"))
def sql_change_types(spark, d):
    return _scripts(spark).select("id", sqltext.udfs()["sql_change_reading"]("sql").alias("r")).select("id", "r.declared", "r.recorded", "r.counts_as_breaking")


_QUERIES = [
    (1, "SELECT * FROM t WHERE name LIKE '%x'", None, "select-star,leading-wildcard"), (2, "SELECT a FROM t, u WHERE lower(a) = 'b' ORDER BY a", None, "function-on-column,comma-join,order-by-no-limit"), (3, "SELECT a FROM t WHERE b NOT IN (SELECT b FROM u) LIMIT 5 OFFSET 2000", None, "not-in-subquery,deep-offset"),
    (4, "SELECT pg_try_advisory_lock(1)", "denied-function", ""), (5, "SELECT a FROM t FOR UPDATE", "locks", ""), (6, "UPDATE t SET a = 1", "not-a-query", "missing-where"), (7, "SELECT count(*) FROM t", None, "unfiltered-count"), (8, "SELECT 1; SELECT 2", "several-statements", ""), (9, "", "empty", ""),
]


@query(_sql_values([(i, why, found) for i, _, why, found in _QUERIES], "id, refused, findings"))
def query_findings(spark, d):
    u = findings.udfs()
    return _values(spark, [(i, q) for i, q, _, _ in _QUERIES], "id int, q string").select("id", u["sql_gate"]("q").alias("refused"), F.array_join(u["sql_findings"]("q"), ",").alias("findings"))


@query(_sql_values([(1, "a,b", "c"), (2, "", None), (3, "a", None)], "id, equality, range"))
def filter_columns(spark, d):
    rows = _values(spark, [(1, "((b = 2) AND (t.a = 'x') AND (c > 5))"), (2, "((a = 1) OR (b = 2))"), (3, "(a = 1)")], "id int, filter string")
    return rows.select("id", findings.udfs()["filter_columns"]("filter").alias("f")).select("id", F.array_join("f.equality", ",").alias("equality"), F.col("f.range").alias("range"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '2.0.0' WHEN p_partkey % 3 = 1 THEN '1.' || (p_size + 1) || '.0' ELSE '1.' || p_size || '.' || (p_partkey % 5 + 1) END AS bumped FROM part")
def bumped_versions(spark, d):
    k = F.col("p_partkey")
    version = F.concat(F.lit("1."), F.col("p_size").cast("string"), F.lit("."), (k % 5).cast("string"))
    return _t(spark, d, "part").select("p_partkey", V.bumped(version, F.when(k % 3 == 0, "breaking").when(k % 3 == 1, "additive").otherwise("patch")).alias("bumped"))


# plans of a database, as JSON, and advice on schemas: one case for each rule


def _node(kind: str, rows: float = 1, cost: float = 10.0, *kids: dict, **more) -> dict:
    return {"Node Type": kind, "Plan Rows": rows, "Total Cost": cost, **{k.replace("_", " "): v for k, v in more.items()}, **({"Plans": list(kids)} if kids else {})}


PLANS = {
    "scan": _node("Seq Scan", 100, 900.0, Relation_Name="big", Filter="(a = 1)"),
    "waste": _node("Seq Scan", 100, 90.0, Relation_Name="mid", Filter="(a = 1)", Actual_Rows=100, Actual_Loops=1, Actual_Total_Time=4.0, Rows_Removed_by_Filter=50_000),
    "estimate": _node("Index Scan", 10, 9.0, Relation_Name="mid", Actual_Rows=1000, Actual_Loops=1, Actual_Total_Time=2.0),
    "sort": _node("Sort", 10, 50.0, _node("Index Scan", 10, 9.0, Relation_Name="mid"), Sort_Space_Type="Disk"),
    "loop": _node("Nested Loop", 10, 5000.0, _node("Index Scan", 100, 9.0, Relation_Name="mid"), _node("Seq Scan", 1_000_000, 40.0, Relation_Name="big")),
    "bitmap": _node("Bitmap Heap Scan", 10, 9.0, Relation_Name="mid", Lossy_Heap_Blocks=5),
    "fetch": _node("Index Only Scan", 10, 9.0, Relation_Name="big", Heap_Fetches=20_000),
    "join": _node("Hash Join", 1000, 2000.0, _node("Seq Scan", 1_000_000, 900.0, Relation_Name="big"), _node("Hash", 100, 9.0)),
    "write": _node("ModifyTable", 1, 10.0, _node("Index Scan", 1, 9.0, Relation_Name="mid")),
}


def _plan_steps(spark) -> DataFrame:
    texts = _values(spark, [(k, json.dumps([{"Plan": p}])) for k, p in PLANS.items()], "plan_id string, plan string")
    return scratch.materialize(steps.weighed(steps.flattened(texts)), "plan-steps")


def _plan_sizes(spark) -> DataFrame:
    return _values(spark, [("big", 1_000_000.0), ("mid", 5_000.0)], "relation string, rows double")


@query(_sql_values([("scan", 1, "seq-scan", "high"), ("waste", 1, "wasteful-filter", "medium"), ("estimate", 1, "estimate-off", "medium"), ("sort", 1, "sort-on-disk", "medium"), ("loop", 3, "nested-loop", "high"), ("bitmap", 1, "lossy-bitmap", "low"), ("fetch", 1, "heap-fetches", "low"), ("join", 1, "join-key", "medium")], "plan_id, step_id, finding, severity"))
def plan_findings(spark, d):
    return findings.plan_findings(_plan_steps(spark), _plan_sizes(spark))


@query(_sql_values([
    ("scan", 1, None, 0, 900.0, True), ("waste", 1, None, 0, 90.0, True), ("estimate", 1, None, 0, 9.0, True), ("sort", 1, None, 0, 41.0, True), ("sort", 2, 1, 1, 9.0, False), ("loop", 1, None, 0, 991.0, False), ("loop", 2, 1, 1, 9.0, False), ("loop", 3, 1, 1, 4000.0, True),
    ("bitmap", 1, None, 0, 9.0, True), ("fetch", 1, None, 0, 9.0, True), ("join", 1, None, 0, 1091.0, True), ("join", 2, 1, 1, 900.0, False), ("join", 3, 1, 1, 9.0, False), ("write", 1, None, 0, 1.0, False), ("write", 2, 1, 1, 9.0, True),
], "plan_id, step_id, parent_id, depth, self_cost, heaviest").replace("SELECT *", "SELECT * REPLACE (CAST(self_cost AS DOUBLE) AS self_cost)"))
def plan_steps(spark, d):
    return _plan_steps(spark).select("plan_id", "step_id", "parent_id", "depth", "self_cost", "heaviest")


@query(_sql_values([(k, k != "write") for k in PLANS], "plan_id, reads_only"))
def plan_reads_only(spark, d):
    return findings.reads_only(_plan_steps(spark))


@query(_sql_values([("scan", 63, "fair"), ("waste", 95, "good"), ("estimate", 80, "fair"), ("sort", 85, "good"), ("loop", 68, "fair"), ("bitmap", 98, "good"), ("fetch", 98, "good"), ("join", 84, "fair"), ("write", 100, "good")], "plan_id, score, band"))
def plan_scores(spark, d):
    found = _plan_steps(spark)
    return steps.scored(found, findings.plan_findings(found, _plan_sizes(spark)), _plan_sizes(spark))


def _schema(spark) -> tuple[DataFrame, ...]:
    tables = _values(spark, [("t", False, False, 20_000_000), ("u", True, False, 5), ("w", True, False, 50_000_000)], "table string, has_primary_key boolean, partitioned boolean, rows long")
    columns = _values(spark, [("t", "at", "timestamp without time zone", None, False), ("t", "flag", "boolean", None, False), ("t", "code", "character(3)", None, False), ("u", "id", "text", "nextval('x')", True)], "table string, column string, type string, default string, in_primary_key boolean")
    index = lambda t, name, columns, **k: (t, name, columns, False, k.get("valid", True), k.get("partitioned", False), 1, k.get("scans", 5), 40, None)
    rows = [index("t", "i1", ["a"], scans=0), index("t", "i2", ["a"]), index("t", "i3", ["a", "b"]), index("t", "i4", ["flag"]), index("w", "broken", ["z"], valid=False), index("w", "half", ["z"], valid=False, partitioned=True)]
    rows += [index("u", f"m{k}", [f"c{k}"]) for k in range(7)]
    indexes = _values(spark, rows, "table string, index string, columns array<string>, is_unique boolean, valid boolean, partitioned boolean, size long, scans long, stats_days int, supports string")
    keys = _values(spark, [("t", "f1", ["z"]), ("t", "f2", ["b", "a"])], "table string, name string, columns array<string>")
    stats = _values(spark, [("t", 100_000, 50, 5_000_000, 1, 100_000, 50_000, None, 10, 90_000)], "table string, rows long, seq_scans long, seq_rows long, index_scans long, live long, dead long, last_analyzed timestamp, hits long, reads long")
    return tables, columns, indexes, keys, stats


_STRUCTURAL = [
    ("no-primary-key", "high", "t", "t"), ("foreign-key-not-indexed", "high", "t", "f1"), ("duplicate-index", "medium", "t", "i2"), ("redundant-index", "low", "t", "i1"), ("redundant-index", "low", "t", "i2"), ("boolean-index", "low", "t", "i4"), ("many-indexes", "medium", "u", "u"),
    ("timestamp-without-timezone", "medium", "t", "at"), ("blank-padded-char", "low", "t", "code"), ("serial-not-identity", "low", "u", "id"), ("text-primary-key", "low", "u", "id"),
]
_STATISTICAL = [("sequential-scan-heavy", "high", "t", "t"), ("dead-tuples", "medium", "t", "t"), ("never-analyzed", "medium", "t", "t"), ("low-cache-hit", "medium", "t", "t"), ("unused-index", "medium", "t", "i1"), ("invalid-index", "high", "w", "broken"), ("unfinished-partitioned-index", "medium", "w", "half")]
_PARTITIONING = [("partition-by-date", "medium", "t", "at"), ("partitioning-candidate", "medium", "w", "w")]
_ADVICE = 'advice, severity, "table", subject'


def _advice(spark) -> DataFrame:
    tables, columns, indexes, keys, stats = _schema(spark)
    return advice.structural(tables, columns, indexes, keys).unionByName(advice.statistical(stats, indexes)).unionByName(advice.partitioning(tables, columns))


@query(_sql_values(_STRUCTURAL + _STATISTICAL + _PARTITIONING, _ADVICE))
def schema_advice(spark, d):
    return _advice(spark)


@query(_sql_values([x for x in _STRUCTURAL + _STATISTICAL + _PARTITIONING if x not in (("redundant-index", "low", "t", "i2"), ("unused-index", "medium", "t", "i1"))], _ADVICE))
def advice_without_repeats(spark, d):
    return advice.without_repeats(_advice(spark))


@query(_sql_values([("f1", True), ("t", False)], "subject, attached"))
def advice_with_wanted_indexes(spark, d):
    tables, columns, indexes, keys, _ = _schema(spark)
    wanted = _values(spark, [("t", ["z", "y"], None)], "table string, equality array<string>, range string")
    return advice.with_wanted_indexes(advice.structural(tables, columns, indexes, keys), wanted, keys).filter("severity = 'high'").select("subject", "attached")


@query("""WITH q AS (SELECT user_id AS f, event_type AS t, 'c' || (CAST(json_extract_string(props, '$.k') AS INT) % 3) AS e FROM events) SELECT t AS "table", e AS equality, count(DISTINCT f) AS queries FROM q WHERE NOT (t = 'click' AND e = 'c1') GROUP BY 1, 2 HAVING count(DISTINCT f) >= 2 OR count(*) >= 3""")
def composite_indexes(spark, d):
    e = _t(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    searches = F.array(F.struct(F.col("event_type").alias("table"), F.array(F.concat(F.lit("c"), (F.col("k") % 3).cast("string"))).alias("equality"), F.lit(None).cast("string").alias("range")))
    patterns = rollups.search_patterns(e.select(F.col("user_id").alias("fingerprint"), searches.alias("searched_columns")))
    found = rollups.composite_advice(patterns, _values(spark, [("click", ["c1", "x"])], "table string, columns array<string>"), most=1000)
    return found.select("table", F.array_join("equality", ",").alias("equality"), "queries")


# whole snapshots, and whole tables where an older query of the catalogue shows a part


@query("""SELECT n_name AS "table" FROM nation WHERE n_nationkey % 3 <> 2""")
def base_tables(spark, d):
    k = F.col("n_nationkey")
    relations = _t(spark, d, "nation").select(F.col("n_name").alias("table"), F.when(k % 3 == 0, "r").when(k % 3 == 1, "p").otherwise("v").alias("kind"))
    return catalog.base_tables(relations.unionByName(_values(spark, [("script_patch", "r"), ("script_patch_reverted", "p")], "table string, kind string")))


@query("""SELECT 5 AS format_version, 'app' AS schema, count(DISTINCT r_name)::INT AS tables, (SELECT count(*)::INT FROM supplier) AS views, (SELECT count(*)::INT FROM customer) AS indexes, NULL::INT AS routines FROM region JOIN nation ON n_regionkey = r_regionkey""")
def whole_snapshot(spark, d):
    none = F.lit(None).cast("string")
    columns = _attributes(spark, d).select("table", "column", F.col("number").cast("int").alias("ordinal"), F.lit("int").alias("type"))
    view = _t(spark, d, "supplier").select(F.lit("view").alias("kind"), F.col("s_name").alias("key"), none.alias("table"), F.lit("SELECT 1").alias("definition"))
    index = _t(spark, d, "customer").select(F.lit("index").alias("kind"), F.col("c_name").alias("key"), F.col("c_mktsegment").alias("table"), F.lit("x").alias("definition"))
    own = _values(spark, [("index", "own", "script_patch", "x")], "kind string, key string, table string, definition string")
    found = catalog.snapshot("app", columns, view.unionByName(index).unionByName(own), {"view": "views", "index": "indexes", "routine": "routines"}, ("routine",))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).alias(c)
    return found.select("format_version", "schema", size("tables"), size("views"), size("indexes"), size("routines"))


@query("SELECT event_type, count(*) AS calls, sum(user_id)::BIGINT AS total_users FROM events GROUP BY 1 UNION ALL SELECT 'never', 0, 0")
def usage_padded(spark, d):
    events = _t(spark, d, "events")
    rollup = rollups.feature_rollup(events, "event_type", {}, {"total_users": "user_id"}, "value").select("event_type", "calls", "total_users")
    return rollups.padded(rollup, events.select("event_type").distinct().unionByName(_values(spark, [("never",)], "event_type string")), "event_type", ["calls", "total_users"])


@query("WITH s AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-04', INTERVAL 1 DAY))::DATE AS day) SELECT s.day, count(ts) AS n FROM s LEFT JOIN events ON ts::DATE = s.day GROUP BY 1")
def calendar_days(spark, d):
    return series.calendar(_t(spark, d, "events"), "ts", "2024-02-04", 35)


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS p, 'n' || n_nationkey AS c FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
    w AS (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region UNION ALL SELECT e.c, w.depth + 1 FROM w JOIN e ON e.p = w.node) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1""")
def reachable_customers(spark, d):
    n, c, r = _t(spark, d, "nation"), _t(spark, d, "customer"), _t(spark, d, "region")
    name = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    edges = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(c.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))
    return graph.closure(edges, r.select(name("r", "r_regionkey").alias("node")))


@query("""WITH w AS (SELECT DISTINCT user_id, ts >= TIMESTAMP '2024-01-02' AS later FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-03')
    SELECT user_id, CASE WHEN bool_and(later) THEN 'appeared' ELSE 'resolved' END AS status FROM w GROUP BY 1 HAVING count(*) = 1""")
def daily_users(spark, d):
    e, at = _t(spark, d, "events"), lambda day: F.lit(f"2024-01-{day:02d}").cast("timestamp_ntz")
    days = lambda a, b: e.filter((F.col("ts") >= at(a)) & (F.col("ts") < at(b)))
    return sets.appeared_resolved(days(1, 2), days(2, 3), ["user_id"])
