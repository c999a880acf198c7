"""Scripts from a comparison: ordered statements, safe mode, rollback, risk.

Statements are rows (phase, depth, kind, table, object, severity, destructive, sql); a script is their order
by phase, depth and name. Left is the wanted state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.versions import LEVELS, level_rank
from ..scratch import materialize
from .graph import closure
from .schema_diff import compare

#: The order in which statements run (what depends on something goes before it and comes after it).
PHASES = (
    "extensions", "collations", "types", "view-drops", "renames", "table-creates", "sequences", "routines", "column-adds", "column-alters", "column-drops", "constraint-drops",
    "index-drops", "trigger-drops", "policy-drops", "constraints", "indexes", "foreign-keys", "triggers", "policies", "views", "privileges", "routine-drops", "table-drops", "sequence-drops", "type-drops",
)


def phase(kind: str) -> Column:
    return F.lit(PHASES.index(kind))


def quoted(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def column_definition(c: str) -> Column:
    """name type [NOT NULL] [DEFAULT …] of a struct of the columns table."""
    f = lambda n: F.col(f"{c}.{n}") if c else F.col(n)
    return F.concat(quoted(f("column")), F.lit(" "), f("type"), F.when(f("nullable"), "").otherwise(" NOT NULL"), F.coalesce(F.concat(F.lit(" DEFAULT "), f("default")), F.lit("")))


def _rows(df: DataFrame, kind: str, name: str, severity: Column | str, destructive: bool, sql: Column, obj: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(phase(kind).alias("phase"), F.lit(0).alias("depth"), F.lit(name).alias("kind"), F.col("table"), obj.alias("object"), severity.alias("severity"), F.lit(destructive).alias("destructive"), sql.alias("sql"))


def statements(left: DataFrame, right: DataFrame, order: DataFrame | None = None, rename_columns: bool = True) -> DataFrame:
    """The statements that turn right into left. order: node, depth (of graph.topological_depth) for tables that need others first.

    The comparison is made once and read from a scratch table by every kind of statement."""
    found = compare(left, right, rename_columns)
    tables, diffs = found["tables"], materialize(found["columns"], "compared-columns")
    t = quoted(F.col("table"))
    created = left.join(tables.filter("status = 'onlyA'").select(F.col("left_table").alias("table")), "table").groupBy("table").agg(F.sort_array(F.collect_list(F.struct("ordinal", column_definition("").alias("d")))).alias("c"))
    create = _rows(created, "table-creates", "create-table", "low", False, F.concat(F.lit("CREATE TABLE "), t, F.lit(" ("), F.array_join(F.transform("c", lambda x: x["d"]), ", "), F.lit(")")), F.col("table"))
    renamed = tables.filter("status = 'renamed'").select(F.col("left_table").alias("table"), F.col("right_table").alias("old"))
    rename = _rows(renamed, "renames", "rename-table", "high", False, F.concat(F.lit("ALTER TABLE "), quoted(F.col("old")), F.lit(" RENAME TO "), t), F.col("old"))
    dropped = tables.filter("status = 'onlyB'").select(F.col("right_table").alias("table"))
    drop = _rows(dropped, "table-drops", "drop-table", "high", True, F.concat(F.lit("DROP TABLE "), t), F.col("table"))
    added = diffs.filter("status = 'onlyA'").select("table", "column").join(left, ["table", "column"])
    required = ~F.col("nullable") & F.col("default").isNull()
    add = _rows(added, "column-adds", "add-column", F.when(required, "high").otherwise("low"), False, F.concat(F.lit("ALTER TABLE "), t, F.lit(" ADD COLUMN "), column_definition("")), F.col("column"))
    gone = diffs.filter("status = 'onlyB'")
    remove = _rows(gone, "column-drops", "drop-column", "high", True, F.concat(F.lit("ALTER TABLE "), t, F.lit(" DROP COLUMN "), quoted(F.col("column"))), F.col("column"))
    changed = diffs.filter("status in ('matched', 'renamed')").select("table", "column", F.explode("changes").alias("c")).filter("c.kind in ('type', 'size', 'nullability', 'default')")
    head = F.concat(F.lit("ALTER TABLE "), t, F.lit(" ALTER COLUMN "), quoted(F.col("column")))
    clause = (
        F.when(F.col("c.kind").isin("type", "size"), F.concat(F.lit(" TYPE "), F.col("c.after")))
        .when(F.col("c.kind") == "nullability", F.when(F.col("c.after") == "true", " DROP NOT NULL").otherwise(" SET NOT NULL"))
        .otherwise(F.coalesce(F.concat(F.lit(" SET DEFAULT "), F.col("c.after")), F.lit(" DROP DEFAULT")))
    )
    alter = _rows(changed, "column-alters", "alter-column", F.col("c.severity"), False, F.concat(head, clause), F.col("column"))
    moved = diffs.filter("status = 'renamed'")
    column = _rows(moved, "renames", "rename-column", "high", False, F.concat(F.lit("ALTER TABLE "), t, F.lit(" RENAME COLUMN "), quoted(F.col("renamed_from")), F.lit(" TO "), quoted(F.col("column"))), F.col("column"))
    every = create.unionByName(column).unionByName(rename).unionByName(drop).unionByName(add).unionByName(remove).unionByName(alter)
    if order is None:
        return every
    # what is needed first is created first and dropped last
    ranked = every.join(order.select(F.col("node").alias("table"), F.col("depth").alias("_d")), "table", "left")
    return ranked.withColumn("depth", F.coalesce(F.when(F.col("kind") == "drop-table", -F.col("_d")).otherwise(F.col("_d")), F.lit(0))).select(*every.columns)


def in_order(script: DataFrame) -> DataFrame:
    return script.orderBy("phase", "depth", "table", "object", "sql")


def breaks(severity: str = "severity") -> Column:
    """Whether a severity breaks: columns say high, objects say breaking."""
    return F.col(severity).isin("high", "breaking")


def held_back(script: DataFrame, uses: DataFrame) -> DataFrame:
    """Safe mode: what isn't run, with why: destructive statements, and breaking ones on what something that stays still uses.

    uses: object, depends_on. What stays is every user that the script doesn't drop, and what its held-back drops leave;
    what those use, directly or through others, is still used."""
    script = materialize(script, "script")
    drops = script.filter(F.col("kind").startswith("drop-") & (F.col("kind") != "drop-column"))
    gone = drops.filter("not destructive").select(F.col("object").alias("node"))
    edges = uses.select(F.col("object").alias("parent"), F.col("depends_on").alias("child"))
    # an object that is dropped goes only if nothing that stays uses it, so it is no start of its own
    stays = edges.select(F.col("parent").alias("node")).distinct().join(gone, "node", "left_anti")
    used = closure(edges, stays).join(edges.select(F.col("child").alias("node")).distinct(), "node", "left_semi").select("node")
    risky = script.filter(breaks() & ~F.col("destructive"))
    # a constraint, index or trigger is dropped as itself; other statements are on their table
    target = F.when(F.col("kind").startswith("drop-"), F.col("object")).otherwise(F.coalesce("table", "object"))
    held = risky.withColumn("_target", target).join(used, F.col("_target") == used.node, "left_semi").drop("_target")
    return script.filter("destructive").withColumn("why", F.lit("destructive")).unionByName(held.withColumn("why", F.lit("still used")))


def safe(script: DataFrame, uses: DataFrame) -> DataFrame:
    """The statements that safe mode runs."""
    script = materialize(script, "script")
    return script.join(held_back(script, uses).select("sql"), "sql", "left_anti").select(*script.columns)


def losses(script: DataFrame) -> DataFrame:
    """table, object, warning: what a script destroys and no script brings back."""
    return script.filter("destructive").select("table", "object", F.concat(F.lit("rows of "), F.col("kind"), F.lit(" are gone")).alias("warning"))


def rollback(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(statements back to right, warnings: what the way there destroys and no script brings back)."""
    return statements(right, left), losses(statements(left, right))


def lossless(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether a rollback brings everything back (nothing on the way there destroys rows)."""
    return script_lossless(statements(left, right))


def script_lossless(script: DataFrame) -> DataFrame:
    return losses(script).agg((F.count("*") == 0).alias("lossless"), F.count("*").alias("warnings"))


def level(script: DataFrame, allow_data_loss: bool = False) -> DataFrame:
    """One row: the change level of what runs: breaking, additive (something is made) or patch, as for an empty script.

    Manual notes run nothing; destructive statements run only where data loss is allowed."""
    runs = (F.col("kind") != "manual") & (F.lit(allow_data_loss) | ~F.col("destructive"))
    one = F.when(breaks(), "breaking").when(F.col("kind").startswith("create-") | F.col("kind").startswith("add-"), "additive").otherwise("patch")
    return script.agg(F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(F.max(F.when(runs, level_rank(one))), F.lit(1)) + 1).alias("level"))


def structural_level(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """breaking, additive or patch of a comparison, by aggregates alone."""
    lost = tables.agg(F.coalesce(F.bool_or(F.col("status").isin("onlyB", "renamed")), F.lit(False)).alias("t"), F.coalesce(F.bool_or(F.col("status") == "onlyA"), F.lit(False)).alias("ta"))
    cols = columns.agg(F.coalesce(F.bool_or((F.col("status") == "onlyB") | F.exists("changes", lambda c: c["severity"] == "high")), F.lit(False)).alias("c"), F.coalesce(F.bool_or(F.col("status") == "onlyA"), F.lit(False)).alias("ca"))
    return lost.join(F.broadcast(cols)).select(F.when(F.col("t") | F.col("c"), "breaking").when(F.col("ta") | F.col("ca"), "additive").otherwise("patch").alias("level"))


def difference_lines(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """The differences as text lines, one a table or column change."""
    a = tables.filter("status <> 'matched'").select(F.concat_ws(" ", F.lit("table"), "status", F.coalesce("left_table", "right_table")).alias("line"))
    b = columns.filter("status <> 'matched'").select(F.concat_ws(" ", F.lit("column"), "status", F.concat_ws(".", "table", "column")).alias("line"))
    c = columns.filter("status = 'matched'").select("table", "column", F.explode("changes").alias("c")).select(F.concat_ws(" ", F.lit("column"), "c.kind", F.concat_ws(".", "table", "column"), F.coalesce("c.before", F.lit("-")), F.coalesce("c.after", F.lit("-"))).alias("line"))
    return a.unionByName(b).unionByName(c)


def drift_fingerprint(lines: DataFrame) -> DataFrame:
    """SHA-1 over the sorted lines. They describe metadata: as many as there are changed columns."""
    return lines.agg(F.sha1(F.array_join(F.sort_array(F.collect_list("line")), "\n").cast("binary")).alias("fingerprint"), F.count("*").alias("differences"))


def approval_fingerprint(script: DataFrame) -> DataFrame:
    """SHA-256 over the script in its order: an approval holds for exactly this text."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("phase", "depth", "table", "object", "sql"))), lambda x: x["sql"])
    return script.agg(F.sha2(F.array_join(ordered, ";\n"), 256).alias("fingerprint"))


def run_risk(scripts: DataFrame, sql: str = "sql") -> DataFrame:
    """Each script with its grade, rows that it destroys, what might fail and enum additions."""
    from ..functions import sqltext

    u = sqltext.udfs()
    return scripts.withColumns({"grade": u["sql_grade"](sql), "destroys": u["sql_destroys"](sql), "might_fail": u["sql_might_fail"](sql), "adds_enum": F.col(sql).rlike(r"(?is)\balter\s+type\b.*\badd\s+value\s+if\s+not\s+exists\b")})


def newest_alerts(alerts: DataFrame, key: str, order: str) -> DataFrame:
    """One alert a key: the newest that says something."""
    return alerts.filter("alert <> 'nothing'").groupBy(key).agg(F.max_by("alert", order).alias("alert"), F.max(order).alias(order))
