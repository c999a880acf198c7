"""Everything of a schema besides tables and columns, compared: constraints, indexes, triggers, policies, views, sequences,
types, collations, extensions, routines and privileges, with severities and the statements that turn right into left.

objects: kind, table (null where there is none), name, definition, signature (for constraints: what they cover, as text),
is_unique (indexes), grants (array of grantee:privilege). Left is the wanted state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized
from ..scratch import materialize
from . import enums
from .graph import topological_depth
from .migration import PHASES, quoted, statements

OBJECTS = "kind string, table string, name string, definition string, signature string, is_unique boolean, grants array<string>"
#: Kinds of constraints; those whose loss breaks and that are matched by what they cover; kinds whose change breaks.
CONSTRAINTS = ("PRIMARY KEY", "UNIQUE", "FOREIGN KEY", "CHECK", "EXCLUDE")
COVERING = ("PRIMARY KEY", "UNIQUE", "FOREIGN KEY")
CHANGE_BREAKS = ("VIEW", "MATERIALIZED VIEW", "POLICY", "ROW SECURITY", "PARTITIONING", "COLLATION")
#: By kind: phase and text of CREATE, phase and text of DROP, and how a change is made: again (drop and create), replace, alter or manual.
MAKING = {
    **{k: ("foreign-keys" if k == "FOREIGN KEY" else "constraints", "ALTER TABLE {table} ADD CONSTRAINT {name} {definition}", "constraint-drops", "ALTER TABLE {table} DROP CONSTRAINT {name}", "again") for k in CONSTRAINTS},
    "INDEX": ("indexes", "{definition}", "index-drops", "DROP INDEX {name}", "again"),
    "TRIGGER": ("triggers", "{definition}", "trigger-drops", "DROP TRIGGER {name} ON {table}", "again"),
    "POLICY": ("policies", "{definition}", "policy-drops", "DROP POLICY {name} ON {table}", "again"),
    "ROW SECURITY": ("policies", "ALTER TABLE {table} {definition}", "policy-drops", "ALTER TABLE {table} DISABLE ROW LEVEL SECURITY", "replace"),
    "VIEW": ("views", "CREATE VIEW {name} AS {definition}", "view-drops", "DROP VIEW {name}", "again"),
    "MATERIALIZED VIEW": ("views", "CREATE MATERIALIZED VIEW {name} AS {definition}", "view-drops", "DROP MATERIALIZED VIEW {name}", "again"),
    "SEQUENCE": ("sequences", "CREATE SEQUENCE {name} {definition}", "sequence-drops", "DROP SEQUENCE {name}", "alter"),
    "TYPE": ("types", "CREATE TYPE {name} AS {definition}", "type-drops", "DROP TYPE {name}", "manual"),
    "DOMAIN": ("types", "CREATE DOMAIN {name} AS {definition}", "type-drops", "DROP DOMAIN {name}", "manual"),
    "COLLATION": ("collations", "CREATE COLLATION {name} {definition}", "type-drops", "DROP COLLATION {name}", "manual"),
    "EXTENSION": ("extensions", "CREATE EXTENSION {name} VERSION {definition}", "type-drops", "DROP EXTENSION {name}", "alter"),
    "ROUTINE": ("routines", "{definition}", "routine-drops", "DROP ROUTINE {name}", "replace"),
}
ALTERED = {"SEQUENCE": "ALTER SEQUENCE {name} {definition}", "EXTENSION": "ALTER EXTENSION {name} UPDATE TO {definition}"}


def constraint_severity(kind: Column, added: Column) -> Column:
    """A new constraint breaks; a lost one does if others relied on it."""
    return F.when(added | kind.isin(*COVERING), "breaking").otherwise("info")


def added_column_severity(nullable: Column, default: Column, generated: Column) -> Column:
    """A new column that rows can't get by themselves breaks."""
    return F.when(generated.isNotNull(), "safe").when(~nullable & default.isNull(), "breaking").otherwise("safe")


def create_severity(kind: Column, unique: Column) -> Column:
    unique = F.coalesce(unique, F.lit(False))
    return F.when(kind == "POLICY", "breaking").when((kind == "INDEX") & unique, "breaking").otherwise("info")


def drop_severity(kind: Column, unique: Column) -> Column:
    return F.when((kind == "INDEX") & ~F.coalesce(unique, F.lit(False)), "safe").otherwise("breaking")


def change_severity(kind: Column, unique_before: Column, unique_after: Column, grants_before: Column, grants_after: Column) -> Column:
    uniques = F.coalesce(unique_before, F.lit(False)) | F.coalesce(unique_after, F.lit(False))
    lost = F.size(F.array_except(F.coalesce(grants_before, F.array().cast("array<string>")), F.coalesce(grants_after, F.array().cast("array<string>")))) > 0
    return (
        F.when(kind.isin(*CHANGE_BREAKS), "breaking").when(kind == "PRIVILEGES", F.when(lost, "breaking").otherwise("safe"))
        .when(kind == "INDEX", F.when(uniques, "breaking").otherwise("safe")).otherwise("info")
    )


def forward(before: Column, after: Column) -> Column:
    """Whether a version of number parts rises; parts that aren't numbers and differ say no."""
    parts = lambda c: F.split(c, r"\.")
    a, b = parts(before), parts(after)
    n = F.greatest(F.size(a), F.size(b))
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.coalesce(F.get(a, i), F.lit("0")).alias("a"), F.coalesce(F.get(b, i), F.lit("0")).alias("b")))
    first = F.get(F.filter(pairs, lambda p: p["a"] != p["b"]), F.lit(0))
    number = lambda c: F.when(c.rlike(r"^\d+$"), c.cast("decimal(38,0)"))
    return F.coalesce(number(first["b"]) > number(first["a"]), F.lit(False))


def matched_constraints(left: DataFrame, right: DataFrame) -> DataFrame:
    """kind, table, name, right_name, status, left_definition, right_definition, severity. Constraints match by name, then what is left by
    what it covers (keys and references) or by its text (checks); of several alike, the first of each side by name."""
    keys = ["table", "kind"]
    meaning = F.when(F.col("kind").isin(*COVERING), F.col("signature")).otherwise(normalized(F.col("definition")))
    a = left.filter(F.col("kind").isin(*CONSTRAINTS)).select(*keys, "name", F.col("definition").alias("left_definition"), meaning.alias("meaning"))
    b = right.filter(F.col("kind").isin(*CONSTRAINTS)).select(*keys, "name", F.col("definition").alias("right_definition"), meaning.alias("meaning"))
    same = a.drop("meaning").join(b.drop("meaning"), [*keys, "name"]).withColumn("right_name", F.col("name"))
    place = F.row_number().over(Window.partitionBy(*keys, "meaning").orderBy("name"))
    rest_a = a.join(b, [*keys, "name"], "left_anti").withColumn("nth", place)
    rest_b = b.join(a, [*keys, "name"], "left_anti").withColumn("nth", place).withColumnRenamed("name", "right_name")
    rest = rest_a.join(rest_b, [*keys, "meaning", "nth"], "full_outer")
    both = same.unionByName(rest.select(*same.columns))
    status = (
        F.when(F.col("right_name").isNull(), "onlyA").when(F.col("name").isNull(), "onlyB").when(F.col("name") != F.col("right_name"), "renamed")
        .when(normalized(F.col("left_definition")) == normalized(F.col("right_definition")), "matched").otherwise("changed")
    )
    severity = F.when(F.col("status").isin("matched", "renamed"), "safe").otherwise(constraint_severity(F.col("kind"), F.col("status") != "onlyB"))
    return both.withColumn("status", status).withColumn("severity", severity)


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """All objects of both sides: kind, table, name, right_name, status (matched, changed, renamed, onlyA, onlyB), left_definition,
    right_definition, left_grants, right_grants, severity, manual (a change that no statement makes)."""
    side = lambda df, s: df.filter(~F.col("kind").isin(*CONSTRAINTS)).select("kind", F.coalesce("table", F.lit("")).alias("t"), "name", F.struct("definition", "is_unique", F.array_sort("grants").alias("grants"), F.lit(1).alias("one")).alias(s))
    both = side(left, "l").join(side(right, "r"), ["kind", "t", "name"], "full_outer")
    l, r = (lambda n: F.col(f"l.{n}")), (lambda n: F.col(f"r.{n}"))
    equal = normalized(l("definition")).eqNullSafe(normalized(r("definition"))) & l("grants").eqNullSafe(r("grants"))
    status = F.when(r("one").isNull(), "onlyA").when(l("one").isNull(), "onlyB").when(equal, "matched").otherwise("changed")
    kind, is_ = F.col("kind"), lambda s: F.col("status") == s
    severity = (
        F.when(is_("matched"), "safe").when(is_("onlyA"), create_severity(kind, l("is_unique"))).when(is_("onlyB"), drop_severity(kind, r("is_unique")))
        .otherwise(change_severity(kind, r("is_unique"), l("is_unique"), r("grants"), l("grants")))
    )
    grows = F.coalesce((kind == "TYPE") & (enums.verdict(enums.labels(r("definition")), enums.labels(l("definition"))) == "grown"), F.lit(False))
    by_hand = (kind.isin(*[k for k, m in MAKING.items() if m[4] == "manual"]) & ~grows) | ((kind == "EXTENSION") & ~forward(r("definition"), l("definition")))
    out = both.withColumn("status", status).select(
        "kind", F.when(F.col("t") != "", F.col("t")).alias("table"), "name", F.col("name").alias("right_name"), "status", l("definition").alias("left_definition"), r("definition").alias("right_definition"),
        l("grants").alias("left_grants"), r("grants").alias("right_grants"), severity.alias("severity"), (is_("changed") & by_hand).alias("manual"),
    )
    none = F.lit(None).cast("array<string>")
    return out.unionByName(matched_constraints(left, right).withColumns({"left_grants": none, "right_grants": none, "manual": F.lit(False)}).select(*out.columns))


def _filled(template: Column, name: Column, definition: Column) -> Column:
    text = template
    for mark, value in (("{table}", quoted(F.coalesce(F.col("table"), F.lit("")))), ("{name}", quoted(name)), ("{definition}", F.coalesce(definition, F.lit("")))):
        text = F.replace(text, F.lit(mark), value)
    return text


def _making(diff: DataFrame) -> DataFrame:
    """MAKING as rows, one a kind."""
    rows = []
    for kind, (made, create, gone, drop, change) in MAKING.items():
        noun = "constraint" if kind in CONSTRAINTS else kind.lower().replace(" ", "-")
        verb = "add" if kind in CONSTRAINTS else "alter" if kind == "ROW SECURITY" else "create"
        rows.append((kind, PHASES.index(made), f"{verb}-{noun}", create, PHASES.index(gone), f"drop-{noun}", drop, change, f"alter-{noun}", ALTERED.get(kind), kind == "MATERIALIZED VIEW"))
    return diff.sparkSession.createDataFrame(rows, "kind string, made int, create_kind string, create string, gone int, drop_kind string, drop string, change string, alter_kind string, alter string, rows boolean")


def object_statements(diff: DataFrame) -> DataFrame:
    """Statements (phase, depth, kind, table, object, severity, destructive, sql) for compared(): in the same form as migration.statements().

    Labels that an enum gains are statements in their order (the object carries their number); an enum that loses or moves labels is manual.
    Each object makes an array of statements, which becomes rows: the comparison is planned and read once, however many kinds there are."""
    of = diff.join(F.broadcast(_making(diff)), "kind", "left")  # as many rows as there are kinds
    is_ = lambda *s: F.col("status").isin(*s)
    phase = lambda name: F.lit(PHASES.index(name))
    one = lambda when, at, kind, obj, sql, destructive=None: F.when(when, F.struct(at.alias("phase"), kind.alias("kind"), obj.alias("object"), F.coalesce(destructive if destructive is not None else F.lit(False), F.lit(False)).alias("destructive"), sql.alias("sql")))
    name, old = F.col("name"), F.col("right_name")
    again, constraint = F.col("change") == "again", F.col("kind").isin(*CONSTRAINTS)
    rename = F.concat(F.lit("ALTER TABLE "), quoted(F.col("table")), F.lit(" RENAME CONSTRAINT "), quoted(old), F.lit(" TO "), quoted(name))
    by_hand = F.concat(F.lit("-- MANUAL: change "), F.lower("kind"), F.lit(" "), quoted(name), F.lit(" to "), F.coalesce("left_definition", F.lit("")))
    single = F.array(
        one(is_("onlyA") | (is_("changed") & F.col("change").isin("again", "replace")), F.col("made"), F.col("create_kind"), name, _filled(F.col("create"), name, F.col("left_definition"))),
        one(is_("onlyB") | (is_("changed") & again), F.col("gone"), F.col("drop_kind"), old, _filled(F.col("drop"), old, F.col("right_definition")), F.col("rows")),
        one(is_("changed") & ~F.col("manual") & F.col("alter").isNotNull(), F.col("made"), F.col("alter_kind"), name, _filled(F.col("alter"), name, F.col("left_definition"))),
        one(is_("renamed") & constraint, phase("renames"), F.lit("rename-constraint"), name, rename),
        one(F.col("manual"), phase("types"), F.lit("manual"), name, by_hand),
    )
    empty = F.array().cast("array<string>")
    grown = F.when(is_("changed") & (F.col("kind") == "TYPE") & ~F.col("manual"), enums.statements(quoted(name), enums.labels(F.col("right_definition")), enums.labels(F.col("left_definition")))).otherwise(empty)
    labels = F.transform(grown, lambda sql, i: F.struct(phase("types").alias("phase"), F.lit("alter-type").alias("kind"), F.concat(name, F.lit(" "), F.lpad(i.cast("string"), 4, "0")).alias("object"), F.lit(False).alias("destructive"), sql.alias("sql")))
    held, wanted, on = F.coalesce("right_grants", empty), F.coalesce("left_grants", empty), F.coalesce(name, old)
    part = lambda g, n: F.split_part(g, F.lit(":"), F.lit(n))
    given = lambda kind, some, word, to: F.transform(
        F.when(F.col("kind") == "PRIVILEGES", some).otherwise(empty), lambda g: F.struct(phase("privileges").alias("phase"), F.lit(kind).alias("kind"), on.alias("object"), F.lit(False).alias("destructive"), F.concat(F.lit(word), part(g, 2), F.lit(" ON "), quoted(on), F.lit(to), quoted(part(g, 1))).alias("sql"))
    )
    every = F.concat(F.filter(F.when(F.col("made").isNotNull(), single).otherwise(F.slice(single, 5, 1)), lambda x: x.isNotNull()), labels, given("grant", F.array_except(wanted, held), "GRANT ", " TO "), given("revoke", F.array_except(held, wanted), "REVOKE ", " FROM "))
    return of.select("table", "severity", F.explode(every).alias("s")).select("s.phase", F.lit(0).alias("depth"), "s.kind", "table", "s.object", "severity", "s.destructive", "s.sql")


def script(left: DataFrame, right: DataFrame, left_objects: DataFrame, right_objects: DataFrame, uses: DataFrame | None = None, rename_columns: bool = True) -> DataFrame:
    """One script for tables, columns and objects. uses (object, depends_on): what is used is made first and dropped last within a phase."""
    every = statements(left, right, None, rename_columns).unionByName(object_statements(materialize(compared(left_objects, right_objects), "compared-objects")))
    if uses is None:
        return every
    edges = uses.select(F.col("object").alias("node"), F.col("depends_on").alias("needs")).distinct()
    order = topological_depth(edges.select("node").unionByName(edges.select(F.col("needs").alias("node"))), edges)
    ranked = every.join(order.select(F.col("node").alias("_name"), F.col("depth").alias("_d")), F.coalesce("object", "table") == F.col("_name"), "left")
    return ranked.withColumn("depth", F.coalesce(F.when(F.col("kind").startswith("drop-"), -F.col("_d")).otherwise(F.col("_d")), F.lit(0))).select(*every.columns)


def shown_first(findings: DataFrame, severity: str, position: str) -> DataFrame:
    """Findings in the order in which they are shown: worst first (breaking, high, medium, low, info, safe), then as they came."""
    order = F.array(*map(F.lit, ("breaking", "high", "medium", "low", "info", "safe")))
    return findings.orderBy(F.array_position(order, F.col(severity)), position)


def candidates_shown(candidates: DataFrame) -> DataFrame:
    """Possible matches: best score first, then by name."""
    return candidates.orderBy(F.desc("score"), "left_id", "right_id")
