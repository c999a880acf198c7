"""Snapshots of schemas from Spark's own metadata or from extracts of a database catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNAPSHOT_FORMAT = 5
#: The flat columns table that operators.schema_diff compares.
COLUMNS = "table string, column string, ordinal int, type string, nullable boolean, default string, collation string, generated string, is_primary_key boolean, unique array<string>, foreign array<string>"
SYSTEM = r"^(pg_|information_schema$)"


#: Kinds of relations that are tables; tables in which this sort of tool keeps its own books.
TABLE_KINDS, OWN_TABLES = ("r", "p"), ("script_patch", "script_patch_reverted")


def base_tables(classes: DataFrame) -> DataFrame:
    """Names of ordinary and partitioned tables (from table, kind), without the tool's own, in order."""
    return classes.filter(F.col("kind").isin(*TABLE_KINDS) & ~F.col("table").isin(*OWN_TABLES)).select("table").distinct().orderBy("table")


def list_schemas(schemata: DataFrame, managed: list[str] | None = None) -> DataFrame:
    """Names of schemas that are neither the system's nor managed ones, in order."""
    return schemata.filter(~F.col("schema").rlike(SYSTEM) & ~F.col("schema").isin(managed or [])).select("schema").distinct().orderBy("schema")


def columns_of(spark: SparkSession, tables: dict[str, T.StructType]) -> DataFrame:
    """The columns table of Spark schemas: what a directory of Parquet files declares."""
    rows = [(t, f.name, i, f.dataType.simpleString(), f.nullable, None, None, None, False, [], []) for t, schema in tables.items() for i, f in enumerate(schema.fields, 1)]
    return spark.createDataFrame(rows, COLUMNS)


def constraints(extract: DataFrame, attributes: DataFrame) -> DataFrame:
    """Constraints with their column names in key order, from extracts (constraint, table, key: array of attribute numbers) and (table, number, column)."""
    one = extract.select("constraint", "table", "kind", F.posexplode_outer("key").alias("at", "number")).join(attributes, ["table", "number"], "left")
    return one.groupBy("constraint", "table", "kind").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("at", "column")))), lambda x: x["column"]).alias("columns"))


def indexes(extract: DataFrame, attributes: DataFrame, constraint_names: DataFrame) -> DataFrame:
    """Indexes that don't belong to a constraint, with their column names in key order."""
    own = extract.join(constraint_names.select(F.col("constraint").alias("index")), "index", "left_anti")
    keyed = own.select("*", F.posexplode_outer("key").alias("at", "number")).join(attributes, ["table", "number"], "left")
    return keyed.groupBy("index", "table", "is_unique").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("column").isNotNull(), F.struct("at", "column")))), lambda x: x["column"]).alias("columns"))


def view_sources(dependencies: DataFrame) -> DataFrame:
    """Each view with the sorted set of what it reads."""
    return dependencies.groupBy("view").agg(F.array_sort(F.collect_set("source")).alias("depends_on"))


def privileges(objects: DataFrame, schemas: DataFrame, defaults: DataFrame) -> DataFrame:
    """Union of three extracts with acl (array of grantee, privilege): one row a grant; objects without grants keep one row of nulls."""
    parts = [df.select(F.lit(kind).alias("kind"), "name", F.explode_outer("acl").alias("a")) for kind, df in (("object", objects), ("schema", schemas), ("default", defaults))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "name", "a.grantee", "a.privilege")


def nested(columns: DataFrame, schema: str) -> DataFrame:
    """One nested row for a snapshot: format, schema, tables (array of table and columns, in order). Snapshots are metadata, so one row holds one."""
    per_table = columns.groupBy("table").agg(F.sort_array(F.collect_list(F.struct("ordinal", *[c for c in columns.columns if c not in ("table", "ordinal")]))).alias("columns"))
    return per_table.agg(F.sort_array(F.collect_list(F.struct("table", "columns"))).alias("tables")).select(F.lit(SNAPSHOT_FORMAT).alias("format_version"), F.lit(schema).alias("schema"), "tables")


def flat(snapshot: DataFrame) -> DataFrame:
    """The columns table of a nested snapshot."""
    return snapshot.select(F.explode("tables").alias("t")).select("t.table", F.explode("t.columns").alias("c")).select("table", "c.*")


def format_gap(version):
    """current, older, newer or unstamped."""
    return F.when(version.isNull(), "unstamped").when(version < SNAPSHOT_FORMAT, "older").when(version > SNAPSHOT_FORMAT, "newer").otherwise("current")


def comparable(left, right):
    """Why a category isn't compared (null: it is): arrays that a side has not recorded."""
    return F.when(left.isNull() & right.isNull(), "neither side recorded it").when(left.isNull(), "the left side did not record it").when(right.isNull(), "the right side did not record it")


def version_tables(tables: DataFrame, names: list[str]) -> DataFrame:
    """Tables that may hold versions: known names in their order, then names like %version%."""
    known = F.array(*map(F.lit, names))
    at = F.array_position(known, F.lower("table"))
    return tables.filter((at > 0) | F.col("table").ilike("%version%")).orderBy(F.when(at > 0, at).otherwise(len(names) + 1), "table")


def version_rows(rows: DataFrame, most: int = 5000) -> DataFrame:
    """The newest version rows, at most `most`, and no row twice, newest first."""
    newest = [F.desc("applied_at"), F.desc("version")]
    return rows.orderBy(*newest).limit(most).select("version", "applied_at").distinct().orderBy(*newest)


def with_statistics(tables: DataFrame, io: DataFrame, analyzed: DataFrame) -> DataFrame:
    """Table counters with I/O counters where there are any, and whether statistics exist."""
    flags = analyzed.select("table").distinct().withColumn("has_stats", F.lit(True))
    return tables.join(io, "table", "left").join(flags, "table", "left").fillna(False, subset=["has_stats"])


def explained(df: DataFrame) -> str:
    """The formatted plan of one of our own queries."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


#: Object kinds of a snapshot besides tables and columns; a null array of one means that it was not recorded.
OBJECT_KINDS = ("constraint", "index", "trigger", "policy", "row_security", "view", "sequence", "type", "collation", "routine", "extension", "privilege")


def objects_of(snapshot: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(kind, key, table, definition) of a snapshot's object arrays; kinds: object kind -> array column of struct<key,table,definition>. Arrays that were not recorded give no rows; see recorded()."""
    out = None
    for kind, column in kinds.items():
        part = snapshot.select(F.lit(kind).alias("kind"), F.explode(column).alias("o")).select("kind", "o.key", "o.table", "o.definition")
        out = part if out is None else out.unionByName(part)
    return out


def recorded(snapshot: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """One row a kind: whether the snapshot recorded it."""
    return snapshot.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).isNotNull().alias("recorded")) for k, c in kinds.items()])).alias("r")).select("r.*")


def snapshot(schema: str, columns: DataFrame, objects: DataFrame, kinds: dict[str, str], not_recorded: tuple[str, ...] = ()) -> DataFrame:
    """One nested row of everything: format, schema, tables with their columns, and an array (key, table, definition) for each
    kind of object; the arrays of kinds that weren't recorded are null. The tool's own tables, and what stands on them, are left out.

    columns: the flat columns table. objects: kind, key, table, definition. kinds: object kind -> array column. Snapshots are metadata: one row holds one."""
    mine = lambda df: df.filter(F.col("table").isNull() | ~F.col("table").isin(*OWN_TABLES))
    held = mine(objects)
    arrays = held.agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("key", "table", "definition")))).alias(c) for k, c in kinds.items()])
    missing = {kinds[k]: F.lit(None).cast("array<struct<key:string,table:string,definition:string>>") for k in not_recorded}
    return nested(mine(columns), schema).join(arrays.withColumns(missing) if missing else arrays)


def inheritance(edges: DataFrame) -> DataFrame:
    """Each child with its parents in their order (from child, parent, position)."""
    return edges.groupBy("child").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "parent"))), lambda x: x["parent"]).alias("inherits"))


def enum_labels(labels: DataFrame) -> DataFrame:
    """Each enum type with its labels in their order, as JSON and as text (from type, label, position)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", "label"))), lambda x: x["label"])
    return labels.groupBy("type").agg(ordered.alias("labels")).withColumns({"json": F.to_json("labels"), "text": F.array_join("labels", ", ")})


def joined_columns(classes: DataFrame, attributes: DataFrame, types: DataFrame, defaults: DataFrame, collations: DataFrame) -> DataFrame:
    """Columns from catalog extracts: classes (table), attributes (table, number, column, type_id, nullable, collation_id), types (type_id, type), defaults (table, number, default), collations (collation_id, collation)."""
    return classes.join(attributes, "table").join(types, "type_id").join(defaults, ["table", "number"], "left").join(collations, "collation_id", "left").select("table", "column", F.col("number").alias("ordinal"), "type", "nullable", "default", "collation")
