"""Objects of a schema with fields of their own, from extracts of a database catalog: triggers, partitions, policies, sequences, routines, index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import OWN_TABLES

#: Letters of a catalog and what they stand for.
STRATEGIES = {"r": "RANGE", "l": "LIST", "h": "HASH"}
ROUTINES = {"f": "function", "p": "procedure"}
BACKING, OWNING = ("p", "u", "x"), ("a", "i")


def _foreign_to_the_tool(table: str | Column) -> Column:
    name = F.col(table) if isinstance(table, str) else table
    return name.isNull() | ~name.isin(*OWN_TABLES)


def _spelled(letter: str, words: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.col(letter)]


def triggers(extract: DataFrame, functions: DataFrame) -> DataFrame:
    """table, name, definition, function, enabled; without internal ones and copies on partitions.

    extract: table, name, definition, function_id, state, internal, parent_id (0: none); functions: function_id, function."""
    own = extract.filter(~F.col("internal") & (F.col("parent_id") == 0) & _foreign_to_the_tool("table"))
    return own.join(functions, "function_id").select("table", "name", "definition", "function", (F.col("state") != "D").alias("enabled"))


def partitioning(classes: DataFrame, keys: DataFrame, edges: DataFrame) -> DataFrame:
    """table, strategy, key, partition_of, bounds, inherits (parents in their order; null for partitions and tables without parents).

    classes: table, kind, is_partition, bounds; keys: table, letter, key; edges: child, parent, position."""
    parents = edges.groupBy(F.col("child").alias("table")).agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "parent"))), lambda x: x["parent"]).alias("parents"))
    rows = classes.filter(F.col("kind").isin("r", "p") & _foreign_to_the_tool("table")).join(keys, "table", "left").join(parents, "table", "left")
    part = F.col("is_partition")
    return rows.select("table", _spelled("letter", STRATEGIES).alias("strategy"), F.when(F.col("kind") == "p", F.col("key")).alias("key"), F.when(part, F.get("parents", 0)).alias("partition_of"), F.when(part, F.col("bounds")).alias("bounds"), F.when(~part, F.col("parents")).alias("inherits"))


def policies(extract: DataFrame, row_security: DataFrame) -> DataFrame:
    """table, name, permissive, command, roles (sorted), using, with_check, enforced: whether the table's switch is on.

    extract: table, name, mode, command, roles, using, with_check; row_security: table, enabled, forced."""
    rows = extract.filter(_foreign_to_the_tool("table")).join(row_security.select("table", "enabled"), "table", "left")
    return rows.select("table", "name", (F.col("mode") == "PERMISSIVE").alias("permissive"), "command", F.array_sort("roles").alias("roles"), "using", "with_check", F.coalesce("enabled", F.lit(False)).alias("enforced"))


def sequences(extract: DataFrame, dependencies: DataFrame, attributes: DataFrame) -> DataFrame:
    """The sequences with owned_by_table and owned_by_column; those that belong to the tool's own tables are left out.

    extract: sequence, start, increment, least, most, cycles, cached, type; dependencies: sequence, table, number, kind; attributes: table, number, column."""
    owners = dependencies.filter(F.col("kind").isin(*OWNING)).join(attributes, ["table", "number"], "left").select("sequence", F.col("table").alias("owned_by_table"), F.col("column").alias("owned_by_column"))
    return extract.join(owners, "sequence", "left").filter(_foreign_to_the_tool("owned_by_table"))


def routines(extract: DataFrame, types: DataFrame, extension_members: DataFrame) -> DataFrame:
    """name, kind, arg_types (text, in order; empty without arguments), identity (name and types), language, definition; functions and procedures that are neither aggregates nor an extension's.

    extract: routine_id, name, letter, arguments (array of type ids), language, definition; types: type_id, type; extension_members: routine_id."""
    own = extract.filter(F.col("letter").isin(*ROUTINES)).join(extension_members, "routine_id", "left_anti")
    typed = own.select("routine_id", F.posexplode("arguments").alias("at", "type_id")).join(types, "type_id").groupBy("routine_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "type"))), lambda x: x["type"]), ", ").alias("arg_types"))
    rows = own.join(typed, "routine_id", "left").withColumn("arg_types", F.coalesce("arg_types", F.lit("")))
    return rows.select("name", _spelled("letter", ROUTINES).alias("kind"), "arg_types", F.concat("name", F.lit("("), "arg_types", F.lit(")")).alias("identity"), "language", "definition")


def index_statistics(extract: DataFrame, constraints: DataFrame, edges: DataFrame) -> DataFrame:
    """The indexes with scans (0 where none were counted), backs_constraint and is_partition_child.

    extract: table, index, scans, is_unique, valid, size; constraints: index, kind (a foreign key names an index, too, but doesn't stand on it); edges: child."""
    flag = lambda df, column, name: df.select(F.col(column).alias("index")).distinct().withColumn(name, F.lit(True))
    rows = extract.filter(_foreign_to_the_tool("table")).join(flag(constraints.filter(F.col("kind").isin(*BACKING)), "index", "backs_constraint"), "index", "left").join(flag(edges, "child", "is_partition_child"), "index", "left")
    return rows.fillna(0, ["scans"]).fillna(False, ["backs_constraint", "is_partition_child"])
