"""Schema snapshots compared: names, renames, columns, objects, severity.

Flat tables stand for snapshots. columns: table, column, ordinal, type, nullable, default, collation,
generated, is_primary_key, unique (array, null: not recorded), foreign (array, null: not recorded).
Left is the wanted state, right the one to be changed: onlyA is to be created, onlyB to be dropped.
Null arrays mean "not recorded" and are never compared; empty ones mean "recorded, none".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import narrows, normalized, rename_allowed, round_score, string_similarity, type_score
from ..scratch import materialize
from .matching import COLUMN_PAIRS, TABLE_PAIRS, match_renames, within_budget

#: Weights and thresholds of the scores.
COLUMN_ACCEPT, COLUMN_SUGGEST, TABLE_ACCEPT, TABLE_SUGGEST = 50, 40, 70, 55


def with_position(columns: DataFrame) -> DataFrame:
    """position: the ordinal relative to the number of the table's columns."""
    return columns.withColumn("position", F.col("ordinal") / F.count("*").over(Window.partitionBy("table")))


def _same(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), 1.0).otherwise(0.0)


def column_score(l: str, r: str) -> Column:
    """0 to 60: name 15, type 20, constraints 15 (key, unique, foreign), order 10."""
    c = lambda s, n: F.col(f"{s}.{n}")
    has = lambda s, n: F.coalesce(F.size(c(s, n)), F.lit(0)) > 0
    constraints = (_same(c(l, "is_primary_key"), c(r, "is_primary_key")) + _same(has(l, "unique"), has(r, "unique")) + _same(has(l, "foreign"), has(r, "foreign"))) * 5
    order = F.greatest(F.lit(0.0), 1 - 2 * F.abs(c(l, "position") - c(r, "position"))) * 10
    name = string_similarity(normalized(c(l, "column")), normalized(c(r, "column"))) * 15
    return round_score(name + type_score(c(l, "type"), c(r, "type")) + constraints + order)


def table_scores(left: DataFrame, right: DataFrame, tables_left: DataFrame, tables_right: DataFrame) -> DataFrame:
    """(left_id, right_id, score, allowed) of all pairs of the given tables (table), 0 to 100: name 20, constraints
    15, columns 55 (mean of each column's best match, both ways), relationships 10; without foreign keys on
    either side the rest is scaled up to 100. Pairs are within the budget before this is called."""
    a = with_position(left).join(tables_left.select("table"), "table").select(F.col("table").alias("lt"), F.struct("*").alias("l"))
    b = with_position(right).join(tables_right.select("table"), "table").select(F.col("table").alias("rt"), F.struct("*").alias("r"))
    pairs = a.join(F.broadcast(b)).withColumn("s", column_score("l", "r") / 60)
    best_left = pairs.groupBy("lt", "rt", "l.column").agg(F.max("s").alias("m")).groupBy("lt", "rt").agg(F.avg("m").alias("from_left"))
    best_right = pairs.groupBy("lt", "rt", "r.column").agg(F.max("s").alias("m")).groupBy("lt", "rt").agg(F.avg("m").alias("from_right"))
    traits = lambda df, t, s: df.groupBy(F.col(f"{s}.table").alias(t)).agg(F.count_if(F.col(f"{s}.is_primary_key")).alias(f"{s}_keys"), F.count_if(F.coalesce(F.size(f"{s}.unique"), F.lit(0)) > 0).alias(f"{s}_unique"), F.count_if(F.coalesce(F.size(f"{s}.foreign"), F.lit(0)) > 0).alias(f"{s}_foreign"))
    both = best_left.join(best_right, ["lt", "rt"]).join(traits(a, "lt", "l"), "lt").join(traits(b, "rt", "r"), "rt")
    ratio = lambda x, y: F.when(F.greatest(x, y) == 0, 1.0).otherwise(F.least(x, y) / F.greatest(x, y))
    name = string_similarity(normalized(F.col("lt")), normalized(F.col("rt"))) * 20
    constraints = (ratio(F.col("l_keys"), F.col("r_keys")) + ratio(F.col("l_unique"), F.col("r_unique"))) / 2 * 15
    columns = (F.col("from_left") + F.col("from_right")) / 2 * 55
    relations = ratio(F.col("l_foreign"), F.col("r_foreign")) * 10
    none = (F.col("l_foreign") == 0) & (F.col("r_foreign") == 0)
    score = F.when(none, (name + constraints + columns) * 100 / 90).otherwise(name + constraints + columns + relations)
    return both.select(F.col("lt").alias("left_id"), F.col("rt").alias("right_id"), round_score(score).alias("score"), rename_allowed(F.col("lt"), F.col("rt")).alias("allowed"))


def matched_tables(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(status, candidates): tables as matched, renamed, onlyA or onlyB, and possible matches. Names match exactly
    first; renames are sought among what is left, within the pair budget."""
    a, b = left.select("table").distinct(), right.select("table").distinct()
    both = a.join(b, "table").select(F.col("table").alias("left_table"), F.col("table").alias("right_table"), F.lit("matched").alias("status"))
    only_a, only_b = a.join(b, "table", "left_anti"), b.join(a, "table", "left_anti")
    spark = left.sparkSession
    found = candidates = spark.createDataFrame([], "left_id string, right_id string, score double")
    if within_budget(only_a, only_b, TABLE_PAIRS) and within_budget(left.join(only_a, "table"), right.join(only_b, "table"), COLUMN_PAIRS):
        found, candidates = match_renames(table_scores(left, right, only_a, only_b), TABLE_ACCEPT, TABLE_SUGGEST)
    renamed = found.select(F.col("left_id").alias("left_table"), F.col("right_id").alias("right_table"), F.lit("renamed").alias("status"))
    rest_a = only_a.join(found.select(F.col("left_id").alias("table")), "table", "left_anti").select(F.col("table").alias("left_table"), F.lit(None).cast("string").alias("right_table"), F.lit("onlyA").alias("status"))
    rest_b = only_b.join(found.select(F.col("right_id").alias("table")), "table", "left_anti").select(F.lit(None).cast("string").alias("left_table"), F.col("table").alias("right_table"), F.lit("onlyB").alias("status"))
    return both.unionByName(renamed).unionByName(rest_a).unionByName(rest_b), candidates


def column_changes(left: DataFrame, right: DataFrame) -> DataFrame:
    """table, column, status (matched, onlyA, onlyB), changes: array of (kind, before, after, severity), of matched tables' columns."""
    a = left.select("table", "column", F.struct("*").alias("l"))
    b = right.select("table", "column", F.struct("*").alias("r"))
    both = a.join(b, ["table", "column"], "full_outer")
    l, r = (lambda n: F.col(f"l.{n}")), (lambda n: F.col(f"r.{n}"))
    text = lambda x: x.cast("string")
    change = lambda kind, before, after, severity, condition: F.when(condition, F.struct(F.lit(kind).alias("kind"), text(before).alias("before"), text(after).alias("after"), severity.alias("severity")))
    recorded = lambda n: l(n).isNotNull() & r(n).isNotNull()
    listed = lambda x: F.array_join(F.array_sort(x), ",")
    base = F.lower(F.regexp_replace(l("type"), r"\s*\([^)]*\)", "")) != F.lower(F.regexp_replace(r("type"), r"\s*\([^)]*\)", ""))
    # left is wanted: the change goes from right to left
    narrower = narrows(r("type"), l("type"))
    changes = F.array(
        change("type", r("type"), l("type"), F.lit("high"), base),
        change("size", r("type"), l("type"), F.when(narrower, "high").otherwise("low"), ~base & (normalized(l("type")) != normalized(r("type")))),
        change("nullability", r("nullable"), l("nullable"), F.when(l("nullable"), "low").otherwise("high"), l("nullable") != r("nullable")),
        change("default", r("default"), l("default"), F.lit("low"), ~l("default").eqNullSafe(r("default"))),
        change("collation", r("collation"), l("collation"), F.lit("medium"), ~l("collation").eqNullSafe(r("collation"))),
        change("generated", r("generated"), l("generated"), F.lit("medium"), ~l("generated").eqNullSafe(r("generated"))),
        change("primaryKey", r("is_primary_key"), l("is_primary_key"), F.lit("high"), l("is_primary_key") != r("is_primary_key")),
        change("unique", listed(r("unique")), listed(l("unique")), F.lit("medium"), recorded("unique") & ((F.size(l("unique")) > 0) != (F.size(r("unique")) > 0))),
        change("foreignKey", listed(r("foreign")), listed(l("foreign")), F.lit("medium"), recorded("foreign") & ((F.size(l("foreign")) > 0) != (F.size(r("foreign")) > 0))),
    )
    for kind, severity in (("computed", "high"), ("sequenceOptions", "low")):  # only where both sides recorded them
        if kind in left.columns and kind in right.columns:
            changes = F.concat(changes, F.array(change(kind, r(kind), l(kind), F.lit(severity), l(kind).isNotNull() & r(kind).isNotNull() & (l(kind) != r(kind)))))
    status = F.when(r("column").isNull(), "onlyA").when(l("column").isNull(), "onlyB").otherwise("matched")
    kept = F.when(status == "matched", F.filter(changes, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<kind:string,before:string,after:string,severity:string>>"))
    return both.select("table", "column", status.alias("status"), kept.alias("changes"))


def added_column_severity(nullable: Column, default: Column) -> Column:
    """A wanted column that rows can't get by themselves is high."""
    return F.when(~nullable & default.isNull(), "high").otherwise("low")


def foreign_signature(schema: Column, own: Column, table: Column, columns: Column, referenced: Column) -> Column:
    """Text of a foreign key's meaning; a reference into the own schema is the same in any schema."""
    place = F.when(schema == own, F.lit("\u0000own\u0000")).otherwise(schema)
    return F.concat_ws("->", F.array_join(columns, ","), place, table, F.array_join(referenced, ","))


def renamed_columns(left: DataFrame, right: DataFrame, differing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, candidates) as (table, column, renamed_from, score): columns that only one side of a table has, matched by the same rule as tables, within a table."""
    a, b = with_position(left), with_position(right)
    pick = lambda df, s: df.join(differing.filter(F.col("status") == s).select("table", "column"), ["table", "column"], "left_semi")
    l, r = pick(a, "onlyA").select("table", F.struct("*").alias("l")), pick(b, "onlyB").select("table", F.struct("*").alias("r"))
    none = left.sparkSession.createDataFrame([], "table string, column string, renamed_from string, score double")
    sizes = l.groupBy("table").agg(F.count("*").alias("n")).join(r.groupBy("table").agg(F.count("*").alias("m")), "table").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("pairs"))
    if not 0 < sizes.first().pairs <= COLUMN_PAIRS:
        return none, none
    name = lambda s: F.to_json(F.array("table", f"{s}.column"))
    pairs = l.join(r, "table").select(name("l").alias("left_id"), name("r").alias("right_id"), column_score("l", "r").alias("score"), rename_allowed(F.col("l.column"), F.col("r.column")).alias("allowed"))
    item = lambda c, i: F.from_json(c, "array<string>")[i]
    back = lambda df: df.select(item("left_id", 0).alias("table"), item("left_id", 1).alias("column"), item("right_id", 1).alias("renamed_from"), "score")
    found, candidates = match_renames(pairs, COLUMN_ACCEPT, COLUMN_SUGGEST)
    return back(found), back(candidates)


def compare(left: DataFrame, right: DataFrame, rename_columns: bool = True) -> dict[str, DataFrame]:
    """tables, candidates, columns (changes of matched and renamed tables; renamed_from where a column was renamed) and summary (one row)."""
    status, candidates = matched_tables(left, right)
    status = materialize(status, "compared-tables")  # one row a table
    pairs = status.filter("right_table is not null and left_table is not null")
    renamed = right.join((pairs.select(F.col("right_table").alias("table"), "left_table")), "table").drop("table").withColumnRenamed("left_table", "table")
    kept = left.join((pairs.select(F.col("left_table").alias("table"))), "table")
    renamed = renamed.select(*kept.columns)
    columns = column_changes(kept, renamed).withColumn("renamed_from", F.lit(None).cast("string"))
    if rename_columns:
        moved, _ = renamed_columns(kept, renamed, materialize(columns.filter("status <> 'matched'"), "compared-one-sided"))
        old = renamed.join(moved.select("table", F.col("renamed_from").alias("column"), F.col("column").alias("_new")), ["table", "column"], "left")
        again = column_changes(kept, old.withColumn("column", F.coalesce("_new", "column")).select(*kept.columns))
        columns = again.join(moved.select("table", "column", "renamed_from"), ["table", "column"], "left").withColumn("status", F.when(F.col("renamed_from").isNotNull(), "renamed").otherwise(F.col("status")))
    differing = columns.filter((F.col("status") != "matched") | (F.size("changes") > 0))
    n = lambda s: F.count_if(F.col("status") == s)
    summary = status.agg((n("matched") + n("renamed")).alias("matched"), n("renamed").alias("renamed"), n("onlyA").alias("only_a"), n("onlyB").alias("only_b")).join(
        F.broadcast(differing.agg(F.countDistinct("table").alias("tables_changed"), F.count("*").alias("columns_changed")))
    )
    return {"tables": status, "candidates": candidates, "columns": differing, "summary": summary}
