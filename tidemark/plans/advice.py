"""Advice on schemas and statistics, as joins and filters over flat tables.

tables: table, has_primary_key, partitioned, rows. columns: table, column, type, default, in_primary_key.
indexes: table, index, columns (array), is_unique, valid, partitioned, size, scans, stats_days, supports
(constraint kind or null). foreign_keys: table, name, columns (array). table_stats: table, rows, seq_scans,
seq_rows, index_scans, live, dead, last_analyzed, hits, reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds.
MANY_INDEXES, UNUSED_DAYS, PARTITION_ROWS, LARGE_ROWS = 6, 30, 10_000_000, 10_000


def _advice(df: DataFrame, name: str, severity: str, subject: str) -> DataFrame:
    return df.select(F.lit(name).alias("advice"), F.lit(severity).alias("severity"), "table", F.col(subject).alias("subject"))


def structural(tables: DataFrame, columns: DataFrame, indexes: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """advice, severity, table, subject."""
    valid = indexes.filter("valid")
    # every beginning of an index, in whatever order, covers a foreign key of the same columns
    upto = F.when(F.size("columns") > 0, F.sequence(F.lit(1), F.size("columns"))).otherwise(F.array(F.lit(0)))
    covering = valid.select("table", F.explode(F.transform(upto, lambda n: F.array_sort(F.slice("columns", 1, n)))).alias("_covered"))
    covered = foreign_keys.withColumn("_covered", F.array_sort("columns")).join(covering, ["table", "_covered"], "left_anti")
    droppable = valid.filter(F.col("supports").isNull())
    # of indexes with equal columns all but the first repeat it: a group, however many indexes a table has
    first = valid.groupBy("table", "columns", "is_unique").agg(F.min("index").alias("_first"))
    same = droppable.join(first, ["table", "columns", "is_unique"]).filter(F.col("index") > F.col("_first")).drop("_first")
    # the proper beginnings of every index, with two of the names that have them: one at least is another's
    sizes = F.when(F.size("columns") > 1, F.sequence(F.lit(1), F.size("columns") - 1))
    begun = valid.select("table", "index", F.explode(F.transform(sizes, lambda n: F.slice("columns", 1, n))).alias("columns")).groupBy("table", "columns").agg(F.min("index").alias("_first"), F.max("index").alias("_last"))
    prefix = droppable.filter(~F.col("is_unique")).join(begun, ["table", "columns"]).filter((F.col("index") != F.col("_first")) | (F.col("index") != F.col("_last"))).drop("_first", "_last")
    one_column = indexes.filter(F.size("columns") == 1).withColumn("column", F.col("columns")[0]).join(columns.select("table", "column", "type"), ["table", "column"])
    many = indexes.groupBy("table").agg(F.count("*").alias("n")).filter(F.col("n") > MANY_INDEXES)
    kind = F.lower("type")
    parts = [
        _advice(tables.filter("not has_primary_key"), "no-primary-key", "high", "table"),
        _advice(covered, "foreign-key-not-indexed", "high", "name"),
        _advice(same.distinct(), "duplicate-index", "medium", "index"),
        _advice(prefix.distinct(), "redundant-index", "low", "index"),
        _advice(one_column.filter(kind == "boolean"), "boolean-index", "low", "index"),
        _advice(many, "many-indexes", "medium", "table"),
        _advice(columns.filter(kind.startswith("timestamp") & ~kind.contains("with time zone")), "timestamp-without-timezone", "medium", "column"),
        _advice(columns.filter(kind.rlike(r"^(char|character|bpchar)(\(|$)")), "blank-padded-char", "low", "column"),
        _advice(columns.filter(F.coalesce(F.col("default").startswith("nextval("), F.lit(False))), "serial-not-identity", "low", "column"),
        _advice(columns.filter(F.col("in_primary_key") & (kind == "text")), "text-primary-key", "low", "column"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def statistical(table_stats: DataFrame, indexes: DataFrame) -> DataFrame:
    """advice, severity, table, subject, from counters."""
    t = table_stats
    parts = [
        _advice(t.filter((F.col("live") >= LARGE_ROWS) & (F.col("seq_scans") > F.coalesce("index_scans", F.lit(0))) & (F.try_divide("seq_rows", "seq_scans") >= LARGE_ROWS)), "sequential-scan-heavy", "high", "table"),
        _advice(t.filter((F.col("dead") >= LARGE_ROWS) & (F.try_divide(F.col("dead"), F.col("live") + F.col("dead")) >= 0.2)), "dead-tuples", "medium", "table"),
        _advice(t.filter((F.col("live") > 0) & F.col("last_analyzed").isNull()), "never-analyzed", "medium", "table"),
        _advice(t.filter((F.col("hits") + F.col("reads") >= LARGE_ROWS) & (F.try_divide(F.col("hits"), F.col("hits") + F.col("reads")) < 0.9)), "low-cache-hit", "medium", "table"),
        _advice(indexes.filter(F.col("valid") & (F.col("scans") == 0) & (F.col("stats_days") >= UNUSED_DAYS) & ~F.col("is_unique") & F.col("supports").isNull()), "unused-index", "medium", "index"),
        _advice(indexes.filter(~F.col("valid") & ~F.col("partitioned")), "invalid-index", "high", "index"),
        _advice(indexes.filter(~F.col("valid") & F.col("partitioned")), "unfinished-partitioned-index", "medium", "index"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def partitioning(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Large unpartitioned tables, with a date or time column to partition by if they have one."""
    dated = columns.filter(F.lower("type").rlike("^(date|timestamp)")).groupBy("table").agg(F.min("column").alias("by"))
    return tables.filter((F.col("rows") >= PARTITION_ROWS) & ~F.col("partitioned")).join(dated, "table", "left").select(F.when(F.col("by").isNull(), "partitioning-candidate").otherwise("partition-by-date").alias("advice"), F.lit("medium").alias("severity"), "table", F.coalesce("by", "table").alias("subject"))


def without_repeats(advice: DataFrame) -> DataFrame:
    """One piece of advice for each index that several rules would drop: duplicate, then redundant, then unused."""
    drops = F.array(*map(F.lit, ("duplicate-index", "redundant-index", "boolean-index", "unused-index")))
    rank = F.array_position(drops, F.col("advice"))
    w = Window.partitionBy("table", "subject").orderBy("rank")
    dropping = advice.filter(rank > 0).withColumn("rank", rank).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rank", "rn")
    return advice.filter(rank == 0).unionByName(dropping)


def with_wanted_indexes(advice: DataFrame, patterns: DataFrame, foreign_keys: DataFrame) -> DataFrame:
    """Foreign-key advice with attached: whether the composite advice for the same leading column serves it."""
    lead = patterns.select("table", F.col("equality")[0].alias("first")).distinct()
    named = foreign_keys.select("table", F.col("name").alias("subject"), F.col("columns")[0].alias("first")).join(lead, ["table", "first"], "left_semi").select("table", "subject", F.lit(True).alias("attached"))
    return advice.join(named, ["table", "subject"], "left").withColumn("attached", F.coalesce("attached", F.lit(False)) & (F.col("advice") == "foreign-key-not-indexed"))
