"""Aggregates over history, usage and change tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles


def daily_trend(df: DataFrame, ts: str, value: str, measured: Column, score: str) -> DataFrame:
    """By UTC day: runs, measured runs, exact median and maximum of the measured values, median score."""
    only, day = F.when(measured, F.col(value)), F.date_trunc("day", ts).cast("date")
    counts = F.count("*").alias("runs"), F.count(only).alias("measured_runs"), F.max(only).alias("max_value")
    out = percentiles(df, day, "day", {"median_value": (only, 0.5), "median_score": (F.col(score), 0.5)}, *counts)
    return out.select("day", "runs", "measured_runs", "median_value", "max_value", "median_score")


def feature_rollup(df: DataFrame, feature: str, counts: dict[str, Column], sums: dict[str, str], value: str) -> DataFrame:
    """By feature: filtered counts, sums, exact median and 95th percentile."""
    counted = F.count("*").alias("calls"), *[F.count_if(c).alias(n) for n, c in counts.items()], *[F.sum(c).alias(n) for n, c in sums.items()]
    return percentiles(df, F.col(feature), feature, {"p50": (F.col(value), 0.5), "p95": (F.col(value), 0.95)}, *counted)


def padded(rollup: DataFrame, dimension: DataFrame, key: str, zeros: Sequence[str]) -> DataFrame:
    """Every member of a (small) dimension, with zeros where the roll-up has none."""
    return dimension.select(key).join(rollup, key, "left").fillna(0, subset=list(zeros))


def rate_window(df: DataFrame, actor: str, ts: str, as_of: str) -> DataFrame:
    """Calls of each actor on as_of's UTC day and in the minute before it, in one pass."""
    now = F.lit(as_of).cast(df.schema[ts].dataType)
    before = F.col(ts) <= now
    return df.filter(F.col(ts) >= F.least(F.date_trunc("day", now).cast(df.schema[ts].dataType), now - F.expr("INTERVAL 1 MINUTE"))).groupBy(actor).agg(
        F.count_if(before & (F.date_trunc("day", ts) == F.date_trunc("day", now))).alias("today"), F.count_if(before & (F.col(ts) > now - F.expr("INTERVAL 1 MINUTE"))).alias("last_minute")
    ).filter("today > 0 or last_minute > 0")


def category_matrix(changes: DataFrame, totals: DataFrame, category: str = "category", kind: str = "change") -> DataFrame:
    """By category: added, dropped, changed, and in_sync = max(0, total - added - changed)."""
    n = lambda v: F.count_if(F.col(kind) == v).alias(v)
    counted = changes.groupBy(category).agg(n("added"), n("dropped"), n("changed"))
    return totals.join(counted, category, "left").fillna(0, subset=["added", "dropped", "changed"]).withColumn("in_sync", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("added") - F.col("changed"))).drop("total")


SEVERITIES = ("info", "low", "medium", "high")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def worst_by_key(items: DataFrame, key: str, severity: str) -> DataFrame:
    """One row a key with its worst severity."""
    return items.groupBy(key).agg(F.max(severity_rank(F.col(severity))).alias("rank")).select(key, F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("rank")).alias(severity))


def severity_counts(items: DataFrame, severity: str) -> DataFrame:
    return items.agg(*[F.count_if(F.col(severity) == s).alias(s) for s in SEVERITIES])


def run_fingerprint(key: Column, severity: Column) -> Column:
    """A fingerprint of a run's items, whatever their order, as an aggregate: sums of the parts of their digests, so an item found twice counts twice and no list is built."""
    digest = F.md5(F.concat_ws("\u0001", F.coalesce(key, F.lit("")), F.coalesce(severity, F.lit(""))).cast("binary"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string")
    return F.substring(F.md5(F.concat_ws(":", F.count("*").cast("string"), part(1), part(16)).cast("binary")), 1, 16)


def search_patterns(queries: DataFrame, searches: str = "searched_columns") -> DataFrame:
    """Explode searches; by table, equality columns and range column: distinct fingerprints and runs, in order of use."""
    rows = queries.select("fingerprint", F.explode(searches).alias("s")).select("fingerprint", "s.table", F.array_sort("s.equality").alias("equality"), "s.range")
    return rows.groupBy("table", "equality", "range").agg(F.countDistinct("fingerprint").alias("queries"), F.count("*").alias("runs")).orderBy(F.desc("queries"), F.desc("runs"), "table", "equality", F.asc_nulls_first("range"))


def index_serves(index: Column, equality: Column, range_column: Column) -> Column:
    """Whether an index's leading columns are the equality columns in any order, then the range column if there is one."""
    n = F.size(equality)
    leading = F.array_sort(F.slice(index, 1, F.greatest(n, F.lit(1)))) == F.array_sort(equality)
    return F.when(n == 0, F.lit(True)).otherwise(leading) & F.when(range_column.isNull(), F.lit(True)).otherwise(F.coalesce(F.try_element_at(index, n + 1) == range_column, F.lit(False)))


def composite_advice(patterns: DataFrame, indexes: DataFrame, most: int = 5) -> DataFrame:
    """Patterns of at least two queries or three runs that no index of the table serves; the first `most`."""
    wanted = patterns.filter((F.col("queries") >= 2) | (F.col("runs") >= 3))
    served = wanted.alias("p").join(indexes.alias("i"), (F.col("p.table") == F.col("i.table")) & index_serves(F.col("i.columns"), F.col("p.equality"), F.col("p.range")), "left_anti")
    return served.orderBy(F.desc("queries"), F.desc("runs"), "table", "equality", F.asc_nulls_first("range")).limit(most)


def loudest(level: str) -> Column:
    """The loudest change level of a group: unknown < patch < additive < breaking."""
    from ..functions.versions import LEVELS, level_rank

    return F.element_at(F.array(*map(F.lit, LEVELS)), F.max(level_rank(F.col(level))) + 1)


def permissions(df: DataFrame, role: str, permission: str) -> DataFrame:
    """Each role with its permissions as a sorted list, empty without any."""
    return df.groupBy(role).agg(F.sort_array(F.collect_set(F.when(F.col(permission).isNotNull(), F.col(permission)))).alias("permissions"))


def snapshot_counts(snapshot: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Sizes of arrays of a snapshot; arrays that were not recorded count 0."""
    return snapshot.select(*[c for c in snapshot.columns if c not in arrays], *[F.coalesce(F.array_size(c), F.lit(0)).alias(c) for c in arrays])


def schema_sizes(stats: DataFrame) -> DataFrame:
    """Sum of sizes and rows; null if any table that isn't empty was never analysed."""
    unknown = F.bool_or(F.col("last_analyzed").isNull() & (F.col("total_bytes") > 0))
    return stats.agg(F.sum("total_bytes").alias("total_bytes"), F.sum("index_bytes").alias("index_bytes"), F.when(unknown, F.lit(None)).otherwise(F.sum("rows")).alias("estimated_rows"))


def table_sizes(stats: DataFrame, names: Sequence[str], most: int = 60) -> DataFrame:
    """Sizes of the named tables; rows null where never analysed and not empty."""
    rows = F.when(F.col("last_analyzed").isNull() & (F.col("total_bytes") > 0), F.lit(None)).otherwise(F.col("rows"))
    return stats.filter(F.col("table").isin(list(names)[:most])).select("table", "total_bytes", rows.alias("rows"))
