"""Activity feeds, schedules, thresholds, health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_ratio


def feed(df: DataFrame, haystack: Sequence[str], order: Sequence[Column], text: str | None = None, most: int = 200, **equal: object) -> DataFrame:
    """Rows that equal what is given (None: any) and hold the text in one of the haystack columns, case folded; newest first."""
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    if text:
        df = df.filter(F.contains(F.lower(F.concat_ws(" ", *haystack)), F.lit(text.strip().lower())))
    return df.orderBy(*order).limit(most)


def due(df: DataFrame, last: str, interval_minutes: str, as_of: str, key: str, most: int = 6, early_seconds: int = 5) -> DataFrame:
    """Scheduled rows whose check is due: never checked first, then the oldest, ties by key."""
    now = F.lit(as_of).cast(df.schema[last].dataType)
    ready = F.col(last).isNull() | (now + F.make_dt_interval(secs=F.lit(early_seconds)) >= F.col(last) + F.make_dt_interval(mins=F.col(interval_minutes)))
    return df.filter((F.col(interval_minutes) > 0) & ready).orderBy(F.asc_nulls_first(last), key).limit(most)


def cadence(minutes: Column, allowed: Sequence[int]) -> Column:
    """The nearest allowed minutes, ties to the larger; null for nothing, zero, negative or not a number."""
    nearest = F.array_min(F.transform(F.array(*map(F.lit, allowed)), lambda a: F.struct(F.abs(a - minutes).alias("far"), (-a).alias("least"), a.alias("value"))))
    return F.when((minutes > 0) & ~F.isnan(minutes.cast("double")), nearest["value"])


def breaches(df: DataFrame, settings: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Values strictly beyond their enabled limit, by overshoot; settings: metric, direction (above, below), limit, enabled."""
    joined = df.join(settings, metric)  # one row a metric: Spark broadcasts it if it is small
    v, limit = F.col(value), F.col("limit")
    beyond = F.when(F.col("direction") == "above", v > limit).otherwise(v < limit)
    overshoot = F.when(F.col("direction") == "above", F.try_divide(v, limit)).otherwise(F.try_divide(limit, v))
    return joined.filter(F.col("enabled") & limit.isNotNull() & ~F.isnan(limit) & beyond).withColumn("overshoot", overshoot)


def level(value: Column, watch: float, bad: float, higher_is_better: bool) -> Column:
    """good, watch or bad; unknown without a value."""
    if higher_is_better:
        return F.when(value.isNull(), "unknown").when(value < bad, "bad").when(value < watch, "watch").otherwise("good")
    return F.when(value.isNull(), "unknown").when(value >= bad, "bad").when(value >= watch, "watch").otherwise("good")


def health(counters: DataFrame) -> DataFrame:
    """Ratios of a row of database counters and their levels."""
    c = F.col
    out = counters.withColumns({"cache_hit": safe_ratio(c("blks_hit"), c("blks_read")), "rollback": safe_ratio(c("xact_rollback"), c("xact_commit")), "connections": F.try_divide(c("numbackends").cast("double"), c("max_connections").cast("double"))})
    some = lambda x: F.when(c(x).isNull(), "unknown").when(c(x) > 0, "watch").otherwise("good")
    return out.withColumns({"cache_level": level(c("cache_hit"), 0.99, 0.9, True), "rollback_level": level(c("rollback"), 0.05, 0.2, False), "connections_level": level(c("connections"), 0.7, 0.9, False), "deadlock_level": some("deadlocks"), "temp_level": some("temp_files")})


def session_kind(df: DataFrame, long_seconds: int = 60) -> DataFrame:
    """Sessions with kind and seconds: blocked (waits for a lock), idle-in-transaction, long-running, running; idle ones use the age of their state."""
    idle = F.col("state").startswith("idle in transaction")
    seconds = F.when(idle, F.col("state_seconds")).otherwise(F.col("query_seconds"))
    kind = F.when(F.col("wait_event_type") == "Lock", "blocked").when(idle, "idle-in-transaction").when(seconds >= long_seconds, "long-running").otherwise("running")
    return df.withColumn("seconds", seconds).withColumn("kind", kind)


KINDS = ("blocked", "idle-in-transaction", "long-running", "running")


def sessions_in_order(df: DataFrame, most: int = 200) -> DataFrame:
    """By kind, then the longest first."""
    return df.orderBy(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.desc_nulls_last("seconds"), "pid").limit(most)


def session_summary(df: DataFrame) -> DataFrame:
    n = lambda k: F.count_if(F.col("kind") == k)
    return df.agg(F.count("*").alias("total"), n("blocked").alias("blocked"), n("idle-in-transaction").alias("idle"), n("long-running").alias("long"), F.coalesce(F.bool_or(F.col("query").isNull()), F.lit(False)).alias("any_hidden"))


def targeting(header: Column, hosted: Column) -> Column:
    """Whom a script applies to: header and hosted are arrays of names (null: not given)."""
    tidy = lambda a: F.array_distinct(F.transform(a, lambda x: F.lower(F.trim(x))))
    return (
        F.when(header.isNull() | (F.size(header) == 0), "everyone")
        .when(hosted.isNull(), "unknown")
        .when(F.size(hosted) == 0, "none-hosted")
        .when(F.arrays_overlap(tidy(header), tidy(hosted)), "applies")
        .otherwise("other")
    )


def attempt_outcome(df: DataFrame) -> Column:
    """unknown > applied > refused (a client error, or nothing ran) > failed."""
    c = F.col
    return F.when(c("finished_at").isNull(), "unknown").when(c("ok"), "applied").when(c("status").between(400, 499) | (F.coalesce(c("ran"), F.lit(0)) == 0), "refused").otherwise("failed")
