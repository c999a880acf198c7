"""Time-ordered tables: newest, previous, changed, retained, as-of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from . import prefix


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in `order`; Spark keeps n a key in each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def beyond_retention(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int) -> DataFrame:
    """The rows that a retention of `keep` rows a key deletes."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") > keep)


def within_days(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last `days` days (at least one) before as_of."""
    since = F.lit(as_of).cast(df.schema[ts].dataType) - F.expr(f"INTERVAL {max(1, int(days))} DAYS")
    return df.filter(F.col(ts) >= since)


def on_change(df: DataFrame, key: str, order: Sequence[str], watched: Sequence[str]) -> DataFrame:
    """Rows whose watched columns differ (null-safe) from the key's previous row; the first row counts as changed."""
    w = Window.partitionBy(key).orderBy(*order)
    state = F.struct(*watched)
    return df.withColumn("_before", F.lag(state).over(w)).filter(F.col("_before").isNull() | ~F.col("_before").eqNullSafe(state)).drop("_before")


def run_compare(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Ratio to the key's previous run and verdict: first, slower (>= 1.2), faster (<= 1 / 1.2), same."""
    w = Window.partitionBy(key).orderBy(*order)
    out = df.withColumn("previous", F.lag(value).over(w)).withColumn("ratio", F.try_divide(F.col(value), F.col("previous")))
    return out.withColumn("verdict", F.when(F.col("previous").isNull(), "first").when(F.col("ratio") >= 1.2, "slower").when(F.col("ratio") <= 1 / 1.2, "faster").otherwise("same"))


def measured_compare(before: Column, after: Column, cost_before: Column, cost_after: Column) -> Column:
    """Verdict from times if both runs were measured, else from costs; measured and estimated are never mixed."""
    ratio = F.when(before.isNotNull() & after.isNotNull(), F.try_divide(after, before)).when(before.isNull() & after.isNull(), F.try_divide(cost_after, cost_before))
    return F.when(ratio.isNull(), "unknown").when(ratio >= 1.2, "slower").when(ratio <= 1 / 1.2, "faster").otherwise("same")


def over_window(df: DataFrame, key: str, order: Column, value: str) -> DataFrame:
    """First and last value of each key and the change between them; order must be total."""
    return df.groupBy(key).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.count("*").alias("samples")).withColumn("change", F.col("last_value") - F.col("first_value"))


def below_high_water(df: DataFrame, key: str, order: Sequence[str], value: str, rows: int = prefix.ROWS) -> DataFrame:
    """With high_water, the running maximum before each row, and forward: whether the row goes beyond it. Keys over `rows` rows run in pieces."""
    out = prefix.max_before(prefix.pieced(df, [key], order, rows), [key], order, value, "high_water").drop("_piece")
    return out.withColumn("forward", F.col("high_water").isNull() | (F.col(value) > F.col("high_water")))


def until_first_violation(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of each key before its first one that isn't forward."""
    cut = df.groupBy(key).agg(F.min(F.when(~F.col("forward"), F.col(order))).alias("cut"))
    return df.join(cut, key).filter(F.col("cut").isNull() | (F.col(order) < F.col("cut"))).drop("cut")


def previous_event(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Backward as-of: the value of the key's event strictly before this one."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int = prefix.ROWS) -> DataFrame:
    """Filtered as-of: the last value that isn't null before this row, among rows of the same keys (null-safe). Keys over `rows` rows run in pieces."""
    return prefix.last_before(prefix.pieced(df, keys, order, rows), keys, order, value, "last_known").drop("_piece")


def later_than(df: DataFrame, key: str, order: Sequence[str], most: int | None = None) -> DataFrame:
    """Range join to one row a key: rows later than the key's oldest by the tuple order."""
    oldest = df.groupBy(key).agg(F.min(F.struct(*order)).alias("oldest"))
    out = df.join(oldest, key).filter(F.struct(*order) > F.col("oldest")).drop("oldest")
    return out if most is None else out.orderBy(*order).limit(most)


def newest_nested(parents: DataFrame, events: DataFrame, key: str, order: Sequence[Column], fields: Sequence[str], n: int = 5) -> DataFrame:
    """Each parent with its n newest events as a list, newest first; an empty list without any."""
    top = newest(events, [key], order, n).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("events"))
    empty = F.array().cast(top.schema["events"].dataType)
    return parents.join(top, key, "left").withColumn("events", F.coalesce("events", empty))


def alerts(df: DataFrame, key: str, order: Sequence[str], status: str, fingerprint: str) -> DataFrame:
    """The alert that each event raises, given the key's event before: drifted, changed, in_sync, unreachable, reachable, nothing.

    changed: still drifted, with a fingerprint other than the key's last known one."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(status).over(w)
    known = F.last(fingerprint, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = F.col(status)
    alert = (
        F.when((s == "unreachable") & ~before.eqNullSafe(F.lit("unreachable")), "unreachable")
        .when((s == "drifted") & before.eqNullSafe(F.lit("unreachable")), "reachable")
        .when((s == "drifted") & ~before.eqNullSafe(F.lit("drifted")), "drifted")
        .when((s == "drifted") & (F.col(fingerprint) != known), "changed")
        .when((s == "in_sync") & (before == "drifted"), "in_sync")
        .when((s == "in_sync") & (before == "unreachable"), "reachable")
        .otherwise("nothing")
    )
    return df.withColumn("previous_status", before).withColumn("alert", alert)


def recorded_outcomes(df: DataFrame, key: str, order: Sequence[str], status: str, fingerprint: str, rows: int = prefix.ROWS) -> DataFrame:
    """Events that are written to the log: a key's first, a new status, or a fingerprint other than the last one recorded with this status.

    An event without a fingerprint has nothing to compare but its status; a log row without one is followed by the next that has one.
    Keys over `rows` rows run in pieces."""
    cut = prefix.pieced(df, [key], order, rows)
    keep = (lambda t: materialize(t, "history")) if "_piece" in cut.columns else (lambda t: t)  # pieces are read twice
    before = keep(prefix.row_before(cut, [key], order, status, "_before"))
    new = before.withColumn("_new", F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(status))).withColumn("_one", F.col("_new").cast("int"))
    runs = keep(prefix.sum_through(new, [key], order, "_one", "_run"))
    # the last fingerprint counts while its run goes on
    seen = runs.withColumn("_seen", F.when(F.col(fingerprint).isNotNull(), F.struct(F.col("_run").alias("run"), F.col(fingerprint).alias("f"))))
    known = prefix.last_before(seen, [key], order, "_seen", "_known").withColumn("_known", F.when(F.col("_known.run") == F.col("_run"), F.col("_known.f")))
    other = F.col(fingerprint).isNotNull() & ~F.col("_known").eqNullSafe(F.col(fingerprint))
    return known.filter(F.col("_new") | other).select(*df.columns)


def incremental(df: DataFrame, seen: DataFrame, id_column: str, baseline: int, highest: int, lookback: int = 100, most: int = 200) -> DataFrame:
    """New rows by an id watermark with a lookback for late ones: ids above max(baseline, highest - lookback) that were not seen, in order."""
    floor = max(baseline, highest - lookback)
    return df.filter(F.col(id_column) > floor).join(seen.select(id_column), id_column, "left_anti").orderBy(id_column).limit(most)
