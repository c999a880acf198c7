"""Version ledgers and timelines: what is applied, missing, ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import versions as V


def ledger_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Entries (script_name, version, sql_content) that the target misses, or has with other content: status missing, extra or diverged."""
    key = lambda df, s: df.select("script_name", V.key_text(F.col("version")).alias("version"), F.md5(F.coalesce("sql_content", F.lit("")).cast("binary")).alias(s))
    both = key(source, "a").join(key(target, "b"), ["script_name", "version"], "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "diverged")
    return both.withColumn("status", status).filter("status is not null").drop("a", "b")


def highest(df: DataFrame, family: str = "script_name", version: str = "version") -> DataFrame:
    """The head of each family: its highest version in version order; of several spellings the last in text order."""
    return df.filter(V.parts(F.col(version)).isNotNull()).groupBy(family).agg(F.max_by(version, F.struct(V.sort_key(F.col(version)), F.col(version))).alias("head"))


def family_heads(left: DataFrame, right: DataFrame, family: str = "script_name") -> DataFrame:
    """Heads of both sides for each family, and which side is older: left, right, same or null where one side has none."""
    a, b = highest(left, family).withColumnRenamed("head", "left_head"), highest(right, family).withColumnRenamed("head", "right_head")
    x, y = V.sort_key(F.col("left_head")), V.sort_key(F.col("right_head"))
    older = F.when(F.col("left_head").isNull() | F.col("right_head").isNull(), F.lit(None)).when(x < y, "left").when(x > y, "right").otherwise("same")
    return a.join(b, family, "full_outer").withColumn("older", older)


def newer_side(heads: DataFrame) -> DataFrame:
    """One row: left, right, same, diverged or unknown, from family_heads()."""
    n = lambda s: F.count_if(F.col("older") == s)
    left_older, right_older = n("left") > 0, n("right") > 0
    return heads.agg(F.when(left_older & right_older, "diverged").when(left_older, "right").when(right_older, "left").when(n("same") > 0, "same").otherwise("unknown").alias("newer"))


def current_version(df: DataFrame, version: str = "version") -> DataFrame:
    """The current version: of the semantic ones if they are at least half, else the last text."""
    semantic = F.col(version).rlike(r"^\s*[vV]?\d+\.\d+")
    return df.agg(
        F.count_if(semantic).alias("semantic"), F.count("*").alias("entries"),
        F.max_by(F.when(semantic, F.col(version)), F.when(semantic, V.sort_key(F.col(version)))).alias("highest"), F.max(F.when(~semantic, F.col(version))).alias("last_text"),
    ).select(F.when(F.col("semantic") * 2 >= F.col("entries"), F.col("highest")).otherwise(F.col("last_text")).alias("version"))


def _order(version: str | Column) -> Column:
    """Versions compare as versions (1.10 after 1.9), whatever type holds them."""
    return V.sort_key((F.col(version) if isinstance(version, str) else version).cast("string"))


def _key(version: str) -> Column:
    """What two spellings of a version share; a name that is no version stands for itself and equals no version."""
    text = F.col(version).cast("string")
    return F.when(V.parts(text).isNull(), F.concat(F.lit("name:"), text)).otherwise(V.key_text(text))


def ledger_status(registry: DataFrame, applied: DataFrame, family: str, version: str) -> DataFrame:
    """Registry against applied ledger: applied, pending (above the family's highest applied), skipped (below it), or unknown to the registry.

    Sides meet on the version, not on its spelling (v1.2 is 1.2.0); a row shows the registry's spelling, the first in text order.
    Applied names that are no versions don't count as the highest."""
    top = applied.filter(V.parts(F.col(version).cast("string")).isNotNull()).groupBy(family).agg(F.max(_order(version)).alias("top"))
    side = lambda df, name: df.groupBy(family, _key(version).alias("_key")).agg(F.min(version).alias(name))
    both = side(registry, "r").join(side(applied, "p"), [family, "_key"], "full_outer").join(top, family, "left").withColumn(version, F.coalesce("r", "p"))
    pending = F.col("top").isNull() | (_order(version) > F.col("top"))
    status = F.when(F.col("r").isNull(), "unregistered").when(F.col("p").isNotNull(), "applied").when(pending, "pending").otherwise("skipped")
    return both.select(family, version, status.alias("status"))


def timeline(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer merge of two sides' entries (script_name, version, applied_at, failed) by family and normalised version.

    Blank versions are skipped; a failed entry loses to a good one; head marks each side's highest version
    that did not fail; unknown says that the other side's entry is below this side's lowest."""

    def side(df: DataFrame, s: str) -> DataFrame:
        kept = df.filter(F.trim("version") != "").withColumn("key", V.key_text(F.col("version"))).withColumn("sort", V.sort_key(F.col("version")))
        pick = Window.partitionBy("script_name", "key").orderBy(F.coalesce("failed", F.lit(False)), F.desc_nulls_last("applied_at"), "version")
        one = kept.withColumn("rn", F.row_number().over(pick)).filter("rn = 1")
        family = Window.partitionBy("script_name")
        head = F.max(F.when(~F.coalesce("failed", F.lit(False)), F.col("sort"))).over(family)
        return one.select("script_name", "key", F.struct("version", "applied_at", F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce(F.col("sort") == head, F.lit(False)).alias("head")).alias(s), F.col("sort").alias(f"sort_{s}"), F.min("sort").over(family).alias(f"floor_{s}"))

    both = side(left, "left").join(side(right, "right"), ["script_name", "key"], "full_outer").withColumn("sort", F.coalesce("sort_left", "sort_right"))
    family = Window.partitionBy("script_name")
    out = both.withColumn("unknown_left", F.col("left").isNull() & (F.col("sort") < F.max("floor_left").over(family))).withColumn("unknown_right", F.col("right").isNull() & (F.col("sort") < F.max("floor_right").over(family)))
    return out.select("script_name", "key", "left", "right", F.coalesce("unknown_left", F.lit(False)).alias("unknown_left"), F.coalesce("unknown_right", F.lit(False)).alias("unknown_right"), "sort")


def timeline_order(df: DataFrame) -> DataFrame:
    """Newest first: versions before names, version descending, time descending (nulls last), name."""
    at = F.greatest(F.col("left.applied_at"), F.col("right.applied_at"))
    return df.orderBy(F.col("sort.parts").isNull(), F.desc("sort"), F.desc_nulls_last(at), "script_name", "key")


def pending_through(status: DataFrame, family: str, version: str, through: Column) -> DataFrame:
    """What is pending up to and with a version."""
    return status.filter((F.col("status") == "pending") & (_order(version) <= _order(through))).orderBy(family, _order(version))


def push_check(registry: DataFrame, family: str, version: str) -> DataFrame:
    """One row: why a version can't be pushed (taken, not-above-highest) or ok."""
    key = V.sort_key(F.lit(version))
    mine = registry.filter(F.col("script_name") == family)
    return mine.agg(F.when(F.coalesce(F.bool_or(V.key_text(F.col("version")) == V.key_text(F.lit(version))), F.lit(False)), "taken").when(F.max(V.sort_key(F.col("version"))) >= key, "not-above-highest").otherwise("ok").alias("verdict"))


def rollback_plan(applied: DataFrame, to_version: str) -> DataFrame:
    """Applied entries above a version, newest first: what a rollback undoes; numbered from 1."""
    above = applied.filter(V.sort_key(F.col("version")) > V.sort_key(F.lit(to_version)))
    order = Window.partitionBy("script_name").orderBy(F.desc(V.sort_key(F.col("version"))))
    return above.withColumn("step", F.row_number().over(order))
