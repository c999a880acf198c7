"""Version texts as sortable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(v: Column) -> Column:
    """Trimmed, lower case, without a leading v."""
    return F.regexp_replace(F.lower(F.trim(v)), r"^v(?=\d)", "")


def parts(v: Column) -> Column:
    """Numeric parts, padded to three, without trailing zeros beyond the third; null if the text isn't a version."""
    text = F.regexp_extract(cleaned(v), r"^(\d+(?:\.\d+)*)", 1)
    numbers = F.transform(F.split(text, r"\."), lambda x: x.try_cast("long"))
    padded = F.concat(numbers, F.transform(F.sequence(F.size(numbers), F.lit(3)), lambda _: F.lit(0).cast("long")))
    padded = F.slice(padded, 1, F.greatest(F.size(numbers), F.lit(3)))
    # the last index that is within the first three or not zero
    used = F.array_max(F.transform(F.sequence(F.lit(1), F.size(padded)), lambda i: F.when((i <= 3) | (F.element_at(padded, i) != 0), i).otherwise(0)))
    return F.when(text == "", F.lit(None)).otherwise(F.slice(padded, 1, used))


def prerelease(v: Column) -> Column:
    """What follows the first hyphen, without build data; empty for releases."""
    return F.regexp_extract(F.regexp_replace(cleaned(v), r"\+.*$", ""), r"^\d+(?:\.\d+)*-(.+)$", 1)


def sort_key(v: Column) -> Column:
    """Struct that orders versions: numeric parts, then releases after prereleases, then prerelease
    identifiers (numbers before words, numbers by value, fewer before more)."""
    pre = prerelease(v)
    tokens = F.transform(F.split(pre, r"\."), lambda t: F.struct(F.when(t.rlike(r"^\d+$"), 0).otherwise(1).alias("word"), F.coalesce(F.when(t.rlike(r"^\d+$"), t).try_cast("long"), F.lit(0)).alias("number"), t.alias("text")))
    return F.struct(parts(v).alias("parts"), (pre == "").alias("release"), F.when(pre == "", F.array().cast("array<struct<word:int,number:bigint,text:string>>")).otherwise(tokens).alias("pre"))


def key_text(v: Column) -> Column:
    """The normalised text of a version, for joins: 1.2 and v1.2.0 are equal."""
    pre = prerelease(v)
    return F.when(parts(v).isNull(), cleaned(v)).otherwise(F.concat(F.array_join(parts(v), "."), F.when(pre == "", "").otherwise(F.concat(F.lit("-"), pre))))


def bumped(v: Column, level: Column) -> Column:
    """The next version: breaking raises the first part, additive the second, patch the third; others leave it."""
    p = parts(v)
    a, b, c = p[0], p[1], p[2]
    return F.when(level == "breaking", F.concat_ws(".", a + 1, F.lit(0), F.lit(0))).when(level == "additive", F.concat_ws(".", a, b + 1, F.lit(0))).when(level == "patch", F.concat_ws(".", a, b, c + 1)).otherwise(F.concat_ws(".", a, b, c))


def step_level(before: Column, after: Column) -> Column:
    """Which part changed between two versions: breaking, additive, patch, or none."""
    p, q = parts(before), parts(after)
    return F.when(p[0] != q[0], "breaking").when(p[1] != q[1], "additive").when(p != q, "patch").otherwise("none")


LEVELS = ("unknown", "patch", "additive", "breaking")


def level_rank(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), level), F.lit(1)).cast("int") - 1
