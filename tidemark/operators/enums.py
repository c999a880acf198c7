"""Ordered label lists compared: what an enum type gains, or why no statement can change it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def labels(definition: Column) -> Column:
    """The labels of ENUM ('a', 'b'), in order, doubled quotes undone; null if it is no enum."""
    found = F.transform(F.regexp_extract_all(definition, F.lit(r"'((?:[^']|'')*)'"), F.lit(1)), lambda x: F.replace(x, F.lit("''"), F.lit("'")))
    return F.when(definition.rlike(r"(?is)^\s*enum\s*\("), found)


def kept_in_order(before: Column, after: Column) -> Column:
    """The length of the longest common subsequence of two lists of distinct labels: the longest rising run of their positions."""
    places = F.filter(F.transform(before, lambda x: F.array_position(after, x)), lambda p: p > 0)
    length = lambda acc, p: F.coalesce(F.array_max(F.transform(F.filter(acc, lambda x: x["p"] < p), lambda x: x["n"])), F.lit(0)) + 1
    runs = F.aggregate(places, F.array().cast("array<struct<p:bigint,n:int>>"), lambda acc, p: F.concat(acc, F.array(F.struct(p.alias("p"), length(acc, p).cast("int").alias("n")))))
    return F.coalesce(F.array_max(F.transform(runs, lambda x: x["n"])), F.lit(0))


def verdict(before: Column, after: Column) -> Column:
    """same, grown (labels were added, the others keep their order), removed or reordered."""
    lost = F.size(F.array_except(before, after)) > 0
    return F.when(before == after, "same").when(lost, "removed").when(kept_in_order(before, after) < F.size(before), "reordered").otherwise("grown")


def additions(before: Column, after: Column) -> Column:
    """For a grown list: (label, next) of each added label in order, next being the old label that it stands before, null at the end."""
    added = F.filter(F.transform(after, lambda x, i: F.struct(x.alias("label"), i.alias("i"))), lambda x: ~F.array_contains(before, x["label"]))
    behind = lambda x: F.get(F.filter(F.slice(after, x["i"] + 2, F.size(after)), lambda y: F.array_contains(before, y)), F.lit(0))
    return F.transform(added, lambda x: F.struct(x["label"].alias("label"), behind(x).alias("next")))


def statements(name: Column, before: Column, after: Column) -> Column:
    """ALTER TYPE … ADD VALUE … BEFORE … for a grown list, in an order that can be run from the first on. name: quoted."""
    text = lambda x: F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.transform(additions(before, after), lambda x: F.concat(F.lit("ALTER TYPE "), name, F.lit(" ADD VALUE "), text(x["label"]), F.coalesce(F.concat(F.lit(" BEFORE "), text(x["next"])), F.lit(""))))
