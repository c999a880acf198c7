"""Running state over ordered rows of a key, however many rows the key has: a two-level prefix scan.

Rows of a key are cut into pieces by ranges of the order. Each piece is one row of summary, and what the pieces before hand on is
a window over summaries; within a piece the state runs as usual, and the two are merged. Keys up to ROWS rows are one
piece; where there are no others, this is the window by itself. The first order column must be a number, a date or a timestamp; rows that are equal in it stay in one piece. Nulls in it come
first, as in any ascending order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

ROWS = 1_000_000  # rows of a piece, about
FAN = 128  # parts that a round cuts a key or a part of it into, at most


def pieced(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = ROWS) -> DataFrame:
    """df with _piece: numbers from 0 within each key, rising with the order; df as it is where no key has more than `rows` rows.

    Keys with more rows than `rows` are counted out first (counts combine before the shuffle). They are cut into FAN parts at most by
    approximate quantiles, parts that still have too many rows again, and so on: a row is compared with FAN cut points a round, and
    there are as many rounds as the pieces have digits to the base of FAN. Rows that are equal in the first order column are not cut."""
    null_safe = lambda a, b, names: [a[k].eqNullSafe(b[f"_hot_{k}"]) for k in names]
    renamed = lambda t, names: t.withColumnsRenamed({k: f"_hot_{k}" for k in names})
    value, out, places = F.col(order[0]), df, []
    while True:
        part = [*keys, *places]
        sized = out.groupBy(*part).agg(F.count("*").alias("_n"), (F.min(value) < F.max(value)).alias("_several"), F.max(value).alias("_max"))
        # parts are about as large as wanted: only those twice as large, and of several values, are cut again
        hot = materialize(sized.filter((F.col("_n") > (2 * rows if places else rows)) & (F.col("_several") | F.lit(not places))).select(*part, "_n", "_max"), "prefix-hot")
        most = hot.agg(F.max("_n")).first()[0]
        if most is None:
            break
        parts = min(FAN, -(-most // rows))
        named = renamed(hot, part)
        # quantiles of what is below the greatest value, however many rows have that: every cut parts something
        below = F.when(value < F.col("_max"), value)
        of_hot = out.join(named, null_safe(out, named, part)).groupBy(*[out[k] for k in part]).agg(F.array_distinct(F.percentile_approx(below, [i / parts for i in range(1, parts)], 100 * parts)).alias("_cuts"))
        cuts = renamed(materialize(of_hot.filter("_cuts is not null"), "prefix-cuts"), part)
        at = F.coalesce(F.size(F.filter("_cuts", lambda c: c < value)), F.lit(0))
        place = f"_at{len(places)}"
        out = out.join(cuts, null_safe(out, cuts, part), "left").withColumn(place, F.when(F.col("_cuts").isNull() | value.isNull(), 0).otherwise(at)).drop("_cuts", *[f"_hot_{k}" for k in part])
        places.append(place)
        if cuts.isEmpty():
            break
    if not places:
        return df
    number = F.lit(0).cast("long")
    for place in places:
        number = number * FAN + F.col(place)
    return out.withColumn("_piece", number).drop(*places)


def _scanned(cut: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, local, summary: Column, handed, merged) -> DataFrame:
    """cut with `out`. local and handed make a column of a window: of the rows of a piece, and of a key's summaries (_s) by piece."""
    if "_piece" not in cut.columns:
        return cut.withColumn(out, local(Window.partitionBy(*keys).orderBy(*order)))
    pieces = cut.groupBy(*keys, "_piece").agg(summary.alias("_s"))
    carried = pieces.select(*[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_piece").alias("_c_piece"), handed(Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    # what the first piece gets is nothing: only keys in several pieces have rows to join
    carried = materialize(carried.filter("_c_piece > 0 and _carry is not null"), "prefix-carried")
    here = cut.withColumn("_local", local(Window.partitionBy(*keys, "_piece").orderBy(*order)))
    same = [here[k].eqNullSafe(carried[f"_c_{k}"]) for k in keys] + [here["_piece"] == carried["_c_piece"]]
    return here.join(carried, same, "left").withColumn(out, merged(F.col("_local"), F.col("_carry"))).drop("_local", "_carry", "_c_piece", *[f"_c_{k}" for k in keys])


_BEFORE = (Window.unboundedPreceding, -1)


def max_before(cut: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The greatest value of the key's rows before this one."""
    return _scanned(cut, keys, order, out, lambda w: F.max(value).over(w.rowsBetween(*_BEFORE)), F.max(value), lambda w: F.max("_s").over(w), lambda a, b: F.greatest(a, b))


def sum_through(cut: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The sum of the key's rows up to and with this one."""
    return _scanned(cut, keys, order, out, lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(value), lambda w: F.sum("_s").over(w), lambda a, b: F.coalesce(a + b, a, b))


def last_before(cut: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The last value that isn't null of the key's rows before this one."""
    # order, then value: a maximum over both is the last one's (rows equal in the whole order have no last one)
    latest = F.max(F.when(F.col(value).isNotNull(), F.struct(*[F.struct(F.col(c).isNotNull().alias("i"), F.col(c).alias("c")).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).alias("v"))))
    return _scanned(cut, keys, order, out, lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(*_BEFORE)), latest, lambda w: F.last("_s", ignorenulls=True).over(w)["v"], lambda a, b: F.coalesce(a, b))


def row_before(cut: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """A struct of the value (v, may be null) of the key's row just before this one; null for the first row."""
    wrapped = cut.withColumn("_v", F.struct(F.col(value).alias("v")))
    return last_before(wrapped, keys, order, "_v", out).drop("_v")
