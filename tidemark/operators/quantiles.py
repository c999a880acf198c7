"""Exact percentiles of groups of any size: no buffer or task holds a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize

MARGIN, ACCURACY = 0.002, 10_000  # share of a group on either side of a wanted position; of the approximate percentiles, whose error (1 / ACCURACY) is far smaller
FITS, PIECES = 1_000_000, 100  # distinct values that one task puts in order; pieces that a bracket with more is cut into


def percentiles(df: DataFrame, by: Column, name: str, shares: dict[str, tuple[Column, float]], *more: Column, fits: int = FITS) -> DataFrame:
    """name (the group, by), the aggregates `more`, and for each share (value, share) the exact percentile of its values that aren't null, interpolated as SQL's percentile_cont; null where a group has none.

    Two scans for all values together. The first takes `more` and approximate percentiles a little below and above each wanted
    position. The second counts what lies below such a bracket and the distinct values inside it, copies combined before the
    shuffle. A bracket with more than `fits` of those is cut into pieces, and only pieces with a wanted position are kept, until
    all fit. A null group is a group."""
    g, columns = F.struct(by.alias("key")).alias("g"), [f"v{i}" for i in range(len(shares))]
    known = df.withColumns({c: value.cast("double") for c, (value, _) in zip(columns, shares.values(), strict=True)})
    cuts = [F.percentile_approx(c, F.array(F.lit(max(0.0, s - MARGIN)), F.lit(min(1.0, s + MARGIN))), ACCURACY).alias(f"cut_{c}") for c, (_, s) in zip(columns, shares.values(), strict=True)]
    groups = materialize(known.groupBy(g).agg(*more, *cuts), "quantile-groups")
    named = [c for c in groups.columns if c != "g" and not c.startswith("cut_v")]
    bracket = groups.select("g", *[f"cut_{c}" for c in columns])
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("v"), F.col(f"cut_{c}")[0].alias("low"), F.col(f"cut_{c}")[1].alias("high")) for i, c in enumerate(columns)])
    placed = known.select(g, *columns).join(bracket, "g").select("g", F.inline(each)).filter("v is not null")
    side = F.when(F.col("v") < F.col("low"), -1).when(F.col("v") > F.col("high"), 1).otherwise(0)
    counted = placed.groupBy("g", "i", side.alias("side"), F.when(side == 0, F.col("v")).alias("at")).agg(F.count("*").alias("m"), F.max("v").alias("top"), F.min("v").alias("bottom"))
    counted = materialize(counted, "quantile-values")
    of = lambda what, which: F.coalesce(F.sum(F.when(which, F.col(what))), F.lit(0))
    sides = counted.groupBy("g", "i").agg(F.sum("m").alias("n"), of("m", F.col("side") < 0).alias("below"), of("m", F.col("side") <= 0).alias("upto"), F.max(F.when(F.col("side") < 0, F.col("top"))).alias("before"), F.min(F.when(F.col("side") > 0, F.col("bottom"))).alias("after"))
    at = F.element_at(F.array(*[F.lit(s) for _, s in shares.values()]), F.col("i") + 1) * (F.col("n") - 1)
    sides = sides.select("*", F.floor(at).cast("long").alias("first"), F.ceil(at).cast("long").alias("last"), (at - F.floor(at)).alias("part"))
    asked = ["first", "last", "part"]
    inside = counted.filter("side = 0").select("g", "i", F.col("at").alias("v"), "m").join(sides.select("g", "i", F.col("below").alias("start"), *asked), ["g", "i"]).withColumn("piece", F.lit(""))
    if counted.count() > fits:
        inside = _narrowed(inside, fits)
    end = F.col("start") + F.sum("m").over(Window.partitionBy("g", "i", "piece").orderBy("v"))
    # the bracket's neighbours stand for a position right beside it, which only small groups have
    beside = F.array(*[F.struct(F.col(v).alias("v"), start.alias("from"), (start + 1).alias("to")) for v, start in (("before", F.col("below") - 1), ("after", F.col("upto")))])
    ranked = inside.select("g", "i", *asked, "v", (end - F.col("m")).alias("from"), end.alias("to")).unionByName(sides.select("g", "i", *asked, F.inline(beside)).filter("v is not null"))
    here = lambda i, place: F.max(F.when((F.col("i") == i) & (F.col(place) >= F.col("from")) & (F.col(place) < F.col("to")), F.col("v")))
    values = [(here(i, "first") + F.max(F.when(F.col("i") == i, F.col("part"))) * (here(i, "last") - here(i, "first"))).alias(n) for i, n in enumerate(shares)]
    return groups.select("g", *named).join(ranked.groupBy("g").agg(*values), "g", "left").select(F.col("g.key").alias(name), *named, *shares)


def _narrowed(inside: DataFrame, fits: int) -> DataFrame:
    """inside (g, i, piece, start: the values below the piece, v, m: its copies, first and last: the wanted positions, part) where no piece that holds a wanted position has more than `fits` values; of larger ones the others go.

    Pieces are cut at approximate quantiles of the distinct values; counts are exact, so any cut is right."""
    piece = ["g", "i", "piece"]
    while True:
        sizes = inside.groupBy(piece).agg(F.count("*").alias("size"))
        if (sizes.agg(F.max("size")).first()[0] or 0) <= fits:
            return inside
        crowded = inside.join(sizes.filter(F.col("size") > fits).select(piece), piece)
        cuts = crowded.groupBy(piece).agg(F.percentile_approx("v", F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)]), PIECES * 100).alias("cuts"))
        cut = crowded.join(cuts, piece).withColumn("sub", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
        sums = cut.groupBy(*piece, "start", "first", "last", "sub").agg(F.sum("m").alias("held")).withColumn("from", F.col("start") + F.sum("held").over(Window.partitionBy(piece).orderBy("sub")) - F.col("held"))
        holds = lambda place: (F.col(place) >= F.col("from")) & (F.col(place) < F.col("from") + F.col("held"))
        kept = sums.filter(holds("first") | holds("last")).select(*piece, "sub", "from")
        finer = cut.join(kept, [*piece, "sub"]).select("g", "i", F.concat_ws(".", "piece", "sub").alias("piece"), F.col("from").alias("start"), "v", "m", "first", "last", "part")
        inside = materialize(inside.join(sizes.filter(F.col("size") <= fits).select(piece), piece).unionByName(finer), "quantile-pieces")


def exact_percentiles(df: DataFrame, by: Column, name: str, value: Column, shares: dict[str, float]) -> DataFrame:
    """percentiles() of one value: groups that have any."""
    found = percentiles(df, by, name, {n: (value, s) for n, s in shares.items()})
    return found.filter(F.coalesce(*shares).isNotNull())
