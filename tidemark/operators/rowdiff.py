"""Row data compared by key and by checksum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICTS = ("sourceOnly", "targetOnly", "changed", "same")


def encoded(*columns: Column) -> Column:
    """An injective text of a row: N for null, else V, the length, a colon and the text."""
    part = lambda c: F.coalesce(F.concat(F.lit("V"), F.length(c.cast("string")), F.lit(":"), c.cast("string")), F.lit("N"))
    return F.concat(*[part(c) for c in columns])


def digest(columns: Sequence[str]) -> Column:
    return F.md5(encoded(*[F.col(c) for c in columns]))


def keyed_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str], label: str | None = None) -> DataFrame:
    """Full outer join on the keys: one row a key with verdict, source_digest, target_digest.

    Only keys and a 32-digit digest are shuffled, however wide the rows are. Keys must be unique and not
    null on each side (see without_duplicate_keys). label: a column that isn't matched but comes along, the source's unless that is null."""
    named = [] if label is None else [label]
    side = lambda df, name: df.select(*keys, *[F.col(c).alias(f"_{name}_{c}") for c in named], digest([*keys, *values]).alias(name))
    both = side(source, "source_digest").join(side(target, "target_digest"), list(keys), "full_outer")
    both = both.select(*keys, *[F.coalesce(f"_source_digest_{c}", f"_target_digest_{c}").alias(c) for c in named], "source_digest", "target_digest")
    verdict = F.when(F.col("target_digest").isNull(), "sourceOnly").when(F.col("source_digest").isNull(), "targetOnly").when(F.col("source_digest") != F.col("target_digest"), "changed").otherwise("same")
    return both.withColumn("verdict", verdict)


def column_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A row for each key and column whose texts differ on keys that both sides have: column, left, right."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s.{c}").cast("string").alias("left"), F.col(f"t.{c}").cast("string").alias("right")) for c in values])
    joined = source.select(*keys, F.struct(*values).alias("s")).join(target.select(*keys, F.struct(*values).alias("t")), list(keys))
    return joined.select(*keys, F.explode(F.filter(cells, lambda x: ~x["left"].eqNullSafe(x["right"]))).alias("x")).select(*keys, "x.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def without_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once; the duplicates, usually few, are the built side of an anti join."""
    return df.join(duplicate_keys(df, keys).select(*keys), list(keys), "left_anti")


def bounded_compare(source: DataFrame, target: DataFrame, key: str, values: Sequence[str], most: int = 2000) -> DataFrame:
    """Compare the first `most` rows of each side in the byte order of the key's text, only up to the last key that both sides reached."""
    first = lambda df: df.withColumn("_key", F.col(key).cast("string")).orderBy("_key").limit(most)
    a, b = first(source), first(target)
    last = lambda df: df.agg(F.max("_key").alias("last"), F.count("*").alias("n"))
    # a side that ended before its limit sets no cut-off
    cut = last(a).unionByName(last(b)).agg(F.min(F.when(F.col("n") >= most, F.col("last"))).alias("cut")).scalar()
    within = lambda df: df.filter(F.coalesce(F.col("_key") <= cut, F.lit(True)))
    return keyed_diff(within(a), within(b), ["_key"], values).withColumnRenamed("_key", key)


def sample_of_differences(diff: DataFrame, keys: Sequence[str], most: int = 10) -> DataFrame:
    """The first `most` differing rows (source only, then target only, then changed) and whether there are more."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    shown = diff.filter("verdict <> 'same'").withColumn("rank", rank).orderBy("rank", *keys).limit(most + 1)
    numbered = shown.agg(F.sort_array(F.collect_list(F.struct("rank", *keys, "verdict"))).alias("rows"))  # most + 1 rows
    return numbered.select(F.explode(F.slice("rows", 1, most)).alias("r"), (F.size("rows") > most).alias("more")).select("r.*", "more")


def table_checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: row_count and checksum, whatever the order of the rows.

    The checksum is over the count and two sums of 60-bit parts of the rows' digests: sums combine before
    the shuffle, so a table of any size takes one row a task."""
    part = lambda at: F.sum(F.conv(F.substring("d", at, 15), 16, 10).cast("decimal(20,0)"))
    zero = F.lit(0).cast("decimal(30,0)")
    sums = df.select(digest(columns).alias("d")).agg(F.count("*").alias("row_count"), F.coalesce(part(1), zero).alias("a"), F.coalesce(part(16), zero).alias("b"))
    return sums.select("row_count", F.md5(F.concat_ws(":", "row_count", "a", "b").cast("binary")).alias("checksum"))


def sorted_checksum(df: DataFrame, columns: Sequence[str], buckets: int | None = None) -> DataFrame:
    """One row: row_count and checksum over the sorted digests of the rows.

    Row digests are dealt into buckets by their first digits; each bucket's sorted digests are hashed, then the
    bucket hashes. A bucket gets about 50,000 rows: there are 256, or as many more (a power of two, up to 65,536) as the
    number of rows asks for. Checksums compare only for equal numbers of buckets: for tables that differ much in size, give it."""
    if buckets is None:
        buckets, rows = 256, df.count()
        while buckets < 65_536 and rows > 50_000 * buckets:
            buckets *= 2
    rows = df.select(digest(columns).alias("d")).withColumn("b", F.conv(F.substring("d", 1, 4), 16, 10).cast("int") % buckets)
    inner = rows.groupBy("b").agg(F.count("*").alias("n"), F.md5(F.array_join(F.sort_array(F.collect_list("d")), "").cast("binary")).alias("h"))
    return inner.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "").cast("binary")).alias("checksum"))


def ordered_fingerprint(df: DataFrame, key: Column, value: Column, by_text: bool = False) -> DataFrame:
    """md5 over key:value pairs in the order of the keys (of the pairs' texts, by_text): for manifests, whose size is bounded."""
    pair = F.concat_ws(":", key, value)
    pairs = F.sort_array(F.collect_list(F.struct((pair if by_text else key).alias("o"), pair.alias("p"))))
    return df.agg(F.md5(F.array_join(F.transform(pairs, lambda x: x["p"]), ",").cast("binary")).alias("fingerprint"))


def matching_rows(df: DataFrame, keys: Sequence[str], wanted: Sequence[Sequence]) -> DataFrame:
    """Rows whose keys, as text, are among the wanted ones: keys of any type against keys that came in as text."""
    table = df.sparkSession.createDataFrame([tuple(map(str, w)) for w in wanted], ", ".join(f"_k{i} string" for i in range(len(keys)))).distinct()
    equal = [F.col(k).cast("string") == F.col(f"_k{i}") for i, k in enumerate(keys)]
    return df.join(table, equal, "left_semi")


def one_sided_counts(tables: dict[str, DataFrame], side: str) -> DataFrame:
    """table_name, side, row_count of tables that only one side has."""
    counted = [df.agg(F.count("*").alias("row_count")).select(F.lit(t).alias("table_name"), F.lit(side).alias("side"), "row_count") for t, df in tables.items()]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def summary(verdicts: DataFrame, table: str = "table_name") -> DataFrame:
    """Counts of verdicts by table, from rows (table, verdict): same, changed, source_only, target_only, rows at risk, identical."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.groupBy(table).agg(
        n("same").alias("same"), n("changed").alias("changed"), n("sourceOnly").alias("source_only"), n("targetOnly").alias("target_only"),
        (n("changed") + n("targetOnly")).alias("rows_at_risk"), (n("same") == F.count("*")).alias("identical"),
    )
