"""Time series of metric samples: spines, geometry, changes in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """The last `days` days up to as_of, each with its count of rows, zero where there are none."""
    spark = df.sparkSession
    spine = spark.range(1).select(F.explode(F.expr(f"sequence(date_sub(date'{as_of}', {int(days) - 1}), date'{as_of}')")).alias("day"))
    counts = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").fillna(0, subset=["n"])


def geometry(df: DataFrame, key: str, ts: str, value: str, width: float = 1.0, height: float = 1.0) -> DataFrame:
    """x and y of each sample that has a value in its series' frame; 10 % of the range is padding, or for a flat
    series the larger of 10 % of the value and 0.5. missing: samples without a value. The frames are one
    aggregated row a key, joined back, so no series is gathered in one task."""
    at = F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)
    frame = df.groupBy(key).agg(F.min(F.when(F.col(value).isNotNull(), at)).alias("t0"), F.max(F.when(F.col(value).isNotNull(), at)).alias("t1"), F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(F.col(value).isNull()).alias("missing"))
    span = F.col("high") - F.col("low")
    pad = F.when(span > 0, span * 0.1).otherwise(F.greatest(F.abs("high") * 0.1, F.lit(0.5)))
    framed = df.filter(F.col(value).isNotNull()).join(frame.withColumn("pad", pad), key)
    x = F.when(F.col("t1") > F.col("t0"), (at - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(F.lit(0.5)) * width
    y = height * (1 - (F.col(value) - (F.col("low") - F.col("pad"))) / (span + 2 * F.col("pad")))
    return framed.select(key, ts, value, x.alias("x"), y.alias("y"), "missing")


def change(df: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """First and last value of each series that has at least two, the change, and the span in words."""
    known = df.filter(F.col(value).isNotNull())
    out = known.groupBy(key).agg(F.min_by(value, ts).alias("first_value"), F.max_by(value, ts).alias("last_value"), F.min(ts).alias("since"), F.max(ts).alias("until"), F.count("*").alias("samples")).filter("samples >= 2")
    seconds = F.unix_micros(F.col("until").cast("timestamp")) / F.lit(1e6) - F.unix_micros(F.col("since").cast("timestamp")) / F.lit(1e6)
    return out.withColumn("change", F.col("last_value") - F.col("first_value")).withColumn("span", span_words(seconds))


def span_words(seconds: Column) -> Column:
    """Minutes below 90, hours below 36, else days."""
    word = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
    minutes, hours, days = (F.floor(seconds / s + 0.5).cast("long") for s in (60.0, 3600.0, 86400.0))
    return F.when(minutes < 90, word(minutes, "minute")).when(hours < 36, word(hours, "hour")).otherwise(word(days, "day"))


def drift_share(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("checks"), F.count_if("drifted").alias("drifted"), F.try_divide(F.count_if("drifted").cast("double"), F.count("*")).alias("share"))
