"""Helpers that the corpus operators share: scratch tables, held-out rows, bounded samples."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it; on a cluster where it is installed or shipped as a py-file that changes nothing."""
    here = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (paths, here)))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch.root(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def superseded(table: DataFrame) -> None:
    """Delete a materialized table that a later one, written already, has replaced."""
    for path in {os.path.dirname(f) for f in table.inputFiles()}:
        remove(table.sparkSession, path)


materialize, forget = scratch.materialize, scratch.forget


def remainder(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of doc_id's text, mod 5; null for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 5


def is_held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that no model may learn from; a null id counts as not held out, but the learners skip it too."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def stratified_sample(rows: DataFrame, stratum: str, by: str, n: int, counts: DataFrame | None = None) -> DataFrame:
    """About n rows of each stratum (all of those that have fewer), by a hash of `by`.

    Strata are counted first (counts: columns stratum, n), then a threshold for each makes the draw a filter: what is
    sent on has about n rows a stratum, however many tasks there are, and no row moves before it is drawn. Callers
    that need n at most cut what they get. A null stratum is left out."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n")) if counts is None else counts
    share = F.least(F.lit(1.0), F.lit(1.2 * n + 40) / F.col("n")) * F.lit(float(1 << 30))
    drawn = F.pmod(F.xxhash64(F.col(by), F.lit("sample")), F.lit(1 << 30)) < share
    return rows.join(counts.select(F.col(stratum).alias("_stratum"), "n"), F.col(stratum) == F.col("_stratum")).filter(drawn).drop("_stratum", "n")


def hash_sample(df: DataFrame, by: str, n: int, total: int, salt: str) -> DataFrame:
    """About n of total rows, those whose hash of `by` falls below a threshold: a filter in the scan, so what it sends on doesn't grow with the number of tasks."""
    share = 1 << 30 if total <= n else max(1, int((1 << 30) * n / total))
    return df.filter(F.pmod(F.xxhash64(F.col(by), F.lit(salt)), F.lit(1 << 30)) < share)


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts (or lists) have about `most` bytes, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    length = pc.multiply(pc.list_value_length(column), 8) if pa.types.is_list(column.type) else pc.binary_length(column)
    ends = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows or not batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop
        if not batch.num_rows:
            return


def with_columns_of_text(
    df: DataFrame, text: str, added: list[tuple[str, T.DataType, pa.DataType]], work: Callable[[list], list], keep_text: bool = True
) -> DataFrame:
    """df with columns that `work` makes of the text column, batch by batch in Arrow; all other columns pass unchanged.

    A column of df with the name of an added one is replaced."""
    names = [n for n, _, _ in added]
    base = df.drop(*[n for n in names if n in df.columns])
    kept = [f for f in base.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, *[T.StructField(n, t, True) for n, t, _ in added]])
    kept_names, arrow = [f.name for f in kept], [t for _, _, t in added]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text)):
            made = work(batch.column(batch.schema.get_field_index(text)).to_pylist())
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept_names]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(m, type=t) for m, t in zip(made, arrow, strict=True)]], names=[*kept_names, *names])

    return base.mapInArrow(run, schema)
