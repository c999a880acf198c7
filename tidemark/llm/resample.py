"""Importance resampling towards a target distribution, over a persisted sparse document-by-bucket count matrix.

1. Words and pairs of neighbouring words are features; a feature's bucket is its CRC-32 modulo the number of buckets.
   Documents are counted in blocks, each a row of a table: the CSR arrays of some megabytes of texts. The matrix is written once.
2. Column sums, task by task and then by bucket, give the distribution of the documents and that of the target.
   What leaves a task is at most one row a bucket; the driver sees one number a bucket, whatever the corpus.
3. A bucket's gain is the logarithm of the two smoothed shares' ratio; the matrix times the gains gives the weights.
4. Gumbel noise by id and the highest scores are a draw without replacement. Ranks are counted within ranges of the
   order, each after the sum of those before it: no task holds more than a range.

Words are maximal runs of [0-9A-Za-z] and of everything beyond ASCII, A-Z in lower case. Null and empty texts have no feature
and weight 0. Very long texts are counted in parts of about PART bytes (a row of the matrix has at most one entry
a bucket). A null id has no noise: its score and rank are null and it doesn't count among those drawn from. Ties go
to the smaller id, then to fewer features; repeated rows are drawn each by itself. An empty table gives an empty result, an empty target
counts nothing. Other columns than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 10_000
LEAST_WORDS = 20  # words of a document that may be drawn
PERCENT = 25  # of those documents are drawn
SEED = 7
SCALE = 1000  # gains and scores are integers in thousandths
RANGE = 1_000_000  # rows that one task ranks
PART = 1 << 20
BLOCK = 1 << 20  # bytes of texts in a block of the matrix, or one text
GROUP = 8 << 20  # bytes of a row group of the matrix

_CSR = ("n_words", "ends", "columns", "counts")

#: Everything but digits, letters and bytes beyond ASCII becomes a space; A-Z become a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in parts."""
    plain, at = text.translate(_WORDS), 0
    while at < len(plain):
        stop = plain.find(b" ", at + PART)
        stop = len(plain) if stop < 0 else stop
        yield plain[at:stop].split()
        at = stop


def buckets_of(text: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, the buckets that occur, and how often."""
    n, last, parts = 0, None, []
    for words in _parts(text):
        if not words:
            continue
        ones = list(map(crc32, words))
        # the checksum of "a b" goes on from that of "a"
        before = ones[:-1] if last is None else [last, *ones[:-1]]
        twos = list(map(crc32, words[1:] if last is None else words, map(crc32, repeat(b" "), before)))
        n, last = n + len(words), ones[-1]
        parts.append(np.unique(np.array(ones + twos, np.int64) % buckets, return_counts=True))
    if len(parts) > 1:
        total = sum(np.bincount(b, c, minlength=buckets) for b, c in parts).astype(np.int64)
        return n, np.flatnonzero(total), total[total > 0]
    return (n, *parts[0]) if parts else (0, np.zeros(0, np.int64), np.zeros(0, np.int64))


def count_matrix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row a block: ids, n_words, ends (of each document's entries), columns, counts; all but the ids as packed integers of 32 bits. Written in small row groups, for readers hold a group."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "text", BLOCK)):
            if batch.num_rows:
                found = [buckets_of(t or b"", buckets) for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]
                ids = batch.column(0)
                lists = [np.array([f[0] for f in found]), np.cumsum([len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])]
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)] + [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in lists]
                yield pa.RecordBatch.from_arrays(arrays, names=["ids", *_CSR])

    made = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"ids array<{kind}>, " + ", ".join(f"{c} binary" for c in _CSR))
    path = common.scratch_path(docs.sparkSession, "resample-matrix")
    made.write.option("parquet.block.size", GROUP).option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def _array(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The integers of a batch's first block."""
    return np.frombuffer(batch.column(column)[0].as_buffer(), "<i4")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n; buckets without features have no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for row in _rows(batches):
            total += np.bincount(_array(row, "columns"), _array(row, "counts"), minlength=buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return matrix.select("columns", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, of two tables of column sums: floor(1000 ln of the ratio of shares, one added to each bucket)."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).unionByName(target.select("bucket", F.lit(0).alias("s"), F.col("n").alias("t")))
    sums = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()  # one row a bucket at most
    s, t = np.zeros(buckets), np.zeros(buckets)
    s[sums.column("bucket").to_numpy()], t[sums.column("bucket").to_numpy()] = sums.column("s").to_numpy(), sums.column("t").to_numpy()
    return np.floor(SCALE * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the matrix times the gains, divided by the features, rounded down."""
    kind = matrix.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, ends, at, n = (_array(row, c) for c in _CSR)
            ends, inner, features = np.append(0, ends), np.append(0, np.cumsum(gain[at] * n)), np.append(0, np.cumsum(n, dtype=np.int64))
            product, features = inner[ends[1:]] - inner[ends[:-1]], features[ends[1:]] - features[ends[:-1]]
            yield pa.RecordBatch.from_arrays([row.column("ids").flatten(), pa.array(words.astype(np.int64)), pa.array(features), pa.array(product // np.maximum(features, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: str = "doc_id", seed: int = SEED):
    """Gumbel noise in thousandths, of a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-float(SCALE) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list, span: int = RANGE) -> DataFrame:
    """rows and their rank (1, 2, 3, …) in the given order, which has to be total up to equal rows."""
    ranges = max(1, -(-rows.count() // span))
    # equal rows are told apart by their place, so that no range can be all ties
    dealt = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, F.col("_place")).sortWithinPartitions(*order, F.col("_place"))
    laid = common.materialize(dealt.drop("_place").withColumn("_at", F.monotonically_increasing_id()), "resample-order")
    sizes = sorted((r["range"], r["count"]) for r in laid.groupBy(F.shiftright("_at", 33).alias("range")).count().collect())  # one row a range
    before = np.append(0, np.cumsum([n for _, n in sizes])).tolist()
    starts = rows.sparkSession.createDataFrame(pa.table({"_range": pa.array([r for r, _ in sizes], pa.int64()), "_before": pa.array(before[:-1], pa.int64())}))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.withColumn("_range", F.shiftright("_at", 33)).join(starts, "_range").withColumn("rank", F.col("_before") + within + 1).drop("_at", "_range", "_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, span: int = RANGE) -> DataFrame:
    """doc_id, n_features, weight, score, rank: every document; rank is null for those not drawn."""
    matrix = count_matrix(docs, doc_id, text, buckets)
    wanted = column_sums(count_matrix(target.select(F.lit(None).cast("long").alias("id"), F.col(text).alias("text")), "id", "text", buckets), buckets)
    gain = gains(column_sums(matrix, buckets), wanted, buckets)
    scored = weights(matrix, gain).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = common.materialize(scored, "resample-scores")
    common.superseded(matrix)
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    placed = ranked(scored.filter(may), [F.col("score").desc(), F.col("doc_id"), F.col("n_features")], span)
    most = scored.filter(may).count() * percent // 100
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.filter(~may).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
