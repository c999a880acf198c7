"""SimHash near-duplicate detection by pigeonhole blocks.

1. Each text gets a 64-bit fingerprint of its word shingles.
2. Copies fold away: one row for each distinct fingerprint goes on.
3. The 64 bits are cut into six blocks. Two fingerprints at 3 or fewer differing bits agree on at least
   three whole blocks, so they meet in at least one of the twenty tables keyed by three blocks.
4. Inside a bucket of a table, a breadth-first search over the members not yet reached yields a
   spanning forest: never all pairs, but the same components. A bucket over BUCKET members is cut into
   pieces, and each pair of pieces is searched in a task of its own, so nothing is capped.
5. Alternating large-star and small-star rounds turn the forests into components.

Null text counts as empty. Texts without words have fingerprint zero and link like any other. Repeated
rows link to each other (equal fingerprints). A null doc_id never becomes a component's id unless all are
null. An empty table gives an empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS, DISTANCE = 64, 3
BLOCKS = (11, 11, 11, 11, 10, 10)
BUCKET = 20_000  # members of a bucket that one task compares at once
_LANES = np.uint64(0x0001000100010001)
_ROWS = 60_000  # shingles summed in 16-bit lanes at once


def shingle_hashes(text: str | None, words: int = 3, seed: int = 42) -> list[int]:
    """XXH64 of each shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), seed)]
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[: len(found) - words])).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is 1 if set in over half of a text's shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    pending: list[tuple[int, list[int]]] = []
    size = 0

    def flush() -> None:
        rows = [(i, h) for i, h in pending if h]
        if not rows:
            return
        every = np.concatenate([np.array(h, np.uint64) for _, h in rows])
        lengths = np.array([len(h) for _, h in rows])
        starts = np.cumsum(lengths) - lengths
        # 16-bit lanes hold the counts of 60,000 hashes; longer texts are summed in several segments
        cuts = [np.arange(s, s + n, _ROWS) for s, n in zip(starts, lengths, strict=True)]
        owner = np.repeat(np.arange(len(rows)), [c.size for c in cuts])
        segments = np.concatenate(cuts)
        bits = np.zeros(len(rows), np.uint64)
        for k in range(16):
            lane = np.add.reduceat((every >> np.uint64(k)) & _LANES, segments)
            for j in range(4):
                count = np.bincount(owner, ((lane >> np.uint64(16 * j)) & np.uint64(0xFFFF)).astype(np.float64), len(rows))
                bits |= (2 * count > lengths).astype(np.uint64) << np.uint64(k + 16 * j)
        out[[i for i, _ in rows]] = bits

    for i, t in enumerate(texts):
        pending.append((i, h := shingle_hashes(t, words)))
        size += len(h)
        if size > 400_000:
            flush()
            pending, size = [], 0
    flush()
    return out


def fingerprinted(docs: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """docs without the text, with `fp`, the fingerprint as a signed long."""
    return common.with_columns_of_text(docs, text, [("fp", T.LongType(), pa.int64())], lambda x: [fingerprints(x, words).view(np.int64)], keep_text=False)


def _masks() -> list[int]:
    low = np.cumsum((0, *BLOCKS))
    block = [((1 << n) - 1) << int(at) for n, at in zip(BLOCKS, low, strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(x) for x in combinations(block, len(BLOCKS) - DISTANCE))]


def forest(x: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, member) that connect what links within x (distinct values), by a search over what is not yet reached."""
    roots, members, left = [], [], x
    while left.size > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and left.size:
            near = np.bitwise_count(left ^ front.pop()) <= distance
            if near.any():
                hit, left = left[near], left[~near]
                front.extend(hit)
                members.append(hit)
                roots.append(np.full(hit.size, root))
    empty = np.zeros(0, x.dtype)
    return (np.concatenate(roots) if roots else empty), (np.concatenate(members) if members else empty)


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("members", T.BinaryType())])
_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64()), ("piece", pa.int32()), ("members", pa.binary())])


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(a))
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=_ARROW)


def _search(most: int):
    """Over rows (bucket, fp) sorted by both: forests of the buckets; a bucket over `most` leaves as pieces."""

    def piece(bucket: int, k: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int64()), pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], schema=_ARROW)

    def whole(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, key.size))
        run = np.repeat(np.arange(first.size), size)
        few = size[run] <= 8
        for lag in range(1, 8):  # small buckets: all their pairs, vectorised
            i = np.flatnonzero((run[:-lag] == run[lag:]) & few[:-lag]) if run.size > lag else np.zeros(0, np.int64)
            i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= DISTANCE]
            if i.size:
                yield _edges(fp[i], fp[i + lag])
        for k in np.flatnonzero(size > 8):
            a, b = forest(fp[first[k] : first[k] + size[k]])
            if a.size:
                yield _edges(a, b)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sent: int | None = None  # pieces that the last bucket has sent, if it is a large one
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            while key.size:
                if sent is not None:  # go on with the large bucket
                    end = int(np.searchsorted(key != key[0], True)) if key[0] == large else 0
                    if end < key.size:  # it ends here
                        if end:
                            yield piece(large, sent, fp[:end])
                        key, fp, sent = key[end:], fp[end:], None
                        continue
                    if end < most:
                        break
                    yield piece(large, sent, fp[:most])
                    key, fp, sent = key[most:], fp[most:], sent + 1
                    continue
                last = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
                # a long bucket among the complete ones leaves as pieces, too
                edge = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), key.size)
                over = [j for j in range(edge.size - 2) if edge[j + 1] - edge[j] > most]
                at = 0
                for j in over:
                    if edge[j] > at:
                        yield from whole(key[at : edge[j]], fp[at : edge[j]])
                    for n, s in enumerate(range(edge[j], edge[j + 1], most)):
                        yield piece(int(key[s]), n, fp[s : min(s + most, edge[j + 1])])
                    at = edge[j + 1]
                if last > at:
                    yield from whole(key[at:last], fp[at:last])
                key, fp = key[last:], fp[last:]
                if key.size <= most:
                    break
                large, sent = int(key[0]), 0
        if key.size:
            if sent is not None and key[0] == large:
                yield piece(large, sent, fp)
            else:
                yield from whole(key, fp)

    return search


def links(prints: DataFrame, most: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all links among the distinct values of prints' column fp."""
    masks = _masks()
    tables = prints.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(masks)])).alias("bucket"))
    found = common.materialize(tables.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_search(most), _LINKS), "simhash-links")
    edges = found.filter("a is not null").select("a", "b")
    large = found.filter("members is not null")
    if not large.limit(1).collect():
        return edges
    left, right = large.select("bucket", F.col("piece").alias("p"), F.col("members").alias("x")), large.select("bucket", F.col("piece").alias("q"), F.col("members").alias("y"))

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, q, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = np.frombuffer(x if p == q else x + y, np.uint64)
                a, b = forest(np.unique(both))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    pairs = left.join(right, "bucket").filter("p <= q").select("p", "q", "x", "y").repartition(F.col("p"), F.col("q"))
    return edges.unionByName(pairs.mapInArrow(across, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node of its component.

    Alternating large-star and small-star rounds; each is written to the shared folder in place of the one before,
    and the loop ends when a round changes nothing, which it does after few rounds (at most about the square of the
    logarithm of the largest component)."""
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = common.materialize(edges, "components")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, common.materialize(small, "components")
        common.superseded(last)
        now = state(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, most: int = BUCKET) -> DataFrame:
    """One row for each row of docs: doc_id, fp (long), component_id."""
    prints = common.materialize(fingerprinted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words), "simhash-prints")
    distinct = common.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct, most))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    known = placed.join(smallest, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: str = "fp"):
    """16 lower-case hex digits of a signed long."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5) -> DataFrame:
    """docs with one document of each component: the one with the smallest id (all rows that carry it; rows without an id stay)."""
    found = near_duplicates(docs, doc_id, text, words)
    keep = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.filter(F.col(doc_id).isNull()).unionByName(docs.join(keep, F.col(doc_id) == F.col("_keep"), "left_semi"))
