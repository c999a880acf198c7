"""Approximate nearest neighbours by an inverted multi-index, for inner products.

Index: both halves of the vectors are quantised by codebooks of their own, so k centroids each make k * k
cells. Codebooks are fitted on a bounded sample (FIT vectors); every vector is indexed. Search: a heap walks
the pairs of centroids by summed distance (the negative inner product with the query's halves) until the
cells passed hold enough entries; those entries are reranked by the exact inner product, in double
precision. How much of the index is enough is measured, not fixed: on the fitting sample, against brute
force, the least share that reaches RECALL.

Copies: the index holds each distinct vector once with its smallest ids; only those can be among the top
TOP, so nothing is lost, and a vector that a third of all rows share costs one entry. Queries with equal
vectors are searched once, too. Vectors are told apart by two 64-bit hashes, so that they are shuffled no
more often than needed.

Distribution: cells are put together into blocks of first-half centroids, queries into parts, both of a
bounded number of bytes (a larger group is cut by a hash). A query goes to the blocks that its walk has reached,
with the sum at which its walk ended, which says what cells of the block it may see. An index block goes once
to each part of queries that visits it: to one task a pair, which takes matrix products and keeps a top list.

Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
take no part; nor do null ids. Of rows that repeat an id, a query never finds its own id. Ties go to the
smaller id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOP = 20
RECALL = 0.95
FIT = 16_000  # vectors that codebooks are fitted on
PER_CELL, PER_CENTROID = 12.5, 64  # entries of a cell that are aimed at; fitting vectors that a centroid needs at least
BYTES, LEAST_BLOCK = 4 << 20, 1024  # of the vectors of an index block, or of a part of the queries; vectors in a block


def usable(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dim: int | None = None) -> DataFrame:
    """vec_id (long), v (array<double>): the vectors that take part; repeated rows stay."""
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.expr(f"v is not null and size(v) > 0 and {finite} and exists(v, x -> x <> 0)"))
    if dim is None:
        most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        dim = most[0].d if most else 0
    # adding zero turns -0.0 into 0.0, so that equal vectors are equal
    return rows.filter(F.size("v") == dim).select("vec_id", F.expr("transform(v, x -> cast(x as double) + 0D)").alias("v"))


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        a = nearest(x, c)
        n = np.bincount(a, minlength=len(c))
        sums = np.stack([np.bincount(a, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


class Codebook:
    """Centroids of both halves; the second may have no columns if vectors have one component."""

    def __init__(self, sample: np.ndarray, k: int):
        self.first, self.second = (kmeans(h, min(k, len(sample))) if h.shape[1] else np.zeros((1, 0)) for h in halves(sample))

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = halves(x)
        return nearest(a, self.first), nearest(b, self.second)

    def sums(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the distances to the centroids of both halves: negative inner products."""
        a, b = halves(q)
        return -(a @ self.first.T), -(b @ self.second.T)

    def walk(self, d1: np.ndarray, d2: np.ndarray, held: np.ndarray, budget: float) -> tuple[list[tuple[int, int]], float]:
        """Cells in order of summed distance until they hold `budget` entries (empty cells are passed over), and the last sum."""
        o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
        s1, s2, count = d1[o1].tolist(), d2[o2].tolist(), held[np.ix_(o1, o2)].tolist()
        o1, o2 = o1.tolist(), o2.tolist()
        # each row of the grid waits with its next column: a heap of at most k pairs
        heap, opened, cells, seen, last, width = [(s1[0] + s2[0], 0, 0)], 1, [], 0.0, -np.inf, len(s2)
        while heap and seen < budget:
            last, i, j = heap[0]
            if n := count[i][j]:
                cells.append((o1[i], o2[j]))
                seen += n
            if j + 1 < width:
                heapq.heapreplace(heap, (s1[i] + s2[j + 1], i, j + 1))
            else:
                heapq.heappop(heap)
            if i + 1 == opened and opened < len(s1):
                heapq.heappush(heap, (s1[opened] + s2[0], opened, 0))
                opened += 1
        return cells, last


def share_needed(sample: np.ndarray, book: Codebook, top: int = TOP, recall: float = RECALL, queries: int = 256) -> float:
    """The least share of the entries whose reranking finds `recall` of the true nearest, on the sample against brute force."""
    if len(sample) <= 2 * top:
        return 1.0
    c1, c2 = book.codes(sample)
    q = sample[:queries]
    scores = q @ sample.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    true = np.argpartition(-scores, top, axis=1)[:, :top]
    d1, d2 = book.sums(q)
    d = d1[:, c1] + d2[:, c2]
    rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
    need = np.quantile(np.take_along_axis(rank, true, axis=1), recall)
    return float(min(1.0, (need + 1) / len(sample)))


def _blocks(held: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each first-half centroid: its first block and the number of blocks it is cut into. Neighbours share a block of `most` while they fit."""
    at, cuts = np.zeros(len(held), np.int64), np.ones(len(held), np.int64)
    block, room = 0, most
    for i, n in enumerate(held.sum(axis=1)):
        if n > room and room < most:
            block, room = block + 1, most
        cuts[i] = max(1, -(-int(n) // most))
        at[i] = block
        if cuts[i] > 1:
            block, room = block + int(cuts[i]), most
        else:
            room -= int(n)
    return at, cuts


def best_of(queries: np.ndarray, book: Codebook, last: np.ndarray, entries: np.ndarray, ids: np.ndarray, c1: np.ndarray, c2: np.ndarray, keep: int, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query's number, entry's number, score) of each query's `keep` best entries in the cells that its walk has passed; ties to the smaller id."""
    for low in range(0, len(queries), max(1, at_once // len(entries))):
        q = queries[low : low + max(1, at_once // len(entries))]
        d1, d2 = book.sums(q)
        product = q @ entries.T
        edge = last[low : low + len(q)]
        product[d1[:, c1] + d2[:, c2] > (edge + 1e-9 * np.maximum(1.0, np.abs(edge)))[:, None]] = -np.inf
        if len(entries) > keep:
            least = np.partition(product, -keep, axis=1)[:, -keep]
            least = least - 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(least), least, 0.0)))
        else:
            least = np.full(len(q), -np.inf)
        i, j = np.nonzero((product >= least[:, None]) & (product > -np.inf))
        score = (entries[j] * q[i]).sum(axis=1)  # summed in the same way wherever the entry stands
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < keep
        yield i[first] + low, j[first], score[first]


def _vectors(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    return np.asarray(pc.list_flatten(column)).reshape(rows, -1) if rows else np.zeros((0, 0))


_KEY = ("h1", "h2")  # two hashes of a vector


def search(table: DataFrame, is_query, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query (a condition on vec_id) its nearest others."""
    spark = table.sparkSession
    keep = top + 1  # the query itself may be among them
    hashes = [F.xxhash64("v", F.lit(i)).alias(h) for i, h in enumerate(_KEY)]
    rows = common.materialize(usable(table, vec_id, embedding).select("vec_id", "v", *hashes), "ann-vectors")
    distinct = rows.groupBy(*_KEY).agg(F.min("vec_id").alias("vid"), F.min(F.when(is_query, F.col("vec_id"))).alias("qid"), F.any_value("v").alias("v"))
    distinct = common.materialize(distinct, "ann-distinct")
    n, asked_for = distinct.agg(F.count("*"), F.count("qid")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = common.hash_sample(distinct.select("h1", "h2", "v"), "h1", int(1.2 * FIT), n, "codebook")
    sample = np.array([r.v for r in some.orderBy(F.xxhash64("h1", F.lit("codebook")), "h2").limit(FIT).collect()])
    dim = sample.shape[1]
    book = Codebook(sample, int(max(1, min(len(sample) / PER_CENTROID, (n / PER_CELL) ** 0.5))))
    k2 = len(book.second)
    shared = spark.sparkContext.broadcast(book)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2 = shared.value.codes(_vectors(batch.column("v"), batch.num_rows)) if batch.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1, pa.int32()), pa.array(c2, pa.int32())], names=[*batch.schema.names, "c1", "c2"])

    index = distinct.mapInArrow(place, "h1 long, h2 long, vid long, qid long, v array<double>, c1 int, c2 int")
    index = common.materialize(index, "ann-index")
    held = np.zeros((len(book.first), k2))
    for r in index.groupBy("c1", "c2").count().collect():  # as many as there are cells, which FIT bounds
        held[r.c1, r.c2] = r["count"]
    budget = share_needed(sample, book, top, recall) * n
    most = max(64, BYTES // (8 * dim))
    at, cuts = _blocks(held, min(most, max(LEAST_BLOCK, -(-n // 16))))  # smaller blocks where there are few: work for more tasks
    layout = spark.sparkContext.broadcast((held, at, cuts, budget))

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, cuts, budget = layout.value
        for batch in batches:
            d1, d2 = shared.value.sums(_vectors(batch.column("v"), batch.num_rows)) if batch.num_rows else (np.zeros((0, 1)),) * 2
            which, block, last = [], [], []
            for i in range(batch.num_rows):
                cells, edge = shared.value.walk(d1[i], d2[i], held, budget)
                reached = sorted({int(at[c]) + cut for c in {c for c, _ in cells} for cut in range(int(cuts[c]))})
                which += [i] * len(reached)
                block += reached
                last += [edge] * len(reached)
            taken = batch.take(pa.array(which, pa.int32()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block, pa.int32()), pa.array(last, pa.float64())], names=[*taken.schema.names, "block", "last"])

    # queries go into parts by the centroid they are nearest to, so that a part visits few blocks where walks are short
    asked = index.filter("qid is not null")
    held_queries = np.zeros((len(book.first), 1))
    for r in asked.groupBy("c1").count().collect():  # as many as there are centroids
        held_queries[r.c1, 0] = r["count"]
    starts, splits = _blocks(held_queries, most)
    of = lambda x: F.array(*[F.lit(int(v)) for v in x])[F.col("c1")]
    order = asked.select((of(starts) + F.pmod(F.xxhash64("h1", F.lit(1)), of(splits))).cast("int").alias("part"), "h1", "h2", "v")
    walks = max(1, min(10_000, -(-asked_for // 256)))  # tasks: a walk takes time, not memory
    walked = order.repartition(walks, F.xxhash64("h1", "h2")).mapInArrow(visit, "part int, h1 long, h2 long, v array<double>, block int, last double")
    walked = common.materialize(walked, "ann-visits")
    entries = index.select("h1", "h2", "vid", "v", "c1", "c2", (of(at) + F.pmod(F.xxhash64("h1", F.lit(2)), of(cuts))).cast("int").alias("block"))
    entries = entries.join(common.materialize(walked.select("block", "part").distinct(), "ann-pairs"), "block")
    entries = entries.toDF(*entries.columns)  # columns of its own: both sides of the cogroup come from the index

    def rerank(q: pa.Table, e: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if q.num_rows and e.num_rows:
            plain = lambda c: e.column(c).to_numpy()
            found += best_of(_vectors(q.column("v"), q.num_rows), shared.value, q.column("last").to_numpy(), _vectors(e.column("v"), e.num_rows), plain("vid"), plain("c1"), plain("c2"), keep)
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True))
        mine, theirs = q.take(pa.array(i)), e.take(pa.array(j))
        return pa.table({"q1": mine.column("h1"), "q2": mine.column("h2"), "h1": theirs.column("h1"), "h2": theirs.column("h2"), "vid": theirs.column("vid"), "score": pa.array(score)})

    near = walked.groupBy("block", "part").cogroup(entries.groupBy("block", "part")).applyInArrow(rerank, "q1 long, q2 long, h1 long, h2 long, vid long, score double")
    # the best of each query, whose copies come back by their smallest ids; a query doesn't find itself
    first = lambda df, by, *order: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("k") <= keep)
    best = first(near, ("q1", "q2"), F.desc("score"), "vid").select("q1", "q2", "h1", "h2", "score")
    copies = rows.select("vec_id", *_KEY).distinct()
    listed = best.join(first(copies, _KEY, "vec_id").drop("k"), [*_KEY])
    listed = first(listed, ("q1", "q2"), F.desc("score"), "vec_id").groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "score"))).alias("found"))  # at most top + 1 each
    queries = copies.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
    mine = queries.join(listed, ["q1", "q2"]).select("query_id", F.posexplode(F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {top})")).alias("rank", "x"))
    return mine.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
