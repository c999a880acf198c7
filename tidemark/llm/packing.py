"""Best-fit packing of documents into bins of fixed capacity, with conflicts.

A document longer than a bin is cut into pieces (whole texts are kept). Pieces go into bins in falling
order of length; each bin carries its residual and two bitmaps: sources (a source has as many bits as a
bin may hold pieces of it) and duplicate clusters; what is too rare in the shard to conflict needs no bits. A piece may join a bin if its cluster is not there yet
and a bit of its source is free. Bins hang in a tree over residuals, whose nodes hold the AND of the
bitmaps below them: the successor search starts at the smallest residual that fits and goes on, skipping
what is blocked as a whole, until it reaches the tightest compatible bin.

Shards: pieces are dealt by a hash of the document into shards of about SHARD pieces, each packed in one
task, so bins fill in parallel and a source or cluster that holds a third of all rows is spread over all
shards. Only narrow rows are shuffled; texts stay where they are.

Length: words between white space. Texts that are null or without words have no pieces and get no bin
(one row with bin null). Null sources count as one source. Ties go by doc_id (nulls last), then piece. Repeated
rows and rows with null ids are packed each by itself, also those that fill bins of their own; equal texts count
as duplicates of each other. Ids keep their type and value. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096  # words in a bin
PER_SOURCE = 8  # pieces of one source in a bin
SHARD = 20_000  # pieces in a shard


class Bins:
    """Open bins of one shard; all masks are Python integers. Layout: per_source bits for each source, then one bit for each cluster."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.half = 1 << capacity.bit_length()
        self.tree: list[int] = [-1] * (2 * self.half)  # AND of what is blocked; -1: no bin below
        self.at: dict[int, list[int]] = defaultdict(list)  # residual -> bins, in order
        self.blocked: list[int] = []
        self.residual: list[int] = []

    def _update(self, r: int) -> None:
        i = r + self.half
        mask = -1
        for b in self.at[r]:
            mask &= self.blocked[b]
        while self.tree[i] != mask:
            self.tree[i] = mask
            i //= 2
            if not i:
                return
            mask = self.tree[2 * i] & self.tree[2 * i + 1]

    def _successor(self, node: int, low: int, high: int, least: int, full: int, cluster: int) -> int | None:
        """The bin of the smallest residual >= least that has neither the source full nor the cluster."""
        mask = self.tree[node]
        if high < least or mask == -1 or mask & full or mask & cluster:
            return None
        if node >= self.half:
            return next((b for b in self.at[low] if not self.blocked[b] & (full | cluster)), None)
        middle = (low + high) // 2
        found = self._successor(2 * node, low, middle, least, full, cluster)
        return found if found is not None else self._successor(2 * node + 1, middle + 1, high, least, full, cluster)

    def place(self, size: int, source: int | None, cluster: int | None) -> tuple[int, int]:
        """Bin and offset of the piece. A source's highest bit says that it is full in the bin. None: can't conflict."""
        ladder = [] if source is None else [1 << (source * self.per_source + k) for k in range(self.per_source)]
        bit = 0 if cluster is None else 1 << cluster
        b = self._successor(1, 0, self.half - 1, size, ladder[-1] if ladder else 0, bit)
        if b is None:
            b = len(self.blocked)
            self.blocked.append(0)
            self.residual.append(self.capacity)
        else:
            self.at[self.residual[b]].remove(b)
            self._update(self.residual[b])
        offset = self.capacity - self.residual[b]
        self.blocked[b] |= next((x for x in ladder if not self.blocked[b] & x), 0) | bit
        self.residual[b] -= size
        insort(self.at[self.residual[b]], b)
        self._update(self.residual[b])
        return b, offset


def pack(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> tuple[list[int], list[int]]:
    """Bins and offsets of the pieces, in the order given (longest first for best-fit decreasing)."""
    bins, often, pieces_of = Bins(capacity, per_source), Counter(clusters), Counter(sources)
    # only what occurs often enough to conflict gets bits, so masks stay short however many sources there are
    source_at = {s: i for i, s in enumerate(s for s, n in pieces_of.items() if n > per_source)}
    shift = len(source_at) * per_source
    cluster_at = {c: shift + i for i, c in enumerate(c for c, n in often.items() if n > 1)}
    placed = [bins.place(n, source_at.get(s), cluster_at.get(c)) for n, s, c in zip(sizes, sources, clusters, strict=True)]
    return [b for b, _ in placed], [o for _, o in placed]


def pieces(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, cluster (hash of the words in lower case), row (a number of its own for each row of docs), piece, n_words; documents without words: piece null."""
    # splitting at single white-space characters and counting what is not empty keeps texts whole in the JVM
    words = F.expr(rf"size(filter(split(coalesce(`{text}`, ''), '[ \\t-\\r]+'), w -> w != ''))")
    cluster = F.xxhash64(F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[ \t-\r]+", " "))))
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), cluster.alias("cluster"), words.alias("n"), F.monotonically_increasing_id().alias("row"))
    none, some = "cast(array() as array<struct<piece:int,n_words:int>>)", f"sequence(0, (n - 1) div {capacity})"
    cut = F.expr(f"if(n = 0, {none}, transform({some}, i -> named_struct('piece', i, 'n_words', least({capacity}, n - i * {capacity}))))")
    return counted.select("doc_id", "source", "cluster", "row", F.explode_outer(cut).alias("c")).select("doc_id", "source", "cluster", "row", F.col("c.piece").cast("int").alias("piece"), F.col("c.n_words").cast("int").alias("n_words"))


def packed(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a piece: doc_id, piece, n_words, bin (shard and number, as text), start (offset in the bin)."""
    from . import common

    cut = common.materialize(pieces(docs, capacity, doc_id, text, source), "packing-pieces")  # written once, so row numbers stay as they are
    full, part = cut.filter(f"n_words = {capacity}"), cut.filter(f"n_words < {capacity}")
    shards = max(1, -(-part.count() // shard))

    def one(table: pa.Table) -> pa.Table:
        # ids pass as Arrow columns: no float ever stands in for them
        table = table.take(pc.sort_indices(table, [("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")]))
        bins, starts = pack(*(table.column(c).to_pylist() for c in ("n_words", "source", "cluster")), capacity, per_source)
        shard_of = table.column("shard")[0].as_py() if len(table) else 0
        made = {"bin": pa.array([f"{shard_of}-{b}" for b in bins], pa.string()), "start": pa.array(starts, pa.int32())}
        return pa.table({c: table.column(c) for c in ("doc_id", "piece", "n_words")} | made)

    kind = cut.schema["doc_id"].dataType.simpleString()
    dealt = part.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(shards)).cast("int"))
    filled = dealt.groupBy("shard").applyInArrow(one, f"doc_id {kind}, piece int, n_words int, bin string, start int")
    # a piece as long as a bin has one to itself: nothing to search
    alone = full.select("doc_id", "piece", "n_words", F.concat_ws("-", F.lit("full"), "row", "piece").alias("bin"), F.lit(0).alias("start"))
    rest = cut.filter("piece is null").select("doc_id", "piece", "n_words", F.lit(None).cast("string").alias("bin"), F.lit(None).cast("int").alias("start"))
    return filled.unionByName(alone).unionByName(rest)
