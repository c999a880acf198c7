"""Line dedup: lines found in many documents are dropped everywhere, by a sharded minimal perfect hash.

1. One row a block (some megabytes of texts): for each document its content key and the hashes of its distinct
   lines. Blocks are written; texts are not.
2. Documents are counted for each distinct line hash (128 bits). Within a block that has happened already, so a
   line that every document holds is sent once a block, not once a document.
3. Hashes are dealt into shards by one half of the hash. Each shard gets a minimal perfect hash (levels of bit
   arrays: a key settles at the first level where it is alone in its slot; its number is the rank of its bit)
   that indexes two arrays: fingerprints (the other half of the hash) and counts of documents.
4. The distinct hashes of a block go to the shards and probe the arrays; what reaches `least` documents returns to
   the block, which tells the documents by their content keys. No line is joined with lines. A shard that gets
   more than PROBES probes (a line in a third of all blocks) is probed in pieces, each with a copy of its arrays.
5. Documents meet what they have to drop by content key (equal texts drop the same). Texts move here alone, once; where the
   decisions are small, Spark broadcasts them by its own threshold and texts don't move at all.

A key is the line without white space [\\x20\\x09-\\x0D] at both ends, A-Z in lower case. Lines end at \\n. Null and
empty texts are one empty line; empty keys are never dropped. A document whose lines all go has an empty text.
A line repeated in one document counts that document once; repeated rows count as documents of their own,
whatever their id, so do rows with a null id. Very long texts: a text is split once, memory is some bytes for each
of its lines. Extra columns pass unchanged; columns named n_lines or n_dropped are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEAST = 10  # documents that hold a line before it is dropped
KEYS = 250_000  # hashes in a shard
PROBES = 1_000_000  # probes of a shard that one task takes
SPARE = 1.5  # slots of a level for each key that it is given
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def key_of(line: bytes) -> bytes:
    """bytes.strip and bytes.lower know ASCII alone: white space is 0x20 and 0x09 to 0x0D, letters are A-Z."""
    return line.strip().lower()


def hashes_of(lines: list[bytes]) -> np.ndarray:
    """n x 2 unsigned halves of each key's 128-bit hash; 0, 0 stands for the empty key."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) if k else bytes(16) for k in map(key_of, lines)]), np.uint64).reshape(-1, 2)


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (0, 0 left out) and how often each occurs."""
    pairs = pairs[pairs.any(axis=1)]
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    first = np.ones(len(pairs), bool)
    first[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    starts = np.flatnonzero(first)
    return pairs[starts], np.diff(np.append(starts, len(pairs)))


class Arrays:
    """Minimal perfect hash of distinct pairs, with their fingerprints and counts."""

    def __init__(self, sizes: list[int], bits: bytes, fingerprints: bytes, counts: bytes):
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes))
        self.rank = np.cumsum(self.bits, dtype=np.int64) - 1
        self.fingerprints, self.counts = np.frombuffer(fingerprints, np.uint64), np.frombuffer(counts, np.uint32)

    @staticmethod
    def slots(pairs: np.ndarray, level: int, size: int) -> np.ndarray:
        x = pairs[:, 0] ^ (pairs[:, 1] * np.uint64(2 * level + 1) + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def built(cls, pairs: np.ndarray, counts: np.ndarray) -> tuple[list[int], bytes, bytes, bytes]:
        """What the constructor takes, of distinct pairs."""
        with np.errstate(over="ignore"):
            sizes, levels, number, left, done = [], [], np.zeros(len(pairs), np.int64), np.arange(len(pairs)), 0
            while len(left):
                size = max(64, int(SPARE * len(left)))
                slot = cls.slots(pairs[left], len(sizes), size)
                alone = np.bincount(slot, minlength=size)[slot] == 1
                bits = np.zeros(size, np.uint8)
                bits[slot[alone]] = 1
                number[left[alone]] = done + np.cumsum(bits)[slot[alone]] - 1
                done += int(alone.sum())
                sizes.append(size)
                levels.append(bits)
                left = left[~alone]
        fingerprints, by_number = np.zeros(len(pairs), np.uint64), np.zeros(len(pairs), np.uint32)
        fingerprints[number], by_number[number] = pairs[:, 1], np.minimum(counts, 0xFFFFFFFF)
        packed = np.packbits(np.concatenate(levels)) if levels else np.zeros(0, np.uint8)
        return sizes, packed.tobytes(), fingerprints.tobytes(), by_number.tobytes()

    def numbers(self, pairs: np.ndarray) -> np.ndarray:
        """The number of each pair; -1 where no level has its bit. A pair that was not built in may get any number."""
        out, left, base = np.full(len(pairs), -1, np.int64), np.arange(len(pairs)), 0
        with np.errstate(over="ignore"):
            for level, size in enumerate(self.sizes):
                at = base + self.slots(pairs[left], level, size)
                found = self.bits[at] == 1
                out[left[found]] = self.rank[at[found]]
                left, base = left[~found], base + size
        return out

    def probe(self, pairs: np.ndarray) -> np.ndarray:
        """Documents of each pair; 0 where the fingerprint is another's."""
        at = self.numbers(pairs)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == pairs[known, 1]
        out = np.zeros(len(pairs), np.int64)
        out[known] = self.counts[at[known]]
        return out


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _signed(pairs: np.ndarray) -> list[np.ndarray]:
    return [np.ascontiguousarray(pairs[:, i]).view(np.int64) for i in (0, 1)]


def _pairs(table: pa.Table) -> np.ndarray:
    """h1 and h2 as n x 2 unsigned halves."""
    return np.stack([table.column(n).to_numpy().view(np.uint64) for n in ("h1", "h2")], axis=1)


def _texts(batch: pa.RecordBatch, text: str) -> list[bytes]:
    return [t or b"" for t in pc.cast(batch.column(batch.schema.get_field_index(text)), pa.binary()).to_pylist()]


def _blocks(docs: DataFrame) -> DataFrame:
    """block, c1 and c2 (content keys), sizes (distinct lines), h1 and h2 of all, document by document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "text")):
            if batch.num_rows:
                each = [_distinct(hashes_of(t.split(b"\n")))[0] for t in _texts(batch, "text")]
                halves = _signed(np.concatenate(each))
                columns = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array([len(e) for e in each], np.int32), *halves]
                yield pa.RecordBatch.from_arrays([pa.array([c], _INTS if c.dtype == np.int32 else _LONGS) for c in columns], names=["c1", "c2", "sizes", "h1", "h2"])

    keyed = docs.select(*_content_key("text"), "text")
    made = keyed.mapInArrow(run, "c1 array<long>, c2 array<long>, sizes array<int>, h1 array<long>, h2 array<long>")
    return common.materialize(made.withColumn("block", F.monotonically_increasing_id()), "lines-blocks")


def _content_key(text: str):
    return F.xxhash64(F.col(text)).alias("c1"), F.xxhash64(F.lit("second"), F.col(text)).alias("c2")


def _lists(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and pairs of each row's lists h1 and h2."""
    for i in range(batch.num_rows):
        yield i, np.stack([batch.column(n)[i].values.to_numpy().view(np.uint64) for n in ("h1", "h2")], axis=1)


def _probes(blocks: DataFrame) -> DataFrame:
    """block, h1, h2, n: each distinct hash of a block and how many of its documents hold it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, pairs in _lists(batch):
                found, n = _distinct(pairs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch.column("block")[i].as_py())), *map(pa.array, _signed(found)), pa.array(n)], names=["block", "h1", "h2", "n"])

    return blocks.select("block", "h1", "h2").mapInArrow(run, "block long, h1 long, h2 long, n long")


def counted(blocks: DataFrame) -> DataFrame:
    """h1, h2, docs, blocks."""
    return common.materialize(_probes(blocks).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.count("*").alias("blocks")), "lines-counts")


def indexed(counts: DataFrame, shards: int) -> DataFrame:
    """One row a shard: shard, sizes, bits, fingerprints, counts (see Arrays)."""

    def build(table: pa.Table) -> pa.Table:
        sizes, *arrays = Arrays.built(_pairs(table), table.column("docs").to_numpy())
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "sizes": pa.array([sizes], _INTS)} | {n: pa.array([a], pa.binary()) for n, a in zip(("bits", "fingerprints", "counts"), arrays, strict=True)})

    keyed = counts.select(F.pmod("h1", F.lit(shards)).alias("shard"), "h1", "h2", "docs")
    return common.materialize(keyed.groupBy("shard").applyInArrow(build, "shard long, sizes array<int>, bits binary, fingerprints binary, counts binary"), "lines-index")


def _answers(blocks: DataFrame, index: DataFrame, counts: DataFrame, shards: int, least: int, probes: int) -> DataFrame:
    """block, h1, h2 of the lines of a block that `least` documents hold."""

    def probe(arrays: pa.Table, asked: pa.Table) -> pa.Table:
        kept = pa.array([], pa.int64())
        if arrays.num_rows and asked.num_rows:
            row = arrays.slice(0, 1).to_pylist()[0]
            docs = Arrays(row["sizes"], row["bits"], row["fingerprints"], row["counts"]).probe(_pairs(asked))
            kept = pa.array(np.flatnonzero(docs >= least))
        return asked.select(["block", "h1", "h2"]).take(kept)

    shard = F.pmod("h1", F.lit(shards)).alias("shard")
    # shards that would get more than one task takes; few, so Spark's own threshold decides how they are joined
    hot = common.materialize(counts.groupBy(shard).agg(F.ceil(F.sum("blocks") / probes).alias("pieces")).filter("pieces > 1"), "lines-hot")
    asked = _probes(blocks).select("block", "h1", "h2", shard).join(hot, "shard", "left").withColumn("piece", F.pmod("block", F.coalesce("pieces", F.lit(1)))).drop("pieces")
    arrays = index.join(hot, "shard", "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return arrays.groupBy("shard", "piece").cogroup(asked.groupBy("shard", "piece")).applyInArrow(probe, "block long, h1 long, h2 long")


def _decisions(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """c1, c2, drops (hashes as bytes, 16 each): one row for each distinct text that loses lines."""

    def tell(block: pa.Table, hits: pa.Table) -> pa.Table:
        c1, c2, drops = [], [], []
        if hits.num_rows:
            wanted = np.sort(_complex(_pairs(hits)))
            for i, pairs in _lists(block):
                gone = _member(_complex(pairs), wanted)
                ends = np.cumsum(block.column("sizes")[i].values.to_numpy())
                keys = [block.column(n)[i].values.to_numpy() for n in ("c1", "c2")]
                for doc, (a, b) in enumerate(zip(np.append(0, ends[:-1]), ends, strict=True)):
                    if gone[a:b].any():
                        c1.append(keys[0][doc])
                        c2.append(keys[1][doc])
                        drops.append(pairs[a:b][gone[a:b]].tobytes())
        return pa.table({"c1": pa.array(c1, pa.int64()), "c2": pa.array(c2, pa.int64()), "drops": pa.array(drops, pa.binary())})

    told = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(tell, "c1 long, c2 long, drops binary")
    return common.materialize(told.groupBy("c1", "c2").agg(F.first("drops").alias("drops")), "lines-decisions")


def _complex(pairs: np.ndarray) -> np.ndarray:
    """Pairs as one sortable value each."""
    return np.ascontiguousarray(pairs).view([("a", np.uint64), ("b", np.uint64)]).reshape(-1)


def _member(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the sorted wanted ones."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    return wanted[np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)] == values


def _without(text: bytes, drops: bytes | None) -> tuple[bytes, int, int]:
    lines = text.split(b"\n")
    if not drops:
        return text, len(lines), 0
    gone = _member(_complex(hashes_of(lines)), np.sort(_complex(np.frombuffer(drops, np.uint64).reshape(-1, 2))))
    return b"\n".join([line for line, g in zip(lines, gone.tolist(), strict=True) if not g]), len(lines), int(gone.sum())


def deduplicated(docs: DataFrame, least: int = LEAST, text: str = "text", keys: int = KEYS, probes: int = PROBES) -> DataFrame:
    """docs with text without the lines that at least `least` documents hold, n_lines (before dropping) and n_dropped."""
    kept = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    blocks = _blocks(docs.select(F.col(text).alias("text")))
    counts = counted(blocks)
    shards = max(1, -(-counts.count() // keys))
    index = indexed(counts, shards)
    decisions = _decisions(blocks, _answers(blocks, index, counts, shards, least, probes))
    for table in (counts, index, blocks):
        common.superseded(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, f"v{at}")):
            done = [_without(t, d) for t, d in zip(_texts(batch, f"v{at}"), batch.column("drops").to_pylist(), strict=True)]
            columns = [batch.column(f"v{i}") for i in range(len(kept))]
            columns[at] = pa.array([t for t, _, _ in done], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([d[i] for d in done], pa.int64()) for i in (1, 2)]], names=[*[f.name for f in kept], "n_lines", "n_dropped"])

    at = [f.name for f in kept].index(text)
    # neutral names on the way, so that no column of docs clashes
    plain = docs.select(*[F.col(f"`{f.name}`").alias(f"v{i}") for i, f in enumerate(kept)], *_content_key(f"`{text}`"))
    joined = plain.join(decisions, ["c1", "c2"], "left").drop("c1", "c2")
    return joined.mapInArrow(run, T.StructType([*kept, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))
