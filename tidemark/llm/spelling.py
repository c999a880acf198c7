"""Spelling variants: words that differ by one code point, found by rolling-hash deletion keys.

1. Words are counted, slice by slice in each task and then over all.
2. Each word gets an integer key for every deletion of one code point: the polynomial hash of what stands before
   it, plus that of what stands after it moved down by one power. All keys of a batch of words come from one
   cumulative sum. Replacement: two words of one length share the key of the same place. Insertion: a word's own
   key equals a deletion key of the longer word.
3. Keys are radix-partitioned by their highest bits; a partition sorts its keys, and what shares its key with nothing goes.
4. What is left gets its strings, and groups form by the remaining string itself, so equal keys of different strings don't
   count. A replacement group has at most as many words as the alphabet has letters, and tells each member the
   two most frequent ones and its size: never all pairs.
5. Forms point to words at least FACTOR times as frequent, so they can't run in circles; pointers are doubled until nothing changes.

Words are runs of LETTERS in texts with A-Z in lower case. Null and empty texts have none; a null id counts as an
empty one in the checksum. Very long texts are read in parts; a very long word has keys as any other, made in parts. Repeated rows count again.
Ties between forms go to the smaller word in code-point order. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHORTEST, LEAST, FACTOR, EVERY = 7, 2, 10, 31
#: A-Z (in lower case by then), a-z and U+00C0 to U+00FF, in UTF-8.
LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"
PART = 1 << 20  # bytes of a text that are searched at once
HELD = 200_000  # words that a task counts before it sends them on
CHUNK = 1 << 20  # code points whose keys are made at once
PARTITION = 500_000  # keys that one task sorts

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
REPLACED, SHORTENED, WHOLE = 0, 1, 2


def _runs(text: bytes, shortest: int) -> Iterator[list[bytes]]:
    """Maximal runs of at least `shortest` letters, part by part; parts end at an ASCII character that is no letter."""
    found, end = re.compile(LETTER + rb"{%d,}" % shortest), re.compile(rb"[\x00-\x60\x7b-\x7f]")
    low, at = text.lower(), 0  # bytes.lower knows A-Z alone
    while at < len(low):
        stop = end.search(low, min(len(low), at + PART))
        stop = stop.start() if stop else len(low)
        yield found.findall(low, at, stop)
        at = max(stop, at + 1)


def words_of(doc_id: str, text: bytes, shortest: int = SHORTEST, every: int = EVERY) -> Counter:
    """Words of a text and how often they occur; where `every` divides the checksum of id and run, the run loses a code point."""
    runs: Counter = Counter()
    for part in _runs(text, shortest):
        runs.update(part)
    out: Counter = Counter()
    start = crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h, word = crc32(run, start), run.decode()
        if h % every == 0:
            i = h % len(word)
            word = word[:i] + word[i + 1 :]
            if len(word) < shortest:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """word, n: words with at least `least` occurrences."""

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in (part for whole in batches for part in common.slices(whole, "text")):
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                held.update(words_of(i or "", t or b"", shortest))
            if len(held) > HELD:
                yield rows(held)
                held = Counter()
        yield rows(held)

    narrow = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(0, n - 1), _BASE, np.uint64)), dtype=np.uint64)[:n]


def _keys(codes: np.ndarray, place: np.ndarray, power: np.ndarray, before: np.ndarray, total: np.ndarray, new_run: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys of the deletions at the given places: (keys of replacement, keys of shortening where a run of equal code points starts).

    before: hash of the word's code points before each place; total: hash of the whole word."""
    value = _mixed(codes.astype(np.uint64) + np.uint64(1)) * power
    left = before + (total - before - value) * _BACK
    return _mixed(left + _mixed(place.astype(np.uint64) * np.uint64(2) + np.uint64(1))), _mixed(left)[new_run]


def deletion_keys(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For a list of words, in parts: (key, number of the word in the list, place, kind).

    Kinds: REPLACED (shared by words that differ at that place alone), SHORTENED (the rest after a deletion; once for a
    run of equal code points, whose deletions leave the same) and WHOLE (the word itself)."""
    with np.errstate(over="ignore"):
        short = [i for i, w in enumerate(words) if len(w) <= CHUNK]
        codes = np.frombuffer("".join([words[i] for i in short]).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(words[i]) for i in short], np.int64)
        if len(short):
            word = np.repeat(np.arange(len(short)), sizes)
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(codes)) - np.repeat(starts, sizes)
            power = _powers(int(sizes.max(initial=1)))[place]
            ends = np.append(np.uint64(0), np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64))
            total = ends[starts + sizes] - ends[starts]
            fresh = np.append(True, codes[1:] != codes[:-1])[: len(codes)] | (place == 0)
            numbers = np.array(short)
            replaced, shortened = _keys(codes, place, power, ends[:-1] - ends[starts][word], total[word], fresh)
            yield replaced, numbers[word], place, np.full(len(codes), REPLACED)
            yield shortened, numbers[word][fresh], place[fresh], np.full(int(fresh.sum()), SHORTENED)
            yield _mixed(total), numbers, np.full(len(numbers), -1), np.full(len(numbers), WHOLE)
        for i in set(range(len(words))) - set(short):
            yield from _long_keys(words[i], i)


def _long_keys(word: str, number: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """As deletion_keys, for one word, a chunk at a time: first its hash, then the keys."""
    powers = _powers(CHUNK)

    def chunks() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for at in range(0, len(word), CHUNK):
            codes = np.frombuffer(word[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)
            yield at, codes, powers[: len(codes)] * np.uint64(pow(_BASE, at, 1 << 64))

    total = np.uint64(0)
    for _, codes, power in chunks():
        total = total + np.sum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)
    before, last = np.uint64(0), -1
    for at, codes, power in chunks():
        value = np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)
        fresh = np.append(int(codes[0]) != last, codes[1:] != codes[:-1])
        place = np.arange(at, at + len(codes))
        replaced, shortened = _keys(codes, place, power, before + np.append(np.uint64(0), value[:-1]), np.full(len(codes), total), fresh)
        yield replaced, np.full(len(codes), number), place, np.full(len(codes), REPLACED)
        yield shortened, np.full(int(fresh.sum()), number), place[fresh], np.full(int(fresh.sum()), SHORTENED)
        before, last = before + value[-1], int(codes[-1])
    yield _mixed(np.array([total])), np.array([number]), np.array([-1]), np.array([WHOLE])


def shared(keys: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Row numbers of the keys that may mean a link: two replacements, or a shortened and a whole word, of one key."""
    whole = kinds != REPLACED
    order = np.lexsort((whole, keys))
    k, w = keys[order], whole[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
    group = np.cumsum(first) - 1
    size = np.bincount(group) if len(group) else np.zeros(0, int)
    wholes = np.bincount(group, kinds[order] == WHOLE) if len(group) else size
    kept = np.where(w, (wholes[group] > 0) & (wholes[group] < size[group]), size[group] > 1)
    return order[kept]


def candidates(words: DataFrame, partition: int = PARTITION) -> DataFrame:
    """wid, place, kind, key of words (wid, word) whose key another word shares."""

    def make(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in common.slices(whole, "word", CHUNK)):
            ids = batch.column(0).to_numpy()
            for key, number, place, kind in deletion_keys(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[number]), pa.array(place.astype(np.int32)), pa.array(kind.astype(np.int8))], names=["key", "wid", "place", "kind"])

    def sort(table: pa.Table) -> pa.Table:
        kept = shared(table.column("key").to_numpy(), table.column("kind").to_numpy())
        return table.select(["wid", "place", "kind", "key"]).take(pa.array(kept))

    many = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    bits = max(1, (-(-many // partition) - 1).bit_length())
    made = words.select("wid", "word").mapInArrow(make, "key long, wid long, place int, kind byte")
    return made.withColumn("radix", F.shiftrightunsigned("key", 64 - bits)).groupBy("radix").applyInArrow(sort, "wid long, place int, kind byte, key long")


def near(words: DataFrame, partition: int = PARTITION) -> DataFrame:
    """wid, n_near, best (struct of minus n, word) of words (wid, word, n) that have a near word."""
    rest = F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    found = candidates(words, partition).join(words, "wid").withColumn("rest", rest).select("key", "kind", "place", "rest", "wid", F.struct((-F.col("n")).alias("less"), "word").alias("me"))
    found = common.materialize(found, "spelling-candidates")
    # strings decide: a group is the words that leave the same rest at the same place, at most one for each letter
    groups = found.filter(F.col("kind") == REPLACED).groupBy("key", "place", "rest").agg(F.array_sort(F.collect_list(F.struct("me", "wid"))).alias("all")).filter(F.size("all") > 1)
    each = groups.select(F.size("all").alias("size"), F.slice("all", 1, 2).alias("top"), F.explode("all").alias("one"))
    replaced = each.select(F.col("one.wid").alias("wid"), (F.col("size") - 1).cast("long").alias("links"), F.when(F.col("top")[0]["wid"] == F.col("one.wid"), F.col("top")[1]["me"]).otherwise(F.col("top")[0]["me"]).alias("best"))
    long, short = (found.filter(F.col("kind") == k).select("key", "rest", F.col("wid").alias(f"{n}_wid"), F.col("me").alias(n)) for k, n in ((SHORTENED, "long"), (WHOLE, "short")))
    links = long.join(short, ["key", "rest"])
    sides = [links.select(F.col(f"{a}_wid").alias("wid"), F.lit(1).cast("long").alias("links"), F.col(b).alias("best")) for a, b in (("long", "short"), ("short", "long"))]
    return replaced.unionByName(sides[0]).unionByName(sides[1]).groupBy("wid").agg(F.sum("links").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following the forms ends. forms: word, form, without circles; each round doubles the steps."""
    at = common.materialize(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = common.materialize(at.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if not moved.filter("moved").take(1):
            return moved.drop("moved")
        common.superseded(at)
        at = moved.drop("moved")


def variants(words: DataFrame, factor: int = FACTOR, partition: int = PARTITION) -> DataFrame:
    """word, form, root, n, n_near, form_n, of distinct words (word, n)."""
    table = common.materialize(words.select("word", "n").withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
    much = -F.col("best.less") >= factor * F.col("n")
    whole = table.join(near(table, partition), "wid", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("best.word")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"))
    whole = common.materialize(whole, "spelling-forms")
    last = roots(whole.filter("form is not null"))
    return whole.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
