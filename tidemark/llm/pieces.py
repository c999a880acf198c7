"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is cut into units wherever the two characters at a place stand side by side in no piece of the
vocabulary, so that no piece crosses the cut. Arrow numbers the distinct units of a batch; those not known yet
are encoded once each: they advance together, position by position, the longest first. At each position the
hashes of all substrings that end there probe the sorted hashes of the pieces; maxima over the lengths give
the best last piece. For unigram models the maximum is over sums of scores. For BPE models a step is allowed
only if the merges would keep the two pieces side by side (the pair, encoded alone, gives the same two
pieces); the one path of allowed steps is then what the merges give, so ids equal those of the merge procedure.

Characters outside the vocabulary become their UTF-8 bytes if the model has byte pieces, else the unknown
id. Decoding joins pieces and bytes and takes the first space away; texts that hold the space mark itself
come back with a space in its place, as the marks stand for spaces. Null texts give null ids; empty ones no
ids. Only models without a normalisation table are read (others raise ValueError).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common
from .textvec import AlignedHash, SpanHash, chunks, codes_of

MARK = "▁"
CACHE = 1_000_000  # units remembered by each worker
_HELD = 16_000_000  # and their code points at most
_PAIRS = 1 << 21  # slots for what is known of pairs of pieces
_TEXT = 3_000_000  # code points encoded at once
_BLOCK = 1 << 18  # code points looked at for cuts at once
_GROUP = 4_000  # units that advance together at most
_SIEVE, _JOINS, _BUCKETS = 20, 20, 18  # bits of the tables that say where hashes may lie
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


def _slot(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """A place in a table of so many bits for each pair of 32-bit numbers."""
    with np.errstate(over="ignore"):
        return ((first.astype(np.uint32) * np.uint32(0x9E3779B1)) ^ (second.astype(np.uint32) * np.uint32(0x85EBCA77))) >> np.uint32(32 - bits)


def _fields(data: bytes):
    """(number, value) of the fields of one protocol-buffer message: integers, or bytes for anything longer."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file; small (a few MB), so it is sent to the executors as it is."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.bpe, self.prefix = False, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.kinds.append(f.get(3, _NORMAL))
            elif number == 2:
                self.bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                f = dict(_fields(value))
                self.prefix = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1):
                    raise ValueError("the model normalises texts; only identity normalisation that keeps spaces is supported")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.byte_ids = [0] * 256
        self.has_bytes = False
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == _BYTE:
                self.byte_ids[int(p[3:5], 16)], self.has_bytes = i, True
        usable = [i for i, k in enumerate(self.kinds) if k in (_NORMAL, _USER)]
        self.rank = {self.pieces[i]: self.scores[i] for i in usable}
        self.longest = max(map(len, self.rank), default=1)
        self.id_of = {self.pieces[i]: i for i in usable}
        codes = np.frombuffer("".join(self.pieces[i] for i in usable).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(self.pieces[i]) for i in usable])
        keys = SpanHash(codes)(ends - [len(self.pieces[i]) for i in usable], ends)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ids = keys[order], np.array(usable, np.int32)[order]
        self.sieve = np.zeros(1 << _SIEVE, bool)  # keys' low bits: most substrings end here
        self.sieve[(keys & np.uint64((1 << _SIEVE) - 1)).astype(np.int64)] = True
        # where the keys of each value of the high bits begin, and how many there are at most
        high = (self.keys >> np.uint64(64 - _BUCKETS)).astype(np.int64)
        self.first = np.minimum(np.searchsorted(high, np.arange(1 << _BUCKETS)), max(0, keys.size - 1)).astype(np.int32)
        self.most = int(np.bincount(high).max(initial=0))
        # characters of pieces that are no pieces themselves have numbers after those of the pieces
        self.inner = sorted({c for p in self.rank for c in p} - self.id_of.keys())
        self.number = self.id_of | {c: len(self.pieces) + i for i, c in enumerate(self.inner)}
        total = len(self.pieces) + len(self.inner)
        # one entry more: any character outside the vocabulary
        self.size = np.ones(total + 1, np.int32)
        for p, i in self.number.items():
            self.size[i] = len(p)
        beside = sorted({p[i : i + 2] for p in self.rank for i in range(len(p) - 1)})
        self.joins = np.zeros(1 << _JOINS, bool)  # pairs of characters side by side in a piece; a few others too
        if beside:
            two = np.frombuffer("".join(beside).encode("utf-32-le"), np.uint32)
            self.joins[_slot(two[::2], two[1::2], _JOINS)] = True
        if self.bpe:
            self._merges(total)
        self.out = [p.replace(MARK, " ").encode() if k in (_NORMAL, _USER) else bytes([int(p[3:5], 16)]) if k == _BYTE else b" \xe2\x81\x87 " if k == _UNKNOWN else b"" for p, k in zip(self.pieces, self.kinds, strict=True)]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the merge procedure joins last to make the piece; None if it never makes it."""
        parts, made = list(piece), None
        while len(parts) > 1:
            best, at = max(((self.rank.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == -np.inf:
                return None
            made = (parts[-at], parts[1 - at])
            parts[-at : 2 - at] = ["".join(made)]
        return made

    def _merges(self, total: int) -> None:
        """Tables by number of a piece or character: the parts last merged, the score of that merge (inf: no merge makes it), and scores of all pairs that merge."""
        self.left, self.right = np.full(total + 1, -1, np.int32), np.full(total + 1, -1, np.int32)
        self.made = np.ones(total + 1, bool)
        self.merged = np.full(total + 1, np.inf)
        pairs: dict[int, float] = {}
        for p, score in self.rank.items():
            if len(p) > 1:
                i, parts = self.id_of[p], self._last_merge(p)
                self.made[i] = parts is not None
                if parts is not None:
                    self.left[i], self.right[i], self.merged[i] = self.number[parts[0]], self.number[parts[1]], score
                for k in range(1, len(p)):
                    a, b = self.number.get(p[:k]), self.number.get(p[k:])
                    if a is not None and b is not None:
                        pairs[a << 32 | b] = score
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_scores = np.array([pairs[k] for k in self.pair_keys.tolist()] + [-np.inf])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The pieces of these hashes; -1 where there is none."""
        at = self.first[(hashes >> np.uint64(64 - _BUCKETS)).astype(np.int64)]
        for _ in range(self.most - 1):
            at = at + (self.keys[at] < hashes)
            at = np.minimum(at, self.keys.size - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], np.int32(-1))

    def stay(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges keep the pieces side by side (left -1: nothing stands before): no merge across the border comes before those that make them.

        The later of the two last merges is taken back, again and again; what then stands at the border
        must not be worth merging sooner. Of equal merges the left one comes first."""
        left, right = np.minimum(left, self.size.size - 1).astype(np.int64), np.minimum(right, self.size.size - 1).astype(np.int64)
        out = self.made[right] & ((left < 0) | self.made[left])
        rows = np.flatnonzero(out & (left >= 0))
        left, right = left[rows], right[rows]
        sooner, open_end = np.full(rows.size, -np.inf), np.zeros(rows.size, bool)  # open_end: a merge as good as `sooner` also comes before
        while rows.size and self.pair_keys.size:
            pair = left << 32 | right
            at = np.minimum(np.searchsorted(self.pair_keys, pair), self.pair_keys.size - 1)
            across = np.where(self.pair_keys[at] == pair, self.pair_scores[at], -np.inf)
            lost = (across > sooner) | open_end & (across == sooner)
            out[rows[lost]] = False
            a, b = self.merged[left], self.merged[right]
            from_left = a < b
            left, right = np.where(from_left, self.right[left], left), np.where(from_left, right, self.left[right])
            sooner, open_end = np.minimum(a, b), ~from_left
            on = ~lost & (sooner < np.inf)
            rows, left, right, sooner, open_end = rows[on], left[on], right[on], sooner[on], open_end[on]
        return out

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())


class Coder:
    """Encodes and decodes with one model; keeps what it has learnt about units and pairs of pieces."""

    def __init__(self, model: Model):
        self.m = model
        self.extra_chars = list(model.inner)  # code points that are no pieces: ids from len(pieces) on
        self.extra = {ord(c): len(model.pieces) + i for i, c in enumerate(self.extra_chars)}
        self.pairs = np.full(_PAIRS, -1, np.int64)
        self.scores = np.array(model.scores)
        self.low = min(model.scores, default=0.0) - 10.0
        self.out = pa.array(model.out, pa.binary())
        self._forget()

    def _forget(self) -> None:
        self.units: dict[bytes, int] = {}  # numbers of units, by their code points
        self.held = 0
        self.ids, self.starts = np.zeros(1 << 16, np.int32), np.zeros(CACHE + 2, np.int64)  # unit i has ids[starts[i]:starts[i + 1]]

    def _allowed(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether `token` may follow `before` (-1: nothing stands before it)."""
        code = (before + 1).astype(np.int64) << 32 | token
        slot = _slot(before, token, _PAIRS.bit_length() - 1)
        known = self.pairs[slot]
        out = (known & 1).astype(bool)
        miss = np.flatnonzero(known >> 1 != code)
        if miss.size:
            out[miss] = flags = self.m.stay(before[miss], token[miss])
            self.pairs[slot[miss]] = code[miss] << 1 | flags
        return out

    def _outside(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of code points that are no pieces."""
        kinds, where = np.unique(codes, return_inverse=True)
        for c in kinds.tolist():
            if c not in self.extra:
                self.extra[c] = len(self.m.pieces) + len(self.extra_chars)
                self.extra_chars.append(chr(c))
        return np.array([self.extra[c] for c in kinds.tolist()], np.int32)[where]

    def _viterbi(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and how many each has; codes: positions by units, lengths: falling."""
        m, (length, count) = self.m, codes.shape
        span = AlignedHash(codes)
        last = np.full((length + 1, count), -2, np.int32)  # the piece that ends here on the best path; -2: no path
        last[0] = -1
        best = np.zeros((length + 1, count)) if not m.bpe else None
        reach = np.searchsorted(-lengths, -np.arange(length + 1), "right").tolist()  # how many units are so long
        for end in range(1, length + 1):
            n, shorter = reach[end], np.arange(min(end, m.longest))  # sizes less one
            h = span(end - 1 - shorter, end, n).ravel()
            hit = np.flatnonzero(m.sieve[(h & np.uint64((1 << _SIEVE) - 1)).astype(np.int64)])
            token = m.find(h[hit])
            hit, token = hit[token >= 0], token[token >= 0]
            if np.searchsorted(hit, n) < n:  # characters that are no pieces
                alone = np.ones(n, bool)
                alone[hit[: np.searchsorted(hit, n)]] = False
                alone = np.flatnonzero(alone)
                hit, token = np.concatenate((alone, hit)), np.concatenate((self._outside(codes[end - 1, alone]), token))
            j, i = np.divmod(hit.astype(np.int32), np.int32(n))
            before = last[end - 1 - j, i]
            if m.bpe:
                good = np.flatnonzero(before > -2)
                good = good[self._allowed(before[good], token[good])][::-1]
            else:
                score = best[end - 1 - j, i] + np.where(token < self.scores.size, self.scores[np.minimum(token, self.scores.size - 1)], self.low)
                good = np.lexsort((-j, score))  # of equal sums the shortest piece; what is written last stays
                best[end, i[good]] = score[good]
            last[end, i[good]] = token[good]
        every = np.arange(count)
        if (last[lengths, every] < 0).any():
            raise AssertionError("no path through a unit")
        # all paths walk back together; column k holds the k-th piece from the end
        at, columns = lengths, []
        while at.any():
            columns.append(last[at, every])
            at = np.where(at > 0, at - m.size[np.minimum(columns[-1], m.size.size - 1)], 0)
        path = np.stack(columns[::-1], axis=1)
        return self._spelled(path[path >= 0], (path >= 0).sum(axis=1))

    def _spelled(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with what stands for characters outside the vocabulary replaced by byte pieces or the unknown id."""
        strange = np.flatnonzero(ids >= len(self.m.pieces))
        if not strange.size:
            return ids, sizes
        kinds, where = np.unique(ids[strange], return_inverse=True)
        texts = [self.extra_chars[t - len(self.m.pieces)].encode("utf-8", "surrogatepass") for t in kinds.tolist()]
        spelled = [[self.m.byte_ids[b] for b in t] if self.m.has_bytes else [self.m.unknown] for t in texts]
        count = np.ones(ids.size, np.int64)
        count[strange] = np.array([len(x) for x in spelled])[where]
        out = np.repeat(ids, count)
        start = (np.cumsum(count) - count)[strange]
        for k in range(4):
            long = np.flatnonzero(count[strange] > k)
            out[start[long] + k] = np.array([x[k] if k < len(x) else 0 for x in spelled], np.int32)[where[long]]
        return out, np.add.reduceat(count, np.cumsum(sizes) - sizes)

    def _learn(self, units: list[bytes]) -> None:
        units = sorted(units, key=len, reverse=True)
        lengths = np.array([len(u) for u in units], np.int64) // 4
        i = 0
        while i < len(units):
            some = units[i : i + max(1, min(_GROUP, 400_000 // int(lengths[i])))]
            size = lengths[i : i + len(some)]
            i += len(some)
            codes = np.zeros((len(some), int(size[0])), np.uint32)
            codes[np.arange(size[0]) < size[:, None]] = np.frombuffer(b"".join(some), np.uint32)
            ids, sizes = self._viterbi(np.ascontiguousarray(codes.T), size)
            have, n = int(self.starts[len(self.units)]), len(self.units)
            while self.ids.size < have + ids.size:
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            if self.starts.size < n + len(some) + 1:
                self.starts = np.concatenate((self.starts, np.zeros(n + len(some), np.int64)))
            self.ids[have : have + ids.size] = ids
            self.starts[n + 1 : n + len(some) + 1] = have + np.cumsum(sizes)
            self.units.update(zip(some, range(n, n + len(some)), strict=True))
            self.held += int(size.sum())

    def _borders(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where units start, and the end."""
        border = np.ones(codes.size + 1, bool)
        for i in range(1, codes.size, _BLOCK):
            to = min(i + _BLOCK, codes.size)
            np.logical_not(self.m.joins[_slot(codes[i - 1 : to - 1], codes[i:to], _JOINS)], out=border[i:to])
        border[starts] = True
        return np.flatnonzero(border)

    def _ids_of_units(self, codes: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and how many each has."""
        buffers = [None, pa.py_buffer((borders * 4).astype(np.int32)), pa.py_buffer(codes)]
        coded = pa.Array.from_buffers(pa.binary(), borders.size - 1, buffers).dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = list(map(self.units.get, kinds))
        fresh = [u for u, i in zip(kinds, number, strict=True) if i is None]
        if len(self.units) + len(fresh) > CACHE or self.held + sum(map(len, fresh)) // 4 > _HELD:
            self._forget()
            number, fresh = [None] * len(kinds), kinds
        self._learn(fresh)
        number = [self.units[u] if i is None else i for u, i in zip(kinds, number, strict=True)]
        unit = np.array(number, np.int64)[coded.indices.to_numpy()]
        start = self.starts[unit]
        size = self.starts[unit + 1] - start
        ends = np.cumsum(size)
        return self.ids[np.repeat(start - ends + size, size) + np.arange(ends[-1])], size

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text starts (one entry more than texts)."""
        codes, starts = codes_of([(MARK if self.m.prefix else "") + t.replace(" ", MARK) if t else "" for t in texts])
        borders = self._borders(codes, starts)
        # a long text is worked on in parts: runs of whole units
        steps = np.unique(np.append(np.searchsorted(borders, np.arange(0, codes.size, _TEXT)), borders.size - 1)).tolist()
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for low, high in zip(steps, steps[1:], strict=False):
            some, size = self._ids_of_units(codes[borders[low] : borders[high]], borders[low : high + 1] - borders[low])
            ids.append(some)
            sizes.append(size)
        return np.concatenate(ids), np.cumsum(np.concatenate(sizes))[np.searchsorted(borders, starts)]

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        out: list[list[int] | None] = []
        for _, part in chunks(["" if t is None else t for t in texts], _TEXT):
            ids, starts = self.flat(part)
            at = starts.tolist()
            out += [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
        return [None if t is None else ids for t, ids in zip(texts, out, strict=True)]

    def _plain(self, data: bytes) -> str:
        text = data.decode("utf-8", "replace")
        return text[1:] if self.m.prefix and text.startswith(" ") else text

    def decode(self, ids: list[int] | None) -> str | None:
        return None if ids is None else self._plain(b"".join([self.m.out[i] for i in ids]))

    def decode_flat(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The texts of ids that lie one after the other."""
        parts = self.out.take(pa.array(ids))
        at = np.frombuffer(parts.buffers()[1], np.int32)[starts + parts.offset].tolist()
        data = memoryview(parts.buffers()[2] or b"")
        return [self._plain(bytes(data[a:b])) for a, b in zip(at, at[1:], strict=False)]


_coders: dict[str, Coder] = {}


def coder_of(shared) -> Coder:
    """One coder for each broadcast model and worker process, so that batches and tasks share what it has learnt."""
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(shared.value)
    return _coders[shared.id]


class _Shared:
    """A broadcast with a key that stays the same in a worker."""

    def __init__(self, spark, model: Model):
        self.box = spark.sparkContext.broadcast(model)
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> Model:
        return self.box.value

    def __getstate__(self):
        return {"box": self.box, "id": self.id}


def encoded(docs: DataFrame, model: Model, text: str = "text", column: str = "ids") -> DataFrame:
    """docs with the ids of the text (array<int>)."""
    shared = _Shared(docs.sparkSession, model)
    return common.with_columns_of_text(docs, text, [(column, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], lambda x: [coder_of(shared).encode(x)])


def decoded(docs: DataFrame, model: Model, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """docs with the text of the ids."""
    shared = _Shared(docs.sparkSession, model)
    return common.with_columns_of_text(docs, ids, [(column, T.StringType(), pa.string())], lambda x: [[coder_of(shared).decode(i) for i in x]])


def digests(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 (of the ids as 32-bit little-endian) and round_trip (decoding gives the text back); null texts: nulls."""
    import hashlib

    shared = _Shared(docs.sparkSession, model)

    def work(texts: list[str | None]) -> list[list]:
        coder, n, digest, same = coder_of(shared), [], [], []
        for begin, part in chunks(["" if t is None else t for t in texts], _TEXT):
            ids, starts = coder.flat(part)
            at, data = starts.tolist(), memoryview(ids.astype("<i4", copy=False)).cast("B")
            for i, (back, a, b) in enumerate(zip(coder.decode_flat(ids, starts), at, at[1:], strict=False)):
                known = texts[begin + i] is not None
                n.append(b - a if known else None)
                digest.append(hashlib.sha256(data[4 * a : 4 * b]).hexdigest() if known else None)
                same.append(back == part[i] if known else None)
        return [n, digest, same]

    return common.with_columns_of_text(docs, text, [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("round_trip", T.BooleanType(), pa.bool_())], work, keep_text=False)
