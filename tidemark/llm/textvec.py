"""Whole batches of texts as one numpy array of code points: words, rolling hashes, runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

CHUNK = 200_000  # code points worked on at once

_flags: dict[str, np.ndarray] = {}


def char_table(kind: str) -> np.ndarray:
    """For each code point below 0x10000, whether str's method `kind` (isalnum, isalpha) holds; the last entry stands for all above."""
    if kind not in _flags:
        _flags[kind] = np.array([getattr(chr(i), kind)() for i in range(0x10000)] + [False])
    return _flags[kind]


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of the texts, one after the other, and where each text starts (one entry more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in pieces of about `limit` code points; texts stay whole."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def cut_long(texts: list[str], limit: int = CHUNK, at: Callable[[str, int, int], int] | None = None) -> tuple[list[str], np.ndarray]:
    """The texts with long ones in parts of at most `limit` code points, and the text that each part is of, so that no array grows with one text.

    at(text, low, high) says where to cut between low and high; without it the cut is at high."""
    parts: list[str] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        start = 0
        while len(t) - start > limit:
            end = at(t, start + limit // 2, start + limit) if at else start + limit
            parts.append(t[start:end])
            owner.append(i)
            start = end
        parts.append(t[start:])
        owner.append(i)
    return parts, np.array(owner, np.int64)


def between_words(text: str, low: int, high: int) -> int:
    """The last place between low and high where a word (letters and digits) ends; high inside a longer one."""
    for i in range(high - 1, low - 1, -1):
        if not text[i].isalnum():
            return i + 1
    return high


def flags_of(codes: np.ndarray, kind: str) -> np.ndarray:
    flags = char_table(kind)[np.minimum(codes, 0x10000)]
    if (high := np.flatnonzero(codes >= 0x10000)).size:
        flags[high] = [getattr(chr(c), kind)() for c in codes[high].tolist()]
    return flags


def runs_of(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in mask, cut where a text starts."""
    if not mask.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(mask.size + 1, bool)
    cut[starts] = True
    before = np.concatenate(([False], mask[:-1]))
    after = np.concatenate((mask[1:], [False]))
    return np.flatnonzero(mask & (~before | cut[:-1])), np.flatnonzero(mask & (~after | cut[1:])) + 1


def sums_between(values: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Sums of values[low:high]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[highs] - total[lows]


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or have.size < n:
        have = np.ones(max(n, CHUNK + 2), np.uint64)
        have[1:] = base
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        _powers[int(base)] = have
    return have[:n]


class SpanHash:
    """64-bit polynomial hashes of any spans of one array of code points, each in constant time."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(codes.size + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(_P, codes.size), out=self.prefix[1:])
        self.back = _power(_P_INVERSE, codes.size + 1)

    def __call__(self, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.prefix[highs] - self.prefix[lows]) * self.back[lows])


class AlignedHash:
    """SpanHash's hashes for many texts at once (codes: positions by texts): of a span that lies at the same place in all."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            self.prefix = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(_P, codes.shape[0])[:, None], axis=0, out=self.prefix[1:])
        self.back = _power(_P_INVERSE, codes.shape[0] + 1)

    def __call__(self, lows: np.ndarray, high: int, n: int) -> np.ndarray:
        """Of the first n texts; a row for each low."""
        with np.errstate(over="ignore"):
            return mix((self.prefix[high, :n] - self.prefix[lows, :n]) * self.back[lows, None])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, so that the low ones can serve as bucket numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))
