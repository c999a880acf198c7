"""Language identification by a string kernel.

k(x, y) counts the n-grams (1 to 4) present in both texts, the blended spectrum without multiplicities,
divided by the geometric mean of k(x, x) and k(y, y). N-grams are hashed into COLUMNS presence columns.
Nyström: the kernel against bounded landmarks, times the inverse square root of the landmarks' own kernel,
gives features; ridge regression on them, one language against the rest, is kernel ridge regression in that
space. A text is cut into pieces of PIECE code points, all of them scored, by batched matrix products; its
score for a language is the mean over its pieces, weighted by their letters.

Null texts and texts without a letter get language `und` and score 0. Without any row to learn from, all
get `und`. Columns named like the added ones are replaced; all others pass through.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textvec

NGRAMS = (1, 2, 3, 4)
COLUMNS = 1 << 13
PIECE = 2048
UNKNOWN = "und"
#: Bounds: documents learnt from for each language, of all languages together and at least for each; landmarks, of which each language has one at least.
TRAIN_DOCS, TRAIN_TOTAL, TRAIN_LEAST, LANDMARKS = 400, 16_000, 8, 192


@dataclass
class Model:
    """landmarks: presence columns by landmarks, float32; weights: landmarks by languages; sharp: slope of the softmax."""

    languages: list[str]
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    sharp: float


def pieces_of(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first code point of each piece, and its text; empty texts have none."""
    first = [np.arange(a, b, PIECE) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    owner = np.repeat(np.arange(len(first)), [f.size for f in first])
    return (np.concatenate(first) if first else np.zeros(0, np.int64)), owner


def presence(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """float32 matrix of pieces by columns: 1 where an n-gram of the piece is present. Digits and the like count as spaces."""
    plain = np.where(textvec.flags_of(codes, "isalpha"), codes, np.uint32(32))
    piece = np.repeat(np.arange(firsts.size), np.diff(np.append(firsts, codes.size)))
    out = np.zeros((firsts.size, COLUMNS), np.float32)
    flat = out.reshape(-1)
    h = np.zeros(codes.size, np.uint32)
    for n in NGRAMS:
        if codes.size < n:
            break
        h = (h if n == 1 else h[:-1]) * np.uint32(0x01000193) + plain[n - 1 :]
        column = (((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)).astype(np.int64)
        inside = piece[: h.size] == piece[n - 1 :]
        flat[(piece[: h.size] * COLUMNS + column)[inside]] = 1
    return out


def _features(x: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The normalised kernel of presence rows with the landmarks."""
    return (x @ landmarks) / (np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * norms[None, :])


def train(texts: list[str], languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2, seed: int = 1) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((COLUMNS, 1), np.float32), np.ones(1, np.float32), np.zeros((1, 0), np.float32), 1.0)
    label = np.array([names.index(x) for x in languages])
    rng = np.random.default_rng(seed)
    rows, of = [], []
    for at, part in textvec.chunks([t.lower() for t in texts]):
        codes, starts = textvec.codes_of(part)
        first, owner = pieces_of(codes, starts)
        if not first.size:
            continue
        # at most two pieces of each training text, spread over it
        rank = np.arange(owner.size) - np.searchsorted(owner, owner)
        pick = (rank == 0) | (rank == np.bincount(owner)[owner] // 2)
        x = presence(codes, first)
        rows.append(np.packbits(x[pick].astype(bool), axis=1))
        of.append(label[owner[pick] + at])
    x, y = np.concatenate(rows), np.concatenate(of)
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == k))[: max(1, landmarks // len(names))] for k in range(len(names))])
    marks = np.ascontiguousarray(np.unpackbits(x[chosen], axis=1).astype(np.float32).T)
    norms = np.sqrt(np.maximum(marks.sum(axis=0), 1))
    own = _features(marks.T, marks, norms).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    half = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    k = np.concatenate([_features(np.unpackbits(x[i : i + 512], axis=1).astype(np.float32), marks, norms) for i in range(0, len(x), 512)]) @ half
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    balance = np.sqrt(1 / np.bincount(y, minlength=len(names))[y])[:, None]
    a = k * balance
    solved = np.linalg.solve(a.T @ a + ridge * np.eye(k.shape[1]), a.T @ (target * balance))
    margin = k @ solved
    # the slope that gives the training pieces the best likelihood
    def loss(s: float) -> float:
        z = s * margin
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(axis=1))).mean())

    sharp = min((0.5, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0), key=loss)
    return Model(names, marks, norms.astype(np.float32), (half @ solved).astype(np.float32), sharp)


def identify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, best
    parts, owner_of = textvec.cut_long([(t or "").lower() for t in texts], textvec.CHUNK // PIECE * PIECE)
    total, weight = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for at, part in textvec.chunks(parts):
        codes, starts = textvec.codes_of(part)
        first, owner = pieces_of(codes, starts)
        if not first.size:
            continue
        edge = np.append(first, codes.size)
        letters = textvec.sums_between(textvec.flags_of(codes, "isalpha"), edge[:-1], edge[1:])
        margin = np.empty((first.size, len(model.languages)), np.float32)
        for i in range(0, first.size, 128):
            some = slice(edge[i], edge[min(i + 128, first.size)])
            margin[i : i + 128] = _features(presence(codes[some], first[i : i + 128] - edge[i]), model.landmarks, model.norms) @ model.weights
        doc = owner_of[at + owner]
        total += np.stack([np.bincount(doc, margin[:, k] * letters, len(texts)) for k in range(margin.shape[1])], axis=1)
        weight += np.bincount(doc, letters, len(texts))
    z = model.sharp * total / np.maximum(weight, 1)[:, None]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for i in np.flatnonzero(weight > 0):
        k = int(p[i].argmax())
        names[i], best[i] = model.languages[k], p[i, k]
    return names, best


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """Learn every language from pieces of at most `most` documents that are not held out and not empty, fewer of each where there are very many languages.

    Of a document, however long, its first piece and the middle one are fetched: at most 8 kB for TRAIN_TOTAL documents, or for
    TRAIN_LEAST of each of more than TRAIN_TOTAL / TRAIN_LEAST languages."""
    usable = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & (common.remainder() != 0) & (F.col("text") != ""))
    counts = common.materialize(usable.groupBy("lang").agg(F.count("*").alias("n")), "language-counts")
    languages = counts.count()
    most = min(most, max(TRAIN_LEAST, TRAIN_TOTAL // max(1, languages)))
    middle = F.expr(f"if(length(text) > {PIECE}, substring(text, {PIECE} * (ceil(length(text) / {PIECE}D) div 2) + 1, {PIECE}), null)")
    pieces = common.stratified_sample(usable, "lang", "doc_id", most, counts).select("doc_id", "lang", F.substring("text", 1, PIECE).alias("first"), middle.alias("middle"))
    order = F.xxhash64("doc_id", F.lit("sample"))
    rows, taken = [], Counter()
    for r in pieces.orderBy(order, "doc_id", "lang", "first", "middle").limit(2 * (most + 50) * max(1, languages)).collect():
        taken[r.lang] += 1
        if taken[r.lang] <= most:
            rows.append(r)
    learnt = [(t, r.lang) for r in rows for t in (r["first"], r["middle"]) if t]
    return train([t for t, _ in learnt], [lang for _, lang in learnt])


def identified(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with lang_pred and score (0 to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # COLUMNS by landmarks: 6 MB up to LANDMARKS languages, 33 kB for each one more
    return common.with_columns_of_text(docs, text, [("lang_pred", T.StringType(), pa.string()), ("score", T.DoubleType(), pa.float64())], lambda x: list(identify(x, shared.value)), keep_text)
