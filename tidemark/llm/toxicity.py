"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 6, with < and > at its ends), hashed into a table of
embedding rows, so that a misspelling shares most rows with the word it came from. A word's vector is the
mean of its rows, a document's vector the mean of its words' vectors, and that goes through a linear softmax
of two classes. Embeddings and softmax are trained together by Adam; each row's embedding is scaled by how
surely its n-grams tell the classes apart (a lower bound of their log odds), so that the few telling n-grams
of a long text aren't drowned by the many others. A quarter of the sample is kept back to set the bias.

Once trained, the score is linear in the embeddings: each table row folds into one number, and whole
batches of texts are scored as arrays of code points. A long text is worked on in parts, cut between words
(inside words of over 100,000 code points), and its words are averaged over all parts.

Null and empty texts, and those without a word, get the score of an empty bag (the softmax's bias). Labels: of rows that repeat a
doc_id, the largest toxic counts; null labels and ids are skipped. Without labels of both classes every
score is the share of class 1 (0 if there are none). Extra columns pass through; columns named like the
added ones are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textvec

NGRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIM = 8
KEPT = 0.5  # share of the n-grams that an epoch trains on
EPOCHS, RATE, DECAY = 100, 0.1, 0.02
GAP = 0.25  # where the cut lies in the gap between clean and toxic texts: nearer to the clean ones, for misspellings carry only part of a word's weight
SURE, CAUTION = 2.0, 8  # standard errors; how much more a clean text weighs than a toxic one when the bias is set
#: Bounds of the training sample: documents of each class, and code points of one of them.
TRAIN_DOCS, TRAIN_CHARS = 1200, 12_000


@dataclass
class Model:
    """gram: what each table row adds to the logit of class 1, float32; bias: the logit of an empty bag."""

    gram: np.ndarray
    bias: float


def _marked(codes: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words codes[low:high] one after the other, each between < and >; where each starts (one entry more)."""
    lengths = highs - lows
    starts = np.zeros(lengths.size + 1, np.int64)
    np.cumsum(lengths + 2, out=starts[1:])
    out = np.full(starts[-1], ord("<"), np.uint32)
    out[starts[1:] - 1] = ord(">")
    word = np.repeat(np.arange(lengths.size), lengths)
    inside = np.arange(word.size) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[starts[word] + 1 + inside] = codes[lows[word] + inside]
    return out, starts


def _grams(marked: np.ndarray, starts: np.ndarray):
    """For each n: the rows of the n-grams at every position and whether each lies in one word."""
    word = np.repeat(np.arange(starts.size - 1, dtype=np.int32), np.diff(starts))
    h = marked.astype(np.uint32)
    for n in range(2, NGRAMS[-1] + 1):
        if marked.size < n:
            return
        h = h[:-1] * np.uint32(0x01000193) + marked[n - 1 :]
        if n in NGRAMS:
            yield n, (((h ^ np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 18)).astype(np.int64), word[: h.size] == word[n - 1 :], word


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points in lower case with all digits as 0, starts and ends of the words, and the text of each word."""
    codes, starts = textvec.codes_of([t.lower() for t in texts])
    codes = np.where((codes >= 48) & (codes <= 57), np.uint32(48), codes)
    lows, highs = textvec.runs_of(textvec.flags_of(codes, "isalnum"), starts)
    return codes, lows, highs, np.searchsorted(starts, lows, "right") - 1


def _word_scores(codes: np.ndarray, lows: np.ndarray, highs: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """For each word the mean of gram over its n-grams."""
    marked, starts = _marked(codes, lows, highs)
    total = np.zeros(marked.size, np.float32)
    for _, rows, inside, _ in _grams(marked, starts):
        total[: rows.size] += np.where(inside, gram[rows], np.float32(0))
    length = np.diff(starts)
    count = sum(np.maximum(length - n + 1, 0) for n in NGRAMS)
    return np.add.reduceat(total, starts[:-1], dtype=np.float64) / np.maximum(count, 1)


def logits(texts: list[str | None], model: Model) -> np.ndarray:
    """The logit of class 1 for each text: the mean of its words' scores, and the bias."""
    parts, owner = textvec.cut_long([t or "" for t in texts], at=textvec.between_words)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for at, some in textvec.chunks(parts):
        codes, lows, highs, part = _words(some)
        if lows.size:
            doc = owner[at + part]
            total += np.bincount(doc, _word_scores(codes, lows, highs, model.gram), len(texts))
            count += np.bincount(doc, minlength=len(texts))
    return model.bias + total / np.maximum(count, 1)


def scores(texts: list[str | None], model: Model) -> np.ndarray:
    """The probability of class 1 for each text, over all of it."""
    return 1 / (1 + np.exp(-np.clip(logits(texts, model), -500, 500)))


def calibrated(model: Model, texts: list[str], labels: list[int]) -> Model:
    """The same model with the bias that separates texts it hasn't seen best, where a clean one weighs CAUTION times a toxic one."""
    y = np.array(labels, int)
    if not 0 < y.sum() < y.size:
        return model
    z = logits(texts, model)
    order = np.argsort(z, kind="stable")
    y, z = y[order], z[order]
    # with the cut before entry i: clean ones below and toxic ones above it are right
    right = CAUTION * np.concatenate(([0], np.cumsum(y == 0))) / (y == 0).sum() + (y.sum() - np.concatenate(([0], np.cumsum(y)))) / y.sum()
    best = np.flatnonzero(right == right.max())
    edge = np.concatenate(([z[0] - 1], z[:-1] + (z[1:] - z[:-1]) * GAP, [z[-1] + 1]))
    return Model(model.gram, model.bias - float(edge[best[best.size // 2]]))


def fitted(texts: list[str], labels: list[int]) -> Model:
    """Train on three of four texts and calibrate on the rest; on all for both if a class has fewer than 100."""
    count = sum(labels)
    if min(count, len(labels) - count) < 100:
        return train(texts, labels)
    rest = [i % 4 != 3 for i in range(len(texts))]
    pick = lambda x, want: [v for v, r in zip(x, rest, strict=True) if r == want]
    return calibrated(train(pick(texts, True), pick(labels, True)), pick(texts, False), pick(labels, False))


@dataclass
class Bags:
    """Training texts as bags: `gram[i]` is an n-gram of unique word `of_word[i]`; word `word[j]` makes up `weight[j]` of text `doc[j]`."""

    gram: np.ndarray
    of_word: np.ndarray
    word: np.ndarray
    doc: np.ndarray
    weight: np.ndarray
    words: int
    docs: int


def bags_of(texts: list[str]) -> Bags:
    """Each unique word is cut into n-grams once, wherever it stands."""
    keys, docs, fresh = [], [], []
    parts, owner = textvec.cut_long(list(texts), at=textvec.between_words)
    for at, some in textvec.chunks(parts):
        codes, lows, highs, part = _words(some)
        if lows.size:
            key = textvec.SpanHash(codes)(lows, highs)
            unique, first = np.unique(key, return_index=True)
            keys.append(key)
            docs.append(owner[at + part])
            fresh.append((unique, codes, lows[first], highs[first]))
    if not keys:
        none = np.zeros(0, np.int64)
        return Bags(none, none, none, none, np.zeros(0), 0, len(texts))
    vocabulary = np.unique(np.concatenate([u for u, _, _, _ in fresh]))
    grams, of_word, done = [], [], np.zeros(vocabulary.size, bool)
    for unique, codes, lows, highs in fresh:
        at = np.searchsorted(vocabulary, unique)
        new = np.flatnonzero(~done[at])
        done[at[new]] = True
        marked, starts = _marked(codes, lows[new], highs[new])
        for _, rows, inside, word in _grams(marked, starts):
            grams.append(rows[inside].astype(np.int32))
            of_word.append(at[new][word[: rows.size][inside]].astype(np.int32))
    token, doc = np.searchsorted(vocabulary, np.concatenate(keys)), np.concatenate(docs)
    pair, times = np.unique(token * len(texts) + doc, return_counts=True)
    doc = pair % len(texts)
    weight = times / np.bincount(doc, times, len(texts))[doc]
    return Bags(np.concatenate(grams), np.concatenate(of_word), (pair // len(texts)).astype(np.int32), doc.astype(np.int32), weight, vocabulary.size, len(texts))


def loss_and_gradients(bags: Bags, kept: np.ndarray, e: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Cross entropy of softmax(mean of the words' mean embeddings @ w + b), and its gradients for e, w and b.

    kept marks the n-grams that stand for their words in this step."""
    gram, of_word = bags.gram[kept], bags.of_word[kept]
    per_word = np.maximum(np.bincount(of_word, minlength=bags.words), 1)
    table = e @ w  # each row's part of the two logits: averages are linear, so they can wait
    z = np.empty((bags.docs, 2))
    for k in (0, 1):
        word = np.bincount(of_word, table[gram, k], bags.words) / per_word
        z[:, k] = np.bincount(bags.doc, bags.weight * word[bags.word], bags.docs) + b[k]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at = np.arange(bags.docs)
    loss = -float(weight @ np.log(np.maximum(p[at, y], 1e-300)))
    p[at, y] -= 1
    g = p * weight[:, None]
    of_table = np.empty((len(e), 2))
    for k in (0, 1):
        of_words = np.bincount(bags.word, bags.weight * g[bags.doc, k], bags.words) / per_word
        of_table[:, k] = np.bincount(gram, of_words[of_word], len(e))
    return loss, of_table @ w.T, e.T @ of_table, g.sum(axis=0)


def trust_of(bags: Bags, y: np.ndarray, part: int = 1 << 13) -> np.ndarray:
    """For each table row how surely its n-grams tell the classes apart: the log odds between the texts of the two classes that hold
    them, without sign, less SURE standard errors; at least 0."""
    texts_of = [(y == k).sum() for k in (0, 1)]
    order = np.argsort(bags.word, kind="stable")
    doc, first = bags.doc[order], np.searchsorted(bags.word[order], np.arange(bags.words + 1))
    order = np.argsort(bags.gram, kind="stable")
    gram, of_word = bags.gram[order].astype(np.int64), bags.of_word[order]
    having = np.zeros((2, BUCKETS))
    edges = np.searchsorted(gram, np.arange(0, BUCKETS + part, part))
    for low, high in zip(edges[:-1], edges[1:], strict=True):  # some rows at a time: every (row, text) once
        word = of_word[low:high]
        times = (first[word + 1] - first[word]) if word.size else np.zeros(0, np.int64)
        at = np.repeat(first[word] - np.cumsum(times) + times, times) + np.arange(times.sum())
        row, text = np.divmod(np.unique(np.repeat(gram[low:high], times) * bags.docs + doc[at]), bags.docs)
        for k in (0, 1):
            having[k] += np.bincount(row[y[text] == k], minlength=BUCKETS)
    odds = [np.log((h + 0.5) / (n - h + 0.5)) for h, n in zip(having, texts_of, strict=True)]
    error = np.sqrt(sum(1 / (h + 0.5) + 1 / (n - h + 0.5) for h, n in zip(having, texts_of, strict=True)))
    return np.maximum(0, np.abs(odds[1] - odds[0]) - SURE * error)


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY, seed: int = 1) -> Model:
    """Fit on whole texts by Adam over all of them; a random half of the n-grams stands for each word in an epoch, as a misspelling would leave it."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if y.size else 0.0
    bags = bags_of(texts) if 0 < share < 1 else None
    if bags is None or not bags.words:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    # rows that don't surely tell the classes apart stay zero: they could only be learnt by heart
    trust = trust_of(bags, y)
    learnt = (trust > 0)[bags.gram]
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / y.size
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1 / DIM, (BUCKETS, DIM))
    w, b = rng.normal(0, 1 / np.sqrt(DIM), (DIM, 2)), np.zeros(2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, b)]
    for epoch in range(1, epochs + 1):
        kept = learnt & (rng.random(bags.gram.size, np.float32) < KEPT)
        _, by_row, by_w, by_b = loss_and_gradients(bags, kept, e * trust[:, None], w, b, y, weight)
        grads = (by_row * trust[:, None], by_w, by_b)
        for (m, v), param, grad in zip(state, (e, w, b), grads, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
        e *= 1 - rate * decay
    table = (e * trust[:, None]) @ w
    return Model((table[:, 1] - table[:, 0]).astype(np.float32), float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, longest: int = TRAIN_CHARS) -> Model:
    """Train on at most `most` labelled documents of each class that are not held out, of up to `longest` code points.

    The sample is by hash of doc_id, so it doesn't depend on how the tables are partitioned."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= longest) & (common.remainder() != 0))
    marked = common.stratified_sample(marks.filter((common.remainder() != 0) & F.col("toxic").isin(0, 1)), "toxic", "doc_id", 2 * most)
    # at most six times `most` ids, so the texts needn't move
    few = marked.select(F.col("doc_id").alias("_id"), "toxic").limit(6 * most)
    rows = usable.join(F.broadcast(few), F.col("doc_id") == F.col("_id")).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id", "text").limit(4 * most).collect()
    kept: list = []
    counts = {0: 0, 1: 0}
    for r in rows:
        if counts[r.toxic] < most:
            counts[r.toxic] += 1
            kept.append(r)
    return fitted([r.text for r in kept], [r.toxic for r in kept])


def scored(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with score (double) and predicted (int, 1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the corpus

    def work(texts: list[str | None]) -> list[np.ndarray]:
        s = scores(texts, shared.value)
        return [s, (s >= 0.5).astype(np.int32)]

    return common.with_columns_of_text(docs, text, [("score", T.DoubleType(), pa.float64()), ("predicted", T.IntegerType(), pa.int32())], work, keep_text)
