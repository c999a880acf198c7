"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Each line of a text is a paragraph, and so is each window of WINDOW words, half of which the next one shares,
across lines: so notices inside long lines and notices that are wrapped are found too. A multinomial logistic
regression over hashed word n-grams (1 to 3) gives a paragraph a licence family or `none`. It is trained on paragraphs made from the templates below (whole,
cut, with words dropped, with the corpus's own words around them) against paragraphs of a bounded sample of
the corpus and against near misses. The unknown class is calibrated on paragraphs that the fit hasn't seen:
a temperature for the probabilities, then the least certainty at which at most FALSE of the paragraphs
without a licence would pass. What passes is confirmed only if it shares enough word n-grams with a
template of its family. A confirmed line is a span; a window is narrowed, or widened, to the words that match one template in
order; the classifier names the family of these words, and a template of that family confirms it or they are dropped. What is
left of the window is looked at again. A line that such a span leaves, that is longer than LONG words, or that holds spans of two
families gives way to them.

Null and empty texts have no paragraphs and no licence. Repeated rows each get their own result. Extra
columns pass through; columns named like the added ones are replaced.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textvec

#: Notices and marking clauses of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    "cc": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc0": ("To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide.", "Released under CC0 1.0 Universal."),
    "gpl": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License."),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain.",),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Released under the zlib License."),
}
#: Paragraphs that use such words without granting a licence.
NEAR_MISSES = (
    "He lost his driving license after the accident.",
    "The club was licensed to sell beer and wine until midnight.",
    "All rights reserved. No part of this book may be reproduced.",
    "You need a permission from your manager before you publish.",
    "The software was released last week and runs on most machines.",
    "The warranty ends after two years.",
    "The general public was free to enter the foundation.",
    "The Apache are a people of the southwest.",
    "A version of this text was copied without notice.",
    "MIT is a university near Boston.",
    "License plates are checked at the border.",
    "See the terms of use and the privacy policy.",
)
NONE = "none"
BUCKETS = 1 << 16
#: Bounds of what is learnt from the corpus: documents (about), paragraphs.
TRAIN_DOCS, TRAIN_PARAGRAPHS = 400, 3000
LINE = 2000  # code points of a paragraph that is learnt from
FALSE = 0.0005  # share of other paragraphs that may pass for a licence before templates are compared
SHARED = 0.5  # share of a template's (or the paragraph's) word n-grams that confirms
WINDOW, LONG = 16, 64  # words of a window; words beyond which a line with matched words in it is no span of its own
GAP = 6  # words that may be changed or left out between two matches of one notice


@dataclass
class Model:
    """families: the classes, `none` first; weights: buckets by classes, float32; least: certainty that a licence needs."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    sharp: float
    least: float


def _grams(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word n-grams and the paragraph of each; starts: of the paragraphs (one entry more)."""
    lows, highs = textvec.runs_of(textvec.flags_of(codes, "isalnum"), starts)
    if not lows.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.searchsorted(starts, lows, "right") - 1
    h = textvec.SpanHash(codes)(lows, highs)
    rows, of, run = [], [], h
    for n in (1, 2, 3):
        if n > 1:
            with np.errstate(over="ignore"):
                run = textvec.mix(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :])
        same = owner[: run.size] == owner[n - 1 :]
        rows.append((run[same] >> np.uint64(48)).astype(np.int64))
        of.append(owner[: run.size][same])
    return np.concatenate(rows), np.concatenate(of)


def _logits(codes: np.ndarray, starts: np.ndarray, model: Model) -> np.ndarray:
    """Paragraphs by classes: mean weight of the n-grams, plus the bias."""
    rows, owner = _grams(codes, starts)
    n, k = starts.size - 1, len(model.families)
    total = np.zeros((n, k))
    if rows.size:
        order = np.argsort(owner, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(owner[order]) > 0)))
        total[owner[order][first]] = np.add.reduceat(model.weights[rows[order]], first, axis=0)
    return model.sharp * (total / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))[:, None] + model.bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def folded(text: str) -> str:
    """text in lower case; code points whose lower form is longer stay, so that positions hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) > 1 else x for c in text)


def word_grams(text: str, n: int = 3) -> set[tuple[str, ...]]:
    words = re.findall(r"\w+", text.lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


_templates: dict[str, list[set]] = {f: [word_grams(t) for t in ts] for f, ts in TEMPLATES.items()}


def confirmed(paragraph: str, family: str) -> float:
    """The largest share of a template's n-grams, or of the paragraph's, that both have."""
    own = word_grams(paragraph)
    return max((len(own & t) / min(len(t), max(len(own), 2)) for t in _templates[family]), default=0.0) if own else 0.0


_ordered: dict[str, list[dict]] = {}
for _f, _ts in TEMPLATES.items():
    for _t in _ts:
        _w = re.findall(r"\w+", _t.lower())
        _at: dict[tuple, list[int]] = {}
        for _i in range(max(1, len(_w) - 2)):
            _at.setdefault(tuple(_w[_i : _i + 3]), []).append(_i)
        _ordered.setdefault(_f, []).append(_at)
LONGEST = max(len(t) for ts in _templates.values() for t in ts) + 2  # words of the longest template


def _matched(words: list[str], low: int, high: int, floor: int, ceiling: int) -> tuple[int, int, int, int] | None:
    """The run of words around [low, high), within [floor, ceiling), that matches most n-grams of one template in order: first word, end, n-grams, n-grams of the template."""
    a, b = max(floor, low - LONGEST), min(ceiling, high + LONGEST)
    grams = [tuple(words[i : i + 3]) for i in range(a, b - 2)]
    best = None
    for templates in _ordered.values():
        for at in templates:
            runs: list[list[int]] = []  # first and last gram, place in the template, n-grams
            for i, g in enumerate(grams, a):
                if g not in at:
                    continue
                later = [p for p in at[g] if runs and p > runs[-1][2]]
                if later and i - runs[-1][1] <= GAP:
                    runs[-1][1:] = [i, later[0], runs[-1][3] + 1]
                else:
                    runs.append([i, i, at[g][0], 1])
            for first, last, _, n in runs:
                if first < high and last + 3 > low and (best is None or n > best[2]):
                    best = (first, last + 3, n, sum(map(len, at.values())))
    return best


def _examples(corpus: list[str], rng: np.random.Generator) -> tuple[list[str], list[str]]:
    """Paragraphs and classes: variations of the templates, near misses, and the corpus's own."""
    words = [w for p in corpus[:200] for w in p.split()[:20]] or ["the", "of", "and"]
    filler = lambda k: [words[i] for i in rng.integers(0, len(words), k)]
    texts, classes = [], []
    for family, templates in TEMPLATES.items():
        for t in templates:
            for i in range(24):
                w = t.split()
                if i % 3 == 1 and len(w) > 12:
                    a = int(rng.integers(0, len(w) - 10))
                    w = w[a : a + int(rng.integers(10, len(w) + 1))]
                if i % 4 >= 2 and len(w) > 8:
                    w = [x for x in w if rng.random() > 0.1]
                if i % 2:
                    w = filler(int(rng.integers(0, 12))) + w + filler(int(rng.integers(0, 12)))
                texts.append(" ".join(w))
                classes.append(family)
    for miss in NEAR_MISSES:
        for _ in range(12):
            texts.append(" ".join(filler(int(rng.integers(0, 8))) + miss.split() + filler(int(rng.integers(0, 8)))))
            classes.append(NONE)
    # licence notices of the corpus itself are not examples of `none`
    cue = re.compile(r"(?i)licen[sc]e|copyright|permission|warrant|redistribut|spdx|public domain|cc.by")
    own = [p for p in corpus if not cue.search(p)]
    return texts + own, classes + [NONE] * len(own)


def train(corpus: list[str], epochs: int = 80, rate: float = 0.1, seed: int = 1) -> Model:
    rng = np.random.default_rng(seed)
    families = [NONE, *sorted(TEMPLATES)]
    texts, classes = _examples(corpus, rng)
    y = np.array([families.index(c) for c in classes])
    codes, starts = textvec.codes_of([t.lower() for t in texts])
    rows, owner = _grams(codes, starts)
    held = rng.random(len(texts)) < 0.25
    size = np.sqrt(np.maximum(np.bincount(owner, minlength=len(texts)), 1))
    used, at = np.unique(rows, return_inverse=True)
    w, b = np.zeros((used.size, len(families))), np.zeros(len(families))
    m, v = np.zeros_like(w), np.zeros_like(w)
    inside = ~held[owner]
    a, o = at[inside], owner[inside]
    value = 1 / size[o]
    balance = np.where(y == 0, 1.0, 2.0) * ~held
    balance /= balance.sum()

    def logits(some_at, some_owner):
        z = np.empty((len(texts), len(families)))
        for k in range(len(families)):
            z[:, k] = np.bincount(some_owner, w[some_at, k], len(texts)) / size + b[k]
        return z

    for epoch in range(1, epochs + 1):
        p = _softmax(logits(a, o))
        p[np.arange(len(y)), y] -= 1
        g = p * balance[:, None]
        grad = np.stack([np.bincount(a, g[o, k] * value, used.size) for k in range(len(families))], axis=1) + 1e-6 * w
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
        b -= rate * g.sum(axis=0)
    z = logits(at, owner)[held]
    loss = lambda s: -np.log(_softmax(s * z)[np.arange(z.shape[0]), y[held]] + 1e-12).mean()
    sharp = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0), key=loss)
    p = _softmax(sharp * z)
    sure = np.where(p.argmax(axis=1) > 0, p.max(axis=1), 0)[y[held] == 0]
    least = max(0.5, float(np.quantile(sure, 1 - FALSE, method="higher")) if sure.size else 0.5)
    weights = np.zeros((BUCKETS, len(families)), np.float32)
    weights[used] = w
    return Model(families, weights, b.astype(np.float32), sharp, min(least, 0.95))


def _windows(words: tuple[np.ndarray, np.ndarray], starts: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of windows of WINDOW words that lie one after the other in each text, the first cut by `shift` words, and the number of the word at each."""
    lows = words[0]
    first = np.searchsorted(lows, starts[:-1])
    n = np.diff(np.append(first, lows.size))
    place = np.arange(lows.size) - np.repeat(first, n) + shift
    at = np.flatnonzero((place % WINDOW == 0) | (place == shift))
    return np.append(lows[at], starts[-1]), np.append(at, lows.size)


def _lines(codes: np.ndarray, starts: np.ndarray, part: list[str], model: Model) -> list[list[tuple[str, int, int, float]]]:
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in part]
    edges = np.unique(np.concatenate((starts, np.flatnonzero(codes == 10) + 1)))
    p = _softmax(_logits(codes, edges, model))
    best = p.argmax(axis=1)
    for i in np.flatnonzero((best > 0) & (p.max(axis=1) >= model.least)):
        doc = int(np.searchsorted(starts, edges[i], "right") - 1)
        a, b = int(edges[i] - starts[doc]), int(edges[i + 1] - starts[doc])
        line = part[doc][a:b].rstrip("\n")
        if confirmed(line, family := model.families[best[i]]) >= SHARED:
            out[doc].append((family, a, a + len(line), float(p[i].max())))
    return out


def _chances(texts: list[str], model: Model) -> np.ndarray:
    return _softmax(_logits(*textvec.codes_of(texts), model))


def _notices(codes: np.ndarray, starts: np.ndarray, part: list[str], model: Model) -> list[list[tuple[str, int, int, float]]]:
    """For each text what confirmed windows match: family, start, end, certainty; of overlapping ones the best matched.

    A window that may hold a licence is narrowed to the words that match a template; the classifier names their family, and a template
    of that family must confirm it. What is left of the window on both sides, and the halves of a window that as a whole is like no
    template, are looked at again in the same way, so that notices side by side are all found. Of equal matches the first template's counts."""
    runs = textvec.runs_of(textvec.flags_of(codes, "isalnum"), starts)
    of: dict[int, tuple[list[str], list[tuple[int, int]]]] = {}
    # text, words (from, to), free words around (from, to), whether it is a whole window
    pieces: list[tuple[int, int, int, int, int, bool]] = []
    for shift in (0, WINDOW // 2):
        if not runs[0].size:
            break
        edges, _ = _windows(runs, starts, shift)
        maybe = 1 - _softmax(_logits(codes, edges, model))[:, 0] >= model.least
        for i in np.flatnonzero(maybe):
            doc = int(np.searchsorted(starts, edges[i], "right") - 1)
            # a window that is its text's last may reach into a later text without words before its first word
            a, b = int(edges[i] - starts[doc]), int(min(edges[i + 1], starts[doc + 1]) - starts[doc])
            if doc not in of:
                low = folded(part[doc])
                spans = [m.span() for m in re.finditer(r"\w+", low)]
                of[doc] = [low[x:y] for x, y in spans], spans
            words, spans = of[doc]
            pieces.append((doc, bisect.bisect_left(spans, (a, 0)), bisect.bisect_left(spans, (b, 0)), 0, len(words), True))
    found: list[list[tuple[int, int, int, str, float]]] = [[] for _ in part]
    while pieces:
        p = _chances([" ".join(of[doc][0][low:high]) for doc, low, high, *_ in pieces], model)
        hits, left = [], []
        for (doc, low, high, floor, ceiling, whole), chance in zip(pieces, p, strict=True):
            if 1 - chance[0] < model.least:
                continue
            words = of[doc][0]
            like = confirmed(" ".join(words[low:high]), model.families[1 + int(chance[1:].argmax())]) >= SHARED
            hit = _matched(words, low, high, floor, ceiling) if like else None
            if hit and (whole or hit[2] >= SHARED * min(hit[3], WINDOW - 2)):
                first, end, n, _ = hit
                hits.append((doc, first, end, n))
                left += [(doc, low, first, floor, first, False)] * (first - low >= 3) + [(doc, end, high, end, ceiling, False)] * (high - end >= 3)
            elif high - low >= 8:
                middle = (low + high) // 2
                left += [(doc, low, middle, floor, ceiling, False), (doc, middle, high, floor, ceiling, False)]
        if hits:
            named = _chances([" ".join(of[doc][0][first:end]) for doc, first, end, _ in hits], model)
            for (doc, first, end, n), chance in zip(hits, named, strict=True):
                words, spans = of[doc]
                family = model.families[1 + int(chance[1:].argmax())]
                if confirmed(" ".join(words[first:end]), family) >= SHARED:
                    found[doc].append((n, spans[first][0], spans[end - 1][1], family, float(chance[1:].max())))
        pieces = left
    out: list[list[tuple[str, int, int, float]]] = []
    for hits in found:
        chosen: list[tuple[str, int, int, float]] = []
        for _, a, b, family, sure in sorted(set(hits), key=lambda x: (-x[0], x[1], x[2], x[3], -x[4])):
            at = bisect.bisect_left(chosen, a, key=lambda x: x[1])  # chosen ones lie in order and apart
            if (not at or chosen[at - 1][2] <= a) and (at == len(chosen) or b <= chosen[at][1]):
                chosen.insert(at, (family, a, b, sure))
        out.append(chosen)
    return out


def _together(text: str, lines: list[tuple[str, int, int, float]], notices: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """Confirmed lines and notices without overlaps: a notice that leaves its line, or lies in a long one, takes the line's place, and so do notices of two families in one line."""
    if not notices:
        return lines
    kept = []
    for line in lines:
        _, a, b, _ = line
        inside = [n for n in notices if n[1] < b and a < n[2]]
        wrapped = any(n[1] < a or n[2] > b for n in inside)
        if not (wrapped or len({n[0] for n in inside}) > 1 or inside and len(re.findall(r"\w+", text[a:b])) > LONG):
            kept.append(line)
    free = [n for n in notices if not any(n[1] < b and a < n[2] for _, a, b, _ in kept)]
    return sorted(kept + free, key=lambda x: x[1:3])


def found_in(texts: list[str | None], model: Model) -> list[list[tuple[str, int, int, float]]]:
    """For each text its confirmed licence notices: family, start, end (code points), certainty."""
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    for at, part in textvec.chunks([t or "" for t in texts]):
        codes, starts = textvec.codes_of([folded(t) for t in part])
        if not codes.size:
            continue
        for i, (lines, notices) in enumerate(zip(_lines(codes, starts, part, model), _notices(codes, starts, part, model), strict=True)):
            out[at + i] = _together(part[i], lines, notices)
    return out


def fit(docs: DataFrame, most: int = TRAIN_DOCS, paragraphs: int = TRAIN_PARAGRAPHS) -> Model:
    """Train against at most `paragraphs` lines, those with the smallest hashes, of about `most` whole documents with small hashes of doc_id.

    Of a line over LINE code points, a piece of that length is taken, from a place that its hash says."""
    some = common.hash_sample(docs.select("doc_id", "text"), "doc_id", most, docs.count(), "licence")
    lines = some.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter("trim(line) <> ''").withColumn("h", F.xxhash64("doc_id", "at", F.lit("licence")))
    over = F.length("line") - LINE
    piece = F.when(over > 0, F.substring("line", (F.pmod("h", over + 1) + 1).cast("int"), F.lit(LINE))).otherwise(F.col("line"))
    return train([r.line for r in lines.select("h", piece.alias("line")).orderBy("h", "line").limit(paragraphs).collect()])


def scanned(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with licences (array of family, start, end, certainty; empty if there are none)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS by families, 4 MB
    kind = T.ArrayType(T.StructType([T.StructField("family", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("certainty", T.DoubleType())]))
    arrow = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("certainty", pa.float64())]))
    row = lambda x: dict(zip(("family", "start", "end", "certainty"), x, strict=True))
    return common.with_columns_of_text(docs, text, [("licences", kind, arrow)], lambda t: [[[row(x) for x in f] for f in found_in(t, shared.value)]], keep_text)
