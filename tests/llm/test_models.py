"""Toxicity, language, licences: learnt operators on small made-up corpora, by held-out accuracy and defined edge cases."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from tidemark.llm import common, langid, licenses, toxicity

SYLLABLES = {"aa": ["ka", "lo", "mi", "ten", "ru"], "bb": ["schö", "vör", "äng", "zeit", "wid"], "cc": ["что", "пра", "мир", "вод", "лес"]}


def sentence(rng, lang, n=30):
    return " ".join("".join(rng.choice(SYLLABLES[lang], int(rng.integers(1, 4)))) for _ in range(n))


@pytest.fixture(scope="module")
def toxic_rows():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        words, bad = sentence(rng, "aa", 40).split(), int(rng.random() < 0.3)
        for _ in range(2 * bad):
            words.insert(int(rng.integers(0, len(words))), "idiotic" if rng.random() < 0.5 else "stupidest")
        rows.append((i, " ".join(words), bad))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_on_held_out_rows(spark, toxic_rows):
    docs = spark.createDataFrame([(i, t, "keep") for i, t, _ in toxic_rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    truth = {i: y for i, _, y in toxic_rows}
    test = [(r.predicted, truth[r.doc_id]) for r in out if held(r.doc_id)]
    assert len(test) > 80 and np.mean([a == b for a, b in test]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)


@pytest.fixture(scope="module")
def toxic_model(toxic_rows):
    return toxicity.fitted([t for _, t, _ in toxic_rows], [y for *_, y in toxic_rows])


def test_toxicity_of_misspellings_that_no_text_holds(toxic_model):
    rng = np.random.default_rng(7)
    clean = [sentence(rng, "aa", 40) for _ in range(60)]
    wrong = ["idiotics", "idi0tic", "stupiddest", "stupidst", "idiottic", "stup1dest"]
    mixed = [" ".join([*t.split()[:20], wrong[i % 6], *t.split()[20:], wrong[(i + 1) % 6]]) for i, t in enumerate(clean)]
    assert np.mean(toxicity.scores(mixed, toxic_model) >= 0.5) > 0.85 and np.mean(toxicity.scores(clean, toxic_model) >= 0.5) < 0.05
    assert (toxicity.scores(wrong, toxic_model) >= 0.5).all()


def test_toxicity_of_empty_and_very_long_texts(toxic_model):
    some = ("kalo mi ten ru " * 5 + "idiotic ") * 12_000
    s = toxicity.scores(["", None, " .,", some, "kalo mi ten ru " * 60_000, "k" * 450_000], toxic_model)
    assert s[0] == s[1] == s[2] < 0.5 < s[3] and s[4] < 0.5 and 0 <= s[5] <= 1


def plain_logit(text, model):
    """The forward pass word by word and n-gram by n-gram."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    means = []
    for word in words:
        marked = "<" + "".join("0" if "0" <= c <= "9" else c for c in word) + ">"
        rows = []
        for n in toxicity.NGRAMS:
            for i in range(len(marked) - n + 1):
                h = ord(marked[i])
                for c in marked[i + 1 : i + n]:
                    h = (h * 0x01000193 + ord(c)) % 2**32
                rows.append(((h ^ n) * 0x9E3779B1) % 2**32 >> (32 - 18))
        means.append(np.mean([float(model.gram[r]) for r in rows]) if rows else 0.0)
    return model.bias + (np.mean(means) if means else 0.0)


def test_toxicity_forward_pass_against_plain_loops():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 5, toxicity.BUCKETS).astype(np.float32), -0.7)
    texts = ["Kalo, mi-ten 12a9 Ärger", "", "a", "x\ny\tz" * 40, "ЖЁ \U00010400\U00010401 ok", "  ", "idiotic " * 3 + "id1ot"]
    assert np.allclose(toxicity.logits(texts, model), [plain_logit(t, model) for t in texts], atol=1e-5)


def test_toxicity_gradients_against_differences(monkeypatch):
    rng = np.random.default_rng(5)
    texts, y = ["kalo mi idiot", "mi mi ten", "ten idiot ru kalo", ""], np.array([1, 0, 1, 0])
    bags = toxicity.bags_of(texts)
    rows = np.unique(bags.gram)
    bags.gram = np.searchsorted(rows, bags.gram)  # a small table
    e, w, b = rng.normal(0, 1, (rows.size, 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2)
    kept, weight = rng.random(bags.gram.size) < 0.7, np.array([0.1, 0.4, 0.3, 0.2])
    _, *grads = toxicity.loss_and_gradients(bags, kept, e, w, b, y, weight)
    for parameter, grad in zip((e, w, b), grads, strict=True):
        for at in np.ndindex(parameter.shape):
            old, step = parameter[at], 1e-6
            parameter[at] = old + step
            up = toxicity.loss_and_gradients(bags, kept, e, w, b, y, weight)[0]
            parameter[at] = old - step
            down = toxicity.loss_and_gradients(bags, kept, e, w, b, y, weight)[0]
            parameter[at] = old
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-6


def test_toxicity_of_repeated_rows_and_clashing_names(spark, toxic_model):
    df = spark.createDataFrame([(1, "kalo idiotic", "a", 9), (1, "kalo idiotic", "a", 9), (None, None, None, None)], "doc_id long, text string, predicted string, n int")
    rows = toxicity.scored(df, toxic_model).collect()
    assert [r.predicted for r in rows] == [1, 1, 0] and rows[0].score == rows[1].score and rows[0].n == 9


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.scored(docs, model).collect()] == [0, 0]
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_toxicity_scores_do_not_depend_on_the_batch(toxic_rows):
    model = toxicity.train([t for _, t, _ in toxic_rows[:200]], [y for *_, y in toxic_rows[:200]])
    texts = [t for _, t, _ in toxic_rows[:50]]
    assert np.allclose(toxicity.scores(texts, model), [toxicity.scores([t], model)[0] for t in texts])


def test_languages(spark):
    rng = np.random.default_rng(2)
    rows = [(i, sentence(rng, lang), lang) for i in range(150) for lang in SYLLABLES]
    rows = [(k, t, lang) for k, (_, t, lang) in enumerate(rows)] + [(9000, None, "aa"), (9001, "123 !!", None), (9002, "", None), (9003, sentence(rng, "cc", 30_000), None), (9004, "ка\U00010400", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.identified(docs, langid.fit(docs)).collect()}
    test = [(out[i].lang_pred, lang) for i, _, lang in rows[:450] if held(i)]
    assert np.mean([a == b for a, b in test]) > 0.97
    assert [(out[i].lang_pred, out[i].score) for i in (9000, 9001, 9002)] == [("und", 0.0)] * 3
    assert out[9003].lang_pred == "cc" and 0 <= out[9003].score <= 1 and out[9004].lang_pred != "und"


def plain_language(text, model):
    """The kernel n-gram by n-gram, one landmark at a time."""
    text, total, letters = text.lower(), np.zeros(len(model.languages)), 0
    for at in range(0, len(text), langid.PIECE):
        piece = "".join(c if c.isalpha() else " " for c in text[at : at + langid.PIECE])
        columns = set()
        for n in langid.NGRAMS:
            for i in range(len(piece) - n + 1):
                h = 0
                for c in piece[i : i + n]:
                    h = (h * 0x01000193 + ord(c)) % 2**32
                columns.add(((h ^ n) * 0x9E3779B1) % 2**32 >> (32 - 13))
        kernel = np.array([sum(model.landmarks[c, k] for c in columns) / (np.sqrt(len(columns)) * model.norms[k]) for k in range(model.landmarks.shape[1])])
        mine = sum(c.isalpha() for c in text[at : at + langid.PIECE])
        total, letters = total + mine * (kernel @ model.weights), letters + mine
    if not letters:
        return langid.UNKNOWN, 0.0
    z = np.exp(model.sharp * (total - total.max()) / letters)
    return model.languages[int(total.argmax())], float(z.max() / z.sum())


def test_languages_against_plain_loops():
    rng = np.random.default_rng(6)
    texts = [sentence(rng, lang) for lang in SYLLABLES for _ in range(20)]
    model = langid.train(texts, [lang for lang in SYLLABLES for _ in range(20)], landmarks=9)
    some = [texts[0], texts[25] + texts[50], "", "12", sentence(rng, "bb", 700), "Ä b"]
    names, scores = langid.identify(some, model)
    want = [plain_language(t, model) for t in some]
    assert names == [w for w, _ in want] and np.allclose(scores, [s for _, s in want], atol=1e-4)


def test_languages_of_repeated_rows_and_clashing_names(spark):
    rng = np.random.default_rng(8)
    text = sentence(rng, "cc")
    rows = [(1, text, "cc", "x", 1)] * 60 + [(i, sentence(rng, "aa"), "aa", "y", 2) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, n int")
    out = langid.identified(docs, langid.fit(docs)).collect()
    assert len(out) == len(rows) and {(r.lang_pred, r.n) for r in out} == {("cc", 1), ("aa", 2)}


def test_languages_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identified(docs, langid.fit(docs)).first().lang_pred == "und"
    assert langid.identified(docs.limit(0), langid.fit(docs)).count() == 0


def test_stratified_sample(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else "cold") for i in range(300)], "doc_id long, s string")
    picked = common.stratified_sample(df, "s", "doc_id", 10)
    counts = {r["s"]: r["count"] for r in picked.groupBy("s").count().collect()}
    assert 25 < counts["hot"] < 85 and 25 < counts["cold"] < 85 and picked.columns == df.columns
    assert picked.exceptAll(common.stratified_sample(df.repartition(7), "s", "doc_id", 10)).count() == 0
    few = df.filter("doc_id < 30")
    assert common.stratified_sample(few, "s", "doc_id", 10).count() == 30


@pytest.fixture(scope="module")
def licence_model():
    rng = np.random.default_rng(3)
    return licenses.train([sentence(rng, lang, int(rng.integers(3, 40))) for lang in SYLLABLES for _ in range(150)])


@pytest.mark.parametrize(
    "line,family",
    [
        ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), ("Licensed under CC BY-NC 4.0.", "cc"), ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"), ("SPDX-License-Identifier: MPL-2.0", "mpl"),
    ],
)
def test_licences_are_found(licence_model, line, family):
    text = f"kalo miten\n{line}\nrulo"
    assert [(f, text[a:b]) for f, a, b, _ in licenses.found_in([text], licence_model)[0]] == [(family, line)]


def test_other_paragraphs_are_left_alone(licence_model):
    clean = ["kalo mi ten ru", "He lost his driving license.", "", None, "\n\n\n", "The warranty ends after two years.", "ka " * 50_000]
    assert licenses.found_in(clean, licence_model) == [[] for _ in clean]


def test_licence_scan_table(spark, licence_model):
    df = spark.createDataFrame([(1, "x\nReleased under the MIT License.", "c"), (1, "x\nReleased under the MIT License.", "c"), (None, None, None)], "doc_id long, text string, licences string")
    rows = licenses.scanned(df, licence_model).collect()
    assert [[x.family for x in r.licences] for r in rows] == [["mit"], ["mit"], []]
    assert licenses.scanned(df.limit(0), licence_model).count() == 0


@pytest.mark.parametrize("notice,family", [("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache"), (licenses.TEMPLATES["gpl"][0], "gpl"), (licenses.TEMPLATES["agpl"][0], "agpl")])
def test_licences_inside_long_lines_and_across_lines(licence_model, notice, family):
    rng = np.random.default_rng(4)
    words = notice.split()
    middle = len(words) // 2
    wrapped = " ".join(words[:middle]) + "\n * " + " ".join(words[middle:])
    for before in (0, 3, 90, 301, 1007):
        for form in (notice, wrapped):
            text = " ".join([sentence(rng, "aa", before), form, sentence(rng, "aa", 400)]) if before else form
            found = licenses.found_in([text], licence_model)[0]
            assert [f for f, *_ in found] == [family], (before, form, found)
            assert text[found[0][1] : found[0][2]].rstrip(".") == form.rstrip("."), (before, found)


def test_two_licences_in_one_long_line(licence_model):
    rng = np.random.default_rng(5)
    text = " ".join([sentence(rng, "bb", 200), "Released under the MIT License.", sentence(rng, "bb", 200), "Licensed under CC BY-NC 4.0.", sentence(rng, "bb", 100)])
    assert [(f, text[a:b]) for f, a, b, _ in licenses.found_in(["", text, None], licence_model)[1]] == [("mit", "Released under the MIT License"), ("cc", "Licensed under CC BY-NC 4.0")]


def test_every_language_is_learnt(spark):
    # more languages than 200, three documents each, and one language of long documents alone
    names = [f"l{i:03d}" for i in range(210)]
    rows = [(3 * k + j, (chr(0x4E00 + 7 * k) + chr(0x4E01 + 7 * k)) * 30, lang) for k, lang in enumerate(names) for j in range(3)]
    rows += [(5000 + i, "шщ " * 8000, "long") for i in range(4)] + [(6000, "", "empty"), (6001, None, "empty")]
    docs = spark.createDataFrame([r for r in rows if not held(r[0]) or r[2] != "long"], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    learnt = {lang for i, t, lang in rows if not held(i) and t}
    assert set(model.languages) == learnt and len(learnt) > 200 and "long" in learnt
    found = langid.identify([t for _, t, lang in rows if lang in learnt], model)[0]
    assert np.mean([a == lang for a, lang in zip(found, (x for _, _, x in rows if x in learnt), strict=True)]) > 0.97


def test_licences_beside_letters_with_longer_lower_forms(licence_model):
    text = "kalo \u0130miten\nReleased under the MIT License.\nRULO"
    assert [(f, text[a:b]) for f, a, b, _ in licenses.found_in([text], licence_model)[0]] == [("mit", "Released under the MIT License.")]
    assert licenses.folded("A\u0130B") == "a\u0130b"


def plain_licence(paragraph, model):
    """The class probabilities of one paragraph, word by word and n-gram by n-gram."""
    mask, prime = 2**64 - 1, 0x9E3779B97F4A7C15

    def mix(h):
        h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & mask
        return h ^ (h >> 29)

    words = "".join(c if c.isalnum() else " " for c in licenses.folded(paragraph)).split()
    hashes = [mix(sum((ord(c) + 1) * pow(prime, i, 2**64) for i, c in enumerate(w)) & mask) for w in words]
    total, n = np.zeros(len(model.families)), 0
    for size in (1, 2, 3):
        for i in range(len(words) - size + 1):
            run = hashes[i]
            for h in hashes[i + 1 : i + size]:
                run = mix((run * prime + h) & mask)
            total, n = total + model.weights[run >> 48], n + 1
    z = model.sharp * (total / max(n, 1) ** 0.5 + model.bias)
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_licence_classifier_against_plain_loops(licence_model):
    rng = np.random.default_rng(9)
    texts = ["Released under the MIT License.", sentence(rng, "bb", 12), "a", "İ x", licenses.TEMPLATES["gpl"][0]]
    codes, starts = licenses.textvec.codes_of([licenses.folded(t) for t in texts])
    got = licenses._softmax(licenses._logits(codes, starts, licence_model))
    assert np.allclose(got, [plain_licence(t, licence_model) for t in texts], atol=1e-4)


def test_licence_scan_against_a_scan_line_by_line(licence_model):
    """Short lines, each judged by itself: what passes the certainty and shares half of a template."""
    rng = np.random.default_rng(10)
    pool = ["Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "Some warranty ends.", sentence(rng, "aa", 9), sentence(rng, "cc", 5), ""]
    texts = ["\n".join(pool[k] for k in rng.integers(0, len(pool), 6)) for _ in range(40)]
    for text, found in zip(texts, licenses.found_in(texts, licence_model), strict=True):
        want, at = [], 0
        for line in text.split("\n"):
            p = plain_licence(line, licence_model)
            family = licence_model.families[int(p.argmax())]
            if family != licenses.NONE and p.max() >= licence_model.least and licenses.confirmed(line, family) >= licenses.SHARED:
                want.append((family, at, at + len(line)))
            at += len(line) + 1
        assert [x[:3] for x in found] == want, text


NOTICES = [("Released under the MIT License", "mit"), ("Licensed under CC BY-NC 4.0", "cc"), ("Licensed under the Apache License, Version 2.0", "apache"), ("Released under the BSD License", "bsd"), ("Licensed under the Mozilla Public License, version 2.0", "mpl"), ("Released under CC0 1.0 Universal", "cc0")]


@pytest.mark.parametrize("gap", [0, 1, 2, 3, 5, 8])
def test_neighbouring_licences_in_a_long_line(licence_model, gap):
    """Two and three notices side by side, at each place against the windows."""
    rng = np.random.default_rng(30 + gap)
    for before in range(0, 16, 3):
        for n in (2, 3):
            some = [NOTICES[i] for i in rng.choice(len(NOTICES), n, replace=False)]
            words = [sentence(rng, "bb", 80 + before)]
            for text, _ in some:
                words += [text, *([sentence(rng, "bb", gap).rstrip(".")] if gap else [])]
            text = " ".join([*words, sentence(rng, "bb", 80)])
            assert [(f, text[a:b]) for f, a, b, _ in licenses.found_in([text], licence_model)[0]] == [(f, t) for t, f in some]


def test_two_families_in_one_short_line(licence_model):
    text = "Released under the MIT License. Licensed under the Apache License, Version 2.0."
    assert [(f, text[a:b]) for f, a, b, _ in licenses.found_in([text], licence_model)[0]] == [("mit", "Released under the MIT License"), ("apache", "Licensed under the Apache License, Version 2.0")]


def test_licence_training_reads_whole_texts(spark, monkeypatch):
    """Lines late in long texts are drawn like others; a long line gives a piece of it."""
    seen = []
    monkeypatch.setattr(licenses, "train", seen.append)
    rows = [(i, "\n".join(f"d{i} line {j}" for j in range(2000)) + "\n" + "x" * 50_000) for i in range(6)] + [(None, None), (7, "")]
    licenses.fit(spark.createDataFrame(rows, "doc_id long, text string"), most=400, paragraphs=300)
    assert len(seen[0]) == 300 and any(int(x.split()[-1]) > 1500 for x in seen[0] if x[0] == "d")
    licenses.fit(spark.createDataFrame(rows, "doc_id long, text string"), most=400, paragraphs=100_000)
    assert len(seen[1]) == 6 * 2001 and sorted(map(len, seen[1]))[-6:] == [licenses.LINE] * 6
