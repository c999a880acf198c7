from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import langid, packing, pii, simhash, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rng = np.random.default_rng(1)
    part = {"en": ["ing", "the", "tion", "er"], "fr": ["eau", "ré", "que", "ou"]}
    rows = []
    for i in range(300):
        lang = "en" if i % 2 else "fr"
        words = ["".join(rng.choice(part[lang], 2)) for _ in range(60)]
        if i % 5 == 0:
            words[3] = words[30] = "scumbag"
        if i % 7 == 0:
            words[10] = f"u{i}@mail.example.com"
        rows.append((i, " ".join(words), None if i == 33 else lang, f"s{i % 3}", 0))
    rows += [(900, rows[1][1], "en", "s0", 0), (901, "12 34 !!", None, "s0", 0), (902, None, "en", "s1", 0), (903, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(300)], "doc_id long, toxic int, quality int").write.parquet(str(d / "labels.parquet"))
    return str(d)


def test_run_equals_the_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = docs.collect()
    score = dict(zip([r.doc_id for r in rows], toxicity.scores([r.text for r in rows], toxicity.fit(docs, labels)), strict=True))
    rows = [r for r in rows if score[r.doc_id] < 0.5]
    assert not any(r.doc_id < 300 and r.doc_id % 5 == 0 for r in rows) and len(rows) > 230
    model = langid.fit(spark.createDataFrame(rows, docs.schema))
    names, sure = langid.identify([r.text for r in rows], model)
    rows = [r for r, n, s in zip(rows, names, sure, strict=True) if n != "und" and s >= corpus_pipeline.LEAST_CERTAIN]
    assert {901, 902, 903}.isdisjoint(r.doc_id for r in rows)
    prints = simhash.fingerprints([r.text for r in rows], 5).tolist()
    keep = []
    for i, r in enumerate(rows):
        group = {i}
        while True:
            more = {j for j in range(len(rows)) if any(bin(prints[j] ^ prints[k]).count("1") <= 3 for k in group)}
            if more == group:
                break
            group = more
        if r.doc_id == min(rows[j].doc_id for j in group):
            keep.append(r)
    assert 900 not in {r.doc_id for r in keep} and 1 in {r.doc_id for r in keep}
    frame = spark.createDataFrame(keep, docs.schema)
    ready = pii.prepared(frame)
    clean = pii.redacted(ready, pii.fit(ready))
    assert "@" not in " ".join(r.text for r in clean.collect())
    want = packing.packed(clean)
    got = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(60)
    # extra columns of the names that operators add pass through as they are
    more = docs.withColumns({c: F.lit("own") for c in ("score", "predicted", "lang_pred", "fp", "spans", "component_id")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns and {(r.score, r.lang_pred, r.fp, r.spans) for r in out.collect()} == {("own",) * 4}


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
