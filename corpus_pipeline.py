"""The corpus pipeline: toxicity, language, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of documents. Stages work on whatever their predecessor
kept; models are fitted on `docs` as the stage gets them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, langid, packing, pii, simhash, toxicity

#: The language stage rejects texts without letters and those whose best language is less likely than this.
LEAST_CERTAIN = 0.35


def _judged(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], added: tuple[str, ...]) -> DataFrame:
    """operator(docs), with docs' own columns of the names that it adds kept aside as _own_…"""
    return operator(docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c in added}))


def _restored(judged: DataFrame, docs: DataFrame, added: tuple[str, ...]) -> DataFrame:
    """The columns of docs, as they came in."""
    return judged.select(*[F.col(f"_own_{c}").alias(c) if c in added else F.col(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below 0.5."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    added = ("score", "predicted")
    return _restored(_judged(docs, lambda d: toxicity.scored(d, model), added).filter("predicted = 0"), docs, added)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the model recognises, and sets lang where it was missing."""
    model, added = langid.fit(docs), ("lang_pred", "score")
    found = _judged(docs, lambda d: langid.identified(d, model), added)
    found = found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN))
    return _restored(found.withColumn("lang", F.coalesce("lang", "lang_pred")), docs, added)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word shingles)."""
    return simhash.deduplicated(docs, words=5)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces spans of personal data by their kind; n_chars follows the text."""
    ready = common.materialize(pii.prepared(docs), "pipeline-candidates")
    done = pii.redacted(ready, pii.fit(ready))
    if "n_chars" not in docs.columns:
        return done
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: doc_id, piece, n_words, bin, start."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.let_workers_import(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not pack:
            docs = common.materialize(docs, f"pipeline-{name}")
    return docs


#: Models, near-copy components and best-fit bins have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None
