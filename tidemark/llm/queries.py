"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, common, langid, licenses, lines, packing, pieces, pii, quality, resample, simhash, spelling, toxicity, warc


#: Where the public tokenizer files lie; read on the driver alone.
MODEL = os.environ.get("TIDEMARK_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scanned(docs, licenses.fit(docs), keep_text=False)
    families = F.array_join(F.array_sort(F.array_distinct(F.col("licences.family"))), ",")
    spans = F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x.family, x.start, x.end)), ",")
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), families.alias("families"), spans.alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ready = common.materialize(pii.prepared(docs).drop("text"), "pii-candidates")
    return pii.spans(ready, pii.fit(ready))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")), keep_text=False)
    return scored.select("doc_id", common.is_held_out().alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identified(docs.select("doc_id", "text"), langid.fit(docs), keep_text=False)
    return found.select("doc_id", common.is_held_out().alias("held_out"), "lang_pred", "score")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judged(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept", "distance")


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return pieces.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.Model.load(model))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(_table(spark, sf_dir, "documents")))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_licenses, op3_pii, op4_toxicity, op5_language, op6_packing, op7_quality, op8_sentencepiece, op9_simhash, op10_neighbours, op11_spelling, op12_lines, op13_resampling)}
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
#: The usual table of CRC-32, made in SQL, and the checksum of a text's UTF-8 bytes by it.
_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab)"""


def _crc(text: str) -> str:
    digit = lambda at: f"(strpos('123456789ABCDEF', substr(hex({text}), CAST({at} AS INT), 1)))"
    bytes_of = f"list_transform(range(strlen({text})), lambda j: CAST(16 * {digit('2 * j + 1')} + {digit('2 * j + 2')} AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {bytes_of}), lambda c, b: xor(c // 256, tab[xor(c, b) % 256 + 1])), 4294967295)"


#: DuckDB SQL where SQL can express the operator; it writes no archives, but the rows that come back are those of this query.
ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to,
               TRUE AS verified
        FROM f""",
    "op11_spelling": rf"""
        WITH {_CRC},
        d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
        r AS (SELECT id, run, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL),
        h AS (SELECT run, n, {_crc("id || ':' || run")} AS h FROM r, crc),
        w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        k AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INT) AS i FROM v)),
        pairs AS (SELECT a.word, b.word AS other, b.n FROM k AS a JOIN k AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT v.word, k.word, k.n FROM v JOIN k ON k.rest = v.word
            UNION SELECT k.word, v.word, v.n FROM v JOIN k ON k.rest = v.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS form_n FROM pairs GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN other END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
        chain AS (SELECT word, word AS here, form AS next FROM f UNION ALL SELECT chain.word, f.word, f.form FROM chain JOIN f ON f.word = chain.next)
        SELECT f.word, f.form, chain.here AS root, f.n, f.n_near, f.form_n FROM f JOIN chain ON chain.word = f.word AND chain.next IS NULL""".replace("WITH", "WITH RECURSIVE", 1),
    "op12_lines": rf"""
        WITH l AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        k AS (SELECT row, doc_id, len(lines) AS n_lines, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l),
        s AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_UPPER}, {_LOWER}) AS key FROM k),
        often AS (SELECT key FROM s WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
        SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(count(often.key) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(CASE WHEN often.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
        FROM s LEFT JOIN often ON s.key = often.key GROUP BY row, doc_id, n_lines""",
    "op13_resampling": rf"""
        WITH {_CRC},
        docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        goal AS (SELECT regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        fd AS (SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs),
        fg AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM goal),
        names AS (SELECT f FROM fd UNION SELECT f FROM fg),
        placed AS (SELECT f, {_crc("f")} % 10000 AS b FROM names, crc),
        s AS (SELECT b, count(*) AS s FROM fd JOIN placed USING (f) GROUP BY b),
        t AS (SELECT b, count(*) AS t FROM fg JOIN placed USING (f) GROUP BY b),
        st AS (SELECT b, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t, CAST((SELECT count(*) FROM fd) AS DOUBLE) AS big_s, CAST((SELECT count(*) FROM fg) AS DOUBLE) AS big_t FROM s FULL JOIN t USING (b)),
        g AS (SELECT b, CAST(floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) AS BIGINT) AS gain FROM st),
        per AS (SELECT row, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM fd JOIN placed USING (f) JOIN g USING (b) GROUP BY row),
        sc AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h FROM docs LEFT JOIN per USING (row)),
        sd AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, n_words >= 20 AND doc_id IS NOT NULL AS may FROM sc),
        r AS (SELECT *, CASE WHEN may THEN row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id, n_features) END AS place, count(*) FILTER (may) OVER () AS big_n FROM sd)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 25 * big_n // 100 THEN place END AS rank FROM r""",
}
