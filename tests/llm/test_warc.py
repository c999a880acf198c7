from __future__ import annotations

import random
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc

LONG = "<p>" + "grüße 𝕏 " * 40 + "</p>"


def pages(spark):
    return spark.createDataFrame([(3, "http://x/3", LONG, "e"), (1, "http://x/1", LONG, "e"), (2, None, None, None), (4, "u\r\nWARC-Type: x", "short", "e"), (5, "http://x/5", "short", "e"), (6, "http://x/6", LONG + "!" * 300_000, "e"), (1, "http://x/1", LONG, "e"), (None, "n", LONG, "e")], "page_id long, url string, html string, record_type string")


def test_round_trip(spark, tmp_path):
    df = pages(spark)
    warc.write(df, str(tmp_path / "w"))
    rows = warc.read(spark, str(tmp_path / "w"), payloads=True).collect()
    text = {p: h or "" for p, _, h, _ in ((r.page_id, r.url, r.html, None) for r in df.collect())}
    assert len(rows) == 8 and all(r.verified for r in rows)
    for r in rows:
        body = text[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == body
    assert {(r.page_id, r.refers_to) for r in rows if r.record_type == "revisit"} == {(3, 1), (None, 1)}


def test_archives_are_plain_multi_member_gzip(spark, tmp_path):
    warc.write(pages(spark).coalesce(1), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 8 and data.count(b"\r\nWARC-Type: revisit\r\n") == 2


def test_broken_archives_are_noticed():
    record = warc.record_of(1, "http://x", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert warc.read_record(record)["page_id"] == 1
    with pytest.raises(ValueError, match="digests"):
        warc.read_record(record.replace(b"payload\r\n", b"paylaod\r\n"))
    assert not warc.read_record(record.replace(b"payload\r\n", b"paylaod\r\n"), strict=False)["verified"]
    with pytest.raises(ValueError, match="Content-Length"):
        warc.read_record(record[:-6] + record[-4:])
    member = warc.gzip_member(record)
    assert list(warc.members(member + warc.gzip_member(b"") + member)) == [record, record]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(member[:-3]))


def test_empty_table(spark, tmp_path):
    warc.write(pages(spark).filter(F.lit(False)), str(tmp_path / "w"))
    assert warc.read(spark, str(tmp_path / "w")).count() == 0


def test_payloads_beyond_one_step_of_the_reader(spark, monkeypatch):
    """Payloads that don't compress, longer than what is inflated at once, over archives of two records."""
    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(33, 0x3000)) for _ in range(n)) for n in (200_000, 70_000, 65_536, 1)] + ["x" * 3_000_000]
    monkeypatch.setattr(warc, "ARCHIVE", 2)
    df = spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.round_trip(df).collect()}
    assert got == {i: (len(t.encode()), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}
