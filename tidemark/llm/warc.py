"""WARC archives: one gzip member per record, written and read in sequence.

Writing: the payload's digest is taken in the JVM; of equal payloads of at least REVISIT bytes the one with
the smallest page_id becomes a response record, the others become revisit records, which hold headers only
and refer to it. The join that finds them moves each row by its digest; rows whose payload is too short to
be revisited get keys of their own, so they don't meet in one task, and a payload that a third of all
pages share is a skewed join that Spark splits. Archives are written through Spark's own writer, so any
file system that Spark knows will do: rows are whole gzip members, and the writer's line separator is an
empty gzip member, which any reader of multi-member gzip skips.

Reading: the archive is walked member by member with an incremental zlib decompressor; each record is
framed by its Content-Length, which must end exactly where the member does, and block and payload digests
are verified. A broken record raises, or comes out with verified = false if strict is off.

Null html counts as an empty payload. Rows with a null page_id are archived without an id and read back as
null. Of rows that repeat the smallest page_id of a payload each is a response. An empty table makes an
empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

REVISIT = 100  # bytes a payload must have to be revisited
LEVEL = 4  # of zlib
DATE = "1970-01-01T00:00:00Z"  # pages carry no time; a fixed one keeps archives reproducible
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    """data as one gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


#: An empty member, as text whose latin-1 bytes it is.
_EMPTY = gzip_member(b"").decode("latin-1")


def record_of(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 response record, or a revisit record if refers_to is given, uncompressed.

    The HTTP headers of a revisit keep the payload's Content-Length, so the length of what isn't repeated is known."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = "" if page_id is None else str(page_id)
    target = "".join(c for c in (url or "urn:page:" + name) if c >= " " and c != "\x7f")
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{payload_digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if revisit else []),
        f"Content-Type: application/http; msgtype={'response'}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(headers).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(archive: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one after the other, each decompressed in steps; empty ones are skipped."""
    view, at = memoryview(archive), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends inside a gzip member")
            parts.append(z.decompress(view[at : at + _CHUNK]))
            at += min(_CHUNK, len(view) - at)
        at -= len(z.unused_data)
        if data := b"".join(parts):
            yield data


def _headers(data: bytes) -> tuple[str, dict[str, str], int]:
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("a record without the end of its headers")
    first, *rest = data[:end].decode("utf-8", "surrogatepass").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}, end + 4


def read_record(data: bytes, strict: bool = True) -> dict | None:
    """A response or revisit record as a dict; None for other types. Frames by Content-Length and verifies digests."""
    version, head, at = _headers(data)
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:20]!r}")
    length = int(head["content-length"])
    block = data[at : at + length]
    if len(block) != length or data[at + length :] != b"\r\n\r\n":
        raise ValueError(f"record {head.get('warc-record-id')}: Content-Length is {length}, the member holds {len(data) - at - 4}")
    kind = head["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    _, http, body = _headers(block)
    payload, digest = block[body:], head["warc-payload-digest"].partition(":")[2]
    whole = int(http["content-length"])
    good = hashlib.sha256(block).hexdigest() == head["warc-block-digest"].partition(":")[2]
    if kind == "response":
        good &= len(payload) == whole and hashlib.sha256(payload).hexdigest() == digest
    if strict and not good:
        raise ValueError(f"record {head.get('warc-record-id')}: digests don't hold")
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    return {"page_id": number(head["warc-record-id"]), "url": head["warc-target-uri"], "payload": payload if kind == "response" else None, "payload_bytes": whole, "payload_digest": digest, "record_type": kind, "refers_to": number(head.get("warc-refers-to", "")), "verified": good}


ARCHIVE = 5000  # records of an archive file: one task reads a file as a whole


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", level: int = LEVEL) -> None:
    """A record for each row, in one archive file for each partition."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long_enough = F.octet_length("payload") >= REVISIT
    # only digests that occur twice or more matter; the narrow table below has those alone
    first = rows.filter(long_enough).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("key"), "first")
    keyed = rows.withColumn("key", F.when(long_enough, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")))))
    joined = keyed.join(first, "key", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                number, target, body, digest, other = (x.as_py() for x in row)
                out.append(gzip_member(record_of(number, target, body, digest, other), level))
                size += len(out[-1])
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    made = joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to")).mapInArrow(records, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", _EMPTY).option("maxRecordsPerFile", ARCHIVE).text(path)


_READ = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("verified", T.BooleanType())])


def read(spark: SparkSession, path: str, strict: bool = True, payloads: bool = False) -> DataFrame:
    """A row for each response and revisit record of the archives at path; with url and payload (null for revisits) if asked for."""
    schema = T.StructType([*_READ.fields, *([T.StructField("url", T.StringType()), T.StructField("payload", T.BinaryType())] if payloads else [])])
    names = schema.names
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "verified": pa.bool_(), "payload": pa.binary()}
    arrow = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                for member in members(content.as_buffer()):
                    if (r := read_record(member, strict)) is not None:
                        rows.append({n: r[n] for n in names})
                    if len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    path = common.scratch_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
