"""WARC archives compressed record by record with a Zstandard dictionary.

An archive begins with a skippable frame that holds the dictionary (magic number 0x184D2A5D, length,
bytes); every record follows as a frame of its own, so that a reader can start at any of them. The
dictionary is built from a bounded sample of the records. Payloads that an earlier page has become
revisit records without a body. A task writes archives under names of its own into the shared folder
and reports them; only what a finished task reports belongs to the result, so lost executors and
repeated attempts leave nothing but unused files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.llm.common import keep, order_id, same, table
from rowtide.sources.tables import run_dir

MAGIC = 0x184D2A5D
#: Payloads under this size are never deduplicated.
SMALL = 100
#: Bytes of the dictionary, records and bytes it is built from at most, bytes of an archive.
DICTIONARY, SAMPLE_ROWS, SAMPLE_BYTES, ARCHIVE = 65_536, 1_000, 8_000_000, 64_000_000
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: int | None) -> bytes:
    """One record; ``payload`` is null for a revisit of the page ``refers``."""
    revisit = payload is None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:x-page:{page}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")), ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Refers-To", f"<urn:x-page:{refers}>"), ("WARC-Profile", PROFILE)] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, in lower case, and block of a record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a record's length does not agree with its header")
    return fields, rest[:size]


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A Zstandard dictionary; too few or too small samples serve as they are, as plain content."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an open archive, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("the archive does not begin with a dictionary")
    held = source.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    inner, parts = reader.decompressobj(), []
    while chunk := source.read(1 << 16):
        while chunk:
            parts.append(inner.decompress(chunk))
            if not inner.eof:
                break
            yield read_record(b"".join(parts))
            chunk, inner, parts = inner.unused_data, reader.decompressobj(), []
    if parts:
        raise ValueError("the archive is cut off")


#: Schemes of Spark's file systems that have another name among Arrow's.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address as Spark writes it. Archives are streamed by the workers, so
    the scheme must be one that Arrow can write to; another one raises an error that names it."""
    scheme, colon, rest = uri.partition(":")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


def plan(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """``(page_id, url, payload, size, digest, refers_to)``: what to write for each page, the payload
    null for a revisit. Only pages that share their payload take part in the search for the first."""
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = same(pages, ["page_id", "url", "html"]).select(F.col("page_id").cast("long").alias("page_id"), order_id("page_id").alias("ord"), "url", body.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("size"), F.sha2("payload", 256).alias("digest"))
    brief = keep(rows.select("ord", "page_id", "size", "digest"), "digests")
    firsts = brief.where(F.col("size") >= small).groupBy("digest").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last")
    firsts = keep(firsts, "firsts")
    again = brief.join(firsts, "digest").where("ord > first").select("ord", "digest", F.col("first").alias("refers_to")).distinct()
    joined = rows.join(again, ["ord", "digest"], "left")
    return joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"), "size", "digest", "refers_to")


def write(pages: DataFrame, folder: str, small: int = SMALL, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives below ``folder``, an address that all executors
    reach, and return ``(path, records, bytes)`` of each archive.

    Of pages with equal payloads of at least ``small`` bytes the smallest page_id is a response, the
    others are revisits of it; null ids come after all others, and rows that share both id and payload
    are of the same kind. A null html is an empty payload. Other columns are ignored; an empty table
    gives no archives.
    """
    rows = plan(pages, small)
    texts = same(pages, ["page_id", "url", "html"]).where("html is not null")
    share = max(1, texts.count() // SAMPLE_ROWS)
    picked = texts.where((F.pmod(F.xxhash64("page_id", "html"), F.lit(share)) == 0) & (F.length("html") < SAMPLE_BYTES // 20)).limit(2 * SAMPLE_ROWS)
    samples, total = [], 0
    for r in picked.toLocalIterator():
        body = r.html.encode()
        samples.append(record(r.page_id, r.url, body, len(body), hashlib.sha256(body).hexdigest(), None))
        total += len(samples[-1])
        if total > SAMPLE_BYTES:
            break
    held = build_dictionary(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = _filesystem(folder)
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held) if held else None, write_content_size=True)
        done: list[tuple[str, int, int]] = []
        out, name, count, size = None, "", 0, 0
        for batch in batches:
            for page in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if out is None:
                    system.create_dir(place, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, count, size = system.open_output_stream(f"{place}/{name}", compression=None), 0, 0
                    size += out.write(leading_frame(held)) or 0
                frame = coder.compress(record(*page))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size > archive_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        if done:
            cols = [pa.array(c, k) for c, k in zip(zip(*done), (pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "records", "bytes"])

    return keep(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives: ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to)``,
    length and digest from the payload itself where there is one, which must agree with the header."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def page_of(name: str) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+|None)>", name)
        return None if found is None or found[1] == "None" else int(found[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                system, place = _filesystem(path)
                with system.open_input_stream(place, compression=None) as source:
                    for fields, block in read_archive(source):
                        http, payload = block.split(b"\r\n\r\n", 1)
                        digest, size = fields["warc-payload-digest"].removeprefix("sha256:"), int(http.rsplit(b": ", 1)[1])
                        if fields["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: the payload of {fields['warc-record-id']} does not agree with its digest")
                        refers = page_of(fields.get("warc-refers-to", ""))
                        rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"], refers))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    parts = max(1, archives.count())
    dealt = archives.select("path").repartition(min(parts, 100_000))
    return dealt.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "pages"), run_dir(spark, "warc"))).drop("url")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""
