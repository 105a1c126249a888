"""WARC derivatives (operator 5): metadata and plain-text records from responses.

A response record is its WARC header lines, a blank line and an HTTP response.
Each gives two records linked to it by WARC-Refers-To: ``metadata`` (JSON: the
source's WARC and HTTP headers, digests, title, link count) and ``conversion``
(the page's visible text, one line a block).  Target URI, date and, as
WARC-Refers-To-Target-URI/-Date, the source's are kept; block digests are
SHA-1 in base 32, as is usual for WARC.

Files: a record ends with two line ends, which is the line separator Spark's
text writer is given, so WARC files (gzip by default) are written by Spark in
any store that it can write.  ``read_warc`` has Spark's text reader cut files
where one record ends and the next begins, so files are read in pieces and
never held; a payload that itself holds such a place is put together again by
its Content-Length.

Defined results: a null or empty page is a response with an empty payload, and
its conversion has an empty block.  A null url is an empty target.  Repeated
pages give records of their own: ids come from the content and the row's place
in the table.  An empty table gives no rows.  Broken records (no blank line, a
wrong Content-Length) raise in ``read_warc``, and so does a record put together
of pieces that fall into two splits of a file, which compressed files don't
have.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm import html_text
from veritrail.llm.common import Scratch, materialize

_END = b"\r\n"
_RECORD = "record_id string, record_type string, refers_to string, target_uri string, warc_date string, content_type string, content_length long, block_digest string, payload_digest string, record binary"
_FIELDS = [x.split()[0] for x in _RECORD.split(", ")]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def build(kind: str, name: str, target: str, date: str, content_type: str, block: bytes, extra: list[tuple[str, str]], payload: bytes | None = None) -> tuple:
    """A record's row; ``name`` tells it from all others of its kind; ``record`` holds the bytes without the two line ends that close it."""
    block_digest = digest(block)
    rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {name} {target} {block_digest}')}>"
    payload_digest = block_digest if payload is None else digest(payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Target-URI", re.sub(r"[\r\n]", "", target)), ("WARC-Date", date), *extra, ("WARC-Block-Digest", block_digest), ("WARC-Payload-Digest", payload_digest), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + _END + block
    return rid, kind, dict(extra).get("WARC-Refers-To"), target, date, content_type, len(block), block_digest, payload_digest, raw


def headers_of(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header lines after the first, and what follows the blank line."""
    head, _, body = block.partition(_END + _END)
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)], body


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64() if f == "content_length" else pa.binary() if f == "record" else pa.string() for f in _FIELDS]
    columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_FIELDS)


def responses(pages: DataFrame, date: str) -> DataFrame:
    """Response records of crawled pages (url, html); ``date`` is the crawl's WARC-Date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for place, url, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                body = (page or "").encode("utf-8", "surrogatepass")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body
                rows.append(build("response", str(place), url or "", date, "application/http; msgtype=response", block, [], body))
            yield _rows(rows)

    return pages.select(F.monotonically_increasing_id().alias("place"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, _RECORD)


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response of ``records`` (record); others are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for raw in batch.column(0).slice(at, 256).to_pylist():
                    head, block = headers_of(raw)
                    source = dict(head)
                    if source.get("WARC-Type") != "response":
                        continue
                    http, body = headers_of(block)
                    page = body.decode("utf-8", "replace")
                    target, date = source.get("WARC-Target-URI", ""), source.get("WARC-Date", "")
                    link = [("WARC-Refers-To", source["WARC-Record-ID"]), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)]
                    title = re.search(r"<title[^>]*>(.*?)</title", page, re.I | re.S)
                    about = {"Envelope": {"WARC-Header-Metadata": source, "Payload-Metadata": {"HTTP-Response-Metadata": {"Status-Line": block.split(_END, 1)[0].decode("latin-1"), "Headers": dict(http), "Entity-Length": len(body), "Entity-Digest": digest(body), "HTML-Metadata": {"Title": title and html_text.html_lib.unescape(title[1]).strip(), "Links": len(re.findall(r"<a\s[^>]*href", page, re.I))}}}}}
                    rows.append(build("metadata", source["WARC-Record-ID"], target, date, "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogatepass"), link))
                    rows.append(build("conversion", source["WARC-Record-ID"], target, date, "text/plain", "\n".join(b.text for b in html_text.blocks(page)[0]).encode("utf-8", "surrogatepass"), link))
                yield _rows(rows)

    return records.select("record").mapInArrow(run, _RECORD)


#: Where one record ends and the next begins, up to the version's last digit.
_BETWEEN = b"\r\n\r\nWARC/1."


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write ``record`` of each row into WARC files, one for each partition."""
    options = {"lineSep": "\r\n\r\n", "compression": compression, "zlib.compress.level": "BEST_SPEED"}
    records.select(F.col("record").cast("string").alias("value")).write.options(**options).text(path)


def _parsed(raw: bytes) -> tuple | None:
    """The row of a whole record, less the two line ends behind a file's last; None if more of it is to come."""
    blank = raw.find(_END + _END)
    if blank < 0:
        return None
    source = dict(headers_of(raw[: blank + 4])[0])
    missing = int(source["Content-Length"]) - (len(raw) - blank - 4)
    if missing == -4 and raw.endswith(_END + _END):
        raw = raw[:-4]
    elif missing:
        if missing < 0:
            raise ValueError(f"record {source.get('WARC-Record-ID')} is longer than its Content-Length")
        return None
    return source["WARC-Record-ID"], source["WARC-Type"], source.get("WARC-Refers-To"), source.get("WARC-Target-URI"), source.get("WARC-Date"), source.get("Content-Type"), int(source["Content-Length"]), source.get("WARC-Block-Digest"), source.get("WARC-Payload-Digest"), raw


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``, plain or compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = b""
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = []
                for piece in batch.column(0).slice(at, 500).to_pylist():
                    first = piece.startswith(b"WARC/1.")
                    if begun and first:
                        raise ValueError("a file ends within a record")
                    raw = piece if first else begun + _BETWEEN + piece if begun else _BETWEEN[4:] + piece
                    row = _parsed(raw)
                    begun = b"" if row else raw
                    if row:
                        rows.append(row)
                yield _rows(rows)
        if begun:
            raise ValueError("a file or a split of one ends within a record")

    lines = spark.read.option("lineSep", _BETWEEN.decode()).text(path)
    return lines.select(F.col("value").cast("binary")).where(F.length("value") > 0).mapInArrow(run, _RECORD)


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written into WARC files as a response, read back, and derived into WARC files: the derivatives' ids, links, headers and digests, and the SHA-256 of their bytes, from those files."""
    with Scratch(spark) as scratch:
        source, derived = scratch.path("warc"), scratch.path("warc-derived")
        write_warc(responses(spark.read.parquet(f"{sf_dir}/pages.parquet").select("url", "html"), "2024-01-01T00:00:00Z"), source)
        write_warc(derive(read_warc(spark, source)), derived)
        return materialize(read_warc(spark, derived).select(*_FIELDS[:-1], F.sha2("record", 256).alias("record_sha256")), "warc-records")
