"""WARC derivatives: each response becomes a metadata and a plain-text conversion record that refer to it.

Input rows: record_id, target_uri, warc_date, headers (the source's HTTP headers), payload, of a table or of WARC files.
Both derived records name the response in WARC-Refers-To, repeat its target and date, keep its headers and payload
digest, and carry digests of their own blocks. write() and read() keep records in WARC/1.1 files.

Defined cases: a null payload counts as empty, and still gives both records; a null URI, date or header stays null, and
out of the record's head; a response without an id gets one from its URI and payload; derived ids follow from the
response's id and payload, so that different responses have different ones, and rows that repeat a response repeat its
records, ids included; control characters in fields are percent-encoded in links and spaces elsewhere; an empty table
gives no records; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SKIP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|head)\b.*?(?:</\1\s*>|\Z)", re.IGNORECASE | re.DOTALL)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|body|html)\b(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>?", re.IGNORECASE)
_TAG = re.compile(r"<[A-Za-z/!?](?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>?")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.IGNORECASE | re.DOTALL)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.IGNORECASE)
_ANCHOR = re.compile(r"<a(?=[\s/])((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CONTROL = re.compile(r"[\x00-\x1f\x7f\u0085\u2028\u2029]")
_SPACE = re.compile(r"[ \t\r\f\v]+")

SCHEMA = "response_id string, record_type string, record_id string, refers_to string, target_uri string, warc_date string, source_headers string, source_digest string, block_digest string, content_type string, content_length long, body string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    """The same response always gets the same derived ids, so a task that runs again repeats them."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}#{kind}')}>"


def links(page: str) -> list[str]:
    """The first href of each anchor, quoted or not."""
    out = []
    for a in _ANCHOR.finditer(page):
        for m in _ATTRIBUTE.finditer(a[1]):
            if m[1].lower() == "href":
                value = next((x for x in m.groups()[1:] if x is not None), None)
                if value is not None:
                    out.append(encoded(html.unescape(value).strip()))
                break
    return out


def encoded(uri: str) -> str:
    """Without characters that would end a line."""
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


def line(value) -> str:
    return _CONTROL.sub(" ", str(value))


def plain(page: str) -> str:
    """Visible text, one line per block element, white space collapsed."""
    text = _TAG.sub("", _BLOCK.sub("\n", _SKIP.sub(" ", page)))
    lines = (_SPACE.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def metadata(page: str, size: int) -> str:
    title, lang = _TITLE.search(page), _LANG.search(page)
    fields = [f"originalContentLength: {size}"]
    if lang:
        fields.append(f"declaredLanguage: {lang[1]}")
    if title:
        fields.append(f"title: {' '.join(line(html.unescape(title[1])).split())}")
    fields += [f"outlink: {x} A/@href" for x in links(page)]
    return "".join(f"{x}\r\n" for x in fields)


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rid, uri, date, headers, payload in zip(*[c.to_pylist() for c in batch.columns]):
            page = payload or ""
            raw = page.encode("utf-8", "surrogatepass")
            source = digest(raw)
            rid = rid or derived_id(f"{uri or ''}#{source}", "response")
            for kind, ctype, body in (("metadata", "application/warc-fields", metadata(page, len(raw))), ("conversion", "text/plain; charset=utf-8", plain(page))):
                block = body.encode("utf-8", "replace")
                rows.append((rid, kind, derived_id(f"{rid}#{source}", kind), rid, uri, date, headers, source, digest(block), ctype, len(block), block.decode()))
        cols = list(zip(*rows)) if rows else [[]] * 12
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 10 else pa.string()) for k, c in enumerate(cols)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records per response; row by row, so no shuffle and no state."""
    common.ship(responses.sparkSession)
    df = common.only(responses, record_id="string", target_uri="string", warc_date="string", headers="string", payload="string")
    return df.mapInArrow(_derive, SCHEMA)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (page_id, url, html), with ids derived from page and URL. The table
    has neither dates nor headers, so these are null."""
    df = common.only(pages, page_id="long", url="string", html="string")
    key = F.md5(F.concat_ws("\u0001", F.col("page_id").cast("string"), F.col("url")))
    rid = F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(key, a, n), F.lit("-" if a < 21 else ">"))])
    return df.select("page_id", rid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(None).cast("string").alias("warc_date"), F.lit(None).cast("string").alias("headers"), F.col("html").alias("payload"))


def serialise(row) -> bytes:
    """A derived row as one WARC/1.1 record."""
    uri = row["target_uri"]
    headers = row["source_headers"]
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Target-URI", None if uri is None else encoded(uri)), ("WARC-Date", row["warc_date"]), ("WARC-Block-Digest", row["block_digest"]), ("WARC-Source-Payload-Digest", row["source_digest"]), ("WARC-Source-Headers", None if headers is None else base64.b64encode(headers.encode()).decode()), ("Content-Type", row["content_type"]), ("Content-Length", row["content_length"])]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {line(v)}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + row["body"].encode() + b"\r\n\r\n"


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a WARC file's bytes; names of fields as they are written."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split("\r\n")
        head = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        body = end + 4
        size = int(next(v for k, v in head.items() if k.lower() == "content-length"))
        out.append((head, data[body : body + size]))
        at = body + size + 4
    return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([serialise(r)[:-4].decode() for r in batch.to_pylist()], pa.string())], names=["value"])


#: Records of a WARC file at most.
FILE_RECORDS = 20_000


def write(records: DataFrame, to: str) -> None:
    """Derived rows as WARC/1.1 files in the folder `to`, committed by Spark's writer: the end of a record is its
    line separator."""
    common.ship(records.sparkSession)
    lines = records.select(*[x.split()[0] for x in SCHEMA.split(", ")]).mapInArrow(_records, "value string")
    lines.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", FILE_RECORDS).text(to)


RECORD = "record_type string, record_id string, refers_to string, target_uri string, warc_date string, headers string, source_headers string, source_digest string, block_digest string, content_type string, payload string"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            data = content.as_buffer().to_pybytes()
            rows = []
            for head, body in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                low = {k.lower(): v for k, v in head.items()}
                http = None
                if low.get("warc-type") == "response" and body.startswith(b"HTTP/"):
                    first, _, body = body.partition(b"\r\n\r\n")
                    http = first.decode("utf-8", "replace")
                kept = low.get("warc-source-headers")
                kept = None if kept is None else base64.b64decode(kept).decode("utf-8", "replace")
                rows.append((low.get("warc-type"), low.get("warc-record-id"), low.get("warc-refers-to"), low.get("warc-target-uri"), low.get("warc-date"), http, kept, low.get("warc-source-payload-digest"), low.get("warc-block-digest"), low.get("content-type"), body.decode("utf-8", "replace")))
            for a in range(0, len(rows), common.ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[a : a + common.ROWS])], names=names)


def read(spark, path: str) -> DataFrame:
    """Rows (RECORD) of all records of WARC files, plain or gzipped, each file read by one task; files of up to 2 GB.
    Those of type response have the columns that derivatives() takes."""
    common.ship(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, RECORD)
