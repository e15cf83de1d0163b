"""Derivatives of WARC responses: metadata and plain-text conversion records.

A response record becomes two records: a ``conversion`` with the visible text of the
page and a ``metadata`` record (``application/warc-fields``) with what was read from the
response.  Both refer to the response (``WARC-Refers-To``), keep its target address and
date and have digests of their own; the metadata record keeps the source's headers and
digests.  Identifiers are derived from the source's identifier, so a task that runs
twice makes the same records.

Edge cases: a null or empty page is a response with an empty body, whose conversion has
an empty text; a null address is left out of the headers; a null id is the empty text
in the identifier; broken markup never raises; bytes that are not UTF-8 are replaced;
repeated rows give repeated records; other columns are dropped.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The date of records made from tables that have none.
DATE = "1970-01-01T00:00:00Z"
SPACE_OF_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: names that are addresses

RECORD = (
    "page_id long, record_id string, warc_type string, refers_to string, target_uri string, warc_date string, "
    "content_type string, block_digest string, payload_digest string, content_length long, headers map<string,string>, block binary"
)

HIDDEN = re.compile(r"<(script|style|template|noscript|head)\b", re.I)
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "template", "noscript", "head", "title")}
TITLE = re.compile(r"<title\b", re.I)
LINK = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", re.I)
BREAK = re.compile(r"</?(p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|blockquote|pre)\b", re.I)
LANGUAGE = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_NAMES, '|'.join('' if p is None else str(p) for p in parts))}>"


def marks(page: str, hidden: bool) -> Iterator[tuple[int, int, bool]]:
    """``start, end, unseen`` of tags and comments, and of ``hidden`` elements as a whole.

    One way forward over the page: an end that is missing once is not looked for again,
    so that the time grows with the page alone, however broken it is.
    """
    at, endless = 0, set()

    def after(name: str, start: int) -> int:
        if name in endless:
            return -1
        if name == "comment":
            found = page.find("-->", start)
            end = found + 3 if found >= 0 else -1
        else:
            closing = CLOSING[name].search(page, start)
            end = closing.end() if closing else -1
        if end < 0:
            endless.add(name)
        return end

    while (start := page.find("<", at)) >= 0:
        element = HIDDEN.match(page, start) if hidden else None
        end = -1
        if page.startswith("<!--", start):
            end = after("comment", start + 4)
        elif element:
            end = after(element[1].lower(), element.end())
        unseen = end >= 0
        if not unseen:
            end = page.find(">", start) + 1
            if not end:
                return
        yield start, end, unseen
        at = end


def plain_text(page: str) -> str:
    """Visible text, a line for each block."""
    parts, last = [], 0
    for start, end, unseen in marks(page, True):
        parts += page[last:start], " " if unseen else "\n" if BREAK.match(page, start, end) else ""
        last = end
    parts.append(page[last:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(parts)).split("\n"))
    return "\n".join(line for line in lines if line)


def facts(page: str, response: dict) -> list[tuple[str, str]]:
    """Fields of the metadata block; what stands in comments is left out."""
    found = [("source-" + k.lower(), v) for k, v in response["headers"].items()]
    title = language = None
    links = []
    for start, end, unseen in marks(page, False):
        if unseen:
            continue
        if title is None and TITLE.match(page, start, end):
            closing = CLOSING["title"].search(page, end)
            title = page[end : closing.start()] if closing else ""
        if language is None and (match := LANGUAGE.match(page, start, end)):
            language = match[1]
        if match := LINK.match(page, start, end):
            links.append(match[1])
    if title:
        found.append(("title", " ".join(html.unescape(title).split())))
    if language:
        found.append(("language", language))
    return found + [("outlink", html.unescape(link)) for link in links]


def record(page_id, kind: str, identity: str, block: bytes, content_type: str, target, date, payload=None, refers_to=None, more=()) -> dict:
    headers = {"WARC-Type": kind, "WARC-Record-ID": identity, "WARC-Date": date or DATE}
    if refers_to:
        headers["WARC-Refers-To"] = refers_to
    if target is not None:
        headers["WARC-Target-URI"] = target
    headers |= dict(more)
    headers |= {"Content-Type": content_type, "WARC-Block-Digest": digest(block)}
    if payload is not None:
        headers["WARC-Payload-Digest"] = digest(payload)
    headers["Content-Length"] = str(len(block))
    return {
        "page_id": page_id, "record_id": identity, "warc_type": kind, "refers_to": refers_to, "target_uri": target,
        "warc_date": headers["WARC-Date"], "content_type": content_type, "block_digest": headers["WARC-Block-Digest"],
        "payload_digest": headers.get("WARC-Payload-Digest"), "content_length": len(block), "headers": headers, "block": block,
    }


def response_of(page_id, url, page: str | None) -> dict:
    """A response record of a page that was stored without its exchange."""
    body = (page or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return record(page_id, "response", record_id("response", page_id, url), head + body, "application/http; msgtype=response", url, None, body)


def derive(response: dict) -> list[dict]:
    """The metadata and conversion records of a response."""
    head, _, body = response["block"].partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    source, target, date = response["record_id"], response["target_uri"], response["warc_date"]
    text = plain_text(page).encode("utf-8", "replace")
    conversion = record(
        response["page_id"], "conversion", record_id("conversion", source), text, "text/plain; charset=utf-8", target, date, None, source,
        [("WARC-Source-Payload-Digest", response["payload_digest"] or digest(body))],
    )
    fields = [("source-block-digest", response["block_digest"]), ("source-payload-digest", response["payload_digest"] or digest(body))]
    fields += [("http-" + k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])]
    fields += [("conversion", conversion["record_id"]), *facts(page, response)]
    block = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode("utf-8", "replace")
    metadata = record(response["page_id"], "metadata", record_id("metadata", source), block, "application/warc-fields", target, date, None, source)
    return [metadata, conversion]


def serialise(item: dict) -> bytes:
    """The bytes of a record in a WARC file, as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in item["headers"].items()) + "\r\n"
    return gzip.compress(head.encode("utf-8", "replace") + item["block"] + b"\r\n\r\n", mtime=0)


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or of gzip members."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        if end < 0:
            return
        lines = data[start:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = int(headers.get("Content-Length", "0"))
        block = data[end + 4 : end + 4 + length]
        at = end + 4 + length
        yield {
            "page_id": None, "record_id": headers.get("WARC-Record-ID"), "warc_type": headers.get("WARC-Type"),
            "refers_to": headers.get("WARC-Refers-To"), "target_uri": headers.get("WARC-Target-URI"), "warc_date": headers.get("WARC-Date"),
            "content_type": headers.get("Content-Type"), "block_digest": headers.get("WARC-Block-Digest"),
            "payload_digest": headers.get("WARC-Payload-Digest"), "content_length": length, "headers": headers, "block": block,
        }


def _emit(rows: list[dict], fields: pa.Schema) -> pa.RecordBatch:
    columns = [[list(r["headers"].items()) for r in rows] if f.name == "headers" else [r[f.name] for r in rows] for f in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (``page_id, url, html``)."""
    schema = StructType.fromDDL(RECORD)
    fields = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            yield _emit([response_of(*row) for row in zip(*(c.to_pylist() for c in batch.columns))], fields)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, schema)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; a file is read by one task, so files of a GB or less suit."""
    schema = StructType.fromDDL(RECORD)
    fields = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows = list(parse(data.as_py()))
                if rows:
                    yield _emit(rows, fields)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records, linked to them."""
    schema = StructType.fromDDL(RECORD)
    fields = to_arrow_schema(schema)
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                response = dict(zip(names, row))
                response["headers"] = dict(response["headers"] or {})
                response["block"] = response["block"] or b""
                rows += derive(response)
            yield _emit(rows, fields)

    return records.where("warc_type = 'response'").select(*names).mapInArrow(run, schema)
