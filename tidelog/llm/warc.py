"""WARC derivatives: a metadata and a plain-text conversion record for every response.

A record is a row: type, id, refers_to, target URI, date, content type, digests and block.
Derived records point back by WARC-Refers-To and keep the response's URI, date, HTTP
headers and payload digest. ``serialise`` and ``parse`` turn rows into WARC/1.1 bytes and back.
"""
from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html as entities
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import slices, text_of

FIELDS = pa.schema(
    [("key", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type")), ("content_length", pa.int64()), *((n, pa.string()) for n in ("payload_digest", "block_digest", "source_headers")), ("block", pa.binary())]
)
DDL = "key long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, payload_digest string, block_digest string, source_headers string, block binary"
_NAMES = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest"}
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122

_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|blockquote|pre|title|head|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*>", re.I), re.compile(r"</title\s*>", re.I)
_ANCHOR = re.compile(r"<a\b([^>]*)>", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HTML, _LANG = re.compile(r"<html\b([^>]*)>", re.I), re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_BLANK = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(b: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(31).join(parts))}>"


def plain_text(html: str) -> str:
    """Visible text, one line per block; entities resolved, white space collapsed, empty lines dropped."""
    return _visible(_GONE.sub("", html))


def closed(html: str) -> tuple[str, str]:
    """Up to the last ``>``, and what follows. In the first part every tag that opens also closes, so patterns that look for its end are linear."""
    end = html.rfind(">") + 1
    return html[:end], html[end:]


def _visible(shown: str) -> str:
    head, tail = closed(shown)
    s = _TAG.sub("", _BREAK.sub("\n", head)) + tail
    lines = (_BLANK.sub(" ", x).strip() for x in entities.unescape(s).split("\n"))
    return "\n".join(x for x in lines if x)


def response(key: int | None, url: str, html: str, date: str) -> tuple:
    """A response record for a page: an HTTP header and the page as its payload."""
    payload = html.encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload
    return (key, "response", record_id("response", str(key), url, digest(payload)), None, url, date, "application/http; msgtype=response", len(block), digest(payload), digest(block), None, block)


def title_of(html: str) -> str | None:
    start = _TITLE.search(html)
    end = _TITLE_END.search(html, start.end()) if start else None
    return plain_text(html[start.end() : end.start()]) if end else None


def links_of(shown: str) -> list[str]:
    found = (_HREF.search(x) for x in _ANCHOR.findall(shown))
    return [entities.unescape(m[1] or m[2] or m[3] or "") for m in found if m]


def dechunked(body: bytes) -> bytes:
    """The content of a body in chunks; what can't be read so stays as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return b"".join(out) if out else body
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else body


def content(payload: bytes, headers: list[list[str]]) -> str:
    """The page as text: transfer and content encodings undone, read in the charset that is named, or else as UTF-8."""
    named = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = dechunked(payload)
    kind = named.get("content-encoding", "")
    if "gzip" in kind or "deflate" in kind:
        for bits in (47, -15):  # with a header, then without
            try:
                payload = zlib.decompressobj(bits).decompress(payload)
                break
            except zlib.error:
                continue
    charset = _CHARSET.search(named.get("content-type", ""))
    try:
        codec = codecs.lookup(charset[1]).name if charset else "utf-8"
        return payload.decode(codec, "replace")
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace")


def derive(record: dict) -> list[tuple]:
    """The metadata and the conversion record of a response record."""
    head, _, payload = bytes(record["block"]).partition(b"\r\n\r\n")
    status, *fields = head.decode("utf-8", "replace").split("\r\n")
    headers = [x.split(":", 1) for x in fields if ":" in x]
    headers = [[k.strip(), v.strip()] for k, v in headers]
    html = content(payload, headers)
    tags = closed(html)[0]
    shown = _GONE.sub("", html)
    source = json.dumps({"status": status, "headers": headers}, ensure_ascii=False)
    root = _HTML.search(tags)
    lang = _LANG.search(root[1]) if root else None
    text = _visible(shown).encode("utf-8", "replace")
    about = {
        "url": record["target_uri"], "status": status, "headers": headers, "payload_digest": record["payload_digest"], "payload_length": len(payload),
        "title": title_of(tags), "lang": lang[1] if lang else None, "links": links_of(closed(shown)[0]), "text_length": len(text),
    }
    out = []
    for kind, content_type, block in (("metadata", "application/json", json.dumps(about, ensure_ascii=False).encode("utf-8", "replace")), ("conversion", "text/plain; charset=utf-8", text)):
        out.append((record["key"], kind, record_id(kind, record["record_id"]), record["record_id"], record["target_uri"], record["date"], content_type, len(block), record["payload_digest"], digest(block), source, block))
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(FIELDS), FIELDS, strict=True)], schema=FIELDS)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of a page table. A null url or page is empty; a null key stays null."""

    def run(batches):
        for b in slices(batches, "html"):
            yield _rows([response(k, text_of(u), text_of(h), date) for k, u, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)])

    return pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html")).mapInArrow(run, DDL)


def derivatives(records: DataFrame) -> DataFrame:
    """For every response record a metadata and a conversion record; other types are passed over.

    Rows that repeat give repeated rows; a null block is empty; an empty table gives no rows.
    """

    def run(batches):
        for b in slices(batches, "block"):
            yield _rows([x for r in b.to_pylist() for x in derive(r | {"block": r["block"] or b""})])

    return records.where("record_type = 'response'").select(*FIELDS.names).mapInArrow(run, DDL)


def serialise(record: dict, compress: bool = True) -> bytes:
    """A record as WARC/1.1, in a gzip member of its own."""
    lines = ["WARC/1.1"] + [f"{_NAMES[n]}: {record[n]}" for n in _NAMES if record.get(n)]
    if record.get("source_headers"):
        lines.append("X-Source-Headers: " + record["source_headers"])
    block = bytes(record["block"])
    raw = ("\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(raw, mtime=0) if compress else raw


def parse(data: bytes) -> Iterator[dict]:
    """Records of a WARC file's bytes, whether in gzip members or plain, unpacked one record at a time.

    A file that breaks off or turns unreadable gives the records that are whole before that.
    """
    file = io.BytesIO(data)
    file = gzip.GzipFile(fileobj=file) if data[:2] == b"\x1f\x8b" else file
    back = {v.lower(): k for k, v in _NAMES.items()}
    try:
        while line := file.readline():
            if not line.startswith(b"WARC/1."):
                continue
            named: dict[str, str] = {}
            while (line := file.readline()).strip():
                name, sep, value = line.decode("utf-8", "replace").strip().partition(":")
                if sep:
                    named[name.strip().lower()] = value.strip()
            if not line:
                return
            n = int(size) if (size := named.get("content-length", "0")).isdecimal() else 0
            block = file.read(n)
            if len(block) < n:
                return
            out = dict.fromkeys(FIELDS.names)
            out |= {back[k]: v for k, v in named.items() if k in back}
            yield out | {"content_length": n, "source_headers": named.get("x-source-headers"), "block": block}
    except (EOFError, OSError, zlib.error):
        return


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files. A file is read by one task, which holds it as it is stored and unpacks record by record,
    so files should be of the usual size of about 1 GB or less."""

    def run(batches):
        for b in batches:
            for data in b.column(0):
                for r in parse(data.as_py()):
                    yield _rows([tuple(r[n] for n in FIELDS.names)])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, DDL)


def digest_table(pages: DataFrame) -> DataFrame:
    """Every page's derived records, whole: page_id, type, ids, URI, date, length, digests, the block and its SHA-256."""
    out = derivatives(responses(pages))
    return out.select(F.col("key").alias("page_id"), "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "payload_digest", "block_digest", "source_headers", F.sha2("block", 256).alias("block_sha256"), "block")
