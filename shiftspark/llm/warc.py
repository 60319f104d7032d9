"""Derivatives of WARC response records: a metadata record and a plain-text conversion record for each.

Both name the response they come from (WARC-Refers-To, with its target and date) and the metadata holds all headers of the response's
WARC record and of its HTTP head, in their order and repeated ones too, and its digests. The body is undone by its transfer and
content encodings and read in its charset. Tasks work through the responses one by one; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Date of capture where the source has none.
CAPTURED = "2024-01-01T00:00:00Z"
SOURCE = "record_id string, target_uri string, date string, block_digest string, payload_digest string, block binary, headers array<struct<name: string, value: string>>"
DERIVED = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, source_block_digest string, source_payload_digest string, digests_match boolean, http_status int, converted boolean, n_links long, content string, record binary"

#: Kinds of body that are pages; other kinds of text are taken as they are, and all else has no text.
PAGES = ("text/html", "application/xhtml+xml")
CHARSET = re.compile(r"""charset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
#: Bytes at a page's start that may declare its charset.
DECLARED = 1024

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/<>]*)([^<>]*)>|<[!?][^<>]*>", re.S | re.I)
TARGET = re.compile(r"""(?:^|\s)(?:href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LINKS = {"a": "a/href", "area": "area/href", "img": "img/src", "iframe": "iframe/src", "link": "link/href"}
#: Elements that begin a line of their own.
BLOCKS = set("address article aside blockquote body br center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split())


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode('utf-8', 'surrogatepass')).digest()[:16])}>"


def page(text: str, base: str | None) -> tuple[str, str, list[dict[str, str]]]:
    """Title, plain text and links of an HTML page."""
    out: list[str] = []
    links, title, at = [], None, 0
    opened = None
    for tag in TAG.finditer(text):
        out.append(text[at : tag.start()])
        at = tag.end()
        name = (tag[3] or "").lower()
        if name == "title":
            if not tag[2] and title is None:
                opened = len(out)
            elif opened is not None:
                title, opened = html.unescape("".join(out[opened:])), None
        if name in LINKS and not tag[2] and (target := TARGET.search(tag[4])):
            url = html.unescape(next(g for g in target.groups() if g is not None)).strip()
            try:
                url = urljoin(base or "", url)
            except ValueError:
                pass
            links.append({"path": LINKS[name], "url": url})
        if name in BLOCKS:
            out.append("\n")
    out.append(text[at:])
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return " ".join((title or "").split()), "\n".join(line for line in lines if line), links


def serialized(headers: dict[str, str | None], content: bytes) -> bytes:
    """One record as in a WARC file; headers that are None are left out."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.0\r\n{lines}Content-Length: {len(content)}\r\n\r\n".encode() + content + b"\r\n\r\n"


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and content of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def http(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers in their order and payload of an HTTP response; without a head all is payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    first = lines[0].split(" ", 2)
    if not gap or not first[0].startswith("HTTP/") or len(first) < 2 or not first[1].isdigit():
        return None, [], block
    return int(first[1]), [(k.strip(), v.strip()) for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)], payload


def unchunked(data: bytes) -> bytes:
    """A chunked body put together; what is no chunk ends it."""
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return data if not out else b"".join(out)
        if size <= 0:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(out)


def body(headers: list[tuple[str, str]], payload: bytes) -> bytes | None:
    """The payload without its encodings; None where one is not known or does not fit."""
    named = lambda name: [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",") if x.strip()]
    if "chunked" in named("transfer-encoding"):
        payload = unchunked(payload)
    for encoding in reversed(named("content-encoding")):
        if encoding in ("identity", "utf-8"):
            continue
        if encoding not in ("gzip", "x-gzip", "deflate"):
            return None
        for bits in (47, -15):
            try:
                payload = zlib.decompressobj(bits).decompress(payload)
                break
            except zlib.error:
                continue
        else:
            return None
    return payload


def text_of(headers: list[tuple[str, str]], payload: bytes) -> tuple[str, str] | None:
    """Kind and decoded text of a body: 'page' or 'text'; None where it is no text.

    The charset is that of the Content-Type, else the one that a page declares at its start, else UTF-8; a charset that is not known
    counts as UTF-8. Bytes that don't fit become replacement characters."""
    declared = next((v for k, v in headers if k.lower() == "content-type"), "text/html")
    mime = declared.split(";")[0].strip().lower() or "text/html"
    data = body(headers, payload)
    if data is None or not (mime in PAGES or mime.startswith("text/")):
        return None
    found = CHARSET.search(declared) or (CHARSET.search(data[:DECLARED].decode("latin-1")) if mime in PAGES else None)
    try:
        text = data.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):
        text = data.decode("utf-8", "replace")
    return "page" if mime in PAGES else "text", text


def responses(pages: DataFrame) -> DataFrame:
    """WARC response records of pages (url, html): SOURCE columns. A null html is an empty payload. Where there is a page_id, it is a part
    of what a record's id is made from, so that equal pages of different ids are different records."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.encode(head, "UTF-8"), payload)
    own = [F.coalesce(F.col("page_id").cast("string"), F.lit(""))] if "page_id" in pages.columns else []
    name = F.sha2(F.concat_ws("\0", *own, F.col("url").isNull().cast("string"), F.coalesce(F.col("url").cast("string"), F.lit("")), F.sha2(payload, 256)), 256)
    ident = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))
    cols = [ident.alias("record_id"), F.col("url").cast("string").alias("target_uri"), F.lit(CAPTURED).alias("date")]
    sha = lambda x: F.concat(F.lit("sha256:"), F.sha2(x, 256))
    warc = [("WARC-Type", F.lit("response")), ("WARC-Record-ID", ident), ("WARC-Date", F.lit(CAPTURED)), ("WARC-Target-URI", F.col("url").cast("string")),
            ("WARC-Block-Digest", sha(block)), ("WARC-Payload-Digest", sha(payload)), ("Content-Type", F.lit("application/http; msgtype=response"))]
    headers = F.filter(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in warc)), lambda x: x["value"].isNotNull())
    return pages.select(*cols, sha(block).alias("block_digest"), sha(payload).alias("payload_digest"), block.alias("block"), headers.alias("headers"))


def derivatives(source: DataFrame) -> DataFrame:
    """Two rows for each response record of source (SOURCE columns, headers may be absent; others aside): its metadata and its conversion
    record (DERIVED). A body that is no text, or whose encoding is not known, has an empty conversion record, and converted is false.

    content is the record's text, JSON for metadata; record is the whole record as it stands in a WARC file. Null or empty blocks give an
    empty text. A null target or date leaves its header out. digests_match tells whether the source's digests fit its block; null
    digests are not compared. Ids follow from the source's id and the kind, so equal source rows give equal records, and a source
    without an id gets one from its block. An empty table gives an empty result.
    """
    names = [c.split()[0] for c in DERIVED.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in DERIVED.split(", ")]

    def of(row: dict) -> Iterator[tuple]:
        block, uri, date = row["block"] or b"", row["target_uri"], row["date"]
        refers = row["record_id"] or identifier(digest(block))
        status, headers, payload = http(block)
        found = text_of(headers, payload)
        title, text, links = page(found[1], uri) if found and found[0] == "page" else ("", found[1] if found else "", [])
        match = all(want is None or not want.startswith("sha256:") or want == digest(data) for want, data in ((row["block_digest"], block), (row["payload_digest"], payload)))
        warc = [[h["name"], h["value"]] for h in row["headers"] or [] if h]
        meta = {"refers-to": refers, "status": status, "headers": headers, "warc-headers": warc, "converted": found is not None, "block-digest": row["block_digest"], "payload-digest": row["payload_digest"], "title": title, "links": links}
        for kind, mime, content in (("metadata", "application/json", json.dumps(meta, ensure_ascii=False, sort_keys=True)), ("conversion", "text/plain", text)):
            data = content.encode("utf-8", "replace")
            ident = identifier(refers, kind)
            target = uri and " ".join(uri.split())
            head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Refers-To": refers, "WARC-Refers-To-Target-URI": target, "WARC-Refers-To-Date": date, "WARC-Target-URI": target, "WARC-Date": date, "Content-Type": mime, "WARC-Block-Digest": digest(data)}
            yield (kind, ident, refers, uri, date, mime, digest(data), row["block_digest"], row["payload_digest"], match, status, found is not None, len(links), data.decode(), serialized(head, data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = [r for row in batch.slice(at, 500).to_pylist() for r in of(row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    if "headers" not in source.columns:
        source = source.withColumn("headers", F.lit(None))
    kind = T.StructType.fromDDL(SOURCE)
    return source.select(*(F.col(f.name).cast(f.dataType) for f in kind)).mapInArrow(run, DERIVED)
