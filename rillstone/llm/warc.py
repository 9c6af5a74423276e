"""Operator 3: WARC derivatives.

The input is WARC data: files with any number of records, plain or in gzip members. Each response record
gives a metadata record (JSON about the response: status line, headers, title, description, links,
digests) and a conversion record (the page's plain text). Both name the response by its own identifier in
WARC-Refers-To and each other in WARC-Concurrent-To; both keep the target, the date and the payload digest
that the response has, and have a digest and a length of their own block. Map-only.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .common import chunks

VERSION = "WARC/1.1"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "https://warc.invalid/derivatives")

#: Elements whose content is not text of the page, and those that start a new line of it.
HIDDEN = frozenset("script style noscript template svg textarea select".split())
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())

TAG = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
TAG_END = re.compile(r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in HIDDEN}


class Page:
    """What one pass over the markup finds: ``title``, ``description``, ``links`` and ``text``.

    The scan goes forward only: what is looked for in vain once (the end of a tag, a comment or a hidden
    element) is not looked for again, so markup that is never closed takes no longer than other.
    """

    def __init__(self, markup: str, base: str = ""):
        self.title = self.description = ""
        self.links: list[dict[str, str]] = []
        self.base, self.out, self.title_from = base, [], -1
        at, size, quotes = 0, len(markup), True
        while at < size:
            start = markup.find("<", at)
            if start < 0:
                break
            self._text(markup[at:start])
            if markup.startswith("<!--", start):
                end = markup.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if markup.startswith("<![CDATA[", start):
                end = markup.find("]]>", start)
                self._text(markup[start + 9 : size if end < 0 else end])
                at = size if end < 0 else end + 3
                continue
            tag = TAG.match(markup, start + 1)
            if not tag and markup[start + 1 : start + 2] not in ("!", "?"):
                self._text("<")
                at = start + 1
                continue
            if tag and quotes:
                end = TAG_END.match(markup, tag.end())
                quotes = end is not None
            end_at = end.end() if tag and quotes else markup.find(">", start) + 1
            if not end_at:  # there is no tag from here on
                at = start
                break
            at = end_at
            if tag:
                name, closes = tag[1].lower(), markup[start + 1] == "/"
                self._tag(name, closes, markup[tag.end() : at - 1])
                if name in HIDDEN and not closes:
                    close = CLOSING[name].search(markup, at)
                    at = markup.find(">", close.end()) + 1 if close else size
                    at = at or size
        self._text(markup[at:])
        lines = (" ".join(line.split()) for line in "".join(self.out).split("\n"))
        self.text = "\n".join(line for line in lines if line)

    def _text(self, raw: str) -> None:
        if raw:
            self.out.append((entities.unescape(raw) if "&" in raw else raw).replace("\n", " "))

    def _tag(self, name: str, closes: bool, rest: str) -> None:
        if name == "title":
            if not closes:
                self.title_from = len(self.out)
            else:
                if self.title_from >= 0 and not self.title:
                    self.title = " ".join("".join(self.out[self.title_from :]).split())
                    del self.out[self.title_from :]
                self.title_from = -1
        elif not closes and name in ("a", "link", "img", "meta", "base"):
            found = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(rest)}
            if name == "meta" and found.get("name", "").lower() == "description":
                self.description = found.get("content", "")
            elif name == "base" and found.get("href"):
                self.base = _join(self.base, found["href"])
            elif target := found.get("src" if name == "img" else "href"):
                self.links.append({"path": f"{name.upper()}@/{'src' if name == 'img' else 'href'}", "url": _join(self.base, target)})
        if name in BLOCKS:
            self.out.append("\n")


def _join(base: str, target: str) -> str:
    try:
        return urljoin(base, target)
    except ValueError:  # a malformed address stays as it is written
        return target


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, name: str) -> str:
    """Deterministic, so that a task that runs again names its records alike."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {name}')}>"


def serialize(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers.items() if v is not None), "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def records(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers, in order and with repeated names, and block of every record of a WARC file.

    Gzip members are unpacked one after the other. A record that is cut off or is none ends the file.
    """
    for part in _members(raw):
        at = 0
        while True:
            while part[at : at + 2] == b"\r\n":
                at += 2
            head_end = part.find(b"\r\n\r\n", at)
            if head_end < 0 or not part.startswith(b"WARC/", at):
                break
            headers = header_lines(part[at:head_end])[1]
            size = first(headers, "Content-Length")
            if size is None or not size.isdigit() or head_end + 4 + int(size) > len(part):
                break
            at = head_end + 4 + int(size)
            yield headers, part[head_end + 4 : at]


def _members(raw: bytes) -> Iterator[bytes]:
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw[:2] == b"\x1f\x8b":
        unpack = zlib.decompressobj(31)
        try:
            part = unpack.decompress(raw)
        except zlib.error:
            return
        yield part
        raw = unpack.unused_data


def header_lines(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """First line, and (name, value) of the others; a line that starts with a blank goes on with the one before."""
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return status, out


def first(headers: list[tuple[str, str]], name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def _markup(payload: bytes, headers: list[tuple[str, str]]) -> str:
    """The payload's text: transfer and content encodings undone as far as they can be."""
    if "chunked" in (first(headers, "Transfer-Encoding") or "").lower():
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            try:
                size = int(payload[at:end].partition(b";")[0], 16)
            except ValueError:
                out = [payload]  # it was stored without its chunks
                break
            if not size:
                break
            out.append(payload[end + 2 : end + 2 + size])
            at = end + 4 + size
        payload = b"".join(out)
    if (first(headers, "Content-Encoding") or "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            payload = zlib.decompress(payload, 47)
        except zlib.error:
            pass
    charset = re.search(r"charset=[\"']?([\w.:-]+)", first(headers, "Content-Type") or "")
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


RECORD_FIELDS = ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", "block_digest", "payload_digest", "source_headers", "block")


def derive(headers: list[tuple[str, str]], block: bytes) -> list[dict]:
    """The metadata and the conversion record of one response record."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, lines = header_lines(head)
    source, target, date = (first(headers, f"WARC-{n}") for n in ("Record-ID", "Target-URI", "Date"))
    page = Page(_markup(payload, lines), target or "")
    payload_digest = first(headers, "WARC-Payload-Digest") or digest(payload)
    about = {
        "refers-to": source,
        "warc-headers": headers,
        "status": status,
        "headers": lines,
        "block-digest": first(headers, "WARC-Block-Digest") or digest(block),
        "payload-digest": payload_digest,
        "payload-length": len(payload),
        "title": page.title,
        "description": page.description,
        "links": page.links,
    }
    blocks = {"metadata": ("application/json", json.dumps(about, ensure_ascii=False, separators=(",", ":"))), "conversion": ("text/plain; charset=utf-8", page.text)}
    ids = {k: record_id(k, f"{source} {payload_digest}") for k in blocks}
    other = {"metadata": "conversion", "conversion": "metadata"}
    return [
        dict(zip(RECORD_FIELDS, (k, ids[k], source, ids[other[k]], target, date, t, digest(b.encode()), payload_digest, head.decode("utf-8", "replace"), b), strict=True))
        for k, (t, b) in blocks.items()
    ]


def warc_headers(record: dict) -> dict[str, str]:
    return {
        "WARC-Type": record["record_type"],
        "WARC-Record-ID": record["record_id"],
        "WARC-Date": record["warc_date"],
        "WARC-Target-URI": record["target_uri"],
        "WARC-Refers-To": record["refers_to"],
        "WARC-Concurrent-To": record["concurrent_to"],
        "WARC-Block-Digest": record["block_digest"],
        "WARC-Payload-Digest": record["payload_digest"],
        "Content-Type": record["content_type"],
        "Content-Length": str(len(record["block"].encode())),
    }


def build_derivatives(df: DataFrame, key: str, content: str = "content", with_record: bool = False) -> DataFrame:
    """Two rows for each response record: ``key``, the record's fields, ``content_length`` and, if asked for, ``record`` (bytes).

    ``content`` is a column of WARC data, as ``spark.read.format("binaryFile")`` reads files of up to 2 GB
    (``key="path"``); a task holds one row's data at a time. Records of other types are passed over, as is
    what follows a damaged record. Null and empty contents have no records; null keys pass through;
    repeated rows give their records again, with equal identifiers; other columns are left out.
    """
    schema = StructType(df.select(key).schema.fields)
    for name in RECORD_FIELDS:
        schema = schema.add(name, StringType())
    schema = schema.add("content_length", "long")
    if with_record:
        schema = schema.add("record", "binary")
    kinds = {"content_length": pa.int64(), "record": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__content"):
            keys: list = []
            columns: dict[str, list] = {n: [] for n in schema.names[1:]}
            kind, held = batch.column(0).type, 0

            def rows(keys=keys, columns=columns, kind=kind) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(keys, kind), *(pa.array(v, kinds.get(n, pa.string())) for n, v in columns.items())], schema.names)

            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                for headers, block in records(batch.column(1)[i].as_py() or b""):
                    if (first(headers, "WARC-Type") or "").lower() != "response":
                        continue
                    for record in derive(headers, block):
                        keys.append(name)
                        record["content_length"] = len(record["block"].encode())
                        if with_record:
                            record["record"] = serialize(warc_headers(record), record["block"].encode())
                        for n, values in columns.items():
                            values.append(record[n])
                    held += len(block)
                    if held > 4_000_000:
                        yield rows()
                        held = 0
                        for values in (keys, *columns.values()):
                            values.clear()
            if keys:
                yield rows()

    return df.select(key, F.col(content).alias("__content")).mapInArrow(run, schema)


def response_record(key: Column, uri: Column, markup: Column, date: str = "2024-01-01T00:00:00Z") -> Column:
    """A page as the bytes of one response record, for tables that hold markup only. Null markup is an empty page."""
    page = F.coalesce(markup, F.lit(""))
    name = F.md5(F.concat_ws("\n", key.cast("string"), uri, page))
    parts = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(page).cast("string"), F.lit("\r\n\r\n"), page)
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit(f"{VERSION}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), parts, F.lit(f">\r\nWARC-Date: {date}\r\n"), target)
    return F.concat(head, F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(http).cast("string"), F.lit("\r\n\r\n"), http, F.lit("\r\n\r\n")).cast("binary")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivatives of every page, each as a response record."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return build_derivatives(pages.select("page_id", response_record(F.col("page_id"), F.col("url"), F.col("html")).alias("content")), "page_id")
