"""Operator 6: secret scans with multipart credential linking.

Three strong kinds are reported wherever they stand. Three weak kinds are candidates: an account
name, an opaque string or an endpoint means little alone. They are reported when a complementary
part stands in the same scope: a name or an endpoint needs a secret, an opaque string needs a name or
an access identifier. A part's scope is the interval of ``reach`` characters to either side, cut at
the nearest blank lines, and a part stands in it if the two overlap or touch, however long the part
is. Parts and scopes are joined as intervals on sorted starts and the greatest ends up to each, so a
text with very many parts makes no pairs.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, documents, texts_of

#: In the order in which spans at one place are listed.
STRONG = ("assign", "access", "hex")
WEAK = ("name", "opaque", "endpoint")
KINDS = STRONG + WEAK
REACH = 400

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is every run of 24 and more
NAME = re.compile(r"""\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.IGNORECASE | re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp)://[^\s"'<>]+|(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}(?!\w)""", re.ASCII)
BLANK = re.compile(r"\n[ \t\r]*\n")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def strong_spans(text: str) -> list[Span]:
    found = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [Span("hex", *m.span()) for m in HEX.finditer(text)]


def weak_candidates(text: str, strong: list[Span]) -> list[Span]:
    """Weak spans that no strong span touches."""
    found = [Span("name", *m.span()) for m in NAME.finditer(text)]
    found += [Span("opaque", *m.span()) for m in OPAQUE.finditer(text)]
    if "://" in text or ":" in text:
        found += [Span("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    if not found or not strong:
        return found
    taken: list[list[int]] = []
    for _, a, b in sorted(strong, key=lambda s: s.start):
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [t[0] for t in taken]
    free = []
    for s in found:
        i = bisect_left(starts, s.end) - 1
        if i < 0 or taken[i][1] <= s.start:
            free.append(s)
    return free


def linked(text: str, strong: list[Span], weak: list[Span], reach: int = REACH) -> list[Span]:
    """The weak spans with a complementary part in scope."""
    if not weak:
        return []
    starts: dict[str, list[int]] = {}
    ends: dict[str, list[int]] = {}  # the greatest end of the parts up to each start
    for s in sorted([*strong, *weak], key=lambda s: s.start):
        starts.setdefault(s.kind, []).append(s.start)
        tops = ends.setdefault(s.kind, [])
        tops.append(max(tops[-1], s.end) if tops else s.end)
    needs = {"name": ("assign", "hex", "opaque"), "endpoint": ("assign", "hex", "opaque"), "opaque": ("access", "name")}
    lines = [m.span() for m in BLANK.finditer(text)]
    blanks = [a for a, _ in lines]
    out = []
    for s in weak:
        i = bisect_left(blanks, s.start)
        lo = max(s.start - reach, lines[i - 1][1] if i else 0)
        j = bisect_left(blanks, s.end)
        hi = min(s.end + reach, blanks[j] if j < len(blanks) else len(text))
        for kind in needs[s.kind]:
            n = bisect_right(starts.get(kind, []), hi)
            if n and ends[kind][n - 1] >= lo:
                out.append(s)
                break
    return out


def find_spans(text: str, reach: int = REACH) -> list[Span]:
    """All reported spans, by start and then kind."""
    strong = strong_spans(text)
    found = strong + linked(text, strong, weak_candidates(text, strong), reach)
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s.start, -s.end)):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """``key`` and ``spans`` (kind, start, end in code points) of every row; map-only.

    Null and empty texts have no spans; repeated rows are scanned each; null keys pass through; other
    columns are left out.
    """
    schema = df.select(key).schema.add("spans", SPAN_TYPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            spans = [[s._asdict() for s in find_spans(t, reach)] for t in texts_of(batch, "__text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPAN_ARROW)], schema.names)

    return df.select(key, F.col(text).alias("__text")).mapInArrow(run, schema)


def redact_secrets(df: DataFrame, text: str = "text", n_chars: str = "n_chars", reach: int = REACH) -> DataFrame:
    """``df`` with secrets replaced by their kind; all rows and columns stay, and texts without secrets as they are.

    ``n_chars`` is brought up to date where a text changes. Null and empty texts stay as they are;
    repeated rows are redacted each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text):
            texts = batch.column(text).to_pylist()
            sizes = batch.column(n_chars).to_pylist()
            for i, t in enumerate(texts):
                if t and (spans := find_spans(t, reach)):
                    texts[i] = redact(t, spans)
                    sizes[i] = len(texts[i])
            new = {text: pa.array(texts, batch.column(text).type), n_chars: pa.array(sizes, batch.column(n_chars).type)}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return df.mapInArrow(run, df.schema)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 6: counts and digest of the base spans, and all spans."""
    found = scan_secrets(documents(spark, sf_dir))
    counts = [_count(k).alias(f"n_{k}") for k in STRONG]
    base = F.filter("spans", lambda s: s["kind"].isin(*STRONG))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
