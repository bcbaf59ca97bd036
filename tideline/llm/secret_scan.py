"""Secret scans with multipart credential linking.

Strong findings (base kinds) stand alone: assignments to a secret's name, access identifiers, long hex strings.
Weak candidates are parts of a credential that mean little alone: identifiers (user names, client and account ids),
secrets (random-looking strings) and endpoints (URLs with a host, host:port, IPv4 addresses). A weak candidate
is reported only when a complementary part lies in its scope: a secret and an identifier or endpoint, strong or weak, link
if neither holds the other, they lie in one paragraph, and their intervals, each widened by ``SCOPE`` code points, touch.
The join of intervals is a sweep over the parts sorted by start and by end. It never leaves a document, each part asks for
its nearest neighbour only, and a neighbour further on is never needed: it is no closer, and in the same paragraph or beyond.

Cases: null and empty texts have no finding; very long texts, runs and parts are scanned whole, in time linear in the text;
parts that share a start or an end nest, so they do not link with each other; parts at one distance all count; repeated
rows are rows of their own; an empty table gives no rows; extra columns, of whatever name, are ignored; ids keep their type.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import id_type, ship, small_batches

KINDS = ("assign", "access", "hex", "ident", "secret", "endpoint")
BASE_KINDS = KINDS[:3]
SCOPE = 120

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the greedy run, so the same as [0-9a-f]+ of 32 or more
_IDENT = re.compile(r"""\b(?:user(?:name)?|login|client_?id|account(?:_?id)?|tenant_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.IGNORECASE | re.ASCII)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")  # whole runs of any length, in one pass
_HOST = re.compile(r"://[^\s\"'<>/@:]+(?::\d{1,5})?", re.ASCII)  # a URL's scheme is found backwards from here
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
_ADDRESS = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{1,5})?(?![\d.])", re.ASCII)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the strong kinds, leftmost and non-overlapping within a kind."""
    out = []
    if ("=" in text or ":" in text) and _NAMES.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def looks_random(s: str) -> bool:
    """Digits and letters of both cases, and more than three bits for each character."""
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values()) > 3.0


def urls(text: str) -> list[tuple[int, int]]:
    """Spans of scheme://host and port: the scheme is the longest run before that starts with a letter."""
    out, edge = [], 0
    for m in _HOST.finditer(text):
        start = at = m.start()
        while at > edge and text[at - 1] in _SCHEME:
            at -= 1
            if "a" <= text[at] <= "z":
                start = at
        if start < m.start():
            out.append((start, m.end()))
            edge = m.end()
    return out


def weak_parts(text: str) -> list[tuple[int, int, str]]:
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "ident") for m in _IDENT.finditer(text)]
    out += [(a, b, "endpoint") for a, b in urls(text)] + [(m.start(), m.end(), "endpoint") for m in _ADDRESS.finditer(text)]
    if out or "AKIA" in text:  # a weak secret needs a partner
        out += [(m.start(), m.end(), "secret") for m in _SECRET.finditer(text) if looks_random(m[0])]
    return out


ROLES = {"assign": "secret", "hex": "secret", "secret": "secret", "access": "partner", "ident": "partner", "endpoint": "partner"}


def _reached(parts: list[tuple[int, int, str, int]], scope: int) -> set[tuple[int, int, str, int]]:
    """Parts (start, end, role, paragraph) that a part of the other role reaches from before: it starts and ends earlier."""
    ends: dict[str, list[tuple[int, int]]] = {"secret": [], "partner": []}  # (end, paragraph) of the parts that start earlier, sorted
    good, at = set(), 0
    parts = sorted(parts)
    for i, (start, end, role, paragraph) in enumerate(parts):
        while parts[at][0] < start:  # parts with one start do not see each other
            insort(ends[parts[at][2]], (parts[at][1], parts[at][3]))
            at += 1
        other = ends["partner" if role == "secret" else "secret"]
        k = bisect_left(other, (end, -1)) - 1  # of those that end earlier, the one that ends last
        if k >= 0 and other[k][1] == paragraph and start - other[k][0] <= 2 * scope:
            good.add(parts[i])
    return good


def linked(text: str, strong: list[tuple[int, int, str]], weak: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Weak parts with a complementary part, strong or weak, in scope."""
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    place = {x: (x[0], x[1], ROLES[x[2]], bisect_left(breaks, x[0])) for x in (*strong, *weak)}
    forwards = _reached(list(place.values()), scope)
    backwards = _reached([(-e, -s, r, p) for s, e, r, p in place.values()], scope)  # the same from behind
    return [w for w in weak if (x := place[w]) in forwards or (-x[1], -x[0], x[2], x[3]) in backwards]


def _outside(weak: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that are not inside a base span; base is sorted by start."""
    out, at, reach = [], 0, -1
    for s, e, k in sorted(weak):
        while at < len(base) and base[at][0] <= s:
            reach = max(reach, base[at][1])
            at += 1
        if e > reach:
            out.append((s, e, k))
    return out


def find_secrets(text: str | None, scope: int = SCOPE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, linked weak spans), each sorted by start, then kind."""
    if not text:
        return [], []

    def key(x):
        return x[0], KINDS.index(x[2]), x[1]

    base = sorted(base_spans(text), key=key)
    weak = _outside(weak_parts(text), base)
    return base, sorted(linked(text, base, weak, scope), key=key)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, findings array<struct<kind, start, end, base>>: code points, end exclusive, by start, then kind."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                base, weak = find_secrets(text, scope)
                found = [(s, KINDS.index(k), e, k, True) for s, e, k in base] + [(s, KINDS.index(k), e, k, False) for s, e, k in weak]
                out.append([{"kind": k, "start": s, "end": e, "base": is_base} for s, _, e, k, is_base in sorted(found)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind)], names=["doc_id", "findings"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, findings array<struct<kind:string,start:int,end:int,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the joined spans of ``scan_secrets``."""

    def spans(col):
        return F.array_join(F.transform(col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("findings", lambda x: x["base"] & (x["kind"] == kind))).cast("long")

    base = F.filter("findings", lambda x: x["base"])
    counts = [number(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("findings")).alias("spans"))
