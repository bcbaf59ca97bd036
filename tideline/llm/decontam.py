"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark items.

Texts and items are lower-cased (A-Z) and cut into words. Every word that occurs in an item has a character of its
own, any other word is a blank, so a text becomes a string with a character for each word and the offset of a match
in it is the word's number in the original. The automaton holds all windows of ``window`` consecutive item words (an
item of fewer words is one window) and reads each such string once; all overlapping occurrences are found.

Items are few next to documents: they are sent to all workers, and each worker builds the automaton once. Their windows
are counted first. A benchmark of more than ``MOST_WINDOWS`` is taken in parts of that size, one after the other: each
part's hits are written out, and all are put together at the end, so the driver and the workers hold one part at a time.

Cases: null and empty texts have no words; items without words have no window; item ids that repeat count once, a
null item id counts as the empty string; occurrences that overlap or touch count each word once; repeated rows are rows of
their own; empty tables give no rows or no hits; very long texts are read whole; extra columns, of whatever name, pass
through ``drop_contaminated``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, discard, materialize, ship, small_batches

WINDOW = 13
#: Windows in an automaton: some 500 MB in each Python worker at the most.
MOST_WINDOWS = 1_000_000
#: Bytes of a word: digits, lower-case letters and all above ASCII; A-Z are lower-cased, the rest are blanks.
_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8."""
    return text.translate(_FOLD).split() if text else []


class _Letters(dict):
    """Word to character; words of no item are blank."""

    def __missing__(self, word):
        return "\0"


class Matcher:
    """The automaton over some items, with its alphabet of words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.letters, self.items = _Letters(), sorted({item for item, _ in items})
        number, found = {item: n for n, item in enumerate(self.items)}, {}
        for item, words in items:
            for w in words:
                if w not in self.letters:
                    code = len(self.letters) + 1
                    dict.__setitem__(self.letters, w, chr(code if code < 0xD800 else code + 0x800))
            line = "".join(self.letters[w] for w in words)
            for at in range(max(1, len(line) - window + 1)) if line else ():
                found.setdefault(line[at : at + window], set()).add(number[item])
        self.automaton = ahocorasick.Automaton()
        for line, of in found.items():
            self.automaton.add_word(line, (len(line), tuple(of)))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of words that lie in an occurrence of a window, and the numbers of the items met."""
        spans: list[tuple[int, int]] = []
        met: set[int] = set()
        if self.empty or not words:
            return spans, met
        for end, (length, of) in self.automaton.iter("".join(map(self.letters.__getitem__, words))):
            met.update(of)
            start = end - length + 1
            while spans and spans[-1][1] >= start:  # ends come in order; an occurrence may reach over earlier spans
                start = min(start, spans.pop()[0])
            spans.append((start, end + 1))
        return spans, met


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def item_parts(benchmark: DataFrame, window: int = WINDOW, most: int = MOST_WINDOWS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items (id as text, words) in parts of about ``most`` windows; the driver holds one part at a time."""
    part, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").toLocalIterator():
        words = words_of(row.text.encode() if row.text is not None else None)
        for at in range(0, max(1, len(words) - window + 1) if words else 0, most):  # a long item goes in overlapping parts
            piece = words[at : at + most + window - 1]
            part.append((row.item, piece))
            size += max(1, len(piece) - window + 1)
            if size >= most:
                yield part
                part, size = [], 0
    if part:
        yield part


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, items, window: int) -> Matcher:
    if key not in _matchers:
        _matchers.clear()  # one automaton at a time in a worker
        _matchers[key] = Matcher(items, window)
    return _matchers[key]


SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_words array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _verdicts(rows: list[tuple[int, list[tuple[int, int]], set[str]]], share: int) -> list[pa.Array]:
    """The columns of ``SCHEMA`` from numbers of words, spans and items."""
    out: list[list] = [[] for _ in range(6)]
    for n, spans, items in rows:
        spans = merged(spans)
        hit = sum(e - s for s, e in spans)
        for column, v in zip(out, (n, hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0 and share * hit >= n, [{"start": s, "end": e} for s, e in spans]), strict=True):
            column.append(v)
    return [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), _SPANS), strict=True)]


_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_words"]


def _hits_of_part(docs: DataFrame, items: list, window: int) -> DataFrame:
    """(key, spans, items) of the texts with a hit; a text of that digest has them wherever it occurs."""
    key, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, sent.value, window)
        for b in batches:
            rows = [(k, *m.scan(words_of(t))) for k, t in zip(b.column("key").to_pylist(), as_bytes(b.column("text")), strict=True)]
            rows = [r for r in rows if r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in rows], pa.string()), pa.array([[{"start": s, "end": e} for s, e in x] for _, x, _ in rows], _SPANS), pa.array([[m.items[n] for n in met] for _, _, met in rows], pa.list_(pa.string()))], names=["key", "spans", "items"])

    found = docs.select(F.md5("text").alias("key"), "text").where("text is not null").mapInArrow(run, "key string, spans array<struct<start:int,end:int>>, items array<string>")
    return materialize(found.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits")


def _scan_in_parts(docs: DataFrame, packed: DataFrame, doc_type, benchmark: DataFrame, window: int, most: int, share: int, inside: bool) -> DataFrame:
    parts = [_hits_of_part(docs, items, window) for items in item_parts(benchmark, window, most)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    hits = materialize(whole.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "all-hits")  # a row for each part at the most
    discard(*parts)
    text = F.col("doc.text") if inside else F.col("text")
    joined = packed.withColumn("key", F.md5(text)).join(hits, "key", "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("doc").field("text") if inside else b.column("text"))
            rows = [(len(words_of(t)), [(x["start"], x["end"]) for x in spans or ()], set(items or ())) for t, spans, items in zip(texts, b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *_verdicts(rows, share)], names=["doc", *_NAMES])

    return joined.mapInArrow(run, f"doc {doc_type.simpleString()}, {SCHEMA}")


def scan_documents(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, most: int = MOST_WINDOWS, share: int = 20, doc_only: bool = False) -> DataFrame:
    """Columns ``keep`` of the documents with n_words, n_hit, n_items, items_sha256, contaminated and the hit spans
    (in words, end exclusive). contaminated: a hit, and hit words are at least one in ``share``."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    inside = "text" in keep  # else the text travels beside the columns to keep
    packed = docs.select(F.struct(*keep).alias("doc"), *([] if inside else ["text"]))
    doc_type = packed.schema["doc"].dataType
    # an item has no more windows than blanks between its words, and one
    windows = benchmark.agg(F.coalesce(F.sum(F.greatest(F.octet_length("text") / 2 - window + 2, F.lit(1.0))), F.lit(0.0)).alias("n")).first().n
    if windows > most:
        exact = sum(max(1, len(words) - window + 1) for part in item_parts(benchmark, window, most) for _, words in part)
        windows = exact
    if windows > most:
        scanned = _scan_in_parts(docs, packed, doc_type, benchmark, window, most, share, inside)
        return scanned if doc_only else scanned.select("doc.*", *_NAMES)
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast([x for part in item_parts(benchmark, window, most) for x in part])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _matcher(key, sent.value, window)
        for batch in batches:
            rows = []
            for t in as_bytes(batch.column("doc").field("text") if inside else batch.column("text")):
                words = words_of(t)
                spans, met = m.scan(words)
                rows.append((len(words), spans, {m.items[n] for n in met}))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *_verdicts(rows, share)], names=["doc", *_NAMES])

    scanned = packed.mapInArrow(run, f"doc {doc_type.simpleString()}, {SCHEMA}")
    return scanned if doc_only else scanned.select("doc.*", *_NAMES)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    scanned = scan_documents(docs, benchmark, docs.columns, doc_only=True, **options)
    return scanned.where(~F.col("contaminated")).select("doc.*")
