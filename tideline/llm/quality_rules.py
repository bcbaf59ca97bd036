"""Quality rules with cross-document line frequency.

Each text gets its base numbers (words, symbols, repeated lines, words in repeated three-word windows). Its lines
are normalised (A-Z lower-cased, digits to 0, white space to one blank) and hashed, and for each host (the source)
the distinct documents that hold a line are counted. Lines above the limit are removed. A document is depleted, and
rejected, if most of its words were in such lines or if fewer words are left than any document must have.

Copies are no distinct documents: documents are told apart by a sketch, the five-word window (A-Z lower-cased) of least hash, which exact
copies share always and near copies nearly always. So a group of copies, exact or near, counts about once, and neither
raises a line's count nor hides it: documents that have only a passage in common share a sketch no more often than
that passage is of their text. The size of a host, of which ``HOST_SHARE`` is taken, is its number of sketches too.

Texts are read twice where they lie and never shuffled: once for lines and sketches, which are counted through partial
sums, once for the verdict, with the lines above the limit sent to all workers. That list has a counted bound; beyond it,
documents meet their lines in a salted join.

Cases: null text has no words and fails; empty lines and lines without words are never counted or removed; null
hosts are one host; repeated rows count as copies and each gets its verdict; a line that holds exactly the limit stays;
an empty table gives no rows; very long texts and lines are read whole; extra columns pass through ``clean_documents``,
whatever their names; ids keep their type.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ASCII_LOWER, as_bytes, discard, id_type, materialize, ship, small_batches

MIN_WORDS = 50
#: A line is above its limit in a host when more distinct documents hold it than both of these.
MIN_DOCUMENTS = 20
HOST_SHARE = 0.02
#: A document is depleted when more than this share of its words was in removed lines.
DEPLETED = 0.8
#: Longer lists of lines are joined, each line's rows dealt over ``SALT`` tasks.
BROADCAST_LINES, SALT = 100_000, 16
#: The sketch: words in a window, factors of their hashes, and the prime that orders windows.
SKETCH, FACTORS, PRIME = 5, np.array([1640531527, 1181783497, 2024237689, 1399733957, 1879048201]), 2147483647
REMEMBER = 100_000

_SYMBOLS = b"#*$%&|<>"
_NOT_COUNTED = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])  # white space, and UTF-8 bytes after a character's first
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_SIGN = 1 << 63


class _WordHashes(dict):
    """28 bits of a word's MD5, for a bounded number of words."""

    def __missing__(self, word):
        if len(self) > REMEMBER:
            self.clear()
        self[word] = h = int(hashlib.md5(word).hexdigest()[:7], 16)
        return h


_word_hashes = _WordHashes()


def sketch(words: list[bytes]) -> int:
    """Signed 64-bit hash of the window of least hash; of all words, if they are fewer than a window."""
    at = 0
    if len(words) > SKETCH:
        h = np.fromiter(map(_word_hashes.__getitem__, words), np.int64, len(words))
        n = len(h) - SKETCH + 1
        at = int((sum(h[j : n + j] * FACTORS[j] for j in range(SKETCH)) % PRIME).argmin())
    return xxhash.xxh64_intdigest(b" ".join(words[at : at + SKETCH])) - _SIGN


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, n = Counter(windows), -1, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 2 - max(covered, i - 1)
            covered = i + 2
    return n


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash of a line whose letters and digits are normalised already."""
    return xxhash.xxh64_intdigest(b" ".join(line.split())) - _SIGN


def text_key() -> Column:
    """Digest of the whole text, null apart from empty."""
    return F.md5("text")


def _host(docs: DataFrame) -> Column:
    return F.col("source").cast("string").alias("host")


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch and distinct line hashes of each text."""
    for b in batches:
        sketches, offsets, hashes = [], [0], []
        for text in as_bytes(b.column("text")):
            normal = (text or b"").translate(_NORMAL)
            sketches.append(sketch((text or b"").translate(ASCII_LOWER).split()))
            hashes.extend({line_hash(line) for line in normal.split(b"\n") if line.strip()})
            offsets.append(len(hashes))
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(sketches, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes, pa.int64()))], names=["host", "sketch", "lines"])
    _word_hashes.clear()  # the worker goes on to other stages


def lines_above(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, host_share: float = HOST_SHARE) -> DataFrame:
    """(host, h): lines that more distinct documents of the host hold than the limit; written to the shared folder."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    held = materialize(docs.select(_host(docs), "text").mapInArrow(_lines, "host string, sketch long, lines array<long>"), "lines")
    lines = held.select("host", "sketch", F.explode("lines").alias("h")).distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > min_documents)
    hosts = held.select(F.col("host").alias("of"), "sketch").distinct().groupBy("of").agg(F.count(F.lit(1)).alias("documents"))
    above = materialize(lines.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("holders") > F.col("documents") * host_share).select("host", "h"), "above")
    discard(held)
    return above


def measure(text: bytes | None, gone) -> tuple[int, int, int, int, int, int, bytes | None]:
    """Base numbers of a text, its words in lines of ``gone``, and the text without these lines (None if it stays)."""
    text = text or b""
    words = text.split()
    raw = [line for line in text.split(b"\n") if line.strip()]
    removed, left = 0, None
    if gone:
        keep = []
        for line in text.split(b"\n"):
            if line.strip() and line_hash(line.translate(_NORMAL)) in gone:
                removed += len(line.split())
            else:
                keep.append(line)
        left = b"\n".join(keep) if removed else None
    return len(words), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, _SYMBOLS)), len(raw) - len(set(raw)), repeated_words(words), removed, left


_NUMBERS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words")


def _verdicts(numbers: dict[str, np.ndarray], depleted: float) -> tuple[np.ndarray, np.ndarray]:
    n, removed = numbers["n_words"], numbers["removed_words"]
    failed = (n < MIN_WORDS) | (100 * numbers["n_repeat_words"] > 50 * n)
    return failed, ~failed & (removed <= depleted * n) & (n - removed >= MIN_WORDS)


def _judge(names: list[str] | None, depleted: float, gone_of_host: dict | None):
    """Rows with numbers and verdict or, with the documents' column names, the documents that are kept, without their removed lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = None if gone_of_host is None else gone_of_host.value
        for b in batches:
            doc = b.column("doc") if names else None
            column = doc.field(names.index("text")) if names else b.column("text")
            gone = [lists.get(h) for h in b.column("host").to_pylist()] if lists is not None else [x and frozenset(x) for x in b.column("removed").to_pylist()]
            rows = [measure(t, g) for t, g in zip(as_bytes(column), gone, strict=True)]
            numbers = {c: np.array([r[i] for r in rows], np.int64) for i, c in enumerate(_NUMBERS)}
            failed, kept = _verdicts(numbers, depleted)
            if not names:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, numbers.values()), pa.array(failed), pa.array(kept)], names=["doc_id", *_NUMBERS, "base_failed", "kept"])
                continue
            fields = [doc.field(i) for i in range(len(names))]
            changed = [i for i, r in enumerate(rows) if kept[i] and r[6] is not None]
            if changed:
                texts = fields[names.index("text")].to_pylist()
                for i in changed:
                    texts[i] = rows[i][6].decode()
                fields[names.index("text")] = pa.array(texts, fields[names.index("text")].type)
                if "n_chars" in names:
                    sizes = fields[names.index("n_chars")].to_pylist()
                    for i in changed:
                        sizes[i] = len(texts[i])
                    fields[names.index("n_chars")] = pa.array(sizes, fields[names.index("n_chars")].type)
            whole = pa.StructArray.from_arrays(fields, fields=list(doc.type))
            yield pa.RecordBatch.from_arrays([whole.filter(pa.array(kept))], names=["doc"])

    return run


def _judged(docs: DataFrame, columns: list, names: list[str] | None, schema: str, limits: dict) -> DataFrame:
    depleted = limits.pop("depleted", DEPLETED)
    above = lines_above(docs, **limits)
    wide = docs.select(*columns, _host(docs), text_key().alias("key"))
    if above.count() <= BROADCAST_LINES:
        lists: dict[str | None, set[int]] = {}
        for r in above.collect():
            lists.setdefault(r.host, set()).add(r.h)
        discard(above)
        return wide.drop("key").mapInArrow(_judge(names, depleted, docs.sparkSession.sparkContext.broadcast(lists)), schema)
    # a text of a host has one verdict, however many copies there are; a line's rows are dealt over many tasks
    salted = above.select("host", "h", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")).alias("a")
    texts = docs.select(_host(docs), "text", text_key().alias("key")).mapInArrow(_lines_of_texts, "host string, key string, lines array<long>")
    held = texts.select("host", "key", F.explode("lines").alias("h")).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALT)).cast("int")).alias("t")
    met = held.join(salted, F.col("t.host").eqNullSafe(F.col("a.host")) & (F.col("t.h") == F.col("a.h")) & (F.col("t.salt") == F.col("a.salt")), "left_semi")
    removed = materialize(met.groupBy("host", "key").agg(F.collect_set("h").alias("removed")), "removed").alias("r")  # as many as one text has lines
    joined = wide.alias("w").join(removed, F.col("w.host").eqNullSafe(F.col("r.host")) & (F.col("w.key") == F.col("r.key")), "left").select("w.*", "r.removed").drop("key", "host")
    return joined.mapInArrow(_judge(names, depleted, None), schema)


def _lines_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = [list({line_hash(x) for x in (t or b"").translate(_NORMAL).split(b"\n") if x.strip()}) for t in as_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("key"), pa.array(lines, pa.list_(pa.int64()))], names=["host", "key", "lines"])


def judge(docs: DataFrame, **limits) -> DataFrame:
    """A row for each document: doc_id, base numbers, removed_words, base_failed, kept."""
    schema = f"doc_id {id_type(docs)}, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", base_failed boolean, kept boolean"
    return _judged(docs, ["doc_id", "text"], None, schema, limits)


def clean_documents(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without the lines above their limit; the columns of ``docs``.

    n_chars, if it is there and a line went, is set to the new length.
    """
    packed = F.struct("*").alias("doc")
    kind = docs.select(packed).schema["doc"].dataType.simpleString()
    return _judged(docs, [packed], docs.columns, f"doc {kind}", limits).select("doc.*")
