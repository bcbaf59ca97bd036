"""A quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]); the identity makes all
pairwise interactions cost one pass over a text's features.

Features: distinct lower-cased words hashed to ``WORD_BINS``, each of value 1/sqrt(their number); statistics of the
text's structure (lengths, shares of capitals, digits, symbols and punctuation, repetition, lines) and numbers that come
with the document (``METADATA``: its recorded length), each cut into bins with one feature for a bin. Labels, language,
source and id are never read for a score.

Training takes a bounded sample of labelled rows: at most ``TRAIN_ROWS`` rows, chosen by the hash of their id, and of these
as many as have ``TRAIN_FEATURES`` features together. Features are made on executors; the driver fits by mini-batches
with AdaGrad. Scoring is one pass over all texts.

Cases: null text counts as empty and is scored; null, negative or missing metadata have a bin of their own; no labels give
0.5 for all, which predicts 1; repeated labels of one document all count; rows with a null label or id are not learned; an
empty table gives no rows; very long texts are read whole; extra columns, of whatever name, are ignored; ids keep their type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ASCII_LOWER, as_bytes, discard, doc_crc, id_type, materialize, ship, small_batches

WORD_BINS = 1 << 15
STAT_BINS = 24
TRAIN_ROWS, TRAIN_FEATURES = 12_000, 12_000_000
#: Columns beside the text that a score may use.
METADATA = ("n_chars",)
RANK, EPOCHS, BATCH, RATE, DECAY = 8, 6, 64, 0.08, 1e-5
REMEMBER = 300_000

_UPPER, _DIGITS, _SYMBOLS, _MARKS, _ENDS = (bytes(x) for x in (range(65, 91), range(48, 58), b"#*$%&|<>{}[]=_~^@", b"!?", b".,;:"))


class _Bins(dict):
    def __missing__(self, word):
        if len(self) > REMEMBER:
            self.clear()
        self[word] = b = xxhash.xxh32_intdigest(word) % WORD_BINS
        return b


_bins = _Bins()


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Numbers between 0 and 1 that describe the structure of a text."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda chars: (len(text) - len(text.translate(None, chars))) / n
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        min(1.0, math.log1p(len(words)) / 12), min(1.0, len(text) / m / 24), share(_UPPER), share(_DIGITS), min(1.0, 4 * share(_SYMBOLS)), min(1.0, 8 * share(_MARKS)), min(1.0, 8 * share(_ENDS)),
        distinct / m, pairs / max(1, len(words) - 1) if len(words) > 1 else 1.0, min(1.0, math.log1p(len(words) / max(1, len(lines))) / 8), len(set(lines)) / max(1, len(lines)), min(1.0, math.log1p(len(lines)) / 8),
    ]


N_STATS = 12 + len(METADATA)
SIZE = WORD_BINS + N_STATS * STAT_BINS


def _known(value: float | None) -> float:
    """A metadata number on the scale of the statistics, by its logarithm; 0, which no such number has, where there is none."""
    return min(1.0, (1.5 + math.log1p(value)) / STAT_BINS) if value is not None and value >= 0 else 0.0


def features(text: bytes | None, metadata: tuple = (None,) * len(METADATA)) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text and its metadata."""
    text = text or b""
    words = text.translate(ASCII_LOWER).split()
    distinct = set(words)
    bins = np.fromiter(map(_bins.__getitem__, distinct), np.int32, len(distinct))
    stats = [WORD_BINS + f * STAT_BINS + min(STAT_BINS - 1, int(v * STAT_BINS)) for f, v in enumerate([*statistics(text, words, len(distinct)), *map(_known, metadata)])]
    return np.concatenate([bins, np.array(stats, np.int32)]), np.concatenate([np.full(len(bins), 1 / math.sqrt(max(1, len(bins))), np.float32), np.full(N_STATS, 0.5, np.float32)])


class Machine:
    """Weights of the factorisation machine."""

    def __init__(self, size: int = SIZE, rank: int = RANK, seed: int = 5):
        self.w0, self.w = 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, rank)).astype(np.float32)

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        vx = self.v[index] * value[:, None]
        total = vx.sum(0)
        return float(self.w0 + self.w[index] @ value + 0.5 * (total @ total - (vx * vx).sum()))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, seed: int = 5) -> Machine:
        """AdaGrad over mini-batches; the order is drawn from the seed, so reruns agree."""
        rng, y_all = np.random.default_rng(seed), np.array([y for *_, y in rows], np.float32)
        mean = min(max(float(y_all.mean()), 1e-3), 1 - 1e-3)
        self.w0 = math.log(mean / (1 - mean))
        g0, gw, gv = 1.0, np.ones_like(self.w), np.ones_like(self.v)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                chosen = order[at : at + BATCH]
                sizes = np.array([len(rows[i][0]) for i in chosen])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                index = np.concatenate([rows[i][0] for i in chosen])
                x = np.concatenate([rows[i][1] for i in chosen])
                vx = self.v[index] * x[:, None]
                total = np.add.reduceat(vx, starts)
                raw = self.w0 + np.add.reduceat(self.w[index] * x, starts) + 0.5 * ((total * total).sum(1) - np.add.reduceat((vx * vx).sum(1), starts))
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y_all[chosen]) / len(chosen)
                e = np.repeat(error, sizes)
                used, inverse = np.unique(index, return_inverse=True)
                dw = np.bincount(inverse, e * x, len(used)).astype(np.float32) + DECAY * self.w[used]
                each = (e * x)[:, None] * (np.repeat(total, sizes, 0) - vx)
                dv = np.stack([np.bincount(inverse, each[:, f], len(used)) for f in range(each.shape[1])], 1).astype(np.float32) + DECAY * self.v[used]
                d0 = float(error.sum())
                g0 += d0 * d0 * len(chosen)
                gw[used] += dw * dw * len(chosen)
                gv[used] += dv * dv * len(chosen)
                self.w0 -= RATE * len(chosen) * d0 / math.sqrt(g0) / 8
                self.w[used] -= RATE * len(chosen) * dw / np.sqrt(gw[used]) / 2
                self.v[used] -= RATE * len(chosen) * dv / np.sqrt(gv[used]) / 8
        return self


def _inputs(docs: DataFrame) -> list:
    """The text and the metadata that the documents have."""
    return [F.col("text"), *[(F.col(c) if c in docs.columns else F.lit(None)).cast("double").alias(f"metadata_{c}") for c in METADATA]]


def _made(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    known = zip(*(b.column(f"metadata_{c}").to_pylist() for c in METADATA), strict=True)
    return [features(t, m) for t, m in zip(as_bytes(b.column("text")), known, strict=True)]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Features and labels of the sample, at most ``rows``; the sample depends on ids alone."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    usable = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (doc_crc(F.col("doc_id")) % 3 != 1)).select("doc_id", F.col(label).cast("int").alias("y"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    total = usable.count()
    chosen = usable.where(place < F.lit(int((1 << 30) * min(1.0, rows / max(1, total)))))
    texts = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(chosen.orderBy(place, "doc_id", "y").limit(rows)), "doc_id").select(place.alias("place"), "y", "text", *[f"metadata_{c}" for c in METADATA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _made(b)
            yield pa.RecordBatch.from_arrays([b.column("place"), b.column("y"), pa.array([len(i) for i, _ in found], pa.int64()), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary())], names=["place", "y", "n", "i", "x"])

    table = written = materialize(texts.mapInArrow(run, "place long, y int, n long, i binary, x binary"), "features")
    count = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("place").alias("most")).first()
    if count.n > TRAIN_FEATURES:  # very long texts: fewer of them
        table = table.where(F.col("place") < F.lit(int(count.most * TRAIN_FEATURES / count.n)))
    made = table.toArrow()
    discard(written)
    out = [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), y, d) for d, y, i, x in zip(*(made[c].to_pylist() for c in ("place", "y", "i", "x")), strict=True)]
    return [r[:3] for r in sorted(out, key=lambda r: (r[3], r[2], r[0].tobytes()))]


def score_quality(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each document."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            raw = np.array([m.raw(*x) for x in _made(b)] if m else np.zeros(len(b)), np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(raw, -500, 500))))], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", (doc_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), *_inputs(docs))
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Train on the sample, then score all documents."""
    rows = training_rows(docs, labels, label)
    return score_quality(docs, Machine().fit(rows) if rows else None)
