"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A word (a run of letters, lower-cased, with the vocabulary's mark for a word's begin) has probability, in a language, of
the sum over all its segmentations into pieces of the product of their probabilities. A forward algorithm sums all
segmentations, for all languages at once; words are independent, so a text's log probability is the sum of its words'.
A letter that is no piece is emitted by the piece for unknown letters, whose learned probability is shared by
``UNKNOWN_LETTERS`` letters.

The recursion is vectorised: the distinct words of an Arrow batch that a worker has not met yet go through it together,
position by position, and their vectors are remembered (a bounded number). Runs of more than ``SHORT`` letters take
the same sums one run at a time, rescaled as they go, whole: a run is never cut and no probability is clamped.

Piece probabilities come from expectation maximisation: forward-backward counts of pieces over distinct training words,
summed across partitions. It starts from equal probabilities. The model has a number for each language and piece of the
fixed vocabulary; that is what the driver holds and sends (0.26 MB a language), however many texts there are.

Training takes a bounded sample: about ``TRAIN_ROWS`` documents of each language, chosen by hash. Scoring reads all of
every text.

Cases: null text, and text without letters, gives ``und`` and score 0; no training rows give ``und`` for all; languages
that tie give the first by code point; repeated rows are rows of their own; an empty table gives no rows; a very long
text, or a long run without blanks, is scored whole in time linear in it; extra columns, of whatever name, are ignored;
ids keep their type.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter, deque
from collections.abc import Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, discard, doc_crc, id_type, materialize, ship, small_batches

TRAIN_ROWS = 2500
ROUNDS = 3
REMEMBER = 400_000
BROADCAST_LANGUAGES = 10_000
BEGIN = "▁"
SMOOTH = 0.02
#: Letters that share the probability of an unknown one: about as many as Unicode has.
UNKNOWN_LETTERS = 140_000
#: Runs of up to so many letters are scored together; LIFT keeps their sums, a factor a letter, within doubles.
SHORT, LIFT = 32, 1e5
#: Doubles that the sums of one vectorised step may take.
STEP = 1 << 18
#: Training words of a language that a task puts through the recursion together.
TOGETHER = 20_000

_WORD = re.compile(r"[^\W\d_]+")
#: Word characters that are neither letters nor digits nor the underscore (like ² and Ⅷ).
_NUMBERS = {c for c in map(chr, range(0x80, 0x20000)) if unicodedata.category(c) in ("Nl", "No")}
#: Chunks of UTF-8: ASCII letters, lower-cased, and all bytes beyond ASCII; the rest are blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_M, _G = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S44 = np.uint64(29), np.uint64(44)


def chunks(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and of anything beyond ASCII."""
    return text.translate(_FOLD).split()


def runs(chunk: bytes) -> list[str]:
    """The lower-cased runs of letters in a chunk."""
    if chunk.isascii():
        return [chunk.decode()]
    text = chunk.decode().lower()
    if odd := _NUMBERS.intersection(text):
        text = text.translate(dict.fromkeys(map(ord, odd), " "))
    return _WORD.findall(text)


def _is_run(text: str) -> bool:
    return chunks(text.encode()) == [text.encode()] and runs(text.encode()) == [text]


def vocabulary(model: bytes) -> list[str]:
    """The pieces of a sentencepiece model that can occur in a lower-cased word."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = (p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i)))
    return sorted({x for x in pieces if x == x.lower() and (x.removeprefix(BEGIN) == "" or _is_run(x.removeprefix(BEGIN))) and x.count(BEGIN) <= 1})


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The hash of a string with one more letter."""
    h = (h ^ code) * _M
    return (h ^ (h >> _S29)) * _G


class Pieces:
    """A vocabulary: number of a piece by its text, and of all pieces that words contain, by vectorised hashing.

    Piece ``unknown`` stands for any letter that is no piece, piece ``none`` for a string that is none.
    """

    def __init__(self, vocab: list[str]):
        self.number = {p: i for i, p in enumerate(vocab)}
        self.lengths = np.array([*map(len, vocab), 1, 0])
        self.unknown, self.none = len(vocab), len(vocab) + 1
        self.longest = max(map(len, vocab), default=1)
        self.prefix, self.whole = np.zeros(1 << 20, bool), np.zeros(1 << 20, bool)
        hashes = np.zeros(len(vocab), np.uint64)
        for n in sorted(set(map(len, vocab))):
            at = [i for i, p in enumerate(vocab) if len(p) == n]
            letters, h = _codes([vocab[i] for i in at]).reshape(len(at), n), np.zeros(len(at), np.uint64)
            for j in range(n):
                h = _step(h, letters[:, j])
                self.prefix[h >> _S44] = True
            self.whole[h >> _S44] = True
            hashes[at] = h
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, numbers): for words by falling length, the pieces that end at place t with length n, [n - 1, t, word].

        Places count the begin mark; a letter that is no piece is ``unknown``.
        """
        sizes = np.array([len(w) + 1 for w in words])
        longest, steps = min(self.longest, int(sizes[0])), int(sizes[0])
        numbers = np.full((longest, steps + 1, len(words)), self.none, np.int32)
        codes = _codes([BEGIN + w for w in words])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) - first[word]
        numbers[0, place + 1, word] = self.unknown
        start, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for n in range(1, longest + 1):
            inside = place[start] + n <= sizes[word[start]]
            start, h = start[inside], h[inside]
            h = _step(h, codes[start + n - 1])
            alive = self.prefix[h >> _S44]
            start, h = start[alive], h[alive]
            if not len(start):
                break
            some = np.flatnonzero(self.whole[h >> _S44])
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            hit = self.hashes[at] == h[some]
            s = start[some[hit]]
            numbers[n - 1, place[s] + n, word[s]] = self.order[at[hit]]
        return sizes, numbers


def with_unknown(table: np.ndarray) -> np.ndarray:
    """Probabilities of pieces and of the unknown piece (rows) as those of strings: one of its letters, and 0 for none."""
    out = np.concatenate([table, np.zeros((1, table.shape[1]))])
    out[-2] /= UNKNOWN_LETTERS
    return out


def _lifted(pieces: Pieces, strings: np.ndarray) -> np.ndarray:
    return strings * (LIFT ** pieces.lengths)[:, None]


def _sums(pieces: Pieces, lifted: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, numbers, alpha[place, word, language]) for short words by falling length; alpha carries LIFT a place."""
    sizes, numbers = pieces.lattice(words)
    steps = int(sizes[0])
    live = np.searchsorted(-sizes, -np.arange(steps + 1), side="right")
    alpha = np.zeros((steps + 1, len(words), lifted.shape[1]))
    alpha[0] = 1.0
    for t in range(1, steps + 1):
        n = live[t]
        for size in range(1, min(t, len(numbers)) + 1):
            alpha[t, :n] += alpha[t - size, :n] * lifted[numbers[size - 1, t, :n]]
    return sizes, numbers, alpha


def _batches(words: list[str], languages: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Short words in batches of falling length, with their places in ``words``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(-sizes, kind="stable")[int((sizes > SHORT).sum()) :]
    width = max(64, STEP // (32 * languages))
    for at in range(0, len(order), width):
        yield order[at : at + width], [words[i] for i in order[at : at + width]]


def long_forward(pieces: Pieces, strings: np.ndarray, word: str) -> np.ndarray:
    """Log probabilities of a run of any length: the same sums place by place, scaled up where they get small."""
    text, languages = BEGIN + word, range(strings.shape[1])
    rows: dict[int, list[float]] = {}
    recent: deque[list[float]] = deque([[1.0] * len(languages)], maxlen=pieces.longest)
    logs = [0.0] * len(languages)
    get = pieces.number.get
    for j in range(1, len(text) + 1):
        here = [0.0] * len(languages)
        for n in range(1, len(recent) + 1):
            i = get(text[j - n : j])
            if i is None:
                if n > 1:
                    continue
                i = pieces.unknown
            p = rows.get(i) or rows.setdefault(i, strings[i].tolist())
            before = recent[-n]
            for k in languages:
                here[k] += before[k] * p[k]
        recent.append(here)
        for k in languages:
            if here[k] < 1e-150:
                for a in recent:
                    a[k] *= 1e150
                logs[k] -= 150 * math.log(10)
    return np.array([math.log(x) + y for x, y in zip(recent[-1], logs, strict=True)])


def log_probabilities(pieces: Pieces, strings: np.ndarray, words: list[str], lifted: np.ndarray | None = None) -> np.ndarray:
    """(words, languages): log probability of each word in each language, over all its segmentations."""
    lifted = _lifted(pieces, strings) if lifted is None else lifted
    out = np.zeros((len(words), strings.shape[1]))
    for at, part in _batches(words, strings.shape[1]):
        sizes, _, alpha = _sums(pieces, lifted, part)
        out[at] = np.log(alpha[sizes, np.arange(len(part))]) - sizes[:, None] * math.log(LIFT)
    for i, w in enumerate(words):
        if len(w) > SHORT:
            out[i] = long_forward(pieces, strings, w)
    return out


def _log_add(a: float, b: float) -> float:
    a, b = max(a, b), min(a, b)
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def long_expected(pieces: Pieces, strings: np.ndarray, word: str) -> dict[int, float]:
    """Expected numbers of pieces in a run of any length, in one language, by forward-backward in logarithms."""
    text, n = BEGIN + word, len(word) + 1
    arcs: list[tuple[int, int, int, float]] = []
    alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for j in range(1, n + 1):
        for i in range(max(0, j - pieces.longest), j):
            k = pieces.number.get(text[i:j], pieces.unknown if j - i == 1 else None)
            if k is not None:
                q = math.log(strings[k, 0])
                arcs.append((i, j, k, q))
                alpha[j] = _log_add(alpha[j], alpha[i] + q)
    out: dict[int, float] = {}
    for i, j, k, q in reversed(arcs):
        beta[i] = _log_add(beta[i], q + beta[j])
        out[k] = out.get(k, 0.0) + math.exp(alpha[i] + q + beta[j] - alpha[n])
    return out


def expected(pieces: Pieces, strings: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected numbers of each piece (the unknown one last) in words that occur so often, in one language (forward-backward)."""
    out, lifted = np.zeros(pieces.none + 1), _lifted(pieces, strings)
    for at, part in _batches(words, 1):
        sizes, numbers, alpha = _sums(pieces, lifted, part)
        alpha, q = alpha[:, :, 0], lifted[:, 0]
        weight = counts[at] / alpha[sizes, np.arange(len(part))]
        steps = int(sizes[0])
        beta = np.zeros_like(alpha)
        beta[sizes, np.arange(len(part))] = 1.0
        live = np.searchsorted(-sizes, -np.arange(steps + 1), side="right")
        for t in range(steps, 0, -1):
            n, parts = live[t], []
            for size in range(1, min(t, len(numbers)) + 1):
                share = q[numbers[size - 1, t, :n]] * beta[t, :n]
                parts.append(alpha[t - size, :n] * share * weight[:n])
                beta[t - size, :n] += share
            out += np.bincount(numbers[: len(parts), t, :n].ravel(), np.concatenate(parts), len(out))
    for w, c in zip(words, counts, strict=True):
        if len(w) > SHORT:
            for k, e in long_expected(pieces, strings, w).items():
                out[k] += c * e
    return out[:-1]


def training_words(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(lang, word, c) over about ``rows`` documents of each language; written to the shared folder."""
    spark = docs.sparkSession
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_crc(F.col("doc_id")) % 5 != 0)).select("lang", "text", "doc_id")
    shares = materialize(usable.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count(F.lit(1))).alias("share")), "shares")
    several = F.broadcast(shares) if shares.count() <= BROADCAST_LANGUAGES else shares  # else the texts shuffle by language
    place = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    ship(spark)
    small_batches(spark)
    chosen = usable.join(several, "lang").where(place < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), as_bytes(b.column("text")), strict=True):
                counts.setdefault(lang, Counter()).update(chunks(text))
        for lang, of in counts.items():
            words = [(w, c) for chunk, c in of.items() for w in runs(chunk)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([w for w, _ in words], pa.string()), pa.array([c for _, c in words], pa.int64())], names=["lang", "word", "c"])

    words = materialize(chosen.mapInArrow(run, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")
    discard(shares)
    return words


_kept: dict[str, object] = {}


def _keep(key: str, make):
    """What a worker made for ``key``, kept for the tasks to come; one thing at a time."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def train(docs: DataFrame, model: bytes, rows: int = TRAIN_ROWS, rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """(languages, vocabulary, probabilities): a row for each piece and one for the unknown piece, a column for each language."""
    spark = docs.sparkSession
    vocab = vocabulary(model)
    words = training_words(docs, rows)
    languages = [r.lang for r in words.select("lang").distinct().orderBy("lang").collect()]
    column = {lang: k for k, lang in enumerate(languages)}
    table = np.full((len(vocab) + 1, len(languages)), 1.0 / (len(vocab) + 1))
    key, sent_vocab = uuid.uuid4().hex, spark.sparkContext.broadcast(vocab)
    for _ in range(rounds if languages else 0):
        sent = spark.sparkContext.broadcast(table)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            pieces: Pieces = _keep(key, lambda: Pieces(sent_vocab.value))
            sums: dict[str, np.ndarray] = {}
            held: dict[str, tuple[list, list]] = {}

            def flush(lang: str) -> None:
                found, counts = held.pop(lang)
                sums[lang] = sums.get(lang, 0.0) + expected(pieces, with_unknown(sent.value[:, [column[lang]]]), found, np.array(counts))

            for b in batches:
                for lang, word, c in zip(*(b.column(x).to_pylist() for x in ("lang", "word", "c")), strict=True):
                    found, counts = held.setdefault(lang, ([], []))
                    found.append(word), counts.append(c)
                    if len(found) >= TOGETHER:
                        flush(lang)
            for lang in list(held):
                flush(lang)
            for lang, e in sums.items():
                used = np.flatnonzero(e)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(e[used])], names=["lang", "piece", "e"])

        found = words.mapInArrow(run, "lang string, piece int, e double").groupBy("lang", "piece").agg(F.sum("e").alias("e")).toArrow()
        counts = np.full(table.shape, SMOOTH)
        counts[found["piece"].to_numpy(), [column[x] for x in found["lang"].to_pylist()]] += found["e"].to_numpy()
        table = counts / counts.sum(0)
    discard(words)
    return languages, vocab, table


class Scorer:
    """Sums of log probabilities and numbers of the runs of chunks, remembered up to a bound."""

    def __init__(self, languages: list[str], vocab: list[str], table: np.ndarray):
        self.languages, self.pieces = languages, Pieces(vocab)
        self.strings = with_unknown(table)
        self.lifted = _lifted(self.pieces, self.strings)
        self.place: dict[bytes, int] = {}
        self.vectors = np.zeros((1024, len(languages) + 1))

    def _places(self, words: list[bytes]) -> np.ndarray:
        """Rows of the chunks' vectors; those of chunks that are not remembered are made."""
        at = np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))
        missing = at < 0
        if missing.any():
            new = list(set(compress(words, missing.tolist())))
            if len(self.place) + len(new) > REMEMBER and self.place:
                self.place.clear()
                return self._places(words)
            start, end = len(self.place), len(self.place) + len(new)
            while end > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            found = [[w.decode()] if w.isascii() else runs(w) for w in new]
            owner = np.repeat(np.arange(start, end), list(map(len, found)))
            self.vectors[start:end] = 0.0
            np.add.at(self.vectors, owner, np.column_stack([log_probabilities(self.pieces, self.strings, list(chain.from_iterable(found)), self.lifted), np.ones(len(owner))]))
            self.place.update(zip(new, range(start, end), strict=True))
            at[missing] = list(map(self.place.__getitem__, compress(words, missing.tolist())))
        return at

    def score(self, texts: list[bytes | None]) -> list[tuple[str, float]]:
        found = [chunks(t) if t and self.languages else [] for t in texts]
        out, sizes = [("und", 0.0)] * len(texts), np.fromiter(map(len, found), np.int64, len(found))
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        at = self._places(list(chain.from_iterable(found)))
        totals = np.add.reduceat(self.vectors.take(at, 0), np.concatenate([[0], np.cumsum(sizes)])[some])
        lettered = totals[:, -1] > 0
        some, totals = some[lettered], totals[lettered, :-1]
        best, top = totals.argmax(1), totals.max(1, keepdims=True)
        for i, k, x in zip(some.tolist(), best.tolist(), (1 / np.exp(totals - top).sum(1)).tolist(), strict=True):
            out[i] = (self.languages[k], x)
        return out


def identify(docs: DataFrame, trained: tuple[list[str], list[str], np.ndarray]) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row for each document; score is the posterior under equal priors."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    key, sent = uuid.uuid4().hex, spark.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer: Scorer = _keep(key, lambda: Scorer(*sent.value))
        for b in batches:
            found = scorer.score(as_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (doc_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {id_type(docs)}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, model_path: str) -> DataFrame:
    with open(model_path, "rb") as f:
        model = f.read()
    return identify(docs, train(docs, model))
