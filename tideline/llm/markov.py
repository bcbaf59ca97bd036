"""LM scoring with a hidden Markov model: Baum-Welch training across partitions, exact likelihood by scaled forward.

Tokens are the words of a text, lower-cased (A-Z), then one end. The hidden chain has ``STATES`` states. A state emits a
class of words and the class emits the word: the ``OWN`` most frequent words and the end are classes of their own, all
other words fall into ``REST`` classes by hash. Within such a class a word has probability (c + 1) / (sum of c + 1, plus 1
for unseen words); for the ``HEAD`` most frequent words this depends on the state too (``word_ratios``). So every token
sequence has a proper probability, and its logarithm is the forward recursion plus a sum over words.

Counts of all training words are gathered by shuffle; they grow with the corpus. Those of the ``HEAD`` most frequent words
are sent to workers; rarer words reach their counts through a join. Texts are encoded once as class numbers.

Baum-Welch: every task runs forward-backward over its whole texts and returns expected counts, which are summed across
tasks. Texts are cut into windows that are handled side by side; ``Windows`` says how vectors pass the cuts, so that no
text is broken. A sample of texts, seeded by k-means++ on a few of them, gives the starting point only: from there, rounds
run over the whole training part until the likelihood settles, that is until a round's gain in log likelihood is at most
``SETTLED`` a token. A last round counts the frequent words of hashed classes by state. Scores are exact.

Cases: null and empty texts are the end alone; an empty training part gives uniform classes; words that tie at a
threshold are all above it or all below; repeated rows are rows of their own, and so are rows with one id; an empty table
gives no rows; a very long text is scored whole, in memory of some 100 bytes a token; extra columns, of whatever name, are
ignored; ids keep their type.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain as chained
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ASCII_LOWER, as_bytes, discard, doc_crc, id_type, materialize, ship, small_batches
from tideline.llm.wordtable import head_threshold, word_counts

STATES = 8
OWN, REST = 20_000, 256
END, UNUSED = REST, REST + 1  # classes: REST hashed ones, the end, then the words of their own
HEAD = 300_000
#: Tokens of a window, windows in one vectorised step, tokens that give a first guess at a cut, tokens handled together (or one text).
WINDOW, TOGETHER, WARM, PACK = 256, 1024, 64, 500_000
#: By bytes of a number: steps between rescalings (each token's greatest emission is 1), and how far a vector at a cut may still move.
PRECISION = {4: (4, 1e-5), 8: (16, 1e-10)}
SAMPLE_TOKENS, SAMPLE_ROUNDS = 600_000, 6
SETTLED = 0.002
SEED_TEXTS = 200
#: Pseudo-counts of the corpus' distribution in each state, of equal moves in each state's moves.
PRIOR, PRIOR_MOVE = 200.0, 1.0


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(ASCII_LOWER).split()


def rest_class(word: bytes) -> int:
    return zlib.crc32(word) % REST


class Chain:
    """Parameters: start, move (S, S), emit (classes, S)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit


class Windows:
    """Sequences cut into windows of ``WINDOW`` tokens, which are then handled side by side; all vectors are scaled as they go.

    Nothing is lost at the cuts. For likelihoods, the product of a window's transfer matrices carries the forward vector to
    the next window. For expected counts, the vectors at the cuts are first taken from the ``WARM`` tokens beside them, then
    swept over whole windows again and again until none moves by more than ``TOLERANCE``: the vectors of the whole sequence.
    """

    def __init__(self, chain: Chain, ids: np.ndarray, sizes: np.ndarray, extra: np.ndarray | None = None, ratio: np.ndarray | None = None, kind=np.float64):
        """Classes of all tokens, sequence after sequence, and the sequences' lengths; ``ratio[:, extra]`` are further factors of the emissions."""
        self.states, self.kind = len(chain.start), kind
        self.emit, self.move, self.ahead = (np.ascontiguousarray(x, kind) for x in (chain.emit.T, chain.move, chain.move.T))
        self.ids, self.extra, self.ratio = ids, extra, ratio
        self.per = -(-sizes // WINDOW)
        self.first = np.cumsum(self.per) - self.per
        self.last = self.first + self.per - 1
        owner = np.repeat(np.arange(len(sizes)), self.per)
        nth = np.arange(len(owner)) - self.first[owner]
        self.start = (np.cumsum(sizes) - sizes)[owner] + nth * WINDOW
        self.length = np.minimum(WINDOW, sizes[owner] - nth * WINDOW)
        self.begins, self.ends = np.zeros((2, len(owner)), bool)
        self.begins[self.first] = self.ends[self.last] = True
        self.enter = np.repeat(chain.start[:, None], len(owner), 1).astype(kind)  # distribution of a window's first state, before its token
        self.leave = np.ones_like(self.enter)  # backward vector of a window's last token
        self.rescale, self.tolerance = PRECISION[np.dtype(kind).itemsize]

    def _groups(self, which: np.ndarray) -> Iterator[np.ndarray]:
        """Windows by falling length, so many at a time."""
        which = which[np.argsort(-self.length[which], kind="stable")]
        for at in range(0, len(which), TOGETHER):
            yield which[at : at + TOGETHER]

    def _emission(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(steps, states, windows) emissions, each token's divided by the greatest, and the sums of the logarithms of what they were divided by."""
        length = self.length[w]
        e = np.empty((int(length[0]), self.states, len(w)), self.kind)
        top = np.empty((len(e), len(w)), self.kind)
        for t in range(len(e)):
            at = self.start[w] + np.minimum(t, length - 1)
            self.emit.take(self.ids[at], 1, e[t], "clip")
            if self.ratio is not None:
                e[t] *= self.ratio.take(self.extra[at], 1)
            e[t].max(0, top[t])
            e[t] /= top[t]
        return e, np.where(np.arange(len(e))[:, None] < length, np.log(top), 0.0).sum(0)

    def _live(self, w: np.ndarray, steps: int) -> np.ndarray:
        return np.searchsorted(-self.length[w], -np.arange(steps + 1))

    def _forward(self, w: np.ndarray, e: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Forward vectors of the last tokens, the logarithms of their scales, and the vectors of all tokens if they are to be kept."""
        live, logs, end = self._live(w, len(e)), np.zeros(len(w)), np.empty((self.states, len(w)), self.kind)
        alpha = np.empty_like(e) if keep else None
        now, before = self.enter[:, w] * e[0], len(w)
        for t in range(np.count_nonzero(live[: len(e)])):
            n = live[t]
            if t:
                if n < before:
                    end[:, n:before] = now[:, n:]
                now = (self.ahead @ now[:, :n]) * e[t, :, :n]
            if t % self.rescale == self.rescale - 1:
                scale = now.sum(0)
                now /= scale
                logs[:n] += np.log(scale)
            if keep:
                alpha[t, :, :n] = now
            before = n
        end[:, :before] = now
        scale = end.sum(0)
        return end / scale, logs + np.log(scale), alpha

    def _entry(self, w: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Emission times backward vector of the windows' first tokens, scaled."""
        live, leave, now = self._live(w, len(e)), self.leave[:, w], np.empty((self.states, 0), self.kind)
        for t in range(len(e) - 1, -1, -1):
            n, m = live[t], now.shape[1]
            beta = np.empty((self.states, n), self.kind)
            beta[:, m:] = leave[:, m:n]
            np.matmul(self.move, now, beta[:, :m])
            now = e[t, :, :n] * beta
            if t % self.rescale == 0:
                now /= now.sum(0)
        return now

    def _carry_exactly(self) -> np.ndarray:
        """Carry forward vectors over the cuts by transfer matrices; the log likelihoods of what lies before the last windows."""
        out, logs = np.zeros(len(self.per)), np.zeros(len(self.start))
        transfers = np.zeros((self.states, self.states, len(self.start)))  # [to, from, window]
        for w in self._groups(np.flatnonzero(~self.ends)):
            e, add = self._emission(w)
            p = np.zeros((self.states, self.states, len(w)))
            p[np.arange(self.states), np.arange(self.states)] = e[0]
            for t in range(1, len(e)):
                p = (self.ahead @ p.reshape(self.states, -1)).reshape(p.shape)
                p *= e[t, :, None]
                if t % self.rescale == self.rescale - 1:
                    scale = p.sum((0, 1))
                    p /= scale
                    add = add + np.log(scale)
            transfers[:, :, w], logs[w] = p, add
        for k in range(int(self.per.max()) - 1):
            docs = np.flatnonzero(self.per > k + 1)
            w = self.first[docs] + k
            end = np.einsum("jin,in->jn", transfers[:, :, w], self.enter[:, w])
            scale = end.sum(0)
            self.enter[:, w + 1] = self.ahead @ (end / scale)
            out[docs] += logs[w] + np.log(scale)
        return out

    def log_likelihoods(self) -> np.ndarray:
        """Exact log likelihood of each sequence."""
        out = self._carry_exactly()
        for w in self._groups(self.last):
            e, top = self._emission(w)
            out[np.searchsorted(self.last, w)] += self._forward(w, e)[1] + top
        return out

    def _guess(self, groups: list) -> None:
        """Vectors at the cuts from the tokens beside them."""
        for w, e, _ in groups:
            some = np.flatnonzero(~self.ends[w])  # all of full length
            if len(some):
                self.enter[:, w[some] + 1] = self.ahead @ self._forward(w[some], e[-WARM:, :, some])[0]
            some = np.flatnonzero(~self.begins[w])
            if len(some):
                self.leave[:, w[some] - 1] = self.move @ self._entry(w[some], e[:WARM, :, some])

    def _sweep_forward(self, groups: list) -> tuple[list, np.ndarray]:
        """All forward vectors with the logarithms of their scales by group, and those of the windows' last tokens."""
        kept: list = [None] * len(groups)
        tail = np.empty_like(self.enter)
        stale = np.ones(len(self.start), bool)
        while stale.any():
            moved = np.zeros(len(self.start), bool)
            for g, (w, e, _) in enumerate(groups):
                some = np.flatnonzero(stale[w])
                if not len(some):
                    continue
                whole = len(some) == len(w)
                tail[:, w[some]], logs, alpha = self._forward(w[some], e if whole else e[:, :, some], keep=True)
                if whole:
                    kept[g] = alpha, logs
                else:
                    kept[g][0][:, :, some], kept[g][1][some] = alpha, logs
                inner = w[some][~self.ends[w[some]]]
                new = self.ahead @ tail[:, inner]
                moved[inner + 1] = np.abs(new - self.enter[:, inner + 1]).max(0) > self.tolerance
                self.enter[:, inner + 1] = new
            stale = moved
        return kept, tail

    def _sweep_backward(self, groups: list) -> None:
        stale = ~self.begins
        while stale.any():
            moved = np.zeros(len(self.start), bool)
            for w, e, _ in groups:
                some = np.flatnonzero(stale[w])
                if len(some):
                    new = self.move @ (self._entry(w, e)[:, some] if 2 * len(some) > len(w) else self._entry(w[some], e[:, :, some]))
                    before = w[some] - 1
                    moved[before] = (np.abs(new - self.leave[:, before]).max(0) > self.tolerance) & ~self.begins[before]
                    self.leave[:, before] = new
            stale = moved

    def expectations(self, classes: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts (start, move, emit) and the log likelihood. Emissions are counted by class, or by ``of`` for each token."""
        groups = [(w, *self._emission(w)) for w in self._groups(np.arange(len(self.start)))]
        of = self.ids if of is None else of
        self._guess(groups)
        kept, tail = self._sweep_forward(groups)
        self._sweep_backward(groups)
        start, move, counts, value = np.zeros(self.states), np.zeros((self.states, self.states)), np.zeros((classes, self.states)), 0.0
        for (w, e, top), (alpha, logs) in zip(groups, kept, strict=True):
            value += float((top + logs).sum())
            live, leave, now = self._live(w, len(e)), self.leave[:, w], np.empty((self.states, 0), self.kind)
            for t in range(len(e) - 1, -1, -1):
                n, m = live[t], live[t + 1]
                beta = np.empty((self.states, n), self.kind)
                beta[:, m:] = leave[:, m:n]
                np.matmul(self.move, now, beta[:, :m])
                a = alpha[t, :, :n]
                both = a * beta
                total = both.sum(0)
                if m:
                    move += (a[:, :m] / total[:m]) @ now.T
                now = e[t, :, :n] * beta
                if t % self.rescale == 0:
                    now /= now.sum(0)
                np.divide(both, total, out=a)
            start += alpha[0][:, self.begins[w]].sum(1)
            inner = np.flatnonzero(~self.begins[w])  # moves over the cuts
            end = tail[:, w[inner] - 1]
            move += (end / (end * (self.move @ now[:, inner])).sum(0)) @ now[:, inner].T
            step = np.arange(len(e))[:, None]
            inside = step < self.length[w]
            at = of[(self.start[w] + step)[inside]]
            for s in range(self.states):
                counts[:, s] += np.bincount(at, alpha[:, s][inside], classes)
        return start, move * self.move, counts, value


def estimate(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Chain:
    """Parameters from expected counts; ``prior`` is the corpus' distribution of classes."""
    states = len(start)
    return Chain((start + 1) / (start.sum() + states), (move + PRIOR_MOVE) / (move.sum(1, keepdims=True) + states * PRIOR_MOVE), (emit + PRIOR * prior[:, None]) / (emit.sum(0) + PRIOR))


def seed_chain(texts: list[np.ndarray], prior: np.ndarray, states: int = STATES, seed: int = 11) -> Chain:
    """k-means++ over texts by their log likelihood: each state starts from one text, far from those before."""
    rng = np.random.default_rng(seed)
    classes = len(prior)
    emit, seeds, gain = [], [], None
    for s in range(states):
        if not texts:
            emit.append(prior * (1 + 0.01 * rng.random(classes)))
            continue
        worth = np.ones(len(texts)) if gain is None else np.maximum(gain.max() - gain, 1e-9)
        pick = int(rng.choice(len(texts), p=worth / worth.sum()))
        seeds.append(pick)
        one = 0.5 * np.bincount(texts[pick], minlength=classes) / len(texts[pick]) + 0.5 * prior
        emit.append(one)
        score = np.array([np.log(one[t] / prior[t]).mean() for t in texts])
        gain = score if gain is None else np.maximum(gain, score)
    b = np.stack(emit, 1)
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95)
    even = np.full(states, 1 / states)
    return Chain(even, move, b / b.sum(0))


_heads: dict[str, tuple] = {}


def _encode(key: str, sent):
    """Rows with class numbers, numbers of the frequent words among hashed classes, sums over frequent words, and the rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _heads:
            words, classes, counts, rest_totals, end_count = sent.value
            _heads.clear()
            logs = np.log10(counts + 1.0)
            rest = np.where(classes < REST, logs - np.log10(rest_totals)[np.minimum(classes, REST - 1)], 0.0)
            _heads[key] = ({w: i for i, w in enumerate(words)}, np.append(classes, 0).astype(np.uint16), np.append(logs, 0.0), np.append(rest, 0.0), np.log10(rest_totals), math.log10(end_count + 1.0), int(end_count > 0))
        place, classes, logs, rests, rest_totals, end_log, end_known = _heads[key]
        unknown = len(classes) - 1
        for b in batches:
            found = [tokens_of(t or b"") for t in as_bytes(b.column("text"))]
            n = len(found)
            sizes = np.fromiter(map(len, found), np.int64, n)
            words, owner = list(chained.from_iterable(found)), np.repeat(np.arange(n), sizes)
            at = np.fromiter(map(place.get, words, repeat(unknown)), np.int64, len(words))
            code, is_rare = classes[at], at == unknown
            names, of = list(compress(words, is_rare.tolist())), owner[is_rare]
            code[is_rare] = np.fromiter(map(rest_class, names), np.uint16, len(names))
            rest = np.bincount(owner, rests[at], n) - np.bincount(of, rest_totals[code[is_rare]], n)
            rare = np.bincount(of, minlength=n)
            ids = np.full(len(words) + n, END, np.uint16)
            ids[np.arange(len(words)) + owner] = code
            hashed = code < REST
            rare_offsets = np.concatenate([[0], np.cumsum(rare)])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("rid"), b.column("doc_id"), b.column("held_out"), _binaries(ids, sizes + 1), _binaries(at[hashed].astype(np.uint32), np.bincount(owner[hashed], minlength=n)), pa.array(sizes + 1),
                    pa.array(np.bincount(owner, logs[at], n) + end_log), pa.array(rest), pa.array(sizes - rare + end_known), pa.ListArray.from_arrays(pa.array(rare_offsets, pa.int32()), pa.array(names, pa.binary())),
                ],
                names=["rid", "doc_id", "held_out", "ids", "frequent", "n_tokens", "base", "rest", "known", "rare"],
            )

    return run


def _binaries(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Stretches of a flat array as binary values."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one after the other, and their numbers in each row."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.empty(0, kind)
    return values, np.diff(offsets) // np.dtype(kind).itemsize


def _packs(sizes: np.ndarray) -> Iterator[slice]:
    """Rows of at most ``PACK`` tokens together, or one row."""
    at, total = 0, np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, total[at] + PACK, "right")) - 1)
        yield slice(at, end)
        at = end


def _sequences(b: pa.RecordBatch, words: int | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(rows, classes, sizes, numbers) of packs of texts; a token that is no frequent word of a hashed class has number ``words``."""
    ids, sizes = _flat(b.column("ids"), np.uint16)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    numbers = None
    if words is not None:
        numbers = np.full(len(ids), words, np.int64)
        numbers[ids < REST] = _flat(b.column("frequent"), np.uint32)[0]
    for rows in _packs(sizes):
        part = slice(edges[rows.start], edges[rows.stop])
        yield rows, ids[part].astype(np.int64), sizes[rows], None if numbers is None else numbers[part]


def _expect(sent, states: int, words: int | None = None):
    """Sums of expected counts of a task: by class, or by frequent word of a hashed class (of ``words``; the last is for all other tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, sums = sent.value, None
        for b in batches:
            for _, ids, sizes, numbers in _sequences(b, words):
                windows = Windows(chain, ids, sizes, kind=np.float32)
                if words is None:
                    part = windows.expectations(len(chain.emit))
                else:
                    part = windows.expectations(words + 1, numbers)
                sums = list(part) if sums is None else [x + y for x, y in zip(sums, part, strict=True)]
        if sums is not None:
            start, move, emit, value = sums
            used = np.flatnonzero(emit.sum(1))
            place = np.concatenate([[-1], -2 - np.arange(states), [-2 - states], used])
            rows = np.concatenate([start[None], move, np.full((1, states), value), emit[used]])
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), *[pa.array(rows[:, s]) for s in range(states)]], names=["place", *[f"s{s}" for s in range(states)]])

    return run


def _gather(texts: DataFrame, chain: Chain, words: int | None = None) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Rows (start, move, likelihood) by number below 0, and the table of expected emissions; it has a row for each class or frequent word, however many texts there are."""
    states = len(chain.start)
    sent = texts.sparkSession.sparkContext.broadcast(chain)
    columns = [f"s{s}" for s in range(states)]
    made = texts.select("ids", "frequent") if words is not None else texts.select("ids")
    found = made.mapInArrow(_expect(sent, states, words), "place int, " + ", ".join(f"{c} double" for c in columns)).groupBy("place").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    place, values = found["place"].to_numpy(), np.stack([found[c].to_numpy() for c in columns], 1) if found.num_rows else np.zeros((0, states))
    emit = np.zeros((len(chain.emit) if words is None else words + 1, states))
    emit[place[place >= 0]] = values[place >= 0]
    return {int(p): v for p, v in zip(place[place < 0], values[place < 0], strict=True)}, emit


def _round(texts: DataFrame, chain: Chain, prior: np.ndarray) -> tuple[Chain, float]:
    """One Baum-Welch round, and the log likelihood before it."""
    states = len(chain.start)
    rows, emit = _gather(texts, chain)
    zero = np.zeros(states)
    return estimate(rows.get(-1, zero), np.stack([rows.get(-2 - s, zero) for s in range(states)]), emit, prior), float(rows.get(-2 - states, zero)[0])


def settle(texts: DataFrame, chain: Chain, prior: np.ndarray, tokens: int) -> Chain:
    """Rounds over all texts until one gains no more than ``SETTLED`` a token."""
    last, gain = -math.inf, math.inf
    while gain > SETTLED * tokens:  # the likelihood has a bound, so this ends
        chain, value = _round(texts, chain, prior)
        last, gain = value, value - last
    return chain


def word_ratios(texts: DataFrame, chain: Chain, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(states, words + 1): how much more probable than in its class at large a frequent word of a hashed class is in each state.

    A last round counts such words by state. Of n occurrences in a state that has the share p of all occurrences of such
    words of the class, a word that occurs c times gets (n / p + 1) / (c + 1): a class still sums to 1 in each state, rarer and
    unseen words included, which have the ratio 1. So has the last column, which stands for them.
    """
    words = len(classes)
    _, found = _gather(texts, chain, words)
    hashed = np.flatnonzero(classes < REST)
    by_class = np.zeros((REST, found.shape[1]))
    np.add.at(by_class, classes[hashed], found[hashed])
    share = by_class / np.maximum(by_class.sum(1, keepdims=True), 1e-300)
    share = np.where(share > 1e-9, share, np.inf)[classes[hashed]]  # a state that hardly has the class prefers no word of it
    ratio = np.ones((words + 1, found.shape[1]))
    ratio[hashed] = np.where(np.isinf(share), 1.0, (found[hashed] / share + 1) / (counts[hashed][:, None] + 1))
    return np.ascontiguousarray(ratio.T)


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, ratio = sent.value
        for b in batches:
            values = np.empty(len(b))
            for rows, ids, sizes, numbers in _sequences(b, ratio.shape[1] - 1):
                values[rows] = Windows(chain, ids, sizes, numbers, ratio).log_likelihoods() / math.log(10)
            kept = ["rid", "doc_id", "held_out", "n_tokens", "base", "rest", "known"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(values, pa.float64())], names=[*kept, "forward"])

    return run


def score_texts(docs: DataFrame, states: int = STATES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each document."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    held_out = doc_crc(F.col("doc_id")) % 7 == 2
    counts = materialize(word_counts(docs.where(~held_out), tokens_of), "counts")
    train_texts = docs.where(~held_out).count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    total, distinct = sums.n + train_texts, sums.v + int(train_texts > 0)
    own, head = max(head_threshold(counts, OWN), 2), max(head_threshold(counts, HEAD), 2)
    known = counts.where(F.col("c") >= head).toArrow().sort_by([("c", "descending"), ("word", "ascending")])  # at most HEAD rows
    words, numbers = known["word"].to_pylist(), known["c"].to_numpy()
    is_own = numbers >= own
    classes = np.where(is_own, UNUSED + np.cumsum(is_own) - 1, np.array([rest_class(w) for w in words], np.int64))
    hashed = F.pmod(F.crc32("word"), F.lit(REST))
    rest_totals, rest_counts = np.ones(REST), np.zeros(REST)
    for r in counts.where(F.col("c") < own).groupBy(hashed.alias("r")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():  # REST rows
        rest_totals[r.r] += r.c + r.v
        rest_counts[r.r] = r.c
    prior = np.concatenate([rest_counts, [train_texts], numbers[is_own]]) + 0.5
    prior /= prior.sum()
    encode = _encode(uuid.uuid4().hex, spark.sparkContext.broadcast((words, classes, numbers.astype(np.float64), rest_totals, train_texts)))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", held_out.alias("held_out"), "text")  # rows are told apart by place: the table is written once
    schema = f"rid long, doc_id {id_type(docs)}, held_out boolean, ids binary, frequent binary, n_tokens long, base double, rest double, known long, rare array<binary>"
    encoded = materialize(rows.mapInArrow(encode, schema), "encoded")

    train = encoded.where(~F.col("held_out"))
    place = F.xxhash64("ids", F.lit(3))
    share = min(1.0, SAMPLE_TOKENS / max(1, total))
    sample = materialize(train.where(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))).select("ids"), "sample")
    seeds = [np.frombuffer(r.ids, np.uint16) for r in sample.orderBy(F.xxhash64("ids"), "ids").limit(SEED_TEXTS).select("ids").collect()]
    chain = seed_chain([t for t in seeds if len(t) > 1], prior, states)
    for _ in range(SAMPLE_ROUNDS):
        chain, _ = _round(sample, chain, prior)
    discard(sample)
    chain = settle(train, chain, prior, total)
    ratio = word_ratios(train, chain, classes, numbers)

    scored = encoded.mapInArrow(_score(spark.sparkContext.broadcast((chain, ratio))), f"rid long, doc_id {id_type(docs)}, held_out boolean, n_tokens long, base double, rest double, known long, forward double")
    rare = encoded.select("rid", F.explode("rare").alias("word"))
    few = counts.where(F.col("c") < head).select("word", "c")
    added = rare.join(few, "word").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1.0)).alias("logs"), F.count(F.lit(1)).alias("found"))
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.join(added, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"), (F.col("forward") + F.col("rest") + logs).alias("score"),
    )
