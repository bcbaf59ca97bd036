"""Near-duplicate detection with DartMinHash signatures and banded joining.

Signature. Each element (a hash of five words) owns regions of a plane weight x rank: the cells [0, 1), [1, 2),
[2, 4), ... along the weight axis. Hashed darts fall into a cell as a Poisson process along the rank axis, at a
rate equal to the cell's width; a dart counts if its weight coordinate is below the element's weight and its rank
below (k ln k + 2k) / total weight, so a text throws about k ln k + 2k darts whatever its length. A dart's hash also
picks one of k coordinates, and each coordinate keeps its earliest dart; while one has none, the rank limit is
doubled. Two texts agree in a coordinate with probability equal to their weighted Jaccard similarity. Weights are 1 for
each distinct element (``weighting="set"``: plain Jaccard, as the near-duplicate contract has it) or the number of
occurrences (``"count"``).

Joining. Texts with one set of elements are one node. Bands of ``ROWS`` coordinates are joined by hash. In a bucket
every node is paired with one leader (most copies, then the greatest digest), so a bucket of n nodes gives n - 1 pairs.
Pairs are verified exactly on the full sets and the links that hold are merged into components. Buckets that then still
hold several components are compared again in tiles: pairs of different components that differ in at most ``MAX_BITS`` of
120 one-bit coordinates are verified exactly where they lie, and only links that hold leave the task. No link between
texts of one bucket is dropped but for the odds stated at the constants: together below 2 in 10,000 at a similarity of
0.8, and far less above (a test measures them between 0.80 and 0.82).

Hot groups are split: a leader of many pairs has its set repeated over as many salted keys as its share of all pairs asks
for, and a node, bucket or class with at least 1 / ``SHARES`` of the rows of a join meets its one fact by broadcast (there
are at most ``SHARES`` such keys). Nothing grows on the driver; lists that are broadcast have a checked number of rows, and
beyond it are joined by shuffle. Every loop writes its state to the shared folder and deletes what it no longer needs.

Cases: fewer than five words are one element, the whole text; texts without words (empty, blank) are one class;
a null text is a class of its own; repeated rows fall in one class; rows with one id and different texts are told
apart by the text; an empty table gives no rows; very long texts are read whole; extra columns, of whatever name, pass
through ``drop_near_duplicates``; ids keep their type.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import ASCII_LOWER, as_bytes, discard, id_type, materialize, ship, small_batches

SHINGLE = 5
SIMILARITY = 0.8
#: 24 bands of 5 coordinates: a pair at similarity 0.8 shares no band with probability (1 - 0.8^5)^24 = 7e-5.
BANDS, ROWS = 24, 5
#: Of 120 one-bit coordinates, a pair at 0.8 differs in 12 on average (deviation 3.3); 26 is 4.3 deviations above.
MAX_BITS = 26
#: Nodes in a block of a bucket of several components; a task holds the sets of two blocks.
TILE = 1024
#: Lists with more rows are joined by shuffle.
BROADCAST_ROWS = 500_000
#: A node or class with at least 1 / SHARES of all rows is joined by broadcast; there are at most SHARES of them.
SHARES = 1000
#: Elements in one vectorised step, and distinct words whose hashes a worker remembers.
STEP, REMEMBER = 200_000, 100_000

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31, _S11, _S32 = (np.uint64(x) for x in (30, 27, 31, 11, 32))
_FACTORS = np.array([pow(0xD6E8FEB86659FD93, 2 * j + 1, 1 << 64) for j in range(64)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class _WordHashes(dict):
    def __missing__(self, word):
        if len(self) > REMEMBER:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_word_hashes = _WordHashes()


def elements(text: bytes, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of lower-cased (A-Z) words, sorted, and their numbers of occurrences."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < size:
        h = np.concatenate([h, np.full(size - len(words), len(words), np.uint64)])
    n = len(h) - size + 1
    out = h[:n] * _FACTORS[0]
    for j in range(1, size):
        out = mix(out) + h[j : n + j] * _FACTORS[j]
    return np.unique(mix(out), return_counts=True)


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None, k: int) -> np.ndarray:
    """(texts, k) earliest darts, for texts with at least one element. ``weights`` None: all weights are 1."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    e = np.concatenate(sets)
    w = None if weights is None else np.concatenate(weights).astype(np.float64)
    total = sizes.astype(np.float64) if w is None else np.bincount(owner, w, len(sets))
    limit = (k * math.log(k) + 2 * k) / total
    ids = np.zeros(len(sets) * k, np.uint64)
    todo = np.arange(len(sets))
    while len(todo):
        chosen = np.zeros(len(sets), bool)
        chosen[todo] = True
        active = np.flatnonzero(chosen[owner])
        best = np.full(len(sets) * k, np.inf)
        slots, ranks, darts = [], [], []
        cell, low, width = 0, 0.0, 1.0
        while len(active):
            cur, rank, i = active, np.zeros(len(active)), 0
            while len(cur):
                with np.errstate(over="ignore"):
                    h = mix(e[cur] + _G * np.uint64((i << 8) + cell + 1))
                rank = rank - np.log(((h >> _S11).astype(np.float64) + 0.5) * 2.0**-53) / width
                inside = rank <= limit[owner[cur]]
                cur, rank, h = cur[inside], rank[inside], h[inside]
                h2 = mix(h + _G)
                hit = slice(None)
                if w is not None:  # where in the cell the dart fell
                    hit = low + width * ((mix(h2 + _G) >> _S11).astype(np.float64) * 2.0**-53) < w[cur]
                slots.append((owner[cur] * k + (((h2 >> _S32) * np.uint64(k)) >> _S32).astype(np.int64))[hit])
                ranks.append(rank[hit])
                darts.append(h[hit])
                i += 1
            low, width, cell = (1.0, 1.0, 1) if cell == 0 else (low * 2, width * 2, cell + 1)
            active = active[:0] if w is None else active[w[active] > low]
        slot, rank, dart = np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        ids[slot[first]] = dart[first]
        empty = np.isinf(best.reshape(len(sets), k)[todo]).any(1)
        todo = todo[empty]
        limit[todo] *= 2
    return ids.reshape(len(sets), k)


def band_hashes(signatures: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) hashes of the bands, each salted with its number."""
    parts = signatures[:, : bands * rows].reshape(len(signatures), bands, rows)
    return mix((parts * _FACTORS[:rows]).sum(2, dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _G)


def one_bits(signatures: np.ndarray) -> np.ndarray:
    """(texts, 2) words of 60 lowest bits each, of the first 120 coordinates."""
    bits = (mix(signatures[:, :120]) & np.uint64(1)).reshape(len(signatures), 2, 60)
    return (bits << np.arange(60, dtype=np.uint64)).sum(2, dtype=np.uint64)


def _signed(docs: DataFrame) -> str:
    return f"doc_id {id_type(docs)}, key long, node binary, bits array<long>, bands array<long>"


def _sign(weighting: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column("text"))
            n = len(texts)
            node, bits, bands = [None] * n, [[]] * n, [[]] * n
            held: list[tuple[int, np.ndarray, np.ndarray]] = []

            def flush():
                if held:
                    signatures = dart_signatures([s for _, s, _ in held], [c for _, _, c in held] if weighting == "count" else None, BANDS * ROWS)
                    for (i, _, _), x, y in zip(held, one_bits(signatures).view(np.int64).tolist(), band_hashes(signatures).view(np.int64).tolist(), strict=True):
                        bits[i], bands[i] = x, y
                    held.clear()

            waiting = 0
            for i, text in enumerate(texts):
                if text is None:
                    continue
                found, counts = elements(text)
                node[i] = xxhash.xxh3_128_digest(found.tobytes() + (counts.tobytes() if weighting == "count" else b""))
                if len(found):
                    held.append((i, found, counts))
                    waiting += len(found)
                    if waiting >= STEP:
                        flush()
                        waiting = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(node, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "node", "bits", "bands"])
        _word_hashes.clear()  # the worker goes on to other stages

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")


def sign(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """doc_id, key, node, bits, bands: a row for each document, written to the shared folder. Texts are read once."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    return materialize(_keyed(docs).mapInArrow(_sign(weighting), _signed(docs)), "signed")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows; ``df`` must be cheap to count."""
    return F.broadcast(df) if df.count() <= rows else df


def _to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [elements(t) for t in as_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())], names=["node", "elements", "counts"])
    _word_hashes.clear()


def _similarity(weighting: str):
    def of(a: bytes, b: bytes, ca: bytes, cb: bytes) -> float:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        if weighting == "set":
            return len(common) / (len(x) + len(y) - len(common))
        p, q = np.frombuffer(ca, np.int32), np.frombuffer(cb, np.int32)
        both = int(np.minimum(p[i], q[j]).sum())
        return both / (int(p.sum()) + int(q.sum()) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [of(*x) for x in zip(*(b.column(c).to_pylist() for c in ("ea", "eb", "ca", "cb")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(values, pa.float64())], names=["a", "b", "similarity"])

    return run


def node_sets(docs: DataFrame, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """(node, elements, counts) of the nodes in ``met``, written; only their texts are read again, one for each node."""
    chosen = materialize(nodes.join(met, "node", "left_semi").select("node", "row.doc_id", "row.key"), "chosen")
    k, c = _keyed(docs).alias("k"), bounded(chosen).alias("c")
    texts = k.join(c, (F.col("k.key") == F.col("c.key")) & F.col("k.doc_id").eqNullSafe(F.col("c.doc_id"))).select("c.node", "k.text")
    sets = materialize(texts.mapInArrow(_to_sets, "node binary, elements binary, counts binary"), "sets")
    repeated = sets.count() > chosen.count()  # rows that agree in id and text
    discard(chosen)
    if repeated:
        once = materialize(sets.dropDuplicates(["node"]), "sets")
        discard(sets)
        return once
    return sets


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, weighting: str, similarity: float) -> DataFrame:
    """(a, b, similarity) of the pairs of nodes whose exact similarity is high enough. ``pairs`` is a written table.

    A node of many pairs, like the leader of a large group, has its set under several salted keys, which share the pairs.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    sets = node_sets(docs, nodes, ends.distinct())
    share = F.lit(max(1.0, pairs.count() / SHARES))
    salts = materialize(ends.groupBy("node").count().where(F.col("count") > share).select("node", F.ceil(F.col("count") / share).cast("int").alias("salts")), "salts")  # at most 2 * SHARES rows
    several = F.broadcast(salts)
    salted = sets.join(several, "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    for end, other in (("a", "b"), ("b", "a")):
        s = F.broadcast(salts.select(F.col("node").alias(end), F.col("salts").alias("of")))
        pairs = pairs.join(s, end, "left").withColumn(f"salt_{end}", F.pmod(F.xxhash64(other), F.coalesce("of", F.lit(1))).cast("int")).drop("of")
    for end in ("b", "a"):
        s = salted.select(F.col("node").alias(end), F.col("salt").alias(f"salt_{end}"), F.col("elements").alias(f"e{end}"), F.col("counts").alias(f"c{end}"))
        pairs = pairs.join(s, [end, f"salt_{end}"])
    scored = pairs.select("a", "b", "ea", "eb", "ca", "cb").mapInArrow(_similarity(weighting), "a binary, b binary, similarity double")
    links = materialize(scored.where(F.col("similarity") >= similarity), "links")
    discard(sets, salts)
    return links


def join_shares(rows: DataFrame, facts: DataFrame, heavy: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row a key) by ``key``, without sending the rows of a frequent key to one task.

    ``heavy`` lists the keys that each hold at least 1 / SHARES of all rows: at most SHARES by construction. Their facts
    are broadcast, and their rows go through the join under ``spread`` (of the key's type), where they meet nothing.
    """
    names = [c for c in facts.columns if c != key]
    known = facts.join(F.broadcast(heavy), key, "left_semi")
    hot = heavy.join(F.broadcast(known), key, "left").select(F.col(key).alias("hot_key"), *[F.col(c).alias(f"hot_{c}") for c in names])
    is_hot = F.col("hot_key").isNotNull()
    probing = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn("probe", F.when(is_hot, spread).otherwise(F.col(key))).withColumn("cold", ~is_hot)
    cold = facts.select(F.col(key).alias("probe"), F.lit(True).alias("cold"), *[F.col(c).alias(f"cold_{c}") for c in names])
    joined = probing.join(cold, ["probe", "cold"], "left").select(*rows.columns, *[F.when(is_hot, F.col(f"hot_{c}")).otherwise(F.col(f"cold_{c}")).alias(c) for c in names])
    return joined.where(F.col(names[0]).isNotNull()) if how == "inner" else joined


def components(links: DataFrame, name: str = "labels", max_rounds: int = 100) -> DataFrame:
    """(node, label) for all nodes of the links (a, b), written; label is the least node of the component.

    Least labels spread along links, then labels are followed to their own labels; every round is written out, and the
    one before is deleted. A node of many links, and a label of many nodes, meet their label by broadcast.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    hubs = materialize(both.groupBy("b").count().where(F.col("count") * SHARES >= both.count()).select("b"), "hubs")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), name)
    nodes = labels.count()
    for _ in range(max_rounds):
        near = join_shares(both, labels.select(F.col("node").alias("b"), "label"), hubs, "b", F.col("a")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        common = materialize(labels.groupBy("label").count().where(F.col("count") * SHARES >= nodes).select("label"), "common")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        followed = join_shares(step, jump, common, "label", F.col("node"), "left")
        after = materialize(followed.select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), name)
        changed = not after.where(F.col("old") != F.col("label")).isEmpty()
        discard(labels, common)
        labels = after
        if not changed:
            discard(both, hubs)
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _tile_links(weighting: str, similarity: float):
    """Links of one tile of a bucket between different components, verified exactly; as many as join components."""

    def run(table: pa.Table) -> pa.Table:
        block, label = table["block"].to_pylist(), np.unique(np.array(table["label"].to_pylist(), object), return_inverse=True)[1]
        band, tile, nodes = table["band"][0].as_py(), table["tile"][0].as_py(), table["node"].to_pylist()
        bits, bands = (np.array(table[c].to_pylist(), np.int64) for c in ("bits", "bands"))
        bits, block, here = bits.view(np.uint64), np.array(block), int(np.flatnonzero((bands == band).all(0))[0])
        sets = [np.frombuffer(x, np.uint64) for x in table["elements"].to_pylist()]
        weights = [np.ones(len(x)) for x in sets] if weighting == "set" else [np.frombuffer(x, np.int32) for x in table["counts"].to_pylist()]
        total = np.array([w.sum() for w in weights])
        root = list(range(label.max() + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        out_a, out_b = [], []
        largest = np.bincount(label).argmax()
        for i in np.flatnonzero(label != largest).tolist():
            differ = np.bitwise_count(bits[i, 0] ^ bits[:, 0]).astype(np.int16) + np.bitwise_count(bits[i, 1] ^ bits[:, 1])
            near = (differ <= MAX_BITS) & (label != label[i])
            if tile["lo"] != tile["hi"]:
                near &= block != block[i]  # pairs within a block have a tile of their own
            js = np.flatnonzero(near)
            if len(js):  # a pair is checked in the first band that it shares
                js = js[~(bands[js, :here] == bands[i, :here]).any(1)]
            for at in range(0, len(js), 64):
                mine = find(label[i])
                part = [j for j in js[at : at + 64].tolist() if find(label[j]) != mine]
                if not part:
                    continue
                flat, w = np.concatenate([sets[j] for j in part]), np.concatenate([weights[j] for j in part])
                pos = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
                both = np.add.reduceat(np.where(sets[i][pos] == flat, np.minimum(weights[i][pos], w), 0), np.concatenate([[0], np.cumsum([len(sets[j]) for j in part])[:-1]]))
                for j, linked in zip(part, both / (total[i] + total[part] - both) >= similarity, strict=True):
                    if linked and find(label[i]) != find(label[j]):
                        root[find(label[i])] = find(label[j])
                        out_a.append(min(nodes[i], nodes[j])), out_b.append(max(nodes[i], nodes[j]))
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return run


def crossing_links(docs: DataFrame, nodes: DataFrame, shared: DataFrame, labels: DataFrame, hot_bands: DataFrame, weighting: str, similarity: float) -> DataFrame:
    """Links (a, b) between nodes of one bucket that are still in different components.

    Buckets of one component are done and drop out. A bucket is cut into blocks of about ``TILE`` nodes, and each two
    blocks are compared in a task of their own, which holds their sets; what leaves a task are links that hold.
    """
    placed = shared.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = materialize(placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("blocks")).where("lo != hi").select("band", "blocks"), "mixed")
    in_mixed = join_shares(placed, mixed, hot_bands, "band", F.xxhash64("node"))
    open_ = materialize(in_mixed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "open")
    sets = node_sets(docs, nodes, open_.select("node").distinct())
    with_bands = sets.join(nodes.select("node", "bits", "bands"), "node")
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("lo"), F.greatest(x, F.col("block")).alias("hi")))
    tiled = open_.join(with_bands, "node").select("band", "node", "bits", "bands", "label", "block", "elements", "counts", F.explode(tiles).alias("tile"))
    links = materialize(tiled.groupBy("band", "tile").applyInArrow(_tile_links(weighting, similarity), "a binary, b binary").distinct(), "crossing")
    discard(mixed, open_, sets)
    return links


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """doc_id, key, node, class_id, class_size: a row for each document.

    class_id is the least id of the class (null ids count only if the class has no other).
    """
    signed = sign(docs, weighting)
    nodes = materialize(signed.where("size(bands) > 0").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("bits").alias("bits"), F.first("bands").alias("bands"), F.min(F.struct("doc_id", "key")).alias("row")), "nodes")
    members = nodes.select("node", "copies", F.explode("bands").alias("band"))
    # one pass finds, for each bucket, its leader and whether it has more than one node
    buckets = materialize(members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("copies", "node")).alias("top")).where("n > 1").select("band", "n", F.col("top.node").alias("leader")), "buckets")
    hot_bands = materialize(buckets.where(F.col("n") * SHARES >= F.lit(nodes.count() * BANDS)).select("band"), "hot-bands")
    shared = materialize(join_shares(members.select("band", "node"), buckets.select("band", "leader"), hot_bands, "band", F.xxhash64("node")), "shared")
    discard(buckets)
    first = materialize(shared.where("node != leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "pairs")
    links = verify(docs, nodes, first, weighting, similarity)
    discard(first)
    labels = components(links)
    more = crossing_links(docs, nodes, shared, labels, hot_bands, weighting, similarity)
    if not more.isEmpty():
        labels = components(links.select("a", "b").union(more))
    discard(shared, hot_bands, links, more)
    heavy_nodes = nodes.where(F.col("copies") * SHARES >= signed.count()).select("node")
    worded, bare = signed.where("size(bands) > 0"), signed.where("size(bands) = 0")  # null and wordless texts have no links
    spread = F.encode(F.concat_ws(":", F.hex("key"), F.col("doc_id").cast("string")), "utf-8")
    labels_of = join_shares(worded.select("doc_id", "key", "node"), labels, heavy_nodes, "node", spread, "left").unionByName(bare.select("doc_id", "key", "node", F.lit(None).cast("binary").alias("label")))
    own = F.concat(F.lit(b"\x00null"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(b"\x00"), F.hex("key").cast("binary"))  # a null text is in no class with others
    grouped = materialize(labels_of.withColumn("label", F.coalesce("label", "node", own)), "grouped")
    discard(signed, nodes)
    classes = materialize(grouped.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "class_sizes")
    heavy_classes = classes.where(F.col("class_size") * SHARES >= grouped.count()).select("label")
    sized = classes.select("label", "class_size", "class_id")
    joined = join_shares(grouped, sized, heavy_classes, "label", spread)
    return joined.select("doc_id", "key", "node", "class_id", "class_size", F.col("label").alias("class_key"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """One document of each class, the one with the least id (then the least hash of the text); columns of ``docs``."""
    classes = materialize(near_duplicates(docs, similarity, weighting).select("doc_id", "key", "class_key"), "classes")
    row = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "key")
    kept = classes.groupBy("class_key").agg(F.min(row).alias("row")).select("row.doc_id", "row.key")
    gone = materialize(classes.select("doc_id", "key").subtract(kept), "gone")
    packed = docs.select(F.struct("*").alias("doc"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"))
    p, g = packed.alias("p"), bounded(gone).alias("g")
    left = p.join(g, (F.col("p.key") == F.col("g.key")) & F.col("p.doc_id").eqNullSafe(F.col("g.doc_id")), "left_anti")
    repeated = classes.groupBy("doc_id", "key").count().where("count > 1").limit(1).count()
    if repeated:  # rows that agree in id and text: keep one
        left = left.dropDuplicates(["doc_id", "key"])
    return left.select("doc.*")
