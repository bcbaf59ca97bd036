"""Byte-balanced shards by Karmarkar-Karp differencing over indivisible groups (equal texts).

Partial partitions are k-tuples of bin loads. The two with the largest spread are combined again and again, the
heaviest bin of one with the lightest of the other, until one is left.

The number of items that are differenced is bounded whatever the input: a group of at least 1/``ITEMS`` of all
bytes is an item of its own (there are at most ``ITEMS`` of those), and smaller groups are bundled by the hash of
their key into ``ITEMS`` bundles, each an item. Differencing runs in one executor task over at most 2 * ``ITEMS``
(key, bytes) pairs. Both maps from items to shards have at most ``ITEMS`` rows, so rows find their shard by
broadcast joins: no row is shuffled for it and no hot group meets in a task.

Slots: rows are numbered within (shard, chunk of ids) and shifted by the number of rows in earlier chunks, so that
no task sorts a whole shard.

Cases: null texts are one group, of size 1 a row; empty texts another; an empty table gives no rows; groups that tie in
size are taken by key, and rows that tie in id and text are numbered in any order, which their columns do not show; a
very long text, or a group of more bytes than a shard's share, has a shard to itself as far as the rest allows. Repeated
rows are rows of their own. Extra columns, of whatever name, pass through ``shard_documents``, but for one named
``shard``, which is replaced.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import materialize

ITEMS = 8192
CHUNK = 50_000


class Partial:
    """A partial partition: loads in ascending order, and the tree of what was combined, with the bins' places."""

    __slots__ = ("loads", "name", "left", "right", "to_left", "to_right")

    def __init__(self, loads, name=None, left=None, right=None, to_left=None, to_right=None):
        self.loads, self.name, self.left, self.right, self.to_left, self.to_right = loads, name, left, right, to_left, to_right


def difference(items: list[tuple[object, int]], k: int) -> tuple[dict, list[int]]:
    """Karmarkar-Karp for items (name, size) into k bins: {name: bin} and the bins' loads.

    Ties are broken by the order given, so equal input gives equal output.
    """
    heap = [(-size, n, Partial([0] * (k - 1) + [size], name=(name,))) for n, (name, size) in enumerate(items)]
    heapq.heapify(heap)
    if not heap:
        return {}, [0] * k
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        joined = [x + y for x, y in zip(a.loads, reversed(b.loads), strict=True)]
        order = sorted(range(k), key=joined.__getitem__)
        place = [0] * k
        for p, i in enumerate(order):
            place[i] = p
        part = Partial([joined[i] for i in order], left=a, right=b, to_left=place, to_right=place[::-1])
        heapq.heappush(heap, (part.loads[0] - part.loads[-1], n, part))
        n += 1
    root, out = heap[0][2], {}
    stack = [(root, list(range(k)))]
    while stack:
        part, at = stack.pop()
        if part.name:
            out[part.name[0]] = at[k - 1]
        else:
            stack.append((part.left, [at[p] for p in part.to_left]))
            stack.append((part.right, [at[p] for p in part.to_right]))
    return out, root.loads


def _difference_table(shards: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["bytes"].to_pylist(), table["key"].to_pylist(), table["bundle"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1] or b"", -1 if x[2] is None else x[2]))
        placed, _ = difference([((key, bundle), size) for size, key, bundle in rows], shards)
        return pa.table({"key": pa.array([x[1] for x in rows], pa.binary()), "bundle": pa.array([x[2] for x in rows], pa.int32()), "shard": pa.array([placed[x[1], x[2]] for x in rows], pa.int32())})

    return run


def group_key(text: Column) -> Column:
    """Digest of the text; null texts share a key that no digest has."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


def byte_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null counts as empty."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def bundle_of(key: Column, items: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(items)).cast("int")


def assign_items(groups: DataFrame, shards: int, items: int = ITEMS) -> DataFrame:
    """(key, bundle, shard) for a table of (key binary, bytes long) with a row for each group.

    Rows with a key are large groups, rows with a bundle stand for all smaller groups of that hash.
    """
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("total")).first().total
    large = F.col("bytes") * F.lit(items) >= F.lit(total)
    listed = groups.groupBy(F.when(large, F.col("key")).alias("key"), F.when(~large, bundle_of(F.col("key"), items)).alias("bundle")).agg(F.sum("bytes").alias("bytes"))
    return listed.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_difference_table(shards), "key binary, bundle int, shard int")


def place_rows(rows: DataFrame, assigned: DataFrame, items: int = ITEMS) -> DataFrame:
    """Add ``shard`` to rows that have a ``key``. Both sides that are broadcast have at most ``items`` rows."""
    large = assigned.where("key is not null").select("key", F.col("shard").alias("own_shard"))
    bundled = assigned.where("bundle is not null").select("bundle", F.col("shard").alias("bundle_shard"))
    joined = rows.join(F.broadcast(large), "key", "left").withColumn("bundle", bundle_of(F.col("key"), items)).join(F.broadcast(bundled), "bundle", "left")
    return joined.withColumn("shard", F.coalesce("own_shard", "bundle_shard")).drop("own_shard", "bundle_shard", "bundle")


def number_slots(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... without gaps within each shard, ordered by chunk, then id, then key."""
    chunks = max(1, math.ceil(rows.count() / chunk))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("key"))), F.lit(chunks)).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "chunk").count().select("shard", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "chunk").orderBy("doc_id", "key")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "chunk"]).withColumn("slot", (F.col("start") + F.col("place")).cast("long")).drop("chunk", "start", "place")


def group_sizes(rows: DataFrame) -> DataFrame:
    return materialize(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "groups")


def shard_rows(docs: DataFrame, shards: int = 16, items: int = ITEMS) -> DataFrame:
    """doc_id, key, size, text_crc32, shard, slot: a row for each document. The texts are read once."""
    text = F.col("text")
    rows = materialize(docs.select("doc_id", group_key(text).alias("key"), byte_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")), "rows")
    assigned = materialize(assign_items(group_sizes(rows), shards, items), "shards")
    return number_slots(materialize(place_rows(rows, assigned, items), "placed"))


def shard_documents(docs: DataFrame, shards: int = 16, items: int = ITEMS) -> DataFrame:
    """The documents with ``shard`` (one of that name is replaced); copies of one text stay together."""
    keyed = docs.drop("shard").select(F.struct("*").alias("doc"), group_key(F.col("text")).alias("key"), byte_size(F.col("text")).alias("size"))
    assigned = materialize(assign_items(group_sizes(keyed.select("key", "size")), shards, items), "shards")
    return place_rows(keyed, assigned, items).select("doc.*", "shard")
