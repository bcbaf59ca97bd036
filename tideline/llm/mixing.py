"""Mixing sources to target weights, with DataFrame functions only.

``source_targets`` turns weights into targets (water filling below a cap of repetitions),
``mix_copies`` gives every document its number of copies, ``mix`` emits the copies.

A document is emitted floor(rate) times, and once more if a hash-seeded uniform number is below the
fraction of the rate. The number depends on the id and the seed alone (of a null id, on the text): reruns agree, and so
do rows with one id.

Cases: null text has size 0; null source is a source of its own, last in order; a source of size 0 has target 0
and takes nothing; sources that tie in cap / weight fill up by name; an empty table gives an empty result; repeated rows are
documents of their own; very long texts are counted whole. Extra columns, of whatever name, pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import WORD, materialize

MAX_REPEATS = 3.0
#: Above so many sources the targets are joined by shuffle, not by broadcast.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of words of the text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(order: Column, weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """1, 2, 3, 1, 2, 3, ... by the source's place (from 0)."""
    return F.element_at(F.array(*[F.lit(w) for w in weights]), (order % len(weights) + 1).cast("int"))


def source_targets(sized: DataFrame, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    The sources share all words by weight; a target stops at ``max_repeats`` times the source's size and the
    excess goes to the others by weight, until none is above. The fixed point is target = min(cap, level * weight).
    Sources fill up in the order of cap / weight; with the first i of them full, the words left over the weight left rise
    until the next source is no longer below that level and fall from there, so the level is their greatest value, and
    one running sum finds it. The table has a row for each source: the ordered window handles sources, never documents.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.col("total")
    return (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", cyclic_weights(F.row_number().over(names) - 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(max_repeats))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("open_weight", F.col("all_weight") - F.sum("weight").over(by_ratio) + F.col("weight"))
        .withColumn("level", F.max((total - F.col("before")) / F.col("open_weight")).over(everything))
        .select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))
    )


def draw(doc_id: Column, text: Column) -> Column:
    """What a document's number is drawn from: the id or, if that is null, a digest of the text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def uniform(drawn: Column, seed: int) -> Column:
    """A number in [0, 1): the first 52 bits of an MD5."""
    text = F.concat(drawn, F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_copies(docs: DataFrame, seed: int = 7, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: a row for each document.

    The texts are read once: ids, sources and sizes go to a table in the shared folder, a hundredth of the input.
    """
    sized = materialize(docs.select("doc_id", "source", draw(F.col("doc_id"), F.col("text")).alias("drawn"), word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sized, max_repeats)
    if targets.select("source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)  # within a checked number of rows; beyond, AQE splits a hot source's side
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(max_repeats))).otherwise(0.0)
    return (
        sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.source", "d.size", "d.drawn", "t.source_size", "t.target", rate.alias("rate"))
        .withColumn("copies", F.floor("rate") + (uniform(F.col("drawn"), seed) < F.col("rate") - F.floor("rate")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("rate", "drawn")
    )


def mix(docs: DataFrame, seed: int = 7, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The mixed documents: the columns of ``docs``, a row for each copy; documents without a copy go.

    Rates are computed per source and applied to the whole rows where they lie, so texts are never shuffled.
    """
    sized = materialize(docs.select("source", word_count(F.col("text")).alias("size")).groupBy("source").agg(F.sum("size").alias("size")), "sizes")
    rates = source_targets(sized, max_repeats).select("source", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(max_repeats))).otherwise(0.0).alias("__rate"))
    if rates.select("source").limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    rate = F.col("r.__rate")
    copies = (F.floor(rate) + (uniform(F.col("d.drawn"), seed) < rate - F.floor(rate)).cast("long")).cast("int")
    packed = docs.select(F.struct("*").alias("doc"), draw(F.col("doc_id"), F.col("text")).alias("drawn"), "source")
    return (
        packed.alias("d").join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
        .select("d.doc", copies.alias("copies")).where("copies > 0")
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")
    )
