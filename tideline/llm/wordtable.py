"""Sums over the words of each document of a value that belongs to the distinct word.

Distinct words are counted once over the corpus (``word_counts``). Values for the most frequent ones, at most
``HEAD`` of them whatever the corpus, are sent to all workers and summed in one pass over the texts; the words
beyond go to a join as (document, word, number) rows. Frequent words never meet in one task, and what is sent
has a fixed bound.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, ship, small_batches

HEAD = 400_000
#: A worker hands its counts on when it holds so many distinct words.
FLUSH = 400_000


def word_counts(docs: DataFrame, words_of: Callable[[bytes], list[bytes]]) -> DataFrame:
    """word binary, c long: how often each word of ``words_of`` occurs in the column text."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)

    def batch(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in as_bytes(b.column(0)):
                if text:
                    counts.update(words_of(text))
            if len(counts) >= FLUSH:
                yield batch(counts)
                counts = Counter()
        yield batch(counts)

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def head_threshold(counts: DataFrame, head: int = HEAD) -> int:
    """The least count for which at most ``head`` words have that count or more."""
    steps = counts.groupBy(F.least(F.col("c"), F.lit(1_000_000)).alias("c")).agg(F.count(F.lit(1)).alias("words"))
    # counts are grouped on a scale of bounded length: exact up to 2,000, then by powers of 1.05
    scaled = steps.groupBy(F.when(F.col("c") <= 2000, F.col("c")).otherwise(F.ceil(F.pow(F.lit(1.05), F.floor(F.log(F.col("c")) / F.log(F.lit(1.05)))))).cast("long").alias("c")).agg(F.sum("words").alias("words"))
    least, above = 1_000_001, 0
    for row in sorted(scaled.collect(), key=lambda r: -r.c):
        above += row.words
        if above > head:
            break
        least = row.c
    return least
