"""Token counts of whole texts under a public tokenizer, without materialising ids.

Pieces are counted once for each distinct pre-token and joined to the pre-token frequencies of each document.
For the vocabulary with word ends, a pre-token is a run of bytes other than ASCII white space, lower-cased (A-Z)
where the text has no ``<|``: the library lower-cases, drops white space and never joins across it, and its two
special strings hold none, so the pieces of a text are those of its pre-tokens, each as the library itself counts it.

Cases: null counts as empty (0 bytes, 0 tokens); repeated rows come back as often as they are there; rows with one
id and different texts stay apart; words that tie at the threshold are all sent to workers or all joined; an empty table
gives no rows; very long texts and runs without blanks are counted whole; extra columns, of whatever name, are ignored; ids
keep their type.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from itertools import compress, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import as_bytes, id_type, materialize, ship, small_batches
from tideline.llm.wordtable import HEAD, head_threshold, word_counts

LIMIT = 2048
_tokenizers: dict[str, object] = {}


def pre_tokens(text: bytes) -> list[bytes]:
    return text.split() if b"<|" in text else text.lower().split()


def _piece_counter(key: str, definition: bytes):
    """A function from pre-tokens to their numbers of pieces."""
    if key not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(definition.decode())
        t.no_truncation()
        t.no_padding()
        _tokenizers[key] = t
    return lambda words: [len(e) for e in _tokenizers[key].encode_batch_fast(words, add_special_tokens=False)]


def piece_table(counts: DataFrame, path: str) -> DataFrame:
    """Add ``pieces`` to a table of distinct words."""
    spark = counts.sparkSession
    with open(path, "rb") as f:  # the vocabulary lies with the driver; workers get its contents
        sent = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _piece_counter(path, sent.value)
        for b in batches:
            words = b.column("word").cast(pa.string()).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("c"), pa.array(count(words), pa.int32())], names=["word", "c", "pieces"])

    return counts.mapInArrow(run, "word binary, c long, pieces int")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: a row for each document."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    pieces = materialize(piece_table(word_counts(docs, pre_tokens), path), "pieces")
    least = head_threshold(pieces, head)
    known = pieces.where(F.col("c") >= least).select("word", "pieces").toArrow()  # at most `head` rows
    sent = spark.sparkContext.broadcast(dict(zip(known["word"].to_pylist(), known["pieces"].to_pylist(), strict=True)))
    del known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = sent.value.get
        for b in batches:
            ids, keys, words_out, numbers, bases, rows, sizes = [], [], [], [], [], [], []
            for doc_id, key, text in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), as_bytes(b.column("text")), strict=True):
                text = text or b""
                words = pre_tokens(text)
                values = list(map(get, words, repeat(-1)))
                rare = values.count(-1)
                # the document's own row: its word is no text, so it matches nothing in the join
                ids.append(doc_id), keys.append(key), words_out.append(b"\xff" + key.to_bytes(8, "little", signed=True))
                numbers.append(0), bases.append(sum(values) + rare), rows.append(1), sizes.append(len(text))
                if rare:
                    found = Counter(compress(words, map((-1).__eq__, values)))
                    n = len(found)
                    ids.extend(repeat(doc_id, n)), keys.extend(repeat(key, n)), words_out.extend(found), numbers.extend(found.values())
                    bases.extend(repeat(0, n)), rows.extend(repeat(0, n)), sizes.extend(repeat(0, n))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.column("doc_id").type), pa.array(keys, pa.int64()), pa.array(words_out, pa.binary()), pa.array(numbers, pa.int32()), pa.array(bases, pa.int64()), pa.array(rows, pa.int32()), pa.array(sizes, pa.int64())],
                names=["doc_id", "key", "word", "n", "base", "rows", "bytes"],
            )

    parts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text").mapInArrow(run, f"doc_id {id_type(docs)}, key long, word binary, n int, base long, rows int, bytes long")
    rare = pieces.where(F.col("c") < least).select("word", "pieces")
    summed = (
        parts.join(rare, "word", "left")
        .groupBy("doc_id", "key")
        .agg(F.sum(F.col("base") + F.col("n") * F.coalesce(F.col("pieces"), F.lit(0))).alias("tokens"), F.sum("rows").alias("rows"), F.max("bytes").alias("n_bytes"))
    )
    n_tokens = (F.col("tokens") / F.col("rows")).cast("long")  # equal rows were summed together
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
