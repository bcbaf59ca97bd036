"""Every operator on the same awkward tables: clashing names, ids of another type, ties, long runs, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import decontam, dedup, language, markov, mixing, quality_model, quality_rules, secret_scan, sharding, tokens

#: Names that some step uses for columns of its own.
CLASHING = ("doc", "host", "removed", "copies", "copy", "node", "label", "hit_words", "contaminated", "__rate", "key", "row", "band", "text_crc32", "size", "rid", "word", "held_out", "score", "bundle", "drawn", "place")


def words(rng, n, size=300):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


def table(spark, kind):
    rng = random.Random(41)
    same = words(rng, 70)
    texts = [words(rng, 60 + i) for i in range(8)] + [same, same, None, "", " \n", "x" * 200_000, "ab+/" * 50_000, "é" * 100_000, words(rng, 8000)]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], None if i % 5 == 0 else len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[10], (None, same, "en", None, 3), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumns({c: F.lit(f"kept {c}") for c in CLASHING})


def bench(spark):
    return spark.createDataFrame([("i", "w1 w2 w3 " * 6), (None, None)], "item_id string, text string").withColumns({c: F.lit(1) for c in CLASHING[:4]})


def labels(spark, kind):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(9)] + [(None, 1, None)], "doc_id long, quality int, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))


def piece_path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


OPERATORS = {
    "mixing": lambda s, d, k: mixing.mix_copies(d),
    "tokens": lambda s, d, k: tokens.token_counts(d, piece_path("word_bpe_49k.json")),
    "quality_rules": lambda s, d, k: quality_rules.judge(d),
    "markov": lambda s, d, k: markov.score_texts(d),
    "language": lambda s, d, k: language.identify_languages(d, piece_path("piece_bpe_32k.model")),
    "secret_scan": lambda s, d, k: secret_scan.digest(secret_scan.scan_secrets(d)),
    "sharding": lambda s, d, k: sharding.shard_rows(d, 4),
    "decontam": lambda s, d, k: decontam.scan_documents(d, bench(s), ["doc_id"]),
    "quality_model": lambda s, d, k: quality_model.classify(d, labels(s, k)),
    "dedup": lambda s, d, k: dedup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_on_awkward_rows(spark, name):
    """Ids are strings here; the other tests have numbers."""
    d = table(spark, "string")
    out = OPERATORS[name](spark, d, "string")
    got = out.collect()
    assert out.schema["doc_id"].dataType.typeName() == "string"
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in d.collect())
    empty = OPERATORS[name](spark, d.limit(0), "string")
    assert empty.count() == 0 and empty.columns == out.columns


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", STAGES)
def test_stage_on_awkward_rows(spark, tmp_path, name):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    d = table(spark, "string")
    out = STAGES[name](spark, d, str(tmp_path))
    assert out.columns == d.columns + ["shard"] * (name == "shard")
    for r in out.collect():
        assert all(r[c] == f"kept {c}" for c in CLASHING)
    assert STAGES[name](spark, d.limit(0), str(tmp_path)).count() == 0


def test_empty_benchmark_and_repeated_runs(spark, tmp_path):
    d = table(spark, "long")
    assert decontam.drop_contaminated(d, bench(spark).limit(0)).count() == d.count()
    assert sorted(map(str, quality_rules.clean_documents(d).collect())) == sorted(map(str, quality_rules.clean_documents(d).collect()))
