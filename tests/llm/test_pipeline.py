"""The pipeline's stages, each against a brute-force version on its own input."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tideline.llm import mixing, quality_rules

BLANKS = " \t\n\v\f\r"


def tokens(text):
    for b in BLANKS:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean texts, exact and near copies in chains, benchmark passages, short texts, a null text and an extra column."""
    rng = random.Random(11)

    def text(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    items = [text(20) for _ in range(4)]
    rows = [text(rng.randrange(80, 160)) for _ in range(40)]
    for i in range(6):  # chains: each differs in one word from the one before
        last = rows[i].split()
        for _ in range(3):
            last = list(last)
            last[rng.randrange(len(last))] = "changed"
            rows.append(" ".join(last))
    rows += rows[6:10] + [f"{text(60)} {items[0]} {text(20)}", f"{text(300)} {items[1][:60]}", "too short", "", None]
    path = str(tmp_path_factory.mktemp("pipeline"))
    documents = [(i, t, "en", f"s{i % 3}", len(t or ""), 7) for i, t in enumerate(rows)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, shard int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def survivors(rows):
    """Ids that are the least of their class: classes join texts whose sets of five words agree by 0.8 or more."""
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in rows if (w := tokens(r.text.lower())) is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(i) for i in sets})


def contaminated(text, items):
    words, hit = tokens(text), set()
    for item in items:
        for s in range(len(item) - 12):
            for i in range(len(words) - 12):
                if words[i : i + 13] == item[s : s + 13]:
                    hit |= set(range(i, i + 13))
    return bool(hit) and 20 * len(hit) >= len(words)


def test_stages_against_brute_force(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix_sources", "shard"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), f"test-{name}")
        assert docs.columns == inputs["quality"].columns
    rows = {n: d.collect() for n, d in inputs.items()}
    ids = {n: sorted(r.doc_id for r in x) for n, x in rows.items()}
    judged = quality_rules.judge(inputs["quality"]).collect()
    assert ids["near_dedup"] == sorted(r.doc_id for r in judged if r.kept)
    short = [r.doc_id for r in rows["quality"] if len(tokens(r.text or "")) < 50]
    assert len(short) == 3 and not set(short) & set(ids["near_dedup"])
    assert set(range(40)) <= set(ids["near_dedup"])  # clean documents stay
    assert ids["decontaminate"] == survivors(rows["near_dedup"])
    items = [tokens(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert ids["mix_sources"] == sorted(r.doc_id for r in rows["decontaminate"] if not contaminated(r.text, items))
    assert len(ids["mix_sources"]) < len(ids["decontaminate"])
    copies = {r.doc_id: r.copies for r in mixing.mix_copies(inputs["mix_sources"]).collect()}
    assert Counter(ids["shard"]) == Counter({i: n for i, n in copies.items() if n})
    final = docs.collect()
    assert Counter(r.doc_id for r in final) == Counter(ids["shard"])
    held = Counter()
    homes = {}
    for r in final:
        held[r.shard] += len(r.text.encode()) + 1
        homes.setdefault(r.text, set()).add(r.shard)
    assert all(len(s) == 1 for s in homes.values()) and set(held) <= set(range(16))
    largest = max(len(r.text.encode()) + 1 for r in final)
    assert max(held.values()) <= sum(held.values()) / 16 + 3 * largest  # a document lies there 3 times at most


def test_run_is_repeatable(spark, folder):
    a, b = (Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b and sum(a.values()) > 0
