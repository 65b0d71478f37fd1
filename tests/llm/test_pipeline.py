"""The pipeline's stages, each against brute force on what the one before it kept."""

import re
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests.llm.test_operators import brute_components, sample, text_of  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key string, kmer string, mixed string"


def repeated_bytes(rows, window=200):
    raws = [text_of(t).encode() for _, t in rows]
    seen = Counter(r[p : p + window] for r in raws for p in range(len(r) - window + 1))
    return [any(seen[r[p : p + window]] > 1 for p in range(len(r) - window + 1)) for r in raws]


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i, t, lang, "s", None if t is None else len(t), "clash", "clash", None) for i, t, lang, *_ in sample()]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "secrets", "packing"]

    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{d}/{i}_{name}"
        stage(spark, docs, d).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns
            kept.append([(r["doc_id"], r["text"]) for r in docs.collect()])
    good, single, cut, safe = kept
    # no labels, so no model: only documents without text go
    assert Counter(good) == Counter((r[0], r[1]) for r in rows if r[1])
    # one row of each component, of the least id; of rows that repeat it, one
    least = {c for _, _, c in brute_components([x for x in good if x[0] is not None])}
    assert Counter(i for i, _ in single) == Counter([None, *least]) and set(single) <= set(good)
    before, after = Counter(single), Counter(cut)
    for x, hit in zip(single, repeated_bytes(single), strict=True):
        assert hit or after[x] == before[x]
    repeated = next(x for x in good if x[0] == 3)
    assert good.count(repeated) == 2 and after[repeated] == 1  # the repeated row's text survives once
    assert sorted((x[0] is None, x[0] or 0) for x in cut) == sorted((x[0] is None, x[0] or 0) for x in single)
    assert not any(re.search(r"AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}|hunter2hunter2", text_of(t)) for _, t in safe)
    theirs = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, len(theirs.encode(text_of(t), add_special_tokens=False).ids) + 1) for i, t in safe)
    packed = docs.collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in packed} == set(want)
    assert sum(r["length"] for r in packed) == sum(n * k for (_, n), k in want.items())


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_workers_give_memory_back(spark):
    """Idle workers hold no caches of the stages that are over."""
    words = [f"word{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 60])) for i in range(300)], "doc_id long, text string").repartition(4)
    corpus_pipeline.packing(spark, docs, "").count()
    corpus_pipeline.near_duplicates(spark, docs, "").count()
    corpus_pipeline.repeated_passages(spark, docs, "").count()

    def held(batches):
        import time

        import pyarrow as pa

        from vanefold.llm import shingles, word_ids

        time.sleep(1)  # so that the tasks meet all idle workers of near_duplicates
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(shingles._hashes)], pa.int64()), pa.array([len(word_ids._held)], pa.int64())], names=["words", "tokenizers"])

    found = spark.range(0, 4, 1, 4).mapInArrow(held, "words long, tokenizers long").collect()
    assert len(found) == 4 and {(r["words"], r["tokenizers"]) for r in found} == {(0, 0)}
