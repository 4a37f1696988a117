"""The pipeline: its stages one by one, edge rows, and the whole of it on the smallest tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
from braidwork.llm import rule_ensemble  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long = [text(400) for _ in range(20)]
    edited = [" ".join("edit" if i == 7 else w for i, w in enumerate(t.split())) for t in long]
    rows = [*enumerate(long), *((100 + i, t) for i, t in enumerate(long)), *((200 + i, t) for i, t in enumerate(edited)), *((300 + i, text(4)) for i in range(40))]
    rows += [(None, long[0]), (None, "alone here without a key"), (None, "alone here without a key"), (5, long[5]), (400, None), (401, "")]
    docs = spark.createDataFrame([(k, t, "en", None, len(t or "")) for k, t in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, docs, "").collect()]
    want = [*enumerate(long), *(r for r in rows if r[0] and 300 <= r[0] < 340), (None, "alone here without a key"), (400, None)]
    assert Counter(got) == Counter(want)
    assert pipeline.near_dedup(spark, docs.limit(0), "").collect() == []


def test_cutting_and_mixing_keep_columns(spark):
    passage = "é".join(str(i) for i in range(120))
    rows = [(1, passage + " one", "en", "a", 3), (2, "two " + passage, "en", "a", 3), (3, None, None, None, None), (4, "plain", "en", "b", 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    cut = {r.doc_id: r for r in pipeline.cut_repeats(spark, docs, "").collect()}
    assert {k: r.text for k, r in cut.items()} == {1: " one", 2: "two ", 3: "", 4: "plain"}
    assert cut[1].n_chars == 4
    mixed = pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    assert set(Counter(r.doc_id for r in mixed.collect()).values()) <= {1, 2, 3}


def test_clashing_columns_and_no_rows(spark):
    names = ["kept", "n_bytes", "stretches", "row_key", "Score", "predicted", "size", "n_copies", "nth", "label_", "id", "component"]
    rows = [(i, f"document number {i} has some words of its own {i * i}", "en", "a", 9) for i in range(12)] + [(None, None, None, None, None)] * 2
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in names:
        docs = docs.withColumn(name, F.lit("own"))
    labels = "/root/testdata/sf0.001"
    for name, stage in pipeline.STAGES[:-1]:
        made = stage(spark, docs, labels)
        assert made.columns == docs.columns, name
        assert {tuple(r)[5:] for r in made.collect()} <= {("own",) * len(names)}, name
        assert stage(spark, docs.limit(0), labels).collect() == [], name
    assert len(pipeline.pack(spark, docs, labels).collect()) == len(rows)
    assert pipeline.pack(spark, docs.limit(0), labels).collect() == []


def test_whole_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {r.doc_id for r in pipeline.classify(spark, docs, d).collect()}
    labels = {r.doc_id: r.quality for r in rule_ensemble.training_labels(spark.read.parquet(f"{d}/labels.parquet")).collect()}
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in kept for k in good) > 0.9 * len(good)
    packed = pipeline.run(spark, d).collect()
    assert {r.doc_id for r in packed} <= kept
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
