"""Packing: the plan against its own placements, ids against the tokenizers library, edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("capacity", [1, 2, 10, 50, 2048])
def test_plan_places_each_item_once_without_gaps(capacity):
    rng = random.Random(capacity)
    for _ in range(40):
        counts = {s: rng.randint(1, 60) for s in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 150)))}
        bins, seen = {}, dict.fromkeys(counts, 0)
        for size, first, after, bin_, each, fill in packing.plan(counts, capacity):
            assert first == seen[size]
            seen[size] = after
            for rank in range(after - first):
                bins.setdefault(bin_ + rank // each, []).append((fill + rank % each * size, size))
        assert seen == counts
        for places in bins.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= capacity
            assert sum(3 * s > capacity for _, s in places) <= 2
        assert len(bins) <= 1 + max(1.25 * sum(s * n for s, n in counts.items()) / capacity, sum(n for s, n in counts.items() if 2 * s > capacity) * 1.25)


def test_ids_are_those_of_the_tokenizers_library():
    """Of all texts of sf0.01, and of texts that hold the vocabulary's own added word, long white space, other scripts."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.encoder(path)
    assert encoder.merge
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += ["", " ", "a  b", " a ", "it's we'll", "x\n\n y", "naïve çà 漢字 🙂", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext", "　x", " " * 5000 + "x", " " * 5000 + "<|endoftext|>", "ab1!" * 400]
    for i in range(0, len(texts), 256):
        for text, made in zip(texts[i : i + 256], tokenizer.encode_batch(texts[i : i + 256], add_special_tokens=False), strict=True):
            assert encoder.ids(text) == np.array(made.ids, dtype="<u4").tobytes()
    assert 50256 in np.frombuffer(encoder.ids("a <|endoftext|> b"), "<u4")


def test_cuts():
    assert packing.cuts(1, 10) == [(0, 1)]
    assert packing.cuts(10, 10) == [(0, 10)]
    assert packing.cuts(25, 10) == [(0, 5), (5, 10), (15, 10)]


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "abc"), (3, "word " * 3000), (3, "word " * 3000), (4, "same"), (5, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sequence_id", F.lit("clash")).withColumn("length", F.lit("clash"))
    got = packing.pack_documents(docs).collect()
    encoder = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for key, text in rows:
        ids = encoder.ids(text or "") + packing.END
        want += [(key, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])) for piece, (start, length) in enumerate(packing.cuts(len(ids) // 4, 2048))]
    by = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=by) == sorted(want, key=by)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_a_size_beyond_its_salts(spark, monkeypatch):
    monkeypatch.setattr(packing, "SALTED", 3)
    items = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(700).alias("length"), F.lit("x").alias("salt_"), F.lit("y").alias("p_size"), F.lit("z").alias("offset"))
    got = packing.pack(items).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000)) and {r.salt_ for r in got} == {"x"}
    assert len({(r.sequence_id, r.offset) for r in got}) == 1000 and {r.offset for r in got} == {0, 700}
    assert len({r.sequence_id for r in got}) == 500


def test_any_name_of_the_key(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, " " * 3000 + "x"), (3, " " * 3000 + "y")], "`doc id.` long, text string")
    got = packing.pack_documents(docs, key="doc id.").collect()
    encoder = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {}
    for r in got:
        sizes[r[0]] = sizes.get(r[0], 0) + r.length
    assert sizes == {1: 3, 2: len(encoder.ids(" " * 3000 + "x")) // 4 + 1, 3: len(encoder.ids(" " * 3000 + "y")) // 4 + 1}
