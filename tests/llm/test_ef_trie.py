"""The trie against plain search and dictionaries; scores against brute force; edge rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import ef_trie as E


def test_monotone_sequences():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (1, 1), (1, 1 << 64), (7, 3), (500, 1 << 20), (3000, 1 << 50), (3000, 1 << 64)):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=False) if top < 1 << 64 else rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
        ef = E.EliasFano(n, *E.EliasFano.arrays(values, top))
        assert (ef.get(np.arange(n)) == values).all()
        x = np.concatenate([values, rng.integers(0, max(1, min(top, (1 << 64) - 1)), 300, dtype=np.uint64)])
        assert (ef.successor(x) == np.searchsorted(values, x)).all()
        assert ((ef.find(x) >= 0) == np.isin(x, values)).all()


def brute(texts, held, mass=E.MASS):
    tokens = [[w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))] + [None] for t in texts]
    train = [t for t, h in zip(tokens, held, strict=True) if not h]
    uni = Counter(w for t in train for w in t)
    contexts = Counter(u for t in train for u in ["", *t[:-1]])
    pairs = Counter((u, w) for t in train for u, w in zip(["", *t[:-1]], t, strict=True))
    n, v = uni.total(), len(uni)
    out = []
    for t in tokens:
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10((pairs[u, w] + mass * (uni[w] + 1) / (n + v + 1)) / (contexts[u] + mass)) for u, w in zip(["", *t[:-1]], t, strict=True))
        out.append((len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize("limits", [(12 << 20, 4096), (200, 3)])
def test_scores(spark, monkeypatch, limits):
    monkeypatch.setattr(E, "CHUNK_BYTES", limits[0])
    monkeypatch.setattr(E, "CHUNK_DOCS", limits[1])
    rng = random.Random(6)
    words = ["the"] * 20 + ["A", "a", "bé", "É", "c-d", "eee", "f"]
    texts = [None, "", "  ", "Once unseen"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(80)]
    held = [i % 7 == 2 for i in range(len(texts))]
    keys = [*range(len(texts))]
    keys[8], keys[9], keys[10] = None, 3, 3
    docs = spark.createDataFrame(list(zip(keys, texts, held, strict=True)), "doc_id long, text string, held_out boolean").withColumn("score", F.lit("clash")).repartition(3)
    got = sorted(map(tuple, E.fit_score(docs).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    want = sorted(((k, h, *b) for k, h, b in zip(keys, held, brute(texts, held), strict=True)), key=lambda r: (r[0] is None, r[0] or 0, r[5]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], abs=1e-9)
        assert g[6] == pytest.approx(w[6], abs=0.0006 * w[2])


def test_counts_beyond_32_bits():
    words, many = np.array([3, 9], np.uint64), 1 << 33
    trie = E.Trie.mapped(E.Trie.build(words, np.array([many, 1]), np.array([0, 1]), np.array([4, 5], np.uint64), np.array([many, 1]), many + 1, 2, 3.0))
    count, top = trie.lookup(words, np.array([4, 5], np.uint64), many + 1, 2, 3.0)
    assert count.tolist() == [many, 1]
    assert top[0] == pytest.approx(math.log10(many + 3), abs=0.0003)


def test_packed_numbers():
    a = np.array([0, 1, 254, 255, 256, 1 << 40, 7])
    p = E.Packed(E.Packed().put_small(a).put_twelve(a[:3]).put_bytes(a.astype(np.uint64), 5).put_small(a[:0]).put_twelve(a[[0, 2]]).bytes())
    assert (p.take_small(7) == a).all() and p.take_twelve(3).tolist() == [0, 1, 254]
    assert p.take_bytes(7, 5).tolist() == [x % (1 << 40) for x in a.tolist()]
    assert len(p.take_small(0)) == 0 and p.take_twelve(2).tolist() == [0, 254]


def test_a_kept_model_scores_as_it_was_fitted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "CHUNK_DOCS", 5)
    rng = random.Random(9)
    texts = [" ".join(rng.choice("a b c the the the d e".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "B " * 700_000 + "never"]
    docs = spark.createDataFrame([(i, t, i % 7 == 2) for i, t in enumerate(texts)], "doc_id long, text string, held_out boolean").repartition(4)
    want = {r.doc_id: tuple(r) for r in E.fit_score(docs).collect()}
    E.fit(docs.where("NOT held_out"), str(tmp_path / "model"))
    got = {r.doc_id: tuple(r) for r in E.Model(spark, str(tmp_path / "model")).score(docs).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:5] == want[k][:5]
        assert got[k][5:] == pytest.approx(want[k][5:], rel=1e-9)
    assert E.Model(spark, str(tmp_path / "model")).score(docs.limit(0)).collect() == []


def test_file_round_trip(tmp_path):
    words = np.array([3, 9, 1 << 60], np.uint64)
    raw = E.Trie.build(words, np.array([2, 1, 5]), np.array([0, 0, 2]), np.array([4, 7, 1], np.uint64), np.array([1, 1, 3]), 8, 3, 3.0)
    path = tmp_path / "trie"
    path.write_bytes(raw)
    for trie in (E.Trie.open(str(path)), E.Trie.mapped(raw)):
        count, top = trie.lookup(np.array([3, 3, 9, 1 << 60, 5], np.uint64), np.array([4, 5, 4, 1, 1], np.uint64), 8, 3, 3.0)
        assert count.tolist() == [2, 2, 1, 5, 0]
        q = lambda c: (c + 1) / 12
        assert top == pytest.approx([math.log10(1 + 3 * q(2)), math.log10(3 * q(2)), math.log10(3 * q(1)), math.log10(3 + 3 * q(5)), math.log10(3 * q(0))], abs=0.0003)


def test_no_rows_and_no_training(spark):
    docs = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    assert E.fit_score(docs.limit(0)).collect() == []
    r = E.fit_score(docs).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
