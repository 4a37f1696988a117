"""Suffix dedup: the suffix sort against plain sorting, removal against brute force, blocks, edge rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import suffix_dedup as S


def brute(texts, width=S.WIDTH):
    raw = [(t or "").encode() for t in texts]
    n = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - width + 1):
            if n[r[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.r_[False, gone].astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rng, n=60):
    phrase = lambda k: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7))) for _ in range(k))
    passages = [phrase(rng.randint(30, 160)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [phrase(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.randint(0, 40) :] if rng.random() < 0.5 else p, phrase(rng.randint(0, 20))]
        texts.append("".join(parts))
    for t in rng.sample(texts, 12):  # near copies
        w = t.split(" ")
        if w:
            w[rng.randrange(len(w))] = "edit"
        texts.append(" ".join(w))
    texts += texts[:3] + [None, "", "short", "a" * 199, "a" * 200, "a" * 201, "b" * 700, "xyz" * 150, "q" * 200, "q" * 200]
    return texts


def test_suffix_sort_is_sorting():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    data[1000:1600] = data[:600]
    s = S.Suffixes(data, 64)
    start = rng.permutation(2900)[:1500]
    group = np.sort(rng.integers(0, 9, 1500))
    order = s.sort(start, group)
    raw = data.tobytes()
    keys = [(int(group[i]), raw[start[i] : start[i] + 64]) for i in order]
    assert keys == sorted(keys)
    assert sorted(order.tolist()) == list(range(1500))
    found, _, _ = s.repeated(start, group)
    n = Counter((int(g), raw[i : i + 64]) for i, g in zip(start, group, strict=True))
    assert [n[(int(g), raw[i : i + 64])] > 1 for i, g in zip(start, group, strict=True)] == found.tolist()


def test_anchors_over_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    bounds = np.array([0, 0, 150, 900, 901, 3000, 5000])
    whole = S.anchors(data, bounds)
    monkeypatch.setattr(S, "CHUNK", 333)
    parts = S.anchors(data, bounds)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    windows = sorted(i for lo, hi in zip(whole[1], whole[2], strict=True) for i in range(lo, hi + 1))
    assert windows == [i for a, b in zip(bounds, bounds[1:], strict=False) for i in range(a, b - S.WIDTH + 1)]


@pytest.mark.parametrize(("block", "common", "rows", "seed"), [(8192, 16, 4096, 1), (3, 16, 4096, 2), (3, 2, 7, 3), (8192, 3, 20, 4)])
def test_against_brute_force(spark, monkeypatch, block, common, rows, seed):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "COMMON", common)
    monkeypatch.setattr(S, "ROWS", rows)
    texts = corpus(random.Random(seed))
    keys = list(range(len(texts)))
    keys[4], keys[5], keys[6] = None, 3, 3
    docs = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string").repartition(5).withColumn("n_spans", F.lit("clash")).withColumn("h", F.lit(1.5))
    got = S.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    by = lambda r: (r[0] is None, *(x or 0 for x in r[:4]), r[4])
    assert sorted(map(tuple, got), key=by) == sorted(((k, *b) for k, b in zip(keys, brute(texts), strict=True)), key=by)


def test_colliding_anchor_hashes_change_nothing():
    """Different anchors under one hash stand in one group, where windows are compared by their bytes."""
    texts = corpus(random.Random(5), 25)
    raw = [(t or "").encode() for t in texts]
    data = b"".join(raw)
    place, lo, hi = S.anchors(np.frombuffer(data, np.uint8), np.cumsum([0, *map(len, raw)]))
    row = np.repeat(np.arange(len(lo)), hi - lo + 1)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
    start = lo[row] + nth
    group = place[row] - start  # all anchors as one
    by = np.argsort(group, kind="stable")
    found, _, _ = S.Suffixes(np.frombuffer(data, np.uint8)).repeated(start[by], group[by])
    n = Counter((int(g), data[i : i + S.WIDTH]) for g, i in zip(group, start, strict=True))
    assert found.tolist() == [n[int(g), data[i : i + S.WIDTH]] > 1 for g, i in zip(group[by], start[by], strict=True)]


def test_equal_prefix_hashes_are_verified(monkeypatch):
    """With hashes that always agree, neighbours count only where their bytes do."""
    monkeypatch.setattr(S, "prefix_hashes", lambda data, bits=64: np.zeros(len(data) + 1, np.uint64))
    data = np.frombuffer(b"abcdabceabcd", np.uint8)
    found, _, _ = S.Suffixes(data, 4).repeated(np.array([0, 4, 8]), np.zeros(3, np.int64))
    assert not found[1]


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_500_000))
    rows = [(1, long), (2, "x" + long[1_048_000:1_049_300] + "y"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("stretches", F.lit("own")).withColumn("row_key", F.lit("own"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in S.remove_repeats(docs).collect()}
    assert got == {1: (2_500_000, 1300, 1), 2: (1302, 1300, 1), 3: (0, 0, 0)}


def test_no_rows(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
