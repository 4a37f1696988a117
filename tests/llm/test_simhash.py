"""SimHash: fingerprints and components against brute force, cells, edge rows."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from braidwork.llm import simhash as S


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(keys, fps, radius=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(fps))]


@pytest.mark.parametrize("cell", [5, 100_000])
def test_against_brute_force(spark, cell):
    rng = random.Random(1)
    vocabulary = ["Aa", "b", "cé", "dÉd", "e", "F"]
    texts = [None, "", " \n", "one", "ONE", "two words", "x\x0by\x0cz\rw"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for _ in range(150)]
    texts += [t + " tail" for t in texts[20:40]] + texts[30:50]
    keys = list(range(100, 100 + len(texts)))
    rng.shuffle(keys)
    keys[5] = None
    docs = spark.createDataFrame(list(zip(keys, texts, strict=True)), "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in S.components(docs, cell=cell).collect())
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted((k is None, k or 0, f, c) for k, f, c in zip(keys, fps, brute_components(keys, fps), strict=True))
    assert got == want


def test_stars_of_large_groups_in_tiles(monkeypatch):
    monkeypatch.setattr(S, "TILE", 8)
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = np.unique(np.array([s ^ (np.uint64(1) << np.uint64(rng.integers(64))) ^ (np.uint64(1) << np.uint64(rng.integers(64))) for s in seeds for _ in range(12)], np.uint64))
    u, v = S.group_stars(np.zeros(len(fp), np.int64), fp, 2)
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        root[find(a)] = find(b)
    whole = brute_components(list(range(len(fp))), [int(x) for x in fp])
    assert len({(find(int(x)), c) for x, c in zip(fp, whole, strict=True)}) == len(set(whole)) == len({find(int(x)) for x in fp})


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.components(docs).collect() == []
