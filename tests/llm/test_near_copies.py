"""Near copies against brute force over exact five-word Jaccard similarity."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def brute(rows):
    """Keys that stay: the least of each component over all pairs with a Jaccard of 0.8 or more."""

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted(least.values())


def stays(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect())


def test_end_and_scattered_edits_near_the_bound(spark):
    rng, texts = random.Random(3), []
    for n in (10, 14, 25, 60, 150, 400):
        for _ in range(8):
            own = words(rng, n)
            texts.append(own)
            texts.append(own + words(rng, rng.randint(1, max(1, (n - 4) // 3))))
            texts.append(own[: n - rng.randint(1, max(1, n // 4))])
            other = list(own)
            for _ in range(rng.randint(1, max(1, n // 40))):
                other[rng.randrange(n)] = "edit"
            texts.append(other)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute(rows)
    assert 48 < len(want) < len(rows) - 40
    assert stays(spark, rows) == want


def test_many_near_copies_and_many_unlike_texts_on_one_passage(spark):
    """More texts on one shingle than the first rounds compare with all others."""
    rng = random.Random(4)
    base, passage = words(rng, 60), words(rng, 12)
    rows = []
    for _ in range(60):
        own = list(base)
        own[rng.randrange(60)] = words(rng, 1)[0]
        rows.append(" ".join(own))
    rows += [" ".join(passage + words(rng, rng.randint(1, 4))) for _ in range(40)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert stays(spark, rows) == brute(rows)


def test_short_texts_meet_across_ten_words(spark):
    rng, rows = random.Random(5), []
    for n in (3, 4, 5, 7, 8, 9, 10, 11):
        for _ in range(6):
            own = words(rng, n)
            rows += [" ".join(own), " ".join([*own, "more"]), " ".join(["other", *own[1:]])]
    rows = list(enumerate(rows))
    got = stays(spark, rows)
    assert got == brute(rows)
    assert sum(1 for k in got if k % 3 == 1) == 24  # a word more: 4 of 5 shingles and up are near copies


def test_the_prefilter_never_leaves_out_what_is_alike():
    import numpy as np

    from braidwork.llm import minhash as M
    from braidwork.llm import near_copies as N

    rng = np.random.default_rng(7)
    sets, kept = [], 0
    for n in (1, 4, 5, 9, 30, 64, 65, 80, 200, 1000, 4000):
        for _ in range(12):
            own = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            fresh = rng.integers(0, 1 << 64, max(1, n // int(rng.choice([3, 9, 10, 12, 40]))), dtype=np.uint64)
            sets += [own, np.unique(np.r_[own[len(fresh) if rng.random() < 0.5 else 0 :], fresh])]
    low, _ = M.low_bits(sets)
    packed = np.frombuffer(b"".join(N.packed_sets(sets, low)), np.uint8).reshape(-1, N.PACKED)
    size = np.array(list(map(len, sets)))
    x, y = np.array([(i, j) for i in range(len(sets)) for j in range(i)]).T
    may = N.may_be_alike(packed[x], packed[y], size[x], size[y])
    for i, j, ok in zip(x, y, may, strict=True):
        shared = len(np.intersect1d(sets[i], sets[j]))
        if 5 * shared >= 4 * (size[i] + size[j] - shared) and size[i] and size[j] and (size[i] > N.SMALL) == (size[j] > N.SMALL):
            assert ok
            kept += 1
    assert kept > 60 and may.sum() < 6 * kept + len(sets) * 12
