"""Fingerprints: estimates against exact Jaccard similarity, successors against plain Python, edge rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import minhash as M


def shingles(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_estimates():
    rng = random.Random(2)
    errors = []
    for n in (3, 20, 150, 3000):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = [str(rng.random()) for _ in range(n)]
            b = a[: int(n * share)] + [str(rng.random()) for _ in range(n - int(n * share))]
            a, b = " ".join(a), " ".join(b)
            s, some = M.sketches([a, b])
            got = float(M.likeness(s[:1], s[1:], some[:1], some[1:])[0])
            errors.append(abs(got - jaccard(a, b)))
            if a == b:
                assert got == 1.0
    assert max(errors) < 0.15
    assert sum(errors) / len(errors) < 0.03
    assert (M.unpacked(M.packed(s)[0]) == s[0]).all()


@pytest.mark.parametrize("n", [1, 2, 700])
def test_successors(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(10**6) * 2, None if i % 90 == 7 else " ".join(rng.choice(["é", "bb", "🙂c", "d\n"]) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    if n > 2:
        rows += [(rows[0][0], "tie"), (rows[0][0], "tie"), (None, "null key"), (None, "another")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash")).withColumn("guest", F.lit(7))
    got = [tuple(r) for r in M.with_successors(docs).collect()]
    order = sorted(((k, t or "") for k, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    want = []
    for (k, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        s, some = M.sketches([t, changed, after])
        f = M.packed(s)
        near = [float(M.likeness(s[:1], s[i : i + 1], some[:1], some[i : i + 1])[0]) for i in (1, 2)]
        want.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), f[0], f[1], *near))
    by = lambda r: (r[0] is None, *((x is None, x if x is not None else 0) for x in r))
    assert sorted(got, key=by) == sorted(want, key=by)


def test_empty_and_long(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.with_successors(docs).collect() == []
    assert M.fingerprints(docs).collect() == []
    assert len(M.word_hashes("word " * 400_000)) == 400_000
    assert (M.word_hashes("a b\x0bc " * 200_000)[:3] == M.word_hashes("a b\tc")).all()
    low, some = M.sketches(["", "  "])
    assert not some.any()
    assert np.all(low == 0)
