"""Medoids of groups whose points are dealt over tasks, against those of groups in one place."""

import numpy as np

from braidwork.operators import kernels as K
from braidwork.operators import medoids as D


def groups():
    rng = np.random.default_rng(9)
    e = rng.normal(size=(400, 16)).astype(np.float32)
    e[200:260] = e[:60]  # copies
    yield 1, e
    yield None, (rng.normal(size=(150, 3)) + rng.integers(0, 4, size=(150, 1)) * 9).astype(np.float32)  # clusters
    yield 3, np.ones((90, 3), np.float32)
    yield 4, rng.permutation(np.repeat(rng.normal(size=(3, 5)), 30, 0)).astype(np.float32)  # fewer vectors than medoids
    yield 5, e[:20]
    yield 6, e[:3]
    odd = e[:80].copy()
    odd[5, 2] = np.inf
    yield 7, odd


def test_medoids_of_dealt_points_are_those_of_all_in_one_place(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 32)
    monkeypatch.setattr(D, "SHORT", 16)
    monkeypatch.setattr(D, "LONG", 50)
    rows, want = [], set()
    for label, e in groups():
        ids = np.random.default_rng(len(e)).permutation(len(e)) * 3
        rows += [(int(i), v.tolist(), label) for i, v in zip(ids, e, strict=True)]
        by = np.argsort(ids)
        with np.errstate(invalid="ignore"):
            chosen, cluster = K.kmedoids(K.Distances(e[by]), 4)
        want |= {(label, int(i), int(ids[by][chosen[c]])) for i, c in zip(ids[by], cluster, strict=True)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for small in (25, D.SMALL):
        made = D.kmedoids(df, "label", "vec_id", "embedding", 4, small)
        assert made.dtypes == [("label", "int"), ("vec_id", "bigint"), ("medoid", "bigint")]
        got = [tuple(r) for r in made.collect()]
        assert len(got) == len(rows) and set(got) == want
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert ("Scan parquet" in plan) == (small == 25) and any("Exchange hashpartitioning(label" in x and "REPARTITION_BY_NUM" in x for x in plan.splitlines())


def test_sums_of_products_are_off_by_what_they_say():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64)) + 50
    x[:40] = x[40:80] + 1e-9
    for tried in (x[:30], x[100:103], x[299:] + 4):
        now, sums, off = D.swap_sums(x, x[[7, 90]], tried, False)
        exact_now, exact, zero = D.swap_sums(x, x[[7, 90]], tried, True)
        assert now == exact_now and zero == 0 and abs(sums - exact).max() <= off + 1e-12 and off < 1e-6


def test_medoids_of_integer_points_are_those_of_all_pairs():
    """Equal distances and sums, where products of matrices must not decide."""
    for seed in range(30):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 4, size=(rng.integers(6, 80), 2)).astype(float) + 1000
        s = D.stretchwise(D.Held(x), {0: len(x)}, 4)[0]
        chosen, cluster = K.kmedoids(K.Distances(x), 4)
        assert s.chosen == chosen and D.apart(s.vectors, x).argmin(0).tolist() == cluster
