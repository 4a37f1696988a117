"""Trees of vectors made in tiles, against those that see all pairs in one place."""

import numpy as np
import pytest

from braidwork.operators import kernels as K
from braidwork.operators import trees as T


def groups():
    rng = np.random.default_rng(7)
    e = rng.normal(size=(90, 16)).astype(np.float32)
    e[40:60] = e[:20]  # copies
    yield 1, e
    yield 2, rng.integers(0, 3, size=(70, 4)).astype(np.float32)  # equal distances, and copies
    yield 3, np.ones((9, 3), np.float32)
    yield 4, e[:1]
    yield None, e[:2] + np.float32(1000)
    yield 6, np.eye(40, dtype=np.float32)  # all pairs alike
    odd = e[:12].copy()
    odd[5, 2] = np.inf
    yield 7, odd


@pytest.mark.parametrize("block", [7, 1000])
def test_trees_of_tiles_are_those_of_all_pairs(spark, block):
    rows, want = [], set()
    for label, e in groups():
        ids = np.random.default_rng(len(e)).permutation(len(e)) * 3
        rows += [(int(i), v.tolist(), label) for i, v in zip(ids, e, strict=True)]
        by = np.argsort(ids)
        with np.errstate(invalid="ignore"):
            tree = K.spanning_tree(K.Distances(e[by]))
        want |= {(label, nth, int(ids[by][x]), None if p is None else int(ids[by][p])) for nth, (x, p) in enumerate(tree)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    made = T.spanning_trees(df, "label", "vec_id", "embedding", block)
    assert made.dtypes == [("label", "int"), ("nth", "bigint"), ("vec_id", "bigint"), ("parent", "bigint")]
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(rows) and set(got) == want


def test_tiles_leave_pairs_that_grow_with_the_points():
    x = np.random.default_rng(3).normal(size=(600, 64))
    a, b = T.tree_pairs(*T.squares(x)[:2], T.MOST)
    assert len(a) == len(b) == 599
    assert T.tree_pairs(*T.squares(np.eye(60))[:2], 8) is None


def test_spanning_trees_deals_pairs_over_tasks(spark, tmp_path):
    from braidwork.queries import registry

    rows = [(i, [float(i % 7), float(i * i % 11)], i % 2) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made = registry.QUERIES["spanning_trees"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert any("REPARTITION_BY_NUM" in x and "lo#" in x and "hi#" in x for x in plan.splitlines()) and made.count() == 60
