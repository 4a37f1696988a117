"""Connected components against union-find."""

import random

from braidwork.operators.components import connected_components


def brute(edges):
    root = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in root)


def test_random_graphs_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(70)]  # a chain
    edges += [(5000, 5001 + i) for i in range(50)]  # a hub
    edges += [(6000, 6000), (6000, 6000), (None, 3), (7, None)]
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert sorted(map(tuple, got.collect())) == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_forest_keeps_components_with_fewer_edges(spark):
    from braidwork.operators.components import forest

    rng = random.Random(9)
    edges = [(100 * g + rng.randrange(40), 100 * g + rng.randrange(40)) for g in range(12) for _ in range(300)] + [(5000, 5000), (None, 3), (7, None)]
    made = [tuple(r) for r in forest(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert brute(made) == brute(edges) and len(made) < len(edges) / 3
