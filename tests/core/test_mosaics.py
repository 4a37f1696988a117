"""Mosaics of walks against trying every panel walk at every step."""

import random

from braidwork.operators import paths as P

KINDS = ["sample", "partial", "ref_a", "ref_b"]


def plainly(walk, panel):
    same = [k for k, w in panel if w == walk and k != "partial"]
    if "sample" in same:
        label = "verbatim"
    elif same:
        label = "copy_of_" + min(same, key=KINDS.index)
    else:
        label = None
    pieces, at = [], 0
    while at < len(walk):
        longest = {}
        for kind, other in panel:
            for p in range(len(other)):
                n = next((n for n in range(len(walk) - at, 0, -1) if other[p : p + n] == walk[at : at + n]), 0)
                longest[kind] = max(longest.get(kind, 0), n)
        n = max(longest.values(), default=0)
        kind = next(k for k in KINDS if longest.get(k) == n) if n else "novel"
        pieces.append((at, at + max(n, 1) - 1, kind))
        at += max(n, 1)
    kinds = [k for *_, k in pieces]
    if label is None:
        label = ("junction" if len(kinds) == 2 else f"mosaic_{len(kinds)}") if set(kinds) == {"sample"} else f"mixed({'+'.join(kinds)})"
    return label, pieces, kinds.count("novel")


def test_mosaics(spark):
    rng = random.Random(5)
    walks, panel, want = [], [], {}
    for g in range(12):
        letters = range(rng.choice([3, 6, 12]))
        own = [(rng.choice(KINDS), [rng.choice(letters) for _ in range(rng.randint(1, 8))]) for _ in range(rng.randint(0, 5))]
        panel += [(g, i, kind, p, x) for i, (kind, w) in enumerate(own) for p, x in enumerate(w)]
        for i in range(6):
            walk = list(rng.choice(own)[1]) if own and rng.random() < 0.4 else [rng.choice(letters) for _ in range(rng.randint(1, 9))]
            walks += [(g, i, p, x) for p, x in enumerate(walk)]
            want[g, i] = plainly(walk, own)
    made = P.mosaics(spark.createDataFrame(walks, "g int, walk int, step int, node int"), spark.createDataFrame(panel, "g int, panel int, kind string, step int, node int"), KINDS, "g").collect()
    assert {(r.g, r.walk): (r.label, [tuple(p) for p in r.pieces], r.novel) for r in made} == want
    assert {x[0].split("(")[0].rstrip("0123456789") for x in want.values()} >= {"verbatim", "junction", "mosaic_", "mixed"}


def test_single_steps_are_not_paired(spark, tmp_path):
    """300 walks and 300 panel walks that share one node only: no row a pair of them."""
    rows = [(w, i, 0 if i == 1 else 1000 * w + i + 1) for w in range(600) for i in range(3)]
    steps = spark.createDataFrame(rows, "w int, step int, node int")
    walks, panel = steps.where("w % 2 = 0").withColumnRenamed("w", "walk"), steps.where("w % 2 = 1").selectExpr("w AS panel", "IF(w = 301, 'ref_a', 'ref_b') AS kind", "step", "node")
    made, seen = [], P.extensions
    P.extensions = lambda *a: made.append(seen(*a)) or made[-1]
    try:
        got = P.mosaics(walks, panel, KINDS).collect()
    finally:
        P.extensions = seen
    assert made[0].count() == 0 and len(got) == 300
    assert {(r.label, r.novel) for r in got} == {("mixed(novel+ref_a+novel)", 2)}
