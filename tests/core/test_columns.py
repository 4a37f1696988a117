"""Columns: runs put back against a plain insertion, the cut of two alignments against trying all, pairs against sets of pairs."""

import random

from pyspark.sql import functions as F

from braidwork.operators import boundaries as B
from braidwork.operators import columns as C
from braidwork.operators import msa as M


def cells(spark, rows, g=0):
    return M.cells(spark.createDataFrame([(g, i, r) for i, r in enumerate(rows)], "g int, row int, aligned string"), "g", "row", "aligned")


def strings(c):
    out = {}
    for r in sorted(c.collect(), key=lambda r: (r.row, r.col)):
        assert r.col == len(out.get(r.row, ""))
        out[r.row] = out.get(r.row, "") + r.ch
    return [out[i] for i in sorted(out)]


def test_reinserted_rows_spell_and_columns_are_private(spark):
    rng = random.Random(3)
    frames, runs, want = [], [], {}
    for g in range(25):
        rows = ["".join(rng.choice("ACGT--") for _ in range(rng.randint(1, 1) * 12)) for _ in range(rng.randint(1, 5))]
        frames += [(g, i, r) for i, r in enumerate(rows)]
        for i, row in enumerate(rows):
            plain, out, last = row.replace("-", ""), [], 0
            for k, pos in enumerate(sorted({rng.randint(0, len(plain)) for _ in range(rng.randint(0, 3))})):
                run = "N" * rng.randint(1, 4)
                runs.append((g, i, k, pos, run))
                out.append(plain[last:pos] + run)
                last = pos
            want[g, i] = "".join([*out, plain[last:]])
    c = M.cells(spark.createDataFrame(frames, "g int, row int, aligned string"), "g", "row", "aligned")
    made = C.reinserted(c, "g", spark.createDataFrame(runs, "g int, row int, k int, pos int, run string")).cache()
    for g in range(25):
        rows = strings(made.where(F.col("g") == g).select("row", "col", "ch")) if g < 3 else None
        if rows:
            assert len({len(r) for r in rows}) == 1 and len(rows[0]) == 12 + sum(len(r[4]) for r in runs if r[0] == g)
    got = {}
    for r in sorted(made.collect(), key=lambda r: (r.g, r.row, r.col)):
        got.setdefault((r.g, r.row), []).append(r.ch)
    assert {k: "".join(v).replace("-", "") for k, v in got.items()} == want
    columns = {}
    for r in made.collect():
        columns.setdefault((r.g, r.col), []).append(r.ch)
    assert all(sum(x != "-" for x in col) == 1 for col in columns.values() if "N" in col)
    # by hand: a run at the begin stands before the first base, one behind a base directly behind it, the least row first
    hand = C.reinserted(cells(spark, ["-AC-G", "TT--A"]), "g", spark.createDataFrame([(0, 0, 0, 0, "N"), (0, 0, 1, 2, "NN"), (0, 1, 0, 3, "R")], "g int, row int, k int, pos int, run string"))
    assert strings(hand) == ["-NACNN-G-", "T-T----AR"]


def plain_cut(rows1, rows2, r, overlap):
    scores = lambda rows: [max(sum(x[i] != "-" for x in rows) - 1, 0) for i in range(len(rows[0]))]
    kept = lambda rows, n: sum([s for s, ch in zip(scores(rows), rows[r], strict=True) if ch != "-"][:n])
    n1, n2 = len(rows1[r].replace("-", "")), len(rows2[r].replace("-", ""))
    return max(range(overlap + 1), key=lambda cut: (kept(rows1, n1 - overlap + cut) + kept(rows2, n2 - cut), -cut))


def test_column_cuts(spark):
    rng = random.Random(7)
    cases = {0: (["ACGTACGT", "ACGTAC--", "ACGTAC--"], ["ACGTACGT", "AC------"], 0, 8), 1: (["ACGT"], ["ACGT"], 0, 4), 2: (["AAAACCCCGG", "AAAACCCCGG"], ["AACCCCGGGG", "----------"], 0, 6)}
    for g in range(3, 60):
        n = rng.randint(1, 4)
        rows = [["".join("-" if rng.random() < p else rng.choice("ACGT") for _ in range(10)) for _ in range(n)] for p in (0.2, 0.4)]
        r = rng.randrange(n)
        least = min(len(x[r].replace("-", "")) for x in rows)
        if least:
            cases[g] = (*rows, r, rng.randint(1, least))
    frame = lambda at: M.cells(spark.createDataFrame([(g, i, r) for g, case in cases.items() for i, r in enumerate(case[at])], "g int, row int, aligned string"), "g", "row", "aligned")
    a, b = frame(0), frame(1)
    cuts = C.column_cuts(a, b, "g", spark.createDataFrame([(g, c[2], c[2], c[3]) for g, c in cases.items()], "g int, row_a int, row_b int, overlap int")).collect()
    assert {r.g: r.cut for r in cuts} == {g: plain_cut(*c) for g, c in cases.items()}
    assert {r.g: r.cut for r in cuts if r.g < 3} == {0: 6, 1: 0, 2: 6}
    first = next(r for r in cuts if r.g == 0)
    kept = C.kept_begin(a.where("g = 0"), "g", spark.createDataFrame([(0, 0, first.keep_a)], "g int, row int, keep int"))
    assert strings(kept) == ["ACGTAC--", "ACGTAC--", "ACGTAC--"]


def test_implied_pairs(spark):
    rng = random.Random(4)
    truth, test = ([(g, p, i, rng.randrange(6)) for g in (1, 2) for p in range(4) for i in range(8) if rng.random() < 0.9] for _ in range(2))

    def pairs(rows, g):
        return {((p, i), (q, j)) for h, p, i, x in rows for k, q, j, y in rows if h == k == g and p < q and x == y}

    got = C.implied_pairs(*(spark.createDataFrame(r, "g int, path int, pos int, place int") for r in (truth, test)), "g").collect()
    for r in got:
        a, b = pairs(truth, r.g), pairs(test, r.g)
        assert (r.true_pairs, r.test_pairs, r.shared) == (len(a), len(b), len(a & b)) and abs(r.recall - len(a & b) / len(a)) < 1e-12
    assert len(got) == 2


def test_boundaries_at_ends_and_with_twice_the_window(spark):
    """Nodes of 10 bases; 1 and 9 are walked by all, the others by one less; 5 twice by one walk."""
    reference = spark.createDataFrame([("c", n, n * 10, n * 10 + 10) for n in range(12)], "contig string, node int, start long, end long")
    visits = spark.createDataFrame([(p, n) for p in range(3) for n in range(12) if p or n in (1, 9)] + [(2, 5)], "path int, node int")
    nodes = B.eligible_nodes(reference, B.coverage(visits), spark.createDataFrame([("c", 91, 91)], "contig string, pos long, stop long"))
    assert {r.node: (r.cov, r.eligible) for r in nodes.collect()} == {n: (3 if n in (1, 9, 5) else 2, n not in (5, 9)) for n in range(12)}
    lengths = spark.createDataFrame([("c", 120)], "contig string, length long")
    regions = spark.createDataFrame([(1, "c", 30, 40), (2, "c", 75, 78)], "region int, contig string, a0 long, b0 long")
    got = {r.region: tuple(r)[1:] for r in B.boundaries(regions, nodes, lengths, 20, 80).collect()}
    assert got == {1: (80, 1, 11, 3, False, True), 2: (80, 1, 11, 3, False, True)}
    assert {r.region: (r.left, r.right, r.width) for r in B.boundaries(regions, nodes, lengths, 20, 80, fallback=True).collect()} == {1: (1, 4, 20), 2: (6, 8, 20)}
    assert B.boundaries(regions.limit(0), nodes, lengths).collect() == []
