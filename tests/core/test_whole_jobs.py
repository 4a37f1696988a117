"""Queries hold the whole job: against brute force on small tables."""

from itertools import product

import pytest

from braidwork.operators import compare as C
from braidwork.operators import haplotypes as H
from braidwork.operators.kernels import edit_distance
from braidwork.queries import registry


def test_phase_search_takes_every_edit(spark, tmp_path):
    names = ["aaaaaaaaaaaa", "abababaaaaaa", "acccccccaaaa"]
    spark.createDataFrame([("b", n) for n in names], "p_brand string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    ref, *truth = names
    edits = [(i, 1, t[i]) for t in truth for i in range(len(ref)) if t[i] != ref[i]]
    assert 8 < len(edits) <= 12
    want = []
    for sides in product((0, 1), repeat=len(edits)):
        a, b = (H.spelled(ref, [e for e, s in zip(edits, sides, strict=True) if s == k]) for k in (0, 1))
        want.append(edit_distance(a, truth[0]) + edit_distance(b, truth[1]))
    got = registry.QUERIES["phase_search"](spark, str(tmp_path)).collect()
    assert [r.distance for r in got] == [min(want)]


def test_bootstrap_ratio_is_that_of_draws_with_return(spark):
    """Each draw's sums in plain arithmetic, and the interval near that of drawing as many rows with return."""
    import hashlib
    import math
    import random

    rng = random.Random(2)
    rows = [(g, rng.randint(1, 90), rng.randint(1, 9), i) for g in ("a", None) for i in range(400)] + [("zero", 5, 0, 1), ("none", None, None, 2)]
    df = spark.createDataFrame(rows, "g string, num long, den long, ident long")
    got = {r.g: r for r in C.bootstrap_ratio(df, "g", "num", "den", "ident").collect()}
    assert len(got) == 4 and got["zero"].ratio is None and got["none"].low is None

    def weight(ident, draw):
        m = hashlib.md5(f"7/{ident}".encode()).hexdigest()
        u = (pow(int(m[:7], 16) + draw * int(m[7:14], 16), 5, C.DRAW_PRIME) + 0.5) / C.DRAW_PRIME
        k, upto = 0, math.exp(-1)
        while u > upto:
            k += 1
            upto += math.exp(-1) / math.factorial(k)
        return k

    for g in ("a", None):
        own = [r for r in rows if r[0] == g]
        table = [[weight(r[3], d) for r in own] for d in range(1, 1001)]
        drawn = sorted(sum(w * r[1] for w, r in zip(ws, own, strict=True)) / sum(w * r[2] for w, r in zip(ws, own, strict=True)) for ws in table)
        assert (got[g].low, got[g].high) == pytest.approx((drawn[25], drawn[974]))
        again = []
        for _ in range(1000):
            s = rng.choices(own, k=len(own))
            again.append(sum(r[1] for r in s) / sum(r[2] for r in s))
        again.sort()
        assert got[g].high - got[g].low == pytest.approx(again[974] - again[25], rel=0.2)
        flat = [w for ws in table for w in ws]
        assert sum(flat) / len(flat) == pytest.approx(1, abs=0.01) and max(flat) > 6


def test_merging_until_stable_is_as_defined(spark):
    """Against a plain loop: merge the first two widened intervals that overlap, until none do."""
    import random

    from pyspark.sql import functions as F

    from braidwork.operators import walks as V

    rng = random.Random(3)
    rows = [(g, a := rng.randrange(400), a + rng.randrange(60)) for g in (1, 2, None) for _ in range(40)]

    def plain(own):
        wide = lambda x: (x[0], x[1] + (x[1] - x[0]) // 10)
        own = [(a, b, 1) for a, b in own]
        while True:
            hit = next(((i, j) for i in range(len(own)) for j in range(i) if wide(own[i])[0] < wide(own[j])[1] and wide(own[j])[0] < wide(own[i])[1]), None)
            if hit is None:
                return sorted(own)
            x, y = own.pop(hit[0]), own.pop(hit[1])
            own.append((min(x[0], y[0]), max(x[1], y[1]), x[2] + y[2]))

    df = spark.createDataFrame(rows, "g int, s long, e long")
    got = V.merge_until_stable(df, "g", (F.col("start"), F.col("end") + F.floor((F.col("end") - F.col("start")) / 10)), "s", "e").collect()
    for g in (1, 2, None):
        assert sorted((r.start, r.end, r.n) for r in got if r.g == g) == plain([r[1:] for r in rows if r[0] == g])


def test_unary_cycles_are_left_out_and_long_chains_end(spark):
    from braidwork.operators import graphs as G

    edges = [(1, 2), (2, 3), (3, 1), (10, 11), (11, 10), *((i, i + 1) for i in range(100, 1300))]
    got = {r.node: (r.head, r.nth) for r in G.unary_chains(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: (100, i - 100) for i in range(100, 1301)}


def test_more_rounds_than_tables_are_gathered(spark):
    from braidwork.operators import graphs as G

    edges = spark.createDataFrame([(i, i + 1) for i in range(25)], "src long, dst long")
    assert sorted(r.node for r in G.reachable(edges, edges.limit(0).selectExpr("src AS node").union(spark.createDataFrame([(3,)], "node long"))).collect()) == list(range(3, 26))
    assert {r.node: r.level for r in G.levels(edges).collect()} == {i: i for i in range(26)}
    with pytest.raises(RuntimeError):
        G.levels(edges.unionByName(spark.createDataFrame([(25, 20)], edges.schema))).collect()
    assert G.levels(edges.limit(0)).collect() == []


def test_rules_of_features_with_nulls(spark):
    from braidwork.operators import compare as C

    rows = [(None, 1.0, True), (1.0, None, False), (2.0, 5.0, True), (3.0, 1.0, False), (4.0, 6.0, True), (4.0, 0.0, False)] * 3
    df = spark.createDataFrame(rows, "a double, b double, pos boolean")
    over = lambda x, t: x is not None and x > t

    def balanced(hits):
        tp, tn = sum(h and r[2] for h, r in zip(hits, rows, strict=True)), sum(not h and not r[2] for h, r in zip(hits, rows, strict=True))
        return (tp / 9 + tn / 9) / 2

    for r in C.threshold_counts(df, "a", "pos").collect():
        hits = [over(x[0], r.cut) for x in rows]
        assert (r.tp + r.fn, r.fp + r.tn) == (9, 9)
        assert (r.tp / 9 + r.tn / 9) / 2 == balanced(hits)
    assert C.threshold_counts(df, "a", "pos").count() == 5
    mids = lambda v: [(x + y) / 2 for x, y in zip(v, v[1:], strict=False)]
    a, b = mids([1, 2, 3, 4]), mids([0, 1, 5, 6])
    best = max(balanced([f(over(r[0], x), over(r[1], y)) for r in rows]) for x in a for y in b for f in (lambda p, q: p and q, lambda p, q: p or q))
    alone = max(balanced([over(r[i], c) for r in rows]) for i in (0, 1) for c in (a, b)[i])
    got = C.two_feature_rule(df, "a", "b", "pos").first()
    assert got.balanced == max(alone, best if best >= alone + 0.02 else 0)


def test_short_reads_and_short_items(spark, tmp_path):
    from braidwork.operators import walks as V
    from braidwork.queries import graphs as Q

    reads = spark.createDataFrame([("a", "ACG"), ("b", "ACGTACGTAC"), ("e", "")], "read string, seq string")
    texts = spark.createDataFrame([("t", "TTACGTACGTACGG")], "text string, whole string")
    got = {(r.read, r.pos) for r in V.occurrences(reads, texts).where("NOT rev").collect()}
    assert got == {("a", 2), ("a", 6), ("a", 10), ("b", 2)}
    whole = ["one", "two words", "now three words", "a b c d e f g h i"]
    spark.createDataFrame(list(enumerate(whole)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = ["none here", "xone more", "some two wordsy", "xnow three wordsy", "za b c d e f g h iz", "a b c d e f g h", None, ""]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r.doc_id for r in Q.decontamination_guard(spark, str(tmp_path)).collect())
    assert got == [i for i, t in enumerate(docs) if any(w in (t or "") for w in whole)]


def test_reachability_makes_its_edges_once(spark):
    """A column that counts what is computed: each edge once, however many rounds there are."""
    from pyspark.sql import functions as F

    from braidwork.operators import graphs as G

    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long").select(F.udf(counted, "long")("a").alias("src"), F.col("b").alias("dst"))
    found = G.reachable(edges, spark.createDataFrame([(3,)], "node long"))
    assert sorted(r.node for r in found.collect()) == list(range(3, 13))
    assert made.value == 12


def test_levels_follow_walks_inside_ranges(spark, monkeypatch):
    """A chain of 300 nodes in few rounds; random graphs cut into many ranges, in the order of nodes and not; cycles in and between ranges."""
    import random

    import pytest

    from braidwork.operators import graphs as G

    rounds, plain = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, name: rounds.append(name) or plain(df, name))
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "src long, dst long")
    assert {r.node: r.level for r in G.levels(chain, 100).collect()} == {i: i for i in range(301)}
    assert rounds.count("levels") <= 5
    rng = random.Random(4)
    name = rng.sample(range(60), 60)
    for names in (list(range(60)), name):
        edges = {(names[a], names[b]) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a < b}
        want, at = {}, {n: i for i, n in enumerate(names)}
        for a, b in sorted(edges, key=lambda x: at[x[0]]):
            want[b] = max(want.get(b, 0), want.setdefault(a, 0) + 1)
        assert {r.node: r.level for r in G.levels(spark.createDataFrame(sorted(edges), "src long, dst long"), 20).collect()} == want
    for size, more in ((1000, (5, 3)), (10, (50, 3)), (30, (299, 0))):
        with pytest.raises(RuntimeError, match="cycle"):
            G.levels(chain.limit(60).unionByName(spark.createDataFrame([more, (59, 299)], chain.schema)), size).collect()


def test_bootstrap_draws_are_not_exploded(spark):
    """Numbers of draws by plain arithmetic, sums of great whole numbers exact; rows are not multiplied by draws."""
    import random

    import numpy as np

    rng = random.Random(6)
    key, step = ([rng.choice((0, 1, (1 << 28) - 1, rng.randrange(1 << 28))) for _ in range(300)] for _ in range(2))
    edges = C.poisson_edges()
    plain = lambda k, j, d: sum((pow(k + d * j, 5, C.DRAW_PRIME) / float(C.DRAW_PRIME) + 0.5 / C.DRAW_PRIME) > e for e in edges)
    made = C.drawn_weights(np.array(key), np.array(step), 500)
    assert made.tolist() == [[plain(k, j, d) for d in range(1, 501)] for k, j in zip(key, step, strict=True)]
    rows = [(i % 3, rng.randrange(-(1 << 55), 1 << 55), rng.random(), k, j) for i, (k, j) in enumerate(zip(key, step, strict=True))]
    got = C.drawn_sums(spark.createDataFrame(rows, "g int, num long, den double, k_ long, j_ long").coalesce(1), ["g"], "num", "den", 40).collect()
    assert len(got) == 120
    for r in got:
        own = [(x[1], x[2], int(made[i, r.draw - 1])) for i, x in enumerate(rows) if x[0] == r.g]
        assert r.n_ == sum(n * w for n, _, w in own) and abs(r.d_ - sum(d * w for _, d, w in own)) < 1e-9
    df = spark.createDataFrame([("a", 1, 2, 3)], "g string, num long, den long, ident long")
    assert "Generate" not in C.bootstrap_ratio(df, "g", "num", "den", "ident")._jdf.queryExecution().optimizedPlan().toString()


def long_names(spark, folder):
    """Two brands of names of up to 40 letters, some of them empty or null; and DuckDB with them as part."""
    import random

    import duckdb

    rng = random.Random(5)
    rows = [(k, f"b{k % 2}", "".join(rng.choice("acgt") for _ in range(rng.choice((0, 3, 14, 15, 29, 40))))) for k in range(24)] + [(24, "b0", None)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string").write.parquet(f"{folder}/part.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return [(k, b, n.upper()) for k, b, n in rows if n], duck


def test_blocks_reach_the_ends_of_names(spark, tmp_path):
    from collections import Counter

    rows, duck = long_names(spark, tmp_path)
    want = Counter()
    for b in ("b0", "b1"):
        own = [n for _, x, n in rows if x == b]
        ends = sorted({len(n) for n in own})
        for block, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False), 1):
            want.update((b, block, n[lo:hi]) for n in own if len(n) >= hi)
    made = registry.QUERIES["msa_blocks"](spark, str(tmp_path)).select("p_brand", "block", "seq", "n").collect()
    assert sorted(map(tuple, made)) == sorted((*k, n) for k, n in want.items())
    assert sorted(map(tuple, made)) == sorted(duck.sql(registry.ORACLES["msa_blocks"]).fetchall())


def test_position_pairs_reach_the_ends_of_names(spark, tmp_path):
    rows, duck = long_names(spark, tmp_path)
    want = []
    for b in ("b0", "b1"):
        own = [len(n) for _, x, n in rows if x == b]
        shared = [min(m, n) for i, m in enumerate(own) for n in own[:i]]  # names without gaps: position and column are one
        want.append((b, sum(shared), sum(i * i for n in shared for i in range(n))))
    made = registry.QUERIES["position_pairs"](spark, str(tmp_path)).select("p_brand", "n", "s").collect()
    assert sorted(map(tuple, made)) == want == sorted(duck.sql(registry.ORACLES["position_pairs"]).fetchall())
