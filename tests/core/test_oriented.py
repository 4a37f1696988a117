"""Oriented chains against a plain walk from side to side, what walks spell before and after, merges of one strand."""

import random

from pyspark.sql import functions as F

from braidwork.operators import graphs as G
from braidwork.operators import oriented as O

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def flipped(seq):
    return seq.translate(COMPLEMENT)[::-1]


def random_graph(seed, n=30, walks=8):
    rng = random.Random(seed)
    nodes = {i: "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 4))) for i in range(1, n + 1)}
    paths = {}
    chain = [(i, rng.random() < 0.4) for i in rng.sample(sorted(nodes), n)]  # long common runs, so that there is something to merge
    for p in range(walks):
        a = rng.randrange(n)
        b = rng.randint(a + 1, n)
        walk = chain[a:b]
        if rng.random() < 0.3:
            walk = walk + [(rng.choice(sorted(nodes)), rng.random() < 0.5)]
        paths[p] = walk if rng.random() < 0.5 else [(x, not r) for x, r in reversed(walk)]
    edges = {(a, ar, b, br) for w in paths.values() for (a, ar), (b, br) in zip(w, w[1:], strict=False)}
    if seed % 3 == 0:  # a cycle and a node's edges to itself
        edges |= {(100, False, 101, True), (101, True, 102, False), (102, False, 100, False), (103, False, 103, False), (104, False, 104, True)}
        nodes |= {i: "AC" for i in range(100, 105)}
    return nodes, edges, paths


def plainly(nodes, edges, paths, same_strand):
    """node: (head, nth, rev, last)."""
    met = {}
    for a, ar, b, br in edges:
        s, t = (a, not ar), (b, br)
        met.setdefault(s, set()).add(t)
        met.setdefault(t, set()).add(s)
    ends = {(w[0][0], w[0][1]) for w in paths.values()} | {(w[-1][0], not w[-1][1]) for w in paths.values()}
    joined = {}
    for s, others in met.items():
        if len(others) == 1 and s not in ends:
            (t,) = others
            if len(met[t]) == 1 and t not in ends and t[0] != s[0] and (not same_strand or s[1] != t[1]):
                joined[s] = t
    ways = {}
    for node in nodes:
        for rev in (False, True):
            if (node, rev) not in joined:  # nothing behind: a chain begins
                way, at = [], (node, rev)
                while True:
                    way.append(at)
                    out = joined.get((at[0], not at[1]))
                    if out is None:
                        break
                    at = (out[0], out[1])
                for nth, (x, r) in enumerate(way):
                    ways.setdefault(x, []).append(((rev, node, r), node, nth, r, len(way) - 1))
    found = {x: min(w)[1:] for x, w in ways.items()}
    return {x: found.get(x, (x, 0, False, 0)) for x in nodes}


def frames(spark, nodes, edges, paths):
    return (
        spark.createDataFrame(sorted(nodes.items()), "node long, seq string"),
        spark.createDataFrame(sorted(edges), "src long, src_rev boolean, dst long, dst_rev boolean"),
        spark.createDataFrame([(p, i, x, r) for p, w in paths.items() for i, (x, r) in enumerate(w)], "path long, step long, node long, rev boolean"),
    )


def test_chains_nodes_edges_and_walks(spark):
    merged_any = 0
    for seed in range(4):
        nodes, edges, paths = random_graph(seed)
        n, e, w = frames(spark, nodes, edges, paths)
        for same_strand in (False, True) if seed == 0 else (False,):
            chains = O.oriented_chains(n, e, O.walk_ends(w), same_strand).cache()
            got = {r.node: (r.head, r.nth, r.rev, r["last"]) for r in chains.collect()}
            assert got == plainly(nodes, edges, paths, same_strand)
            merged_any += any(x[3] for x in got.values())
            if same_strand:
                assert not any(r for _, _, r, _ in got.values())
        seqs = {r.node: r.seq for r in O.merged_nodes(n, chains).collect()}
        assert sum(map(len, seqs.values())) == sum(map(len, nodes.values()))
        walked = {}
        for r in sorted(O.merged_walks(w, chains).collect(), key=lambda r: (r.path, r.step)):
            assert r.step == len(walked.get(r.path, [])) + 1
            walked.setdefault(r.path, []).append((r.node, r.rev))
        spell = lambda seqs, way: "".join(flipped(seqs[x]) if r else seqs[x] for x, r in way)
        assert {p: spell(seqs, way) for p, way in walked.items()} == {p: spell(nodes, way) for p, way in paths.items()}
        new = {tuple(r) for r in O.merged_edges(e, chains).collect()}
        canonical = lambda a, ar, b, br: min((a, ar, b, br), (b, not br, a, not ar))
        inside = {canonical(*x, *y) for way in walked.values() for x, y in zip(way, way[1:], strict=False)}
        assert inside <= {canonical(*x) for x in new}
        chains.unpersist()
    assert merged_any


def test_one_strand_keeps_the_first_id_and_edges_of_flipped_handles(spark):
    """a+ b+ c+ in a row, then c+ to d- and back: a, b, c are one node named a."""
    n, e, w = frames(spark, {5: "A", 3: "CC", 4: "G", 9: "TA", 8: "T"}, {(5, False, 3, False), (4, True, 3, True), (4, False, 9, True), (8, False, 5, False), (9, False, 5, False)}, {1: [(8, False), (5, False)], 2: [(9, False), (5, False)]})
    chains = O.oriented_chains(n, e, None, True)
    assert {r.node: (r.head, r.nth) for r in chains.collect()} == {5: (5, 0), 3: (5, 1), 4: (5, 2), 9: (9, 0), 8: (8, 0)}
    assert {r.node: r.seq for r in O.merged_nodes(n, chains).collect()}[5] == "ACCG"
    assert {tuple(r) for r in O.merged_edges(e, chains).collect()} == {(5, False, 9, True), (8, False, 5, False), (9, False, 5, False)}
    assert G.spelled(O.merged_walks(w, chains).where("false"), n, "path", "step").collect() == []
    assert O.oriented_chains(n.limit(0), e.limit(0)).collect() == []
    assert [tuple(r) for r in O.oriented_chains(n.where(F.col("node") == 8), e.limit(0)).collect()] == [(8, 8, 0, False, 0)]


def test_joins_near_each_other_are_merged_in_their_task(spark, monkeypatch):
    """What near says never changes the chains; where all of a chain is near, no round between tasks is left."""
    for seed in (0, 1, 5):
        nodes, edges, paths = random_graph(seed)
        n, e, w = frames(spark, nodes, edges, paths)
        for near in (F.lit(7), (F.least("src", "dst") % 3).cast("int"), F.hash("src")):
            got = {r.node: (r.head, r.nth, r.rev, r["last"]) for r in O.oriented_chains(n, e.withColumn("near", near), O.walk_ends(w)).collect()}
            assert got == plainly(nodes, edges, paths, False)
    made, write = [], O.materialize
    monkeypatch.setattr(O, "materialize", lambda df, name: made.append(name) or write(df, name))
    n = spark.range(1, 61).selectExpr("id AS node")
    e = spark.range(1, 60).selectExpr("id AS src", "false AS src_rev", "id + 1 AS dst", "false AS dst_rev", "int(id div 100) AS near")
    assert {(r.node, r.head, r.nth, r["last"]) for r in O.oriented_chains(n, e).collect()} == {(i, 1, i - 1, 59) for i in range(1, 61)}
    assert made == ["runs"]


def test_a_task_merges_some_nears_at_a_time(monkeypatch):
    import pyarrow as pa

    rows = [{"near": k, "a": 10 * k + i, "a_right": True, "b": 10 * k + i + 1, "b_right": False, "a_open": False, "b_open": False} for k in range(4) for i in range(5)]
    monkeypatch.setattr(O, "HELD", 4)
    parts = list(O._runs(pa.Table.from_pylist(rows).to_batches(max_chunksize=3)))
    assert len(parts) > 1
    assert sorted((r["node"], r["head"], r["nth"], r["last"]) for p in parts for r in p.to_pylist()) == [(10 * k + i, 10 * k, i, 5) for k in range(4) for i in range(6)]
