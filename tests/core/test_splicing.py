"""Splicing against a plain replacement in lists, statuses, numbers of new nodes; alignments carried over, by hand."""

import pytest

from braidwork.operators import projection as J
from braidwork.operators import splicing as X

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def spell(nodes, walk):
    return "".join(nodes[n].translate(COMPLEMENT)[::-1] if r else nodes[n] for n, r in walk)


def walks_of(steps):
    out = {}
    for r in sorted(steps, key=lambda r: (r.path, r.step)):
        out.setdefault(r.path, []).append((r.node, r.rev))
    return out


@pytest.fixture()
def graph(spark):
    nodes = {1: "AA", 2: "C", 10: "G", 12: "TT", 13: "CA", 20: "GG", 30: "T", 40: "AC", 41: "AG", 42: "AT", 50: "CCC", 60: "GT", 61: "T", 62: "A", 70: "C"}
    f = lambda *ns: [(n, False) for n in ns]
    back = lambda w: [(n, not r) for n, r in reversed(w)]
    paths = {
        1: f(1, 10, 12, 20, 30, 40, 41, 42, 50, 60, 61, 62, 70),
        2: back(f(2, 10, 13, 20, 30, 40, 42, 50, 60, 62, 70)),
        3: f(41, 42, 50),  # begins inside region 2
    }
    steps = [(p, i + 1, n, r) for p, w in paths.items() for i, (n, r) in enumerate(w)]
    edges = sorted({(a, ar, b, br) for w in paths.values() for (a, ar), (b, br) in zip(w, w[1:], strict=False)})
    return (
        nodes, paths,
        spark.createDataFrame(steps, "path long, step long, node long, rev boolean"),
        spark.createDataFrame(sorted(nodes.items()), "node long, seq string"),
        spark.createDataFrame(edges, "src long, src_rev boolean, dst long, dst_rev boolean"),
        spark.createDataFrame([(1, n) for n in (10, 12, 13, 20)] + [(2, n) for n in (40, 41, 42)] + [(3, n) for n in (60, 61, 62)], "region long, node long"),
        spark.createDataFrame([(1, 10, 20), (2, 40, 42), (3, 60, 62)], "region long, left long, right long"),
    )


def test_spliced(spark, graph):
    nodes, paths, steps, node_rows, edges, inside, regions = graph
    # region 1: path 1 spells G TT GG, path 2 along it G CA GG; the candidate shares its ends and walks one piece backwards
    pieces = [(1, 1, "G"), (1, 2, "AA"), (1, 3, "CA"), (1, 4, "GG"), (2, 1, "ACAGAT"), (3, 1, "GTTA"), (3, 2, "GTA")]
    walks = [(1, 1, 1, 1, False), (1, 1, 2, 2, True), (1, 1, 3, 4, False), (1, 2, 1, 1, False), (1, 2, 2, 3, False), (1, 2, 3, 4, False), (2, 1, 1, 1, False), (3, 1, 1, 1, False), (3, 2, 1, 2, False)]
    links = [(1, 1, False, 2, True), (1, 2, True, 4, False), (1, 1, False, 3, False), (1, 3, False, 4, False)]
    run = lambda p, w: X.spliced(steps, node_rows, edges, inside, regions, spark.createDataFrame(p, "region long, piece long, seq string"), spark.createDataFrame(w, "region long, path long, step long, piece long, rev boolean"), spark.createDataFrame(links, "region long, src long, src_rev boolean, dst long, dst_rev boolean"), max_node=2)
    made = run(pieces, walks)
    assert {r.region: tuple(r)[1:] for r in made.regions.collect()} == {
        1: ("patched", 2, 4, True), 2: ("unpatched:starts_inside=1", 2, None, None), 3: ("patched", 2, 4, False),
    }  # fmt: skip  # region 3 has 3 numbers for 2 + 2 pieces of two bases
    seqs = {r.node: r.seq for r in made.nodes.collect()}
    assert set(nodes) - {10, 12, 13, 20, 60, 61, 62} <= set(seqs) and len(seqs) == len(nodes) - 7 + 8
    assert {seqs[n] for n in range(10, 21) if n in seqs} == {"G", "AA", "CA", "GG"} and {seqs[n] for n in (71, 72, 73, 74)} == {"GT", "TA", "A"}
    walked = walks_of(made.steps.collect())
    assert {p: spell(seqs, w) for p, w in walked.items()} == {p: spell(nodes, w) for p, w in paths.items()}
    assert all(r.step >= 1 for r in made.steps.collect()) and walked[3] == paths[3]
    found = {tuple(r) for r in made.edges.collect()}
    canonical = lambda a, ar, b, br: min((a, ar, b, br), (b, not br, a, not ar))
    assert found == {canonical(*x, *y) for w in walked.values() for x, y in zip(w, w[1:], strict=False)}
    # a candidate that lacks a path, one that spells something else, one with a path that does not cross, none at all
    reasons = {}
    for name, (p, w) in {"lacks": (pieces, walks[:3] + walks[6:]), "differs": ([(1, 1, "C"), *pieces[1:]], walks), "extra": (pieces, [*walks, (1, 9, 1, 1, False)]), "none": (pieces[4:], walks[6:])}.items():
        reasons[name] = {r.region: r.status for r in run(p, w).regions.collect()}[1]
    assert reasons == {"lacks": "unpatched:crossing_path_not_in_candidate:2", "differs": "unpatched:sequence_differs:1", "extra": "unpatched:candidate_path_not_crossing:9", "none": "no_candidate"}
    nothing = X.spliced(steps, node_rows, edges, inside, regions.limit(0), spark.createDataFrame([], "region long, piece long, seq string"), spark.createDataFrame([], "region long, path long, step long, piece long, rev boolean"))
    assert walks_of(nothing.steps.collect()) == paths and nothing.regions.collect() == []


def test_projected_by_hand(spark):
    """Reference walk 1 to 8, each of 10 bases (3 lies backwards), the span over 4 and 5, flanks of 20 bases named 100 and 200."""
    reference = spark.createDataFrame([("r", n, (n - 1) * 10, n * 10, n == 3) for n in range(1, 9)], "region string, node long, r_start long, r_end long, r_rev boolean")
    inside = spark.createDataFrame([("r", 4, 10), ("r", 5, 10), ("r", 44, 7)], "region string, node long, len long")
    regions = spark.createDataFrame([("r", 30, 50, 100, 20, 200, 20)], "region string, a0 long, b0 long, left long, left_len long, right long, right_len long")
    f = lambda *ns: [(n, n == 3) for n in ns]
    back = lambda w: [(n, not r) for n, r in reversed(w)]
    reads = {
        "in": f(4, 44, 5), "left": f(3, 4), "both": f(2, 3, 4, 5, 6), "back": back(f(3, 4)), "alone": f(7), "alone back": back(f(2)),
        "far": f(1, 2, 3, 4), "gap": f(2, 4), "twisted": [(3, False), (2, False), (4, False)], "off": [(99, False), (4, False)], "within": f(4, 6, 5), "away": f(8, 1),
    }
    rows = [("r", name, i, n, r) for name, w in reads.items() for i, (n, r) in enumerate(w)]
    at = [("r", name, 2, 10 * len(w) - 3, 10 * len(w)) for name, w in reads.items() if name != "in"] + [("r", "in", 2, 20, 27)]
    out, steps = J.projected(spark.createDataFrame(at, "region string, read string, ps long, pe long, plen long"), spark.createDataFrame(rows, "region string, read string, step long, node long, rev boolean"), inside, reference, regions)
    got = {r.read: tuple(r)[2:] for r in out.collect()}
    assert got == {
        "in": ("kept", 2, 20, 27), "left": ("projected", 12, 27, 30), "both": ("projected", 2, 47, 60), "back": ("projected", 2, 17, 30), "alone": ("projected", 12, 17, 20), "alone back": ("projected", 12, 17, 20),
        "far": ("beyond_flank", None, None, None), "gap": ("beyond_flank", None, None, None), "twisted": ("not_colinear", None, None, None), "off": ("off_reference", None, None, None),
        "within": ("outside_within", None, None, None), "away": ("not_colinear", None, None, None),
    }
    walked = {}
    for r in sorted(steps.collect(), key=lambda r: (r.read, r.step)):
        walked.setdefault(r.read, []).append((r.node, r.rev))
    assert walked == {
        "in": f(4, 44, 5), "left": f(100, 4), "both": f(100, 4, 5, 200), "back": back(f(100, 4)), "alone": f(200), "alone back": back(f(100)),
    }
    kept = J.wholly_on(spark.createDataFrame(rows, "region string, read string, step long, node long, rev boolean"), inside, ["region", "read"], "region").collect()
    assert {r.read for r in kept} == {"in"} and len(kept) == 3
