"""Plans and steps that hold at size: what is not broadcast, and closed forms against plain ones."""

from pyspark.sql import functions as F


def broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_implied_pairs_broadcasts_no_exploded_table(spark, tmp_path):
    from braidwork.operators import columns as C

    spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("path")).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t").select("g", "path", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("pos"))
    out = C.implied_pairs(rows.withColumn("place", F.col("pos")), rows.withColumn("place", F.col("pos") + F.col("path") % 2), "g")
    assert broadcasts(out) == 0
    for r in out.collect():
        n, odd = (len([p for p in range(2000) if p % 3 == r.g and p % 2 in kind]) for kind in ((0, 1), (1,)))
        both = n - odd
        assert (r.true_pairs, r.shared) == (9 * n * (n - 1) // 2, 9 * (odd * (odd - 1) + both * (both - 1)) // 2)


def test_core_bases_by_steps(spark):
    """Against adding up base by base: both strands, ends at and beyond a walk's, repeated reads, nodes without fractions."""
    import random

    from braidwork.operators import columns as C

    rng = random.Random(5)
    length = {n: rng.randint(0, 4) for n in range(8)}
    fractions = [(n, i, rng.randint(0, 4) / 4) for n in range(7) for i in range(length[n]) if rng.random() < 0.8]
    value, steps, walk = {(n, i): f for n, i, f in fractions}, [], {}
    for path in range(6):
        for step in range(rng.randint(0, 6)):
            n, rev = rng.randrange(8), rng.random() < 0.5
            steps.append((path, step, n, rev, length[n]))
            walk.setdefault(path, []).extend(value.get((n, length[n] - 1 - i if rev else i), 0.0) for i in range(length[n]))
    reads = [(p, a, b) for p in range(6) for a in range(-1, 25, 3) for b in range(a, 26)] + [(0, 0, 1)] * 2
    got = C.core_bases(*(spark.createDataFrame(r, s) for r, s in ((reads, "path int, ps long, pe long"), (steps, "path int, step int, node int, rev boolean, len long"), (fractions, "node int, at int, fraction double"))))
    assert broadcasts(got) == 0
    want = [(p, a, b, sum(walk[p][a:b]) if walk.get(p) and a >= 0 and b <= len(walk[p]) else None) for p, a, b in reads]
    order = lambda r: (*r[:3], r[3] is None)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)


def test_graph_pairs_by_visits(spark):
    """Visits and lengths give the pairs that a row a base gives."""
    import random

    from braidwork.operators import columns as C

    rng = random.Random(6)
    steps = spark.createDataFrame([(g, p, i, n := rng.randrange(6), rng.random() < 0.5, n * 2) for g in (1, 2) for p in range(5) for i in range(rng.randint(1, 7))], "g int, path int, step int, node int, rev boolean, len long")
    made = C.implied_node_pairs(steps, 5, "g")
    assert "Generate" not in made._jdf.queryExecution().sparkPlan().toString()
    # places of one base on one strand: positions in a walk do not matter to the counts
    places = C.walk_places(steps, "g")
    coarse = places.where("place.at < 5").select("g", "path", "pos", F.col("place.node").alias("place"))
    assert sorted(made.collect()) == sorted(C.implied_pairs(places, coarse, "g").collect())
    assert tuple(C.implied_node_pairs(steps.limit(0), 5).first()) == (0, 0, 0, None, None)


def test_reinserted_rows_are_those_of_the_cells(spark):
    import random

    from braidwork.operators import columns as C
    from braidwork.operators import msa as M

    rng = random.Random(8)
    rows = [(g, i, "".join(rng.choice("ACG---") for _ in range(9))) for g in range(12) for i in range(rng.randint(1, 5))] + [(99, 0, "-" * 9)]
    runs = [(g, i, k, pos, "N" * rng.randint(0, 3)) for g, i, r in rows for k, pos in enumerate(sorted(rng.randint(0, 9 - r.count("-")) for _ in range(rng.randint(0, 3))))]
    c = M.cells(spark.createDataFrame(rows, "g int, row int, aligned string"), "g", "row", "aligned")
    r = spark.createDataFrame(runs, "g int, row int, k int, pos int, run string")
    made = C.reinserted_rows(c, "g", r)
    assert broadcasts(made) == 0
    whole = {tuple(x) for x in M.rows_of(C.reinserted(c, "g", r), "g").collect()}
    assert {(x.g, x.row, x.aligned) for x in made.collect()} == whole and all(len(x.aligned) == x.columns for x in made.collect())


def test_blocks_by_rows(spark):
    """Against sets of rows; ragged rows, a group without a name and missing columns too. Cells are not broadcast."""
    import random

    from braidwork.operators import msa as M

    rng = random.Random(9)
    rows = [(g, i, j, rng.choice("AC--" if j % 3 else "A")) for g in (1, 2, None) for i in range(4) for j in range(rng.randint(3, 9)) if j != 4]
    c = spark.createDataFrame(rows, "g int, row int, col int, ch string")
    want = set()
    for g in (1, 2, None):
        last, block = object(), 0
        seqs = {}
        for col in sorted({r[2] for r in rows if r[0] == g}):
            now = {r[1] for r in rows if r[0] == g and r[2] == col and r[3] != "-"}
            block += now != last
            last = now
            for r in rows:
                if r[0] == g and r[2] == col and r[3] != "-":
                    seqs[block, r[1]] = seqs.get((block, r[1]), "") + r[3]
        want |= {(g, *k, s) for k, s in seqs.items()}
    made = M.block_spellings(c, "g")
    assert broadcasts(made) == 0
    assert {tuple(r) for r in made.select("g", "block", "row", "seq").collect()} == want


def test_position_pair_sums_are_those_of_the_pairs(spark):
    import random

    from braidwork.operators import msa as M

    rng = random.Random(10)
    c = M.cells(spark.createDataFrame([(g, i, "".join(rng.choice("AC-") for _ in range(9))) for g in (1, 2, 3) for i in range(g * 2 - 1)], "g int, row int, aligned string"), "g", "row", "aligned")
    want = M.position_pairs(c, "g").groupBy("g").agg(F.count("*").alias("n"), F.sum((F.col("pos_a") * F.col("pos_b")).cast("long")).alias("s"))
    made = M.position_pair_sums(c, "g")
    assert "Join" not in made._jdf.queryExecution().sparkPlan().toString()
    assert sorted(made.collect()) == sorted(want.collect())


def test_best_covering_pair_against_all_pairs(spark):
    import random
    from itertools import combinations

    from braidwork.operators import walks as V

    rng = random.Random(11)
    rows = [(g, o, m) for g in range(40) for o in range(rng.randint(1, 7)) for m in rng.sample(range(30), rng.randint(1, 4))]
    made = V.best_covering_pair(spark.createDataFrame(rows * 2, "g int, o int, m int"), "g", "o", "m")
    want = {}
    for g in range(40):
        own = {o: {m for h, p, m in rows if h == g and p == o} for h, o, _ in rows if h == g}
        if len(own) > 1:
            want[g] = min((-len(own[a] | own[b]), a, b) for a, b in combinations(sorted(own), 2))
    assert {r.g: (-r.covered, r.a, r.b) for r in made.collect()} == want


def test_many_owners_that_share_nothing_make_no_pairs(spark):
    from braidwork.operators import walks as V

    one = spark.range(20000).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.col("id").alias("m"))
    assert V.best_covering_pair(one, "g", "o", "m").collect() == [(1, 0, 1, 2)]


def test_names_of_one_stem_meet_only_where_one_begins_the_other(spark):
    from braidwork.operators import walks as V

    names = [f"s#{i}" for i in range(100, 400)] + ["t#9", "u#1", "u#12", "none", "v#a[1"]
    paths = [f"s#{i}x" for i in range(100, 400)] + ["t#91", "t#92", "u#1x2", "u#12[4]", "none1", "v#a[12]"]
    made = V.match_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {(r.name, r.path, r.how) for r in made.collect()}
    assert got == {(f"s#{i}", f"s#{i}x", "prefix") for i in range(100, 400)} | {("u#12", "u#12[4]", "subrange"), ("u#1", "u#1x2", "prefix"), ("v#a[1", "v#a[12]", "prefix")}


def test_greedy_cover_is_that_of_sets():
    import random
    import time

    from braidwork.operators import walks as V

    rng = random.Random(12)
    for share in (0.5, 0.95, 1.0):
        sets = {o: set(rng.sample(range(60), rng.randint(1, 9))) for o in range(40)}
        pairs = [(o, m) for o, own in sets.items() for m in own]
        rng.shuffle(pairs)
        whole, covered, want = set().union(*sets.values()), set(), []
        while len(covered) < share * len(whole):
            want.append(max(sorted(k for k in sets if k not in want), key=lambda k: len(sets[k] - covered)))
            covered |= sets[want[-1]]
        assert V.greedy_cover([o for o, _ in pairs], [m for _, m in pairs], share) == want
    began = time.monotonic()
    assert len(V.greedy_cover(list(range(20000)), list(range(20000)), 0.5)) == 10000 and time.monotonic() - began < 30
    assert V.greedy_cover([], [], 0.9) == []


def test_equal_alleles_are_judged_once(spark, tmp_path):
    from braidwork.queries import registry

    spark.range(1600).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), (F.col("id") % 4).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    made = registry.QUERIES["allele_conflicts"](spark, str(tmp_path))
    assert "bin_l" not in made._jdf.queryExecution().sparkPlan().toString() and made.select("id_a", "id_b").distinct().count() == made.count() > 100_000


def test_runs_are_dealt_by_their_rows(spark, monkeypatch):
    """Few bytes a row do not bring all rows into few tasks; the exchange by keys serves the runs too."""
    from braidwork.operators import windows as N

    monkeypatch.setattr(N, "TASK_ROWS", 1000)
    rows = spark.range(30000).select((F.col("id") % 500).alias("k"), (F.col("id") * 7 % 97).alias("x"))
    made = N.conserved_runs(rows, "k", "x", 3, 30000)
    assert sorted(made.collect()) == sorted(N.conserved_runs(rows, "k", "x", 3).collect())
    assert made.rdd.getNumPartitions() == 30
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0


def test_variable_kmers_aggregate_no_pairs_of_kmers_and_rows(spark):
    from braidwork.operators import kmers as K

    rows = [("a", 1, "ACGTA"), ("a", 1, "CGTTT"), ("a", 2, "ACGAC"), ("a", 3, None), ("a", None, "TTTT"), ("b", 1, "AC"), ("b", 2, "ACGACG")]
    made = K.variable_kmers(spark.createDataFrame(rows, "g string, i int, s string"), "g", "i", "s", 3)
    have = {}
    for g, i, s in rows:
        for x in range(len(s or "") - 2):
            have.setdefault((g, s[x : x + 3]), set()).update({i} - {None})
    size = {g: len({i for h, i, _ in rows if h == g and i is not None}) for g in "ab"}
    assert {tuple(r) for r in made.collect()} == {(*k, len(v)) for k, v in have.items() if len(v) < size[k[0]]}
    assert "count(distinct" not in made._jdf.queryExecution().analyzed().toString()


def test_coarsened_alleles_sorts_no_cells_for_letters_and_deals_rows_not_cells(spark, tmp_path):
    from braidwork.operators import paths as P
    from braidwork.queries import checks

    rows = [(k, f"Brand#{k % 2}", "RING BOLT"[: 4 + k % 5], 1) for k in range(40)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    out = checks.coarsened_alleles(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    # rows are dealt before they are exploded; behind that no row or column of cells is in an exchange
    assert "REPARTITION_BY_NUM" in plan and not any("Exchange" in x and ("row#" in x or "col#" in x) for x in plan.splitlines())
    assert {tuple(r) for r in out.collect()} == {("Brand#0", 4), ("Brand#1", 4)}


def test_spliced_edges_reads_orders_once(spark, tmp_path):
    """Orders are read to number them, once; what follows reads the tables made of them."""
    from braidwork.queries import splicing

    rows = [(k, k % 7, f"199{3 + k % 6}-01-0{1 + k % 9}") for k in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate string").selectExpr("o_orderkey", "o_custkey", "to_timestamp(o_orderdate) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    for made in splicing.customers(spark, str(tmp_path)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in plan and "row_number" not in plan
    assert splicing.spliced_edges(spark, str(tmp_path)).count() > 0


def test_chosen_truth_seeks_neighbours_once(spark):
    """Which records of the second source meet the first's is written once: what comes out sorts and seeks nothing again."""
    from braidwork.operators import records as R

    rows = [(1, i, ("stvar", "smvar")[i % 2], i // 2, i // 2 + 1, "AA", ["C"], [1, 1], True) for i in range(12)]
    made = R.chosen_truth(spark.createDataFrame(rows, "region int, id int, source string, pos int, end int, ref string, alts array<string>, gt array<int>, within boolean"), "region")
    assert "Window" not in made._jdf.queryExecution().optimizedPlan().toString() and made.count() == 24


def test_allele_conflicts_joins_two_kinds_once_and_deals_pairs_over_all_tasks(spark, tmp_path):
    import duckdb

    from braidwork.queries import registry

    rows = [(k, f"b{k % 2}", None if k % 41 == 0 else k * 7 % 5) for k in [*range(900), 8, 9, 16, 33]] + [(901, None, 3)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    made = registry.QUERIES["allele_conflicts"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    # the few ids that make many pairs are not brought into few tasks, and of two kinds one stands first
    assert sum("Exchange hashpartitioning(b_kind" in x and "REPARTITION_BY_NUM" in x for x in plan.splitlines()) == 2 and "a_kind" in plan.split("Join")[1].split("\n")[0]
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = duck.sql(f"SELECT id_a, id_b, conflict FROM ({registry.ORACLES['allele_conflicts']})").fetchall()
    assert len(want) > 10_000 and sorted(map(tuple, made.collect())) == sorted(want)
