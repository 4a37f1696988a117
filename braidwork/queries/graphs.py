"""Graph queries: users' event types as cyclic walks, orders' parts as paths."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions import sequences as S
from braidwork.operators import graphs as G
from braidwork.operators import windows as N
from braidwork.operators.components import connected_components, forest
from braidwork.plans.scratch import materialize
from braidwork.queries.base import query, table
from braidwork.queries.paths import STEPS_SQL, order_steps


@query("path_offsets", f"WITH {STEPS_SQL} SELECT path, step, (sum(len) OVER (PARTITION BY path ORDER BY step) - len)::BIGINT AS \"offset\" FROM steps")
def path_offsets(spark, d):
    """W1, W2."""
    return N.offsets(order_steps(spark, d), "path", "step", "len").select("path", F.col("step").cast("long").alias("step"), "offset")


@query("path_edges_canonical", f"""WITH {STEPS_SQL}, e AS (SELECT node AS a, lead(node) OVER (PARTITION BY path ORDER BY step) AS b FROM steps)
SELECT CASE WHEN a < -b THEN a ELSE -b END AS src, CASE WHEN a < -b THEN b ELSE -a END AS dst, count(*)::BIGINT AS n FROM e WHERE b IS NOT NULL GROUP BY ALL""")
def path_edges_canonical(spark, d):
    """W3, R12."""
    e = N.edges(order_steps(spark, d), "path", "step").select(S.canonical_edge(F.col("src"), F.col("dst")).alias("e"))
    return e.groupBy("e.src", "e.dst").agg(F.count("*").alias("n"))


@query("walk_metrics", f"""WITH {STEPS_SQL}, v AS (SELECT path, node, count(*) AS n, min(len) AS len FROM steps GROUP BY ALL)
SELECT path, sum(n)::BIGINT AS steps, count(*)::BIGINT AS nodes, sum(n * len)::BIGINT AS bp, max(n)::BIGINT AS most_visits, sum(n - 1)::BIGINT AS revisits FROM v GROUP BY path""")
def walk_metrics(spark, d):
    """Two-level aggregation of visits."""
    v = order_steps(spark, d).groupBy("path", "node").agg(F.count("*").alias("n"), F.min("len").alias("len"))
    return v.groupBy("path").agg(F.sum("n").alias("steps"), F.count("*").alias("nodes"), F.sum(F.col("n") * F.col("len")).alias("bp"), F.max("n").alias("most_visits"), F.sum(F.col("n") - 1).alias("revisits"))


@query("monotone_matches", f"""WITH {STEPS_SQL}, m AS (SELECT *, max(node) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM steps), k AS (SELECT * FROM m WHERE b IS NULL OR node > b)
SELECT path, step, node, node - lag(node) OVER (PARTITION BY path ORDER BY step) AS gap_node FROM k""")
def monotone_matches(spark, d):
    """Steps taken greedily so that nodes grow, with the gaps between."""
    m = N.monotone(order_steps(spark, d), "path", "step", "node")
    return N.gaps_between(m, "path", "step", "node").select("path", F.col("step").cast("long").alias("step"), "node", "gap_node")


EVENT_RUNS_SQL = "e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


def event_steps(spark, d):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_type", n.alias("n"))


@query("run_length_encode", f"""WITH {EVENT_RUNS_SQL}, m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY n) OR n = 1 THEN 1 ELSE 0 END AS x FROM e), i AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY n) AS island FROM m)
SELECT user_id, island::BIGINT AS island, event_type, min(n)::BIGINT AS first, count(*)::BIGINT AS n FROM i GROUP BY user_id, island, event_type""")
def run_length_encode(spark, d):
    """W16, W5, E56."""
    r = N.run_lengths(event_steps(spark, d), "user_id", "n", "event_type")
    return r.withColumn("first", F.col("first").cast("long"))


@query("gap_islands", """WITH x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), k AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM x)
SELECT l_suppkey, min(l_partkey) AS lo, max(l_partkey) AS hi, count(*)::BIGINT AS n FROM k GROUP BY l_suppkey, g""")
def gap_islands(spark, d):
    """Runs of consecutive parts of a supplier."""
    lines = table(spark, d, "lineitem")
    return N.numeric_runs(lines, "l_suppkey", "l_partkey", lines.count())


@query("conserved_runs", """WITH x AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), k AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS g FROM x),
r AS (SELECT l_suppkey, min(l_partkey) AS lo, max(l_partkey) AS hi, count(*)::BIGINT AS n FROM k GROUP BY l_suppkey, g)
SELECT l_suppkey, lo, hi, n FROM (SELECT *, min(lo) OVER (PARTITION BY l_suppkey) AS a, max(hi) OVER (PARTITION BY l_suppkey) AS b FROM r) WHERE n >= 3 OR lo = a OR hi = b""")
def conserved_runs(spark, d):
    """W7."""
    lines = table(spark, d, "lineitem")
    return N.conserved_runs(lines, "l_suppkey", "l_partkey", 3, lines.count())


@query("lag_identity", f"""WITH {EVENT_RUNS_SQL}, m AS (SELECT user_id, n, (event_type = lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY n))::INT::BIGINT AS match FROM e)
SELECT user_id, n, match, (sum(match) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))::BIGINT AS in_window FROM m""")
def lag_identity(spark, d):
    """Matches at a lag, summed over a sliding window."""
    m = N.lag_matches(event_steps(spark, d), "user_id", "n", "event_type", 2)
    return N.sliding_sum(m, "user_id", "n", "match", 5).select("user_id", F.col("n").cast("long").alias("n"), "match", "in_window")


@query("latest_wins", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_wins(spark, d):
    """The last row of each key."""
    return N.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def word_runs(k: int):
    """Hashes of the runs of k words of an array of words."""
    return lambda w: F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k))))).otherwise(F.array().cast("array<bigint>"))


@query("decontamination_guard", "SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def decontamination_guard(spark, d):
    """Documents that hold a benchmark item whole.

    The first and last words of an item may be parts of longer words in a document, those between stand there whole. Items
    and documents meet on the first of those, five at most: equi-joins on hashes of runs of words, one for each length that
    items have, then an exact check. Items of one or two words have none between; documents are searched for each of them.
    """
    words = lambda c: F.split(F.trim(F.regexp_replace(c, "\\s+", " ")), " ")
    items = table(spark, d, "benchmark").select(F.col("text").alias("item"), words(F.col("text")).alias("w")).select("item", "w", F.least(F.size("w") - 2, F.lit(5)).alias("k")).where("item IS NOT NULL")
    lengths = sorted(r[0] for r in items.select("k").distinct().collect())  # -1 to 5
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = None
    for k in lengths:
        own = items.where(F.col("k") == k)
        if k < 1:
            found = docs.join(own.select("item").distinct(), F.contains("text", "item")).select("doc_id")
        else:
            inner = own.select("item", F.xxhash64(F.slice("w", 2, k)).alias("h"))
            met = docs.select("doc_id", F.explode(S.let(words(F.col("text")), word_runs(k))).alias("g")).join(inner, F.col("g") == F.col("h")).select("doc_id", "item").distinct()
            found = met.join(docs, "doc_id").where(F.contains("text", "item")).select("doc_id")
        hits = found if hits is None else hits.unionByName(found)
    return docs.where("false").select("doc_id") if hits is None else hits.distinct()


EDGES_SQL = f"""{STEPS_SQL}, e AS (SELECT DISTINCT src, dst FROM (SELECT node AS src, lead(node) OVER (PARTITION BY path ORDER BY step) AS dst FROM steps) WHERE dst IS NOT NULL)"""


def some_edges(spark, d):
    return N.edges(order_steps(spark, d), "path", "step").select("src", "dst").distinct()


@query("reachability", f"WITH RECURSIVE {EDGES_SQL}, r AS (SELECT min(src) AS node FROM e UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r")
def reachability(spark, d):
    """From the least node."""
    e = materialize(some_edges(spark, d), "reach-edges")
    return G.reachable(e, e.agg(F.min("src").alias("node")))


@query("connected_components", f"""WITH RECURSIVE {EDGES_SQL}, b AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e), r AS (SELECT u AS node, u AS c FROM b UNION SELECT v, c FROM r JOIN b ON u = node)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def components(spark, d):
    """R4."""
    return connected_components(forest(some_edges(spark, d), "src", "dst"))


FORWARD_SQL = f"{STEPS_SQL}, e AS (SELECT DISTINCT src, dst FROM (SELECT node AS src, lead(node) OVER (PARTITION BY path ORDER BY step) AS dst FROM steps) WHERE dst > src)"


def forward(spark, d):
    return N.edges(order_steps(spark, d), "path", "step").where("dst > src").select("src", "dst").distinct()


@query("cut_points", f"""WITH {FORWARD_SQL}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE src < node AND node < dst)""")
def cut_points(spark, d):
    """Nodes that no edge jumps over."""
    return G.cut_points(forward(spark, d))


@query("longest_levels")
def longest_levels(spark, d):
    """O2, O3: the longest walk that ends in each node."""
    return G.levels(forward(spark, d))


@query("cyclic_nodes", f"""WITH RECURSIVE {EVENT_RUNS_SQL}, g AS (SELECT DISTINCT event_type AS s, lead(event_type) OVER (PARTITION BY user_id ORDER BY n) AS d FROM e),
c AS (SELECT s, d FROM g WHERE d IS NOT NULL UNION SELECT c.s, g.d FROM c JOIN g ON g.s = c.d WHERE g.d IS NOT NULL) SELECT d AS node FROM c WHERE s IN (SELECT s FROM c WHERE s = d) UNION SELECT s FROM c WHERE s = d""")
def cyclic_nodes(spark, d):
    """Event types of all users as a cyclic graph."""
    return G.cyclic_nodes(N.edges(event_steps(spark, d), "user_id", "n", "event_type").select("src", "dst").distinct())


@query("unary_chains", f"""WITH RECURSIVE {EDGES_SQL}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), j AS (SELECT src, dst FROM e WHERE src IN (SELECT src FROM e GROUP BY src HAVING count(*) = 1) AND dst IN (SELECT dst FROM e GROUP BY dst HAVING count(*) = 1)),
ch AS (SELECT node, node AS head, 0::BIGINT AS nth FROM n WHERE node NOT IN (SELECT dst FROM j) UNION ALL SELECT j.dst, head, nth + 1 FROM ch JOIN j ON j.src = ch.node) SELECT * FROM ch""")
def unary_chains(spark, d):
    """R7, R8."""
    return G.unary_chains(some_edges(spark, d))


@query("subwalk_search", f"""WITH {STEPS_SQL}, w AS (SELECT path, list(node ORDER BY step) AS h FROM steps GROUP BY path), b AS (SELECT path AS walk, h, false AS rev FROM w UNION ALL SELECT path, list_reverse(list_transform(h, lambda x: -x)), true FROM w)
SELECT walk, w.path, (p.step - 1)::INT AS "at", rev FROM b JOIN steps p ON p.node = b.h[1] JOIN w ON w.path = p.path WHERE w.h[p.step:p.step + len(b.h) - 1] = b.h""")
def subwalk_search(spark, d):
    """The whole walks of all orders in all orders."""
    w = order_steps(spark, d).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("s")).select("path", F.transform("s", lambda x: x["node"]).alias("handles"))
    return G.subwalks(w.select(F.col("path").alias("walk"), "handles"), w)


@query("multiset_difference", "SELECT l_partkey FROM lineitem EXCEPT ALL SELECT p_partkey FROM part")
def multiset_difference(spark, d):
    """U2, P13."""
    return table(spark, d, "lineitem").select("l_partkey").exceptAll(table(spark, d, "part").select("p_partkey"))


@query("anti_join_missing", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_missing(spark, d):
    """J20."""
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("record_diff", """WITH a AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), x AS (SELECT * FROM a WHERE o_orderstatus = 'O'), y AS (SELECT * FROM a WHERE o_orderstatus = 'F')
SELECT CASE WHEN y.n IS NULL THEN 'only_a' WHEN x.n IS NULL THEN 'only_b' WHEN x.n = y.n THEN 'same' ELSE 'differ' END AS verdict, count(*)::BIGINT AS n FROM x FULL JOIN y ON x.o_custkey = y.o_custkey GROUP BY 1""")
def record_diff(spark, d):
    """A full outer difference."""
    a = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").count()
    x, y = (a.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias(f"k{s}"), F.col("count").alias(f"n{s}")) for s in "OF")
    j = x.join(y, F.col("kO") == F.col("kF"), "full")
    verdict = F.when(F.col("nF").isNull(), "only_a").when(F.col("nO").isNull(), "only_b").when(F.col("nO") == F.col("nF"), "same").otherwise("differ")
    return j.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("rank_aligned_assignment", """WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F')
SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b FROM a JOIN b ON a.o_custkey = b.o_custkey AND a.k = b.k""")
def rank_aligned_assignment(spark, d):
    """The k-th of one side goes to the k-th of the other."""
    o = table(spark, d, "orders").withColumn("k", F.row_number().over(W.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")))
    a = o.where("o_orderstatus = 'O'").select("o_custkey", "k", F.col("o_orderkey").alias("a"))
    return a.join(o.where("o_orderstatus = 'F'").select("o_custkey", "k", F.col("o_orderkey").alias("b")), ["o_custkey", "k"]).select("o_custkey", "a", "b")


@query("mate_pairing", """WITH x AS (SELECT conv_id, role, min(turn) AS turn, count(*)::BIGINT AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY ALL)
SELECT conv_id, max(turn) FILTER (role = 'user') AS one, max(turn) FILTER (role = 'assistant') AS two, sum(n - 1)::BIGINT AS copies FROM x GROUP BY conv_id""")
def mate_pairing(spark, d):
    """The first copy of each mate, later ones counted, in one shuffle."""
    c = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    of = lambda r: F.min(F.when(F.col("role") == r, F.col("turn")))
    return c.groupBy("conv_id").agg(of("user").alias("one"), of("assistant").alias("two"), (F.count("*") - F.countDistinct("role")).alias("copies"))


@query("json_metric_pivot", """SELECT user_id, sum((props->>'k')::BIGINT) FILTER (event_type = (SELECT min(event_type) FROM events))::BIGINT AS first_type, count(props->>'k')::BIGINT AS n FROM events GROUP BY user_id""")
def json_metric_pivot(spark, d):
    """Dotted access to documents."""
    e = table(spark, d, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    least = e.agg(F.min("event_type")).first()[0]
    return e.groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == least, F.col("k").cast("long"))).alias("first_type"), F.count("k").alias("n"))
