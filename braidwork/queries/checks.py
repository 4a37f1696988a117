"""Validation and path-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import checks as C
from braidwork.operators import kernels as K
from braidwork.operators import paths as P
from braidwork.operators.windows import dealt
from braidwork.plans.scratch import materialize
from braidwork.queries.base import query, table
from braidwork.queries.graphs import event_steps
from braidwork.queries.paths import STEPS_SQL, order_steps
from braidwork.queries.sequences import CELLS_SQL, WIDTH, cells_of


@query("row_check", """SELECT p_partkey::VARCHAR AS name, CASE WHEN p_size % 5 = 0 THEN 'missing' ELSE 'differs' END AS problem, CASE WHEN p_size % 5 = 0 THEN NULL ELSE 3 END::INT AS "at" FROM part WHERE p_size % 5 = 0 OR p_size % 5 = 1""")
def row_check(spark, d):
    """Rows of which some are missing and some have another base inside."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.upper("p_name").alias("seq"), (F.col("p_size") % 5).alias("k"))
    changed = F.concat(F.substr("seq", F.lit(1), F.lit(3)), F.lit("?"), F.expr("substr(seq, 5)"))
    rows = p.where("k <> 0").select("name", F.concat(F.lit("--"), F.when(F.col("k") == 1, changed).otherwise(F.col("seq"))).alias("aligned"))
    return C.row_mismatches(rows, p)


@query("length_prefilter", """WITH g AS (SELECT p_brand, max(length(p_name)) FILTER (p_size = 1) AS r, min(length(p_name)) AS a, max(length(p_name)) AS b FROM part GROUP BY p_brand)
SELECT p_brand, greatest(abs(a - r), abs(b - r))::INT AS most FROM g WHERE greatest(abs(a - r), abs(b - r)) >= 2""")
def length_prefilter(spark, d):
    """Brands whose names vary in length from that of the smallest part."""
    return C.varying(table(spark, d, "part").withColumn("n", F.length("p_name")), "p_brand", "n", F.col("p_size") == 1, 2)


@query("rule_predicate", "SELECT p_partkey, p_size > 20 AND p_retailprice > 1000 AS both, p_size > 20 OR p_retailprice > 1000 AS either FROM part")
def rule_predicate(spark, d):
    """P7, E54."""
    two = [("p_size", 20), ("p_retailprice", 1000)]
    return table(spark, d, "part").select("p_partkey", C.rule(two).alias("both"), C.rule(two, "or").alias("either"))


@query("skip_rule", """WITH j AS (SELECT p_partkey, p_brand, p_retailprice AS cost, p_size % 7 = 0 AS t FROM part)
SELECT p_partkey, CASE WHEN n >= 2 THEN 'timeouts' WHEN cost > 1500 THEN 'predicted' END AS skip FROM (SELECT *, coalesce(sum(t::INT) OVER (PARTITION BY p_brand ORDER BY cost RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM j)""")
def skip_rule(spark, d):
    """P10: jobs skipped after cheaper ones timed out, or for their predicted cost."""
    j = table(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("cost"), F.when(F.col("p_size") % 7 == 0, "timeout").otherwise("ok").alias("status"))
    return C.skipped(j, "p_brand", "cost", "status", "cost", 2, 1.5, 1000).select("p_partkey", "skip")


@query("validation_report", """SELECT 'orders without lines' AS "check", (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey))::BIGINT AS n
UNION ALL SELECT 'unknown parts', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey))::BIGINT""")
def validation_report(spark, d):
    """P11."""
    lines = table(spark, d, "lineitem")
    return C.report({
        "orders without lines": table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "unknown parts": lines.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_anti"),
    })


def user_steps(spark, d):
    """Users' walks of one group, user 1's being the reference."""
    return event_steps(spark, d).select(F.lit(0).alias("g"), F.col("user_id").cast("string").alias("path"), "n", F.concat("event_type", F.lit("-"), (F.col("n") % 11).cast("string")).alias("node"), F.lit(10).alias("len"))


@query("anchored_pieces")
def anchored_pieces(spark, d):
    """Pieces between anchors of each walk on the reference walk."""
    return P.pieces(P.anchored(user_steps(spark, d), "g", "path", "n", "node", "len", "1"), "g", "path")


@query("inflation")
def inflation(spark, d):
    """A7."""
    return P.inflation(anchored_pieces(spark, d), "g", "path", 30)


#: Orders of even customers are the panel, its kinds going by customer; those of odd ones are looked for in it.
PANEL_SQL = f"""{STEPS_SQL}, owned AS (SELECT s.path, s.step - 1 AS step, s.node, o_custkey AS cust, CASE o_custkey % 10 WHEN 0 THEN 'partial' WHEN 2 THEN 'ref_a' WHEN 4 THEN 'ref_b' ELSE 'sample' END AS kind, count(*) OVER (PARTITION BY s.path) AS n FROM steps s JOIN orders ON o_orderkey = s.path),
w AS (SELECT * FROM owned WHERE cust % 2 = 1), p AS (SELECT * FROM owned WHERE cust % 2 = 0),
met AS (SELECT w.path AS walk, w.step, w.n, p.path AS panel, p.kind, p.step AS pos, p.n AS panel_n, w.step - row_number() OVER (PARTITION BY w.path, p.path, p.step - w.step ORDER BY w.step) AS run FROM w JOIN p USING (node)),
ext AS (SELECT *, max(step) OVER (PARTITION BY walk, panel, pos - step, run) AS upto, list_position(['sample', 'partial', 'ref_a', 'ref_b'], kind) AS rank FROM met),
whole AS (SELECT walk, arg_min(kind, {{'a': kind <> 'sample', 'b': rank}}) AS kind FROM ext WHERE step = 0 AND pos = 0 AND upto + 1 = n AND panel_n = n AND kind <> 'partial' GROUP BY walk),
best AS (SELECT walk, step, max(upto) AS upto, arg_max(kind, {{'a': upto, 'b': -rank}}) AS kind FROM ext GROUP BY walk, step),
each AS MATERIALIZED (SELECT w.path AS walk, w.step, coalesce(b.upto, w.step) AS upto, coalesce(b.kind, 'novel') AS kind FROM w LEFT JOIN best b ON b.walk = w.path AND b.step = w.step),
pieces AS (SELECT * FROM each WHERE step = 0 UNION ALL SELECT e.* FROM pieces p JOIN each e ON e.walk = p.walk AND e.step = p.upto + 1)"""


@query("mosaic_walks", f"""WITH RECURSIVE {PANEL_SQL}, l AS (SELECT walk, list(kind ORDER BY step) AS kinds, string_agg(step || '-' || upto, ',' ORDER BY step) AS spans FROM pieces GROUP BY walk)
SELECT l.walk, CASE WHEN whole.kind = 'sample' THEN 'verbatim' WHEN whole.kind IS NOT NULL THEN 'copy_of_' || whole.kind WHEN list_distinct(kinds) = ['sample'] THEN CASE WHEN len(kinds) = 2 THEN 'junction' ELSE 'mosaic_' || len(kinds) END ELSE 'mixed(' || array_to_string(kinds, '+') || ')' END AS label,
       spans, len(list_filter(kinds, lambda x: x = 'novel'))::BIGINT AS novel FROM l LEFT JOIN whole USING (walk)""")
def mosaic_walks(spark, d):
    """orders' walks as pieces of others', the panel being a table."""
    cust = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("cust"))
    steps = materialize(order_steps(spark, d).join(cust, "path").select("path", (F.col("step") - 1).alias("step"), "node", "cust"), "mosaic-steps")
    k = F.col("cust") % 10
    panel = steps.where("cust % 2 = 0").select(F.col("path").alias("panel"), F.when(k == 0, "partial").when(k == 2, "ref_a").when(k == 4, "ref_b").otherwise("sample").alias("kind"), "step", "node")
    made = P.mosaics(steps.where("cust % 2 = 1").select(F.col("path").alias("walk"), "step", "node"), panel, ["sample", "partial", "ref_a", "ref_b"])
    spans = F.array_join(F.transform("pieces", lambda p: F.concat_ws("-", p["first"], p["last"])), ",")
    return made.select("walk", "label", spans.alias("spans"), "novel")


@query("coarsened_alleles", f"""WITH {CELLS_SQL}, k AS (SELECT p_brand, col FROM c GROUP BY ALL HAVING count(DISTINCT ch) = 1 AND max(ch) <> '-')
SELECT p_brand, count(*)::BIGINT AS n FROM k GROUP BY p_brand""".replace("SELECT p_brand, count(*)::BIGINT AS n FROM k GROUP BY p_brand", "SELECT p_brand, (SELECT count(*) FROM k WHERE k.p_brand = b.p_brand)::BIGINT AS n FROM (SELECT DISTINCT p_brand FROM part) b"))
def coarsened_alleles(spark, d):
    """Columns that stand in anchors of at least one column."""
    rows = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    parts = P.coarsened(cells_of(dealt(rows, ["p_brand", "p_partkey"], rows.count() * WIDTH)), "p_brand", 1).groupBy("p_brand", "part", "anchor").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return parts.groupBy("p_brand").agg(F.coalesce(F.sum(F.when(F.col("anchor"), F.col("hi") - F.col("lo") + 1)), F.lit(0)).cast("long").alias("n"))


@query("cluster_split", """WITH u AS (SELECT DISTINCT p_brand, p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS d, greatest(length(a.p_name), length(b.p_name)) AS m FROM u a JOIN u b ON a.p_brand = b.p_brand AND a.p_name < b.p_name)
SELECT a[1] = b[1] AS within, sum(d)::BIGINT AS cost, sum(m)::BIGINT AS optimum, sum(d)::DOUBLE / sum(m)::DOUBLE AS ratio FROM p GROUP BY 1""")
def cluster_split(spark, d):
    """Names of one first letter are a cluster."""
    from braidwork.queries.kernels import brand_pairs

    pairs = K.distinct_apply(brand_pairs(spark, d), "a", "b", "cost", K.edit_distance).withColumn("m", F.greatest(F.length("a"), F.length("b")))
    clusters = table(spark, d, "part").select(F.col("p_name").alias("id"), F.substr("p_name", F.lit(1), F.lit(1)).alias("cluster")).distinct()
    return P.cluster_split(pairs, clusters, "a", "b", "cost", "m").withColumn("optimum", F.col("optimum").cast("long"))
