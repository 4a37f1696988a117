"""Splicing queries: a customer's orders as a walk and its reverse, those of some years as a region."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators import splicing as X
from braidwork.plans.scratch import materialize
from braidwork.queries.base import query, table

CUT = 3

#: Orders of 1994 to 1996 are inside (those of 1998 too for every ninth customer, which makes two runs). The candidate has what they
#: spell as one piece; it lacks the reverse walk of every seventh customer, spells something else for others, or is missing.
CUSTOMERS_SQL = """numbered AS (SELECT o_custkey, o_orderkey, year(o_orderdate::DATE) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
own AS (SELECT o_custkey AS region, o_custkey * 1000 + nth * 2 AS node, nth, n, substr('ACGTTGCAAC', (1 + o_orderkey % 5)::BIGINT, (1 + o_orderkey % 4)::BIGINT) AS seq,
        (y BETWEEN 1994 AND 1996) OR (y = 1998 AND o_custkey % 9 = 0) AS inner_ FROM numbered),
steps AS (SELECT region * 2 AS path, nth AS step, node, false AS rev, region, seq, inner_ FROM own UNION ALL SELECT region * 2 + 1, n + 1 - nth, node, true, region, seq, inner_ FROM own),
ends AS (SELECT region, min(node) AS l, max(node) AS r FROM own WHERE inner_ GROUP BY region),
pieces AS (SELECT region, string_agg(seq, '' ORDER BY node) || CASE WHEN region % 8 = 5 THEN 'A' ELSE '' END AS seq FROM own WHERE inner_ AND region % 10 <> 3 GROUP BY region),
walks AS (SELECT region, region * 2 AS path FROM pieces UNION ALL SELECT region, region * 2 + 1 FROM pieces WHERE region % 7 <> 0)"""

SPLICED_SQL = f"""{CUSTOMERS_SQL}, runs0 AS (SELECT *, step - row_number() OVER (PARTITION BY path ORDER BY step) AS g, (SELECT max(nth) FROM own o WHERE o.region = s.region) AS n FROM steps s WHERE inner_),
runs AS (SELECT path, region, min(step) AS first, max(step) AS last, arg_min(node, step) AS a, arg_max(node, step) AS b, any_value(rev) AS rev, any_value(n) AS n FROM runs0 GROUP BY path, region, g),
kinds AS (SELECT r.*, CASE WHEN NOT rev AND a = l AND b = e.r OR rev AND a = e.r AND b = l THEN 'good' WHEN first = 1 THEN 'starts_inside' WHEN last = n THEN 'ends_inside' ELSE 'not_anchor_to_anchor' END AS kind FROM runs r JOIN ends e USING (region)),
bad AS (SELECT region, string_agg(kind || '=' || n, ',' ORDER BY kind) AS bad FROM (SELECT region, kind, count(*) AS n FROM kinds WHERE kind <> 'good' GROUP BY ALL) GROUP BY region),
why AS (SELECT region, CASE WHEN region % 8 = 5 THEN 'sequence_differs:' || region * 2 WHEN region % 7 = 0 THEN 'crossing_path_not_in_candidate:' || (region * 2 + 1) END AS why FROM ends),
states AS (SELECT region, l, r, CASE WHEN region % 10 = 3 THEN 'no_candidate' ELSE coalesce('unpatched:' || coalesce(bad, why), 'patched') END AS status, (SELECT count(*) FROM kinds k WHERE k.region = e.region AND kind = 'good') AS crossing
  FROM ends e LEFT JOIN bad USING (region) LEFT JOIN why USING (region)),
fresh AS (SELECT region, s.l, s.r, unnest(generate_series(0, (length(seq) - 1) // {CUT})) AS k, seq, (length(seq) - 1) // {CUT} + 1 AS n_new FROM pieces JOIN states s USING (region) WHERE status = 'patched'),
ids AS (SELECT region, k, substr(seq, k * {CUT} + 1, {CUT}) AS seq, n_new, r - l + 1 AS n_free,
        CASE WHEN r - l + 1 >= n_new THEN l + least(r - l, floor(k * ((r - l + 1)::DOUBLE / n_new))::BIGINT) END AS node FROM fresh),
behind AS (SELECT region, k, seq, (SELECT max(node) FROM own) + row_number() OVER (ORDER BY region, k) AS node FROM ids WHERE node IS NULL),
made AS (SELECT region, k, seq, node FROM ids WHERE node IS NOT NULL UNION ALL SELECT * FROM behind),
gone AS (SELECT region FROM states WHERE status = 'patched')"""


def customers(spark, d):
    """(steps, nodes, edges, inside, regions, pieces, walks)."""
    by = W.partitionBy("o_custkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("y"))
    o = o.select("*", F.row_number().over(by.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("nth"), F.count("*").over(by).alias("n"))
    k, region = F.col("o_orderkey"), F.col("o_custkey")
    seq = F.substr(F.lit("ACGTTGCAAC"), (1 + k % 5).cast("int"), (1 + k % 4).cast("int"))
    inner = F.col("y").between(1994, 1996) | ((F.col("y") == 1998) & (region % 9 == 0))
    # made once: all tables below are read by several steps
    own = materialize(o.select(region.cast("long").alias("region"), (region * 1000 + F.col("nth") * 2).cast("long").alias("node"), "nth", "n", seq.alias("seq"), inner.alias("inner_")), "splice-own")
    steps = own.select((F.col("region") * 2).alias("path"), F.col("nth").alias("step"), "node", F.lit(False).alias("rev"))
    steps = steps.unionByName(own.select((F.col("region") * 2 + 1).alias("path"), (F.col("n") + 1 - F.col("nth")).alias("step"), "node", F.lit(True).alias("rev")))
    w = W.partitionBy("path").orderBy("step")
    edges = steps.select(F.col("node").alias("src"), F.col("rev").alias("src_rev"), F.lead("node").over(w).alias("dst"), F.lead("rev").over(w).alias("dst_rev")).where("dst IS NOT NULL")
    inside = own.where("inner_").select("region", "node", "seq")
    regions = materialize(inside.groupBy("region").agg(F.min("node").alias("left"), F.max("node").alias("right")), "splice-regions")
    spelled = inside.where("region % 10 <> 3").groupBy("region").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    pieces = materialize(spelled.select("region", F.lit(1).cast("long").alias("piece"), F.concat("seq", F.when(F.col("region") % 8 == 5, "A").otherwise("")).alias("seq")), "splice-given")
    paths = F.when(F.col("region") % 7 == 0, F.array(F.col("region") * 2)).otherwise(F.array(F.col("region") * 2, F.col("region") * 2 + 1))
    walks = pieces.select("region", F.explode(paths).alias("path"), F.lit(1).cast("long").alias("step"), "piece", F.lit(False).alias("rev"))
    return steps, own.select("node", "seq"), edges, inside.select("region", "node"), regions, pieces, walks


def patched(spark, d):
    return X.spliced(*customers(spark, d), max_node=CUT)


@query("spliced_regions", f"""WITH {SPLICED_SQL} SELECT region, status, crossing, n_new AS new_nodes, n_free >= n_new AS interleaved FROM states LEFT JOIN (SELECT DISTINCT region, n_new, n_free FROM ids) USING (region)""")
def spliced_regions(spark, d):
    """Which regions are replaced, or why not."""
    return patched(spark, d).regions


@query("spliced_nodes", f"WITH {SPLICED_SQL} SELECT node, seq FROM own WHERE NOT (inner_ AND region IN (SELECT region FROM gone)) UNION ALL SELECT node, seq FROM made")
def spliced_nodes(spark, d):
    """The nodes that stay and the new ones under their numbers."""
    return patched(spark, d).nodes


@query("spliced_walks", f"""WITH {SPLICED_SQL}, every AS (
  SELECT path, step AS first, 0 AS sub, node, rev FROM steps WHERE NOT (inner_ AND region IN (SELECT region FROM gone))
  UNION ALL SELECT r.path, r.first, CASE WHEN r.rev THEN -m.k ELSE m.k END, m.node, r.rev FROM kinds r JOIN made m USING (region))
SELECT path, row_number() OVER (PARTITION BY path ORDER BY first, sub) AS step, node, rev FROM every""")
def spliced_walks(spark, d):
    """Walks with the candidate's nodes in place of a region's."""
    return patched(spark, d).steps


@query("spliced_edges", f"""WITH {SPLICED_SQL}, every AS (
  SELECT path, step AS first, 0 AS sub, node, rev FROM steps WHERE NOT (inner_ AND region IN (SELECT region FROM gone))
  UNION ALL SELECT r.path, r.first, CASE WHEN r.rev THEN -m.k ELSE m.k END, m.node, r.rev FROM kinds r JOIN made m USING (region)),
e AS (SELECT node AS a, rev AS ar, lead(node) OVER w AS b, lead(rev) OVER w AS br FROM every WINDOW w AS (PARTITION BY path ORDER BY first, sub))
SELECT DISTINCT CASE WHEN (a, ar) <= (b, NOT br) THEN a ELSE b END AS src, CASE WHEN (a, ar) <= (b, NOT br) THEN ar ELSE NOT br END AS src_rev,
       CASE WHEN (a, ar) <= (b, NOT br) THEN b ELSE a END AS dst, CASE WHEN (a, ar) <= (b, NOT br) THEN br ELSE NOT ar END AS dst_rev FROM e WHERE b IS NOT NULL""")
def spliced_edges(spark, d):
    """Edges of the spliced graph, each in one of its two directions."""
    return patched(spark, d).edges
