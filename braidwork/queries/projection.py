"""Queries of walks on other graphs: a brand's parts as the reference walk of a region, reads as pieces of it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators import projection as J
from braidwork.queries.base import query, table
from braidwork.queries.paths import STEPS_SQL, order_steps

FLANK = 90

#: The middle third of a brand's parts is inside. A read begins at each part and goes on over up to five, along or against the
#: reference; a step of some is turned round (every eleventh read) or leads to a part that is not there (every thirteenth).
READS_SQL = f"""ranked AS (
  SELECT p_brand AS region, p_partkey AS node, p_size::BIGINT AS len, p_partkey % 7 = 0 AS r_rev, row_number() OVER w AS place, count(*) OVER (PARTITION BY p_brand) AS n,
         (sum(p_size) OVER w - p_size)::BIGINT AS r_start, (sum(p_size) OVER w)::BIGINT AS r_end FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
inner_nodes AS (SELECT region, node, len FROM ranked WHERE place * 3 > n AND place * 3 <= n * 2),
spans AS (SELECT region, min(r_start) AS a0, max(r_end) AS b0 FROM ranked JOIN inner_nodes USING (region, node) GROUP BY region),
pieces AS (
  SELECT a.region, a.node AS read, CASE WHEN a.node % 2 = 0 THEN b.place - a.place ELSE 10 - (b.place - a.place) END AS step,
         CASE WHEN a.node % 13 = 0 AND b.place = a.place + 1 THEN -b.node ELSE b.node END AS node,
         (b.r_rev <> (a.node % 2 = 1)) <> (a.node % 11 = 0 AND b.place = a.place) AS rev, b.len
  FROM ranked a JOIN ranked b ON a.region = b.region AND b.place >= a.place AND b.place <= a.place + a.node % 5),
aligned AS (SELECT region, read, read % 3 AS ps, sum(len)::BIGINT - read % 4 AS pe, sum(len)::BIGINT AS plen FROM pieces GROUP BY region, read)"""

JUDGED_SQL = f"""{READS_SQL}, marked AS (
  SELECT p.*, i.len AS in_len, r.r_start, r.r_end, r.r_rev FROM pieces p LEFT JOIN inner_nodes i ON i.region = p.region AND i.node = p.node LEFT JOIN ranked r ON r.region = p.region AND r.node = p.node),
bounds AS (SELECT region, read, min(step) AS i, max(step) AS j, sum(in_len)::BIGINT AS in_len FROM marked WHERE in_len IS NOT NULL GROUP BY region, read),
sided AS (
  SELECT m.*, CASE WHEN m.in_len IS NOT NULL THEN 'in' WHEN b.i IS NULL OR m.step < b.i THEN 'lead' WHEN m.step > b.j THEN 'trail' ELSE 'within' END AS side FROM marked m LEFT JOIN bounds b USING (region, read)),
parts AS (
  SELECT region, read, side, count(*) AS n, count(*) FILTER (r_start IS NULL) AS unknown, min(r_start) AS lo, arg_max(r_end, {{'a': r_start, 'b': r_end}}) AS hi, sum(r_end - r_start)::BIGINT AS size,
         bool_and(rev = r_rev) AS along, bool_and(rev <> r_rev) AS against FROM sided WHERE side IN ('lead', 'trail') GROUP BY ALL),
flanked AS (
  SELECT p.*, s.a0, s.b0, CASE WHEN hi = a0 AND size <= {FLANK} THEN 'left' WHEN lo = b0 AND size <= {FLANK} THEN 'right' WHEN b.i IS NULL AND lo >= a0 - {FLANK} AND hi <= a0 THEN 'left'
         WHEN b.i IS NULL AND lo >= b0 AND hi <= b0 + {FLANK} THEN 'right' END AS flank FROM parts p JOIN spans s USING (region) LEFT JOIN bounds b USING (region, read)),
turned AS (
  SELECT *, CASE WHEN unknown > 0 THEN 'off_reference' WHEN NOT (along OR against) OR size <> hi - lo THEN 'not_colinear' WHEN flank IS NULL THEN 'beyond_flank' END AS bad,
         CASE WHEN along THEN lo - CASE flank WHEN 'left' THEN a0 - {FLANK} ELSE b0 END ELSE CASE flank WHEN 'left' THEN a0 ELSE b0 + {FLANK} END - hi END AS before FROM flanked),
moved AS (
  SELECT a.region, a.read, l.read IS NOT NULL OR t.read IS NOT NULL AS changed, ps + coalesce(l.before, 0) AS ps, pe + coalesce(l.before, 0) AS pe, l.bad AS lead_bad, t.bad AS trail_bad,
         CASE WHEN l.read IS NOT NULL OR t.read IS NOT NULL THEN coalesce(b.in_len, 0) + CASE WHEN l.read IS NOT NULL THEN {FLANK} ELSE 0 END + CASE WHEN t.read IS NOT NULL THEN {FLANK} ELSE 0 END ELSE plen END AS plen,
         EXISTS (SELECT 1 FROM sided x WHERE x.region = a.region AND x.read = a.read AND x.side = 'within') AS within
  FROM aligned a LEFT JOIN bounds b USING (region, read) LEFT JOIN turned l ON l.region = a.region AND l.read = a.read AND l.side = 'lead' LEFT JOIN turned t ON t.region = a.region AND t.read = a.read AND t.side = 'trail'),
verdicts AS (
  SELECT *, CASE WHEN within THEN 'outside_within' ELSE coalesce(lead_bad, trail_bad, CASE WHEN NOT coalesce(ps >= 0 AND ps <= pe AND pe <= plen, false) THEN 'bad_offsets' END, CASE WHEN changed THEN 'projected' ELSE 'kept' END) END AS verdict FROM moved)"""


def reads(spark, d):
    """(alignments, steps, inside, reference, regions)."""
    by = W.partitionBy("region")
    at = by.orderBy("node")
    p = table(spark, d, "part").select(F.col("p_brand").alias("region"), F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("len"))
    ranked = p.select("*", (F.col("node") % 7 == 0).alias("r_rev"), F.row_number().over(at).alias("place"), F.count("*").over(by).alias("n"), F.sum("len").over(at).alias("r_end")).withColumn("r_start", F.col("r_end") - F.col("len"))
    inside = ranked.where("place * 3 > n AND place * 3 <= n * 2")
    regions = inside.groupBy("region").agg(F.min("r_start").alias("a0"), F.max("r_end").alias("b0"))
    regions = regions.select("*", F.lit(-1).cast("long").alias("left"), F.lit(FLANK).cast("long").alias("left_len"), F.lit(-2).cast("long").alias("right"), F.lit(FLANK).cast("long").alias("right_len"))
    a = ranked.select("region", F.col("node").alias("read"), F.col("place").alias("from_"), F.explode(F.sequence(F.lit(0), (F.col("node") % 5).cast("int"))).alias("k"))
    met = a.withColumn("place", F.col("from_") + F.col("k")).join(ranked.select("region", "node", "len", "r_rev", "place"), ["region", "place"])
    against = F.col("read") % 2 == 1
    steps = met.select(
        "region", "read", F.when(against, 10 - F.col("k")).otherwise(F.col("k")).cast("long").alias("step"),
        F.when((F.col("read") % 13 == 0) & (F.col("k") == 1), -F.col("node")).otherwise(F.col("node")).alias("node"),
        ((F.col("r_rev") != against) != ((F.col("read") % 11 == 0) & (F.col("k") == 0))).alias("rev"), "len",
    )
    total = F.sum("len")
    alignments = steps.groupBy("region", "read").agg(total.alias("plen")).select("region", "read", (F.col("read") % 3).alias("ps"), (F.col("plen") - F.col("read") % 4).alias("pe"), "plen")
    return alignments, steps.drop("len"), inside.select("region", "node", "len"), ranked.select("region", "node", "r_start", "r_end", "r_rev"), regions


@query("projected_alignments", f"WITH {JUDGED_SQL} SELECT region, read, verdict, CASE WHEN verdict IN ('kept', 'projected') THEN ps END AS ps, CASE WHEN verdict IN ('kept', 'projected') THEN pe END AS pe, CASE WHEN verdict IN ('kept', 'projected') THEN plen END AS plen FROM verdicts")
def projected_alignments(spark, d):
    """What becomes of each alignment in the local graph, and its offsets there."""
    return J.projected(*reads(spark, d))[0]


@query("projected_steps", f"""WITH {JUDGED_SQL}, every AS (
  SELECT region, read, 0 AS side, step AS nth, node, rev FROM sided JOIN verdicts USING (region, read) WHERE side = 'in' AND verdict IN ('kept', 'projected')
  UNION ALL SELECT region, read, CASE side WHEN 'lead' THEN -1 ELSE 1 END, 0, CASE flank WHEN 'left' THEN -1 ELSE -2 END, NOT along FROM turned JOIN verdicts USING (region, read) WHERE verdict IN ('kept', 'projected'))
SELECT region, read, row_number() OVER (PARTITION BY region, read ORDER BY side, nth) AS step, node, rev FROM every""")
def projected_steps(spark, d):
    """The walks of those that are carried over."""
    return J.projected(*reads(spark, d))[1].withColumn("step", F.col("step").cast("long"))


@query("walks_on_nodes", f"WITH {STEPS_SQL} SELECT path, step, node FROM steps s WHERE NOT EXISTS (SELECT 1 FROM steps t JOIN part ON p_partkey = t.node WHERE t.path = s.path AND p_size > 40)")
def walks_on_nodes(spark, d):
    """Orders that nowhere leave the parts of size 40 or less."""
    nodes = table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("node"))
    return J.wholly_on(order_steps(spark, d), nodes, "path").select("path", F.col("step").cast("long").alias("step"), "node")
