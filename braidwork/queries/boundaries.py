"""Boundary queries: a brand's parts as the reference walk of a contig, line numbers as haplotypes, parts' surroundings as regions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators import boundaries as B
from braidwork.queries.base import query, table

WIDTH, MOST = 50, 400

#: A line number walks each part that has such a line once, and again with the highest discount and tax. Every eighth part holds a truth record.
CONTIGS_SQL = """reference AS (SELECT p_brand AS contig, p_partkey AS node, (sum(p_size) OVER w - p_size)::BIGINT AS start, (sum(p_size) OVER w)::BIGINT AS stop FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)),
visits AS (SELECT DISTINCT l_linenumber AS path, l_partkey AS node, 0 AS again FROM lineitem UNION ALL SELECT l_linenumber, l_partkey, 1 FROM lineitem WHERE l_discount >= 0.095 AND l_tax >= 0.075),
covered AS (SELECT node, sum(n)::BIGINT AS cov, max(n)::BIGINT AS most FROM (SELECT node, path, count(*) AS n FROM visits GROUP BY ALL) GROUP BY node),
lengths AS (SELECT contig, max(stop) AS length FROM reference GROUP BY contig),
nodes AS (SELECT contig, r.node, start, stop, coalesce(cov, 0) AS cov, coalesce(most, 0) <= 1 AND r.node % 8 <> 3 AS eligible FROM reference r LEFT JOIN covered c ON c.node = r.node),
regions AS (SELECT node AS region, contig, start AS a0, stop + 40 AS b0 FROM reference)"""


def chosen_sql(fallback: bool) -> str:
    good = "true" if fallback else "cov = h"
    ends = "false" if fallback else "true"
    return f"""WITH {CONTIGS_SQL}, tries AS (SELECT r.*, l.length, w AS width, greatest(a0 - w, 0) AS lo, least(b0 + w, length) AS hi FROM regions r JOIN lengths l USING (contig), (VALUES (50), (100), (200), (400)) v(w)),
met AS (SELECT t.region, t.width, a0, b0, lo, hi, length, n.* EXCLUDE (contig), max(cov) OVER (PARTITION BY t.region, t.width) AS h FROM tries t JOIN nodes n ON n.contig = t.contig AND n.start < t.hi AND n.stop > t.lo),
found AS (SELECT region, width, any_value(h) AS h, any_value(lo) = 0 AS low_end, any_value(hi) = any_value(length) AS high_end,
  arg_max(node, {{'c': cov, 's': stop}}) FILTER (eligible AND stop <= a0 AND {good}) AS l, arg_max(node, {{'c': cov, 's': -start}}) FILTER (eligible AND start >= b0 AND {good}) AS r, arg_min(node, start) AS first, arg_max(node, stop) AS last FROM met GROUP BY region, width),
ended AS (SELECT *, {ends} AND l IS NULL AND low_end AND first IS NOT NULL AS at_start, {ends} AND r IS NULL AND high_end AND last IS NOT NULL AS at_end FROM (SELECT t.region, t.width, f.* EXCLUDE (region, width, low_end, high_end), lo = 0 AS low_end, hi = length AS high_end FROM tries t LEFT JOIN found f USING (region, width))),
sided AS (SELECT *, coalesce(l, CASE WHEN at_start THEN first END) AS left_, coalesce(r, CASE WHEN at_end THEN last END) AS right_ FROM ended),
best AS (SELECT * FROM sided WHERE left_ IS NOT NULL AND right_ IS NOT NULL OR low_end AND high_end OR width = 400 QUALIFY row_number() OVER (PARTITION BY region ORDER BY width) = 1)
SELECT region, width, CASE WHEN right_ IS NOT NULL THEN left_ END AS left, CASE WHEN left_ IS NOT NULL THEN right_ END AS right, h, at_start, at_end FROM best"""


def contigs(spark, d):
    """(regions, eligible nodes, lengths)."""
    at = W.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, d, "part").select(F.col("p_brand").alias("contig"), F.col("p_partkey").alias("node"), F.col("p_size").cast("long").alias("len"), F.sum(F.col("p_size").cast("long")).over(at).alias("end"))
    reference = p.select("contig", "node", (F.col("end") - F.col("len")).alias("start"), "end")
    line = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("path"), F.col("l_partkey").alias("node"), "l_discount", "l_tax")
    visits = line.select("path", "node").distinct().unionByName(line.where("l_discount >= 0.095 AND l_tax >= 0.075").select("path", "node"))
    truth = p.where("node % 8 = 3").select("contig", (F.col("end") - F.col("len") + 1).alias("pos"), (F.col("end") - F.col("len") + 1).alias("stop"))
    lengths = reference.groupBy("contig").agg(F.max("end").alias("length"))
    regions = reference.select(F.col("node").alias("region"), "contig", F.col("start").alias("a0"), (F.col("end") + 40).alias("b0"))
    return regions, B.eligible_nodes(reference, B.coverage(visits), truth), lengths


@query("node_coverage", f"WITH {CONTIGS_SQL} SELECT contig, node, start, stop AS \"end\", cov, eligible FROM nodes")
def node_coverage(spark, d):
    """Coverage of reference nodes and which may be anchors."""
    return contigs(spark, d)[1]


@query("boundary_choice", chosen_sql(False))
def boundary_choice(spark, d):
    """Anchors of each region, in windows doubled while a side lacks one."""
    return B.boundaries(*contigs(spark, d), WIDTH, MOST)


@query("fallback_anchors", chosen_sql(True))
def fallback_anchors(spark, d):
    """The best covered nodes on both sides."""
    return B.boundaries(*contigs(spark, d), WIDTH, MOST, fallback=True)
