"""Queries over records: orders nested by their parts, lines as calls of two sources."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators import haplotypes as H
from braidwork.operators import panels as P
from braidwork.operators import records as R
from braidwork.queries.base import query, table
from braidwork.queries.paths import order_steps


def days(column):
    return F.datediff(F.col(column), F.lit("1970-01-01").cast("date")).cast("long")


def order_records(spark, d):
    """(records: id, pos, end; pairs: child, parent): orders as records, nested by their first and last parts."""
    steps = order_steps(spark, d)
    bounds = steps.groupBy("path").agg(F.min_by("node", "step").alias("left"), F.max_by("node", "step").alias("right"), F.max("step").alias("last"))
    inside = steps.join(bounds.select("path", "last"), "path").where("step > 1 AND step < last").select(F.col("path").alias("id"), "node")
    pairs = P.nested(bounds.select(F.col("path").alias("id"), "left", "right"), inside)
    at = days("o_orderdate")
    records = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), at.alias("pos"), (at + F.col("o_custkey") % 90).alias("end"))
    return records, pairs


@query("nesting_order")
def nesting_order(spark, d):
    """Orders by day, longest first, none before one that holds it."""
    return R.nesting_order(*order_records(spark, d))


CALLS_SQL = """numbered AS (
  SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS id,
         l_suppkey AS region, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'stvar' ELSE 'smvar' END AS source, l_returnflag, l_linenumber,
         date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS day, (l_partkey % 7 * 4)::BIGINT AS size FROM lineitem),
calls AS (
  SELECT id, region, source, day + CASE source WHEN 'stvar' THEN 0 ELSE 700 END AS pos, day + size + CASE source WHEN 'stvar' THEN 0 ELSE 700 END AS "end", repeat('A', 1 + size) AS ref,
         [CASE l_partkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'CC' ELSE '*' END, CASE l_partkey % 4 WHEN 0 THEN '<DEL>' WHEN 1 THEN 'G[x:1[' ELSE 'T' END] AS alts,
         CASE WHEN l_linenumber % 5 = 0 THEN [(l_partkey % 3)::INT] ELSE [(l_partkey % 3)::INT, (l_linenumber % 3)::INT] END AS gt, day >= 8200 AND day + size <= 10800 AS within
  FROM numbered),
each AS (SELECT c.*, h.hap, gt[h.hap] AS called, alts[nullif(gt[h.hap], 0)] AS alt FROM calls c, (VALUES (1), (2)) h(hap)),
marked AS (
  SELECT *, CASE WHEN called IS NULL THEN 'no:missing_gt' WHEN called = 0 THEN 'ref' WHEN alt = '*' THEN 'no:star_allele'
                 WHEN regexp_matches(alt, '^<|[\\[\\]]') THEN 'no:symbolic' WHEN NOT within THEN 'no:crosses_span_edge' END AS applied FROM each),
"""

#: Greedy trials: from the first of a group, each row taken names the next by its end.
CHOSEN_SQL = f"""WITH RECURSIVE {CALLS_SQL}
t1 AS (SELECT * FROM marked WHERE applied IS NULL AND source = 'stvar'),
s1 AS (SELECT * FROM t1 QUALIFY row_number() OVER (PARTITION BY region, hap, pos ORDER BY "end", id) = 1),
n1 AS MATERIALIZED (SELECT a.region, a.hap, a.id, arg_min(b.id, b.pos) AS next FROM s1 a JOIN s1 b ON a.region = b.region AND a.hap = b.hap AND a."end" < b.pos GROUP BY ALL),
k1 AS (SELECT region, hap, id FROM s1 QUALIFY row_number() OVER (PARTITION BY region, hap ORDER BY pos) = 1 UNION ALL SELECT k.region, k.hap, n.next FROM k1 k JOIN n1 n ON n.region = k.region AND n.hap = k.hap AND n.id = k.id),
y1 AS (SELECT t1.* FROM t1 JOIN k1 USING (region, hap, id)),
j2 AS (SELECT m.*, EXISTS (SELECT 1 FROM y1 y WHERE y.region = m.region AND y.hap = m.hap AND y.pos = m.pos AND y.ref = m.ref AND y.alt = m.alt) AS same,
              EXISTS (SELECT 1 FROM y1 y WHERE y.region = m.region AND y.hap = m.hap AND y.pos <= m."end" AND m.pos <= y."end") AS held FROM marked m WHERE m.applied IS NULL AND m.source = 'smvar'),
t2 AS (SELECT * FROM j2 WHERE NOT same AND NOT held),
s2 AS (SELECT * FROM t2 QUALIFY row_number() OVER (PARTITION BY region, hap, pos ORDER BY "end", id) = 1),
n2 AS MATERIALIZED (SELECT a.region, a.hap, a.id, arg_min(b.id, b.pos) AS next FROM s2 a JOIN s2 b ON a.region = b.region AND a.hap = b.hap AND a."end" < b.pos GROUP BY ALL),
k2 AS (SELECT region, hap, id FROM s2 QUALIFY row_number() OVER (PARTITION BY region, hap ORDER BY pos) = 1 UNION ALL SELECT k.region, k.hap, n.next FROM k2 k JOIN n2 n ON n.region = k.region AND n.hap = k.hap AND n.id = k.id),
y2 AS (SELECT t2.* FROM t2 JOIN k2 USING (region, hap, id))
SELECT region, id, source, hap, applied FROM marked WHERE applied IS NOT NULL
UNION ALL SELECT region, id, source, hap, CASE WHEN EXISTS (SELECT 1 FROM y1 WHERE y1.region = t1.region AND y1.hap = t1.hap AND y1.id = t1.id) THEN 'yes' ELSE 'no:overlaps_applied_stvar' END FROM t1
UNION ALL SELECT region, id, source, hap, CASE WHEN same THEN 'no:duplicate_of_stvar' ELSE 'no:overlaps_applied_stvar' END FROM j2 WHERE same OR held
UNION ALL SELECT region, id, source, hap, CASE WHEN EXISTS (SELECT 1 FROM y2 WHERE y2.region = t2.region AND y2.hap = t2.hap AND y2.id = t2.id) THEN 'yes'
  WHEN EXISTS (SELECT 1 FROM y2 WHERE y2.region = t2.region AND y2.hap = t2.hap AND y2.pos = t2.pos AND y2.ref = t2.ref AND y2.alt = t2.alt) THEN 'no:duplicate_of_stvar' ELSE 'no:overlaps_applied_smvar' END FROM t2"""


def calls(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    part, size = F.col("l_partkey"), (F.col("l_partkey") % 7 * 4).cast("long")
    first = F.col("l_linestatus") == "O"
    day = days("l_shipdate")
    pos = day + F.when(first, 0).otherwise(700)
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 100 + number).alias("id"), F.col("l_suppkey").alias("region"), F.when(first, "stvar").otherwise("smvar").alias("source"),
        pos.alias("pos"), (pos + size).alias("end"), F.repeat(F.lit("A"), (size + 1).cast("int")).alias("ref"),
        F.array(F.when(part % 3 == 0, "C").when(part % 3 == 1, "CC").otherwise("*"), F.when(part % 4 == 0, "<DEL>").when(part % 4 == 1, "G[x:1[").otherwise("T")).alias("alts"),
        F.when(F.col("l_linenumber") % 5 == 0, F.array((part % 3).cast("int"))).otherwise(F.array((part % 3).cast("int"), (F.col("l_linenumber") % 3).cast("int"))).alias("gt"),
        ((day >= 8200) & (day + size <= 10800)).alias("within"),
    )


@query("chosen_truth", CHOSEN_SQL)
def chosen_truth(spark, d):
    """Which calls of two sources are applied on each haplotype, the second filling only where the first leaves room."""
    return R.chosen_truth(calls(spark, d), "region")


#: Spans of 31 bases of a reference that repeats ten; alleles that delete, insert, replace, or can't be applied.
ALLELES_SQL = """n AS (SELECT id, l_partkey AS part, day AS pos, day // 40 * 40 + 5 AS low, day // 40 * 40 + 35 AS high, substr(repeat('ACGTTGCAAC', 6), day % 10 + 1, 1 + l_partkey % 26) AS base FROM numbered),
alleles AS (SELECT id, pos, low, high, substr(repeat('ACGTTGCAAC', 8), low % 10 + 1, 31) AS refseq, CASE WHEN part % 17 = 0 THEN substr(base, 1, 1) || 'N' || substr(base, 3) ELSE base END AS ref,
  CASE part % 9 WHEN 0 THEN substr(base, 1, 1) WHEN 1 THEN base || 'GT' WHEN 2 THEN 'TC' WHEN 3 THEN '*' WHEN 4 THEN '<DEL>' WHEN 5 THEN substr(base, 1, 1) || 'TTG' || substr(base, 2) WHEN 6 THEN substr(base, 1, 2) || 'GGGTTTGGG' WHEN 7 THEN base END AS alt FROM n),
tail AS (SELECT *, coalesce(alt, '') AS alt0, len(list_filter(range(1, least(length(ref), length(coalesce(alt, ''))) + 1), lambda x: right(ref, x) = right(alt, x))) AS k FROM alleles),
head AS (SELECT *, left(ref, length(ref) - k) AS r1, left(alt0, length(alt0) - k) AS a1 FROM tail),
cut AS (SELECT *, len(list_filter(range(1, least(length(r1), length(a1)) + 1), lambda x: left(r1, x) = left(a1, x))) AS j FROM head),
t AS (SELECT *, pos + j AS s, pos + length(r1) AS e, substr(r1, j + 1) AS tr, substr(a1, j + 1) AS ta, pos + length(ref) - 1 AS last, pos >= low AND pos + length(ref) - 1 <= high AS inside FROM cut),
judged AS (SELECT *, CASE WHEN alt IS NULL THEN 'no_allele' WHEN alt = '*' THEN 'star' WHEN NOT regexp_full_match(alt, '[ACGTN]+') THEN 'symbolic'
  WHEN greatest(pos, low) <= least(last, high) AND substr(ref, greatest(pos, low) - pos + 1, least(last, high) - greatest(pos, low) + 1) <> substr(refseq, greatest(pos, low) - low + 1, least(last, high) - greatest(pos, low) + 1) THEN 'ref_mismatch'
  WHEN inside THEN 'ok' WHEN s = e THEN CASE WHEN low < s AND s <= high THEN 'ok' ELSE 'edge_insertion' END WHEN e - 1 < low OR s > high THEN 'outside' ELSE 'ok' END AS effect,
  CASE WHEN inside OR s = e THEN 0 ELSE greatest(low - s, 0) END AS l, CASE WHEN inside OR s = e THEN 0 ELSE greatest(e - 1 - high, 0) END AS r FROM t)"""


@query("allele_effects", f"""WITH {CALLS_SQL.split("calls AS")[0]} {ALLELES_SQL}
SELECT id, effect, effect = 'ok' AND (l > 0 OR r > 0) AS crossing, CASE WHEN effect = 'ok' THEN s + l END AS pos, CASE WHEN effect = 'ok' THEN substr(tr, l + 1, length(tr) - l - r) END AS ref,
       CASE WHEN effect = 'ok' THEN substr(ta, l + 1, greatest(length(ta) - l - r, 0)) END AS alt FROM judged""")
def allele_effects(spark, d):
    """What each allele changes of a span, clipped at its edges, or why it can't."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    number = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    n = table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + number).alias("id"), F.col("l_partkey").alias("part"), days("l_shipdate").alias("pos"))
    pos, part = F.col("pos"), F.col("part")
    n = n.withColumn("low", F.floor(pos / 40) * 40 + 5).withColumn("base", F.substr(F.repeat(F.lit("ACGTTGCAAC"), F.lit(6)), (pos % 10 + 1).cast("int"), (1 + part % 26).cast("int")))
    base, first = F.col("base"), F.substr(F.col("base"), F.lit(1), F.lit(1))
    alts = [first, F.concat(base, F.lit("GT")), F.lit("TC"), F.lit("*"), F.lit("<DEL>"), F.concat(first, F.lit("TTG"), F.substr(base, F.lit(2))), F.concat(F.substr(base, F.lit(1), F.lit(2)), F.lit("GGGTTTGGG")), base]
    ref = F.when(part % 17 == 0, F.concat(first, F.lit("N"), F.substr(base, F.lit(3)))).otherwise(base)
    refseq = F.substr(F.repeat(F.lit("ACGTTGCAAC"), F.lit(8)), (F.col("low") % 10 + 1).cast("int"), F.lit(31))
    a = n.select("id", "pos", "low", ref.alias("ref"), F.get(F.array(*alts), (part % 9).cast("int")).alias("alt"), refseq.alias("refseq"))
    effect = H.allele_effect(F.col("pos"), F.col("ref"), F.col("alt"), F.col("low"), F.col("low") + 30, F.col("refseq"))
    return a.select("id", effect.alias("x")).select("id", "x.*")
