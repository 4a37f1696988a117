"""Genotype queries: lines of a supplier as reads of a region, with four alleles."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators import genotypes as G
from braidwork.queries.base import query, table
from braidwork.queries.paths import STEP_ORDER

SCALE, READ_LENGTH = 1.5, 150

READS_SQL = """reads AS (SELECT l_suppkey AS region, l_partkey, l_linenumber, l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS read FROM lineitem),
scores AS (SELECT region, read, k AS allele, ((l_partkey * (k + 1) + l_linenumber) % 7)::DOUBLE AS d, 0.01::DOUBLE + (l_partkey % 5) / 100.0::DOUBLE AS e FROM reads, (VALUES (0), (1), (2), (3)) v(k)),
lengths AS (SELECT DISTINCT region, k AS allele, 100 + region * (k + 3) % 50 AS len FROM reads, (VALUES (0), (1), (2), (3)) v(k)), depths AS (SELECT DISTINCT region, 0.05::DOUBLE * (region % 4) AS kappa FROM reads),
pairs AS (SELECT a.region, a.allele AS i, b.allele AS j, a.d AS x, b.d AS y, a.e FROM scores a JOIN scores b ON a.region = b.region AND a.read = b.read AND a.allele <= b.allele)"""


def reads(spark, d):
    """(scores: region, read, allele, d, e; lengths; depths)."""
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    read = F.col("l_orderkey") * 100 + F.row_number().over(W.partitionBy("l_orderkey").orderBy(*STEP_ORDER))
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("region"), read.alias("read"), part, line)
    k = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("allele")
    a = F.col("allele")
    scores = rows.select("region", "read", "l_partkey", "l_linenumber", k).select("region", "read", "allele", ((part * (a + 1) + line) % 7).cast("double").alias("d"), (0.01 + (part % 5) / 100.0).alias("e"))
    regions = rows.select("region").distinct()
    lengths = regions.select("region", k).withColumn("len", 100 + F.col("region") * (a + 3) % 50)
    return scores, lengths, regions.select("region", (0.05 * (F.col("region") % 4)).alias("kappa"))


RANKED = "QUALIFY row_number() OVER (PARTITION BY region ORDER BY round(ll, 9) DESC, i, j) = 1"


@query("rescored_pairs", f"""WITH {READS_SQL}, s AS (SELECT region, i, j, count(*)::BIGINT AS reads, sum(greatest(-{SCALE}::DOUBLE * x, -{SCALE}::DOUBLE * y) + ln(0.5::DOUBLE * exp(-{SCALE}::DOUBLE * x - greatest(-{SCALE}::DOUBLE * x, -{SCALE}::DOUBLE * y)) + 0.5::DOUBLE * exp(-{SCALE}::DOUBLE * y - greatest(-{SCALE}::DOUBLE * x, -{SCALE}::DOUBLE * y)))) AS fit FROM pairs GROUP BY ALL),
m AS (SELECT s.*, kappa, kappa * (a.len + b.len + 2 * ({READ_LENGTH} - 1)) AS mu FROM s JOIN lengths a ON a.region = s.region AND a.allele = i JOIN lengths b ON b.region = s.region AND b.allele = j JOIN depths p ON p.region = s.region),
l AS (SELECT region, i::INT AS i, j::INT AS j, reads, fit + CASE WHEN kappa > 0 THEN reads * ln(mu) - mu - lgamma(reads + 1) ELSE 0 END AS ll FROM m) SELECT region, i, j, round(ll, 4) AS ll, reads FROM l {RANKED}""")
def rescored_pairs(spark, d):
    """The pair of alleles of the greatest likelihood with its depth term."""
    scores, lengths, depths = reads(spark, d)
    return G.best_pairs(G.pair_likelihoods(scores, lengths, depths, SCALE, READ_LENGTH)).withColumn("ll", F.round("ll", 4))


@query("mixture_pairs", f"""WITH {READS_SQL}, w AS (SELECT p.*, a.len::DOUBLE / (a.len + b.len) AS w, exp(-x) AS rx, exp(-y) AS ry FROM pairs p JOIN lengths a ON a.region = p.region AND a.allele = i JOIN lengths b ON b.region = p.region AND b.allele = j),
f AS (SELECT region, i, j, sum(ln((1 - e) * (0.5::DOUBLE * rx + 0.5::DOUBLE * ry) + e)) AS ll FROM w GROUP BY ALL), v AS (SELECT region, i, j, sum(ln((1 - e) * (w * rx + (1 - w) * ry) + e)) AS ll FROM w GROUP BY ALL)
SELECT region, f.i::INT AS flat_i, f.j::INT AS flat_j, v.i::INT AS weighted_i, v.j::INT AS weighted_j, f.i <> v.i OR f.j <> v.j AS differ FROM (SELECT * FROM f {RANKED}) f JOIN (SELECT * FROM v {RANKED}) v USING (region)""")
def mixture_pairs(spark, d):
    """The best pair under a mixture of halves and under one by lengths."""
    scores, lengths, _ = reads(spark, d)
    rel = scores.withColumn("rel", F.exp(-F.col("d")))
    best = lambda ll: F.max_by(F.struct("i", "j"), F.struct(F.round(ll, 9).alias("a"), (-F.col("i")).alias("b"), (-F.col("j")).alias("c")))
    both = G.mixture_fits(rel, lengths).groupBy("region").agg(best("flat").alias("f"), best("weighted").alias("w"))
    both = both.select("region", F.col("f.i").alias("flat_i"), F.col("f.j").alias("flat_j"), F.col("w.i").alias("weighted_i"), F.col("w.j").alias("weighted_j"))
    return both.withColumn("differ", (F.col("flat_i") != F.col("weighted_i")) | (F.col("flat_j") != F.col("weighted_j")))
