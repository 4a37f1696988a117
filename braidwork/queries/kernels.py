"""Kernel queries: alignments, distances and clusterings of small groups, one group a task."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions.sequences import pair_cost
from braidwork.operators import align as A
from braidwork.operators import haplotypes as H
from braidwork.operators import kernels as K
from braidwork.operators import medoids as D
from braidwork.operators import trees as T
from braidwork.queries.base import query, table


def brand_names(spark, d):
    return table(spark, d, "part").select("p_brand", "p_name").distinct()


def brand_pairs(spark, d):
    u = brand_names(spark, d)
    return u.select("p_brand", F.col("p_name").alias("a")).join(u.select(F.col("p_brand").alias("brand_b"), F.col("p_name").alias("b")), (F.col("p_brand") == F.col("brand_b")) & (F.col("a") < F.col("b"))).select("p_brand", "a", "b")


@query("bit_parallel_edit", """WITH u AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT a.p_brand, a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::BIGINT AS cost FROM u a JOIN u b ON a.p_brand = b.p_brand AND a.p_name < b.p_name""")
def bit_parallel_edit(spark, d):
    """each distinct pair once."""
    return K.distinct_apply(brand_pairs(spark, d), "a", "b", "cost", K.edit_distance)


@query("affine_cost")
def affine_cost(spark, d):
    """F4, A6."""
    return K.distinct_apply(brand_pairs(spark, d), "a", "b", "cost", K.affine_cost)


@query("semi_global")
def semi_global(spark, d):
    """part names as reads, their neighbours twice over as texts."""
    p = brand_pairs(spark, d).withColumn("text", F.concat("b", F.lit("-"), "b"))
    return K.distinct_apply(p, "a", "text", "cost", K.semi_global, symmetric=False)


@query("pairwise_cigars")
def pairwise_cigars(spark, d):
    """alignments of neighbouring names and their cost by two gap pieces."""

    def run(batches):
        for pdf in batches:
            cigars = [K.align(a, b) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            rows = [K.aligned_rows(a, b, c) for a, b, c in zip(pdf["a"], pdf["b"], cigars, strict=True)]
            yield pdf.assign(cigar=cigars, row_a=[r[0] for r in rows], row_b=[r[1] for r in rows])

    made = brand_pairs(spark, d).mapInPandas(run, "p_brand string, a string, b string, cigar string, row_a string, row_b string")
    return made.withColumn("cost", pair_cost(F.col("row_a"), F.col("row_b")))


@query("dag_distance")
def dag_distance(spark, d):
    """Each brand's names as a two-branch graph, and every name against it."""

    def run(pdf):
        names = sorted(pdf["p_name"])
        nodes = [names[0][:3], *names[:4], names[-1][-3:]]
        edges = [(0, i) for i in range(1, len(nodes) - 1)] + [(i, len(nodes) - 1) for i in range(1, len(nodes) - 1)]
        found = [K.dag_distance(n, nodes, edges, [0], [len(nodes) - 1]) for n in names]
        return pd.DataFrame({"p_name": names, "distance": [f[0] for f in found], "walk": [f[1] for f in found]})

    return K.grouped(brand_names(spark, d), "p_brand", "p_name string, distance long, walk array<int>", run)


def aligned(spark, d, method):
    def run(pdf):
        names = sorted(pdf["p_name"])
        status, rows = A.realigned(names, A.METHODS[method])
        return pd.DataFrame({"p_name": names, "aligned": rows or [None] * len(names), "status": status})

    return K.grouped(brand_names(spark, d), "p_brand", "p_name string, aligned string, status string", run)


@query("star_alignment")
def star_alignment(spark, d):
    """Stars around the medoid."""
    return aligned(spark, d, "star")


@query("threaded_alignment")
def threaded_alignment(spark, d):
    """Threading along a spanning tree."""
    return aligned(spark, d, "threaded")


@query("gap_normalised")
def gap_normalised(spark, d):
    """gap runs moved left, one by one and together."""

    def run(pdf):
        rows = A.realigned(sorted(pdf["p_name"]))[1]
        alone, moves = A.normalise(rows)
        joint, moved = A.normalise_joint(rows)
        return pd.DataFrame({"before": rows, "alone": alone, "joint": joint, "moves": moves, "moved": moved})

    return K.grouped(brand_names(spark, d), "p_brand", "before string, alone string, joint string, moves long, moved long", run)


@query("medoid_clusters")
def medoid_clusters(spark, d):
    """K-medoids of the vectors of each label."""
    return D.kmedoids(table(spark, d, "embeddings"), "label", "vec_id", "embedding", 4)


@query("spanning_trees")
def spanning_trees(spark, d):
    """Nearest-first trees of the vectors of each label."""
    return T.spanning_trees(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query("average_linkage")
def average_linkage(spark, d):
    """Merges of the names of each brand by edit distance."""

    def run(pdf):
        names = sorted(pdf["p_name"])
        merges = K.average_linkage([[K.edit_distance(a, b) for b in names] for a in names])
        return pd.DataFrame(merges, columns=["a", "b", "height"])

    return K.grouped(brand_names(spark, d), "p_brand", "a long, b long, height double", run)


@query("phase_search")
def phase_search(spark, d):
    """Names as a reference, the next two as the truth, point differences as phased edits."""
    n = lambda k: F.lead("p_name", k).over(W.partitionBy("p_brand").orderBy("p_name"))
    three = brand_names(spark, d).select("p_brand", "p_name", n(1).alias("t1"), n(2).alias("t2")).where("t2 IS NOT NULL")

    def run(batches):
        for pdf in batches:
            found = []
            for ref, a, b in zip(pdf["p_name"], pdf["t1"], pdf["t2"], strict=True):
                blocks = [[((i, 1, t[i]), None)] for t in (a, b) for i in range(min(len(ref), len(t))) if t[i] != ref[i]]
                found.append(H.best_phase(ref, blocks, (a, b))[0])
            yield pdf.assign(distance=found)

    return three.mapInPandas(run, "p_brand string, p_name string, t1 string, t2 string, distance long")


@query("diploid_likelihood", """WITH x AS (SELECT l_partkey, -l_quantity AS a, -l_linenumber::DOUBLE AS b FROM lineitem)
SELECT l_partkey, round(sum(greatest(a, b) + ln(0.5::DOUBLE * exp(a - greatest(a, b)) + 0.5::DOUBLE * exp(b - greatest(a, b)))), 5) AS ll FROM x GROUP BY l_partkey""")
def diploid_likelihood(spark, d):
    """F37, E64, E67."""
    x = table(spark, d, "lineitem").select("l_partkey", (-F.col("l_quantity")).alias("a"), (-F.col("l_linenumber")).cast("double").alias("b"))
    return x.groupBy("l_partkey").agg(F.round(F.sum(H.diploid_log_likelihood(F.col("a"), F.col("b"))), 5).alias("ll"))
