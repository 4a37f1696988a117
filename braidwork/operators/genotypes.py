"""Pairs of alleles that explain reads best: likelihoods from distances with a depth term, and from mixtures of relative ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators.haplotypes import diploid_log_likelihood


def log_factorial(n: Column) -> Column:
    """ln n! of a whole number."""
    return F.when(n > 1, F.aggregate(F.sequence(F.lit(2).cast("bigint"), n.cast("bigint")), F.lit(0.0), lambda a, x: a + F.ln(x.cast("double")))).otherwise(0.0)


def allele_pairs(scores: DataFrame, score: str) -> DataFrame:
    """(region, read, i, j, x, y): every pair i <= j of the alleles of each read, with their scores; scores: region, read, allele, and score.

    A read's alleles come together in one row, as many as its region has, and leave it as pairs, so nothing is joined.
    """
    one = scores.groupBy("region", "read").agg(F.sort_array(F.collect_list(F.struct("allele", F.col(score).cast("double").alias("s")))).alias("all"))
    pair = lambda a, b: F.struct(a["allele"].alias("i"), b["allele"].alias("j"), a["s"].alias("x"), b["s"].alias("y"))
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b["allele"] >= a["allele"]), lambda b: pair(a, b))))
    return one.select("region", "read", F.explode(pairs).alias("p")).select("region", "read", "p.*")


def best_pairs(scored: DataFrame) -> DataFrame:
    """(region, i, j, ll, reads) of the greatest ll, compared to nine decimals; ties to the lesser i, then j."""
    order = F.struct(F.round("ll", 9).alias("a"), (-F.col("i")).alias("b"), (-F.col("j")).alias("c"))
    return scored.groupBy("region").agg(F.max_by(F.struct("i", "j", "ll", "reads"), order).alias("x")).select("region", "x.*")


def pair_likelihoods(distances: DataFrame, lengths: DataFrame, depths: DataFrame, scale: float, read_length: int, depth_weight: float = 1.0) -> DataFrame:
    """(region, i, j, ll, reads): for each pair of alleles, the sum over reads of ln of the mean of exp(-scale * distance) to either, and
    depth_weight times the Poisson term of the number of reads under kappa * (both lengths + 2 * (read_length - 1)).

    distances: region, read, allele (a whole number), d, a row for each read and allele; lengths: region, allele, len; depths: region,
    kappa. Regions without kappa, or of none, have no depth term. Sums are partial before they are shuffled, a row a pair.
    """
    each = allele_pairs(distances.withColumn("e", -F.lit(scale) * F.col("d")), "e")
    sums = each.groupBy("region", "i", "j").agg(F.sum(diploid_log_likelihood(F.col("x"), F.col("y"))).alias("fit"), F.count("*").alias("reads"))
    of = lambda c: lengths.select("region", F.col("allele").alias(c), F.col("len").alias(f"len_{c}"))
    known = sums.join(of("i"), ["region", "i"]).join(of("j"), ["region", "j"]).join(depths, "region", "left")
    mu = F.col("kappa") * (F.col("len_i") + F.col("len_j") + 2 * (read_length - 1))
    depth = F.when(F.col("kappa") > 0, F.col("reads") * F.ln(mu) - mu - log_factorial(F.col("reads"))).otherwise(0.0)
    return known.select("region", "i", "j", (F.col("fit") + F.coalesce(depth, F.lit(0.0)) * depth_weight).alias("ll"), "reads")


def mixture_fits(relative: DataFrame, lengths: DataFrame) -> DataFrame:
    """(region, i, j, flat, weighted, reads): the sums over reads of ln((1 - e) * mixture + e), the mixture being half and half, and by
    the alleles' lengths. Reads are dealt by region once, which serves their alleles, the lengths (a row a region) and both sums.
    """
    scored = relative.repartition("region").groupBy("region", "read").agg(F.max("e").alias("e"), F.sort_array(F.collect_list(F.struct("allele", F.col("rel").cast("double").alias("s")))).alias("all"))
    of = lengths.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("allele", "len"))).alias("lens"))
    known = lambda x: F.map_contains_key(F.col("lens"), x["allele"])
    one = scored.join(of.hint("merge"), "region").withColumn("all", F.transform(F.filter("all", known), lambda x: F.struct(x["allele"].alias("allele"), x["s"].alias("s"), F.col("lens")[x["allele"]].alias("len"))))
    pair = lambda a, b: F.struct(a["allele"].alias("i"), b["allele"].alias("j"), a["s"].alias("x"), b["s"].alias("y"), F.try_divide(a["len"].cast("double"), a["len"] + b["len"]).alias("w"))
    pairs = F.flatten(F.transform("all", lambda a: F.transform(F.filter("all", lambda b: b["allele"] >= a["allele"]), lambda b: pair(a, b))))
    each = one.select("region", "e", F.explode(pairs).alias("p")).select("region", "e", "p.*")
    fit = lambda w: F.sum(F.ln((1 - F.col("e")) * (w * F.col("x") + (1 - w) * F.col("y")) + F.col("e")))
    return each.groupBy("region", "i", "j").agg(fit(F.lit(0.5)).alias("flat"), fit(F.col("w")).alias("weighted"), F.count("*").alias("reads"))


def mixture_likelihoods(relative: DataFrame, lengths: DataFrame, by_length: bool = False, priors: DataFrame | None = None) -> DataFrame:
    """(region, i, j, ll, reads): the sum over reads of ln((1 - e) * mixture + e), the mixture being that of the two alleles' relative
    likelihoods, half and half or by their lengths, and the pair's prior (region, i, j, prior; 0 without).

    relative: region, read, allele, e (the read's chance of being misplaced), rel.
    """
    sums = mixture_fits(relative, lengths).select("region", "i", "j", F.col("weighted" if by_length else "flat").alias("fit"), "reads")
    if priors is None:
        return sums.select("region", "i", "j", F.col("fit").alias("ll"), "reads")
    return sums.join(priors, ["region", "i", "j"], "left").select("region", "i", "j", (F.col("fit") + F.coalesce("prior", F.lit(0.0))).alias("ll"), "reads")
