"""k-mer operators: counts, redundancy, similarity, sketches. Counts are partial before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.functions.sequences import kmers
from braidwork.operators.windows import Names, _list


def positions(df: DataFrame, keep: Names, seq: str, k: int) -> DataFrame:
    """(keep, pos, kmer): every k-mer of every row, pos from 0."""
    return df.select(*_list(keep), F.posexplode(kmers(F.col(seq), k)).alias("pos", "kmer"))


def counts(df: DataFrame, keep: Names, seq: str, k: int) -> DataFrame:
    """(keep, kmer, n)."""
    return positions(df, keep, seq, k).groupBy(*_list(keep), "kmer").agg(F.count("*").alias("n"))


def redundancy(occurrences: DataFrame, by: Names, path: str, place: Column) -> DataFrame:
    """(by, places, copies, extra): extra sums over k-mers the distinct places less the most occurrences in any one path.

    occurrences: (by, path, kmer and the columns of place).
    """
    keys = _list(by)
    per_path = occurrences.groupBy(*keys, "kmer", path).agg(F.count("*").alias("n"), F.collect_set(place).alias("at"))
    per_kmer = per_path.groupBy(*keys, "kmer").agg(F.max("n").alias("copies"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("places"))
    return per_kmer.groupBy(*keys).agg(F.sum("places").alias("places"), F.sum("copies").alias("copies"), F.sum(F.col("places") - F.col("copies")).alias("extra"))


def overlaps(counted: DataFrame, rows: DataFrame, by: str, ident: str, item: str) -> DataFrame:
    """(by, id_a, id_b, n_a, n_b, least): every pair of a group's rows (by, ident), also those that share nothing, with the sums of
    their counts and of the lesser count of each item; counted: by, ident, item, n.

    Items meet by (group, item); only sums go beside the pairs, as sum(max) = n_a + n_b - least.
    """
    total = counted.groupBy(by, ident).agg(F.sum("n").alias("n"))
    every = rows.select(by, ident).distinct().join(total, [by, ident], "left").select(by, ident, F.coalesce("n", F.lit(0)).alias("n"))
    side = lambda df, t: df.select(F.col(by).alias(f"by_{t}"), F.col(ident).alias(f"id_{t}"), *(F.col(c).alias(f"{c}_{t}") for c in df.columns if c not in (by, ident)))
    pair = (F.col("by_a") == F.col("by_b")) & (F.col("id_a") < F.col("id_b"))
    a, b = side(counted.select(by, ident, item, "n"), "a"), side(counted.select(by, ident, item, "n"), "b")
    shared = a.join(b, pair & (F.col(f"{item}_a") == F.col(f"{item}_b"))).groupBy("by_a", "id_a", "id_b").agg(F.sum(F.least("n_a", "n_b")).alias("least"))
    pairs = side(every, "a").join(side(every, "b"), pair).select("by_a", "id_a", "id_b", "n_a", "n_b")
    return pairs.join(shared, ["by_a", "id_a", "id_b"], "left").select(F.col("by_a").alias(by), "id_a", "id_b", "n_a", "n_b", F.coalesce("least", F.lit(0)).alias("least"))


def jaccard(df: DataFrame, by: str, ident: str, seq: str, k: int) -> DataFrame:
    """(by, id_a, id_b, jaccard): weighted Jaccard similarity of the k-mer counts of every pair of a group; 1 if neither has any."""
    met = overlaps(counts(df, [by, ident], seq, k), df, by, ident, "kmer")
    union = F.col("n_a") + F.col("n_b") - F.col("least")
    return met.select(by, "id_a", "id_b", F.when(union > 0, F.col("least") / union).otherwise(1.0).alias("jaccard"))


def hashed(kmer: Column) -> Column:
    """A hash of 60 bits that any engine computes: the first 15 digits of the MD5."""
    return F.conv(F.substring(F.md5(kmer), 1, 15), 16, 10).cast("long")


def sketch(df: DataFrame, keep: Names, seq: str, k: int, scale: int) -> DataFrame:
    """(keep, hash): the distinct k-mer hashes that a fraction 1 / scale of all k-mers have."""
    return positions(df, keep, seq, k).select(*_list(keep), hashed(F.col("kmer")).alias("hash")).where(F.col("hash") % scale == 0).distinct()


def binned_distance(df: DataFrame, by: str, ident: str, seq: str, k: int, bins: int = 4096) -> DataFrame:
    """(by, id_a, id_b, l1): L1 distance of hashed k-mer counts of every pair of a group."""
    binned = positions(df, [by, ident], seq, k).groupBy(by, ident, (hashed(F.col("kmer")) % bins).alias("bin")).agg(F.count("*").alias("n"))
    return overlaps(binned, df, by, ident, "bin").select(by, "id_a", "id_b", (F.col("n_a") + F.col("n_b") - 2 * F.col("least")).alias("l1"))


def variable_kmers(df: DataFrame, by: Names, ident: str, seq: str, k: int) -> DataFrame:
    """(by, kmer, carriers): k-mers that some but not all rows of a group have.

    The sequences of one ident come together before their k-mers are made distinct, so no table of (k-mer, ident) is aggregated.
    """
    keys = _list(by)
    names = [f"g{i}_" for i in range(len(keys))]
    own = df.select(*keys, ident, seq).repartition(*keys, ident).groupBy(*keys, ident).agg(F.collect_list(seq).alias("seqs_"))
    n = own.groupBy(*(F.col(c).alias(g) for c, g in zip(keys, names, strict=True))).agg(F.count(ident).alias("n_"))
    each = own.select(*keys, ident, F.explode(F.array_distinct(F.flatten(F.transform("seqs_", lambda s: kmers(s, k))))).alias("kmer"))
    have = each.groupBy(*keys, "kmer").agg(F.count(ident).alias("carriers"))
    same = F.lit(True)
    for c, g in zip(keys, names, strict=True):
        same = same & (F.col(c) == F.col(g))
    return have.join(n, same).where("carriers < n_").select(*keys, "kmer", "carriers")


def medoids(df: DataFrame, by: str, ident: str, seq: str, weight: str, k: int) -> DataFrame:
    """(by, medoid): the row with the least weighted sum of 1 - Jaccard similarity to the group's rows; ties to the lesser id."""
    near = jaccard(df, by, ident, seq, k)
    both = near.unionByName(near.select(by, F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "jaccard"))
    w = df.select(F.col(by).alias("wb"), F.col(ident).alias("wi"), F.col(weight).alias("w"))
    whole = w.groupBy("wb").agg(F.sum("w").alias("all_w"))
    gain = both.join(w, (F.col(by) == F.col("wb")) & (F.col("id_b") == F.col("wi"))).groupBy(F.col(by).alias("b_"), F.col("id_a").alias("i_")).agg(F.sum(F.col("w") * F.col("jaccard")).alias("gain"))
    own = w.join(whole.withColumnRenamed("wb", "wb2"), F.col("wb") == F.col("wb2")).join(gain, (F.col("wb") == F.col("b_")) & (F.col("wi") == F.col("i_")), "left")
    cost = F.round(F.col("all_w") - F.col("w") - F.coalesce("gain", F.lit(0.0)), 9)
    return own.groupBy(F.col("wb").alias(by)).agg(F.min(F.struct(cost.alias("c"), "wi")).alias("best")).select(by, F.col("best.wi").alias("medoid"))
