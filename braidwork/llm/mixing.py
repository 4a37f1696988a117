"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target, target / size is its repetition rate, and a document is
emitted floor(rate) times plus one more with the probability of the fraction, drawn from a hash of a seed and its id.
Sums are partial before the one small shuffle; documents themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.llm.common import free_name, materialize, numbered, table, word_count

#: A source gives at most so many times its own size, so no document is taken more often.
MAX_REPEATS = 3
SEED = "mix-1"
#: The table of sources is broadcast up to so many rows (about 100 bytes each); beyond, it is joined by salted shuffle.
BROADCAST_SOURCES = 100_000
SALTS = 64


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target, rate): one row a source, null being a source of its own, ordered last.

    Weights go 1, 2, 3, 1, ... by the code points of the names. Targets share the total by weight; what exceeds
    max_repeats times a source's size is shared anew among the others, which is the water level of capped shares:
    with sources by capacity / weight, the first whose share of what is left fits its capacity sets the level.
    A source of size 0 has target and rate 0. No rows give no rows.
    """
    by = sizes.groupBy(F.col(source).alias("source")).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("source_size"))
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)).cast("double")
    return (
        by.withColumn("weight", ((F.row_number().over(ordered) - 1) % 3 + 1).cast("long"))
        .withColumn("cap", F.col("source_size") * F.lit(max_repeats))
        .withColumn("share", share)
        .withColumn("level", F.max(F.when(F.col("share") <= F.col("cap") / F.col("weight"), F.col("share"))).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats)))).otherwise(0.0))
        .select("source", "source_size", "weight", "target", "rate")
    )


def uniform(key: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed and key; a null key gives way to the MD5 of the text."""
    named = F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), named)), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)


def with_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """docs with size, source_size, target and n_copies (how often the mix takes the document).

    Columns of docs with these names give way to the computed ones. Null texts have size 0; a document without words
    is taken like any other of its source. Repeated rows share their id, so they share their draw; rows without an id draw by
    their texts. An empty table gives an empty one.
    """
    own = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "n_copies")]
    drawn = free_name(docs, "draw")[0]
    sized = docs.select(*own, word_count(F.col(text)).alias("size"), uniform(F.col(key), F.col(text), seed).alias(drawn))
    sources = materialize(source_targets(sized.select(F.col(source).alias("source"), "size"), max_repeats=max_repeats), "mix-sources")
    name, salt = free_name(sized, "mix_source", "mix_salt")
    sources = sources.select(F.col("source").alias(name), "source_size", "target", F.col("rate").alias(f"{name}_rate"))
    if sources.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(sources), F.col(source).eqNullSafe(F.col(name)), "left")
    else:
        left = sized.withColumn(salt, F.pmod(F.xxhash64(F.col(key), F.col("size")), F.lit(SALTS)).cast("int"))
        right = sources.withColumn(f"{salt}_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.join(right, F.col(source).eqNullSafe(F.col(name)) & (F.col(salt) == F.col(f"{salt}_r")), "left")
    rate = F.col(f"{name}_rate")
    copies = F.floor(rate) + F.when(F.col(drawn) < rate - F.floor(rate), 1).otherwise(0)
    return joined.select(*own, "size", "source_size", "target", copies.cast("long").alias("n_copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it, with the columns of docs as they are."""
    plain, name = numbered(docs)
    counted = with_copies(plain, name[key], name[text], name[source], seed).where("n_copies > 0")
    taken = counted.withColumn("mix_copy_", F.explode(F.array_repeat(F.lit(0), F.col("n_copies").cast("int"))))
    return taken.select(*(F.col(new).alias(old) for old, new in name.items()))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = with_copies(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


OP9_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, source_size * 3 AS cap FROM by_source
), shared AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share
  FROM weighed WINDOW before AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levelled AS (
  SELECT *, max(CASE WHEN share <= cap::DOUBLE / weight::DOUBLE THEN share END) OVER () AS level FROM shared
), targets AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, level * weight), 0.0)::DOUBLE AS target FROM levelled
), rated AS (
  SELECT d.doc_id, d.digest, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size::DOUBLE, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, digest)), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
