"""Interval operators over half-open intervals: merging, union, coverage, overlap joins, as-of joins.

Overlap joins deal both sides over bins of the coordinate and are equi-joins on (key, bin); a pair is reported from the
first bin that both touch, so nothing is found twice and no nested loop is planned. As-of joins are a union and a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.windows import Names, _list, window


def merge_intervals(df: DataFrame, by: Names, start: str = "start", end: str = "end", gap: int = 0) -> DataFrame:
    """(by, island, start, end, n): intervals merged where the next starts at most gap after the furthest end so far."""
    keys = _list(by)
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) - reach > gap), 1).otherwise(0)
    marked = df.withColumn("new_", new)
    summed = marked.withColumn("island", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return summed.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def union_length(df: DataFrame, by: Names, start: str = "start", end: str = "end") -> DataFrame:
    """(by, covered): length of the union of the intervals."""
    return merge_intervals(df, by, start, end).groupBy(*_list(by)).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def clipped(df: DataFrame, low: Column, high: Column, start: str = "start", end: str = "end") -> DataFrame:
    """The parts of the intervals within [low, high)."""
    return df.withColumn(start, F.greatest(F.col(start), low)).withColumn(end, F.least(F.col(end), high)).where(F.col(start) < F.col(end))


def coverage(df: DataFrame, by: Names, low: str, high: str, start: str = "start", end: str = "end") -> DataFrame:
    """(by, covered, fraction) of [low, high), columns of df, by intervals that don't overlap each other."""
    keys = _list(by)
    part = F.greatest(F.least(F.col(end), F.col(high)) - F.greatest(F.col(start), F.col(low)), F.lit(0))
    summed = df.groupBy(*keys, low, high).agg(F.sum(part).alias("covered"))
    return summed.withColumn("fraction", F.coalesce(F.try_divide(F.col("covered"), F.col(high) - F.col(low)), F.lit(0.0))).drop(low, high)


def _binned(df: DataFrame, key: str, start: str, end: str, width: int, tag: str) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    return df.where(F.col(start) < F.col(end)).withColumn(f"bin_{tag}", F.explode(F.sequence(first, last))).withColumn(f"key_{tag}", F.col(key))


def overlap_join(left: DataFrame, right: DataFrame, key: tuple[str, str], a: tuple[str, str], b: tuple[str, str], width: int = 1000, how: str = "inner") -> DataFrame:
    """Pairs of a left and a right interval that overlap within the key. Column names of both sides must differ.

    how: inner; left_semi or left_anti for rows of left with or without a partner (rows equal in all columns once, or each, if kept).
    Empty intervals overlap nothing.
    """
    if how == "left_anti":
        found = overlap_join(left, right, key, a, b, width, "left_semi")
        other = found.toDF(*(f"f{i}_" for i in range(len(left.columns))))
        same = F.lit(True)
        for i, c in enumerate(left.columns):
            same = same & F.col(c).eqNullSafe(F.col(f"f{i}_"))
        return left.join(other, same, "left_anti")
    x, y = _binned(left, key[0], *a, width, "l"), _binned(right, key[1], *b, width, "r")
    meet = (F.col("key_l") == F.col("key_r")) & (F.col("bin_l") == F.col("bin_r"))
    over = (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1]))
    once = F.col("bin_l") == F.greatest(F.floor(F.col(a[0]) / width), F.floor(F.col(b[0]) / width))
    if how == "left_semi":
        return x.join(y, meet & over, "left_semi").select(*left.columns).distinct()
    return x.join(y, meet & over & once).drop("bin_l", "bin_r", "key_l", "key_r")


def point_join(points: DataFrame, intervals: DataFrame, key: tuple[str, str], at: str, b: tuple[str, str], width: int = 1000) -> DataFrame:
    """Points with the half-open intervals that hold them."""
    x = points.withColumn("bin_l", F.floor(F.col(at) / width))
    y = _binned(intervals, key[1], *b, width, "r")
    return x.join(y, (F.col(key[0]) == F.col("key_r")) & (F.col("bin_l") == F.col("bin_r")) & (F.col(at) >= F.col(b[0])) & (F.col(at) < F.col(b[1]))).drop("bin_l", "bin_r", "key_r")


def asof_join(left: DataFrame, right: DataFrame, by: tuple[Names, Names], on: tuple[str, str], values: list[str], backward: bool = True) -> DataFrame:
    """left with values of the right row of the same key that is last at or before it (or, forward, first at or after it).

    Among right rows at one place, the one with the greatest values (as a struct) counts. Rows without a partner get nulls.
    """
    lk, rk = _list(by[0]), _list(by[1])
    keys = [f"k{i}_" for i in range(len(lk))]
    own = F.struct(*(F.col(c) for c in left.columns))
    best = right.groupBy(*rk, on[1]).agg(F.max(F.struct(*values)).alias("v_"))
    x = left.select(*(F.col(c).alias(k) for c, k in zip(lk, keys, strict=True)), F.col(on[0]).alias("at_"), own.alias("own_"), F.lit(None).cast(best.schema["v_"].dataType).alias("v_"), F.lit(1).alias("side_"))
    y = best.select(*(F.col(c).alias(k) for c, k in zip(rk, keys, strict=True)), F.col(on[1]).alias("at_"), F.lit(None).cast(x.schema["own_"].dataType).alias("own_"), "v_", F.lit(0).alias("side_"))
    order = [F.col("at_"), F.col("side_")] if backward else [F.col("at_").desc(), F.col("side_")]
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = x.unionByName(y).withColumn("f_", F.last("v_", ignorenulls=True).over(w)).where("side_ = 1")
    return found.select("own_.*", *(F.col(f"f_.{v}").alias(v) for v in values))


def conflicts(df: DataFrame, by: str, ident: str, start: str = "start", end: str = "end", width: int = 1000) -> DataFrame:
    """(by, id_a, id_b): pairs of overlapping intervals of one group, the lesser id first."""
    a = df.select(F.col(by).alias("by_a"), F.col(ident).alias("id_a"), F.col(start).alias("s_a"), F.col(end).alias("e_a"))
    b = df.select(F.col(by).alias("by_b"), F.col(ident).alias("id_b"), F.col(start).alias("s_b"), F.col(end).alias("e_b"))
    return overlap_join(a, b, ("by_a", "by_b"), ("s_a", "e_a"), ("s_b", "e_b"), width).where("id_a < id_b").select(F.col("by_a").alias(by), "id_a", "id_b")


def nearest_spans(points: DataFrame, chains: DataFrame, by: tuple[str, str], at: tuple[str, str], chain: str, start: str, end: str) -> DataFrame:
    """points with, of the chains that have a boundary on both sides, the tightest span: (chain, left, right).

    On each chain, left is the nearest end at or before at[0] and right the nearest start at or after at[1]; the least
    right - left wins, then the lesser chain.
    """
    pairs = points.withColumn("row_", F.monotonically_increasing_id())
    joined = pairs.join(chains.select(F.col(by[1]).alias("key_"), F.col(chain).alias("chain_"), F.col(start).alias("s_"), F.col(end).alias("e_")), F.col(by[0]) == F.col("key_"))
    per = joined.groupBy("row_", "chain_").agg(F.max(F.when(F.col("e_") <= F.col(at[0]), F.col("e_"))).alias("left"), F.min(F.when(F.col("s_") >= F.col(at[1]), F.col("s_"))).alias("right")).where("left IS NOT NULL AND right IS NOT NULL")
    best = per.groupBy("row_").agg(F.min(F.struct(F.expr("right - left").alias("span"), F.col("chain_"), "left", "right")).alias("b_"))
    return pairs.join(best, "row_", "left").select(*points.columns, F.col("b_.chain_").alias("chain"), F.col("b_.left").alias("left"), F.col("b_.right").alias("right"))


__all__ = ["asof_join", "clipped", "conflicts", "coverage", "merge_intervals", "nearest_spans", "overlap_join", "point_join", "union_length", "window"]
