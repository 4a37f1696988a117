"""Order-dependent operators: offsets, edges, monotone matches, islands, ranks, run lengths.

Each is one window over (by, order), so operators over the same keys share one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Names = str | list[str]


def _list(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def window(by: Names, order: Names):
    return W.partitionBy(*_list(by)).orderBy(*_list(order))


def offsets(df: DataFrame, by: Names, order: Names, length: str, out: str = "offset") -> DataFrame:
    """df with the sum of the lengths before each row (0 for the first; null lengths count 0)."""
    before = window(by, order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(length).over(before), F.lit(0)))


def edges(steps: DataFrame, by: Names, order: Names, node: str = "node") -> DataFrame:
    """(by, src, dst): consecutive pairs of each walk."""
    return steps.withColumn("dst", F.lead(node).over(window(by, order))).where("dst IS NOT NULL").select(*_list(by), F.col(node).alias("src"), "dst")


def first_positions(steps: DataFrame, by: Names, order: Names, node: str = "node") -> DataFrame:
    """(by, node, first): the least order value of each node of a walk."""
    return steps.groupBy(*_list(by), node).agg(F.min(_list(order)[0]).alias("first"))


def monotone(df: DataFrame, by: Names, order: Names, value: str) -> DataFrame:
    """The rows taken greedily so that value grows: those above all values before them. Null values are never taken."""
    before = F.max(value).over(window(by, order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("before_", before).where(F.col(value).isNotNull() & (F.col("before_").isNull() | (F.col(value) > F.col("before_")))).drop("before_")


def gaps_between(df: DataFrame, by: Names, order: Names, *values: str) -> DataFrame:
    """df with gap_<value>: the distance to the value of the row before, null for the first."""
    w = window(by, order)
    for v in values:
        df = df.withColumn(f"gap_{v}", F.col(v) - F.lag(v).over(w))
    return df


def islands(df: DataFrame, by: Names, order: Names, value: Names, out: str = "island") -> DataFrame:
    """df with the number of its maximal run of equal values (from 1 in each group). Nulls equal nulls."""
    w = window(by, order)
    new = F.lit(False)
    for v in _list(value):
        new = new | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    df = df.withColumn("new_", (new | (F.row_number().over(w) == 1)).cast("long"))
    return df.withColumn(out, F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new_")


def run_lengths(df: DataFrame, by: Names, order: Names, value: str) -> DataFrame:
    """(by, island, value, first, n): run-length encoding; first is the least order value of the run."""
    keys = _list(by)
    return islands(df, by, order, value).groupBy(*keys, "island", value).agg(F.min(_list(order)[0]).alias("first"), F.count("*").alias("n"))


#: Rows of a task where a step is told how many there are.
TASK_ROWS = 1_000_000


def dealt(df: DataFrame, by: Names, rows: int) -> DataFrame:
    """df by its keys over at least as many tasks as its rows fill; adaptive execution doesn't join these up, however few bytes they take."""
    from braidwork.plans.scratch import partitions

    return df.repartition(max(partitions(df.sparkSession), -(-rows // TASK_ROWS)), *_list(by))


def numeric_runs(df: DataFrame, by: Names, number: str, rows: int | None = None) -> DataFrame:
    """(by, lo, hi, n): maximal runs of consecutive whole numbers (repeats counted once). rows, if given, is df's count and sets how many tasks take it."""
    keys = _list(by)
    own = df.select(*keys, number) if rows is None else dealt(df.select(*keys, number), keys, rows)
    one = own.distinct().withColumn("key_", F.col(number) - F.row_number().over(window(keys, number)))
    return one.groupBy(*keys, "key_").agg(F.min(number).alias("lo"), F.max(number).alias("hi"), F.count("*").alias("n")).drop("key_")


def conserved_runs(df: DataFrame, by: Names, number: str, least: int, rows: int | None = None) -> DataFrame:
    """numeric_runs of at least so many numbers, the first and last run of each group kept at any length."""
    w = W.partitionBy(*_list(by))
    runs = numeric_runs(df, by, number, rows)
    return runs.withColumn("a_", F.min("lo").over(w)).withColumn("b_", F.max("hi").over(w)).where((F.col("n") >= least) | (F.col("lo") == F.col("a_")) | (F.col("hi") == F.col("b_"))).drop("a_", "b_")


def occurrence(df: DataFrame, by: Names, order: Names, out: str = "occurrence") -> DataFrame:
    """df with the how-manieth row of its group each is."""
    return df.withColumn(out, F.row_number().over(window(by, order)).cast("long"))


def average_rank(value: str, by: Names = ()) -> Column:
    """The rank of a value, ties sharing the mean of theirs."""
    keys = _list(by)
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2.0


def latest(df: DataFrame, by: Names, order: Names) -> DataFrame:
    """The last row of each group: what an upsert by key leaves."""
    w = W.partitionBy(*_list(by)).orderBy(*(F.col(o).desc_nulls_last() for o in _list(order)))
    return df.withColumn("nth_", F.row_number().over(w)).where("nth_ = 1").drop("nth_")


def lag_matches(df: DataFrame, by: Names, order: Names, value: str, period: int, out: str = "match") -> DataFrame:
    """df with whether the value so many rows on is equal (null past the end)."""
    return df.withColumn(out, (F.col(value) == F.lead(value, period).over(window(by, order))).cast("long"))


def sliding_sum(df: DataFrame, by: Names, order: Names, value: str, width: int, out: str = "in_window") -> DataFrame:
    """df with the sum over each row and the width - 1 rows after it."""
    return df.withColumn(out, F.sum(value).over(window(by, order).rowsBetween(0, width - 1)))


def midpoints(df: DataFrame, value: str, by: Names = ()) -> DataFrame:
    """(by, cut): midpoints between neighbouring distinct values."""
    keys = _list(by)
    one = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    return one.withColumn("cut", (F.col(value) + F.lead(value).over(window(keys, value))) / 2.0).where("cut IS NOT NULL").select(*keys, "cut")


def running_sums(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """df with before_<value>: the sums over all rows of lesser order, for a whole table and without one task for all of it.

    Rows are dealt by ranges of order and written; sums run within ranges, and the ranges' totals, a row each, are added.
    Orders must not repeat, or rows of one order get sums in any order among them.
    """
    from braidwork.plans.scratch import materialize, partitions

    n = partitions(df.sparkSession)
    dealt = materialize(df.repartitionByRange(n, order).withColumn("part_", F.spark_partition_id()), "ranges")
    lower = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy("part_").agg(*(F.sum(v).alias(v) for v in values)).select(F.col("part_").alias("p_"), *(F.coalesce(F.sum(v).over(lower), F.lit(0)).alias(f"t_{v}") for v in values))
    w = W.partitionBy("part_").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = dealt
    for v in values:
        local = local.withColumn(f"l_{v}", F.coalesce(F.sum(v).over(w), F.lit(0)))
    joined = local.join(F.broadcast(totals), F.col("part_") == F.col("p_"))  # as many rows as there are partitions
    return joined.select(*df.columns, *((F.col(f"l_{v}") + F.col(f"t_{v}")).alias(f"before_{v}") for v in values))


def depth_changes(df: DataFrame, by: Names, start: str, end: str) -> DataFrame:
    """(by, at, depth): how many half-open intervals cover each stretch from at to the next at, as a difference array summed up."""
    keys = _list(by)
    steps = df.where(F.col(start) < F.col(end)).select(*keys, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("s"))
    summed = steps.groupBy(*keys, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    return summed.withColumn("depth", F.sum("d").over(window(keys, "at").rowsBetween(W.unboundedPreceding, 0))).drop("d")
