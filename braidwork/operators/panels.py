"""Panels and reports: strict lookups, nesting, seeds and orders of inputs, shares weighted by counts, differences of digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.windows import Names, _list


def looked_up(df: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """df with value of names (key, value; keys differ) beside each row; a row whose key names doesn't hold ends the job with an error."""
    right = names.select(F.col(key).alias("key_"), F.col(value).alias("value_"), F.lit(True).alias("found_"))
    missing = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return df.join(right, F.col(key) == F.col("key_"), "left").withColumn(value, F.when(F.col("found_"), F.col("value_")).otherwise(missing)).drop("key_", "value_", "found_")


def with_reference(df: DataFrame, by: Names, ident: str, reference: str) -> DataFrame:
    """(by, reference, ident): the pairs of each group that hold its reference (a boolean column), and no others."""
    keys = _list(by)
    ref = df.where(F.col(reference)).select(*keys, F.col(ident).alias("reference"))
    return df.where(~F.col(reference)).select(*keys, ident).join(ref, keys)


def nested(records: DataFrame, interiors: DataFrame) -> DataFrame:
    """(child, parent): records whose two boundary nodes are both interior to another record of a different boundary.

    records: id, left, right; interiors: id, node. The rarer of the two nodes finds the holders, the other one is checked.
    """
    held = interiors.select(F.col("id").alias("parent"), "node").distinct()
    often = held.groupBy("node").agg(F.count("*").alias("n"))
    side = lambda c: often.select(F.col("node").alias(f"{c}_node"), F.col("n").alias(f"{c}_n"))
    known = records.join(side("left"), F.col("left") == F.col("left_node")).join(side("right"), F.col("right") == F.col("right_node"))
    rarer = F.col("left_n") <= F.col("right_n")
    asked = known.select(F.col("id").alias("child"), F.col("left").alias("l1"), F.col("right").alias("r1"), F.when(rarer, F.col("left")).otherwise(F.col("right")).alias("rare"), F.when(rarer, F.col("right")).otherwise(F.col("left")).alias("other"))
    pairs = asked.join(held, (F.col("rare") == F.col("node")) & (F.col("child") != F.col("parent"))).drop("node")
    both = pairs.join(held.select(F.col("parent").alias("p2"), F.col("node").alias("n2")), (F.col("parent") == F.col("p2")) & (F.col("other") == F.col("n2")))
    bounds = records.select(F.col("id").alias("p3"), F.col("left").alias("l2"), F.col("right").alias("r2"))
    return both.join(bounds, (F.col("parent") == F.col("p3")) & ~(F.col("l1").eqNullSafe(F.col("l2")) & F.col("r1").eqNullSafe(F.col("r2")))).select("child", "parent")


def with_missing(edges: DataFrame, walked: DataFrame) -> DataFrame:
    """(src, dst, listed): edges and those that only walks take (both src, dst), each once; one shuffle for both."""
    both = edges.select("src", "dst", F.lit(True).alias("listed")).unionByName(walked.select("src", "dst", F.lit(False).alias("listed")))
    return both.groupBy("src", "dst").agg(F.max("listed").alias("listed"))


def input_order(order: str, length: str, ident: str) -> list[Column]:
    """The columns to sort rows by: given, longest, shortest, or random:SEED (a hash of seed and id); ties by id."""
    if order == "given":
        return [F.col(ident)]
    if order in ("longest", "shortest"):
        return [F.col(length).desc() if order == "longest" else F.col(length), F.col(ident)]
    if order.startswith("random:"):
        return [F.md5(F.concat(F.lit(order.removeprefix("random:") + "/"), F.col(ident).cast("string"))), F.col(ident)]
    raise ValueError(f"unknown order {order!r}")


def ordered(df: DataFrame, by: Names, order: str, length: str, ident: str, out: str = "place") -> DataFrame:
    """df with each row's place in its group, from 1."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*_list(by)).orderBy(*input_order(order, length, ident))))


def seeds(df: DataFrame, by: Names, ident: str, weight: str, length: str, k: int) -> DataFrame:
    """df with seed: whether a row is among the k heaviest of its group, or its longest or shortest. Ties: the least id, for the shortest the greatest."""
    group = W.partitionBy(*_list(by))
    heavy = F.row_number().over(group.orderBy(F.col(weight).desc(), ident)) <= k
    longest = F.row_number().over(group.orderBy(F.col(length).desc(), ident)) == 1
    shortest = F.row_number().over(group.orderBy(F.col(length), F.col(ident).desc())) == 1
    return df.withColumn("seed", heavy | longest | shortest)


def extremes(df: DataFrame, value: str, ident: str, n: int) -> DataFrame:
    """The n least and the n greatest values (side: improved, worsened); ties by id. Rows without a value count for neither."""
    found = df.where(F.col(value).isNotNull())
    least = found.orderBy(F.col(value), ident).limit(n).withColumn("side", F.lit("improved"))
    return least.unionByName(found.orderBy(F.col(value).desc(), ident).limit(n).withColumn("side", F.lit("worsened")))


def job_rank(predicted: Column, method: Column, priority: dict[str, float], preferred: Column, factor: float) -> Column:
    """A job's rank: its predicted seconds times its method's priority (1 if it has none), times factor where it is preferred."""
    by_method = F.lit(1.0)
    for name, p in priority.items():
        by_method = F.when(method == name, F.lit(float(p))).otherwise(by_method)
    return predicted * by_method * F.when(preferred, F.lit(float(factor))).otherwise(F.lit(1.0))


def kinds_inside(records: DataFrame, by: Names, snv: Column, inside: Column) -> DataFrame:
    """(by, snv_in, snv_out, indel_in, indel_out): counts of records by kind and place."""
    count = lambda kind, place: F.count_if(kind & place)
    return records.groupBy(*_list(by)).agg(count(snv, inside).alias("snv_in"), count(snv, ~inside).alias("snv_out"), count(~snv, inside).alias("indel_in"), count(~snv, ~inside).alias("indel_out"))


def one_start(units: DataFrame, by: Names, column: str, start: str) -> DataFrame:
    """(by, one_start, columns, share): columns whose units all have one start, all columns, the share of units that are in the former."""
    keys = _list(by)
    each = units.groupBy(*keys, column).agg(F.count("*").alias("n"), (F.min(start) == F.max(start)).alias("same"))
    share = F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)) / F.sum("n")
    return each.groupBy(*keys).agg(F.count_if("same").alias("one_start"), F.count("*").alias("columns"), F.round(share, 4).alias("share"))


def pooled_means(df: DataFrame, by: Names, values: list[str], weight: str) -> DataFrame:
    """(by, n, values): means weighted by weight, a null value counting 0; rows of a null or zero weight are left out."""
    sums = [(F.sum(F.coalesce(F.col(v), F.lit(0.0)) * F.col(weight)) / F.sum(weight)).alias(v) for v in values]
    return df.where(F.col(weight) > 0).groupBy(*_list(by)).agg(F.sum(weight).alias("n"), *sums)


def different(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, a, b): keys whose digests differ, or that only one side has (null on the other)."""
    x, y = a.select(F.col(key).alias("ka_"), F.col(digest).alias("a")), b.select(F.col(key).alias("kb_"), F.col(digest).alias("b"))
    return x.join(y, F.col("ka_") == F.col("kb_"), "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.coalesce("ka_", "kb_").alias(key), "a", "b")


def evaluable(placements: DataFrame, key: str, exact: Column, quality: str, least: float) -> DataFrame:
    """(key): keys of a quality of at least least whose placements are all exact; a null counts as not exact."""
    return placements.groupBy(key).agg(F.min(quality).alias("q_"), F.every(F.coalesce(exact, F.lit(False))).alias("e_")).where((F.col("q_") >= least) & F.col("e_")).select(key)


def expanded(steps: DataFrame, pieces: DataFrame, path: str = "path") -> DataFrame:
    """(path, step, piece, rev): walks over the pieces that their nodes were cut into, backwards in a node walked in reverse.

    steps: path, step, node, rev; pieces: node, nth, piece. Steps are numbered anew from 1; steps of nodes without pieces go.
    """
    joined = steps.join(pieces, "node").withColumn("nth_", F.when(F.col("rev"), -F.col("nth")).otherwise(F.col("nth")))
    number = F.row_number().over(W.partitionBy(path).orderBy("step", "nth_"))
    return joined.select(path, number.alias("step"), "piece", "rev")
