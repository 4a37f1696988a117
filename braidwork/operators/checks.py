"""Validation and selection: spelling checks, guards, prefilters, threshold rules, skip rules, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions.sequences import common_prefix
from braidwork.operators.windows import Names, _list


def row_mismatches(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """(name, problem, at): aligned rows (name, aligned) that don't spell their sequence (name, seq), with the first differing base.

    problem: missing (no row), extra (no sequence) or differs.
    """
    a = rows.select(F.col("name").alias("n1"), F.replace("aligned", F.lit("-"), F.lit("")).alias("spelt"))
    b = seqs.select(F.col("name").alias("n2"), F.upper("seq").alias("seq"))
    j = a.join(b, F.col("n1") == F.col("n2"), "full")
    problem = F.when(F.col("n1").isNull(), "missing").when(F.col("n2").isNull(), "extra").when(F.col("spelt") != F.col("seq"), "differs")
    at = F.when(problem == "differs", common_prefix(F.col("spelt"), F.col("seq")))
    return j.select(F.coalesce("n1", "n2").alias("name"), problem.alias("problem"), at.alias("at")).where("problem IS NOT NULL")


def invalid_paths(steps: DataFrame, nodes: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem): expected paths (path, seq) that are absent, step on an unknown node, or spell something else."""
    from braidwork.operators.graphs import spelled

    unknown = steps.join(nodes, "node", "left_anti").select("path").distinct().withColumn("u_", F.lit(1))
    got = spelled(steps, nodes, "path", "step").withColumnRenamed("seq", "spelt")
    j = expected.select("path", "seq").join(got, "path", "left").join(unknown, "path", "left")
    problem = F.when(F.col("u_").isNotNull(), "unknown node").when(F.col("spelt").isNull(), "absent").when(F.col("spelt") != F.col("seq"), "differs")
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def guard(df: DataFrame, column: str, excluded: list[str], what: str) -> DataFrame:
    """df; a row whose column names an excluded value fails the job when it is read."""
    bad = F.col(column).isin(excluded)
    return df.where(F.when(bad, F.raise_error(F.concat(F.lit(f"{what}: excluded "), F.col(column).cast("string"))).cast("boolean")).otherwise(F.lit(True)))


def varying(df: DataFrame, by: Names, length: str, reference: Column, least: int) -> DataFrame:
    """(by, most): groups in which a length differs from the reference row's by so much at least."""
    keys = _list(by)
    one = df.groupBy(*keys).agg(F.max(F.when(reference, F.col(length))).alias("r_"), F.min(length).alias("a_"), F.max(length).alias("b_"))
    return one.withColumn("most", F.greatest(F.abs(F.col("a_") - F.col("r_")), F.abs(F.col("b_") - F.col("r_")))).where(F.col("most") >= least).select(*keys, "most")


def rule(conditions: list[tuple[str, float]], how: str = "and") -> Column:
    """feature > bound for all ('and') or any ('or') of the conditions; a null feature fails its condition."""
    parts = [F.coalesce(F.col(f) > b, F.lit(False)) for f, b in conditions]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if how == "and" else (out | p)
    return out


def skipped(jobs: DataFrame, by: Names, cost: str, status: str, predicted: str, timeouts: int, factor: float, limit: float) -> DataFrame:
    """jobs with skip: 'timeouts' after so many cheaper jobs of the group timed out, 'predicted' beyond factor times the limit, else null."""
    cheaper = W.partitionBy(*_list(by)).orderBy(cost).rangeBetween(W.unboundedPreceding, -1)
    n = F.coalesce(F.sum((F.col(status) == "timeout").cast("int")).over(cheaper), F.lit(0))
    return jobs.withColumn("skip", F.when(n >= timeouts, "timeouts").when(F.col(predicted) > factor * limit, "predicted"))


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, n): rows that each check found."""
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no checks")
    return out
