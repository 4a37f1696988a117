"""Alignments carried from one graph to another that shares its inner nodes and has one node for each flank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.windows import Names, _list
from braidwork.plans.scratch import materialize


def wholly_on(steps: DataFrame, nodes: DataFrame, key: Names, by: Names = ()) -> DataFrame:
    """The steps (key, by, node, ...) of walks that nowhere leave nodes (by, node). Steps on a null node count as outside."""
    at = [*_list(by), "node"]
    outside = steps.join(nodes.select(*at).distinct(), at, "left_anti").select(*_list(key)).distinct()
    return steps.join(outside, _list(key), "left_anti")


def _part(which: Column, prefix: str) -> list[Column]:
    """What is to be known of the outside steps on one side: their number and place on the reference walk, and whether they are one piece of it."""
    of = lambda value: F.when(which, value)
    return [
        F.count_if(which).alias(f"{prefix}_n"),
        F.count_if(which & F.col("r_start").isNull()).alias(f"{prefix}_unknown"),
        F.min(of(F.col("r_start"))).alias(f"{prefix}_lo"),
        F.max_by("r_end", of(F.struct("r_start", "r_end"))).alias(f"{prefix}_hi"),
        F.sum(of(F.col("r_end") - F.col("r_start"))).alias(f"{prefix}_len"),
        F.count_if(which & (F.col("rev") == F.col("r_rev"))).alias(f"{prefix}_along"),
        F.count_if(which & (F.col("rev") != F.col("r_rev"))).alias(f"{prefix}_against"),
    ]


def projected(alignments: DataFrame, steps: DataFrame, inside: DataFrame, reference: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alignments: region, read, verdict, ps, pe, plen; steps: region, read, step, node, rev) in the local graph's nodes.

    alignments: region, read, ps, pe, plen (from ps to pe on the path, closed-open). steps: region, read, step, node, rev.
    inside: region, node, len, the nodes that both graphs have. reference: region, node, r_start, r_end, r_rev, the first place of each
    node on the reference walk. regions: region, a0, b0 (the span, closed-open), left, left_len, right, right_len (its flank nodes).

    Steps inside stay. A run of outside steps at a walk's begin or end must be one contiguous piece of the reference walk, walked one
    way, that ends where the span begins or begins where it ends, and no longer than the flank; it becomes one step on that flank's
    node and the offsets shift. A walk wholly outside may lie anywhere in a flank. verdict: kept, projected, or why it is dropped,
    the begin being judged first: outside_within (outside steps between inside ones), off_reference, not_colinear, beyond_flank,
    bad_offsets. Dropped ones keep no steps and null offsets. Neither walks nor the reference are gathered: each read is one row of
    sums over its steps.
    """
    on = ["region", "node"]
    marked = steps.join(inside.select("region", "node", F.col("len").alias("in_len")), on, "left").join(reference, on, "left")
    marked = materialize(marked.withColumn("in_", F.col("in_len").isNotNull()), "projected-steps")
    ends = marked.where("in_").groupBy("region", "read").agg(F.min("step").alias("i"), F.max("step").alias("j"), F.sum("in_len").alias("in_len"))
    placed = marked.drop("in_len").join(ends.select("region", "read", "i", "j"), ["region", "read"], "left")
    lead = ~F.col("in_") & (F.col("i").isNull() | (F.col("step") < F.col("i")))
    trail = ~F.col("in_") & F.col("j").isNotNull() & (F.col("step") > F.col("j"))
    sums = placed.groupBy("region", "read").agg(F.count_if(~F.col("in_") & ~lead & ~trail).alias("within"), *_part(lead, "lead"), *_part(trail, "trail"))
    known = alignments.join(sums, ["region", "read"]).join(ends.drop("i", "j"), ["region", "read"], "left").join(regions, "region")

    def judged(df: DataFrame, p: str) -> DataFrame:
        lo, hi, length = F.col(f"{p}_lo"), F.col(f"{p}_hi"), F.col(f"{p}_len")
        alone = F.col("in_len").isNull()
        left = ((hi == F.col("a0")) & (length <= F.col("left_len"))) | (alone & (lo >= F.col("a0") - F.col("left_len")) & (hi <= F.col("a0")))
        right = ((lo == F.col("b0")) & (length <= F.col("right_len"))) | (alone & (lo >= F.col("b0")) & (hi <= F.col("b0") + F.col("right_len")))
        # The first that holds, in this order: touching on the left, on the right, then anywhere in the left flank, in the right one.
        touches_left, touches_right = (hi == F.col("a0")) & (length <= F.col("left_len")), (lo == F.col("b0")) & (length <= F.col("right_len"))
        flank = F.when(touches_left, "left").when(touches_right, "right").when(left, "left").when(right, "right")
        one_way = (F.col(f"{p}_along") == F.col(f"{p}_n")) | (F.col(f"{p}_against") == F.col(f"{p}_n"))
        bad = (
            F.when(F.col(f"{p}_n") == 0, None).when(F.col(f"{p}_unknown") > 0, "off_reference")
            .when(~one_way | (length != hi - lo), "not_colinear").when(flank.isNull(), "beyond_flank")
        )
        rev = F.col(f"{p}_along") != F.col(f"{p}_n")
        start, size = F.when(flank == "left", F.col("a0") - F.col("left_len")).otherwise(F.col("b0")), F.when(flank == "left", F.col("left_len")).otherwise(F.col("right_len"))
        before = F.when(rev, start + size - hi).otherwise(lo - start)
        return df.withColumns({f"{p}_bad": bad, f"{p}_flank": flank, f"{p}_rev": rev, f"{p}_before": before, f"{p}_size": size})

    both = judged(judged(known, "lead"), "trail")
    shift = F.when(F.col("lead_n") > 0, F.col("lead_before")).otherwise(0)
    changed = (F.col("lead_n") > 0) | (F.col("trail_n") > 0)
    size = lambda p: F.when(F.col(f"{p}_n") > 0, F.col(f"{p}_size")).otherwise(0)
    moved = both.withColumns({"n_ps": F.col("ps") + shift, "n_pe": F.col("pe") + shift, "n_plen": F.when(changed, F.coalesce("in_len", F.lit(0)) + size("lead") + size("trail")).otherwise(F.col("plen"))})
    offsets = (F.col("n_ps") >= 0) & (F.col("n_ps") <= F.col("n_pe")) & (F.col("n_pe") <= F.col("n_plen"))
    verdict = F.when(F.col("within") > 0, "outside_within").otherwise(F.coalesce("lead_bad", "trail_bad", F.when(~F.coalesce(offsets, F.lit(False)), "bad_offsets"), F.when(changed, "projected").otherwise("kept")))
    out = materialize(moved.withColumn("verdict", verdict), "projected")
    kept = F.col("verdict").isin("kept", "projected")
    own = placed.where("in_").join(out.where(kept).select("region", "read"), ["region", "read"], "left_semi").select("region", "read", F.col("step").alias("at"), "node", "rev")

    def flank_step(p: str, at: int) -> DataFrame:
        node = F.when(F.col(f"{p}_flank") == "left", F.col("left")).otherwise(F.col("right"))
        rows = out.where(kept & (F.col(f"{p}_n") > 0))
        return rows.select("region", "read", F.lit(at).cast(dict(steps.dtypes)["step"]).alias("at"), node.alias("node"), F.col(f"{p}_rev").alias("rev"))

    every = own.withColumn("side", F.lit(0)).unionByName(flank_step("lead", 0).withColumn("side", F.lit(-1))).unionByName(flank_step("trail", 0).withColumn("side", F.lit(1)))
    number = F.row_number().over(W.partitionBy("region", "read").orderBy("side", "at"))
    held = lambda c: F.when(kept, F.col(c)).alias(c[2:])
    return out.select("region", "read", "verdict", held("n_ps"), held("n_pe"), held("n_plen")), every.select("region", "read", number.alias("step"), "node", "rev")
