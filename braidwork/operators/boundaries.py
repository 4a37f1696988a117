"""Anchors of regions on a reference walk: coverage of nodes, the nearest good ones on both sides, in windows that widen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.intervals import overlap_join
from braidwork.plans.scratch import discard, materialize

WINDOW, MOST = 20_000, 320_000


def coverage(visits: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(node, cov, most): visits of walks (path, node a row), counted with the weights of paths (path, weight; 1 without), and the most
    of any one path."""
    each = visits.groupBy("node", "path").agg(F.count("*").alias("n"))
    w = each.join(weights, "path", "left").withColumn("weight", F.coalesce("weight", F.lit(1))) if weights is not None else each.withColumn("weight", F.lit(1))
    return w.groupBy("node").agg(F.sum(F.col("n") * F.col("weight")).alias("cov"), F.max("n").alias("most"))


def eligible_nodes(reference: DataFrame, covered: DataFrame, truth: DataFrame | None) -> DataFrame:
    """reference (contig, node, start, end) with cov and whether each node is eligible: no walk visits it twice, the reference once, and no
    truth record (contig, pos, stop; closed, from 1) touches it. Nodes that no walk visits have coverage 0."""
    once = reference.groupBy("contig", "node").agg(F.count("*").alias("times"))
    known = reference.join(once, ["contig", "node"]).join(covered, "node", "left").withColumns({"cov": F.coalesce("cov", F.lit(0)), "eligible": (F.col("times") == 1) & (F.coalesce("most", F.lit(0)) <= 1)})
    known = known.select("contig", "node", "start", "end", "cov", "eligible")
    if truth is None:
        return known
    spans = truth.select(F.col("contig").alias("t_contig"), (F.col("pos") - 1).alias("t_start"), F.col("stop").alias("t_stop"))
    hit = overlap_join(reference.select("contig", "node", "start", "end"), spans, ("contig", "t_contig"), ("start", "end"), ("t_start", "t_stop")).select("contig", "node").distinct().withColumn("hit", F.lit(True))
    return known.join(hit, ["contig", "node"], "left").withColumn("eligible", F.col("eligible") & F.col("hit").isNull()).drop("hit")


def boundaries(regions: DataFrame, nodes: DataFrame, lengths: DataFrame, window: int = WINDOW, most: int = MOST, fallback: bool = False) -> DataFrame:
    """(region, width, left, right, h, at_start, at_end) of every region (region, contig, a0, b0; closed-open, from 0).

    nodes: of eligible_nodes; lengths: contig, length. Left is the last eligible node that ends by a0, right the first that starts at b0 or
    behind, both with the greatest coverage h of any reference node that the window meets (a0 - width to b0 + width). fallback: with the
    greatest that an eligible node has on that side. Where a side has none and the window reaches that end of the contig, the window's
    outermost node stands in (at_start, at_end), but not as a fallback. Regions that still lack a side are tried again with twice the
    width, and only they; those that lack one at most have null nodes and the last width tried.
    """
    todo = materialize(regions.select("region", "contig", "a0", "b0").join(lengths, "contig"), "unbounded")
    done, width, used = [], window, []
    named = nodes.select(F.col("contig").alias("n_contig"), "node", "start", "end", "cov", "eligible")
    while True:
        probe = todo.withColumns({"lo": F.greatest(F.col("a0") - width, F.lit(0)), "hi": F.least(F.col("b0") + width, F.col("length"))})
        met = overlap_join(probe, named, ("contig", "n_contig"), ("lo", "hi"), ("start", "end"))
        left, right = F.col("eligible") & (F.col("end") <= F.col("a0")), F.col("eligible") & (F.col("start") >= F.col("b0"))
        found = met.groupBy("region").agg(
            F.max("cov").alias("h"),
            F.max_by(F.struct("node", "cov"), F.when(left, F.struct("cov", "end"))).alias("l"),
            F.max_by(F.struct("node", "cov"), F.when(right, F.struct(F.col("cov"), -F.col("start")))).alias("r"),
            F.min_by("node", "start").alias("first"),
            F.max_by("node", "end").alias("last"),
        )
        good = lambda side: F.when(F.lit(fallback) | (F.col(f"{side}.cov") == F.col("h")), F.col(f"{side}.node"))
        at_start, at_end = (F.lit(not fallback) & good("l").isNull() & (F.col("lo") == 0)), (F.lit(not fallback) & good("r").isNull() & (F.col("hi") == F.col("length")))
        both = probe.join(found, "region", "left").select(
            "region", "contig", "a0", "b0", "length", F.lit(width).alias("width"), F.coalesce(good("l"), F.when(at_start, F.col("first"))).alias("left"), F.coalesce(good("r"), F.when(at_end, F.col("last"))).alias("right"),
            "h", (at_start & F.col("first").isNotNull()).alias("at_start"), (at_end & F.col("last").isNotNull()).alias("at_end"), ((F.col("lo") == 0) & (F.col("hi") == F.col("length"))).alias("whole"),
        )
        now = materialize(both, "bounded")
        used.append(todo)
        missing = F.col("left").isNull() | F.col("right").isNull()
        again = missing & ~F.col("whole") if width < most else F.lit(False)
        null = lambda c: F.when(~missing, F.col(c)).alias(c)
        done.append(now.where(~again).select("region", "width", null("left"), null("right"), "h", "at_start", "at_end"))
        rest = now.where(again)
        if not rest.limit(1).count():
            discard(*used)
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out
        todo, width = materialize(rest.select("region", "contig", "a0", "b0", "length"), "unbounded"), width * 2
