"""Candidate walks spliced into a larger graph in place of what its walks do inside regions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions.sequences import reverse_complement
from braidwork.operators.windows import islands, running_sums
from braidwork.plans.scratch import materialize

#: Longer nodes are cut.
MAX_NODE = 1024


class Spliced(NamedTuple):
    regions: DataFrame
    nodes: DataFrame
    steps: DataFrame
    edges: DataFrame


def crossings(steps: DataFrame, inside: DataFrame, regions: DataFrame) -> DataFrame:
    """(path, run, region, first, last, kind): the runs of a walk's consecutive steps in one region.

    kind: along (from the left anchor to the right one, both forwards), against (the other way round), else starts_inside,
    ends_inside (the walk does) or not_anchor_to_anchor.
    """
    marked = steps.select("path", "step", "node", "rev").join(inside.select("node", "region"), "node", "left")
    whole = W.partitionBy("path")
    runs = islands(marked.withColumns({"from_": F.min("step").over(whole), "to_": F.max("step").over(whole)}), "path", "step", "region", "run").where("region IS NOT NULL")
    at = runs.groupBy("path", "run", "region").agg(
        F.min("step").alias("first"), F.max("step").alias("last"), F.min_by(F.struct("node", "rev"), "step").alias("a"), F.max_by(F.struct("node", "rev"), "step").alias("b"), F.first("from_").alias("from_"), F.first("to_").alias("to_")
    )
    met = at.join(regions.select("region", "left", "right"), "region")
    along = (F.col("a.node") == F.col("left")) & ~F.col("a.rev") & (F.col("b.node") == F.col("right")) & ~F.col("b.rev")
    against = (F.col("a.node") == F.col("right")) & F.col("a.rev") & (F.col("b.node") == F.col("left")) & F.col("b.rev")
    kind = F.when(along, "along").when(against, "against").when(F.col("first") == F.col("from_"), "starts_inside").when(F.col("last") == F.col("to_"), "ends_inside").otherwise("not_anchor_to_anchor")
    return met.select("path", "run", "region", "first", "last", kind.alias("kind"))


def _spelled(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, seq): what rows (keys, order, seq, rev) spell; a region's stretch of one walk is one string."""
    own = F.when(F.col("rev"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return rows.select(*keys, F.struct(*order, own.alias("s")).alias("x")).groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), "").alias("seq"))


def _turned(order: Column, against: Column) -> Column:
    return F.when(against, -order).otherwise(order)


def spliced(steps: DataFrame, nodes: DataFrame, edges: DataFrame, inside: DataFrame, regions: DataFrame, pieces: DataFrame, walks: DataFrame, piece_edges: DataFrame | None = None, max_node: int = MAX_NODE) -> Spliced:
    """The graph with every region replaced whose candidate fits, or left as it is.

    steps: path, step, node, rev; nodes: node (long), seq; edges: src, src_rev, dst, dst_rev; inside: region, node (a node is in one
    region at most); regions: region, left, right, the anchor nodes. pieces: region, piece (long), seq and walks: region, path, step,
    piece, rev are the candidates; piece_edges: region, src, src_rev, dst, dst_rev between pieces.

    A region is patched if it has a candidate, all its runs are along or against, every path that crosses does so once and has a walk
    in the candidate that spells the same, and every walk of the candidate crosses. Else status names what is wrong: no_candidate, the
    counts of bad runs, or the first reason of the least path. New nodes, cut to max_node, are numbered in the order of their pieces:
    spread evenly over the free numbers between the anchors' (those that nodes there gave up, and gaps) where these are enough and no
    other region asks for one of them; else from behind the greatest number on, regions in order, by sums over ranges of them. Steps
    are numbered anew from 1. regions: (region, status, crossing, new_nodes, interleaved).
    """
    runs = materialize(crossings(steps, inside, regions), "crossings")
    good = F.col("kind").isin("along", "against")
    bad = runs.where(~good).groupBy("region", "kind").count().groupBy("region").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "kind", "count"))), ",").alias("bad"))
    crossing = runs.where(good)

    stretch = steps.join(crossing.select(F.col("path").alias("p_"), "region", "first", "last", "kind"), (F.col("path") == F.col("p_")) & F.col("step").between(F.col("first"), F.col("last")))
    stretch = stretch.join(nodes, "node").select("region", "path", _turned(F.col("step"), F.col("kind") == "against").alias("step"), "seq", (F.col("rev") != (F.col("kind") == "against")).alias("rev"))
    times = crossing.groupBy("region", "path").agg(F.count("*").alias("times"))
    is_now = _spelled(stretch, ["region", "path"], ["step"]).withColumnRenamed("seq", "now")
    to_be = _spelled(walks.join(pieces, ["region", "piece"]), ["region", "path"], ["step"]).withColumnRenamed("seq", "wanted")
    both = times.join(is_now, ["region", "path"]).join(to_be, ["region", "path"], "full")
    named = lambda reason: F.concat(F.lit(reason), F.lit(":"), F.col("path").cast("string"))
    why = (
        F.when(F.col("times").isNull(), named("candidate_path_not_crossing")).when(F.col("wanted").isNull(), named("crossing_path_not_in_candidate"))
        .when(F.col("times") > 1, F.concat(F.lit("path_crosses_"), F.col("times").cast("string"), F.lit("_times:"), F.col("path").cast("string")))
        .when(F.col("now") != F.col("wanted"), named("sequence_differs"))
    )
    judged = both.groupBy("region").agg(F.min_by(why, F.when(why.isNotNull(), F.col("path"))).alias("why"), F.sum(F.coalesce("times", F.lit(0))).alias("crossing"))
    offered = pieces.select("region").distinct().withColumn("offered", F.lit(True))
    status = F.when(F.col("offered").isNull(), "no_candidate").otherwise(F.coalesce(F.concat(F.lit("unpatched:"), F.coalesce("bad", "why")), F.lit("patched")))
    states = regions.select("region", "left", "right").join(offered, "region", "left").join(bad, "region", "left").join(judged, "region", "left")
    states = materialize(states.select("region", "left", "right", status.alias("status"), F.coalesce("crossing", F.lit(0)).alias("crossing")), "splice-states")
    patched = states.where("status = 'patched'").select("region", "left", "right")

    # New nodes and their numbers.
    removed = inside.join(patched.select("region"), "region", "left_semi").select("node")
    kept = nodes.join(removed, "node", "left_anti")
    chunk = F.expr(f"transform(sequence(0, greatest(length(seq) - 1, 0) div {max_node}), i -> struct(i as chunk, substring(seq, i * {max_node} + 1, {max_node}) as part))")
    cut = pieces.join(patched.select("region"), "region", "left_semi").select("region", "piece", F.explode(chunk).alias("c")).select("region", "piece", F.col("c.chunk").cast("long").alias("chunk"), F.col("c.part").alias("seq"))
    nth = materialize(cut.withColumn("k", (F.row_number().over(W.partitionBy("region").orderBy("piece", "chunk")) - 1).cast("long")), "splice-pieces")
    sizes = patched.join(nth.groupBy("region").agg(F.count("*").alias("n_new")), "region")
    asked = sizes.select("region", "n_new", F.explode(F.sequence(F.least("left", "right"), F.greatest("left", "right"))).alias("node")).join(kept.select("node"), "node", "left_anti")
    asked = materialize(asked, "splice-free")
    shared = asked.join(asked.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "node", "left_semi").select("region").distinct()
    free = asked.join(shared, "region", "left_anti").withColumns({"f": (F.row_number().over(W.partitionBy("region").orderBy("node")) - 1).cast("long"), "n_free": F.count("*").over(W.partitionBy("region"))}).where("n_free >= n_new")
    room = free.select("region", "n_free").distinct()
    inter = nth.join(sizes.select("region", "n_new"), "region").join(room, "region").withColumn("f", F.least(F.col("n_free") - 1, F.floor(F.col("k") * (F.col("n_free").cast("double") / F.col("n_new")))))
    inter = inter.join(free.select("region", "f", "node"), ["region", "f"]).select("region", "piece", "chunk", "seq", "node")
    top = nodes.agg(F.coalesce(F.max("node"), F.lit(-1))).first()[0] + 1
    rest = running_sums(sizes.join(room, "region", "left_anti").select("region", "n_new"), "region", ["n_new"])
    behind = nth.join(rest, "region").select("region", "piece", "chunk", "seq", (F.lit(top) + F.col("before_n_new") + F.col("k")).cast("long").alias("node"))
    new = materialize(inter.unionByName(behind), "splice-nodes")

    # Walks: steps outside patched runs stay, and each run's place is taken by its candidate's.
    used = crossing.join(patched.select("region"), "region", "left_semi").select(F.col("path").alias("p_"), "region", "first", "last", (F.col("kind") == "against").alias("against"))
    gone = steps.join(used, (F.col("path") == F.col("p_")) & F.col("step").between(F.col("first"), F.col("last")), "left_anti")
    stay = gone.select("path", F.col("step").alias("at"), F.lit(0).cast("long").alias("nth"), F.lit(0).cast("long").alias("sub"), "node", "rev")
    put = walks.join(used, (F.col("path") == F.col("p_")) & (walks["region"] == used["region"])).drop(used["region"]).join(new.select("region", "piece", "chunk", "node"), ["region", "piece"])
    sub = _turned(F.col("chunk"), F.col("rev"))
    put = put.select("path", F.col("first").alias("at"), _turned(F.col("step"), F.col("against")).cast("long").alias("nth"), _turned(sub, F.col("against")).alias("sub"), "node", (F.col("rev") != F.col("against")).alias("rev"))
    number = F.row_number().over(W.partitionBy("path").orderBy("at", "nth", "sub"))
    walked = materialize(stay.unionByName(put).select("path", number.cast("long").alias("step"), "node", "rev"), "splice-steps")

    # Edges: those between nodes that stay, those inside cut pieces and between pieces, those that the new walks take.
    w = W.partitionBy("path").orderBy("step")
    pair = ["src", "src_rev", "dst", "dst_rev"]
    taken = walked.select(F.col("node").alias("src"), F.col("rev").alias("src_rev"), F.lead("node").over(w).alias("dst"), F.lead("rev").over(w).alias("dst_rev")).where("dst IS NOT NULL")
    a, b = removed.select(F.col("node").alias("src")), removed.select(F.col("node").alias("dst"))
    old = edges.select(*pair).join(a, "src", "left_anti").join(b, "dst", "left_anti").select(*pair)
    after = F.lead("node").over(W.partitionBy("region", "piece").orderBy("chunk"))
    links = new.select(F.col("node").alias("src"), F.lit(False).alias("src_rev"), after.alias("dst"), F.lit(False).alias("dst_rev")).where("dst IS NOT NULL")
    found = old.unionByName(links).unionByName(taken)
    if piece_edges is not None:
        ends = new.groupBy("region", "piece").agg(F.min_by("node", "chunk").alias("head"), F.max_by("node", "chunk").alias("tail"))
        s, t = (ends.select("region", F.col("piece").alias(c), F.col("head").alias(f"{c}_head"), F.col("tail").alias(f"{c}_tail")) for c in ("src", "dst"))
        e = piece_edges.join(s, ["region", "src"]).join(t, ["region", "dst"])
        found = found.unionByName(e.select(F.when(F.col("src_rev"), F.col("src_head")).otherwise(F.col("src_tail")).alias("src"), "src_rev", F.when(F.col("dst_rev"), F.col("dst_tail")).otherwise(F.col("dst_head")).alias("dst"), "dst_rev"))
    canonical = F.least(F.struct(*pair), F.struct(F.col("dst").alias("src"), (~F.col("dst_rev")).alias("src_rev"), F.col("src").alias("dst"), (~F.col("src_rev")).alias("dst_rev")))
    report = states.join(sizes.select("region", "n_new"), "region", "left").join(room.select("region", F.lit(True).alias("roomy")), "region", "left")
    report = report.select("region", "status", "crossing", F.col("n_new").alias("new_nodes"), F.when(F.col("n_new").isNotNull(), F.coalesce("roomy", F.lit(False))).alias("interleaved"))
    return Spliced(report, kept.select("node", "seq").unionByName(new.select("node", "seq")), walked, found.select(canonical.alias("e")).select("e.*").distinct())
