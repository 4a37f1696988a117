"""Paths against a reference walk: anchors, pieces between them, pair segments, inflation, mosaics, coarsening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.windows import Names, _list, monotone, offsets, window
from braidwork.plans.scratch import materialize


def anchored(steps: DataFrame, by: Names, path: str, order: str, node: str, length: str, reference: str) -> DataFrame:
    """(by, path, step, node, offset, ref_step, ref_offset): steps on the reference walk's nodes, taken so that both orders grow.

    Of a node that the reference visits again, the first visit counts.
    """
    keys = _list(by)
    placed = offsets(steps, [*keys, path], order, length)
    ref = placed.where(F.col(path) == reference).groupBy(*(F.col(k).alias(f"{k}__") for k in keys), F.col(node).alias("node__")).agg(F.min(F.struct(order, "offset", length)).alias("r_"))
    same = F.col(node) == F.col("node__")
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}__"))
    hits = placed.where(F.col(path) != reference).join(ref, same).select(*keys, path, F.col(order).alias("step"), F.col(node).alias("node"), "offset", F.col(length).alias("len"), F.col(f"r_.{order}").alias("ref_step"), F.col("r_.offset").alias("ref_offset"))
    return monotone(hits, [*keys, path], "step", "ref_step")


def pieces(anchors: DataFrame, by: Names, path: str) -> DataFrame:
    """(by, path, at, ref_length, alt_length): what lies between neighbouring anchors, where either side has something."""
    w = window([*_list(by), path], "step")
    end, ref_end = F.lag(F.col("offset") + F.col("len")).over(w), F.lag(F.col("ref_offset") + F.col("len")).over(w)
    made = anchors.withColumn("at", ref_end).withColumn("alt_length", F.col("offset") - end).withColumn("ref_length", F.col("ref_offset") - ref_end)
    return made.where("at IS NOT NULL AND (alt_length > 0 OR ref_length > 0)").select(*_list(by), path, "at", "ref_length", "alt_length")


def inflation(found: DataFrame, by: Names, path: str, large: int = 50) -> DataFrame:
    """(by, paths, large_pieces, indel, net): pieces of a large size, and inserted and deleted lengths against the net change of each path."""
    keys = _list(by)
    size = F.abs(F.col("alt_length") - F.col("ref_length"))
    per = found.groupBy(*keys, path).agg(F.count_if(F.greatest("alt_length", "ref_length") >= large).alias("large_pieces"), F.sum(size).alias("indel"), F.abs(F.sum(F.col("alt_length") - F.col("ref_length"))).alias("net"))
    return per.groupBy(*keys).agg(F.count("*").alias("paths"), F.sum("large_pieces").alias("large_pieces"), F.sum("indel").alias("indel"), F.sum("net").alias("net"))


def extensions(walks: DataFrame, panel: DataFrame, by: Names = ()) -> DataFrame:
    """(by, walk, step, panel, kind, at, upto): each step of a walk that a panel walk also takes, and the step up to which both agree from
    there on.

    walks: by, walk, step, node; panel: by, panel, kind, step, node; steps count from 0. Steps meet by an equi-join on nodes; agreeing
    stretches are runs of consecutive steps at one distance between the two walks.
    """
    keys = _list(by)
    other = panel.select(*keys, "panel", "kind", F.col("step").alias("at"), "node")
    met = walks.select(*keys, "walk", "step", "node").join(other, [*keys, "node"]).withColumn("far", F.col("at") - F.col("step"))
    line = [*keys, "walk", "panel", "far"]
    runs = met.withColumn("run", F.col("step") - F.row_number().over(window(line, "step")))
    return runs.withColumn("upto", F.max("step").over(W.partitionBy(*line, "run"))).select(*keys, "walk", "step", "panel", "kind", "at", "upto")


def _neighbours(rows: DataFrame, *names: str) -> DataFrame:
    """(names, step, node) of rows (names, s array<struct<step, node>>): node is the pair of a step's node and the next one's."""
    pairs = rows.where(F.size("s") > 1).select(*names, F.explode(F.arrays_zip(F.expr("slice(s, 1, size(s) - 1)").alias("a"), F.expr("slice(s, 2, size(s) - 1)").alias("b"))).alias("p"))
    met = pairs.where("p.b.step = p.a.step + 1 AND p.a.node IS NOT NULL AND p.b.node IS NOT NULL")
    return met.select(*names, F.col("p.a.step").alias("step"), F.struct(F.col("p.a.node").alias("a"), F.col("p.b.node").alias("b")).alias("node"))


def mosaics(walks: DataFrame, panel: DataFrame, kinds: list[str], by: Names = (), own: str = "sample") -> DataFrame:
    """(by, walk, label, pieces array<struct<first, last, kind>>, novel): how each walk is made of panel walks.

    A walk is cut into pieces from its begin: each is the longest stretch that a panel walk has from there, ties going to the kind that
    comes first in kinds; a step that no panel walk takes is a piece of kind novel. label: verbatim if a panel walk of kind own is the
    whole walk, copy_of_<kind> if only one of another kind is (the first in kinds that does so; kind partial does not count), junction
    for two pieces of kind own, mosaic_<n> for other numbers of them, else mixed(<kinds of the pieces, joined by +>).
    """
    keys = _list(by)
    rank = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
    own_rows = lambda df, *more: df.groupBy(*keys, *more).agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("s"))
    made, given = materialize(own_rows(walks, "walk"), "mosaic-walks"), materialize(own_rows(panel, "panel", "kind"), "mosaic-panel")
    full = F.forall("s", lambda x: x["node"].isNotNull())
    same = given.where(full & ((F.col("kind") == own) | (F.col("kind") != "partial"))).groupBy(*keys, "s").agg(F.min(F.struct((F.col("kind") != own).alias("a"), rank.alias("b"), "kind")).alias("whole"))
    whole = made.where(full).join(same, [*keys, "s"]).select(*keys, "walk", "whole")
    # Stretches of two steps and more meet by their pairs of neighbouring nodes; for single steps a node's first kind is enough.
    found = extensions(_neighbours(made, *keys, "walk"), _neighbours(given, *keys, "panel", "kind"), keys)
    best = found.groupBy(*keys, "walk", "step").agg(F.max(F.struct((F.col("upto") + 1).alias("upto"), (-rank).alias("r"), "kind")).alias("x"))
    steps = lambda df, *more: df.select(*keys, *more, F.explode("s").alias("s")).select(*keys, *more, "s.*")
    one = steps(given, "kind").groupBy(*keys, "node").agg(F.max(F.struct((-rank).alias("r"), "kind")).alias("y"))
    each = steps(made, "walk").join(one, [*keys, "node"], "left").join(best, [*keys, "walk", "step"], "left")
    each = each.select(*keys, "walk", F.struct("step", F.coalesce("x.upto", "step").alias("upto"), F.coalesce("x.kind", "y.kind", F.lit("novel")).alias("kind")).alias("s"))
    piece = "struct<first: bigint, last: bigint, kind: string>"

    def taken(state: Column, s: Column) -> Column:
        new = F.struct(s["step"].cast("long").alias("first"), s["upto"].cast("long").alias("last"), s["kind"].alias("kind"))
        more = F.struct((s["upto"] + 1).cast("long").alias("next"), F.concat(state["pieces"], F.array(new)).alias("pieces"))
        return F.when(s["step"] == state["next"], more).otherwise(state)

    empty = F.struct(F.lit(0).cast("long").alias("next"), F.array().cast(f"array<{piece}>").alias("pieces"))
    rows = each.groupBy(*keys, "walk").agg(F.sort_array(F.collect_list("s")).alias("s")).select(*keys, "walk", F.aggregate("s", empty, taken)["pieces"].alias("pieces"))
    of = F.transform("pieces", lambda p: p["kind"])
    n = F.size("pieces")
    told = F.when(F.forall(of, lambda k: k == own), F.when(n == 2, "junction").otherwise(F.concat(F.lit("mosaic_"), n.cast("string")))).otherwise(F.concat(F.lit("mixed("), F.array_join(of, "+"), F.lit(")")))
    label = F.when(F.col("whole.kind") == own, "verbatim").when(F.col("whole.kind").isNotNull(), F.concat(F.lit("copy_of_"), F.col("whole.kind"))).otherwise(told)
    return rows.join(whole, [*keys, "walk"], "left").select(*keys, "walk", label.alias("label"), "pieces", F.size(F.filter(of, lambda k: k == "novel")).cast("long").alias("novel"))


def coarsened(cells: DataFrame, by: Names, least: int) -> DataFrame:
    """(by, part, kind, lo, hi, seq, rows): runs of at least so many columns with one base in all rows, and whole alleles between them.

    Rows that are dealt by (by, row) before they are exploded to cells are not shuffled again.
    """
    from braidwork.operators.windows import conserved_runs

    keys = _list(by)
    letters = cells.select(*keys, "col", "ch").distinct()  # hashed: the greatest of letters would sort all cells of a task
    same = letters.groupBy(*keys, "col").agg(F.count("ch").alias("n"), F.max("ch").alias("ch")).where("n = 1 AND ch <> '-'")
    # written, so that Spark knows how few there are before it chooses the join
    runs = materialize(conserved_runs(same, keys, "col", least).select(*(F.col(k).alias(f"{k}__") for k in keys), "lo", "hi"), "coarse-runs")
    on = (F.col("col") >= F.col("lo")) & (F.col("col") <= F.col("hi"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}__"))
    marked = cells.join(runs, on, "left").withColumn("anchor", F.col("lo").isNotNull())
    w = window([*keys, "row"], "col")
    change = F.when(F.col("lo").eqNullSafe(F.lag("lo").over(w)), 0).otherwise(1)
    numbered = marked.withColumn("new_", change).withColumn("part", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    spelt = numbered.groupBy(*keys, "part", "anchor", "row").agg(F.min("col").alias("lo"), F.max("col").alias("hi"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "ch"))), lambda x: F.when(x["ch"] == "-", "").otherwise(x["ch"])), "").alias("seq"))
    return spelt.groupBy(*keys, "part", "anchor", "seq").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("rows"))


def cluster_split(pairs: DataFrame, clusters: DataFrame, a: str, b: str, cost: str, optimum: str) -> DataFrame:
    """(within, cost, optimum, ratio): sums over pairs of one cluster and of two; clusters: (id, cluster)."""
    x, y = clusters.select(F.col("id").alias("i1"), F.col("cluster").alias("c1")), clusters.select(F.col("id").alias("i2"), F.col("cluster").alias("c2"))
    j = pairs.join(x, F.col(a) == F.col("i1")).join(y, F.col(b) == F.col("i2")).groupBy((F.col("c1") == F.col("c2")).alias("within"))
    return j.agg(F.sum(cost).alias("cost"), F.sum(optimum).alias("optimum")).withColumn("ratio", F.try_divide(F.col("cost").cast("double"), F.col("optimum")))


def same_places(a: DataFrame, b: DataFrame, by: Names) -> DataFrame:
    """(by, node_a, node_b, at): nodes of two graphs that begin at one offset of a path both have; a, b: (by, node, offset)."""
    keys = _list(by)
    return a.select(*keys, F.col("offset").alias("at"), F.col("node").alias("node_a")).join(b.select(*keys, F.col("offset").alias("at"), F.col("node").alias("node_b")), [*keys, "at"])
