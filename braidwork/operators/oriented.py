"""Graphs whose nodes are walked in both directions: chains on handle sides, and walks carried over to the merged graph.

A handle is a node with a direction (rev); each node has a left and a right side. An edge leaves a handle by the side in front
and enters the next by the side behind, so the same edge is walked backwards between the flipped handles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions.sequences import reverse_complement
from braidwork.plans.scratch import discard, materialize


def sides(edges: DataFrame) -> DataFrame:
    """(node, right, node2, right2): both ways between the sides that an edge (src, src_rev, dst, dst_rev) joins, each once."""
    out = edges.select(F.col("src").alias("node"), (~F.col("src_rev")).alias("right"), F.col("dst").alias("node2"), F.col("dst_rev").alias("right2"))
    back = out.select(F.col("node2").alias("node"), F.col("right2").alias("right"), F.col("node").alias("node2"), F.col("right").alias("right2"))
    return out.unionByName(back).distinct()


def walk_ends(steps: DataFrame, path: str = "path", order: str = "step") -> DataFrame:
    """(node, right): the sides at which walks (path, order, node, rev) begin or end."""
    at = steps.groupBy(path).agg(F.min_by(F.struct("node", "rev"), order).alias("a"), F.max_by(F.struct("node", "rev"), order).alias("b"))
    return at.select(F.explode(F.array(F.struct(F.col("a.node").alias("node"), F.col("a.rev").alias("right")), F.struct(F.col("b.node").alias("node"), (~F.col("b.rev")).alias("right")))).alias("s")).select("s.*").distinct()


def side_joins(edges: DataFrame, ends: DataFrame | None = None, same_strand: bool = False) -> DataFrame:
    """(node, right, node2, right2): both ways, sides that have only each other, belong to two nodes and are no end of a walk.

    same_strand: only joins of a right side to a left one.
    """
    met = sides(edges)
    one = met.groupBy("node", "right").agg(F.count("*").alias("n"), F.first("node2").alias("node2"), F.first("right2").alias("right2")).where("n = 1").drop("n")
    if ends is not None:
        one = one.join(ends.select("node", "right"), ["node", "right"], "left_anti")
    back = one.select(F.col("node").alias("b_node"), F.col("right").alias("b_right"), F.col("node2").alias("a_node"), F.col("right2").alias("a_right"))
    both = one.join(back, (F.col("node") == F.col("a_node")) & (F.col("right") == F.col("a_right")) & (F.col("node2") == F.col("b_node")) & (F.col("right2") == F.col("b_right")), "left_semi")
    return both.where((F.col("node") != F.col("node2")) & ((F.col("right") != F.col("right2")) if same_strand else F.lit(True)))


#: Joins after which a task merges what it holds, at the next change of near.
HELD = 1 << 18


def _lone_sides(edges: DataFrame, ends: DataFrame | None, same_strand: bool) -> DataFrame:
    """(node, right, node2, right2, near, open): sides with one other only, as side_joins has them, before that one is asked.

    near: where the join is merged with others, alike for both of its sides. open: the node's other side is such a one too, elsewhere.
    """
    near = F.col("near") if "near" in edges.columns else F.hash("src", "src_rev", "dst", "dst_rev")
    way = lambda n, r, n2, r2: F.struct(F.col(n).alias("node"), r.alias("right"), F.struct(F.col(n2).alias("node"), r2.alias("right"), near.alias("near")).alias("to"))
    met = edges.select(F.explode(F.array(way("src", ~F.col("src_rev"), "dst", F.col("dst_rev")), way("dst", F.col("dst_rev"), "src", ~F.col("src_rev")))).alias("s")).select("s.*")
    if ends is not None:
        met = met.unionByName(ends.select("node", "right"), allowMissingColumns=True)
    here = {False: ~F.col("right"), True: F.col("right")}
    at = met.groupBy("node").agg(*(f(F.when(here[r], v)).alias(f"{n}{r}") for r in here for n, f, v in (("lo", F.min, F.col("to")), ("hi", F.max, F.col("to")), ("end", F.max, F.col("to").isNull()))))

    def lone(r: bool) -> Column:
        lo, hi = F.col(f"lo{r}"), F.col(f"hi{r}")
        free = (lo["node"] == hi["node"]) & (lo["right"] == hi["right"]) & ~F.col(f"end{r}") & (lo["node"] != F.col("node"))
        return F.when(free & (lo["right"] != F.lit(r)) if same_strand else free, lo)

    one = at.select("node", lone(False).alias("l"), lone(True).alias("r"))
    side = lambda r, own, other: F.struct(F.lit(r).alias("right"), F.col(own).alias("to"), F.coalesce(F.col(f"{other}.near") != F.col(f"{own}.near"), F.lit(False)).alias("open"))
    both = one.select("node", F.explode(F.array(side(False, "l", "r"), side(True, "r", "l"))).alias("s")).where("s.to IS NOT NULL")
    return both.select("node", "s.right", F.col("s.to.node").alias("node2"), F.col("s.to.right").alias("right2"), F.col("s.to.near").alias("near"), "s.open")


def _runs(batches):
    """What the joins of a task give, some nears at a time (see _merge); a near is never divided."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= HELD:
            t = pa.Table.from_batches(held)
            same = pc.equal(t["near"], t["near"][-1]).to_numpy()
            cut = int(np.argmax(same))  # rows come in order of near
            if cut:
                yield _merge(t.slice(0, cut))
                held, n = t.slice(cut).to_batches(), len(t) - cut
    if n:
        yield _merge(pa.Table.from_batches(held))


def _merge(t: pa.Table) -> pa.RecordBatch:
    """Rows (kind, node, right, head, nth, rev, last) of the runs of joins t (a, a_right, b, b_right, a_open, b_open).

    Whole chains give their nodes (kind 0: as oriented_chains). A run that may go on elsewhere gives a join of its ends (2: node's side
    right with head's side rev, nth places on) and the nodes between (1: nth places on from head, which is read backwards if right;
    rev: the node then lies backwards). Handles and sides are 2 * node, one more if backwards or right.
    """
    names = pa.concat_arrays([*t["a"].chunks, *t["b"].chunks]).dictionary_encode()
    code, rows, m = names.indices.to_numpy(), len(t), len(names.dictionary)
    flag = lambda c: t[c].to_numpy().astype(np.int64)
    a, b = 2 * code[:rows].astype(np.int64) + flag("a_right"), 2 * code[rows:].astype(np.int64) + flag("b_right")
    mate, goes_on = np.full(2 * m, -1), np.zeros(2 * m, bool)
    mate[a], mate[b] = b, a
    goes_on[a ^ 1], goes_on[b ^ 1] = t["a_open"].to_numpy(), t["b_open"].to_numpy()
    top, nth = np.where(mate < 0, np.arange(2 * m), mate ^ 1), (mate >= 0).astype(np.int64)
    for _ in range((2 * m).bit_length()):
        if not nth[top].any():
            break
        nth, top = nth + nth[top], top[top]
    x = np.flatnonzero(mate[top[0::2]] < 0)  # not on cycles
    t0, t1, n0, n1 = top[2 * x], top[2 * x + 1], nth[2 * x], nth[2 * x + 1]
    rank = np.empty(m, np.int64)
    rank[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(m)
    cut = goes_on[t0] | goes_on[t1]
    order = lambda h: np.where(cut, 0, h & 1) * m + rank[h >> 1]
    back = order(t1) < order(t0)
    head, k, last = np.where(back, t1, t0), np.where(back, n1, n0), n0 + n1
    kind = np.where(cut, np.where(k == last, 2, 1), 0)
    keep = ~cut | (k > 0)
    x, head, k, last, kind, back = (v[keep] for v in (x, head, k, last, kind, back))
    link = kind == 2
    name = lambda v: names.dictionary.take(pa.array(v))
    right = np.where(link, (head & 1) == 0, (head & 1) == 1)
    cols = [pa.array(kind.astype(np.int32)), name(np.where(link, head >> 1, x)), pa.array(right), name(np.where(link, x, head >> 1)), pa.array(k), pa.array(back), pa.array(last)]
    return pa.RecordBatch.from_arrays(cols, ["kind", "node", "right", "head", "nth", "rev", "last"])


def _ends_of_runs(links: DataFrame) -> DataFrame:
    """(node, head, nth, rev, last) for the ends of runs that links (node, right, head, rev, nth) join to chains; without cycles.

    Rounds of jumping over pointers between handles double what each handle knows, so there are as many as the logarithm of the most
    runs in a chain, and one more.
    """
    joins = links.select("node", "right", F.col("head").alias("node2"), F.col("rev").alias("right2"), "nth")
    joins = joins.unionByName(joins.select(F.col("node2").alias("node"), F.col("right2").alias("right"), F.col("node").alias("node2"), F.col("right").alias("right2"), "nth"))
    # The handle before (node, rev): its side behind, left if forwards, is joined to the other's side in front.
    before = joins.select("node", F.col("right").alias("rev"), F.col("node2").alias("up"), (~F.col("right2")).alias("up_rev"), "nth")
    handles = joins.select("node").distinct().select("node", F.explode(F.array(F.lit(False), F.lit(True))).alias("rev"))
    first = handles.join(before, ["node", "rev"], "left").select("node", "rev", F.coalesce("up", "node").alias("head"), F.coalesce("up_rev", "rev").alias("head_rev"), F.coalesce("nth", F.lit(0)).alias("nth"), F.col("up").isNotNull().alias("moved"))
    now = materialize(first, "handles")
    for _ in range(now.count().bit_length()):  # after so many rounds only cycles still move
        if not now.where("moved").limit(1).count():
            break
        above = now.select(F.col("node").alias("n2"), F.col("rev").alias("r2"), F.col("head").alias("h2"), F.col("head_rev").alias("hr2"), F.col("nth").alias("k2"))
        step = now.join(above, (F.col("head") == F.col("n2")) & (F.col("head_rev") == F.col("r2")))
        new = step.select("node", "rev", F.col("h2").alias("head"), F.col("hr2").alias("head_rev"), (F.col("nth") + F.col("k2")).alias("nth"), (F.col("k2") > 0).alias("moved"))
        read, now = now, materialize(new, "handles")
        discard(read)
    ended = now.select(F.col("node").alias("e_node"), F.col("rev").alias("e_rev"), F.col("nth").alias("e_nth")).where("e_nth = 0")
    known = now.join(ended, (F.col("head") == F.col("e_node")) & (F.col("head_rev") == F.col("e_rev")), "left_semi")  # not on cycles
    # Both readings of a chain hold each node, once a direction: the better beginning is chosen node by node, alike for all of a chain.
    best = known.groupBy("node").agg(F.min_by(F.struct("head", "nth", "rev"), F.struct("head_rev", "head", "rev")).alias("at"), F.sum("nth").alias("last"))
    return best.select("node", "at.head", "at.nth", "at.rev", "last")


def oriented_chains(nodes: DataFrame, edges: DataFrame, ends: DataFrame | None = None, same_strand: bool = False) -> DataFrame:
    """(node, head, nth, rev, last): the chain of each node of nodes, its place from 0, whether it lies backwards, the last place.

    Chains are runs of side_joins; a node of none is one of its own. A chain is read from the end whose node lies forwards;
    where both or neither do, from the lesser one. It is named by the first node read. Cycles have no end to begin at: their nodes
    stay unmerged. Edges may repeat, and name no nodes but those of nodes.

    edges may have a column near (int): joins of equal near come together and are merged in their task, so that only the ends of runs
    are left for the rounds between tasks. Walks' parts do; it decides where the work is done, not what comes out, and should be
    bounded (some thousand steps of a walk).
    """
    mine, other = F.struct("node", "right"), F.struct(F.col("node2").alias("node"), F.col("right2").alias("right"))
    lone = _lone_sides(edges, ends, same_strand).select("near", F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b"), F.when(mine < other, F.col("open")).alias("a_open"), F.when(mine > other, F.col("open")).alias("b_open"))
    sides_ = lone.select("near", F.col("a.node").alias("a"), F.col("a.right").alias("a_right"), F.col("b.node").alias("b"), F.col("b.right").alias("b_right"), "a_open", "b_open")
    joins = sides_.repartition("near").groupBy("near", "a", "a_right", "b", "b_right").agg(F.max("a_open").alias("a_open"), F.max("b_open").alias("b_open"), F.count("*").alias("n")).where("n = 2").drop("n")
    t = edges.schema["src"].dataType.simpleString()
    local = materialize(joins.sortWithinPartitions("near").mapInArrow(_runs, f"kind int, node {t}, right boolean, head {t}, nth bigint, rev boolean, last bigint"), "runs")
    found = local.where("kind = 0").select("node", "head", "nth", "rev", "last")
    links = local.where("kind = 2")
    if links.limit(1).count():
        tips = materialize(_ends_of_runs(links), "tips")
        at = tips.select(*(F.col(c).alias(f"t_{c}") for c in tips.columns))
        along = F.col("t_rev") == F.col("right")
        between = local.where("kind = 1").join(at, F.col("head") == F.col("t_node")).select("node", F.col("t_head").alias("head"), F.when(along, F.col("t_nth") + F.col("nth")).otherwise(F.col("t_nth") - F.col("nth")).alias("nth"), (F.col("rev") == along).alias("rev"), F.col("t_last").alias("last"))
        found = found.unionByName(tips).unionByName(between)
    alone = nodes.select("node").distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("nth"), F.lit(False).alias("rev"), F.lit(0).cast("long").alias("last")))


def merged_nodes(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """(node, seq): what each chain spells, members that lie backwards reverse-complemented; nodes (node, seq)."""
    own = nodes.join(chains, "node").select("head", "nth", F.when(F.col("rev"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("s_"))
    return own.groupBy(F.col("head").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "s_"))), lambda x: x["s_"]), "").alias("seq"))


def _ways_in(chains: DataFrame) -> DataFrame:
    """(c_node, c_rev, c_head, c_head_rev): the handles by which chains are entered, and those of the chains."""
    both = chains.select("node", "head", "nth", "last", F.col("rev").alias("lies"), F.explode(F.array(F.lit(False), F.lit(True))).alias("rev")).withColumn("against", F.col("rev") != F.col("lies"))
    return both.where(F.col("nth") == F.when(F.col("against"), F.col("last")).otherwise(0)).select(F.col("node").alias("c_node"), F.col("rev").alias("c_rev"), F.col("head").alias("c_head"), F.col("against").alias("c_head_rev"))


def merged_edges(edges: DataFrame, chains: DataFrame) -> DataFrame:
    """(src, src_rev, dst, dst_rev): the edges between chains, each once as it was walked; those inside a chain go."""
    # A chain is left by a handle where it is entered by the same, flipped.
    left = edges.join(_ways_in(chains), (F.col("src") == F.col("c_node")) & (F.col("src_rev") == ~F.col("c_rev"))).select(F.col("c_head").alias("src"), (~F.col("c_head_rev")).alias("src_rev"), "dst", "dst_rev")
    to = chains.select(F.col("node").alias("c_node"), F.col("head").alias("c_head"), F.col("rev").alias("c_rev"))
    return left.join(to, F.col("dst") == F.col("c_node")).select("src", "src_rev", F.col("c_head").alias("dst"), (F.col("dst_rev") != F.col("c_rev")).alias("dst_rev")).distinct()


def merged_walks(steps: DataFrame, chains: DataFrame, path: str = "path", order: str = "step") -> DataFrame:
    """(path, step, node, rev): walks over the chains, steps numbered anew from 1. Chains must not run on over an end of a walk."""
    entered = steps.join(_ways_in(chains), (F.col("node") == F.col("c_node")) & (F.col("rev") == F.col("c_rev")))
    number = F.row_number().over(W.partitionBy(path).orderBy(order))
    return entered.select(path, number.alias("step"), F.col("c_head").alias("node"), F.col("c_head_rev").alias("rev"))
