"""Graph operators over edge and step tables: reachability, cycles, cut points, unary chains, sibling merges.

Fixpoints are loops of joins; each round is written to the shared folder, so plans stay short and lost executors cost one
round. Rounds are bounded by the longest path (reachability, peeling) or its logarithm (pointer jumping).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.windows import Names, _list, running_sums, window
from braidwork.plans.scratch import discard, materialize, partitions


#: Rounds after which the tables of a fixpoint are written as one.
GATHER = 8


def fixpoint(start: DataFrame, step) -> DataFrame:
    """start and all that step adds: step(frontier) gives candidate rows, those not seen yet are the next frontier."""
    seen = frontier = materialize(start.distinct(), "seed")
    keys, tables = start.columns, [seen]
    while True:
        frontier = materialize(step(frontier).select(*keys).distinct().join(seen, keys, "left_anti"), "frontier")
        if not frontier.limit(1).count():
            return seen
        tables.append(frontier)
        seen = seen.unionByName(frontier)
        if len(tables) > GATHER:
            seen = materialize(seen, "seen")
            discard(*tables[:-1])
            tables = [seen, frontier]


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): seeds (node) and all nodes that walks over edges (src, dst) reach from them. Edges are made once, not in each round."""
    e = edges if hasattr(edges, "scratch_path") else materialize(edges.select("src", "dst"), "reach-edges")
    found = fixpoint(seeds.select("node"), lambda f: f.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")))
    if e is not edges:
        discard(e)
    return found


def between(edges: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """(node): nodes on a walk from a source to a sink."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(edges, sources).intersect(reachable(back, sinks))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node): what is left when nodes without incoming edges are peeled off again and again; empty if there is no cycle."""
    left = materialize(edges.select("src", "dst").distinct(), "peel")
    n = left.count()
    while True:
        kept = materialize(left.join(left.select(F.col("dst").alias("k")).distinct(), F.col("src") == F.col("k"), "left_semi"), "peel")
        discard(left)
        left, was, n = kept, n, kept.count()
        if n == was:
            return left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()


#: Edges of a range of nodes whose walks one task follows.
RANGE_EDGES = 1_000_000


def longest_from(seeds: dict, edges: tuple[list, list]) -> tuple[dict, bool]:
    """(the longest walk over edges that ends in each node that walks from seeds reach, whether the edges have a cycle there).

    seeds: node to the length of the walk that ends in it. Each edge is followed once, when all before it have been.
    """
    after, waiting = {}, {}
    for a, b in zip(*edges, strict=True):
        after.setdefault(a, []).append(b)
    seen, stack = set(seeds), list(seeds)
    while stack:
        for b in after.get(stack.pop(), ()):
            waiting[b] = waiting.get(b, 0) + 1
            if b not in seen:
                seen.add(b)
                stack.append(b)
    best, free, taken = dict(seeds), [a for a in seen if a not in waiting], 0
    while free:
        a = free.pop()
        taken += 1
        next_ = best[a] + 1
        for b in after.get(a, ()):
            if best.get(b, -1) < next_:
                best[b] = next_
            waiting[b] -= 1
            if not waiting[b]:
                free.append(b)
    return best, taken < len(seen)


def levels(edges: DataFrame, range_edges: int = RANGE_EDGES) -> DataFrame:
    """(node, level): the longest walk that ends in each node of an acyclic graph, in edges; a topological order sorts by it.

    Nodes are dealt by ranges, each of which has about range_edges edges. A round follows all walks inside ranges, in tasks; then what
    edges between ranges lead to starts the next, so round r has the nodes that end a walk of r edges between ranges. Without a cycle
    there are fewer each round; as many as before mean that the graph has one, which is an error.
    """
    import pyarrow as pa

    e = materialize(edges.select("src", "dst").distinct(), "levels-edges")
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    ranges = -(-e.count() // range_edges) or 1
    placed = materialize(nodes.repartitionByRange(ranges, "node").withColumn("part", F.spark_partition_id()), "levels-nodes")
    ends = [placed.select(F.col("node").alias(c), F.col("part").alias(f"{c}_part")) for c in ("src", "dst")]
    apart = materialize(e.join(ends[0], "src").join(ends[1], "dst").select("src", "dst", "src_part", "dst_part"), "levels-parts")
    inner = apart.where("src_part = dst_part").select(F.col("src_part").alias("part"), F.col("src").alias("node"), "dst", F.lit(None).cast("int").alias("level"))
    outer = apart.where("src_part <> dst_part").select("src", F.col("dst").alias("node"), F.col("dst_part").alias("part"))
    node = dict(e.dtypes)["src"]
    tasks = max(ranges, partitions(e.sparkSession))

    def run(group: pa.Table) -> pa.Table:
        import pyarrow as pa
        import pyarrow.compute as pc

        given = pc.is_valid(group.column("level"))
        seeds, links = group.filter(given), group.filter(pc.invert(given))
        found, cyclic = longest_from(dict(zip(seeds.column("node").to_pylist(), seeds.column("level").to_pylist(), strict=True)), (links.column("node").to_pylist(), links.column("dst").to_pylist()))
        of = group.column("part")[0].as_py()
        cols = [pa.array(found.keys(), group.schema.field("node").type), pa.array([of] * len(found), pa.int32()), pa.array(found.values(), pa.int32()), pa.array([cyclic] * len(found), pa.bool_())]
        return pa.table(cols, ["node", "part", "level", "cyclic"])

    seeds, last, tables, n = placed.select("part", "node", F.lit(0).alias("level")), None, [], None
    best = lambda: reduce(DataFrame.unionByName, (t.select("node", "level") for t in tables)).groupBy("node").agg(F.max("level").alias("level"))
    while True:
        own = inner if last is None else inner.join(seeds.select("part").distinct(), "part", "left_semi")
        work = own.unionByName(seeds.select("part", "node", F.lit(None).cast(node).alias("dst"), "level"))
        new = materialize(work.repartition(tasks, "part").groupBy("part").applyInArrow(run, f"node {node}, part int, level int, cyclic boolean"), "levels")
        found = new.agg(F.count("*"), F.coalesce(F.max("cyclic"), F.lit(False))).first()
        if found[1] or found[0] and found[0] == n and last is not None:
            raise RuntimeError("the graph has a cycle")
        tables.append(new)
        if len(tables) > GATHER:
            merged = materialize(best(), "levels")
            discard(*tables[:-1])
            tables = [merged, new]
        if not found[0]:
            return best()
        if last is not None:
            n = found[0]
        last = new
        seeds = materialize(new.select(F.col("node").alias("src"), "level").join(outer, "src").groupBy("part", "node").agg((F.max("level") + 1).cast("int").alias("level")), "levels-seeds")


def cut_points(edges: DataFrame, by: Names = ()) -> DataFrame:
    """(by, node): nodes of an order (edges src < dst are places in it) that no edge jumps over, first and last included.

    Without groups, sums run by ranges of the order, so no task holds all of it.
    """
    keys = _list(by)
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
    steps = edges.select(*keys, F.explode(F.array(F.struct((F.col("src") + 1).alias("at"), F.lit(1).alias("d")), F.struct(F.col("dst").alias("at"), F.lit(-1).alias("d")))).alias("s")).select(*keys, F.col("s.at").alias("node"), F.col("s.d").alias("d"))
    change = steps.unionByName(ends.withColumn("d", F.lit(0))).groupBy(*keys, "node").agg(F.sum("d").alias("d"))
    if keys:
        over = change.withColumn("over_", F.sum("d").over(window(keys, "node").rowsBetween(W.unboundedPreceding, 0)))
    else:
        over = running_sums(change, "node", ["d"]).withColumn("over_", F.col("before_d") + F.col("d"))
    return over.join(ends, [*keys, "node"], "left_semi").where("over_ = 0").select(*keys, "node")


def bubbles(steps: DataFrame, cuts: DataFrame, by: Names, path: str, order: str, node: str) -> DataFrame:
    """(by, left, right, alleles, paths): distinct traversals between neighbouring cut points."""
    keys = _list(by)
    w = window([*keys, path], order)
    c = cuts.select(*(F.col(k).alias(f"{k}__") for k in keys), F.col("node").alias("cut_"))
    same = F.col(node) == F.col("cut_")
    for k in keys:
        same = same & (F.col(k) == F.col(f"{k}__"))
    marked = steps.join(c, same, "left").withColumn("left", F.last("cut_", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("right", F.first("cut_", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    inside = marked.where("left IS NOT NULL AND right IS NOT NULL").groupBy(*keys, path, "left", "right").agg(F.sort_array(F.collect_list(F.struct(order, node))).alias("w_"))
    walks = inside.withColumn("allele_", F.array_join(F.transform("w_", lambda x: x[node].cast("string")), ","))
    return walks.groupBy(*keys, "left", "right").agg(F.countDistinct("allele_").alias("alleles"), F.count("*").alias("paths"))


def unary_chains(edges: DataFrame) -> DataFrame:
    """(node, head, nth): nodes of chains that would be one node: each but the head has one predecessor, whose only successor it is.

    Heads are found by pointer jumping: after a round more than the logarithm of the number of nodes every member of a chain
    knows its head. Those that still don't are members of unary cycles, which are left out.
    """
    e = edges.select("src", "dst").distinct()
    out, into = e.groupBy("src").agg(F.count("*").alias("o")), e.groupBy("dst").agg(F.count("*").alias("i"))
    joins = e.join(out.where("o = 1").select("src"), "src", "left_semi").join(into.where("i = 1").select("dst"), "dst", "left_semi")
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    up = nodes.join(joins.select(F.col("dst").alias("node"), F.col("src").alias("up")), "node", "left").select("node", F.coalesce("up", "node").alias("head"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("nth"))
    now = materialize(up, "chains")
    for _ in range(now.count().bit_length() + 1):
        above = now.select(F.col("node").alias("n2"), F.col("head").alias("h2"), F.col("nth").alias("k2"))
        new = now.join(above, F.col("head") == F.col("n2")).select("node", F.col("h2").alias("head"), (F.col("nth") + F.col("k2")).alias("nth"), (F.col("h2") != F.col("head")).alias("moved"))
        read, now = now, materialize(new, "chains")
        discard(read)
        if not now.where("moved").limit(1).count():
            break
    heads = now.where("nth = 0 AND node = head").select(F.col("node").alias("h"))
    return now.select("node", "head", "nth").join(heads, F.col("head") == F.col("h"), "left_semi")


def unchopped(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with unary chains merged: nodes (node, seq), the head naming the whole."""
    chains = unary_chains(edges)
    named = nodes.join(chains, "node", "left").select("node", "seq", F.coalesce("head", "node").alias("head"), F.coalesce("nth", F.lit(0)).alias("nth"))
    merged = named.groupBy(F.col("head").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    a = named.select(F.col("node").alias("src"), F.col("head").alias("src_h"))
    b = named.select(F.col("node").alias("dst"), F.col("head").alias("dst_h"), F.col("nth").alias("k"))
    kept = edges.join(a, "src").join(b, "dst").where("src_h <> dst_h OR k = 0").select(F.col("src_h").alias("src"), F.col("dst_h").alias("dst")).distinct()
    return merged, kept


def merge_siblings(nodes: DataFrame, edges: DataFrame, both: bool = True) -> DataFrame:
    """(node, into): nodes of equal sequence with the same predecessors and successors (or, not both, either) merged to a fixed point."""
    now = materialize(nodes.select("node", F.col("node").alias("into")), "siblings")
    while True:
        a, b = now.select(F.col("node").alias("src"), F.col("into").alias("s")), now.select(F.col("node").alias("dst"), F.col("into").alias("t"))
        e = edges.join(a, "src").join(b, "dst").select("s", "t").distinct()
        seqs = nodes.join(now, "node").groupBy("into").agg(F.min("seq").alias("seq"))
        preds = e.groupBy(F.col("t").alias("into")).agg(F.sort_array(F.collect_set("s")).alias("preds"))
        succs = e.groupBy(F.col("s").alias("into")).agg(F.sort_array(F.collect_set("t")).alias("succs"))
        full = seqs.join(preds, "into", "left").join(succs, "into", "left")
        sides = [["preds", "succs"]] if both else [["preds"], ["succs"]]
        moved = 0
        for side in sides:
            least = F.min("into").over(W.partitionBy("seq", *side))
            to = full.withColumn("to_", least).where("to_ <> into").select(F.col("into").alias("from_"), "to_")
            new = materialize(now.join(to, F.col("into") == F.col("from_"), "left").select("node", F.coalesce("to_", "into").alias("into")), "siblings")
            moved = new.join(now.select("node", F.col("into").alias("was_")), "node").where("into <> was_").limit(1).count()
            now = new
            if moved:
                break
        if not moved:
            return now


def spelled(steps: DataFrame, nodes: DataFrame, path: str, order: str) -> DataFrame:
    """(path, seq): the sequence of each walk; steps (path, order, node, rev boolean), nodes (node, seq)."""
    from braidwork.functions.sequences import reverse_complement

    joined = steps.join(nodes, "node").withColumn("s_", F.when(F.col("rev"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return joined.groupBy(path).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "s_"))), lambda x: x["s_"]), "").alias("seq"))


def subwalks(walks: DataFrame, paths: DataFrame) -> DataFrame:
    """(walk, path, at, rev): where each walk (walk, handles array) stands in a path (path, handles), on either strand.

    The join is on the walk's first handle; the rest is compared by slices.
    """
    from braidwork.functions.sequences import reverse_walk

    both = walks.select("walk", "handles", F.lit(False).alias("rev")).unionByName(walks.select("walk", reverse_walk(F.col("handles")).alias("handles"), F.lit(True).alias("rev")))
    at = paths.select("path", F.col("handles").alias("whole"), F.posexplode("handles").alias("at", "first"))
    hit = both.where(F.size("handles") > 0).join(at, F.get("handles", F.lit(0)) == F.col("first"))
    return hit.where(F.slice(F.col("whole"), F.col("at") + 1, F.size("handles")) == F.col("handles")).select("walk", "path", "at", "rev")
