"""Connected components of an edge table, by alternating large and small stars.

Each round relinks every node's neighbours to the least of them; rounds grow with the logarithm of the component size.
Least neighbours are partial aggregations, so a hub costs one row a task there; the joins that hand them back are plain
equi-joins, whose skewed keys adaptive execution splits. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.plans.scratch import discard, materialize, partitions


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
    linked = edges.join(least, F.col("u") == F.col("k"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


#: Edges that a task joins up before it passes on what holds their nodes together.
CHUNK = 500_000


def forest(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(u, v): edges with the same nodes and components, fewer where edges of a range of nodes hold each other together.

    Edges are dealt by ranges of u. A task joins up CHUNK of them at a time and passes on an edge from each node to the first of its part.
    Self-loops stay where a node has no other edge there; rows with a null end are left out.
    """
    import pyarrow as pa

    ends = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")

    def joined(pairs: list[tuple]) -> dict:
        root = {}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, b in pairs:
            a, b = find(root.setdefault(a, a) if a not in root else a), find(root.setdefault(b, b) if b not in root else b)
            if a != b:
                root[max(a, b)] = min(a, b)
        return {x: find(x) for x in root}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        held, schema = [], None

        def passed_on():
            of = joined(held)
            held.clear()
            single = set(of).difference(x for x, r in of.items() if x != r).difference(r for x, r in of.items() if x != r)
            kept = [(x, r) for x, r in of.items() if x != r or x in single]
            return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], schema.field(i).type) for i in (0, 1)], schema=schema)

        for batch in batches:
            schema = batch.schema
            held.extend(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            if len(held) >= CHUNK:
                yield passed_on()
        if held:
            yield passed_on()

    return ends.repartitionByRange(partitions(edges.sparkSession), "u").mapInArrow(run, ends.schema)


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int | None = None) -> DataFrame:
    """(node, component): the least node of each node's component, for every node that an edge names.

    Edges have no direction and may repeat; self-loops name their node. Rows with a null end are left out. An empty table
    gives an empty one. Rounds end when nothing changes any more; max_rounds makes more of them an error.
    """
    ends = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    alone = ends.where("u = v").select(F.col("u").alias("node")).distinct()
    now = materialize(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for nth in count():
        if nth == max_rounds:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
        read, now = now, materialize(_small_star(_large_star(now)), "stars")
        discard(read)
        doubled = now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if not doubled and not now.join(now.select(F.col("u").alias("k")), F.col("v") == F.col("k"), "left_semi").limit(1).count():
            break
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
