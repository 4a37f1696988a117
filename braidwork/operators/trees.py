"""Nearest-first trees of groups of vectors of any size: all pairs of points are seen in tiles, dealt over tasks; a tree walks over what tiles leave.

Points are numbered in a group and cut into blocks. A tile is two blocks, and tells which of its pairs a least spanning tree of the group
may hold: all that no way of shorter steps joins, so whichever of equal pairs a walk takes is among them. These grow with the points, not
with their pairs, and a task walks over those of a group. Products of matrices choose pairs, with room for their rounding; what decides
is the distance as `kernels.Distances` makes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators.kernels import Distances, spanning_tree
from braidwork.plans.scratch import partitions

#: Points of a block, and how many pairs a point of a tile may leave before its group is walked over row by row.
BLOCK, MOST = 1536, 8


def matrix(vectors):
    """Lists of equal length as rows of a matrix, from Arrow."""
    import numpy as np

    vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if vectors.null_count or len(flat) % max(len(vectors), 1) or len(set(vectors.value_lengths().to_pylist())) > 1:
        raise ValueError("vectors are not of one length")
    return np.ascontiguousarray(flat.reshape(len(vectors), -1), dtype=float)


def squares(x):
    """(squared distances of all rows of x, what each may be off by, the unit of length); numbers that are none or too large give None."""
    import numpy as np

    with np.errstate(all="ignore"):
        z = x - x.mean(0)
        unit = float(np.sqrt((z * z).sum(1).max()))
        if not np.isfinite(unit):
            return None
        z /= unit or 1
    n = (z * z).sum(1)
    d = z @ z.T
    d *= -2
    d += n
    d += n[:, None]
    np.maximum(d, 0, out=d)
    return d, 16 * (x.shape[1] + 16) * np.finfo(float).eps, unit


def tree_pairs(d, off: float, most: int):
    """(a, b): places of all pairs that a least spanning tree may hold, squared distances d being off by off. None if they are more than most a point.

    Of points in the order in which a tree takes them, the longest step on the way between two is the longest taken from one to the other.
    """
    import numpy as np

    m = len(d)
    near, taken, row = d[0].copy(), np.full(m, -np.inf), np.empty(m)
    near[0] = taken[0] = np.inf
    order, longest = np.zeros(m, np.int64), np.full(m, -np.inf)
    a, b, left = [], [], most * m
    for k in range(1, m):
        x = int(near.argmin())
        step, order[k] = near[x], x
        np.maximum(longest[:k], step, out=longest[:k])
        hits = order[:k][d[x].take(order[:k]) <= longest[:k] + 2 * off]
        a.append(np.full(len(hits), x))
        b.append(hits)
        left -= len(hits)
        if left < 0:
            return None
        taken[x] = np.inf
        np.maximum(d[x], taken, out=row)
        np.minimum(near, row, out=near)
        near[x] = np.inf
    return (np.concatenate(a), np.concatenate(b)) if a else (order[:0], order[:0])


def _tile(blocks, most: int):
    """(a, b, d, off) of a tile's one or two blocks: pairs a, b with their distance; points a with sums of distances and their error; nothing but nulls where pairs are too many."""
    import numpy as np
    import pyarrow as pa

    points = [blocks.column("points").chunk(i) for i in range(blocks.column("points").num_chunks)]
    sizes = [int(n) for c in points for n in c.value_lengths().to_pylist()]
    flat = pa.chunked_array([c.flatten() for c in points]).combine_chunks()
    n, copies, x = flat.field("n").to_numpy(), flat.field("copies").to_numpy().astype(float), matrix(pa.chunked_array([flat.field("vector")]))
    none = {"a": [None], "b": [None], "d": [None], "off": [None]}
    known = squares(x)
    if known is None:
        return none
    d, off, unit = known
    pairs = tree_pairs(d, off, most)
    if pairs is None:
        return none
    # sums: a tile of two blocks holds the distances between them, a tile of one those inside it
    cut = sizes[0]
    alone = len(sizes) == 1
    far = d[:cut, :cut] if alone else d[:cut, cut:]
    np.sqrt(far, out=far)
    if alone:
        np.fill_diagonal(far, 0)
    own, other = (copies, copies) if alone else (copies[:cut], copies[cut:])
    sums = far @ other if alone else np.r_[far @ other, own @ far]
    error = np.full(len(n), other.sum())
    if not alone:
        error[cut:] = own.sum()
    a, b = pairs
    exact = np.concatenate([np.sqrt(np.square(x[a[i : i + 4096]] - x[b[i : i + 4096]]).sum(1)) for i in range(0, max(len(a), 1), 4096)])
    fill = lambda size: pa.nulls(size, pa.float64())
    return {
        "a": pa.chunked_array([pa.array(n[a]), pa.array(n)]),
        "b": pa.chunked_array([pa.array(n[b]), pa.nulls(len(n), pa.int64())]),
        "d": pa.chunked_array([pa.array(exact), pa.array(sums * unit)]),
        "off": pa.chunked_array([fill(len(a)), pa.array(error * unit * (2 * off) ** 0.5)]),
    }


def _root(sums, off, vectors, everywhere) -> int:
    """The point with the least sum of distances, the lowest of equal ones: sums that may be least are made anew."""
    import numpy as np

    best = np.flatnonzero(sums - off <= (sums + off).min())
    if len(best) < 2:
        return int(best[0])
    d, at = Distances(vectors[everywhere]), np.full(len(vectors), -1)
    at[everywhere[::-1]] = np.arange(len(everywhere))[::-1]
    return int(best[np.argmin([d[int(at[x])].sum() for x in best])])


def _walk(a, b, d, n: int, root: int) -> list[tuple[int, int | None]]:
    """(point, parent) in the order of a nearest-first tree over pairs; ties go to the lower point, and to the parent that was taken first."""
    import heapq

    import numpy as np

    first = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True)[1]
    a, b, d = (np.concatenate(x) for x in ((a[first], b[first]), (b[first], a[first]), (d[first], d[first])))
    by = np.argsort(a, kind="stable")
    to, far, start = b[by], d[by], np.searchsorted(a[by], np.arange(n + 1))
    near, parent, done, out = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool), []
    heap = [(0.0, root)]
    while heap:
        x = heapq.heappop(heap)[1]
        if done[x]:
            continue
        done[x] = True
        out.append((x, int(parent[x]) if parent[x] >= 0 else None))
        those, w = to[start[x] : start[x + 1]], far[start[x] : start[x + 1]]
        closer = (w < near[those]) & ~done[those]
        those, w = those[closer], w[closer]
        near[those], parent[those] = w, x
        for entry in zip(w.tolist(), those.tolist(), strict=True):
            heapq.heappush(heap, entry)
    if len(out) < n:
        raise ValueError("pairs do not join all points")
    return out


def _tree(found, points):
    """(id, parent's id) of a group's points in the order of its tree. Points of equal vectors are one, and follow its first."""
    import numpy as np

    points = points.sort_by("n")
    ids, vectors = points.column("ids").to_pylist(), matrix(points.column("vector"))
    a, b, d, off = (found.column(c).to_numpy() for c in ("a", "b", "d", "off"))
    all_ids, own = np.concatenate([np.array(i) for i in ids]), np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    by = np.argsort(all_ids, kind="stable")
    if found.column("a").null_count:
        sorted_ids = all_ids[by].tolist()
        return [(sorted_ids[x], None if p is None else sorted_ids[p]) for x, p in spanning_tree(Distances(vectors[own[by]]))]
    pair = ~np.isnan(b) if b.dtype.kind == "f" else np.ones(len(b), bool)
    at = a[~pair].astype(np.int64)
    root = _root(np.bincount(at, d[~pair], len(ids)), np.bincount(at, off[~pair], len(ids)), vectors, own[by])
    out = []
    for x, p in _walk(a[pair].astype(np.int64), b[pair].astype(np.int64), d[pair], len(ids), root):
        out.append((ids[x][0], None if p is None else ids[p][0]))
        out += [(i, ids[x][0]) for i in ids[x][1:]]
    return out


def spanning_trees(df: DataFrame, by: str, ident: str, vector: str, block: int | None = None, most: int = MOST) -> DataFrame:
    """(by, nth, ident, parent): the nearest-first tree of each group's vectors from their medoid, as kernels.spanning_tree makes it of points in the order of ident."""
    block, kinds = block or BLOCK, dict(df.dtypes)
    alike = df.groupBy(F.col(by).alias("by"), F.col(vector).alias("vector")).agg(F.sort_array(F.collect_list(F.col(ident).cast("long"))).alias("ids"))
    w = W.partitionBy("by")
    points = alike.withColumn("n", F.row_number().over(w.orderBy(F.col("ids")[0], "vector")).cast("long") - 1).withColumn("all", F.count("*").over(w))
    place = F.floor(F.col("n") / block)
    kept = F.struct("n", F.size("ids").cast("long").alias("copies"), "vector")
    blocks = points.groupBy("by", place.alias("block"), F.floor((F.col("all") - 1) / block).alias("last")).agg(F.collect_list(kept).alias("points"))
    dealt = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).select("by", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "points")
    fields = f"by {kinds[by]}, a long, b long, d double, off double"

    def tile(key, blocks):
        import pyarrow as pa

        made = pa.table(_tile(blocks, most), schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64()), ("off", pa.float64())]))
        return made.add_column(0, "by", pa.array([key[0].as_py()] * len(made), key[0].type))

    found = dealt.repartition(partitions(df.sparkSession), "by", "lo", "hi").groupBy("by", "lo", "hi").applyInArrow(tile, fields)

    def walk(key, found, points):
        import pyarrow as pa

        out = _tree(found, points)
        return pa.table({by: pa.array([key[0].as_py()] * len(out), key[0].type), "nth": pa.array(range(len(out)), pa.int64()), ident: pa.array([i for i, _ in out], pa.int64()), "parent": pa.array([p for _, p in out], pa.int64())})

    return found.groupBy("by").cogroup(points.select("by", "n", "ids", "vector").groupBy("by")).applyInArrow(walk, f"`{by}` {kinds[by]}, nth long, `{ident}` long, parent long")
