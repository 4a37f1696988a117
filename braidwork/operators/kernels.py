"""Alignment kernels: dynamic programmes over strings and small graphs, vectorised along rows with numpy.

They run in Arrow batches; equal and empty strings never reach them, and a column is computed for its distinct keys only
(distinct_apply). Costs are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.windows import Names, _list


def edit_distance(a: str, b: str) -> int:
    """Unit edit distance, bit-parallel over the whole pattern: one step of big-integer arithmetic for each character of b."""
    if not a or not b:
        return len(a) + len(b)
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        flat = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = minus | ~(flat | plus) & full, plus & flat
    return score


def semi_global(read: str, text: str) -> int:
    """Least edit distance of the read to any stretch of the text."""
    import numpy as np

    if not text:
        return len(read)
    t = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    row = np.zeros(len(t) + 1, np.int64)
    place = np.arange(len(t) + 1)
    for i, c in enumerate(read, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place  # insertions along the row
    return int(row.min())


def affine_cost(a: str, b: str, mismatch: int = 4, opening: int = 6, extend: int = 2) -> int:
    """Least cost of a global alignment in which a gap of k costs opening + extend * k."""
    import numpy as np

    big = 1 << 40
    t = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    n = np.arange(len(t) + 1)
    best = np.where(n > 0, opening + extend * n, 0).astype(np.int64)
    down = np.full(len(t) + 1, big)
    for i, c in enumerate(a, 1):
        down = np.minimum(down, best + opening) + extend
        new = np.empty_like(best)
        new[0] = opening + extend * i
        new[1:] = best[:-1] + np.where(t == ord(c), 0, mismatch)
        new = np.minimum(new, down)
        # gaps along the row: the least of what stands before, opening once
        along = np.minimum.accumulate(new - extend * n)
        across = np.r_[big, along[:-1]] + opening + extend * n
        best = np.minimum(new, across)
    return int(best[-1])


def align(a: str, b: str, max_cells: int | None = None) -> str | None:
    """CIGAR (=, X, I, D) of a least-cost unit alignment; diagonal before deletion before insertion on ties. None beyond max_cells, if given."""
    import numpy as np

    if max_cells is not None and (len(a) + 1) * (len(b) + 1) > max_cells:
        return None
    t, place = np.frombuffer(b.encode("utf-32-le"), np.uint32), np.arange(len(b) + 1)
    rows = [place.astype(np.int32)]
    for i, c in enumerate(a, 1):
        new = np.empty(len(b) + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(rows[-1][:-1] + (t != ord(c)), rows[-1][1:] + 1)
        rows.append((np.minimum.accumulate(new - place) + place).astype(np.int32))
    i, j, ops = len(a), len(b), []
    while i or j:
        here = rows[i][j]
        if i and j and here == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            ops.append("=" if a[i - 1] == b[j - 1] else "X")
            i, j = i - 1, j - 1
        elif i and here == rows[i - 1][j] + 1:
            ops.append("D")
            i -= 1
        else:
            ops.append("I")
            j -= 1
    out, ops = [], ops[::-1]
    for k, op in enumerate(ops):
        if k and op == ops[k - 1]:
            out[-1][0] += 1
        else:
            out.append([1, op])
    return "".join(f"{n}{op}" for n, op in out)


def aligned_rows(a: str, b: str, cigar: str) -> tuple[str, str]:
    """The two rows that a CIGAR makes of a and b."""
    import re

    x, y, i, j = [], [], 0, 0
    for n, op in re.findall(r"(\d+)([=XMID])", cigar):
        n = int(n)
        x.append("-" * n if op == "I" else a[i : i + n])
        y.append("-" * n if op == "D" else b[j : j + n])
        i, j = i + (op != "I") * n, j + (op != "D") * n
    return "".join(x), "".join(y)


def dag_distance(query: str, nodes: list[str], edges: list[tuple[int, int]], sources: list[int], sinks: list[int]) -> tuple[int, list[int]] | None:
    """(distance, walk): the source-to-sink walk whose spelling is nearest to the query. nodes are in topological order."""
    import numpy as np

    before: dict[int, list[int]] = {}
    for s, d in edges:
        before.setdefault(d, []).append(s)
    t, place = np.frombuffer(query.encode("utf-32-le"), np.uint32), np.arange(len(query) + 1)
    ends: dict[int, np.ndarray] = {}
    first: dict[int, np.ndarray] = {}
    for v, seq in enumerate(nodes):
        rows = [ends[u] for u in before.get(v, ()) if u in ends]
        if v in sources:
            rows.append(place.astype(np.int64))
        if not rows:
            continue
        row = np.minimum.reduce(rows)
        first[v] = row
        for c in seq:
            new = np.empty_like(row)
            new[0] = row[0] + 1
            new[1:] = np.minimum(row[:-1] + (t != ord(c)), row[1:] + 1)
            row = np.minimum.accumulate(new - place) + place
        ends[v] = row
    reached = [v for v in sinks if v in ends]
    if not reached:
        return None
    last = min(reached, key=lambda v: (int(ends[v][-1]), v))
    walk, j = [last], len(query)
    while True:  # back over nodes: the column at which the walk entered each
        v = walk[-1]
        row, j = first[v], _entry(nodes[v], query, first[v], j)
        if v in sources and row[j] == j:
            return int(ends[last][-1]), walk[::-1]
        walk.append(next(u for u in before.get(v, ()) if u in ends and ends[u][j] == row[j]))


def _entry(seq: str, query: str, row, j: int) -> int:
    """The column of row from which the best way through seq comes to column j."""
    import numpy as np

    t, place = np.frombuffer(query.encode("utf-32-le"), np.uint32), np.arange(len(query) + 1)
    rows = [row]
    for c in seq:
        new = np.empty_like(row)
        new[0] = rows[-1][0] + 1
        new[1:] = np.minimum(rows[-1][:-1] + (t != ord(c)), rows[-1][1:] + 1)
        rows.append(np.minimum.accumulate(new - place) + place)
    i = len(seq)
    while i:
        here = rows[i][j]
        if j and here == rows[i - 1][j - 1] + (seq[i - 1] != query[j - 1]):
            i, j = i - 1, j - 1
        elif here == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return j


def distinct_apply(df: DataFrame, a: str, b: str, out: str, kernel: Callable[[str, str], int | None], symmetric: bool = True) -> DataFrame:
    """df with out, the kernel of columns a and b, computed once for each distinct pair and joined back.

    symmetric: (a, b) and (b, a) are one pair. Equal strings cost 0; nulls give null.
    """
    x, y = (F.least(a, b), F.greatest(a, b)) if symmetric else (F.col(a), F.col(b))
    keyed = df.withColumn("x_", x).withColumn("y_", y)
    pairs = keyed.where("x_ <> y_").select("x_", "y_").distinct()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            xs, ys = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([xs, ys, pa.array([kernel(p.as_py(), q.as_py()) for p, q in zip(xs, ys, strict=True)], pa.int64())], names=["px_", "py_", "cost_"])

    costs = pairs.mapInArrow(run, "px_ string, py_ string, cost_ long")
    joined = keyed.join(costs, (F.col("x_") == F.col("px_")) & (F.col("y_") == F.col("py_")), "left")
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return joined.select(*df.columns, F.when(both & (F.col(a) == F.col(b)), F.lit(0)).otherwise(F.col("cost_")).cast("long").alias(out))


class Distances:
    """The distances of points (rows of vectors), made a row at a time when asked for: d[x] or d[[x, y, ...]]; never all pairs at once."""

    def __init__(self, vectors):
        import numpy as np

        self.vectors = np.ascontiguousarray(vectors, dtype=float)
        self.work = np.empty_like(self.vectors)

    def __len__(self) -> int:
        return len(self.vectors)

    def __getitem__(self, x):
        import numpy as np

        if np.ndim(x):
            return np.stack([self[i] for i in x])
        np.subtract(self.vectors, self.vectors[x], out=self.work)
        np.square(self.work, out=self.work)
        return np.sqrt(self.work.sum(1))


def _distances(distance):
    import numpy as np

    return distance if isinstance(distance, Distances) else np.asarray(distance, float)


def kmedoids(distance, k: int, fixed: list[int] = ()) -> tuple[list[int], list[int]]:
    """(medoids, nearest medoid of each point, as a place in them): farthest-first from the fixed ones (or point 0), then swaps.

    Points are tried in their order, again and again: one takes the place of the medoid with which the sum of distances falls
    most, at once, if it falls, until all points in a row change nothing. Each swap lowers the sum, so this ends. Fixed medoids
    come first and stay. Ties go to the lower place. distance: a matrix, or Distances.
    """
    import numpy as np

    d = _distances(distance)
    n = len(d)
    if not n:
        return [], []
    chosen = list(dict.fromkeys(fixed)) or [0]
    still = len(dict.fromkeys(fixed))
    while len(chosen) < min(k, n):
        near = d[chosen].min(0)
        near[chosen] = -1
        chosen.append(int(near.argmax()))
    idle = x = 0
    without = None  # for each medoid, the distances of all points to the nearest other one
    while idle < n and still < len(chosen) < n:
        if without is None:
            without = np.stack([d[[m for m in chosen if m != own]].min(0) if len(chosen) > 1 else np.full(n, np.inf) for own in chosen])
            now = d[chosen].min(0).sum()
        sums = np.minimum(without[still:], d[x]).sum(1)
        at = int(sums.argmin())
        if x not in chosen and sums[at] < now - 1e-12:
            chosen[still + at], without, idle = x, None, 0
        else:
            idle += 1
        x = (x + 1) % n
    return chosen, d[chosen].argmin(0).tolist()


def spanning_tree(distance, root: int | None = None) -> list[tuple[int, int | None]]:
    """(point, parent) in the order in which a nearest-first tree takes points, from the root (or the medoid). Ties go to the lower number."""
    import numpy as np

    d = _distances(distance)
    if not len(d):
        return []
    root = int(np.argmin([d[x].sum() for x in range(len(d))])) if root is None else root
    out: list[tuple[int, int | None]] = [(root, None)]
    near, parent = d[root].copy(), np.full(len(d), root)
    near[root] = np.inf
    done = np.zeros(len(d), bool)
    done[root] = True
    for _ in range(len(d) - 1):
        x = int(near.argmin())
        out.append((x, int(parent[x])))
        done[x] = True
        row = d[x]
        closer = (row < near) & ~done
        near[closer], parent[closer] = row[closer], x
        near[x] = np.inf
    return out


def average_linkage(distance) -> list[tuple[int, int, float]]:
    """(a, b, height) of merges by average distance; a merge of n points gets the number n, n + 1, ... Ties go to lower numbers."""
    import numpy as np

    d = {(i, j): float(x) for (i, j), x in np.ndenumerate(np.asarray(distance)) if i < j}
    size = dict.fromkeys(range(len(distance)), 1)
    out, new = [], len(distance)
    while len(size) > 1:
        a, b = min(d, key=lambda p: (d[p], p))
        out.append((a, b, d[a, b]))
        for c in size:
            if c not in (a, b):
                x, y = d.pop((min(a, c), max(a, c))), d.pop((min(b, c), max(b, c)))
                d[c, new] = (x * size[a] + y * size[b]) / (size[a] + size[b])
        del d[a, b]
        size[new] = size.pop(a) + size.pop(b)
        new += 1
    return out


def grouped(df: DataFrame, by: Names, fields: str, f: Callable) -> DataFrame:
    """f(rows of a group as a pandas frame) -> frame of fields, group by group; the keys stand first in fields."""
    keys, kinds = _list(by), dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), fields])

    def run(pdf):
        out = f(pdf)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)
