"""Medoids of large groups of vectors: kernels.kmedoids with the points of a group dealt over tasks.

Points are tried in their order, as there, but a stretch of them at a time: tasks add up, over their own points, what each of the stretch
would make of the sum of distances in the place of each medoid; the first that lowers it is taken, and the next stretch begins behind it.
Stretches are as long as the last way between two swaps, so that little is added up in vain, and double while none comes. The driver
holds a stretch and the medoids of each large group. Groups of up to SMALL points are gone through in the same way inside a task. Products of matrices make the distances; where their rounding could decide, they
are made anew as `kernels.Distances` makes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.operators import kernels as K
from braidwork.operators.trees import matrix
from braidwork.plans.scratch import materialize, partitions

#: Groups up to SMALL points stay in one task (about 10 s). Points of a block, the shortest and the longest stretch, and how many points are looked at again at a time.
SMALL, BLOCK, SHORT, LONG, AGAIN = 16384, 1536, 64, 2048, 64


def apart(a, b):
    """Distances of the rows of a from those of b, as kernels.Distances makes them."""
    import numpy as np

    return np.stack([np.sqrt(np.square(b - x).sum(1)) for x in a])


def nearly_apart(a, b):
    """(distances of the rows of a from those of b, what each may be off by). Those of points near each other are made anew."""
    import numpy as np

    mean = b.mean(0)
    a0, b0 = a - mean, b - mean
    na, nb = (a0 * a0).sum(1), (b0 * b0).sum(1)
    far = max(na.max(), nb.max())
    d = np.column_stack([-2 * a0, na, np.ones(len(a))]) @ np.column_stack([b0, np.ones(len(b)), nb]).T
    close = np.flatnonzero(d.ravel() < 1e-3 * far)
    np.maximum(d, 0, out=d)
    np.sqrt(d, out=d)
    for i in range(0, len(close), 4096):
        x, y = np.divmod(close[i : i + 4096], len(b))
        d[x, y] = np.sqrt(np.square(b[y] - a[x]).sum(1))
    return d, 256 * (a.shape[1] + 16) * np.finfo(float).eps * far**0.5


def swap_sums(x, medoids, tried, exact: bool):
    """(sum of distances of points x to their medoids, the same with each tried one in the place of each medoid, what a sum may be off by)."""
    import numpy as np

    near = apart(medoids, x)
    now, k = float(near.min(0)[None].sum(1)[0]), len(near)
    sums, off = np.empty((len(tried), k)), 0.0
    if exact:
        without = [np.delete(near, i, 0).min(0) if k > 1 else np.full(len(x), np.inf) for i in range(k)]
        for i in range(0, len(tried), 256):
            d = apart(tried[i : i + 256], x)
            sums[i : i + 256] = np.stack([np.minimum(d, w).sum(1) for w in without], 1)
        return now, sums, off
    # taking a medoid away leaves the points of others where they are
    own = near.argmin(0)
    first, second = near.min(0), np.partition(near, 1, 0)[1] if k > 1 else np.full(len(x), np.inf)
    belongs = (own[:, None] == np.arange(k)).astype(float)
    for i in range(0, len(tried), 256):
        d, each = nearly_apart(tried[i : i + 256], x)
        off = max(off, each * len(x))
        kept = np.minimum(d, first) @ belongs
        moved = np.minimum(d, second, out=d) @ belongs
        sums[i : i + 256] = kept.sum(1)[:, None] - kept + moved
    return now, sums, off


class Group:
    """A group's medoids (places and vectors), and how far the trial of its points is."""

    def __init__(self, size: int):
        self.size, self.chosen, self.vectors, self.x, self.idle, self.stretch, self.since = size, [], [], 0, 0, SHORT, 0

    def open(self) -> bool:
        return self.idle < self.size and len(self.chosen) < self.size

    def next(self) -> list[int]:
        return [(self.x + i) % self.size for i in range(min(self.stretch, self.size - self.idle))]

    def pass_over(self, n: int) -> None:
        self.x, self.idle, self.since = (self.x + n) % self.size, self.idle + n, self.since + n

    def swap(self, at: int, place: int, vector) -> None:
        self.stretch, self.since, self.idle = min(max(self.since, SHORT), LONG), 0, 0
        self.chosen[at], self.vectors[at], self.x = place, vector, (place + 1) % self.size


class Points:
    """The points of groups in their order, in blocks in a table; the driver keeps the blocks that it has asked for last."""

    def __init__(self, table: DataFrame):
        self.table, self.kept = table, {}

    def ask(self, places: dict[int, list[int]]) -> dict[int, list]:
        """For each group and places in it: (ident, vector) of them."""
        import numpy as np

        wanted = {(g, p // BLOCK) for g, some in places.items() for p in some}
        missing = sorted(wanted - self.kept.keys())
        self.kept = {k: v for k, v in self.kept.items() if k in wanted}
        if missing:
            cond = F.concat_ws("/", "g", "block").isin([f"{g}/{b}" for g, b in missing])
            for r in self.table.where(cond).collect():
                self.kept[r.g, r.block] = r.ids, np.frombuffer(r.points).reshape(len(r.ids), -1)
        return {g: [(self.kept[g, p // BLOCK][0][p % BLOCK], self.kept[g, p // BLOCK][1][p % BLOCK]) for p in some] for g, some in places.items()}

    def run(self, f, fields: str, last=None) -> DataFrame:
        """f(group, number of the first point, ids, points) -> a dict of columns or None, block by block; last() -> dicts of columns when a task's blocks are through."""
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        schema = to_arrow_schema(StructType.fromDDL(fields))

        def each(batches):
            for batch in batches:
                for g, block, ids, points in zip(*(batch.column(c) for c in ("g", "block", "ids", "points")), strict=True):
                    made = f(g.as_py(), block.as_py() * BLOCK, ids, np.frombuffer(points.as_buffer()).reshape(len(ids), -1))
                    if made:
                        yield pa.RecordBatch.from_pydict(made, schema=schema)
            for made in last() if last else ():
                yield pa.RecordBatch.from_pydict(made, schema=schema)

        return self.table.mapInArrow(each, fields)

    def farthest(self, groups: dict[int, Group]) -> dict[int, int]:
        """The place of the point of each group that is farthest from its medoids."""
        state = {g: (list(s.chosen), s.vectors) for g, s in groups.items()}

        def far(g, start, ids, x):
            import numpy as np

            if g not in state:
                return None
            chosen, vectors = state[g]
            near = apart(vectors, x).min(0)
            near[[c - start for c in chosen if 0 <= c - start < len(x)]] = -1
            at = int(np.argmax(near))
            return {"g": [g], "d": [float(near[at])], "place": [start + at]}

        best = self.run(far, "g int, d double, place long").groupBy("g").agg(F.min(F.struct((-F.col("d")).alias("d"), "place"))["place"].alias("place"))
        return {r.g: r.place for r in best.collect()}

    def sums(self, groups: dict[int, Group], tried: dict[int, list], exact: bool) -> dict[int, tuple]:
        """For each group (sum now, sums of its tried ones, what they may be off by), added up in tasks over their blocks, then over tasks."""
        import numpy as np

        state = {g: (np.stack(groups[g].vectors), np.stack(vectors)) for g, vectors in tried.items()}
        held = {}

        def add(g, start, ids, x):
            if g in state:
                now, sums, off = swap_sums(x, *state[g], exact)
                made = np.r_[now, off, sums.ravel()]
                held[g] = (held[g][0], held[g][1] + made) if g in held else (start, made)

        def last():
            for g, (start, made) in held.items():
                yield {"g": [g], "start": [start], "sums": [made]}

        parts = self.run(add, "g int, start long, sums array<double>", last).toArrow().sort_by([("g", "ascending"), ("start", "ascending")])
        out = {}
        for g, made in zip(parts.column("g").to_pylist(), parts.column("sums"), strict=True):
            out[g] = out.get(g, 0) + made.values.to_numpy()
        return {g: (float(v[0]), v[2:].reshape(len(tried[g]), -1), float(v[1])) for g, v in out.items()}


class Held:
    """The points of one group, 0, in a task: what Points tells, without jobs."""

    def __init__(self, x):
        self.x = x

    def ask(self, places: dict[int, list[int]]) -> dict[int, list]:
        return {g: [(p, self.x[p]) for p in some] for g, some in places.items()}

    def farthest(self, groups: dict[int, Group]) -> dict[int, int]:
        near = apart(groups[0].vectors, self.x).min(0)
        near[groups[0].chosen] = -1
        return {0: int(near.argmax())}

    def sums(self, groups: dict[int, Group], tried: dict[int, list], exact: bool) -> dict[int, tuple]:
        import numpy as np

        state = np.stack(groups[0].vectors), np.stack(tried[0])
        now, sums, off = zip(*(swap_sums(self.x[i : i + BLOCK], *state, exact) for i in range(0, len(self.x), BLOCK)), strict=True)
        return {0: (sum(now), np.sum(sums, 0), sum(off))}


def advance(s: Group, places: list[int], vectors: list, now: float, sums, off: float, exact: bool) -> list[int]:
    """Goes on over tried points up to the first that is taken. Returns those whose sums must be known better first."""
    import numpy as np

    least = now - 1e-12
    best = sums.min(1)
    # a point that is a medoid, or lies where one does, lowers no sum
    idle = np.isin(places, s.chosen)
    for m in s.vectors:
        idle |= (np.stack(vectors) == m).all(1)
    maybe = np.flatnonzero(~idle & (best < least + 2 * off))
    if not len(maybe):
        s.pass_over(len(places))
        return []
    i = int(maybe[0])
    order = np.sort(sums[i])
    if exact or (best[i] < least - 2 * off and (len(order) < 2 or order[1] > order[0] + 2 * off)):
        s.pass_over(i)
        s.swap(int(sums[i].argmin()), places[i], vectors[i])
        return []
    s.pass_over(i)
    return [places[m] for m in maybe[:AGAIN]]


def stretchwise(points: Points | Held, sizes: dict[int, int], k: int) -> dict[int, Group]:
    """The medoids of groups of more than k points."""
    groups = {g: Group(n) for g, n in sizes.items()}
    for s, found in zip(groups.values(), points.ask(dict.fromkeys(groups, [0])).values(), strict=True):
        s.chosen, s.vectors = [0], [found[0][1]]
    for _ in range(1, k):
        farthest = points.farthest(groups)
        for g, found in points.ask({g: [p] for g, p in farthest.items()}).items():
            groups[g].chosen.append(farthest[g])
            groups[g].vectors.append(found[0][1])
    while running := {g: s for g, s in groups.items() if s.open()}:
        places = {g: s.next() for g, s in running.items()}
        vectors = {g: [v for _, v in found] for g, found in points.ask(places).items()}
        again = {}
        for g, known in points.sums(running, vectors, False).items():
            unsure = advance(groups[g], places[g], vectors[g], *known, False)
            if unsure:
                again[g] = unsure, [vectors[g][places[g].index(p)] for p in unsure]
            elif groups[g].idle:
                groups[g].stretch = min(2 * groups[g].stretch, LONG)
        if again:
            for g, (now, sums, _) in points.sums(running, {g: v for g, (_, v) in again.items()}, True).items():
                # what lies between the unsure ones lowers no sum, and they go up to the last of them
                s, (unsure, found) = groups[g], again[g]
                best = sums.min(1)
                hits = (best < now - 1e-12).nonzero()[0]
                if len(hits):
                    i = int(hits[0])
                    s.pass_over((unsure[i] - s.x) % s.size)
                    s.swap(int(sums[i].argmin()), unsure[i], found[i])
                else:
                    s.pass_over((unsure[-1] - s.x) % s.size + 1)
    return groups


def kmedoids(df: DataFrame, by: str, ident: str, vector: str, k: int, small: int = SMALL) -> DataFrame:
    """(by, ident, medoid): the medoid of each point of each group, as kernels.kmedoids chooses them of the points in the order of ident."""
    kinds = dict(df.dtypes)
    rows = df.select(F.col(by).alias("by"), F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e150))
    sizes = rows.groupBy("by").agg(F.count("*").alias("size"), F.max(odd).alias("odd"))
    large = sizes.where((F.col("size") > max(small, k)) & ~F.coalesce("odd", F.lit(True))).select("by", "size").collect()

    def alone(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("id")
        ids, x = pdf["id"].tolist(), np.stack(pdf["vector"].to_numpy())
        if len(x) <= k or not (np.abs(x) <= 1e150).all():
            chosen, cluster = K.kmedoids(K.Distances(x), k)
        else:
            s = stretchwise(Held(x), {0: len(x)}, k)[0]
            chosen, cluster = s.chosen, apart(s.vectors, x).argmin(0)
        return pd.DataFrame({ident: ids, "medoid": [ids[chosen[c]] for c in cluster]})

    spark, fields = df.sparkSession, f"`{ident}` long, medoid long"

    def apiece(rows):
        # few bytes make much work: groups are dealt over all tasks, whatever they weigh
        return K.grouped(rows.select(F.col("by").alias(by), "id", "vector").repartition(partitions(spark), by), by, fields, alone)

    if not large:
        return apiece(rows)
    numbers = spark.createDataFrame([(r.by, g) for g, r in enumerate(large)], f"by_ {kinds[by]}, g int")
    dealt = rows.join(numbers, F.col("by").eqNullSafe(F.col("by_")), "left")
    n = F.row_number().over(W.partitionBy("g").orderBy("id", "vector")).cast("long") - 1
    numbered = dealt.where("g IS NOT NULL").select("g", "id", "vector", n.alias("n"))

    def pack(key, rows):
        import pyarrow as pa

        rows = rows.sort_by("n")
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([rows.column("id").to_pylist()], pa.list_(pa.int64())), "points": pa.array([matrix(rows.column("vector")).tobytes()], pa.binary())})

    blocks = numbered.withColumn("block", F.floor(F.col("n") / BLOCK)).groupBy("g", "block").applyInArrow(pack, "g int, block long, ids array<long>, points binary")
    points = Points(materialize(blocks.repartitionByRange(partitions(spark), "g", "block"), "points"))
    groups = stretchwise(points, {g: r.size for g, r in enumerate(large)}, k)
    state, keys = {}, [r.by for r in large]
    for g, found in points.ask({g: s.chosen for g, s in groups.items()}).items():
        state[g] = [i for i, _ in found], [v for _, v in found]

    def nearest(g, start, ids, x):
        medoids, vectors = state[g]
        return {by: [keys[g]] * len(x), ident: ids.values, "medoid": [medoids[i] for i in apart(vectors, x).argmin(0)]}

    made = points.run(nearest, f"`{by}` {kinds[by]}, {fields}")
    return made.unionByName(apiece(dealt.where("g IS NULL")))
