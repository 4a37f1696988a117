"""SimHash fingerprints and their near-duplicate components.

A fingerprint's bit is set where over half of the text's shingle hashes have it set. Equal fingerprints are collapsed
first. Two fingerprints within the radius differ in at most so many of radius + 2 blocks of bits, so they agree on two
whole blocks: each fingerprint goes to one group for each pair of blocks, and only within groups are fingerprints compared,
all of them, exactly. Groups are compared in tiles with exclusive or and bit counts; rows are ordered by their population
counts, and tile pairs whose counts differ by more than the radius are skipped. A group with too many rows for a task is
dealt over cells, one for each pair of its tiles. Tasks give a star for each component of a group, not all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.llm.common import free_name, materialize, partitions, table
from braidwork.operators.components import connected_components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Rows of one side of a tile; groups of more fingerprints than CELL are dealt over cells.
TILE, CELL = 1024, 16_384


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of the shingles of the lower-cased words; fewer words than a shingle are one shingle, no words none."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z, and space and U+0009 to U+000D
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)]


def fingerprint(hashes: list[int]) -> int:
    import numpy as np

    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        own = np.array(hashes[i : i + (1 << 16)], "<u8")
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint of each whole text as a long; null and wordless texts have 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            own = [fingerprint(shingle_hashes(x.as_py() or b"", shingle)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x - (x >> 63 << 64) for x in own], pa.int64())], names=[key, "fp"])

    return docs.select(key, F.col(text).cast("binary").alias("text_")).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, fp long")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _block_keys(radius: int) -> Column:
    """array<struct<t, key>>: for each pair of radius + 2 blocks of bits, the fingerprint with the other bits cleared."""
    n = radius + 2
    bounds = [64 * i // n for i in range(n + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    signed = lambda x: x - (x >> 63 << 64)
    return F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(a | b)).cast("long")).alias("key")) for t, (a, b) in enumerate(combinations(masks, 2))))


def _union(lab, i, j):
    """lab: each row's root; joins the components of the pairs i, j and gives the new roots, each the least of its component."""
    import numpy as np

    while len(i):
        a, b = lab[i], lab[j]
        differ = a != b
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        if not len(i):
            break
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


def group_stars(group, fp, radius: int):
    """Links within groups as stars: (node, least node linked with it in its group). group: sorted group numbers; fp: unsigned.

    Small groups are compared together, all rows with the row d further on for d = 1, 2, ...; large ones in tiles.
    """
    import numpy as np

    order = np.lexsort((fp, np.bitwise_count(fp), group))
    group, fp = group[order], fp[order]
    count = np.bitwise_count(fp).astype(np.int16)
    lab = np.arange(len(fp))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    size = ends - starts
    end_of = np.repeat(ends, size)
    active = np.flatnonzero(np.repeat(size <= 2 * TILE, size))
    d = 0
    while len(active):
        d += 1
        active = active[active + d < end_of[active]]
        active = active[count[active + d] - count[active] <= radius]  # rows are in the order of their counts
        hit = active[np.bitwise_count(fp[active] ^ fp[active + d]) <= radius]
        lab = _union(lab, hit, hit + d)
    for g in np.flatnonzero(size > 2 * TILE):
        for a in range(starts[g], ends[g], TILE):
            a_end = min(a + TILE, ends[g])
            for b in range(a, ends[g], TILE):
                b_end = min(b + TILE, ends[g])
                if count[b] - count[a_end - 1] > radius:
                    break
                i, j = np.nonzero(np.bitwise_count(fp[a:a_end, None] ^ fp[None, b:b_end]) <= radius)
                lab = _union(lab, i + a, j + b)
    linked = np.flatnonzero(lab != np.arange(len(lab)))
    return fp[linked], fp[lab[linked]]


def links(distinct: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(u, v): edges whose components are those of all pairs of fingerprints within the radius. distinct: column fp, no repeats."""
    spark = distinct.sparkSession
    keyed = distinct.select("fp", F.explode(_block_keys(radius)).alias("k_")).select("fp", F.col("k_.t").alias("t"), F.col("k_.key").alias("key"))
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > cell)
    large = materialize(large, "simhash-large")
    nothing = [F.lit(-1).alias(c) for c in ("p1", "a1", "p2", "a2")]
    if large.limit(1).count():
        names = large.select(F.col("t").alias("lt"), F.col("key").alias("lk"))
        same = (F.col("t") == F.col("lt")) & (F.col("key") == F.col("lk"))
        usual = keyed.join(names, same, "left_anti").select("t", "key", *nothing, "fp")
        hot = keyed.join(names, same, "left_semi").withColumn("p", F.bit_count("fp"))
        tiles = materialize(hot.groupBy("t", "key", "p").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts")), "simhash-tiles")
        x, y = (tiles.select("t", "key", F.col("p").alias(f"p{i}"), F.col("parts").alias(f"n{i}"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"a{i}")) for i in (1, 2))
        cells = x.join(y, ["t", "key"]).where((F.col("p2") - F.col("p1") <= radius) & ((F.col("p1") < F.col("p2")) | ((F.col("p1") == F.col("p2")) & (F.col("a1") <= F.col("a2")))))
        cells = materialize(cells, "simhash-cells")
        part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
        dealt = [hot.withColumnRenamed("p", f"p{i}").join(cells, ["t", "key", f"p{i}"]).where(part(f"n{i}") == F.col(f"a{i}")).select("t", "key", "p1", "a1", "p2", "a2", "fp") for i in (1, 2)]
        keyed = usual.unionByName(dealt[0]).unionByName(dealt[1]).distinct()
    else:
        keyed = keyed.select("t", "key", *nothing, "fp")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        columns = ("t", "key", "p1", "a1", "p2", "a2")

        def stars(rows: list) -> Iterator:
            whole = pa.Table.from_batches(rows)
            ids = [whole[c].to_numpy() for c in columns]
            change = np.zeros(whole.num_rows, bool)
            for x in ids:
                change[1:] |= x[1:] != x[:-1]
            u, v = group_stars(np.cumsum(change), whole["fp"].to_numpy().view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        def name(batch, row: int) -> tuple:
            return tuple(batch.column(i)[row].as_py() for i in range(len(columns)))

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last, cut = name(batch, batch.num_rows - 1), 0
            low, high = 0, batch.num_rows - 1  # the first row of the last group
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if name(batch, mid) == last else (mid + 1, high)
            cut = low
            if cut or (held and name(held[0], held[0].num_rows - 1) != last):
                yield from stars([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from stars(held)

    dealt = keyed.repartition(partitions(spark), "t", "key", "p1", "a1", "p2", "a2").sortWithinPartitions("t", "key", "p1", "a1", "p2", "a2")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """(key, fp, component_id): one row for each row of docs; component_id is the least key reachable over links.

    Texts that are null or have no words have fingerprint 0 and are linked like others. Rows with a null key link too, but
    never name a component; one of null keys alone has a null name. Other columns are not carried. No rows give none.
    """
    found = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = materialize(found.groupBy("fp").agg(F.min(key).alias("least_")), "distinct-fingerprints")
    of = connected_components(links(distinct.select("fp"), radius, cell))
    named = distinct.join(of, F.col("fp") == F.col("node"), "left").select("fp", "least_", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "simhash-components")
    least = named.groupBy("component").agg(F.min("least_").alias("component_id")).withColumnRenamed("component", "c_")
    by_fp = named.join(least, F.col("component") == F.col("c_")).select(F.col("fp").alias("fp_"), "component_id")
    return found.join(by_fp, F.col("fp") == F.col("fp_")).select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs without all but one row of each component: the one with the least key, of rows with that key the first by text.

    Rows with a null key count as having very large keys made from their texts, so they stay only where no keyed row of
    their component does. No rows give none.
    """
    name, nth = free_name(docs, "row_key", "nth")
    made = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 1).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumn(name, F.coalesce(F.col(key).cast("long"), made))
    narrow = keyed.select(name, F.col(text).alias("text"))
    found = components(narrow, name, "text", radius=radius)
    stays = found.where(F.col(name) == F.col("component_id")).select(name).distinct()
    first = W.partitionBy(name).orderBy(F.xxhash64(F.col(text)))
    return keyed.join(stays, name, "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
