"""Near copies by the exact Jaccard similarity of their sets of five-word shingles, and their components.

Texts with equal sets are collapsed first. Candidates come from two operators: SimHash fingerprints of the sets, compared in
tiles, join most near copies at a small cost; then packed MinHash bins, taken in bands, bring together what they left. Two
sets of a Jaccard similarity of 0.8 miss each other in all 64 bands of 8 bins with a probability below 10**-5. Every
candidate pair is decided by the sets themselves; first, pairs that can't be alike are left out by what is packed of them: a
set's shingles as bits of a map, of which two maps differ in no more than their sets do, or a large one's bins, whose estimate
must be within six standard deviations of the share. Where many texts meet in a band, a few of them are compared with all
others at a time, and pairs that the links found so far already join are left out, so a group of many near copies isn't
compared with itself whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.llm import minhash, simhash
from braidwork.llm.common import discard, materialize, numbered, partitions
from braidwork.operators.components import connected_components

#: Shingles of so many words; sets are near copies where SHARE[0] / SHARE[1] of their union is in both.
SHINGLE, SHARE = 5, (4, 5)
#: Bands of MinHash bins; texts of a group compared with all others in the first round, and how many times more in each next.
BANDS, PIVOTS, MORE = 64, 1, 8
#: Fingerprints within so many bits are candidates in the first round. It decides no pair, only what the later rounds find joined.
RADIUS = 3
#: Documents read together; pairs given on together by a task; sets of up to so many shingles are packed as maps; bytes packed.
BLOCK, PACK, SMALL, PACKED = 256, 1 << 16, 640, 256


def shingle_set(text: bytes, shingle: int = SHINGLE):
    """Sorted distinct hashes of the shingles of the lower-cased words; fewer words than a shingle are one shingle."""
    import numpy as np

    lower = text.lower().decode(errors="replace")  # on bytes: A-Z only
    return np.unique(minhash.shingle_hashes(minhash.word_hashes(lower), shingle))


def set_id(hashes) -> int:
    import xxhash

    found = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return found - (found >> 63 << 64)


def packed_sets(sets: list, low) -> list[bytes]:
    """PACKED bytes of each set: of one of SMALL shingles at most a map with a bit set for each of them; of others two bins a byte."""
    import numpy as np

    pairs = low[:, ::2] | low[:, 1::2] << 4
    out = []
    for own, bins in zip(sets, pairs, strict=True):
        if len(own) <= SMALL:
            bits = np.zeros(8 * PACKED, bool)
            bits[own % np.uint64(8 * PACKED)] = True
            out.append(np.packbits(bits).tobytes())
        else:
            out.append(bins.tobytes())
    return out


def may_be_alike(x, y, nx, ny):
    """Which pairs of packed sets (rows of bytes) with sizes nx and ny may have the share in common; a map and bins may.

    A bit that is set in one of two maps stands for a shingle of that set alone, so maps differ in at most as many bits as
    their sets do in shingles: no pair that is alike enough is left out by them.
    """
    import numpy as np

    a, b = SHARE
    out = b * np.minimum(nx, ny) >= a * np.maximum(nx, ny)
    small, large = np.flatnonzero(out & (nx <= SMALL) & (ny <= SMALL)), np.flatnonzero(out & (nx > SMALL) & (ny > SMALL))
    for i in range(0, len(small), 4096):
        k = small[i : i + 4096]
        differ = np.bitwise_count(x[k].view("<u8") ^ y[k].view("<u8")).sum(1, dtype=np.int64)
        out[k] = (b + a) * differ <= (b - a) * (nx[k] + ny[k])
    for i in range(0, len(large), 4096):
        k = large[i : i + 4096]
        differ = x[k] ^ y[k]
        same = ((differ & 15) == 0).sum(1) + ((differ >> 4) == 0).sum(1)
        chance = 2.0**-minhash.BITS
        found = (same / minhash.BINS - chance) / (1 - chance)
        spread = 6 * np.sqrt(a * (b - a) / b**2 / np.minimum(minhash.BINS, np.minimum(nx[k], ny[k])) + chance / minhash.BINS)
        out[k] = found >= a / b - spread
    return out


def band_keys(low):
    """texts x BANDS numbers: the packed bins of each band, mixed with the band's number."""
    import numpy as np

    each = low.shape[1] // BANDS
    packed = np.zeros((len(low), BANDS), np.uint64)
    for i in range(each):
        packed = packed << np.uint64(minhash.BITS) | low[:, i::each]
    return minhash._mix(packed * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64))


def described(docs: DataFrame) -> DataFrame:
    """(key, digest, id, fp, n, bands, packed) of docs (key, digest, text binary): what is told of each text's set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                sets = [shingle_set(x.as_py()) for x in batch.column(2)]
                fps = [simhash.fingerprint(own) for own in sets]
                low, _ = minhash.low_bits(sets)
                bands = band_keys(low).view("<i8").tolist()
                made = [pa.array(map(set_id, sets), pa.int64()), pa.array([x - (x >> 63 << 64) for x in fps], pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed_sets(sets, low), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["key", "digest", "id", "fp", "n", "bands", "packed"])

    return docs.mapInArrow(run, "key long, digest long, id long, fp long, n int, bands array<long>, packed binary")


def _by_group(rows: DataFrame, take, fields: str) -> DataFrame:
    """take(arrays of s, id, n, c, and packed where rows have it) over whole groups of rows with one s, in the order of s and id; gives arrays of fields."""
    names = ["s", "id", "n", "c", *(["packed"] if "packed" in rows.columns else [])]
    kept = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def made(parts: list) -> Iterator:
            if not sum(len(p[0]) for p in parts):
                return
            out = take(*(np.concatenate([p[k] for p in parts]) for k in range(len(names))))
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=kept)

        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            own += [np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, PACKED) for c in batch.columns[4:]]
            cut = int(np.searchsorted(own[0], own[0][-1]))  # the first row of the last group
            if cut or (held and held[0][0][0] != own[0][-1]):
                yield from made([*held, [x[:cut] for x in own]])
                held = []
            held.append([x[cut:] for x in own])
        if held:
            yield from made(held)

    return rows.select(*names).repartition(partitions(rows.sparkSession), "s").sortWithinPartitions("s", "id").mapInArrow(run, fields)


def _bounds(s):
    """The first row and the end of each row's group."""
    import numpy as np

    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[starts, len(s)])
    return np.repeat(starts, size), np.repeat(starts + size, size)


def candidates(rows: DataFrame, pivots: int) -> DataFrame:
    """(u, v): pairs of the first so many texts of each group with all after them, that may be alike and are not yet joined."""

    def take(s, id_, n, c, packed):
        import numpy as np

        start, end = _bounds(s)
        row = np.arange(len(s))
        active = row[row - start < pivots]
        seen, held, d = [np.empty((0, 2), np.int64)], 0, 0
        while len(active):
            d += 1
            active = active[active + d < end[active]]
            x = active[c[active] != c[active + d]]
            x = x[may_be_alike(packed[x], packed[x + d], n[x].astype(np.int64), n[x + d].astype(np.int64))]
            pair = np.stack([np.minimum(id_[x], id_[x + d]), np.maximum(id_[x], id_[x + d])], 1)
            if len(pair):
                seen.append(pair)
                held += len(pair)
            if held > 16 * PACK:
                seen, held = [np.unique(np.concatenate(seen), axis=0)], 0
        out = np.unique(np.concatenate(seen), axis=0)
        return np.ascontiguousarray(out[:, 0]), np.ascontiguousarray(out[:, 1])

    return _by_group(rows, take, "u long, v long").distinct()


def beyond(rows: DataFrame, pivots: int) -> DataFrame:
    """Rows of the groups without the texts that were compared with all others, where two of the rest aren't joined."""

    def take(s, id_, n, c):
        import numpy as np

        start, _ = _bounds(s)
        row = np.arange(len(s))
        rest = np.flatnonzero(row - start >= pivots)
        if not len(rest):
            return s[:0], id_[:0], n[:0], c[:0]
        first = np.flatnonzero(np.r_[True, s[rest][1:] != s[rest][:-1]])
        low, high = np.minimum.reduceat(c[rest], first), np.maximum.reduceat(c[rest], first)
        mixed = np.repeat(low != high, np.diff(np.r_[first, len(rest)]))
        rest = rest[mixed]
        return s[rest], id_[rest], n[rest], c[rest]

    return _by_group(rows, take, "s long, id long, n int, c long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are alike enough, by the sets of their whole texts."""
    a, b = SHARE
    side = lambda k: texts.select(F.col("id").alias(f"id_{k}"), F.col("text").alias(f"t_{k}"))
    both = pairs.join(side("v"), F.col("v") == F.col("id_v")).join(side("u"), F.col("u") == F.col("id_u")).select("u", "v", "t_u", "t_v")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, one = None, None
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hit = []
            for k in range(len(u)):
                if u[k] != last:
                    last, one = u[k], shingle_set(batch.column(2)[k].as_py())
                other = shingle_set(batch.column(3)[k].as_py())
                shared = len(np.intersect1d(one, other, assume_unique=True))
                if b * shared >= a * (len(one) + len(other) - shared):
                    hit.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in hit], pa.int64()), pa.array([v[k] for k in hit], pa.int64())], names=["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def close_fingerprints(texts: DataFrame, radius: int) -> DataFrame:
    """(u, v): pairs of ids whose fingerprints are equal or linked within the radius, as stars. texts: id, fp."""
    least = texts.groupBy("fp").agg(F.min("id").alias("least_"))
    least = materialize(least, "near-fingerprints")
    same = texts.join(least.withColumnRenamed("fp", "fp_"), F.col("fp") == F.col("fp_")).where("id <> least_").select(F.col("least_").alias("u"), F.col("id").alias("v"))
    of = lambda c: least.select(F.col("fp").alias(f"fp_{c}"), F.col("least_").alias(f"id_{c}"))
    found = simhash.links(least.select("fp"), radius)
    near = found.join(of("u"), F.col("u") == F.col("fp_u")).join(of("v"), F.col("v") == F.col("fp_v")).select(F.col("id_u").alias("u"), F.col("id_v").alias("v"))
    return same.unionByName(near)


def linked(sets: DataFrame, texts_of, pivots: int = PIVOTS, radius: int = RADIUS) -> DataFrame:
    """(node, component) of the ids that are near copies of others, linked by all candidates alike enough.

    sets: id, fp, n, bands, packed; ids differ. texts_of(ids) gives (id, text) of a frame of ids; texts that meet no other are never
    read. Links of fingerprints come first; each round after that compares eight times as many texts of each group as the
    one before, so rounds grow with the logarithm of the largest group that links don't join.
    """

    def shared(s, id_, n, c):
        import numpy as np

        start, end = _bounds(s)
        many = np.flatnonzero(end - start > 1)
        return s[many], id_[many], n[many], c[many]

    def named(rows: DataFrame) -> DataFrame:
        return rows.join(of, F.col("id") == F.col("node"), "left").select("s", "id", "n", F.coalesce("component", "id").alias("c"))

    near = materialize(close_fingerprints(sets.select("id", "fp"), radius), "near-pairs")
    bands = sets.where("n > 0").select(F.explode("bands").alias("s"), "id", "n", F.col("id").alias("c"))
    met = materialize(_by_group(bands, shared, "s long, id long, n int, c long"), "near-groups")
    asked = near.select(F.col("u").alias("id")).unionByName(near.select(F.col("v").alias("id"))).unionByName(met.select("id")).distinct()
    texts = materialize(texts_of(asked), "near-texts")
    edges = materialize(verified(near, texts), "near-links")
    of = materialize(connected_components(edges), "near-components")
    rows = materialize(beyond(named(met), 0), "near-groups")
    packed = sets.join(rows.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("packed_id"), "packed")
    packed = materialize(packed, "near-packed")
    discard(met, near)
    while True:
        pairs = materialize(candidates(rows.join(packed, F.col("id") == F.col("packed_id")), pivots), "near-pairs")
        edges = edges.unionByName(materialize(verified(pairs, texts), "near-links"))
        before, of = of, materialize(connected_components(edges), "near-components")
        read, rows = rows, materialize(beyond(named(rows), pivots), "near-groups")
        discard(before, pairs, read)
        if not rows.limit(1).count():
            discard(texts)
            return of
        pivots *= MORE


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one row of each component: the one with the least key, of rows with that key the first by text.

    Null texts are empty; texts without words are linked with each other. Rows with a null key count as having very large
    keys made from their texts, so they stay only where no keyed row of their component does. No rows give none.
    """
    docs, names = numbered(docs)
    key, text, name, nth = names[key], names[text], "row_key_", "nth_"
    whole = F.coalesce(F.col(text), F.lit(""))
    made = F.shiftrightunsigned(F.xxhash64(whole), 1).bitwiseOR(F.lit(1 << 62))
    keyed = docs.withColumn(name, F.coalesce(F.col(key).cast("long"), made))
    narrow = keyed.select(F.col(name).alias("key"), F.xxhash64(whole).alias("digest"), whole.cast("binary").alias("text"))
    found = materialize(described(narrow), "shingle-sets")
    sets = materialize(found.groupBy("id").agg(F.min(F.struct("key", "digest")).alias("row"), *(F.first(c).alias(c) for c in ("fp", "n", "bands", "packed"))), "distinct-sets")

    def texts_of(ids: DataFrame) -> DataFrame:
        """Texts by key and digest of one row of each set: together they tell rows of one key apart."""
        at = sets.select("id", "row").join(ids.withColumnRenamed("id", "asked_"), F.col("id") == F.col("asked_"), "left_semi").select("id", F.col("row.key").alias("k_"), F.col("row.digest").alias("d_"))
        return narrow.join(at, (F.col("key") == F.col("k_")) & (F.col("digest") == F.col("d_"))).select("id", "text").dropDuplicates(["id"])

    of = linked(sets.select("id", "fp", "n", "bands", "packed"), texts_of)
    least = found.groupBy("id").agg(F.min("key").alias("least_"))
    kept = least.join(of, F.col("id") == F.col("node"), "left").groupBy(F.coalesce("component", "id").alias("c_")).agg(F.min("least_").alias(name))
    stays = kept.select(name).distinct()
    first = W.partitionBy(name).orderBy(F.xxhash64(F.col(text)))
    return keyed.join(stays, name, "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*(F.col(new).alias(old) for old, new in names.items()))
