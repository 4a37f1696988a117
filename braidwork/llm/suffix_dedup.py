"""Removal of every byte that a repeated string of 200 bytes covers, by hash-compared suffix sorts.

Strings of WIDTH bytes are called windows. Each window names as its anchor the least of its runs of ANCHOR bytes, by a
rolling hash, the leftmost on ties; equal windows so have equal anchors at equal places, and neighbouring windows mostly
share theirs. The windows of one anchor make up one stretch of text.

1. Anchors go, packed, to shards by the 64-bit hash of their bytes, with a 128-bit digest of their stretch. An anchor seen
   once repeats nothing; two stretches equal in all 192 bits repeat wholly (among 10**13 stretches, about 100 TB, the
   chance of one wrong pair is below 10**-30); only anchors seen with differing stretches need their bytes. An anchor with
   many differing stretches among documents read together needs its bytes anyway: its shard is told of it once a task.
2. Those stretches are cut from their documents and meet by anchor. Windows at the same place relative to the anchor are
   sorted as suffixes: prefix polynomial hashes give the hash of any string, a binary search over them the common
   extension of two suffixes, so a comparison takes the logarithm of the width; a merge sort orders all sets of suffixes
   at once. Neighbours that agree over the whole width are compared byte by byte before they count.
3. An anchor with too many stretches for a task is dealt over blocks; windows that are alone in their block meet those
   of the other blocks by digest, in an aggregation.
4. Each document takes the union of its stretches and windows found, and is cut.

Matches never cross documents, and everything is judged on the input.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import materialize, partitions, table

WIDTH, ANCHOR = 200, 100
#: Documents whose anchors are packed together; bytes of text whose anchors go to one shard, about; differing stretches among
#: documents packed together from which on an anchor is common.
ROWS, SHARD_BYTES, COMMON = 4096, 96 << 20, 16
#: Bytes whose rolling hashes are held at once; stretches of an anchor that one task sorts; bytes sorted together.
CHUNK, BLOCK, SORTED = 1 << 20, 8192, 1 << 20
#: Odd bases of the polynomials: modulo 2**32 to choose anchors, 2**64 to compare.
BASE32, BASE64 = 0x9E3779B1, 0x9E3779B97F4A7C15
_powers: dict = {}


def powers(bits: int, n: int):
    """(powers, inverse powers) of the base modulo 2**bits, n of each."""
    import numpy as np

    if bits not in _powers or len(_powers[bits][0]) < n:
        kind, base = (np.uint32, BASE32) if bits == 32 else (np.uint64, BASE64)
        made = []
        for b in (base, pow(base, -1, 1 << bits)):
            p = np.full(n, b, kind)
            p[0] = 1
            made.append(np.cumprod(p, dtype=kind))
        _powers[bits] = tuple(made)
    return _powers[bits]


def prefix_hashes(data, bits: int = 64):
    """h of length len + 1: (h[j] - h[i]) * inverse powers[i] is the polynomial hash of data[i:j]."""
    import numpy as np

    kind = np.uint32 if bits == 32 else np.uint64
    out = np.zeros(len(data) + 1, kind)
    np.cumsum((data.astype(kind) + kind(1)) * powers(bits, len(data) + 1)[0][: len(data)], dtype=kind, out=out[1:])
    return out


def anchors(data, bounds, width: int = WIDTH, anchor: int = ANCHOR):
    """(place, first window, last window) of each anchor of texts that stand one after another; bounds: where they start and end.

    Places are ascending; the windows of an anchor are neighbours.
    """
    import numpy as np

    span = width - anchor + 1
    found = []
    starts, ends = bounds[:-1], bounds[1:]
    for s in range(0, max(0, len(data) - width + 1), CHUNK):
        t = data[s : s + CHUNK + width - 1]
        h = prefix_hashes(t, 32)
        rolled = (h[anchor:] - h[:-anchor]) * powers(32, CHUNK + width + 1)[1][: len(t) - anchor + 1] * np.uint32(0x85EBCA77)
        keys = rolled.astype(np.uint64) << np.uint64(32) | np.arange(len(rolled), dtype=np.uint64)
        rows = np.concatenate([keys, np.full(-len(keys) % span, 0xFFFFFFFFFFFFFFFF, np.uint64)]).reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(t) - width + 1
        place = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64) + s
        valid = np.ones(n, bool)
        i = np.searchsorted(ends, s, "right")
        while i < len(ends) and starts[i] < s + len(t):
            valid[max(0, max(starts[i], ends[i] - width + 1) - s) : max(0, ends[i] - s)] = False
            i += 1
        window = np.flatnonzero(valid)
        if len(window):
            place = place[window]
            new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            found.append((place[new], window[new] + s, window[np.r_[new[1:], len(place)] - 1] + s))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    place, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # an anchor of windows of two chunks
    return place[new], first[new], last[np.r_[new[1:], len(place)] - 1]


class Suffixes:
    """Comparison of suffixes of data, up to a width, by their prefix polynomial hashes."""

    def __init__(self, data, width: int = WIDTH):
        self.data, self.width = data, width
        self.h, self.inverse = prefix_hashes(data), powers(64, len(data) + 1)[1]

    def common(self, i, j):
        """Length of the common extension of the suffixes at i and j, at most the width, by binary search. Arrays."""
        import numpy as np

        low, high = np.zeros(len(i), np.int64), np.full(len(i), self.width)
        hi, hj, pi, pj = self.h[i], self.h[j], self.inverse[i], self.inverse[j]
        same = (self.h[i + self.width] - hi) * pi == (self.h[j + self.width] - hj) * pj
        low[same] = self.width
        open_ = np.flatnonzero(~same)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            a, b = i[open_], j[open_]
            ok = (self.h[a + mid] - hi[open_]) * pi[open_] == (self.h[b + mid] - hj[open_]) * pj[open_]
            low[open_[ok]], high[open_[~ok]] = mid[ok], mid[~ok]
            open_ = open_[high[open_] - low[open_] > 1]
        return low

    def after(self, i, j):
        """Whether the suffix at i comes after the one at j; equal ones don't."""
        import numpy as np

        n = self.common(i, j)
        at = np.minimum(n, self.width - 1)
        return (n < self.width) & (self.data[i + at] > self.data[j + at])

    def sort(self, start, group):
        """The order of the suffixes at start within their groups (which are sorted already): a merge sort, all groups at once."""
        import numpy as np

        order = np.arange(len(start))
        bounds = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
        first = np.repeat(bounds[:-1], np.diff(bounds))
        last = np.repeat(bounds[1:], np.diff(bounds))
        run, longest = 1, int(np.diff(bounds).max(initial=0))
        where = np.arange(len(start))
        while run < longest:
            nth = (where - first) // run
            left = nth % 2 == 0
            other = first + (nth + np.where(left, 1, -1)) * run  # the run to merge with
            low, end = np.minimum(other, last), np.minimum(other + run, last)
            base = low.copy()
            busy = np.flatnonzero(end > low)
            while len(busy):
                mid = (low[busy] + end[busy]) // 2
                own, its = start[order[busy]], start[order[mid]]
                # of equal ones, those of the left run go first
                up = np.where(left[busy], self.after(own, its), ~self.after(its, own))
                low[busy[up]], end[busy[~up]] = mid[up] + 1, mid[~up]
                busy = busy[end[busy] > low[busy]]
            target = np.where(left, where, other + (where - first) % run) + (low - base)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            run *= 2
        return order

    def repeated(self, start, group):
        """(which suffixes equal another of their group over the width, order, which in order begin a class of equal ones)."""
        import numpy as np

        order = self.sort(start, group)
        i, j = start[order[:-1]], start[order[1:]]
        same = (group[order[:-1]] == group[order[1:]]) & (self.common(i, j) >= self.width)
        hit = np.flatnonzero(same)
        for part in range(0, len(hit), 4096):  # equal hashes are verified byte by byte
            k = hit[part : part + 4096]
            ways = np.arange(self.width)
            same[k] = (self.data[i[k][:, None] + ways] == self.data[j[k][:, None] + ways]).all(1)
        found = np.zeros(len(start), bool)
        found[order[:-1][same]] = True
        found[order[1:][same]] = True
        return found, order, np.r_[True, ~same] if len(start) else np.zeros(0, bool)


def row_key(key: str, text: str):
    """A row's key: rows equal in id and text have equal ones, and are cut alike."""
    return F.xxhash64(F.col(key), F.col(text))


JUDGED = "kind int, row_key long, data binary, n int, h long, lo long, place int, last int, known boolean"
#: Kinds of rows: a shard's anchors of some documents, packed; a row's stretches that are known to repeat; a stretch of an
#: anchor seen elsewhere with others, whose bytes are needed.
ANCHORS, REPEATS, ASKED = range(3)


def _judged_rows(kind: int, rows: int, shard=None, **columns):
    """An Arrow batch of JUDGED (after shard, if that is given), nulls where a column is not given."""
    import pyarrow as pa

    kinds = {"row_key": pa.int64(), "data": pa.binary(), "n": pa.int32(), "h": pa.int64(), "lo": pa.int64(), "place": pa.int32(), "last": pa.int32(), "known": pa.bool_()}
    made = [pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in kinds.items()]
    first, names = ([], []) if shard is None else ([pa.array(shard, pa.int32())], ["shard"])
    return pa.RecordBatch.from_arrays([*first, pa.array([kind] * rows, pa.int32()), *made], names=[*names, "kind", *kinds])


def _repeats(key, lo, hi, shards: int | None = None):
    """One row of kind REPEATS for each key; arrays."""
    import numpy as np

    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]) if len(key) else np.zeros(1, np.int64)
    spans = list(zip(cuts, cuts[1:], strict=False))
    data = [np.concatenate([lo[a:b], hi[a:b]]).astype("<i8").tobytes() for a, b in spans]
    keys = [int(key[a]) for a, _ in spans]
    return _judged_rows(REPEATS, len(spans), None if shards is None else [k % shards for k in keys], row_key=keys, data=data, n=[int(b - a) for a, b in spans])


def _classes(h, c):
    """(order, where classes of equal (h, c) begin in it, where those of equal h begin); c: two columns."""
    import numpy as np

    order = np.lexsort((c[:, 1], c[:, 0], h))
    h, c = h[order], c[order]
    new_h = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    return order, np.flatnonzero(new_h | np.r_[True, (c[1:] != c[:-1]).any(1)]) if len(h) else np.zeros(0, np.int64), np.flatnonzero(new_h)


def _sizes(starts, n: int):
    import numpy as np

    return np.diff(np.r_[starts, n])


def _packed_anchors(docs: DataFrame, shards: int) -> DataFrame:
    """Rows of all kinds, of the documents of each batch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        short, digest = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        common = np.zeros(0, np.uint64)  # anchors whose shards this task has told
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            texts = batch.column(1).cast(pa.large_binary())
            bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = memoryview(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]] if len(texts) else memoryview(b"")
            bounds = bounds - bounds[0]
            keys = batch.column(0).to_numpy()
            place, lo, hi = anchors(np.frombuffer(raw, np.uint8), bounds)
            h = np.fromiter((short(raw[i : i + ANCHOR]) for i in place.tolist()), np.uint64, len(place))
            c = b"".join(digest(raw[i:j], k) for i, j, k in zip(lo.tolist(), (hi + WIDTH).tolist(), (place - lo).tolist(), strict=True))
            c = np.frombuffer(c, ">u8").astype(np.uint64).reshape(-1, 2)
            doc = np.searchsorted(bounds, lo, "right") - 1
            at, place, last = lo - bounds[doc], (place - lo).astype(np.int64), hi - lo
            order, new_c, new_h = _classes(h, c)
            count, classes = _sizes(new_c, len(order)), _sizes(np.searchsorted(new_c, new_h), len(new_c))
            # all members of a class that occurs twice here are known to repeat
            x = order[np.repeat(count > 1, count)]
            yield _repeats(keys[doc[x]], at[x], at[x] + last[x] + WIDTH, shards)
            told = np.isin(h[order[new_h]], common)
            many = (classes >= COMMON) | told
            x, known = order[new_c][np.repeat(many, classes)], (count > 1)[np.repeat(many, classes)]
            if len(x):
                key = keys[doc[x]]
                yield _judged_rows(ASKED, len(x), (key % shards).astype(np.int32), row_key=key, h=h[x].view(np.int64), lo=at[x], place=place[x], last=last[x], known=known)
            sent = np.r_[order[new_c][np.repeat(~many, classes)], order[new_h][many & ~told]]
            flag = np.r_[np.minimum(count[np.repeat(~many, classes)], 2), np.full((many & ~told).sum(), 3)].astype(np.uint8)
            common = np.union1d(common, h[order[new_h]][many])
            shard = (h[sent] >> np.uint64(32)).astype(np.int64) % shards
            by = np.argsort(shard, kind="stable")
            sent, flag, shard = sent[by], flag[by], shard[by]
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            full = np.flatnonzero(np.diff(cuts))
            data, n = [], []
            for s in full.tolist():
                own = slice(cuts[s], cuts[s + 1])
                x = sent[own]
                data.append(b"".join(b.tobytes() for b in (h[x], c[x], keys[doc[x]], at[x].astype(np.int64), flag[own], place[x].astype(np.uint8), last[x].astype(np.uint8))))
                n.append(len(x))
            yield _judged_rows(ANCHORS, len(full), full.astype(np.int32), data=data, n=n)
            del texts, raw
            pa.default_memory_pool().release_unused()

    return docs.select("row_key", F.col("text_").cast("binary")).mapInArrow(run, f"shard int, {JUDGED}")


def _judged(packed: DataFrame, shards: int) -> DataFrame:
    """Rows of kinds REPEATS and ASKED: those made before pass, the others are told from the shard's anchors."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        parts: list[list] = [[] for _ in range(7)]
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)
            own = pc.equal(batch["kind"], ANCHORS)
            if (passed := batch.filter(pc.invert(own))).num_rows:
                yield passed.select(range(1, batch.num_columns))
            own = batch.filter(own)
            for data, n in zip(own["data"].to_pylist(), own["n"].to_pylist(), strict=True):
                at = 0
                for part, (t, wide) in zip(parts, ((np.uint64, 1), (np.uint64, 2), (np.int64, 1), (np.int64, 1), (np.uint8, 1), (np.uint8, 1), (np.uint8, 1)), strict=True):
                    a = np.frombuffer(data, t, n * wide, at)
                    part.append(a.reshape(n, 2) if wide == 2 else a)
                    at += a.nbytes
        if not parts[0]:
            return
        h, c, key, lo, flag, place, last = (np.concatenate(p) for p in parts)
        del parts[:]
        order, new_c, new_h = _classes(h, c)
        h, key, lo, flag, place, last = (x[order] for x in (h, key, lo, flag, place, last))
        n_c, n_h = _sizes(new_c, len(h)), _sizes(new_h, len(h))
        # a flag of 3 tells that the anchor is common elsewhere; its stretch is asked for there
        real = flag < 3
        common = np.repeat(np.maximum.reduceat(flag, new_h) == 3, n_h)
        times = np.where(real, flag, 0).astype(np.int64)
        seen_h, seen_c = np.repeat(np.add.reduceat(times, new_h), n_h), np.repeat(np.add.reduceat(times, new_c), n_c)
        settled = real & (seen_c > 1) & (flag == 1)
        yield _repeats(key[settled], lo[settled], lo[settled] + last[settled] + WIDTH)
        unsettled = real & ((seen_h > 1) | common) & (seen_c == 1)
        open_h = np.repeat(np.maximum.reduceat(unsettled, new_h), n_h) | common
        # of each class the first real one
        nth = np.where(real, np.arange(len(h)), len(h))
        first = np.repeat(np.minimum.reduceat(nth, new_c), n_c) == np.arange(len(h))
        x = np.flatnonzero(open_h & real & first)
        yield _judged_rows(ASKED, len(x), row_key=key[x], h=h[x].view(np.int64), lo=lo[x], place=place[x].astype(np.int32), last=last[x].astype(np.int32), known=seen_c[x] > 1)

    return packed.repartitionById(shards, F.col("shard")).mapInArrow(run, JUDGED)


def _in_blocks(asked: DataFrame) -> DataFrame:
    """asked with blocks: over how many blocks the stretches of an anchor are dealt."""
    many = materialize(asked.groupBy(F.col("h").alias("h_")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "suffix-blocks")
    return asked.join(many, F.col("h") == F.col("h_"), "left").select(*asked.columns, F.coalesce("blocks", F.lit(1)).alias("blocks"))


def _stretches(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked stretches with their bytes."""
    by_row = asked.groupBy(F.col("row_key").alias("k_")).agg(F.collect_list(F.struct("h", "lo", "place", "last", "known", "blocks")).alias("asked_"))
    joined = docs.select("row_key", "text_").join(by_row, F.col("row_key") == F.col("k_")).select("row_key", F.col("text_").cast("binary"), "asked_")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for row, asked_ in enumerate(batch.column(2).to_pylist()):
                raw = texts[row].as_py()
                made = [a | {"row_key": keys[row], "bytes": raw[a["lo"] : a["lo"] + a["last"] + WIDTH]} for a in asked_]
                yield pa.RecordBatch.from_pylist(made, schema)

    import pyarrow as pa

    schema = pa.schema([("h", pa.int64()), ("lo", pa.int64()), ("place", pa.int32()), ("last", pa.int32()), ("known", pa.bool_()), ("blocks", pa.int32()), ("row_key", pa.int64()), ("bytes", pa.binary())])
    return joined.mapInArrow(run, "h long, lo long, place int, last int, known boolean, blocks int, row_key long, bytes binary")


def _sorted_windows(stretches: DataFrame) -> DataFrame:
    """kind 1: windows that repeat within their block; kind 3: digests of windows of anchors with several blocks."""
    spark = stretches.sparkSession
    block = F.pmod(F.xxhash64("row_key", "lo"), F.col("blocks")).cast("int")
    dealt = stretches.withColumn("block", block).repartition(partitions(spark), "h", "block").sortWithinPartitions("h", "block")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("kind", pa.int32()), ("row_key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

        def solve(rows: pa.Table) -> Iterator:
            h, block_ = rows["h"].to_numpy(), rows["block"].to_numpy()
            place, last, lo, key = (rows[c].to_numpy().astype(np.int64) for c in ("place", "last", "lo", "row_key"))
            known, many = rows["known"].to_numpy(zero_copy_only=False), rows["blocks"].to_numpy() > 1
            parts = rows["bytes"].to_pylist()
            data = np.frombuffer(b"".join(parts), np.uint8)
            begin = np.cumsum([0, *map(len, parts)])[:-1]
            n = last + 1
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            group = np.cumsum(np.r_[False, (h[1:] != h[:-1]) | (block_[1:] != block_[:-1])])
            ident = group[row] * WIDTH + (place[row] - nth)  # windows at the same place relative to their anchor
            by = np.argsort(ident, kind="stable")
            row, nth, ident = row[by], nth[by], ident[by]
            start = begin[row] + nth
            found, order, new = Suffixes(data).repeated(start, ident)
            told = np.flatnonzero(found & ~known[row])
            if len(told):
                at = lo[row[told]] + nth[told]
                # neighbouring windows of a stretch are told as one
                o = np.lexsort((nth[told], row[told]))
                r, x, at = row[told][o], nth[told][o], at[o]
                fresh = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (x[1:] != x[:-1] + 1)])
                end = np.r_[fresh[1:], len(r)] - 1
                z = np.zeros(len(fresh), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(fresh), np.int32)), pa.array(key[r[fresh]]), pa.array(at[fresh]), pa.array(at[end] + WIDTH), pa.array(z), pa.array(z)], schema=schema)
            first = order[new]  # one window of each class
            size = np.diff(np.r_[np.flatnonzero(new), len(order)])
            cross = many[row[first]]
            first, size = first[cross], size[cross]
            if len(first):
                d = [xxhash.xxh3_128_intdigest(data[s : s + WIDTH]) for s in start[first].tolist()]
                halves = [pa.array([(x >> shift & (1 << 64) - 1) - (x >> shift + 63 & 1) * (1 << 64) for x in d], pa.int64()) for shift in (0, 64)]
                several = (size > 1) | known[row[first]]
                at = lo[row[first]] + nth[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), 3, np.int32)), pa.array(key[row[first]]), pa.array(np.where(several, -1, at)), pa.array(at + WIDTH), *halves], schema=schema)

        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(b.get_total_buffer_size() for b in held) < 2 * SORTED:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            h, b = whole["h"].to_numpy(), whole["block"].to_numpy()
            cut = int(np.flatnonzero((h != h[-1]) | (b != b[-1]))[-1]) + 1 if ((h != h[-1]) | (b != b[-1])).any() else 0
            if cut:
                yield from in_parts(whole.slice(0, cut), solve)
            held = whole.slice(cut).to_batches()
        if held:
            yield from in_parts(pa.Table.from_batches(held), solve)

    def in_parts(rows, solve):
        """Whole blocks, so many at once that their bytes are about SORTED."""
        import numpy as np

        h, b = rows["h"].to_numpy(), rows["block"].to_numpy()
        new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (b[1:] != b[:-1])])
        total = np.cumsum(rows["last"].to_numpy().astype(np.int64) + WIDTH)
        done, a = 0, 0
        for x in [*new[1:].tolist(), len(h)]:
            if total[x - 1] - done >= SORTED or x == len(h):
                yield from solve(rows.slice(a, x - a).combine_chunks())
                done, a = total[x - 1], x

    return dealt.mapInArrow(run, "kind int, row_key long, lo long, hi long, d1 long, d2 long")


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(row_key, stretches array<binary>): where rows of docs (row_key, text_) have bytes to remove; some may overlap."""
    size = docs.agg(F.sum(F.octet_length("text_"))).first()[0] or 0
    shards = max(partitions(docs.sparkSession), -(-size // SHARD_BYTES))
    judged = materialize(_judged(_packed_anchors(docs, shards), shards), "suffix-anchors")
    asked = judged.where(F.col("kind") == ASKED).select("row_key", "h", "lo", "place", "last", "known")
    windows = materialize(_sorted_windows(_stretches(docs, _in_blocks(asked))), "suffix-windows")
    digests = windows.where("kind = 3")
    shared = digests.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min("lo").alias("least")).where("n > 1 OR least < 0").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"))
    met = digests.where("lo >= 0").join(shared, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    single = windows.where("kind = 1").select("row_key", "lo", "hi").unionByName(met.select("row_key", "lo", "hi"))
    arrays = judged.where(F.col("kind") == REPEATS).select("row_key", "data").unionByName(single.select("row_key", F.concat(_little(F.col("lo")), _little(F.col("hi"))).alias("data")))
    # rows equal in id and text have one key and tell the same
    return arrays.groupBy("row_key").agg(F.collect_set("data").alias("stretches"))


def _little(x):
    """A long as its 8 little-endian bytes."""
    return F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(x), 16, "0"), F.lit("(..)"), F.lit(1))), ""))


def spans(stretches: list[bytes]) -> list[tuple[int, int]]:
    """The maximal runs that the stretches cover. Each is an array of starts followed by as many ends, 64-bit little-endian."""
    import numpy as np

    if not stretches:
        return []
    both = [np.frombuffer(s, "<i8").reshape(2, -1) for s in stretches]
    lo, hi = np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
    return list(zip(lo[new].tolist(), hi[np.r_[new[1:], len(lo)] - 1].tolist(), strict=True))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with kept (the bytes that stay), n_bytes, n_removed, n_spans. Columns of docs with these names give way.

    kept is binary; decoded makes it a string, without the bytes of characters that were cut in two.

    A null text is empty, texts under the width keep all. Repeated rows repeat each other's text. A row's key may be null or
    repeat. No rows give none.
    """
    made = ("kept", "n_bytes", "n_removed", "n_spans", "row_key", "text_", "stretches", "k_")
    own = [c for c in docs.columns if c.lower() not in made]
    read = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("text_")).withColumn("row_key", row_key(key, "text_"))
    found = materialize(repeated_stretches(read.select("row_key", "text_")), "suffix-stretches").withColumnRenamed("row_key", "k_")
    joined = read.join(found, F.col("row_key") == F.col("k_"), "left").select(*own, "text_", "stretches")
    types = dict(docs.dtypes)
    fields = ", ".join([*(f"`{c}` {types[c]}" for c in own), f"kept {'string' if decoded else 'binary'}, n_bytes long, n_removed long, n_spans long"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            kept, sizes, removed, runs = [], [], [], []
            for raw, stretches in zip(batch.column(len(own)), batch.column(len(own) + 1), strict=True):
                raw, cut = raw.as_py(), spans(stretches.as_py() or [])
                edges = [0, *(x for span in cut for x in span), len(raw)]
                stays = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                kept.append(stays)
                sizes.append(len(raw))
                removed.append(len(raw) - len(stays))
                runs.append(len(cut))
            kept = pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if decoded else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), kept, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=[*own, "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.select(*own, F.col("text_").cast("binary"), "stretches").mapInArrow(run, fields)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
