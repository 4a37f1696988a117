"""A bigram model in Elias-Fano tries, and the scoring of a corpus with it.

The model is sharded by the predicted word, never gathered: each shard is a reversed trie of two levels. The first holds its
words as a monotone sequence, their counts, their smoothed unigram probabilities quantised to 16 bits, and monotone pointers
into the second; that holds, for each word, the contexts it was seen after, relative to the word's place, and quantised
smoothed weights. A lookup is a successor search within the range of the word. All arrays of a trie stand in one buffer that
can be mapped from a file or from memory.

Smoothing is that of a Dirichlet prior: p(w | u) = (c(u w) + mass * q(w)) / (c(u) + mass), with the add-one unigram q. The
numerator belongs to the word's shard and the denominator to the context's, which each token meets as a word of its own.

Texts are read in chunks. A chunk sends each of its distinct pairs (context, word) once to the pair's shard, with how often
its training texts have it; shards so build their tries from partial counts and answer with the quantised weights. The lists
of which documents have a pair go to where the answers of the chunk meet, never to the shards, so no word and no pair is a
hot key, and what is shuffled is so many bytes a token at any number of shards. Words that many pairs share are dealt over
all shards by word and context; their counts are known to all tasks.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import held_out, materialize, partitions, table

#: Mass of the prior, in tokens. Chosen on training rows of sf0.1 alone (those of remainder 3 left out of the counts): the mean
#: log10 probability of a token is -4.17 by the base, -3.95 with a mass of 10, -3.76 with 200, -3.75 with 400.
MASS = 200.0
#: Tokens a shard, and shards at most (beyond, shards grow); bytes of text and documents packed together.
SHARD_TOKENS, MAX_SHARDS, CHUNK_BYTES, CHUNK_DOCS = 3_000_000, 1 << 18, 12 << 20, 4096
CONTEXT_BITS = 40
#: Pairs looked up together, so that the arrays of a search stay in the processor's cache.
SLICE = 1 << 15
#: Quantised log10 values: steps of 1/2048 from -16.
STEPS, LEAST = 2048, 16.0


def encode(log10):
    import numpy as np

    return np.clip(np.rint((log10 + LEAST) * STEPS), 0, 65535).astype(np.uint16)


def quantise(x):
    import numpy as np

    return encode(np.log10(x))


def value(code):
    return code / float(STEPS) - LEAST


class Bits:
    """A bit vector over 64-bit words with a directory of ones before each word; selects ones and zeros, for whole arrays."""

    def __init__(self, words, before):
        self.words, self.before = words, before

    @staticmethod
    def arrays(places, n: int):
        """words and directory of n bits with ones at places."""
        import numpy as np

        bits = np.zeros(-(-max(n, 1) // 64) * 64, np.uint8)
        bits[places] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        return words, np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)].astype(np.uint32)

    def _select(self, words, before, k):
        import numpy as np

        at = np.searchsorted(before, k, "right") - 1
        word, left = words[at], (k - before[at]).astype(np.int64)
        place = np.zeros(len(at), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << step) - 1)).astype(np.int64)
            up = left >= low
            left[up] -= low[up]
            place[up] += step
            word = np.where(up, word >> np.uint64(step), word)
        return at * 64 + place

    def one(self, k):
        return self._select(self.words, self.before, k)

    def zero(self, k):
        import numpy as np

        before = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
        return self._select(~self.words, before, k)


class EliasFano:
    """A monotone sequence of 64-bit numbers: whole bytes of low bits each, the rest in unary. Repeats are allowed."""

    def __init__(self, n: int, low, words, before):
        self.n, self.low, self.high = n, low.reshape(n, -1) if n else low.reshape(0, 0), Bits(words, before)

    @staticmethod
    def arrays(values, top: int):
        """(low bytes, words, directory) of sorted values that are below top."""
        import numpy as np

        n = len(values)
        width = min(7, max(0, -(-((top // max(n, 1)).bit_length() - 1) // 8)))
        low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :width] if n else np.zeros((0, width), np.uint8)
        high = (values >> np.uint64(8 * width)).astype(np.int64)
        words, before = Bits.arrays(high + np.arange(n), n + ((top - 1) >> 8 * width) + 2)
        return np.ascontiguousarray(low).ravel(), words, before

    @property
    def width(self) -> int:
        return self.low.shape[1]

    def _low(self, i):
        import numpy as np

        out = np.zeros(len(i), np.uint64)
        for b in range(self.width):
            out |= self.low[i, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def get(self, i):
        import numpy as np

        return (self.high.one(i) - i).astype(np.uint64) << np.uint64(8 * self.width) | self._low(i)

    def successor(self, x, first=0, after=None):
        """The place of the first number from first on that is not less than x, before after (else after). Arrays."""
        import numpy as np

        after = np.full(len(x), self.n) if after is None else after
        if not self.n:
            return np.zeros(len(x), np.int64)
        top = (x >> np.uint64(8 * self.width)).astype(np.int64)
        low = np.where(top > 0, self.high.zero(np.maximum(top - 1, 0)) - top + 1, 0)
        end = self.high.zero(top) - top
        low, end = np.maximum(low, first), np.minimum(end, after)
        end = np.maximum(low, end)
        rest = x & np.uint64((1 << 8 * self.width) - 1)
        open_ = np.flatnonzero(end > low)
        while len(open_):
            mid = (low[open_] + end[open_]) // 2
            less = self._low(mid) < rest[open_]
            low[open_[less]], end[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[end[open_] > low[open_]]
        return low

    def find(self, x, first=0, after=None):
        """The place of x, or -1."""
        import numpy as np

        at = self.successor(x, first, after)
        limit = np.full(len(x), self.n) if after is None else after
        inside = np.flatnonzero((at < limit) & (at < self.n))
        out = np.full(len(x), -1)
        hit = inside[self.get(at[inside]) == x[inside]]
        out[hit] = at[hit]
        return out


class Trie:
    """A shard's model over one buffer. Words and contexts are hashes: of 64 bits, and their upper CONTEXT_BITS bits."""

    KINDS = ("u1", "u8", "u4") * 3 + ("u8", "u2", "u2")

    def __init__(self, buffer):
        import numpy as np

        head = np.frombuffer(buffer, "<i8", 2 + len(self.KINDS))
        self.n_words, self.n_pairs = int(head[0]), int(head[1])
        arrays, at = [], 8 * len(head)
        for kind, n in zip(self.KINDS, head[2:].tolist(), strict=True):
            arrays.append(np.frombuffer(buffer, f"<{kind}", n, at))
            at += -(-n * int(kind[1]) // 8) * 8
        self.words = EliasFano(self.n_words, *arrays[0:3])
        self.pointers = EliasFano(self.n_words + 1, *arrays[3:6])
        self.contexts = EliasFano(self.n_pairs, *arrays[6:9])
        self.counts, self.unigram, self.pair = arrays[9:]

    @classmethod
    def build(cls, words, counts, pair_word, pair_context, pair_count, total: float, types: float, mass: float = MASS) -> bytes:
        """words: sorted hashes; pairs sorted by the place of the word and the context; total and types: of the training tokens."""
        import numpy as np

        q = (counts + 1) / (total + types + 1)
        pointers = np.searchsorted(pair_word, np.arange(len(words) + 1)).astype(np.uint64)
        relative = pair_word.astype(np.uint64) << np.uint64(CONTEXT_BITS) | pair_context
        arrays = [
            *EliasFano.arrays(words, 1 << 64),
            *EliasFano.arrays(pointers, len(pair_word) + 1),
            *EliasFano.arrays(relative, max(1, len(words)) << CONTEXT_BITS),
            counts.astype(np.uint64),
            quantise(q),
            quantise(pair_count + mass * q[pair_word]) if len(pair_word) else np.zeros(0, np.uint16),
        ]
        out = [np.array([len(words), len(pair_word), *map(len, arrays)], "<i8").tobytes()]
        for kind, a in zip(cls.KINDS, arrays, strict=True):
            raw = a.astype(f"<{kind}").tobytes()
            out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    @classmethod
    def mapped(cls, raw: bytes) -> Trie:
        """The trie over anonymous mapped memory."""
        memory = mmap.mmap(-1, len(raw))
        memory.write(raw)
        return cls(memory)

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie in a file, mapped."""
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def lookup(self, word, context, total: float, types: float, mass: float = MASS):
        """(count of the word, log10 of the numerator of p(word | context)). Arrays."""
        import numpy as np

        at = self.words.find(word)
        count = np.zeros(len(word), np.uint64)
        top = np.full(len(word), np.log10(mass / (total + types + 1)))
        k = np.flatnonzero(at >= 0)
        place = at[k]
        count[k] = self.counts[place]
        top[k] = np.log10(mass) + value(self.unigram[place])
        first, after = self.pointers.get(place).astype(np.int64), self.pointers.get(place + 1).astype(np.int64)
        pair = self.contexts.find(place.astype(np.uint64) << np.uint64(CONTEXT_BITS) | context[k], first, after)
        seen = pair >= 0
        top[k[seen]] = value(self.pair[pair[seen]])
        return count, top


def special(which: int) -> int:
    """Hashes that stand for the beginning (1) and the end (2) of a text: of no word, with seeds of their own."""
    import xxhash

    return xxhash.xxh3_64_intdigest(b"", which)


def token_hashes(raw: bytes):
    import re

    import numpy as np
    import xxhash

    lower = raw.lower()  # on bytes: A-Z only
    words = lower.split() if len(raw) < 1 << 20 else (m[0] for m in re.finditer(rb"[^\x20\x09-\x0D]+", lower))
    out = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)
    return np.append(out, np.uint64(special(2)))


class Packed:
    """Arrays one after another in bytes: numbers of any size, which mostly are small, and fields of a fixed size."""

    def __init__(self, raw: bytes = b""):
        self.parts, self.raw, self.at = [], raw, 0

    def put(self, a, kind: str) -> Packed:
        import numpy as np

        self.parts.append(np.ascontiguousarray(a).astype(f"<{kind}").tobytes())
        return self

    def put_small(self, a) -> Packed:
        """A byte each; those from 255 on follow as 64-bit numbers."""
        import numpy as np

        over = a[a >= 255]
        return self.put([len(over)], "u4").put(np.minimum(a, 255), "u1").put(over, "u8")

    def put_bytes(self, a, width: int) -> Packed:
        """The low bytes of each number, so many."""
        import numpy as np

        self.parts.append(np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].tobytes())
        return self

    def put_twelve(self, a) -> Packed:
        """Numbers below 4096, two in three bytes."""
        import numpy as np

        x = np.concatenate([a, np.zeros(len(a) % 2, a.dtype)]).astype(np.uint32)
        return self.put_bytes(x[::2] | x[1::2] << np.uint32(12), 3)

    def bytes(self) -> bytes:
        return b"".join(self.parts)

    def take(self, kind: str, n: int):
        import numpy as np

        out = np.frombuffer(self.raw, f"<{kind}", n, self.at)
        self.at += out.nbytes
        return out

    def take_small(self, n: int):
        import numpy as np

        over, out = int(self.take("u4", 1)[0]), self.take("u1", n).astype(np.int64)
        if over:
            large = self.take("u8", over).astype(np.int64)
            out[np.flatnonzero(out == 255)] = large
        return out

    def take_bytes(self, n: int, width: int):
        import numpy as np

        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = self.take("u1", width * n).reshape(n, width)
        return wide.view("<u8").ravel()

    def take_twelve(self, n: int):
        import numpy as np

        both = self.take_bytes(-(-n // 2), 3)
        return np.stack([both & np.uint64(4095), both >> np.uint64(12)], 1).ravel()[:n].astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n_train, n_all) of docs (text_, held_out), the end a word of its own."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def made(parts, flags):
            tokens = np.concatenate(parts)
            train = np.repeat(flags, list(map(len, parts)))
            word, inverse, n = np.unique(tokens, return_inverse=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bincount(inverse, train, len(word)).astype(np.int64)), pa.array(n)], names=["word", "n_train", "n_all"])

        parts, flags, size = [], [], 0
        for batch in batches:
            for raw, out in zip(batch.column(0), batch.column(1), strict=True):
                raw = raw.as_py()
                parts.append(token_hashes(raw))
                flags.append(0.0 if out.as_py() else 1.0)
                size += len(raw) + 50
                if size > 2 * CHUNK_BYTES:
                    yield made(parts, flags)
                    parts, flags, size = [], [], 0
        if parts:
            yield made(parts, flags)

    rows = docs.select(F.col("text_").cast("binary"), "held_out").mapInArrow(run, "word long, n_train long, n_all long")
    return rows.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


@dataclass
class Sizes:
    """What every task knows of a model: counts of the training tokens, and the words that are dealt over all shards."""

    shards: int
    total: int
    types: int
    mass: float
    #: Sorted hashes and training counts. Fewer than 2 * shards words have so large a share, so this can be sent to tasks.
    large: tuple = ()

    @classmethod
    def of(cls, counts: DataFrame, mass: float, shards: int | None = None) -> Sizes:
        import numpy as np

        total, types, everything = counts.agg(F.sum("n_train"), F.count_if(F.col("n_train") > 0), F.sum("n_all")).first()
        everything = everything or 0
        shards = shards or max(partitions(counts.sparkSession), min(MAX_SHARDS, -(-everything // SHARD_TOKENS)))
        rows = counts.where(F.col("n_all") * 2 * shards > everything).select("word", "n_train").toArrow()
        word, n = rows["word"].to_numpy().astype(np.int64).view(np.uint64), rows["n_train"].to_numpy().astype(np.int64)
        order = np.argsort(word)
        return cls(shards, total or 0, types or 0, mass, (word[order], n[order]))

    def shard(self, word, context):
        """The shard of each pair: that of its word, or, for words with a large share, one by word and context."""
        import numpy as np

        names = self.large[0]
        at = np.searchsorted(names, word)
        hot = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == word) if len(names) else np.zeros(0, np.int64)
        mixed = word.copy()
        mixed[hot] = (mixed[hot] ^ context[hot]) * np.uint64(0x9E3779B97F4A7C15)
        mixed[hot] ^= mixed[hot] >> np.uint64(29)
        return (mixed % np.uint64(self.shards)).astype(np.int64)


ROW = "kind int, shard int, chunk long, data binary, nth int, held_out boolean, n_tokens long"
#: Kinds of rows. A chunk's distinct pairs that a shard is asked for, and later its answer; a document; a chunk's lists of
#: documents by pair; a shard's trie.
ASKED, DOCUMENT, LISTS, TRIE = range(4)


def _rows(kind: int, shard: list, chunk: list, data: list, **more):
    import pyarrow as pa

    n = len(shard)
    nothing = {"key_": pa.nulls(n), "nth": [None] * n, "held_out": [None] * n, "n_tokens": [None] * n} | more
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.int32()), pa.array(shard, pa.int32()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary()), pa.array(nothing["nth"], pa.int32()), pa.array(nothing["held_out"], pa.bool_()), pa.array(nothing["n_tokens"], pa.int64()), nothing["key_"]],
        names=[*(f.split()[0] for f in ROW.split(", ")), "key_"],
    )


def _packed(docs: DataFrame, key: str, sizes: Sizes, lists: bool = True) -> DataFrame:
    """Rows of kind ASKED, and with lists DOCUMENT and LISTS, of docs (key, text_, held_out), chunk by chunk."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shards, bits = sizes.shards, np.uint64(CONTEXT_BITS)
        chunk = TaskContext.get().partitionId() << 24

        def made(parts, keys, out):
            n_tokens = np.array(list(map(len, parts)))
            word = np.concatenate(parts)
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[np.r_[0, np.cumsum(n_tokens)[:-1]]] = np.uint64(special(1))
            context >>= np.uint64(64 - CONTEXT_BITS)
            doc = np.repeat(np.arange(len(parts)), n_tokens)
            train = np.repeat(~np.array(out), n_tokens).astype(np.int64)
            name, pair = np.unique(word, return_inverse=True)
            pair = pair.astype(np.uint64) << bits | context
            del word, context
            order = np.argsort(pair)
            pair = pair[order]
            starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            pair, n = pair[starts], np.diff(np.r_[starts, len(pair)])
            trained = np.add.reduceat(train[order], starts)
            named, context = (pair >> bits).astype(np.int64), pair & np.uint64((1 << CONTEXT_BITS) - 1)
            shard = sizes.shard(name[named], context)
            by = np.argsort(shard, kind="stable")
            cuts = np.searchsorted(shard[by], np.arange(shards + 1))
            asked: tuple[list, ...] = ([], [])
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                x = by[cuts[s] : cuts[s + 1]]
                new = np.flatnonzero(np.r_[True, named[x][1:] != named[x][:-1]])
                blob = Packed().put([len(new), len(x)], "u4").put(name[named[x[new]]], "u8").put_small(np.diff(np.r_[new, len(x)])).put_bytes(context[x], CONTEXT_BITS // 8).put_small(trained[x])
                asked[0].append(s)
                asked[1].append(blob.bytes())
            yield _rows(ASKED, asked[0], [chunk] * len(asked[0]), asked[1], key_=pa.nulls(len(asked[0]), keys.type))
            if not lists:
                return
            n = n[by]
            token = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[by], n)
            blob = Packed().put([len(n), len(order)], "u4").put_small(n).put_twelve(doc[order[token]])
            yield _rows(LISTS, [chunk % shards], [chunk], [blob.bytes()], key_=pa.nulls(1, keys.type))
            yield _rows(DOCUMENT, [(chunk + i) % shards for i in range(len(parts))], [chunk] * len(parts), [None] * len(parts), nth=list(range(len(parts))), key_=keys, held_out=out, n_tokens=n_tokens)

        parts, kept, out, size = [], [], [], 0
        for batch in batches:
            start = 0
            for row, (raw, held) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                raw = raw.as_py()
                parts.append(token_hashes(raw))
                out.append(held.as_py())
                size += len(raw) + 50
                if size > CHUNK_BYTES or len(parts) == CHUNK_DOCS:
                    yield from made(parts, pa.concat_arrays([*kept, batch.column(0).slice(start, row + 1 - start)]), out)
                    parts, kept, out, size, start, chunk = [], [], [], 0, row + 1, chunk + 1
            kept.append(batch.column(0).slice(start))
        if parts:
            yield from made(parts, pa.concat_arrays(kept), out)

    return docs.select(key, F.col("text_").cast("binary"), "held_out").mapInArrow(run, f"{ROW}, key_ {kind}")


def _answered(packed: DataFrame, sizes: Sizes, only_tries: bool = False) -> DataFrame:
    """Each shard answers for the pairs that it is asked for; DOCUMENT and LISTS pass. only_tries: the shards' tries instead.

    A shard's trie is the one among its rows, or, where there is none, made from the training counts of the pairs asked for.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bits, width = np.uint64(CONTEXT_BITS), CONTEXT_BITS // 8
        asked: dict[int, list] = {}
        tries: dict[int, bytes] = {}
        kind = pa.null()
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)
            kind = batch["key_"].type
            passes = pc.or_(pc.equal(batch["kind"], DOCUMENT), pc.equal(batch["kind"], LISTS))
            if (passed := batch.filter(passes)).num_rows:
                yield passed
            own = batch.filter(pc.invert(passes))
            for k, s, c, raw in zip(*(own[x].to_pylist() for x in ("kind", "shard", "chunk", "data")), strict=True):
                if k == TRIE:
                    tries[s] = raw
                    asked.setdefault(s, [])
                else:
                    asked.setdefault(s, []).append((c, raw))

        def answers(s: int, blobs: list) -> Iterator:
            blobs.sort(key=lambda b: b[0])
            chunks, read = [c for c, _ in blobs], []
            for _, raw in blobs:
                p = Packed(raw)
                n, m = p.take("u4", 2).tolist()
                read.append((p.take("u8", n), p.take_small(n), p.take_bytes(m, width), p.take_small(m)))
            del blobs[:]
            if s in tries and not read:
                return
            # all distinct pairs of the shard, and how often training texts have them: one sort serves training and lookups
            large, n_large = sizes.large
            name = np.unique(np.concatenate([large, *(r[0] for r in read)]))
            places = [np.searchsorted(name, r[0]) for r in read]
            keys = [np.repeat(p, r[1]).astype(np.uint64) << bits | r[2] for p, r in zip(places, read, strict=True)] or [np.zeros(0, np.uint64)]
            trained = np.concatenate([r[3] for r in read] or [np.zeros(0, np.int64)])
            runs = [r[1] for r in read]
            del read
            pair, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            pair_word, context = (pair >> bits).astype(np.int64), pair & np.uint64((1 << CONTEXT_BITS) - 1)
            if s in tries:
                trie = Trie.mapped(tries.pop(s))
            else:
                pair_count = np.zeros(len(pair), np.int64)
                np.add.at(pair_count, inverse, trained)
                count = np.zeros(len(name), np.int64)
                np.add.at(count, pair_word, pair_count)
                count[np.searchsorted(name, large)] = n_large
                seen, had = np.flatnonzero(count > 0), np.flatnonzero(pair_count > 0)
                raw = Trie.build(name[seen], count[seen], (np.cumsum(count > 0) - 1)[pair_word[had]], context[had], pair_count[had], sizes.total, sizes.types, sizes.mass)
                if only_tries:
                    yield _rows(TRIE, [s], [None], [raw], key_=pa.nulls(1, kind))
                    return
                trie = Trie.mapped(raw)
                del raw, pair_count, seen, had
            del trained
            # each distinct pair is looked up once, in the order of the trie
            code, count = np.zeros(len(pair), np.uint16), np.zeros(len(name), np.uint64)
            for i in range(0, len(pair), SLICE):
                of = slice(i, i + SLICE)
                own, top = trie.lookup(name[pair_word[of]], context[of], sizes.total, sizes.types, sizes.mass)
                code[of], count[pair_word[of]] = encode(top), own
            at = 0
            for c, place, run_ in zip(chunks, places, runs, strict=True):
                m = int(run_.sum())
                own = count[place]
                size = next(w for w in (1, 2, 4, 8) if w == 8 or own.max() < np.uint64(1 << 8 * w))
                blob = Packed().put([len(place), m, size], "u4").put(own, f"u{size}").put_small(run_).put(code[inverse[at : at + m]], "u2")
                at += m
                yield _rows(ASKED, [s], [c], [blob.bytes()], key_=pa.nulls(1, kind))

        for s in sorted(asked):
            yield from answers(s, asked[s])

    return packed.repartitionById(sizes.shards, F.col("shard")).mapInArrow(run, f"{ROW}, key_ {dict(packed.dtypes)['key_']}")


def _summed(answered: DataFrame, key: str, sizes: Sizes) -> DataFrame:
    """Each document's sums over its tokens, chunk by chunk."""
    fields = f"{key} {dict(answered.dtypes)['key_']}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def made(rows):
            rows = pa.Table.from_batches(rows)
            docs = rows.filter(pc.equal(rows["kind"], DOCUMENT)).sort_by("nth").combine_chunks()
            n = docs.num_rows
            p = Packed(rows.filter(pc.equal(rows["kind"], LISTS))["data"][0].as_py())
            pairs, tokens = p.take("u4", 2).tolist()
            times = p.take_small(pairs)
            doc, start, at = p.take_twelve(tokens), 0, 0
            known, base, top = np.zeros(n), np.zeros(n), np.zeros(n)
            for raw in rows.filter(pc.equal(rows["kind"], ASKED)).sort_by("shard")["data"].to_pylist():
                p = Packed(raw)
                words, m, size = p.take("u4", 3).tolist()
                count = p.take(f"u{size}", words).astype(np.float64)
                run_ = p.take_small(words)
                each = times[at : at + m]
                at += m
                own = doc[start : start + int(each.sum())]
                start += len(own)
                of_token = np.repeat(np.repeat(count, run_), each)
                known += np.bincount(own, of_token > 0, n)
                base += np.bincount(own, np.log10(of_token + 1), n)
                # each token's denominator is that of the token after it; the end's, a text's each, stands for the beginning's
                top += np.bincount(own, np.repeat(value(p.take("u2", m)), each) - np.log10(of_token + sizes.mass), n)
            n_tokens = docs["n_tokens"].to_numpy()
            base -= n_tokens * np.log10(sizes.total + sizes.types + 1)
            columns = [docs["key_"], docs["held_out"], docs["n_tokens"], pa.array(known.astype(np.int64)), pa.array(np.full(n, sizes.total, np.int64)), pa.array(base), pa.array(top)]
            yield from pa.table(columns, names=[x.split()[0] for x in fields.split(", ")]).to_batches()

        held: list = []
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names)
            chunk = batch["chunk"].to_numpy()
            cuts = [0, *(np.flatnonzero(chunk[1:] != chunk[:-1]) + 1).tolist(), len(chunk)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1]["chunk"][0].as_py() != chunk[a]:
                    yield from made(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from made(held)

    return answered.repartition(partitions(answered.sparkSession), "chunk").sortWithinPartitions("chunk").mapInArrow(run, fields)


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    held = F.coalesce("held_out", F.lit(False)) if "held_out" in docs.columns else F.lit(False)
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text_"), held.alias("held_out"))


def fit_score(docs: DataFrame, key: str = "doc_id", text: str = "text", mass: float = MASS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of docs, which has a boolean held_out.

    The model learns from the rows that are not held out; one exchange of the pairs of each chunk trains the shards and
    asks them. Null texts are empty: one token, the end. Repeated rows are scored each. Other columns are not carried.
    Without training rows all words are unknown. No rows give none.
    """
    read = _read(docs, key, text)
    sizes = Sizes.of(materialize(word_counts(read), "word-counts"), mass)
    return _summed(_answered(_packed(read, key, sizes), sizes), key, sizes)


def fit(docs: DataFrame, path: str, text: str = "text", mass: float = MASS) -> Model:
    """The model of all rows of docs, kept as tables in a new folder that all executors can read."""
    read = docs.select(F.lit(0).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_"), F.lit(False).alias("held_out"))
    word_counts(read).write.parquet(f"{path}/words")
    sizes = Sizes.of(docs.sparkSession.read.parquet(f"{path}/words"), mass)
    tries = _answered(_packed(read, "key_", sizes, lists=False), sizes, only_tries=True)
    tries.select("kind", "shard", F.col("data").alias("trie"), F.lit(sizes.shards).alias("shards"), F.lit(mass).alias("mass")).write.parquet(f"{path}/tries")
    return Model(docs.sparkSession, path)


class Model:
    """A model that fit has kept. Its shards are co-located with what they are asked for, and mapped where they are used."""

    def __init__(self, spark: SparkSession, path: str):
        self.tries = spark.read.parquet(f"{path}/tries")
        shards, mass = self.tries.agg(F.max("shards"), F.max("mass")).first()
        self.sizes = Sizes.of(spark.read.parquet(f"{path}/words"), mass if shards else MASS, shards or 1)

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """As fit_score, of any docs; held_out is false where docs has no such column."""
        packed = _packed(_read(docs, key, text), key, self.sizes)
        others = {c: F.lit(None).cast(t) for c, t in packed.dtypes}
        tries = self.tries.select(*((F.col("trie") if c == "data" else F.col(c) if c in ("kind", "shard") else v).alias(c) for c, v in others.items()))
        return _summed(_answered(packed.unionByName(tries), self.sizes), key, self.sizes)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_score(table(spark, sf_dir, "documents").select("doc_id", "text", held_out("doc_id", 7, 2).alias("held_out")))
