"""Best-fit packing of tokenized documents into sequences, by matching of large items.

Sizes are whole numbers up to the capacity, so the packing is planned on their histogram (capacity rows at most, at any
input size): large items, above a third of the capacity, are matched greedily, two a bin at most, the larger first and
each with the largest partner that fits; small items then go, larger first, to the tightest gap that holds them. The plan
says which ranks of a size go to which range of bins. Ranks within a size come from salted groups and the sums before
them, so a size that a third of all rows share is dealt over many tasks. Only narrow rows are shuffled, never ids.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.llm.common import materialize, numbered, partitions, table, text_or_empty

CAPACITY = 2048
#: Items of a size that stand in one salted group, about.
SALTED = 1_000_000
END = b"\0\0\0\0"


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """text -> its ids as little-endian unsigned 32-bit bytes; the ids are those of tokenizers with the same file.

    The vocabulary is read from the file; merging is done by tiktoken, which takes a third of the time for the same ids, and
    only where the file's merges come in the order of their ids. Words that the file adds to the vocabulary are taken whole
    where they stand in a text, as tokenizers does. Texts with very long runs of white space, on which its pattern runs out
    of stack, go to tokenizers itself.
    """

    def __init__(self, path: str):
        import json
        import re

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        added, byte, words = made.get("added_tokens") or [], byte_of(), made["model"]["vocab"]
        special = {x["content"]: x["id"] for x in added}
        merged = [words["".join(m.split(" ") if isinstance(m, str) else m)] for m in made["model"]["merges"]]
        plain = not any(x.get(flag) for x in added for flag in ("single_word", "lstrip", "rstrip", "normalized"))
        self.path, self.long_run, self.merge, self.whole = path, re.compile(r"\s{1000}").search, None, None
        if plain and merged == sorted(merged):
            ranks = {bytes(byte[c] for c in word): i for word, i in words.items() if word not in special}
            made_of = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
            self.merge = lambda text: made_of.encode(text, allowed_special="all", disallowed_special=())

    def ids(self, text: str) -> bytes:
        return array("I", self.merge(text) if self.merge and not self.long_run(text) else self.plain(text)).tobytes()

    def plain(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole capacities, but for the first piece, which takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(i, capacity) for i in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]): the documents' ids, the end id 0 after each, cut where they exceed the capacity.

    ids are little-endian unsigned 32-bit bytes. A null text is an empty one: its only id is the end.
    """
    import pyarrow as pa

    plain, name = numbered(docs)
    fields = f"key_ {dict(docs.dtypes)[key]}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        encode = encoder(tokenizer).ids
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            texts = batch.column(1)
            for row in range(batch.num_rows):
                ids = memoryview(encode(texts[row].as_py()) + END)
                for piece, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for out, x in zip(rows, (row, piece, start, length, zlib.crc32(own), bytes(own) if with_ids else None), strict=True):
                        out.append(x)
            columns = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
            names = ["key_", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(rows[5], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return plain.select(plain[name[key]].alias("key_"), text_or_empty(name[text]).alias("text_")).mapInArrow(run, fields).withColumnRenamed("key_", key)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, rank after the last, first bin, items a bin, fill before): where the items of a size go, by rank.

    counts: items of each size. The result has rows for ranges, not for items.
    """
    left, taken = dict(counts), defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: ranges of bins (first, how many)
    found: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def place(size: int, first: int, n_bins: int, each: int, fill: int) -> None:
        found.append((size, taken[size], taken[size] + n_bins * each, first, each, fill))
        taken[size] += n_bins * each
        left[size] -= n_bins * each

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for s in large:
        while left[s]:
            t = next((t for t in large if t <= min(s, capacity - s) and left[t] > (t == s)), None)
            n = left[s] if t is None else left[s] // 2 if t == s else min(left[s], left[t])
            place(s, bins, n, 1, 0)
            if t is not None:
                place(t, bins, n, 1, s)
            gaps[capacity - s - (t or 0)].append((bins, n))
            bins += n
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        for gap in range(s, capacity + 1):
            if gap == capacity and left[s]:  # nothing open holds it: new bins
                n = -(-left[s] // (capacity // s))
                gaps[gap].append((bins, n))
                bins += n
            while left[s] and gaps.get(gap):
                first, n = gaps[gap].pop()
                each = gap // s
                full = min(n, left[s] // each)
                if full:
                    place(s, first, full, each, capacity - gap)
                    gaps[gap - each * s].append((first, full))
                if full < n:
                    first, n, rest = first + full, n - full, left[s]
                    if rest and rest < each:
                        place(s, first, 1, rest, capacity - gap)
                        gaps[gap - rest * s].append((first, 1))
                        first, n = first + 1, n - 1
                    if n:
                        gaps[gap].append((first, n))
            if not left[s]:
                break
    return found


def pack(items: DataFrame, size: str = "length", order: list[str] | None = None, capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset: every row gets a place, no sequence exceeds the capacity, offsets leave no gaps.

    items must be a table that reads alike each time (materialize it); sizes are from 1 to capacity, else this raises.
    order: columns that order the items of a size; rows equal in all of them are told apart in any way. No rows give none.
    Columns of items named sequence_id or offset give way.
    """
    spark = items.sparkSession
    plain, name = numbered(items)
    by, order = name[size], [name[c] for c in order or ["doc_id", "piece"]]
    counts = {r[0]: r[1] for r in plain.groupBy(by).count().collect()}  # a row for each size, capacity rows at most
    if any(s is None or not 1 <= s <= capacity for s in counts):
        raise ValueError(f"sizes must be from 1 to {capacity}")
    places = spark.createDataFrame(plan(counts, capacity), "p_size long, p_from long, p_to long, p_bin long, p_each long, p_fill long")
    salts = max(64, partitions(spark), max(counts.values(), default=0) // SALTED)
    salted = plain.withColumn("salt_", F.pmod(F.xxhash64(*order), F.lit(salts)))
    groups = salted.groupBy(F.col(by).alias("g_size"), F.col("salt_").alias("g_salt")).count()
    before = groups.withColumn("before_", F.sum("count").over(W.partitionBy("g_size").orderBy("g_salt")) - F.col("count")).drop("count")
    local = salted.withColumn("row_", F.row_number().over(W.partitionBy(by, "salt_").orderBy(*order)) - 1)
    ranked = local.join(before, (F.col(by) == F.col("g_size")) & (F.col("salt_") == F.col("g_salt"))).withColumn("rank_", F.col("row_") + F.col("before_"))
    placed = ranked.join(F.broadcast(places), (F.col(by) == F.col("p_size")) & (F.col("rank_") >= F.col("p_from")) & (F.col("rank_") < F.col("p_to")))
    nth = F.col("rank_") - F.col("p_from")
    sequence, offset = F.col("p_bin") + F.floor(nth / F.col("p_each")), F.col("p_fill") + nth % F.col("p_each") * F.col("p_size")
    own = [F.col(new).alias(old) for old, new in name.items() if old.lower() not in ("sequence_id", "offset")]
    return placed.select(*own, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs with their places: (key, piece, start, length, ids_crc32, sequence_id, offset).

    Other columns of docs are not carried. Repeated rows are packed each for itself. An empty table gives an empty one.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    found = materialize(pieces(docs, str(tokenizer), key, text, capacity), "pieces")
    return pack(found, "length", [key, "piece", "ids_crc32"], capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
