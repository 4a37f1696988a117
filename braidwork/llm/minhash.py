"""Document fingerprints by one-permutation MinHash.

Each shingle of five words is hashed once; the upper bits name a bin, the rest is its value there, and a bin keeps its least
value. An empty bin copies the bin that a fixed sequence of hashes of its own number finds first among the filled ones
(optimal densification). A fingerprint packs the low bits of the bins' values; the share of equal bins, corrected for bins
that agree by chance, estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import partitions, table

SHINGLE, BINS, BITS = 5, 512, 4
#: Documents fingerprinted together; characters above which words are taken one at a time.
BLOCK, LONG = 256, 1 << 20


def _mix(x):
    """A fixed bijection of 64-bit words with well spread bits."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str):
    import re

    import numpy as np
    import xxhash

    raw = text.encode()
    words = raw.split() if len(raw) <= LONG else (m[0] for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64)


def shingle_hashes(h, shingle: int = SHINGLE):
    """One hash for each run of so many words; all words of a shorter text are one shingle, no words none."""
    import numpy as np

    n = min(shingle, len(h))
    if not n:
        return h
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def sketches(texts: list[str], shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS):
    """(texts x bins array of low bits, which texts have a shingle). bins: a power of two."""
    return low_bits([shingle_hashes(word_hashes(text), shingle) for text in texts], bins, bits)


def low_bits(sets: list, bins: int = BINS, bits: int = BITS):
    """As sketches, of arrays of shingle hashes."""
    import numpy as np

    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    least = np.full((len(sets), bins), none)
    shift = np.uint64(64 - (bins.bit_length() - 1))
    for row, s in zip(least, sets, strict=True):
        np.minimum.at(row, (s >> shift).astype(np.int64), s & ((np.uint64(1) << shift) - np.uint64(1)))
    filled = least != none
    some = filled.any(1)
    doc, bin_ = np.nonzero(~filled & some[:, None])
    attempt = 0
    while len(doc):
        attempt += 1
        at = (_mix(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) >> shift).astype(np.int64)
        found = filled[doc, at]
        least[doc[found], bin_[found]] = least[doc[found], at[found]]
        doc, bin_ = doc[~found], bin_[~found]
    low = (least & np.uint64((1 << bits) - 1)).astype(np.uint8)
    low[~some] = 0
    return low, some


def likeness(a, b, some_a, some_b, bits: int = BITS):
    """Estimated Jaccard similarity of sketches, row by row, 0 to 1. Without shingles: 1 to another such text, else 0."""
    import numpy as np

    chance = 2.0**-bits
    found = np.clip(((a == b).mean(1) - chance) / (1 - chance), 0.0, 1.0)
    return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def packed(sketch) -> list[str]:
    """Hex strings of sketches of 4 bits a bin, a digit for each bin."""
    import numpy as np

    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    return [row.tobytes().decode() for row in digits[sketch]]


def unpacked(text: str):
    import numpy as np

    return np.array([int(c, 16) for c in text], np.uint8)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, fingerprint): each whole text's; equal texts have equal ones. Null is the empty text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                texts = [x or "" for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(packed(sketches(texts)[0]))], names=[key, "n_chars", "fingerprint"])

    return docs.select(key, F.col(text).alias("text_")).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, n_chars long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many characters (or all) of the following text's start."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, guest, key, text): docs dealt over partitions by ranges of descending keys, and sorted there.

    Ties go by text, null keys come last. Each bucket's first document also stands, as a guest, at the end of the bucket
    before it (the first bucket's at the end of the last), so every document's successor is in its own partition. Bounds
    are approximate quantiles of the keys; only their number and the buckets' first keys reach the driver.
    """
    import numpy as np

    spark = docs.sparkSession
    n = max(1, partitions(spark))
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = plain.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    bounds = np.unique(np.array(bounds if bounds is not None else [], np.int64))

    @F.pandas_udf("int")
    def bucket(keys):
        import pandas as pd

        known = keys.notna().to_numpy()
        at = np.searchsorted(bounds, keys.fillna(0).to_numpy().astype(np.int64), side="right")
        return pd.Series(np.where(known, len(bounds) - at, len(bounds)).astype(np.int32))

    dealt = plain.withColumn("bucket", bucket(F.col("key").cast("long"))).withColumn("guest", F.lit(0))
    heads = sorted((r[0], r[1]) for r in plain.select("key", bucket(F.col("key").cast("long")).alias("bucket")).groupBy("bucket").agg(F.max("key")).collect())
    hosts = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    names = spark.createDataFrame(hosts, f"head {dict(docs.dtypes)[key]}, host int")
    guests = plain.join(F.broadcast(names), F.col("key").eqNullSafe(F.col("head"))).select("key", "text", F.col("host").alias("bucket"), F.lit(1).alias("guest"))
    return dealt.unionByName(guests).repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.col("key").desc_nulls_last(), "text").select("bucket", "guest", "key", "text")


def with_successors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row a document.

    The next document is the one after it by descending key; after the last comes the first; a document alone is its own
    next one. Ties go by text, null keys last. Null texts are empty. Other columns are not carried. No rows give none.
    """
    fields = f"{key} {dict(docs.dtypes)[key]}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = None

        def made(keys: list, texts: list[str]) -> pa.RecordBatch:
            """texts: those of keys, and the one after them."""
            changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            own, some = sketches(texts)
            new, some_new = sketches(changed)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, kind),
                    pa.array([len(t) for t in texts[:-1]], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(packed(own[:-1])),
                    pa.array(packed(new)),
                    pa.array(likeness(own[:-1], new, some[:-1], some_new)),
                    pa.array(likeness(own[:-1], own[1:], some[:-1], some[1:])),
                ],
                names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        keys, texts, bucket, done = [], [], None, False
        for batch in batches:
            kind = batch.column(2).type
            for row in range(batch.num_rows):
                b, guest = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if b != bucket:
                    keys, texts, bucket, done = [], [], b, False
                if done:
                    continue  # further rows with the guest's key
                texts.append(batch.column(3)[row].as_py())
                if guest or len(keys) == BLOCK:
                    yield made(keys, texts)
                    keys, texts, done = [], texts[-1:], bool(guest)
                if not guest:
                    keys.append(batch.column(2)[row].as_py())

    return in_order(docs, key, text).mapInArrow(run, fields)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_successors(table(spark, sf_dir, "documents"))
