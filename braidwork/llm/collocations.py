"""Phrase collocation mining by suffix counting.

Each word begins a suffix of its piece, cut after max_n words; each phrase is a prefix of suffixes. Suffixes are counted
where they are read, dealt by language and first word in ranges, so that a task holds neighbours, and sorted in reverse
order: then all rows that begin with a phrase stand in a row, and one stack of the open prefixes counts them all in one
pass. A first word, or a pair, that fills more than a task's share runs on over several ranges: the counts of the few
prefixes that a range's edge divides are added up afterwards. The ranges come from a sample, and decide places only, never
counts. Then phrases meet the counts of their parts.

A row's key is one binary value: language, then words, each closed from the next by a zero byte. Zero bytes in texts are
written otherwise (escape), so that no byte of a word sorts between a phrase and what follows it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.llm.common import materialize, partitions, table, text_or_empty

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

MAX_N, MIN_COUNT, TOP = 4, 30, 2000
#: A candidate falls to a longer one that holds it with so many hundredths of its count.
INSIDE = 80
SCALE = 2_000_000
#: Distinct suffixes that a task counts before it hands them on.
COUNTED = 400_000
#: Languages that a task counts beside each other before it hands on what it has.
LANGUAGES = 100
#: Sampled suffixes a range, about.
PER_RANGE = 64
#: Parts are joined over so many salts: a word that many phrases begin or end with is dealt over as many tasks.
SALTS = 16
END = b"\0"
PIECE_ENDS = re.compile(rb"[.,;:!?\n-\r]+").split


def escape(data: bytes) -> bytes:
    return data.replace(b"\1", b"\1\3").replace(b"\0", b"\1\2") if b"\0" in data or b"\1" in data else data


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\1\2"), F.lit("\0")), F.lit("\1\3"), F.lit("\1"))


def suffixes(text: bytes, max_n: int = MAX_N) -> list[bytes]:
    """The suffixes of a text's pieces, cut after max_n words. A-Z are taken in lower case; other letters as they are."""
    out: list[bytes] = []
    join = END.join
    for piece in PIECE_ENDS(escape(text.lower())):
        words = piece.split()  # a piece holds no white space but space and tab
        if len(words) >= max_n:
            out += map(join, zip(words, *[words[i:] for i in range(1, max_n)], strict=False))
            words = words[len(words) - max_n + 1 :]
        out += [join(words[i:]) for i in range(len(words))]
    return out


class OpenPrefixes:
    """Counts the prefixes of keys that come in reverse order, with one stack of those that may still go on.

    The stack is kept from batch to batch; within a batch, a level of it is a column of numbers: a prefix of so many words is
    closed where a key shares fewer with the one before. Results are (prefix, words in it, count); the prefix of 0 words is the
    language. Prefixes of fewer than least are left out, unless they are on the path of the first or the last key: these may go on
    in a neighbouring range.
    """

    def __init__(self, least: int):
        self.least = least
        self.key: bytes | None = None  # the last key, whose prefixes are open
        self.counts: list[int] = []  # of these, by their number of parts less one
        self.edge: list[bool] = []  # whether they are the first key's too

    def add(self, keys: pa.BinaryArray, n: np.ndarray) -> list[tuple[bytes, int, int]]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not len(keys):
            return []
        if self.key is None:
            self.key = keys[0].as_py()
            depth = self.key.count(END) + 1
            self.counts, self.edge = [0] * depth, [True] * depth
        keys = pa.concat_arrays([pa.array([self.key], pa.binary()), keys])
        n = np.concatenate([[0], n])
        split = pc.split_pattern(keys, pattern=END)
        ends = split.offsets.to_numpy()
        sizes, codes = np.diff(ends), split.flatten().dictionary_encode().indices.to_numpy()
        depth = int(sizes.max())
        table = np.full((len(keys), depth), -1, np.int32)
        table[np.repeat(np.arange(len(keys)), sizes), np.arange(len(codes)) - np.repeat(ends[:-1] - ends[0], sizes)] = codes
        same = (table[1:] == table[:-1]) & (table[1:] >= 0)
        common = np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)])  # parts shared with the key before
        found, counts, edge = [], [], []
        for level in range(depth):
            starts = np.flatnonzero(common <= level)
            weights = n.copy()
            weights[0] = self.counts[level] if level < len(self.counts) else 0
            sums = np.add.reduceat(weights, starts)
            real = sizes[starts] > level
            shown = real & (sums >= self.least)
            shown[0] |= real[0] and self.edge[level]
            if real[-1]:
                shown[-1] = False  # still open
                counts.append(int(sums[-1]))
                edge.append(len(starts) == 1 and self.edge[level])
            for at in np.flatnonzero(shown):
                parts = keys[int(starts[at])].as_py().split(END)[: level + 1]
                found.append((END.join(parts), level, int(sums[at])))
        self.key, self.counts, self.edge = keys[len(keys) - 1].as_py(), counts, edge
        return found

    def close(self) -> list[tuple[bytes, int, int]]:
        parts = self.key.split(END) if self.key is not None else []
        return [(END.join(parts[: level + 1]), level, n) for level, n in enumerate(self.counts)]


def counted(docs: DataFrame, bounds: list[bytes], lang: str, text: str, max_n: int) -> DataFrame:
    """(range_, key, n): the suffixes of docs, counted in each task over COUNTED distinct ones at a time, and the range of each."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        found: dict[bytes, Counter] = {}

        def hand_on() -> Iterator[pa.RecordBatch]:
            for language, own in sorted(found.items()):
                head = language + END
                words = sorted(own)
                inner = [b[len(head) :] for b in bounds if b.startswith(head)]  # bounds of this language, without its name
                first = bisect_left(bounds, head)
                cuts = [0, *(bisect_left(words, b) for b in inner), len(words)]
                ranges = np.repeat(np.arange(first, first + len(inner) + 1, dtype=np.int32), np.diff(cuts))
                for i in range(0, len(words), 50_000):
                    some = words[i : i + 50_000]
                    keys = pc.binary_join_element_wise(pa.scalar(language, pa.binary()), pa.array(some, pa.binary()), pa.scalar(END, pa.binary()))
                    yield pa.RecordBatch.from_pydict({"range_": pa.array(ranges[i : i + 50_000]), "key": keys, "n": pa.array(map(own.__getitem__, some), pa.int64())})
            found.clear()

        for batch in batches:
            for language, whole in zip(batch.column(0), batch.column(1), strict=True):
                name = escape(language.as_py())
                found.setdefault(name, Counter()).update(suffixes(whole.as_py(), max_n))
                if len(found[name]) >= COUNTED or len(found) > LANGUAGES:
                    yield from hand_on()
        yield from hand_on()

    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang_"), text_or_empty(text).cast("binary").alias("text_"))
    return read.mapInArrow(run, "range_ int, key binary, n long")


def range_bounds(docs: DataFrame, lang: str, text: str, max_n: int, ranges: int) -> list[bytes]:
    """At most ranges - 1 keys that divide the suffixes about evenly, from a sample of documents. Where they lie changes no count."""
    size = docs.select(F.sum(F.length(F.col(text).cast("binary")))).first()[0] or 0
    share = min(1.0, PER_RANGE * ranges * 60 / max(size, 1))  # some words of a document are enough: about 6 bytes each
    sample = counted(docs.sample(share, seed=1) if share < 1 else docs, [], lang, text, max_n)
    sample = sample.sample(min(1.0, PER_RANGE * ranges / max(size * share / 6, 1)), seed=2)
    least = sample.repartitionByRange(ranges, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    return sorted(bytes(r.key) for r in least.collect())[1:]  # a key a range


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", max_n: int = MAX_N, min_count: int = MIN_COUNT, ranges: int | None = None) -> DataFrame:
    """(key binary, words int, f long) of each phrase of up to max_n words found min_count times or more; of 0 words, a language's n."""
    import pyarrow as pa

    ranges = ranges or partitions(docs.sparkSession)
    bounds = range_bounds(docs, lang, text, max_n, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        stack = OpenPrefixes(min_count)

        def packed(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
            key, words, f = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_pydict({"key": pa.array(key, pa.binary()), "words": pa.array(words, pa.int32()), "f": pa.array(f, pa.int64())})

        for batch in batches:
            yield packed(stack.add(batch.column(0), batch.column(1).to_numpy()))
        yield packed(stack.close())

    dealt = counted(docs, bounds, lang, text, max_n).repartitionById(len(bounds) + 1, "range_").select("key", "n")
    parts = dealt.sortWithinPartitions(F.col("key").desc()).mapInArrow(run, "key binary, words int, f long")
    return parts.groupBy("key", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_n words, by their weakest cut.

    score is floor(2000000 * a / (l + r)) at the cut where it is least, ties to the shortest first part; phrases that a longer
    one holds with 80 % of their count are left out. A null language is und, a null or empty text has no words. Ties in score
    and count go by the phrase's bytes. Repeated rows count each. Very long texts and pieces are read whole. Only lang and
    text of docs are read, so other columns may have any names. No rows give none.
    """
    known = materialize(phrase_counts(docs, lang, text, max_n, min_count), "phrases")
    parts = F.split(F.col("key").cast("string"), "\\x00")
    phrases = known.where("words > 0").select(parts[0].alias("lang"), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), "\0").alias("phrase"), "words", "f")
    candidates = phrases.where("words > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", "\\x00")
    joined = lambda first, length: F.array_join(F.slice(words, first, length), "\0")

    # The two parts of each cut, as rows that look up their counts; a part is as frequent as its phrase, so it is known.
    salted = phrases.select(F.col("lang").alias("p_lang"), F.col("phrase").alias("p_phrase"), F.col("f").alias("p_f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("p_salt"))
    cut = candidates.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"), "words").withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    sides = cut.select("lang", "phrase", "a", "k", "salt", F.posexplode(F.array(joined(F.lit(1), F.col("k")), joined(F.col("k") + 1, F.col("words") - F.col("k")))).alias("side", "part"))
    # A table with exploded rows is larger than its plan says, and one for the driver to broadcast by that: both joins are merges.
    met = sides.join(salted.hint("merge"), (F.col("lang") == F.col("p_lang")) & (F.col("part") == F.col("p_phrase")) & (F.col("salt") == F.col("p_salt")))
    cuts = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("p_f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("p_f"))).alias("r"))
    scored = cuts.withColumn("score", F.expr(f"cast(cast(a as decimal(20, 0)) * {SCALE} div (cast(l as decimal(20, 0)) + r) as bigint)"))
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # What longer candidates say of the phrases inside them.
    inner = candidates.where("words > 2").select("lang", F.col("a").alias("longer"), "words", "phrase", F.explode(F.expr("sequence(2, words - 1)")).alias("length"))
    inner = inner.select("lang", "longer", "length", words.alias("w"), F.explode(F.expr("sequence(1, words - length + 1)")).alias("first"))
    held = inner.groupBy("lang", F.array_join(F.slice("w", F.col("first"), F.col("length")), "\0").alias("phrase")).agg(F.max("longer").alias("longer"))
    free = weakest.join(held.hint("merge"), ["lang", "phrase"], "left").where(F.expr(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {INSIDE}"))

    n = known.where("words = 0").select(F.col("key").cast("string").alias("lang"), F.col("f").alias("n"))
    named = free.select("lang", F.replace(F.col("phrase"), F.lit("\0"), F.lit(" ")).alias("shown"), "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    named = named.withColumn("phrase", unescape(F.col("shown"))).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = named.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    best = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(n, "lang").select(unescape(F.col("lang")).alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM lowered
), spans AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded WHERE len(w) > 0
), sized AS (
  SELECT lang, w, i, unnest(generate_series(1, least(4, len(w) - i + 1))) AS size FROM spans
), counts AS (
  SELECT lang, w[i:i + size - 1] AS words, count(*)::BIGINT AS f FROM sized GROUP BY ALL
), totals AS (
  SELECT lang, count(*)::BIGINT AS n FROM spans GROUP BY lang
), candidates AS (
  SELECT lang, words, f AS a FROM counts WHERE f >= 30 AND len(words) > 1
), cut AS (
  SELECT lang, words, a, unnest(generate_series(1, len(words) - 1)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.words, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cut c JOIN counts x ON x.lang = c.lang AND x.words = c.words[1:c.k] JOIN counts y ON y.lang = c.lang AND y.words = c.words[c.k + 1:]
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), starts AS (
  SELECT lang, words, a, unnest(generate_series(1, len(words))) AS i FROM candidates WHERE len(words) > 2
), insides AS (
  SELECT lang, words, a, i, unnest(generate_series(i + 1, len(words))) AS j FROM starts
), held AS (
  SELECT lang, words[i:j] AS words, max(a) AS longer FROM insides WHERE j - i + 1 < len(words) GROUP BY ALL
), free AS (
  SELECT w.lang, array_to_string(w.words, ' ') AS phrase, w.a, w.l, w.r, t.n, w.score
  FROM weakest w JOIN totals t USING (lang) LEFT JOIN held h ON h.lang = w.lang AND h.words = w.words
  WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < 80::HUGEINT * w.a
)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM free) WHERE rank <= 2000
"""
