"""Quality rules, in DataFrame functions only: counts of a text's words and lines, then a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed into a fixed number of buckets. Bucket counts of trusted documents and of
the whole corpus give two smoothed multinomials; a document's score is the mean log ratio of its n-grams, so length does
not matter, and it is kept from a fixed threshold on. Counting is a partial aggregation to one row for each bucket; the
table of log ratios has a fixed size and reaches the tasks as the value of a scalar subquery. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import SPACES, let, materialize, table, words

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Documents from this mean log ratio on are kept.
THRESHOLD = -0.08
#: The keys of trusted documents are broadcast up to so many (about 16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_KEYS = 4_000_000


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows of so many words that occur twice or more in the text, first occurrences included.

    hashes: array of the words' hashes. Only texts with equal windows are sorted; n words take n log n steps.
    """
    keys = F.when(
        F.size(hashes) >= window,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window)))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(k: Column) -> Column:
        in_order = F.sort_array(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        starts = let(in_order, lambda s: F.sort_array(F.filter(F.transform(s, lambda x, j: F.when(same(F.get(s, j - 1), x) | same(F.get(s, j + 1), x), x["i"])), lambda p: p.isNotNull())))
        return let(starts, lambda s: F.aggregate(F.transform(s, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - p, F.lit(window)))), F.lit(0), lambda a, b: a + b))

    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) < F.size(k), covered(k)).otherwise(0)).cast("long")


def line_repeats(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def grams(hashes: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of the words and of the pairs of neighbouring words."""
    bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    pairs = F.when(F.size(hashes) > 1, F.transform(F.sequence(F.lit(0), F.size(hashes) - 2), lambda i: bucket(F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.transform(hashes, bucket), pairs)


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def fit(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """One row, ratios array<double>: each bucket's log-likelihood ratio of trusted documents to all.

    docs: all documents. trusted: the keys of some. Both are counted whole. Without trusted n-grams all ratios are 0.
    """
    ids = materialize(trusted.select(F.col(trusted.columns[0]).alias("trusted_")).where("trusted_ IS NOT NULL").distinct(), "trusted")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_KEYS else ids
    marked = docs.select(F.col(key).alias("key_"), F.coalesce(F.col(text), F.lit("")).alias("text_")).join(ids, F.col("key_") == F.col("trusted_"), "left")
    each = marked.select(F.explode(let(word_hashes(F.col("text_")), lambda h: grams(h, buckets))).alias("bucket"), F.col("trusted_").isNotNull().cast("long").alias("t"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("t").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left").na.fill(0)
    total = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "t"))).alias("all"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    log = lambda c, n: F.log((c + SMOOTHING) / (n + SMOOTHING * buckets))
    return total.select(F.transform("all", lambda x: F.when(F.col("t") > 0, log(x["t"], F.col("t")) - log(x["n"], F.col("n"))).otherwise(0.0)).alias("ratios"))


def ratios_literal(model: DataFrame) -> Column:
    """The model's ratios, to 6 decimals, as one literal array (the optimizer folds it); its length is the number of buckets."""
    return F.split(F.lit(",".join(f"{x:.6f}" for x in model.first()["ratios"])), ",").cast("array<double>")


def statistics(text: Column, ratios: Column, buckets: int = BUCKETS) -> Column:
    """struct<n_words, n_repeat_words, llr> of a non-null text; llr is 0 without words."""

    def of(h: Column) -> Column:
        mean = let(grams(h, buckets), lambda g: let(ratios, lambda r: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(r, b)) / F.greatest(F.size(g), F.lit(1))))
        return F.struct(F.size(h).cast("long").alias("n_words"), repeat_words(h).alias("n_repeat_words"), mean.alias("llr"))

    return let(word_hashes(text), of)


def judge(docs: DataFrame, model: DataFrame, text: str = "text", threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    Columns of docs with these names give way. Null and empty texts have no words: all counts are 0, base_failed is true.
    Each row is judged by its text alone, so repeated rows agree. Words are compared by 64-bit hashes.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    own = [c for c in docs.columns if c.lower() not in names]
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(*own, statistics(whole, ratios_literal(model), buckets).alias("s_"), (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"), F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"), line_repeats(whole).alias("n_dup_lines"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        read.select(*own, F.col("s_.n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("s_.n_repeat_words"), F.col("s_.llr"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
        .select(*own, *names)
    )


def trusted_keys(labels: DataFrame) -> DataFrame:
    """Keys of all documents labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = materialize(fit(docs, trusted_keys(table(spark, sf_dir, "labels"))), "llr")
    return judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
