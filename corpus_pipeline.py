"""The training-corpus pipeline: classify, drop near duplicates, cut repeated passages, mix sources, pack.

Each stage takes all rows that the one before it kept, and is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import mixing, near_copies, packing, rule_ensemble, suffix_dedup
from braidwork.llm.common import discard, materialize, numbered, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the rule ensemble, fitted on the training labels, predicts to be of low quality.

    A null or empty text is judged like any other, as are very long ones; equal texts, and so repeated rows, are judged alike.
    Columns of any name stay as they are. Without labels, or without rows, the model is a constant: then all rows stay.
    """
    plain, name = numbered(docs)
    model = rule_ensemble.fit(docs.select("doc_id", "text"), rule_ensemble.training_labels(table(spark, sf_dir, "labels")))
    kept = rule_ensemble.score(plain, model, name["text"]).where(F.col("predicted") == 1)
    return kept.select(*(F.col(new).alias(old) for old, new in name.items()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of five-word shingles shared): the one with the least doc_id.

    Of rows that share it, the first by a hash of the text. Null texts are empty, and texts without words are one group.
    Texts of fewer than five words are one shingle. Rows without a doc_id stay only where no row of their group has one.
    Columns of any name stay as they are. No rows give none.
    """
    return near_copies.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the bytes taken out of their texts that a string of 200 bytes found elsewhere covers; all documents stay.

    A null text becomes an empty one; a text may be cut to nothing. Characters that a cut divides go. n_chars is that of the
    new text. Repeated rows repeat each other's text, so both are cut. Other columns of any name stay as they are. No rows
    give none.
    """
    plain, name = numbered(docs)
    cut = suffix_dedup.remove_repeats(plain, name["doc_id"], name["text"], decoded=True)
    made = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*(made.get(old, F.col(new)).alias(old) for old, new in name.items()))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each as often as the mix of sources takes it.

    A null source is a source of its own. Null and empty texts have size 0 and are taken at their source's rate. Repeated
    rows are taken alike; rows without a doc_id draw by their texts. Columns of any name stay as they are. No rows give none.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of docs with their places in sequences.

    A null text is an empty one: one token, the end. Longer ones than a sequence are cut into pieces. Repeated rows are
    packed each for itself. Other columns are not carried. No rows give none.
    """
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality_classifier", classify), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", cut_repeats), ("mix_sources", mix), ("best_fit_packing", pack)]

#: Hashes, trees and packings aren't SQL's; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        read, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(read)
    return docs
