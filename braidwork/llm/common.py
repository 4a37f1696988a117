"""Shared pieces of the training-data operators: word rules, split rules, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.plans.scratch import discard, materialize, partitions  # noqa: F401

#: The only separators of words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
NOT_WORD = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """The words of a non-null text, in order."""
    return F.filter(F.split(text, NOT_WORD), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.size(words(F.coalesce(text, F.lit("")))), F.lit(0)).cast("long")


def chars_of(text: Column, kind: str) -> Column:
    """How many code points of a non-null text are of a kind, a regular expression for one character."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{kind}+", ""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where lambdas of body use it many times."""
    return F.transform(F.array(value), body)[0]


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key has no remainder (null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def held_out(key: str, modulus: int, rest: int) -> Column:
    """True for the held-out fold. A row without a key is a training row."""
    return F.coalesce(remainder(key, modulus) == rest, F.lit(False))


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df does not have (case folded), each as close to the wanted one as can be."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """(df with its columns named c0_, c1_, ..., the new name of each): so that no name of a caller's meets one of an operator's."""
    names = {c: f"c{i}_" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names
