"""Fill-in-middle transformation: a text's units are cut into prefix, middle and suffix, which are put in another order.

The cuts and the form are drawn from a hash of a seed and the document's id, so that each run and each order of rows agrees.
One Arrow-batched function a batch: the ends of the units stand in one compact array, and the parts are two slices by it.
Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import numbered, table, text_or_empty

#: A line with its end, or the last without.
LINES = r"[^\n]*\n|[^\n]+"
SEED = 7


class Markers(NamedTuple):
    """Must overlap neither themselves nor each other."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Rule(NamedTuple):
    """How texts are transformed: of 100 documents, percent are, and of 100 of these, spm_percent with the suffix first."""

    unit: str = LINES
    seed: int = SEED
    percent: int = 100
    spm_percent: int = 50
    markers: Markers = Markers()


class Transformed(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(seed: int, key: object) -> list[int]:
    """Four numbers below 2**32 from the seed and the key in decimal; a null key counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform(text: str, key: object, rule: Rule = Rule(), units=None) -> Transformed:
    """units: the compiled pattern of rule.unit; it must cover the text without gaps."""
    import regex

    ends = array("q", [0])
    for m in (units or regex.compile(rule.unit)).finditer(text):
        if m.start() != ends[-1]:
            break
        ends.append(m.end())
    n = len(ends) - 1
    if ends[n] != len(text):
        raise ValueError("the units do not cover the text")
    cut_a, cut_b, shaped, ordered = draws(rule.seed, key)
    if not text or any(m in text for m in rule.markers) or shaped % 100 >= rule.percent:
        return Transformed(n, "plain", None, None, text)
    a, b = sorted((ends[cut_a % (n + 1)], ends[cut_b % (n + 1)]))
    p, s, m = rule.markers
    if ordered % 100 < rule.spm_percent:
        return Transformed(n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}")
    return Transformed(n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}")


def restore(output: str, form: str, markers: Markers = Markers()) -> str:
    """The text that was transformed. A transformed text holds each marker once, for texts that hold one stay plain."""
    p, s, m = markers
    if form == "plain":
        return output
    first, second = (s, p) if form == "spm" else (p, s)
    if form not in ("spm", "psm") or not output.startswith(first):
        raise ValueError(f"not of form {form}")
    head, found, rest = output[len(first) :].partition(second)
    tail, ended, middle = rest.partition(m)
    if not (found and ended):
        raise ValueError(f"not of form {form}")
    prefix, suffix = (tail, head) if form == "spm" else (head, tail)
    return prefix + middle + suffix


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", with_output: bool = True) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256[, output]) for each row.

    A null text is an empty one, and stays plain, as do texts that hold a marker. prefix_chars and middle_chars (code points)
    are null for plain ones. A null key draws as an empty one; repeated keys draw alike. Other columns are not carried,
    whatever their names. Very long texts take memory in proportion, 8 bytes a unit besides. No rows give none.
    """
    fields = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    plain, name = numbered(docs)

    @F.pandas_udf(fields + ", output string" * with_output)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import regex

        units = regex.compile(rule.unit)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for keys, texts in batches:
            rows = []
            for k, t in zip(keys, texts, strict=True):
                x = transform(t, k, rule, units)
                rows.append((x.n, x.form, x.prefix_chars, x.middle_chars, digest(x.output), digest(restore(x.output, x.form, rule.markers)), *[x.output] * with_output))
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *["output"] * with_output])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    read = plain.select(F.col(name[key]).alias("key_"), made(F.col(name[key]).cast("string"), text_or_empty(name[text])).alias("made_"))
    return read.select(F.col("key_").alias(key), "made_.*")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), with_output=False)


OP13_SQL = r"""
WITH lined AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, lines, len(lines)::BIGINT AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(lines) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(lines) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM lined
), parts AS (
  SELECT doc_id, text, n, form,
         coalesce(array_to_string(lines[1:least(c1, c2)], ''), '') AS p,
         coalesce(array_to_string(lines[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m,
         coalesce(array_to_string(lines[greatest(c1, c2) + 1:], ''), '') AS s
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
