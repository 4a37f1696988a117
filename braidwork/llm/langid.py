"""Language identification as inference of a document's mixture of languages.

Byte trigrams of the lower-cased text are hashed into a fixed number of buckets. Training counts them for each language,
over all training documents, by partial sums of one array a language and task. A document is a draw from a mixture of the
languages' multinomials; expectation-maximisation estimates the proportions on its bucket counts. The set of languages is
chosen forward: starting from the likeliest one, the language with the steepest likelihood joins and stays if the
likelihood rises by more than a penalty that grows with the logarithm of the text. Documents are independent rows: nothing
is shuffled but the training sums, and whole Arrow batches are estimated together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.common import held_out, table

BUCKETS = 4096
SMOOTHING = 0.1
#: A further language must raise the log likelihood by so many times the logarithm of the number of trigrams.
PENALTY = 6.0
ROUNDS = 12
#: More languages than this are refused: the model is sent to every task.
MAX_LANGUAGES = 4000
#: Documents estimated together; bytes of a text hashed together.
BLOCK, PIECE = 256, 1 << 20


def _letters():
    """Byte table: A-Z lower-cased, all other bytes below 0x80 that aren't letters a space, the others as they are."""
    import numpy as np

    t = np.arange(256, dtype=np.uint8)
    t[:0x80] = 0x20
    for c in range(ord("a"), ord("z") + 1):
        t[c] = t[c - 32] = c
    return t


def bucket_counts(text: str):
    """How often each bucket of trigrams occurs in the text with a space before and after it. Long texts go piece by piece."""
    import numpy as np

    t = _letters()[np.frombuffer(f" {text} ".encode(), np.uint8)]
    # upper-case Latin letters of two bytes (U+00C0 to U+00DE): the second byte moves to that of the small letter
    t[1:][(t[:-1] == 0xC3) & (t[1:] >= 0x80) & (t[1:] <= 0x9E) & (t[1:] != 0x97)] += 0x20
    out = np.zeros(BUCKETS, np.int64)
    for i in range(0, len(t) - 2, PIECE):
        x = t[i : i + PIECE + 2].astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        out += np.bincount((h >> np.uint32(20)).astype(np.int64), minlength=BUCKETS)
    return out


def counts_of(texts) -> tuple:
    """(documents x BUCKETS counts as float32, which have a letter) of an Arrow string or binary array; null counts as empty."""
    import numpy as np

    out = np.zeros((len(texts), BUCKETS), np.float32)
    letter = np.zeros(len(texts), bool)
    for i, x in enumerate(texts):
        if raw := x.as_py():
            letter[i] = any(map(str.isalpha, raw))
            out[i] = bucket_counts(raw)
    return out, letter


@dataclass
class Model:
    languages: list[str]
    logp: object  # languages x BUCKETS

    @cached_property
    def p(self):
        """The probabilities as 32-bit numbers, once a task."""
        import numpy as np

        return np.exp(self.logp).astype(np.float32)

    def shares(self, counts, penalty: float = PENALTY):
        """documents x languages: the estimated proportions, 0 outside of each document's chosen set."""
        import numpy as np

        p = self.p
        d, n_langs = len(counts), len(self.languages)
        total = counts.sum(1)
        single = counts @ self.logp.T.astype(np.float32)
        best = single.argmax(1)
        pi = np.zeros((d, n_langs), np.float32)
        pi[np.arange(d), best] = 1
        likelihood = single.max(1).astype(np.float64)
        price = penalty * np.log(np.maximum(total, 2.0))
        open_ = np.flatnonzero(total > 0)
        for _ in range(n_langs - 1):
            if not len(open_):
                break
            c = counts[open_]
            slope = (c / (pi[open_] @ p)) @ p.T  # of the likelihood, by each language
            slope[pi[open_] > 0] = -1
            joins = slope.argmax(1)
            new = pi[open_] * np.float32(0.8)
            new[np.arange(len(open_)), joins] = 0.2
            for _ in range(ROUNDS):
                new *= (c / (new @ p)) @ p.T
                new /= new.sum(1, keepdims=True)
            value = (c * np.log(new @ p)).sum(1, dtype=np.float64)
            better = value > likelihood[open_] + price[open_]
            open_, new = open_[better], new[better]
            pi[open_], likelihood[open_] = new, value[better]
        return pi


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram multinomials of each non-null language of docs. Null and empty texts add nothing but their language's name."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                counts, _ = counts_of(part.column(1))
                for i, name in enumerate(part.column(0).to_pylist()):
                    sums.setdefault(name, np.zeros(BUCKETS))
                    sums[name] += counts[i]
        for name, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n.astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["lang", "n"])

    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL")
    partial = known.mapInArrow(run, "lang string, n array<long>")
    sums = partial.select("lang", F.posexplode("n").alias("bucket", "n")).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    arrays = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("all")).select("lang", "all.n")
    rows = arrays.orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    n = np.array([r["n"] for r in rows], np.float64).reshape(len(rows), BUCKETS) + SMOOTHING
    return Model([r["lang"] for r in rows], np.log(n / n.sum(1, keepdims=True)))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(key, held_out if docs has it, lang_pred, score, langs, shares): one row a document.

    lang_pred is the language with the largest share (ties: the first by name), score its share; langs and shares list the
    chosen set, largest first. Null texts and texts without a letter, and all texts under a model without languages, are
    'und' with score 0 and an empty set. Only the text is read.
    """
    extra = [c for c in docs.columns if c == "held_out"]
    fields = f"{key} {dict(docs.dtypes)[key]}, {'held_out boolean, ' * len(extra)}lang_pred string, score double, langs array<string>, shares array<double>"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                counts, letter = counts_of(batch.column(0))
                pi = model.shares(counts, penalty).astype(np.float64) if model.languages else np.zeros((batch.num_rows, 0))
                names, scores, sets, shares = [], [], [], []
                for row, ok in zip(pi, letter, strict=True):
                    order = [i for i in np.argsort(-row, kind="stable") if row[i] > 0] if ok else []
                    names.append(model.languages[order[0]] if order else "und")
                    scores.append(min(1.0, float(row[order[0]])) if order else 0.0)
                    sets.append([model.languages[i] for i in order])
                    shares.append([float(row[i]) for i in order])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(1, batch.num_columns)), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                    names=[key, *extra, "lang_pred", "score", "langs", "shares"],
                )

    return docs.select(F.col(text).alias("text_"), key, *extra).mapInArrow(run, fields)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out("doc_id", 3, 1).alias("held_out"))
    return identify(docs, fit(docs.where(~F.col("held_out"))))
