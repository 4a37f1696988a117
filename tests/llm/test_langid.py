"""Language identification: held-out accuracy, mixtures, the estimation against a plain one, edge rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from braidwork.llm import langid as L

WORDS = {"aa": ["kato", "mika", "toka", "rimo", "sato"], "bb": ["schlag", "pfund", "dich", "urst", "wein"], "cc": ["élan", "très", "oùi", "çava", "nuée"]}


def make(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(rng, n=90):
    return [(i, make(rng, lang, rng.randint(5, 60)), lang) for i in range(n) for lang in [list(WORDS)[i % 3]]]


def test_predictions_mixtures_and_edges(spark):
    rng = random.Random(4)
    train = spark.createDataFrame(corpus(rng) + [(1000, "noise", None), (1001, None, "aa"), (1002, "", "bb")], "doc_id long, text string, lang string")
    model = L.fit(train)
    assert model.languages == ["aa", "bb", "cc"]
    rows = [(i, make(rng, lang, 30)) for i, lang in enumerate(WORDS)] + [(10, make(rng, "aa", 60) + " " + make(rng, "bb", 40)), (11, None), (12, ""), (13, "123 !?"), (None, "kato"), (14, make(rng, "cc", 1) * 400_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("zz")).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == list(WORDS)
    assert got[10].langs == ["aa", "bb"]
    assert 0.4 < got[10].shares[0] < 0.8
    assert [got[i].lang_pred for i in (11, 12, 13)] == ["und"] * 3
    assert [got[i].score for i in (11, 12, 13)] == [0.0] * 3
    assert got[None].lang_pred == "aa"
    assert got[14].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert L.identify(docs, L.fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert L.identify(docs.limit(0), model).collect() == []


def test_estimation_against_plain_em():
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.full(L.BUCKETS, 0.05), 2) + 1e-9
    p /= p.sum(1, keepdims=True)
    model = L.Model(["a", "b"], np.log(p))
    c = rng.multinomial(3000, 0.6 * p[0] + 0.4 * p[1]).astype(np.float32)
    pi = [0.8, 0.2]
    for _ in range(L.ROUNDS):
        new = [0.0, 0.0]
        for b in np.flatnonzero(c):
            m = pi[0] * p[0, b] + pi[1] * p[1, b]
            for k in range(2):
                new[k] += c[b] * pi[k] * p[k, b] / m
        pi = [x / sum(new) for x in new]
    got = model.shares(c[None])[0]
    assert math.isclose(max(pi), got.max(), abs_tol=0.01)
    assert math.isclose(got[0], 0.6, abs_tol=0.05)


def test_held_out_accuracy(spark):
    rows = [r for r in L.op2_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) / len(rows) > 0.97
