"""Rule ensemble: compiled columns against plain evaluation, sparsity, held-out accuracy, edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidwork.llm import rule_ensemble as R
from braidwork.llm.common import held_out


def plain(model, row):
    out = model.bias
    for name, (w, least, most, scale) in model.linear.items():
        out += w * min(max(row[name], least), most) / scale
    for r in model.rules:
        out += r.weight * all((row[n] > b) if over else (row[n] <= b) for n, over, b in r.conditions)
    return 1 / (1 + math.exp(-out))


def test_compiled_rules_equal_plain_evaluation(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(R.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(int)
    model = R.fit_arrays(x, y)
    assert model.rules
    assert len(model.rules) < 200
    model.linear["upper"] = (0.3, 0.1, 0.9, 2.0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], R.FEATURES)
    got = df.select(1 / (1 + F.exp(-model.logit(F.struct(*R.FEATURES))))).collect()
    for (a,), r in zip(got, x, strict=False):
        assert a == pytest.approx(plain(model, dict(zip(R.FEATURES, r, strict=True))), abs=1e-9)
    predicted = np.array([plain(model, dict(zip(R.FEATURES, r, strict=True))) for r in x])
    assert ((predicted >= 0.5) == y).mean() > 0.95


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a few words"), (4, "x" * 300_000), (4, "x" * 300_000), (5, "a | b\n" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Score", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (9, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (R.fit(docs.drop("Score"), labels), R.fit(docs.limit(0), labels), R.fit(docs, labels.limit(0))):
        got = R.score(docs, model).collect()
        assert len(got) == len(rows)
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert R.score(docs.limit(0), R.Ensemble(0.0)).collect() == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet").where(held_out("doc_id", 3, 1))
    got = R.op3_quality_classifier(spark, d).join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93
