"""Mixing: targets against plain arithmetic, copies against their rates, edge rows, the way beyond the broadcast."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from braidwork.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def brute(rows):
    """{source: (size, target)} by filling capped shares again and again."""
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    open_, left, target = set(order), float(sum(sizes.values())), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s]]
        for s in over or open_:
            target[s] = 3.0 * sizes[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(3 * sizes[s] for s in over)
        open_ -= set(over)
    return {s: (sizes[s], target[s]) for s in order}


def draw(key, text):
    named = str(key) if key is not None else hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(f"{mixing.SEED}:{named}".encode()).hexdigest()[:13], 16) / 2**52


ROWS = [(i, "w " * (i % 9), "abcdefg"[i * i % 7]) for i in range(300)]
ROWS += [(None, None, None), (None, f"no key {1}", None), (None, "no key", None), (7, "repeated row", "a"), (7, "repeated row", "a"), (400, "", "only empty"), (401, "word " * 5000, "large"), (402, "one", "Ä"), (403, " ", None)]


@pytest.mark.parametrize("limit", [mixing.BROADCAST_SOURCES, 0])
def test_targets_and_copies(spark, monkeypatch, limit):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    want = brute(ROWS)
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = mixing.with_copies(docs).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(ROWS)
    for r in got:
        size, target = want[r.source]
        assert r.source_size == size and r.target == pytest.approx(target)
        rate = min(3.0, target / size) if size else 0.0
        assert r.n_copies == int(rate) + (draw(r.doc_id, r.text) < rate - int(rate))
    taken = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(docs).collect())
    assert taken == Counter({k: n for k, n in sum((Counter({(r.doc_id, r.text, r.source): r.n_copies}) for r in got), Counter()).items() if n})


def test_sources_come_near_their_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("five words in each text").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    for r in mixing.with_copies(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("n_copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.05)


def test_rows_without_an_id_draw_by_text(spark):
    docs = spark.createDataFrame([(None, f"text number {i}", "a" if i < 300 else "b") for i in range(400)], SCHEMA)
    copies = Counter(r.n_copies for r in mixing.with_copies(docs).where("source = 'a'").collect())
    assert len(copies) == 2


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("size", "source_size", "target", "n_copies", "mix_copy_", "Mix_Source", "draw"):
        docs = docs.withColumn(name, F.lit("own"))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert all(r[3:] == ("own",) * 7 for r in map(tuple, mixed.collect()))
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.with_copies(docs.limit(0)).collect() == []
