"""Quality rules against plain Python: base counts, bucket ratios, scores, edge rows."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from braidwork.llm import quality_rules as Q

SMALL = 64


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def word_hash(w):
    return signed(xxhash.xxh64_intdigest(w.encode(), 42))


def pair_hash(a, b):
    # the second hash takes the first as its seed, over the 8 bytes of the long
    return signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)))


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def buckets(text):
    h = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return [x % SMALL for x in h] + [pair_hash(a, b) % SMALL for a, b in zip(h, h[1:], strict=False)]


TEXTS = [None, "", "  \n\t", "one", "a b c d e " * 3, "a b c d e f a b c d e", "x\nx\n \nx y\n\n", "a|b <c> #$%& *", "é🙂 ü\x0bz\x0cq\r w", " ".join("ab"[i % 2] for i in range(50)), " wide space stays", "ten words are here now so the base rule holds"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["a", "b", "cc", "dd\n", "e#"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_counts_ratios_and_scores(spark):
    texts = TEXTS + random_texts(60, 3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("LLR", F.lit("clash"))
    trusted = spark.createDataFrame([(i,) for i in range(0, len(texts), 2)], "id long")
    model = Q.fit(docs, trusted, buckets=SMALL)
    got = {r.doc_id: r for r in Q.judge(docs, model, buckets=SMALL, threshold=0.0).collect()}
    raw, good = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(buckets(t))
        if i % 2 == 0:
            good.update(buckets(t))
    log = lambda c, b: math.log((c[b] + 1.0) / (c.total() + SMALL))
    ratio = [round(log(good, b) - log(raw, b), 6) for b in range(SMALL)]
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), t
        g = buckets(t)
        want = sum(ratio[b] for b in g) / max(len(g), 1)
        assert r.llr == pytest.approx(want, abs=1e-5)
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed
        assert r.kept == (not failed and r.llr >= 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words " * 10)], "doc_id long, text string")
    none = spark.createDataFrame([], "id long")
    assert Q.judge(docs, Q.fit(docs, none, buckets=SMALL), buckets=SMALL).first().llr == 0.0
    assert Q.judge(docs.limit(0), Q.fit(docs.limit(0), none, buckets=SMALL), buckets=SMALL).collect() == []
