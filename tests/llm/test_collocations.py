"""Collocations against counting in dictionaries, the stack against plain counts, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from braidwork.llm import collocations as C


def plainly(rows, min_count=30, top=2000, max_n=4):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, max_n + 1):
                    if i + k <= len(words):
                        counts[lang, tuple(words[i : i + k])] += 1
    found = {}
    for (lang, w), a in counts.items():
        if len(w) > 1 and a >= min_count:
            cuts = [(2000000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            found[lang, w] = (score, a, counts[lang, w[:k]], counts[lang, w[k:]])
    dropped = {(lang, w[i:j]) for (lang, w), x in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * x[1] >= 80 * found[lang, w[i:j]][1]}
    out = []
    for lang in n:
        own = [(x, w) for (at, w), x in found.items() if at == lang and (lang, w) not in dropped]
        own.sort(key=lambda p: (-p[0][0], -p[0][1], " ".join(p[1]).encode()))
        out += [(lang, i + 1, " ".join(w), a, left, right, n[lang], s) for i, ((s, a, left, right), w) in enumerate(own[:top])]
    return sorted(out)


NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def got(docs, **more):
    return sorted(tuple(r[c] for c in NAMES) for r in C.collocations(docs, **more).collect())


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "of", "the", "New", "york", "é", "\x01", "\x01\x02", "x\0y", "\0", "a\x01", "z\x0e", "漢"]
    ends = [" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"]
    return [(rng.choice(["en", "en", None, "und", "x\0", ""]), "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for _ in range(n)]


def test_the_stack_counts_all_prefixes():
    rng = random.Random(1)
    for _ in range(100):
        keys = Counter({b"\0".join([b"l", *(rng.choice([b"a", b"b", b"a\1"]) for _ in range(rng.randint(1, 4)))]): rng.randint(1, 5) for _ in range(rng.randint(0, 30))})
        want = Counter()
        for key, n in keys.items():
            parts = key.split(b"\0")
            for k in range(1, len(parts) + 1):
                want[b"\0".join(parts[:k]), k - 1] += n
        order = sorted(keys.items(), reverse=True)
        found = stacked(rng, order, 1)
        assert {(p, k): n for p, k, n in found} == dict(want) and len(found) == len(want)
        # cut anywhere, with a threshold: no count that reaches it is lost
        at, total = rng.randint(0, len(order)), Counter()
        for part in (order[:at], order[at:]):
            for p, k, n in stacked(rng, part, 6):
                total[p, k] += n
        assert {x: n for x, n in total.items() if n >= 6} == {x: n for x, n in want.items() if n >= 6}


def stacked(rng, order, least):
    """In batches of any sizes."""
    stack, out, at = C.OpenPrefixes(least), [], 0
    while at < len(order):
        some = order[at : at + rng.randint(1, 6)]
        out += stack.add(pa.array([k for k, _ in some], pa.binary()), np.array([n for _, n in some]))
        at += len(some)
    return out + stack.close()


def test_against_dictionaries(spark):
    for seed, n in ((1, 400), (2, 60)):
        rows = random_rows(seed, n)
        docs = spark.createDataFrame(rows, "lang string, text string")
        assert got(docs, min_count=5) == plainly(rows, 5)
    assert got(docs, min_count=3, top=4, max_n=3) == plainly(rows, 3, 4, 3)


def test_flushes_and_divided_first_words(spark, monkeypatch):
    """Ranges far narrower than the commonest first word, and tasks that hand on each few suffixes."""
    rows = [("en", f"the the end of the {i % 7} day. the {i % 3} the") for i in range(300)] + random_rows(3, 50)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = plainly(rows, 30)
    assert want and got(docs) == want
    monkeypatch.setattr(C, "SALTS", 2)
    counts = C.phrase_counts(docs, ranges=40)
    wanted = {(bytes(r.key), r.f) for r in C.phrase_counts(docs, ranges=1).collect()}
    assert {(bytes(r.key), r.f) for r in counts.collect()} == wanted


def test_edges(spark):
    rows = [("en", None), ("en", ""), (None, "a b " * 40), ("long", "p q r s t " * 20_000), ("long", "p q r s t " * 20_000), ("one", "w " * 100)]
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit("clash")).withColumn("range_", F.lit("clash"))
    assert got(docs) == plainly(rows)
    assert got(docs.limit(0)) == []
    numbered = docs.withColumn("lang", F.lit(7))
    assert {r[0] for r in got(numbered)} == {"7"}
