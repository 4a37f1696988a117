"""Tandem scan against every window of every period."""

import random

from braidwork.operators import tandem as T


def plain(seq, max_period, floor, share):
    out = []
    for p in range(1, min(max_period, len(seq) // 3) + 1):
        w = max(2 * p, floor)
        got = set()
        for a in range(len(seq) - p - w + 1):
            equal = [j for j in range(a, a + w) if seq[j] == seq[j + p]]
            if share[1] * len(equal) >= share[0] * w:
                got |= set(equal) | {j + p for j in equal}
        if got:
            out.append((p, len(got)))
    return out


def chosen(found, lo, hi):
    """The best period of lo to hi, or its smallest divisor there of at least 85 % of what it covers."""
    inside = {p: c for p, c in found if lo <= p <= hi}
    if not inside:
        return None
    best = max(inside.values())
    top = min(p for p, c in inside.items() if c == best)
    return min(p for p, c in inside.items() if top % p == 0 and 100 * c >= 85 * best)


def test_periods_and_their_choice(spark):
    rng = random.Random(6)
    rows = [(None, None, 0), ("empty", "", 0), ("short", "AC", 0), ("null", None, 0), ("long text", "ACGTTGCAT" * 4000, 0), ("wide", "äöü" * 40, 0), ("twice", "AC" * 40, 0), ("twice", "AC" * 40, 0)]
    for k in range(60):
        unit = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 20)))
        rows.append((f"r{k}", "".join(rng.choice("ACGT") if rng.random() < 0.08 else c for c in "GATTACA" * rng.randint(0, 3) + unit * rng.randint(1, 12)), 0))
    df = spark.createDataFrame(rows, "`the key` string, letters string, period int").repartition(3)
    cover = T.period_coverage(df, "the key", "letters", 30, 12, (4, 5)).cache()
    got = {}
    for r in cover.collect():
        got.setdefault(r["the key"], []).append((r.period, r.covered))
    for key, seq, _ in rows:
        if key == "long text":
            assert T.covered(seq[:900], 30, 12) == plain(seq[:900], 30, 12, (4, 5))
            assert (9, len(seq)) in got[key]
        elif key != "twice":
            assert sorted(got.get(key, [])) == (plain(seq, 30, 12, (4, 5)) if seq else [])
    assert len(got["twice"]) == 2 * len(plain("AC" * 40, 30, 12, (4, 5)))
    best = {(r["the key"], r.kind): r.period for r in T.best_periods(cover.where("`the key` <> 'twice'"), "the key").collect()}
    for key, found in got.items():
        if key != "twice":
            assert (best.get((key, "short")), best.get((key, "long"))) == (chosen(found, 1, 6), chosen(found, 7, 30))
    assert best["wide", "short"] == 3 and best["long text", "long"] == 9
    assert T.best_periods(T.period_coverage(df.limit(0), "the key", "letters"), "the key").count() == 0


def test_thresholds():
    assert T.covered("A" * 44, 1) == [(1, 44)] and T.covered("A" * 40, 1) == []  # a window and a period must fit
    s = "ACGT" * 20
    assert T.covered(s)[0] == (4, 80)
    assert T.covered("") == [] and T.covered("ACG") == []
