"""Units: scores against a search over unrolled copies, cuts that are worth their score, the consensus against plain counting."""

import random
from collections import Counter
from functools import lru_cache

import pytest

from braidwork.operators import units as U

C = U.Costs()


def worth(a, b):
    return C.unknown if "N" in (a, b) else C.match if a == b else -C.mismatch


def searched(seq, left, motif, right, free_prefix, free_suffix, free_entry):
    """The best score, by a search from the back over a graph of flanks and unrolled copies."""
    rounds = len(seq) + 2
    nodes = [("l", k) for k in range(len(left))] + [("c", c, j) for c in range(rounds) for j in range(len(motif))] + [("r", k) for k in range(len(right))]
    letter = {x: {"l": left, "c": motif, "r": right}[x[0]][x[-1]] for x in nodes}

    def into(x):
        """(node or None for the start, states it may be in, whether a gap runs on)."""
        if x[0] == "l":
            return [(("l", x[1] - 1), "MID", True)] if x[1] else [(None, "", False)]
        flank = [(("l", len(left) - 1), "MID", False)] if left else [(None, "", False)]
        if x[0] == "c":
            before = [] if x[1:] == (0, 0) else [(("c", x[1], x[2] - 1) if x[2] else ("c", x[1] - 1, len(motif) - 1), "MID", True)]
            return before + (flank if x[1:] == (0, 0) or free_entry and x[1] == 0 else [])
        if x[1]:
            return [(("r", x[1] - 1), "MID", True)]
        return [(("c", c, j), "MI", False) for c in range(rounds) for j in range(len(motif))] + flank

    start = lambda i: 0 if not i or free_prefix else None

    @lru_cache(None)
    def best(i, x, s):
        options = []
        if s == "I":
            if i:
                options = [(best(i - 1, x, t), -C.extend if t == "I" else -C.opening) for t in "MID"]
        elif s == "D" or i:
            k = i - (s == "M")
            for y, states, on in into(x):
                if x[0] == "c" and s == "D" and x[2] and (y is None or y[0] == "l"):
                    continue  # a deletion enters at the first letter
                for t in states:
                    options.append((best(k, y, t), worth(seq[i - 1], letter[x]) if s == "M" else -C.extend if t == "D" and on else -C.opening))
                if y is None:
                    options.append((start(k), worth(seq[i - 1], letter[x]) if s == "M" else -C.opening))
        return max((a + b for a, b in options if a is not None), default=None)

    def ended(i):
        if right:
            found = [best(i, ("r", len(right) - 1), s) for s in "MID"]
        else:
            found = [best(i, ("l", len(left) - 1), s) for s in "MID"] if left else [start(i)]
            found += [best(i, x, s) for x in nodes if x[0] == "c" for s in "MI"]
        return max((x for x in found if x is not None), default=None)

    found = [ended(i) for i in (range(len(seq) + 1) if free_suffix else [len(seq)])]
    return max(x for x in found if x is not None)


def of_units(seq, motif, found):
    """The worth of the rounds of a cut without flanks."""
    total, last = 0, "M"
    for a, _, slots, gone in found.units:
        events = sorted([(s, n, seq[a + n]) for n, s in enumerate(slots)] + [(2 * j, -1, "") for j in gone])
        for slot, _, c in events:
            kind = "I" if slot % 2 else "M" if c else "D"
            total += worth(c, motif[slot // 2]) if kind == "M" else -C.extend if kind == last else -C.opening
            last = kind
    return total


@pytest.mark.parametrize("mode", range(8))
def test_best_score(mode):
    rng = random.Random(mode)
    free = bool(mode & 1), bool(mode & 2), bool(mode & 4)
    for _ in range(40):
        word = lambda a, b: "".join(rng.choice("ACGN" if rng.random() < 0.1 else "ACG") for _ in range(rng.randint(a, b)))  # noqa: B023, E731
        left, motif, right = word(0, 2), word(1, 3), word(0, 2)
        seq = word(0, 1) + left + "".join(motif if rng.random() < 0.7 else word(0, 3) for _ in range(rng.randint(0, 2))) + right
        found = U.segment(seq, left, motif, right, C, *free)
        assert found.score == searched(seq, left, motif, right, *free), (seq, left, motif, right, free)
        assert 0 <= found.start <= found.end <= len(seq)
        at = found.start
        for a, b, slots, _ in found.units:  # copies lie end to end, places do not fall within one
            assert a == at and b - a == len(slots) and slots == sorted(slots)
            at = b
        assert at == found.end


def test_a_cut_is_worth_its_score():
    rng = random.Random(5)
    same = 0
    for _ in range(300):
        motif = "".join(rng.choice("ACGT") for _ in range(rng.randint(2, 7)))
        seq = "".join(c for c in "TTAG" + motif * rng.randint(1, 40) + "GGAT" if rng.random() > 0.03)
        found = U.segment(seq, "", motif, "", C, True, True, True)
        assert of_units(seq, motif, found) >= found.score  # above it only if a round without letters was left out
        same += of_units(seq, motif, found) == found.score
    assert same > 290


def test_known_cuts():
    left, right, u = "GGATCTTACCAG", "TCCGATTAGGCA", "ACGTTGCAT"
    inside = u * 3 + "ACGTGCAT" + u + "ACGTTGGCAT" + u[:5]
    s = U.segment(left + inside + right, left, u, right)
    assert (s.start, s.end) == (len(left), len(left) + len(inside)) and [b - a for a, b, _, _ in s.units] == [9, 9, 9, 8, 9, 10, 5]
    s = U.segment(left + right, left, u, right)
    assert (s.start, s.end, s.units) == (12, 12, [])
    s = U.segment("A" * 9 + left + u + right + "CCCC", left, u, right, free_prefix=True, free_suffix=True)
    assert (s.start, s.end, len(s.units)) == (21, 30, 1)
    s = U.segment("CCCCCC" + u[3:] + u * 2 + "GAGAGA", "", u, "", C, True, True, True)
    assert s.start == 6 and s.units[0][2][0] == 6 and len(s.units) == 3
    assert U.segment("", "", u, "").units == [] and U.segment("", left, u, right).score == -2 * (C.opening + 11 * C.extend)
    for motif, costs in (("", C), ("A", C._replace(extend=0))):
        with pytest.raises(ValueError):
            U.segment("A", "", motif, "", costs)


def test_long_rows_keep_few_vectors():
    u = "ACGTTGCATGGA"
    s = U.segment(u * 2000, "", u, "")
    assert len(s.units) == 2000 and s.score == 2 * 12 * 2000


def plain_consensus(units, p):
    placed, gone, runs, reached = [Counter() for _ in range(p)], Counter(), [Counter() for _ in range(p)], Counter()
    for copy, slots, deleted in units:
        added = {}
        for c, s in zip(copy, slots, strict=True):
            if s % 2:
                added[s // 2] = added.get(s // 2, "") + c
            else:
                placed[s // 2][c] += 1
        gone.update(deleted)
        reached.update({s // 2 for s in slots if s % 2 == 0} | set(deleted))
        for j, run in added.items():
            runs[j][run] += 1
    out = ""
    for j in range(p):
        if placed[j] and placed[j].total() >= gone[j]:
            out += placed[j].most_common(1)[0][0]
        if reached[j] and runs[j].total() * 2 > reached[j]:
            out += runs[j].most_common(1)[0][0]
    return out


def test_copies_identity_and_consensus(spark):
    rng = random.Random(8)
    rows = []
    for k in range(40):
        true = "".join(rng.choice("ACGT") for _ in range(rng.randint(3, 8)))
        seen = list(true)
        seen[rng.randrange(len(seen))] = rng.choice("ACGT")  # what is asked for differs from what repeats
        if k % 3 == 0:
            del seen[0]
        seq = "".join(c for c in true * rng.randint(2, 9) if rng.random() > 0.05)
        rows.append((k, seq, "".join(seen), None if k % 2 else "", k))
    rows += [(100, None, "AC", None, 0), (101, "ACAC", None, None, 0), (102, "ACAC", "", None, 0), (103, "", "AC", None, 0)]
    df = spark.createDataFrame(rows, "`a key` int, units string, score string, flank string, slots int")  # names clash with those made
    cut = U.segmented(df.repartition(5), "a key", "units", "score", "flank").withColumnRenamed("a key", "key").cache()
    got = {r.key: r for r in cut.collect()}
    assert len(got) == len(rows) and all(got[k].score is None and got[k].units is None for k in (100, 101, 102)) and got[103].units == []
    copies = U.copies(cut, "key").cache()
    consensus = {r.key: r.consensus for r in U.consensus_motif(copies, "key").collect()}
    numbers = {r.key: r for r in U.array_identity(copies, "key").collect()}
    for k, seq, motif, _, _ in rows[:40]:
        want = U.segment(seq, "", motif, "")
        assert (got[k].score, got[k].array_start, got[k].array_end) == want[:3]
        units = [(seq[a:b], slots, deleted) for a, b, slots, deleted in want.units]
        assert consensus[k] == plain_consensus(units, len(motif))
        pairs = [(c, s) for copy, slots, _ in units for c, s in zip(copy, slots, strict=True)]
        equal = sum(s % 2 == 0 and motif[s // 2] == c for c, s in pairs)
        whole = len(pairs) + sum(len(x[2]) for x in units)
        assert (numbers[k].units, numbers[k].equal, numbers[k].matched + numbers[k].inserted + numbers[k].deleted) == (len(units), equal, whole)
        assert numbers[k].identity == pytest.approx(equal / whole, abs=6e-5) and numbers[k].whole_units == sum(2 * len(c) >= len(motif) for c, _, _ in units)
    empty = df.limit(0)
    assert U.consensus_motif(U.copies(U.segmented(empty, "a key", "units", "score"), "a key"), "a key").count() == 0


def test_registered_rows(spark):
    """The registered queries over whole tables against the search over unrolled copies and plain counting."""
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    rows = {}
    for r in entry.queries()["unit_segments"](spark, d).collect():
        rows.setdefault((r.user_id, r.week), []).append(r)
    weeks = {}
    for e in sorted(spark.read.parquet(f"{d}/events.parquet").selectExpr("ts", "event_id", "user_id", "event_type", "cast(date_trunc('week', ts) AS date) week").collect()):
        weeks[e.user_id, e.week] = weeks.get((e.user_id, e.week), "") + e.event_type[0].upper()
    consensus = {(r.user_id, r.week): r.consensus for r in entry.queries()["consensus_motifs"](spark, d).collect()}
    identity = {(r.user_id, r.week): r for r in entry.queries()["unit_identity"](spark, d).collect()}
    with_units = 0
    for k, seq in weeks.items():
        if len(seq) < 7:
            assert k not in rows
            continue
        want = U.segment(seq, seq[:2], seq[2:5], seq[-2:])
        if len(seq) < 11:
            assert want.score == searched(seq, seq[:2], seq[2:5], seq[-2:], False, False, False)
        got = sorted(rows.get(k, []), key=lambda r: r.unit)
        assert [(r.start, r.end, r.slots, r.deleted) for r in got] == want.units and all(r.copy == seq[r.start : r.end] for r in got)
        assert consensus.get(k) == (plain_consensus([(r.copy, r.slots, r.deleted) for r in got], 3) if got else None)
        assert (k in identity) == bool(got)
        with_units += bool(got)
    assert with_units > 10


def test_rows_cut_together_are_those_cut_alone(monkeypatch):
    """The same cuts for all kinds of ends, rows of unlike lengths and too long ones; each letter is one step for all rows of a kind."""
    rng = random.Random(11)
    word = lambda a, b: "".join(rng.choice("ACGN") for _ in range(rng.randint(a, b)))
    rows = [(word(0, 14), word(0, 2), word(1, 4), word(0, 2)) for _ in range(300)] + [("AC" * 40, "A", "AC", "C"), ("", "", "A", "")]
    monkeypatch.setattr(U, "CELLS", 1200)
    for kind in [(False, False, False), (True, True, True), (False, True, False), (True, False, True)]:
        assert U.segments(rows, C, *kind) == [U.segment(*r, C, *kind) for r in rows]
    monkeypatch.undo()
    steps, plain = [], U.Cut.vector
    monkeypatch.setattr(U.Cut, "vector", lambda *a: steps.append(1) or plain(*a))
    U.segments([("ACACGTACAC", "A", "CAC", "C")] * 500, C)
    assert len(steps) == 11
