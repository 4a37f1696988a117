"""Tandem repeats: sequences cut into copies of a motif between two flanks, and the motif that the copies agree on.

The model of a row is its left flank, any number of rounds of its motif (none too), its right flank. Rounds are entered at
the motif's first letter (with free_entry at any) and left behind any letter that is not a deletion. A gap of k letters costs
opening + extend * (k - 1); a gap does not run on from a flank into the rounds or back. Letters before the first letter of
the model have no place in it, unless free_prefix leaves them out; free_suffix leaves letters behind it out.

One row is one programme of letters x model letters, a numpy vector of model letters at a time. Rows whose models have equal
lengths go together, a letter of all of them at a time, as far as their vectors are few enough to be kept (CELLS). Of a longer row
only every sqrt(n)-th vector is kept, the others are made again on the way back: memory grows with sqrt(n) x model letters. Rows are independent, so Spark
spreads them; aggregates over copies are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.operators.windows import Names, _list

LOW = -(1 << 40)
MATCH, INSERTED, DELETED = range(3)


class Costs(NamedTuple):
    """Scores of equal letters and of a pair with an N, costs of unequal letters and of a gap's first and further letters."""

    match: int = 2
    mismatch: int = 4
    opening: int = 6
    extend: int = 1
    unknown: int = -1


class Segments(NamedTuple):
    """Score, the stretch that the rounds cover, and each round with letters: (start, end, slots, deleted).

    slots: for each letter 2 * motif place, and one more if it is inserted behind that place. deleted: motif places without a letter.
    """

    score: int
    start: int
    end: int
    units: list[tuple[int, int, list[int], list[int]]]


def _codes(s: str):
    import numpy as np

    return np.frombuffer(s.encode("utf-32-le"), np.uint32)


def segment(seq: str, left: str, motif: str, right: str, costs: Costs = Costs(), free_prefix: bool = False, free_suffix: bool = False, free_entry: bool = False) -> Segments:
    """The best cut of seq. An empty seq has no units; an empty motif or costs.extend below 1 raise ValueError.

    Ties: a match before an insertion before a deletion, entering before going round (at the first letter), no rounds before
    some, leaving behind the earliest motif letter, the longest stretch with free_suffix.
    """
    import numpy as np

    _checked(motif, costs)
    model, codes, n = _codes(left + motif + right)[None], _codes(seq), len(seq)
    cut = Cut(model, len(left), len(left) + len(motif), costs, free_prefix, free_entry)
    stride = isqrt(n) + 1
    kept, now, finish = [], None, None
    for i in range(n + 1):
        now = cut.vector(i, now, codes[i - 1 : i])
        if not i % stride:
            kept.append(now)
        if free_suffix or i == n:
            end = int(cut.ended(i, now)[0])
            finish = (end, i) if finish is None or end >= finish[0] else finish

    made: dict[int, list] = {}

    def at(i: int):
        part = i // stride
        if part not in made:
            for old in [x for x in made if x > part + 1]:
                del made[old]
            rows = [kept[part]]
            for k in range(part * stride + 1, min((part + 1) * stride, n + 1)):
                rows.append(cut.vector(k, rows[-1], codes[k - 1 : k]))
            made[part] = np.stack(rows)[:, 0].tolist()
        return made[part][i % stride]

    return cut.traced(at, *finish)


def _checked(motif: str, costs: Costs) -> None:
    if not motif or costs.extend < 1:
        raise ValueError("a motif of at least one letter and a cost of at least 1 for each further letter of a gap are needed")


class Cut:
    """The programme of rows whose flanks and motifs have equal lengths, a letter of all rows at a time. model: rows x model letters."""

    def __init__(self, model, first: int, after: int, costs: Costs, free_prefix: bool, free_entry: bool):
        self.model, self.first, self.after, self.size = model, first, after, model.shape[1]
        self.costs, self.free_prefix, self.free_entry = costs, free_prefix, free_entry

    def started(self, i: int) -> int:
        return 0 if self.free_prefix or not i else LOW

    def before_rounds(self, i: int, now):
        import numpy as np

        return now[:, :, self.first - 1].max(1) if self.first else np.full(len(now), self.started(i), np.int64)

    def after_rounds(self, i: int, now):
        import numpy as np

        return np.maximum(self.before_rounds(i, now), now[:, :DELETED, self.first : self.after].max((1, 2)))

    def ended(self, i: int, now):
        return now[:, :, -1].max(1) if self.after < self.size else self.after_rounds(i, now)

    def vector(self, i: int, last, letters):
        """Best scores of rows x (match, insertion, deletion) x model letter once i letters are read; letters: the rows' i-th."""
        import numpy as np

        model, first, after, size, c = self.model, self.first, self.after, self.size, self.costs
        go, ge = c.opening, c.extend

        def running(gaps):
            slope = ge * np.arange(gaps.shape[1])
            return np.maximum.accumulate(gaps + slope, 1) - slope

        now = np.full((len(model), 3, size), LOW, np.int64)
        if last is not None:
            reach = np.empty((len(model), size), np.int64)
            reach[:, 1:] = last[:, :, :-1].max(1)
            entry = self.before_rounds(i - 1, last)
            if self.free_entry:
                np.maximum(reach[:, first:after], entry[:, None], out=reach[:, first:after])
            if first:
                reach[:, 0] = self.started(i - 1)
            reach[:, first] = np.maximum(last[:, :, after - 1].max(1), entry)
            if after < size:
                reach[:, after] = self.after_rounds(i - 1, last)
            letters = letters[:, None]
            unknown = (letters == ord("N")) | (model == ord("N"))
            now[:, MATCH] = reach + np.where(unknown, c.unknown, np.where(model == letters, c.match, -c.mismatch))
            now[:, INSERTED] = np.maximum(np.maximum(last[:, MATCH], last[:, DELETED]) - go, last[:, INSERTED] - ge)
        opened = now[:, :DELETED].max(1) - go
        if first:
            head = np.full((len(model), 1), self.started(i) - go, np.int64)
            now[:, DELETED, :first] = running(np.hstack([head, opened[:, : first - 1]]))
        lap = np.hstack([np.maximum(self.before_rounds(i, now) - go, opened[:, after - 1])[:, None], opened[:, first : after - 1]])
        now[:, DELETED, first:after] = running(np.hstack([lap, lap]))[:, after - first :]  # the second lap has been all the way round
        if after < size:
            now[:, DELETED, after:] = running(np.hstack([(self.after_rounds(i, now) - go)[:, None], opened[:, after:-1]]))
        return now

    def traced(self, at, total: int, i: int) -> Segments:
        """The cut of one row that ends with i letters; at(i): its vector of i letters, as lists."""
        first, after, size, free_entry = self.first, self.after, self.size, self.free_entry
        go, ge = self.costs.opening, self.costs.extend
        start = end = None
        events: list[tuple[int, int, int] | None] = []  # backwards: (state, motif place, letters read), None where a round begins

        def most(values) -> int:
            return values.index(max(values))

        def best(now, v: int) -> tuple[int, int]:
            return v, most([x[v] for x in now])

        def before_rounds(i: int, now) -> int:
            return max(x[first - 1] for x in now) if first else self.started(i)

        def enter(i: int):
            return best(at(i), first - 1) if first else None

        def leave(i: int):
            nonlocal start, end
            end = i
            now = at(i)
            inside = [max(m, k) for m, k in zip(now[MATCH][first:after], now[INSERTED][first:after], strict=True)]
            if max(inside) <= before_rounds(i, now):
                start = i
                return enter(i)
            place = first + most(inside)
            return place, most([now[MATCH][place], now[INSERTED][place]])

        where = best(at(i), size - 1) if after < size else leave(i)
        while where is not None:
            v, state = where
            ring = first <= v < after
            if ring:
                events.append((state, v - first, i))
            if state == INSERTED:
                i -= 1
                where = v, most([x[v] - p for x, p in zip(at(i), (go, ge, go), strict=True)])
                continue
            i -= state == MATCH
            now = at(i)
            # what a match or a deletion at v goes on from: the letter before it, at what price
            price = (0, 0, 0) if state == MATCH else (go, go, ge)
            behind = after - 1 if v == first else v - 1
            back = [x[behind] - p for x, p in zip(now, price, strict=True)]
            entry = before_rounds(i, now) - price[0]
            entered = ring and (entry >= max(back) if v == first else free_entry and state == MATCH and entry > max(back))
            if first and not v:
                where = None
            elif v == after:
                where = leave(i)
            elif entered:
                events.append(None)
                start = i
                where = enter(i)
            else:
                if v == first:
                    events.append(None)
                where = (after if v == first else v) - 1, most(back)

        units: list[tuple[int, int, list[int], list[int]]] = []
        slots: list[int] = []
        gone: list[int] = []
        place = start

        def close():
            if slots:
                units.append((place, place + len(slots), list(slots), list(gone)))
            return place + len(slots)

        for event in reversed(events):
            if event is None:
                place = close()
                slots, gone = [], []
            elif event[0] == DELETED:
                gone.append(event[1])
            else:
                slots.append(2 * event[1] + (event[0] == INSERTED))
        close()
        return Segments(total, start, end, units)


#: Numbers that the vectors of rows cut together may have; a row with more of its own is cut alone.
CELLS = 1 << 21


def segments(rows: list[tuple[str, str, str, str]], costs: Costs = Costs(), free_prefix: bool = False, free_suffix: bool = False, free_entry: bool = False) -> list[Segments]:
    """segment of each (seq, left, motif, right): rows whose flanks and motifs have equal lengths go together, in the order of lengths."""
    import numpy as np

    out: list[Segments | None] = [None] * len(rows)
    kinds: dict[tuple[int, ...], list[int]] = {}
    for nth, (_, left, motif, right) in enumerate(rows):
        _checked(motif, costs)
        kinds.setdefault((len(left), len(motif), len(right)), []).append(nth)
    for (a, m, b), members in kinds.items():
        size = a + m + b
        members.sort(key=lambda x: len(rows[x][0]))
        at = 0
        while at < len(members):
            stop = at
            while stop < len(members) and (stop + 1 - at) * (len(rows[members[stop]][0]) + 1) * 3 * size <= CELLS:
                stop += 1
            some, at = members[at : max(stop, at + 1)], max(stop, at + 1)
            if stop == at - 1:  # not one fits
                out[some[0]] = segment(*rows[some[0]], costs, free_prefix, free_suffix, free_entry)
                continue
            lengths = np.array([len(rows[x][0]) for x in some])
            n = int(lengths[-1])
            letters = _codes("".join(rows[x][0].ljust(n) for x in some)).reshape(len(some), n)
            cut = Cut(_codes("".join("".join(rows[x][1:]) for x in some)).reshape(len(some), size), a, a + m, costs, free_prefix, free_entry)
            table = np.empty((len(some), n + 1, 3, size), np.int64)
            total, place, now = np.full(len(some), 4 * LOW), np.zeros(len(some), np.int64), None
            for i in range(n + 1):
                now = table[:, i] = cut.vector(i, now, letters[:, i - 1] if i else None)
                ends = cut.ended(i, now)
                better = ((lengths == i) | (free_suffix & (lengths > i))) & (ends >= total)
                total[better], place[better] = ends[better], i
            for k, x in enumerate(some):
                out[x] = cut.traced(table[k].tolist().__getitem__, int(total[k]), int(place[k]))
    return out


UNITS = "score long, array_start long, array_end long, units array<struct<start:long,end:long,slots:array<int>,deleted:array<int>>>"


def segmented(df: DataFrame, key: Names, seq: str, motif: str, left: str | None = None, right: str | None = None, costs: Costs = Costs(), free_prefix: bool = False, free_suffix: bool = False, free_entry: bool = False) -> DataFrame:
    """(key, seq, motif, score, array_start, array_end, units): one row for each row of df, as segment has it.

    left and right name columns of flanks; null flanks are empty ones. A null seq, a null or an empty motif give nulls, an
    empty seq no units. Repeated rows are kept, other columns of df are not. Rows are dealt over spark.sql.shuffle.partitions
    tasks, since they cost far more than their bytes tell adaptive execution.
    """
    keys = _list(key)
    flank = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if c else F.lit("")
    given = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{seq}`").cast("string").alias("seq"), F.col(f"`{motif}`").cast("string").alias("motif"), flank(left).alias("left_"), flank(right).alias("right_"))
    given = given.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("slots", pa.list_(pa.int32())), ("deleted", pa.list_(pa.int32()))])
        for batch in batches:
            texts = [batch.column(c).to_pylist() for c in ("seq", "motif", "left_", "right_")]
            given = [nth for nth, (s, m) in enumerate(zip(*texts[:2], strict=True)) if s is not None and m]
            found = [None] * batch.num_rows
            for nth, f in zip(given, segments([tuple(texts[c][nth] for c in (0, 2, 1, 3)) for nth in given], costs, free_prefix, free_suffix, free_entry), strict=True):
                found[nth] = f
            numbers = [pa.array([f and f[k] for f in found], pa.int64()) for k in range(3)]
            units = pa.array([f and [dict(zip(("start", "end", "slots", "deleted"), u, strict=True)) for u in f.units] for f in found], pa.list_(kinds))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keys, "seq", "motif"]], *numbers, units], names=[*keys, "seq", "motif", "score", "array_start", "array_end", "units"])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema if f.name not in ("left_", "right_"))
    return given.mapInArrow(run, f"{names}, {UNITS}")


def copies(cut: DataFrame, key: Names) -> DataFrame:
    """(key, unit, start, end, copy, slots, deleted, motif): a row for each copy of a segmented row; rows without any give none."""
    u = cut.select(*_list(key), "seq", "motif", F.posexplode("units").alias("unit", "u"))
    length = (F.col("u.end") - F.col("u.start")).cast("int")
    return u.select(*_list(key), "unit", F.col("u.start").alias("start"), F.col("u.end").alias("end"), F.substring("seq", (F.col("u.start") + 1).cast("int"), length).alias("copy"), F.col("u.slots").alias("slots"), F.col("u.deleted").alias("deleted"), "motif")


def array_identity(units: DataFrame, key: Names) -> DataFrame:
    """(key, units, whole_units, matched, inserted, deleted, equal, identity) of copies: whole ones have half the motif's letters or more.

    identity: equal letters over all letters and deletions of the copies, to four places.
    """
    placed = F.expr("filter(slots, x -> x % 2 = 0)")
    equal = F.expr("size(filter(sequence(1, size(slots)), i -> slots[i - 1] % 2 = 0 AND substring(copy, i, 1) = substring(motif, slots[i - 1] div 2 + 1, 1)))")
    sums = units.groupBy(*_list(key)).agg(
        F.count("*").alias("units"), F.sum((F.length("copy") * 2 >= F.length("motif")).cast("long")).alias("whole_units"), F.sum(F.size(placed)).alias("matched"),
        F.sum(F.size("slots") - F.size(placed)).alias("inserted"), F.sum(F.size("deleted")).alias("deleted"), F.sum(equal).alias("equal"))
    return sums.withColumn("identity", F.round(F.col("equal") / (F.col("matched") + F.col("inserted") + F.col("deleted")), 4))


def consensus_motif(units: DataFrame, key: Names) -> DataFrame:
    """(key, consensus): the motif that the copies of a key agree on, as counts by place, joined in the order of places.

    A place keeps its commonest letter unless more copies lack it than have it. Letters inserted behind it follow if more than
    half of the copies that reach the place carry some: the commonest such run. Ties go to what comes first by (unit). Copies are
    counted before anything is brought together; a key's row holds two strings a motif place. Without any place the result is ''.
    """
    keys = _list(key)
    letters = F.expr("filter(transform(slots, (s, i) -> struct(s div 2 AS place, s % 2 AS kind, substring(copy, i + 1, 1) AS text)), x -> x.kind = 0)")
    runs = F.expr("transform(array_distinct(filter(slots, s -> s % 2 = 1)), s -> struct(s div 2 AS place, 1 AS kind, substring(copy, cast(array_position(slots, s) AS int), size(filter(slots, x -> x = s))) AS text))")
    gaps = F.expr("transform(deleted, j -> struct(j AS place, 2 AS kind, '' AS text))")
    as_one = "array<struct<place:long,kind:int,text:string>>"
    events = units.select(*keys, "unit", F.explode(F.concat(letters.cast(as_one), runs.cast(as_one), gaps.cast(as_one))).alias("e")).select(*keys, "unit", "e.*")
    counted = events.groupBy(*keys, "place", "kind", "text").agg(F.count("*").alias("n"), F.min("unit").alias("first"))
    number = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    commonest = lambda kind: F.max_by("text", F.when(F.col("kind") == kind, F.struct("n", -F.col("first"))))
    places = counted.groupBy(*keys, "place").agg(number(0).alias("placed"), number(1).alias("added"), number(2).alias("lacking"), commonest(0).alias("letter"), commonest(1).alias("run"))
    kept = F.when((F.col("placed") > 0) & (F.col("placed") >= F.col("lacking")), F.col("letter")).otherwise("")
    more = F.when(F.col("added") * 2 > F.col("placed") + F.col("lacking"), F.col("run")).otherwise("")
    joined = places.select(*keys, F.struct("place", F.concat(kept, more).alias("part")).alias("p")).groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("p"))
    return joined.select(*keys, F.array_join(F.transform("p", lambda x: x["part"]), "").alias("consensus"))
