"""Multiple alignments of small groups, one group a task: star merging, tree threading, gap normalisation.

The functions take and give plain lists of rows, so a group operator is grouped(df, by, fields, f) with one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from braidwork.operators.kernels import align, aligned_rows, edit_distance, spanning_tree

GAP = "-"


class Bases:
    """An alignment as the columns of its bases: one ascending array a row, with the letters beside it. Gaps are what is between."""

    def __init__(self, rows: list[str]):
        import numpy as np

        self.width = len(rows[0]) if rows else 0
        whole = [np.frombuffer(r.encode("utf-32-le"), np.uint32) for r in rows]
        self.at = [np.flatnonzero(r != ord(GAP)) for r in whole]
        self.letters = [r[at] for r, at in zip(whole, self.at, strict=True)]

    def mirrored(self) -> Bases:
        """The same read from the last column to the first."""
        other = Bases([])
        other.width, other.at, other.letters = self.width, [self.width - 1 - a[::-1] for a in self.at], [x[::-1] for x in self.letters]
        return other

    def consensus(self, voters: list[int] | None = None):
        """The commonest letter of each column among the voters (all rows), the lesser of equally common ones; 0 where none has one."""
        import numpy as np

        chosen = range(len(self.at)) if voters is None else voters
        columns = np.concatenate([self.at[i] for i in chosen]) if chosen else np.zeros(0, np.int64)
        letters = np.concatenate([self.letters[i] for i in chosen]) if chosen else np.zeros(0, np.uint32)
        kinds, which = np.unique(letters, return_inverse=True)
        votes = np.zeros((len(kinds) + 1, self.width), np.int64)
        np.add.at(votes, (which, columns), 1)
        best = votes.argmax(0)  # the first of the largest: the least letter
        return np.where(votes.max(0) > 0, np.r_[kinds, 0][best], 0)

    def rows(self) -> list[str]:
        """The rows, without columns that no row has a base in."""
        import numpy as np

        used = np.unique(np.concatenate(self.at)) if self.at else np.zeros(0, np.int64)
        out = []
        for at, letters in zip(self.at, self.letters, strict=True):
            row = np.full(len(used), ord(GAP), np.uint32)
            row[np.searchsorted(used, at)] = letters
            out.append(row.tobytes().decode("utf-32-le"))
        return out


def _slide_each(b: Bases, agreed) -> int:
    """One pass, each row for itself: before each gap, bases go to its far end, nearest first, while they agree with the consensus there."""
    moves = 0
    for at, letters in zip(b.at, b.letters, strict=True):
        last = len(at) - 1
        for i in [i for i in range(len(at)) if (at[i + 1] if i < last else b.width) > at[i] + 1]:
            while i >= 0 and letters[i] == agreed[to := (at[i + 1] if i < last else b.width) - 1]:
                at[i] = to
                moves += 1
                i -= 1
    return moves


def _slide_together(b: Bases, agreed) -> int:
    """One pass: rows that have a gap in common, end to end, slide it together, and only while each of them may."""
    import numpy as np

    gaps: dict[tuple[int, int], list[int]] = {}
    for row, at in enumerate(b.at):
        ends = np.r_[-1, at, b.width]
        for k in np.flatnonzero(np.diff(ends) > 1):
            gaps.setdefault((int(ends[k]) + 1, int(ends[k + 1])), []).append(row)
    moves = 0
    for (first, end), members in sorted(gaps.items()):
        before = {row: int(np.searchsorted(b.at[row], first)) - 1 for row in members}
        while all(i >= 0 and b.at[row][i] == first - 1 and b.letters[row][i] == agreed[end - 1] for row, i in before.items()):
            for row, i in before.items():
                b.at[row][i] = end - 1
            before = {row: i - 1 for row, i in before.items()}
            first, end, moves = first - 1, end - 1, moves + 1
    return moves


def _settled(rows: list[str], left: bool, slide, voters: list[int] | None) -> tuple[list[str], int]:
    b = Bases(rows) if left else Bases(rows).mirrored()
    moves = 0
    while moved := slide(b, b.consensus(voters)):
        moves += moved
    return (b if left else b.mirrored()).rows(), moves


def normalise(rows: list[str], left: bool = True, voters: list[int] | None = None) -> tuple[list[str], int]:
    """(rows, moves): gaps moved to one side, a column at a time, while the base that passes agrees with the consensus where it lands.

    The consensus, of the voters if given, is taken anew after each pass, until a pass moves nothing. Columns of gaps alone go.
    """
    return _settled(rows, left, _slide_each, voters)


def normalise_joint(rows: list[str], left: bool = True) -> tuple[list[str], int]:
    """As normalise, but rows that share a gap move it together, one move each for all of them, and stop where one of them may not."""
    return _settled(rows, left, _slide_together, None)


def without_gap_columns(rows: list[str]) -> list[str]:
    keep = [i for i, column in enumerate(zip(*rows, strict=True)) if any(c != GAP for c in column)]
    return ["".join(r[i] for i in keep) for r in rows]


def pairwise(a: str, b: str) -> tuple[str, str]:
    return aligned_rows(a, b, align(a, b))


def star(sequences: list[str], centre: int, pair: Callable[[str, str], tuple[str, str]] = pairwise) -> list[str]:
    """Rows of all sequences, each aligned to the centre; insertions at one place of the centre share columns, left-aligned."""
    middle = sequences[centre]
    before = [0] * (len(middle) + 1)  # the widest insertion before each base of the centre, and at its end
    taken: list[tuple[list[str], list[str]]] = []  # of each sequence: what stands at each base, what is inserted before it
    for i, s in enumerate(sequences):
        x, y = (middle, middle) if i == centre else pair(middle, s)
        at, inserted = [], [""]
        for c, d in zip(x, y, strict=True):
            if c == GAP:
                inserted[-1] += d
            else:
                at.append(d)
                inserted.append("")
        taken.append((at, inserted))
        before = [max(n, len(t)) for n, t in zip(before, inserted, strict=True)]
    return ["".join(t.ljust(n, GAP) + d for t, n, d in zip(inserted, before, [*at, ""], strict=True)) for at, inserted in taken]


#: Fixed scores of placing an insertion: a letter in a column that has it, in one that hasn't, in a new column; a column passed over.
AGREES, DIFFERS, FRESH, PASSED = 2.0, -3.0, -1.0, -2.5


def place_insertion(text: str, columns: list[set[str]]) -> list[tuple[int | None, int | None]]:
    """(column, letter) from left to right, so that the scores' sum is the largest: no column is a new one, no letter one passed over.

    Columns before the first letter and after the last are passed over for free. Of equal ways, one that leaves columns
    after the last letter goes first, then one that takes a column, then a new column.
    """
    n, m = len(text), len(columns)
    best: list[list[tuple[float, int]]] = [[(0.0, 0)] * (m + 1)]  # (score, way): 0 passes a column, 1 makes one, 2 takes one
    for i in range(1, n + 1):
        row = [(best[-1][0][0] + FRESH, 1)]
        for j in range(1, m + 1):
            took = best[-1][j - 1][0] + (AGREES if text[i - 1] in columns[j - 1] else DIFFERS)
            passed = row[-1][0] + (0.0 if i == n else PASSED)
            ways = [(passed, 3 if i == n else 0, 0), (best[-1][j][0] + FRESH, 1, 1), (took, 2, 2)]
            score, _, way = max(ways)
            row.append((score, way))
        best.append(row)
    out, i, j = [], n, m
    while i or j:
        way = best[i][j][1]
        out.append((None if way == 1 else j - 1, None if way == 0 else i - 1))
        i, j = i - (way > 0), j - (way != 1)
    return out[::-1]


def threaded(sequences: list[str], distance=None) -> list[str]:
    """Rows of all sequences: each joins the alignment through its parent in a spanning tree, on the parent's columns.

    distance: a square array (edit distances by default). Inserted letters take columns between the parent's where a letter
    agrees, else new ones.
    """
    if not sequences:
        return []
    if distance is None:
        distance = [[edit_distance(a, b) for b in sequences] for a in sequences]
    order = spanning_tree(distance)
    columns: list[dict[int, str]] = [{order[0][0]: c} for c in sequences[order[0][0]]]  # column: letter of each sequence there
    for new, parent in order[1:]:
        x, y = pairwise(sequences[parent], sequences[new])
        home = [i for i, c in enumerate(columns) if parent in c]
        made, at, nth, pending = [], 0, 0, ""

        def insert(upto: int) -> None:
            nonlocal at, pending
            free = columns[at:upto]
            for column, letter in place_insertion(pending, [set(c.values()) for c in free]):
                own = {} if letter is None else {new: pending[letter]}
                made.append(own if column is None else {**free[column], **own})
            at, pending = upto, ""

        for c, d in zip(x, y, strict=True):
            if c == GAP:
                pending += d
                continue
            insert(home[nth])
            made.append({**columns[at], new: d} if d != GAP else columns[at])
            at, nth = at + 1, nth + 1
        insert(len(columns))
        columns = made
    return ["".join(c.get(i, GAP) for c in columns) for i in range(len(sequences))]


def medoid(sequences: list[str], weights: list[float] | None = None) -> int:
    """The sequence with the least weighted sum of edit distances to the others, ties to the lower number."""
    w = weights or [1.0] * len(sequences)
    return min(range(len(sequences)), key=lambda i: (round(sum(edit_distance(sequences[i], s) * x for s, x in zip(sequences, w, strict=True)), 9), i))


def realigned(sequences: list[str], method: Callable[[list[str]], list[str]] | None = None) -> tuple[str, list[str]]:
    """(status, rows): distinct sequences are aligned by the method (a star around the medoid) and checked; nothing is masked.

    A method that raises, or whose rows don't spell their sequences, gives a status that says so and no rows.
    """
    distinct = list(dict.fromkeys(sequences))
    try:
        rows = (method or (lambda s: star(s, medoid(s))))(distinct)
    except Exception as e:  # noqa: BLE001  a plug-in's failure is a result, not the job's
        return f"error: {type(e).__name__}", []
    if len(rows) != len(distinct) or len({len(r) for r in rows}) > 1 or any(r.replace(GAP, "") != s for r, s in zip(rows, distinct, strict=True)):
        return "error: rows don't spell their sequences", []
    of = dict(zip(distinct, rows, strict=True))
    return "ok", [of[s] for s in sequences]


#: Methods by name; register adds one.
METHODS: dict[str, Callable[[list[str]], list[str]]] = {"star": lambda s: star(s, medoid(s)), "threaded": threaded}


def register(name: str, method: Callable[[list[str]], list[str]]) -> None:
    METHODS[name] = method
