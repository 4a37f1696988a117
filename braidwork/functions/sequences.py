"""Sequence functions as column expressions: all stay in the JVM, none needs Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def letters(seq: Column) -> Column:
    """Upper case; every symbol but A, C, G and T is N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


#: Complements of the IUPAC codes.
COMPLEMENTS = ("ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, *COMPLEMENTS))


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length k, in order; none of shorter sequences."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substr(seq, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def kmer_set(seq: Column, k: int) -> Column:
    return F.array_distinct(kmers(seq, k))


def masked(seq: Column, least: int = 1) -> Column:
    """struct<seq, runs array<struct<pos, run>>>: runs of other letters than A, C, G, T, of so many at least, cut out.

    pos is the place in what is left where the run stood.
    """
    pattern = f"[^ACGT]{{{least},}}"
    parts = F.split(seq, pattern, -1)
    runs = F.regexp_extract_all(seq, F.lit(f"({pattern})"), F.lit(1))
    at = lambda p, i: F.aggregate(F.slice(p, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x))
    return let(parts, lambda p: F.struct(F.array_join(p, "").alias("seq"), F.transform(runs, lambda r, i: F.struct(at(p, i).alias("pos"), r.alias("run"))).alias("runs")))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), n + 1), lambda i: (i > n) | (F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))))
    return F.when(n > 0, F.get(differ, F.lit(0)) - 1).otherwise(0)


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """struct<pos, ref, alt> of an allele without what both sides share at their ends, then at their starts."""
    cut = lambda s, n: F.substr(s, F.lit(1), F.length(s) - n)
    tail = let(common_prefix(F.reverse(ref), F.reverse(alt)), lambda n: F.struct(cut(ref, n).alias("ref"), cut(alt, n).alias("alt")))
    return let(tail, lambda t: let(common_prefix(t["ref"], t["alt"]), lambda n: F.struct((pos + n).alias("pos"), F.substr(t["ref"], n + 1, F.length(t["ref"])).alias("ref"), F.substr(t["alt"], n + 1, F.length(t["alt"])).alias("alt"))))


def apply_edits(ref: Column, edits: Column) -> Column:
    """ref with edits array<struct<pos, ref_length, alt>> applied, pos from 0; they are sorted by place and must not overlap."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, e: F.struct(F.concat(a["out"], F.substr(ref, a["at"] + 1, e["pos"] - a["at"]), e["alt"]).alias("out"), (e["pos"] + e["ref_length"]).cast("int").alias("at"))
    return F.aggregate(F.array_sort(edits), start, step, lambda a: F.concat(a["out"], F.substr(ref, a["at"] + 1, F.length(ref))))


def same_event(ref: Column, pos_a: Column, len_a: Column, alt_a: Column, pos_b: Column, len_b: Column, alt_b: Column) -> Column:
    """Whether two edits of one reference spell the same sequence over the window that holds both."""
    low, high = F.least(pos_a, pos_b), F.greatest(pos_a + len_a, pos_b + len_b)
    spell = lambda p, n, alt: F.concat(F.substr(ref, low + 1, p - low), alt, F.substr(ref, p + n + 1, high - p - n))
    return spell(pos_a, len_a, alt_a) == spell(pos_b, len_b, alt_b)


def runs_of(text: Column, pattern: str) -> Column:
    """Lengths of the runs of characters of a kind (a regular expression for one character)."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"((?:{pattern})+)"), F.lit(1)), lambda r: F.length(r))


def gap_cost(lengths: Column, extend: tuple[int, int] = (2, 1), opens: tuple[int, int] = (4, 24)) -> Column:
    """Sum over gap lengths of the lesser of two affine pieces."""
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + F.least(opens[0] + extend[0] * n, opens[1] + extend[1] * n))


def pair_cost(a: Column, b: Column, mismatch: int = 4) -> Column:
    """Cost of two aligned rows: mismatches, and gaps in either row by two affine pieces; columns that are gaps in both don't count."""
    chars = F.filter(F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y")), lambda c: ~((c["x"] == "-") & (c["y"] == "-")))
    kind = lambda c: F.when(c["x"] == "-", "x").when(c["y"] == "-", "y").when(c["x"] == c["y"], "=").otherwise("*")
    track = F.array_join(F.transform(chars, kind), "")
    return let(track, lambda t: mismatch * (F.length(t) - F.length(F.replace(t, F.lit("*"), F.lit("")))) + gap_cost(F.concat(runs_of(t, "x"), runs_of(t, "y"))))


def cs_operations(cs: Column) -> Column:
    """array<string> of the operations of a difference string (:n, *xy, +seq, -seq, =seq)."""
    return F.regexp_extract_all(cs, F.lit("(:[0-9]+|\\*[a-zA-Z]{2}|[+\\-=][a-zA-Z]+)"), F.lit(1))


def cigar_operations(cigar: Column) -> Column:
    """array<struct<n, op>>."""
    found = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), F.lit(0))
    return F.transform(found, lambda o: F.struct(F.substr(o, F.lit(1), F.length(o) - 1).cast("int").alias("n"), F.right(o, F.lit(1)).alias("op")))


def read_of(path_seq: Column, cs: Column) -> Column:
    """The read that a difference string spells against a path; null where their lengths disagree."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, o):
        n = F.when(o.startswith(":"), F.substr(o, F.lit(2), F.length(o)).cast("int")).when(o.startswith("*"), 1).when(o.startswith("+"), 0).otherwise(F.length(o) - 1)
        add = F.when(o.startswith(":") | o.startswith("="), F.substr(path_seq, a["at"] + 1, n)).when(o.startswith("*"), F.upper(F.right(o, F.lit(1)))).when(o.startswith("+"), F.upper(F.substr(o, F.lit(2), F.length(o)))).otherwise("")
        return F.struct(F.concat(a["out"], add).alias("out"), (a["at"] + n).alias("at"))

    return F.aggregate(cs_operations(cs), start, step, lambda a: F.when(a["at"] == F.length(path_seq), a["out"]))


def cs_counts(cs: Column) -> Column:
    """struct<matches, substitutions, inserted, deleted> of a difference string."""
    ops = cs_operations(cs)
    total = lambda keep, size: F.aggregate(F.transform(F.filter(ops, keep), size), F.lit(0), lambda a, x: a + x)
    return F.struct(
        (total(lambda o: o.startswith(":"), lambda o: F.substr(o, F.lit(2), F.length(o)).cast("int")) + total(lambda o: o.startswith("="), lambda o: F.length(o) - 1)).alias("matches"),
        total(lambda o: o.startswith("*"), lambda o: F.lit(1)).alias("substitutions"),
        total(lambda o: o.startswith("+"), lambda o: F.length(o) - 1).alias("inserted"),
        total(lambda o: o.startswith("-"), lambda o: F.length(o) - 1).alias("deleted"),
    )


def path_name(name: Column) -> Column:
    """struct<sample, haplotype, contig, start> of sample#haplotype#contig[start]."""
    parts = F.split(F.regexp_replace(name, "\\[.*$", ""), "#")
    start = F.regexp_extract(name, "\\[([0-9]+)", 1)
    return F.struct(F.get(parts, F.lit(0)).alias("sample"), F.get(parts, F.lit(1)).try_cast("int").alias("haplotype"), F.get(parts, F.lit(2)).alias("contig"), F.when(start != "", start.cast("long")).alias("start"))


def anchor(text: Column) -> Column:
    """struct<node, rev> of >12, <12, 12+ or 12-, spaces around it aside; other text gives nulls."""
    t = F.trim(text)
    known = t.rlike("^([<>][0-9]+|[0-9]+[+-])$")
    return F.struct(F.when(known, F.regexp_extract(t, "([0-9]+)", 1).cast("long")).alias("node"), F.when(known, t.rlike("^<|-$")).alias("rev"))


def canonical_edge(src: Column, dst: Column) -> Column:
    """The lesser of an edge of signed handles and its reverse."""
    return F.least(F.struct(src.alias("src"), dst.alias("dst")), F.struct((-dst).alias("src"), (-src).alias("dst")))


def reverse_walk(handles: Column) -> Column:
    return F.reverse(F.transform(handles, lambda h: -h))


def ratio(cost: Column, optimum: Column) -> Column:
    """cost / optimum; 1 where both are 0, null where only the optimum is."""
    return F.when(optimum > 0, cost / optimum).when(cost == 0, 1.0)


def f1_strict(tp_base: Column, fn: Column, tp_comp: Column, fp: Column) -> Column:
    """Null only if precision and recall are both undefined; 0 if one is, or either is 0; to 4 decimals."""
    r, p = F.try_divide(tp_base, tp_base + fn), F.try_divide(tp_comp, tp_comp + fp)
    return F.when(r.isNull() & p.isNull(), None).when(r.isNull() | p.isNull() | (r == 0) | (p == 0), 0.0).otherwise(F.round(2 * p * r / (p + r), 4))


def f1_pooled(tp_base: Column, fn: Column, tp_comp: Column, fp: Column) -> Column:
    """Null if precision or recall is undefined, 0 if both are 0."""
    r, p = F.try_divide(tp_base, tp_base + fn), F.try_divide(tp_comp, tp_comp + fp)
    return F.when(r.isNull() | p.isNull(), None).when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def f1_pairs(tp: Column, optimum: Column, found: Column) -> Column:
    return F.try_divide(2.0 * tp, optimum + found)
