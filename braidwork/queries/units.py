"""Unit queries: the events of a user's week as a sequence of letters, cut into copies of a motif."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import tandem as T
from braidwork.operators import units as U
from braidwork.queries.base import query, table

KEY = ["user_id", "week"]


def spans_sql(span: str) -> str:
    return f"""{span}s AS (SELECT user_id, date_trunc('{span}', ts)::DATE AS {span}, string_agg(upper(substr(event_type, 1, 1)), '' ORDER BY ts, event_id) AS seq FROM events WHERE event_type IS NOT NULL GROUP BY ALL)"""


def user_spans(spark, d, span):
    """(user_id, span, seq): first letters of the event types in the order of time."""
    e = table(spark, d, "events").where("event_type IS NOT NULL")
    letter = F.struct("ts", "event_id", F.upper(F.substring("event_type", 1, 1)).alias("c"))
    w = e.groupBy("user_id", F.date_trunc(span, "ts").cast("date").alias(span)).agg(F.sort_array(F.collect_list(letter)).alias("x"))
    return w.select("user_id", span, F.array_join(F.transform("x", lambda v: v["c"]), "").alias("seq"))


def local_scores_sql() -> str:
    """The programme of a motif of three letters without flanks, free at both ends and in its entry, a row a letter."""
    go, ge, p = 6, 1, range(3)
    equal = lambda j: f"CASE WHEN substr(seq, i + 1, 1) = substr(motif, {j + 1}, 1) THEN 2 ELSE -4 END"
    read = ", ".join([f"greatest(m{(j - 1) % 3}, i{(j - 1) % 3}, d{(j - 1) % 3}, 0) + {equal(j)} AS m{j}" for j in p] + [f"greatest(m{j} - {go}, i{j} - {ge}, d{j} - {go}) AS i{j}" for j in p])
    lap = [f"greatest({'' if j else '0, '}m{(j - 1) % 3}, i{(j - 1) % 3}) - {go}" for j in p]
    gaps = ", ".join(f"greatest({', '.join(f'{lap[(j - k) % 3]} - {k * ge}' for k in p)}) AS d{j}" for j in p)
    names = ", ".join(f"{s}{j}" for s in "mid" for j in p)
    low = ", ".join(f"-100000 AS {s}{j}" for s in "mi" for j in p)
    return f"""WITH RECURSIVE {spans_sql('week')}, given AS (SELECT *, substr(seq, 1, 3) AS motif FROM weeks WHERE length(seq) >= 3),
run AS (SELECT user_id, week, seq, motif, 0 AS i, {low}, -{go} AS d0, -{go + ge} AS d1, -{go + 2 * ge} AS d2 FROM given
  UNION ALL SELECT user_id, week, seq, motif, i + 1, m0, m1, m2, i0, i1, i2, {gaps} FROM (SELECT user_id, week, seq, motif, i, {read} FROM run WHERE i < length(seq))),
ends AS (SELECT user_id, week, seq, motif, i, greatest(0, m0, m1, m2, i0, i1, i2) AS s FROM run)
SELECT user_id, week, seq, motif, max(s)::BIGINT AS score, arg_max(i, s * 100000 + i)::BIGINT AS array_end FROM ends GROUP BY ALL"""


@query("unit_scores", local_scores_sql())
def unit_scores(spark, d):
    """M6: a week's first three events as a motif, wherever in the week its copies lie."""
    w = user_spans(spark, d, "week").where(F.length("seq") >= 3).withColumn("motif", F.substring("seq", 1, 3))
    return U.segmented(w, KEY, "seq", "motif", free_prefix=True, free_suffix=True, free_entry=True).select(*KEY, "seq", "motif", "score", "array_end")


def anchored(spark, d):
    w = user_spans(spark, d, "week").where(F.length("seq") >= 7)
    w = w.select(*KEY, "seq", F.substring("seq", 1, 2).alias("l"), F.substring("seq", 3, 3).alias("motif"), F.expr("right(seq, 2)").alias("r"))
    return U.segmented(w, KEY, "seq", "motif", "l", "r")


@query("unit_segments")
def unit_segments(spark, d):
    """M6: weeks between their first two and last two events, cut into copies of what comes in between; a row a copy."""
    return U.copies(anchored(spark, d), KEY)


@query("unit_identity")
def unit_identity(spark, d):
    """M6: how far the copies of a week equal its motif."""
    return U.array_identity(U.copies(anchored(spark, d), KEY), KEY)


@query("consensus_motifs")
def consensus_motifs(spark, d):
    """M6: the motif that the copies of a week agree on."""
    return U.consensus_motif(U.copies(anchored(spark, d), KEY), KEY)


#: Two fifths of a window of 10: letters of five kinds meet by chance at a fifth.
SCAN = {"max_period": 12, "floor": 10, "share": (2, 5)}

COVERED_SQL = f"""{spans_sql('quarter')}, tried AS (SELECT user_id, quarter, seq, p, greatest(2 * p, 10) AS w FROM quarters, unnest(generate_series(1, 12)) t(p) WHERE p <= length(seq) // 3 AND greatest(2 * p, 10) + p <= length(seq)),
equal AS (SELECT user_id, quarter, p, w, i, (substr(seq, i::INT, 1) = substr(seq, (i + p)::INT, 1))::INT AS e FROM tried, unnest(generate_series(1, length(seq) - p)) t(i)),
upto AS (SELECT *, sum(e) OVER (PARTITION BY user_id, quarter, p ORDER BY i) AS s FROM equal),
good AS (SELECT a.user_id, a.quarter, a.p, a.i, a.w FROM upto a JOIN upto b ON a.user_id = b.user_id AND a.quarter = b.quarter AND a.p = b.p AND b.i = a.i + a.w - 1 WHERE 5 * (b.s - a.s + a.e) >= 2 * a.w),
inside AS (SELECT DISTINCT x.user_id, x.quarter, x.p, x.i FROM equal x JOIN good g ON x.user_id = g.user_id AND x.quarter = g.quarter AND x.p = g.p AND x.i BETWEEN g.i AND g.i + g.w - 1 WHERE x.e = 1),
covered AS (SELECT user_id, quarter, length(seq)::BIGINT AS letters, p::BIGINT AS period, covered FROM (SELECT user_id, quarter, p, count(DISTINCT place)::BIGINT AS covered FROM (SELECT user_id, quarter, p, i AS place FROM inside UNION ALL SELECT user_id, quarter, p, i + p FROM inside) GROUP BY ALL) JOIN quarters USING (user_id, quarter))"""


def quarter_coverage(spark, d):
    return T.period_coverage(user_spans(spark, d, "quarter"), ["user_id", "quarter"], "seq", **SCAN)


@query("period_coverage", f"WITH {COVERED_SQL} SELECT * FROM covered")
def period_coverage(spark, d):
    """How much of a user's quarter repeats at each period."""
    return quarter_coverage(spark, d)


@query("tandem_periods", f"""WITH {COVERED_SQL}, kinds AS (SELECT *, CASE WHEN period >= 4 THEN 'long' ELSE 'short' END AS kind FROM covered), tops AS (SELECT user_id, quarter, kind, max(covered) AS best FROM kinds GROUP BY ALL),
top AS (SELECT user_id, quarter, kind, best, min(period) AS top FROM kinds JOIN tops USING (user_id, quarter, kind) WHERE covered = best GROUP BY ALL)
SELECT user_id, quarter, kind, period, letters, covered, round(covered / letters, 4) AS share FROM kinds JOIN top USING (user_id, quarter, kind) WHERE top % period = 0 AND 100 * covered >= 85 * best QUALIFY row_number() OVER (PARTITION BY user_id, quarter, kind ORDER BY period) = 1""")
def tandem_periods(spark, d):
    """The short and the long period that cover most of a user's quarter, divisors before their multiples."""
    return T.best_periods(quarter_coverage(spark, d), ["user_id", "quarter"], long_from=4)
