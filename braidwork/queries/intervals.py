"""Interval queries: orders as intervals of days, ship dates as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import intervals as I
from braidwork.operators import windows as N
from braidwork.queries.base import query, table

#: An order's interval: from its date, as many days as its total price has tens of thousands, and one.
SPANS_SQL = """spans AS (SELECT o_orderkey AS id, o_custkey AS cust, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS s,
  (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1 + floor(o_totalprice / 10000))::BIGINT AS e FROM orders)"""


def spans(spark, d, p=""):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias(f"{p}id"), F.col("o_custkey").alias(f"{p}cust"), day.alias(f"{p}s"), (day + 1 + F.floor(F.col("o_totalprice") / 10000)).cast("long").alias(f"{p}e"))


MERGED_SQL = f"""WITH {SPANS_SQL}, m AS (
  SELECT *, CASE WHEN s - max(e) OVER w > 30 OR max(e) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM spans
  WINDOW w AS (PARTITION BY cust ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), i AS (SELECT *, sum(new) OVER (PARTITION BY cust ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT cust, island::BIGINT AS island, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", count(*)::BIGINT AS n FROM i GROUP BY cust, island"""


@query("interval_merge", MERGED_SQL)
def interval_merge(spark, d):
    """Intervals of a customer merged over gaps of up to 30 days."""
    return I.merge_intervals(spans(spark, d), "cust", "s", "e", 30)


@query("interval_union_bp", MERGED_SQL.replace("> 30", "> 0").replace('SELECT cust, island::BIGINT AS island, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", count(*)::BIGINT AS n FROM i GROUP BY cust, island', 'SELECT cust, sum(x)::BIGINT AS covered FROM (SELECT cust, max(e) - min(s) AS x FROM i GROUP BY cust, island) GROUP BY cust'))
def interval_union_bp(spark, d):
    """Days that a customer's intervals cover."""
    return I.union_length(spans(spark, d), "cust", "s", "e")


@query("interval_coverage", """WITH y AS (SELECT o_custkey AS cust, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS s FROM orders)
SELECT cust, sum(greatest(least(s + 1, 10957) - greatest(s, 10592), 0))::BIGINT AS covered, sum(greatest(least(s + 1, 10957) - greatest(s, 10592), 0))::DOUBLE / 365.0 AS fraction FROM y GROUP BY cust""")
def interval_coverage(spark, d):
    """The fraction of the days of 1999 that are order days (each order's own day, counted as often as it occurs)."""
    one = spans(spark, d).withColumn("e", F.col("s") + 1).withColumn("lo", F.lit(10592)).withColumn("hi", F.lit(10957))
    return I.coverage(one, "cust", "lo", "hi", "s", "e").select("cust", F.col("covered").cast("long").alias("covered"), "fraction")


@query("interval_overlap_join", f"""WITH {SPANS_SQL}, w AS (SELECT n_nationkey AS nat, (9131 + n_nationkey * 30)::BIGINT AS ws, (9131 + n_nationkey * 30 + 45)::BIGINT AS we FROM nation)
SELECT id, nat FROM spans JOIN customer ON c_custkey = cust JOIN w ON nat = c_nationkey AND s < we AND ws < e""")
def interval_overlap_join(spark, d):
    """Orders that overlap the window of their customer's nation."""
    key = F.col("n_nationkey")
    w = table(spark, d, "nation").select(key.alias("nat"), (9131 + key * 30).cast("long").alias("ws"), (9131 + key * 30 + 45).cast("long").alias("we"))
    o = spans(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("cust"), "c_nationkey"), "cust")
    return I.overlap_join(o, w, ("c_nationkey", "nat"), ("s", "e"), ("ws", "we"), 60).select("id", "nat")


@query("point_in_interval", """WITH p AS (SELECT l_orderkey, l_partkey, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS pos FROM lineitem),
iv AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT + 10 AS s FROM orders)
SELECT l_orderkey, count(*)::BIGINT AS n FROM p JOIN iv ON o_orderkey = l_orderkey AND pos >= s AND pos < s + 60 GROUP BY l_orderkey""")
def point_in_interval(spark, d):
    """Lines shipped from 10 to 70 days after their order, by order."""
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    p = table(spark, d, "lineitem").select("l_orderkey", day("l_shipdate").alias("at"))
    iv = table(spark, d, "orders").select("o_orderkey", (day("o_orderdate") + 10).alias("s"), (day("o_orderdate") + 70).alias("e"))
    return I.point_join(p, iv, ("l_orderkey", "o_orderkey"), "at", ("s", "e"), 64).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("overlap_semi", f"""WITH {SPANS_SQL} SELECT DISTINCT a.id FROM spans a WHERE EXISTS (SELECT 1 FROM spans b WHERE b.cust = a.cust AND b.id <> a.id AND b.s < a.e AND a.s < b.e)""")
def overlap_semi(spark, d):
    """Orders that overlap another one of their customer."""
    return I.conflicts(spans(spark, d), "cust", "id", "s", "e", 60).select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct()


@query("interval_conflicts", f"""WITH {SPANS_SQL} SELECT a.cust, a.id AS id_a, b.id AS id_b FROM spans a JOIN spans b ON a.cust = b.cust AND a.id < b.id AND a.s < b.e AND b.s < a.e""")
def interval_conflicts(spark, d):
    """Pairs of overlapping orders of a customer."""
    return I.conflicts(spans(spark, d), "cust", "id", "s", "e", 60)


@query("overlap_anti", f"""WITH {SPANS_SQL} SELECT a.id FROM spans a WHERE NOT EXISTS (SELECT 1 FROM events v WHERE v.user_id = a.cust AND a.s <= 9131 + v.event_id % 2000 AND 9131 + v.event_id % 2000 < a.e)""")
def overlap_anti(spark, d):
    """Orders without an event of their customer on any of their days."""
    at = 9131 + F.col("event_id") % 2000
    v = table(spark, d, "events").select(F.col("user_id").alias("u"), at.alias("vs"), (at + 1).alias("ve"))
    return I.overlap_join(spans(spark, d), v, ("cust", "u"), ("s", "e"), ("vs", "ve"), 60, "left_anti").select("id")


@query("asof_boundary", """WITH r AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL),
p AS (SELECT DISTINCT o_custkey AS cust, o_orderdate + INTERVAL 40 DAY AS at FROM orders)
SELECT p.cust, p.at, r.o_orderkey FROM p ASOF LEFT JOIN r ON p.cust = r.o_custkey AND p.at >= r.o_orderdate""")
def asof_boundary(spark, d):
    """The last order at or before 40 days after each order day of a customer."""
    o = table(spark, d, "orders")
    p = o.select(F.col("o_custkey").alias("cust"), (F.col("o_orderdate") + F.expr("INTERVAL 40 DAY")).alias("at")).distinct()
    return I.asof_join(p, o.select("o_custkey", "o_orderdate", "o_orderkey"), ("cust", "o_custkey"), ("at", "o_orderdate"), ["o_orderkey"])


@query("containment_in_last_start", f"""WITH {SPANS_SQL}, r AS (SELECT cust, s, max(e) AS e FROM spans GROUP BY ALL),
p AS (SELECT id, cust, s + 5 AS a, s + 8 AS b FROM spans)
SELECT p.id, coalesce(p.b <= r.e, false) AS inside FROM p ASOF LEFT JOIN r ON p.cust = r.cust AND p.a >= r.s""")
def containment_in_last_start(spark, d):
    """Whether days 5 to 8 after an order lie in the interval that starts last before them."""
    p = spans(spark, d).select("id", "cust", (F.col("s") + 5).alias("a"), (F.col("s") + 8).alias("b"))
    r = spans(spark, d, "r").select("rcust", "rs", "re")
    return I.asof_join(p, r, ("cust", "rcust"), ("a", "rs"), ["re"]).select("id", F.coalesce(F.col("b") <= F.col("re"), F.lit(False)).alias("inside"))


@query("nearest_boundaries", f"""WITH {SPANS_SQL}, c AS (SELECT cust, id % 3 AS chain, s, e FROM spans), p AS (SELECT id, cust, s AS a, e AS b FROM spans),
per AS (SELECT p.id, c.chain, max(CASE WHEN c.e <= a THEN c.e END) AS l, min(CASE WHEN c.s >= b THEN c.s END) AS r FROM p JOIN c USING (cust) GROUP BY p.id, c.chain)
SELECT p.id, x.chain, x.l AS "left", x.r AS "right" FROM p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r - l, chain) AS k FROM per WHERE l IS NOT NULL AND r IS NOT NULL) x ON x.id = p.id AND k = 1""")
def nearest_boundaries(spark, d):
    """On the tightest chain of a customer's orders (id mod 3), the nearest end before and start after each order."""
    p = spans(spark, d).select("id", "cust", F.col("s").alias("a"), F.col("e").alias("b"))
    c = spans(spark, d, "c").withColumn("chain_no", F.col("cid") % 3)
    return I.nearest_spans(p, c, ("cust", "ccust"), ("a", "b"), "chain_no", "cs", "ce").select("id", "chain", "left", "right")


@query("depth_changes", f"""WITH {SPANS_SQL}, x AS (SELECT cust, s AS pos, 1 AS d FROM spans UNION ALL SELECT cust, e, -1 FROM spans), y AS (SELECT cust, pos, sum(d) AS d FROM x GROUP BY ALL)
SELECT cust, pos AS "at", (sum(d) OVER (PARTITION BY cust ORDER BY pos))::BIGINT AS depth FROM y""")
def depth_changes(spark, d):
    """How many of a customer's intervals cover each stretch of days."""
    return N.depth_changes(spans(spark, d), "cust", "s", "e")
