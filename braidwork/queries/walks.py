"""Walk, name and read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions.sequences import COMPLEMENTS, cigar_operations, reverse_complement
from braidwork.operators import kernels as K
from braidwork.operators import walks as V
from braidwork.queries.base import query, table
from braidwork.queries.paths import STEPS_SQL, order_steps


@query("name_matching")
def name_matching(spark, d):
    """Customer names bound to names with a subrange or a longer contig."""
    n = table(spark, d, "customer").select(F.concat(F.lit("s#"), (F.col("c_custkey") % 7).cast("string"), F.lit("#"), F.col("c_name")).alias("name"), "c_custkey")
    k = F.col("c_custkey") % 3
    paths = n.select(F.concat("name", F.when(k == 1, "[12]").when(k == 2, "x1").otherwise("")).alias("path"))
    return V.match_names(n, paths)


@query("walk_classes", f"""WITH {STEPS_SQL}, top AS (SELECT node, row_number() OVER (ORDER BY count(*) DESC, node) AS k FROM steps GROUP BY node), a AS (SELECT node FROM top WHERE k = 1), b AS (SELECT node FROM top WHERE k = 2),
w AS (SELECT path, count(*) FILTER (node = (SELECT node FROM a)) AS n_a, count(*) FILTER (node = (SELECT node FROM b)) AS n_b, min(step) FILTER (node = (SELECT node FROM a)) AS at_a, min(step) FILTER (node = (SELECT node FROM b)) AS at_b FROM steps GROUP BY path),
k AS (SELECT *, CASE WHEN n_a > 1 OR n_b > 1 THEN 'twice' WHEN n_a = 1 AND n_b = 1 THEN CASE WHEN at_a < at_b THEN 'spanning' ELSE 'out_of_order' END WHEN n_a = 1 THEN 'left_only' WHEN n_b = 1 THEN 'right_only' ELSE 'internal' END AS class FROM w)
SELECT path, class, CASE WHEN class = 'spanning' THEN (SELECT string_agg(node::VARCHAR, ',' ORDER BY step) FROM steps s WHERE s.path = k.path AND s.step BETWEEN at_a AND at_b) END AS span FROM k""")
def walk_classes(spark, d):
    """orders' walks cut at the two commonest parts."""
    steps = order_steps(spark, d)
    top = [r["node"] for r in steps.groupBy("node").count().orderBy(F.desc("count"), "node").limit(2).collect()]
    w = steps.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("step", "node"))).alias("s")).select("path", F.transform("s", lambda x: x["node"]).alias("handles"))
    return V.cut_walks(w, top[0], top[1]).select("path", "class", F.array_join(F.transform("span", lambda x: x.cast("string")), ",").alias("span"))


@query("exact_occurrences", f"""WITH n AS (SELECT n_nationkey, n_name, reverse(translate(n_name, '{COMPLEMENTS[0]}', '{COMPLEMENTS[1]}')) AS back FROM nation), r AS (SELECT DISTINCT n_name AS read, unnest([n_name, back]) AS seq, unnest([false, true]) AS rev FROM n),
t AS (SELECT c_custkey AS text, n_name || c_mktsegment || back || n_name AS whole FROM customer JOIN n ON n_nationkey = c_nationkey)
SELECT DISTINCT read, text, (i - 1)::INT AS pos, rev FROM r, t, unnest(generate_series(1, length(whole) - length(seq) + 1)) u(i) WHERE substr(whole, i::INT, length(seq)) = seq""")
def exact_occurrences(spark, d):
    """Nation names, on both strands, in texts that hold one twice as it is and once complemented."""
    n = table(spark, d, "nation")
    reads = n.select(F.col("n_name").alias("read"), F.col("n_name").alias("seq")).distinct()
    whole = F.concat("n_name", "c_mktsegment", reverse_complement(F.col("n_name")), "n_name")
    texts = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("text"), whole.alias("whole"))
    return V.occurrences(reads, texts, 5)


@query("spread_places", f"""WITH {STEPS_SQL}, s AS (SELECT *, CASE WHEN node % 2 = 0 THEN step * 100 END AS place FROM steps), r AS (SELECT *, count(place) OVER (PARTITION BY path ORDER BY step) AS run,
last_value(place + len IGNORE NULLS) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo, first_value(place IGNORE NULLS) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hi FROM s),
t AS (SELECT *, (sum(len) OVER (PARTITION BY path, run, place IS NULL))::DOUBLE AS whole, (sum(len) OVER (PARTITION BY path, run, place IS NULL ORDER BY step))::DOUBLE AS upto FROM r)
SELECT path, step::INT AS step, CASE WHEN place IS NOT NULL THEN place::DOUBLE ELSE lo + (upto - len) / whole * (hi - lo) END AS low, CASE WHEN place IS NOT NULL THEN (place + len)::DOUBLE ELSE lo + upto / whole * (hi - lo) END AS high FROM t""")
def spread_places(spark, d):
    """Steps on even parts are placed, runs of odd ones lie between."""
    s = order_steps(spark, d).withColumn("place", F.when(F.col("node") % 2 == 0, F.col("step") * 100))
    return V.spread_places(s, "path", "step", "place", "len").select("path", "step", "low", "high")


@query("robust_lengths", """WITH o AS (SELECT l_suppkey AS g, l_extendedprice / 20 AS v FROM lineitem WHERE l_extendedprice / 20 BETWEEN 100 AND 2000), m AS (SELECT g, count(*)::BIGINT AS n, median(v) AS median, list_sort(list(v)) AS s FROM o GROUP BY g),
a AS (SELECT g, 1.4826::DOUBLE * median(abs(v - median)) AS sigma FROM o JOIN m USING (g) GROUP BY g), k AS (SELECT g, avg(v) AS mean, stddev_pop(v) AS stdev FROM o JOIN m USING (g) JOIN a USING (g) WHERE abs(v - median) <= 4 * sigma GROUP BY g)
SELECT g, n, median, s[(n // 4 + 1)::INT] AS q1, s[(3 * n // 4 + 1)::INT] AS q3, sigma, round(mean, 5) AS mean, round(stdev, 5) AS stdev FROM m JOIN a USING (g) LEFT JOIN k USING (g)""")
def robust_lengths(spark, d):
    """Prices as fragment lengths."""
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_extendedprice") / 20).alias("v"))
    return V.robust_lengths(x, "g", "v").withColumn("mean", F.round("mean", 5)).withColumn("stdev", F.round("stdev", 5))


@query("phase_stretches", """SELECT o_custkey, o_orderstatus, min(o_orderkey) AS start, max(o_orderkey) AS "end" FROM orders GROUP BY ALL""")
def phase_stretches(spark, d):
    """E43."""
    return V.stretches(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey", "o_orderkey")


@query("best_covering_pair", """WITH x AS (SELECT DISTINCT p_brand, l_suppkey, l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey), s AS (SELECT p_brand, l_suppkey AS o, count(*) AS n FROM x GROUP BY ALL),
b AS (SELECT i.p_brand, i.l_suppkey AS a, j.l_suppkey AS b, count(*) AS n FROM x i JOIN x j ON i.p_brand = j.p_brand AND i.l_orderkey = j.l_orderkey AND i.l_suppkey < j.l_suppkey GROUP BY ALL),
p AS (SELECT s.p_brand, s.o AS a, t.o AS b, s.n + t.n - coalesce(b.n, 0) AS covered FROM s JOIN s t ON s.p_brand = t.p_brand AND s.o < t.o LEFT JOIN b ON b.p_brand = s.p_brand AND b.a = s.o AND b.b = t.o)
SELECT p_brand, a, b, covered::BIGINT AS covered FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY covered DESC, a, b) AS k FROM p) WHERE k = 1""")
def best_covering_pair(spark, d):
    """The two suppliers that cover most orders of a brand."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return V.best_covering_pair(x, "p_brand", "l_suppkey", "l_orderkey")


@query("greedy_cover")
def greedy_cover(spark, d):
    """Suppliers that cover 95 of 100 parts of each brand."""
    import pandas as pd

    x = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select("p_brand", "l_suppkey", "l_partkey").distinct()

    def run(pdf):
        taken = V.greedy_cover(pdf["l_suppkey"], pdf["l_partkey"], 0.95)
        return pd.DataFrame({"nth": range(len(taken)), "l_suppkey": taken})

    return K.grouped(x, "p_brand", "nth long, l_suppkey long", run)


@query("coordinate_lift")
def coordinate_lift(spark, d):
    """parts' sizes through a fixed alignment."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 20).alias("at"), cigar_operations(F.lit("5=2D3=1I4=1X9=")).alias("ops"))
    return V.lifted(p, "at", "ops").select("p_partkey", "at", "lifted")


@query("merge_until_stable")
def merge_until_stable(spark, d):
    """orders' days, widened by a tenth of their length and merged until no two overlap."""
    from braidwork.queries.intervals import spans

    widen = F.col("start"), F.col("end") + F.floor((F.col("end") - F.col("start")) / 10)
    return V.merge_until_stable(spans(spark, d), "cust", widen, "s", "e")


@query("stage_decision", """WITH g AS (SELECT o_orderpriority AS method, o_custkey % 50 AS region, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS v FROM orders GROUP BY ALL), b AS (SELECT region, v AS base FROM g WHERE method = '1-URGENT')
SELECT method, count(*)::BIGINT AS n, quantile_cont(v, 0.5)::DOUBLE AS median, sum(v)::BIGINT AS total, count(*) FILTER (v < base)::BIGINT AS better, count(*) FILTER (v > base)::BIGINT AS worse, sum(v) < sum(base) AND count(*) FILTER (v < base) > count(*) FILTER (v > base) AS wins FROM g JOIN b USING (region) GROUP BY method""")
def stage_decision(spark, d):
    """Medians, sums, better and worse, and the rule that a method wins with a lesser sum and more regions."""
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 50).alias("region")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v"))
    b = g.where("method = '1-URGENT'").select("region", F.col("v").alias("base"))
    better, worse = F.count_if(F.col("v") < F.col("base")), F.count_if(F.col("v") > F.col("base"))
    return g.join(b, "region").groupBy("method").agg(F.count("*").alias("n"), F.percentile("v", F.lit(0.5)).alias("median"), F.sum("v").alias("total"), better.alias("better"), worse.alias("worse"), ((F.sum("v") < F.sum("base")) & (better > worse)).alias("wins"))
