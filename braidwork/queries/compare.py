"""Comparison queries: order priorities as methods, customers mod 50 as regions, total prices as the metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.operators import compare as C
from braidwork.operators import windows as N
from braidwork.queries.base import query, table

RESULTS_SQL = "r AS (SELECT o_custkey % 50 AS region, o_orderpriority AS method, quantile_cont(o_totalprice, 0.5) AS value FROM orders GROUP BY ALL)"


def results(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("region"), F.col("o_orderpriority").alias("method")).agg(F.percentile("o_totalprice", F.lit(0.5)).alias("value"))


@query("quantile_summary", f"""WITH {RESULTS_SQL} SELECT method, count(value)::BIGINT AS n, quantile_cont(value, 0.5) AS median, avg(value) AS mean, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, max(value) AS max FROM r GROUP BY method""")
def quantile_summary(spark, d):
    """A3, A4."""
    return C.summary(results(spark, d), "method", "value")


@query("paired_baseline", f"""WITH {RESULTS_SQL} SELECT a.region, a.method, a.value, b.value AS base, a.value - b.value AS diff FROM r a JOIN r b ON a.region = b.region AND b.method = '1-URGENT' AND a.method <> '1-URGENT'""")
def paired_baseline(spark, d):
    """Each method beside the baseline, by region."""
    return C.paired(results(spark, d), "region", "method", "value", "1-URGENT")


@query("better_worse_equal", f"""WITH {RESULTS_SQL}, p AS (SELECT a.method, a.value - b.value AS diff FROM r a JOIN r b ON a.region = b.region AND b.method = '1-URGENT' AND a.method <> '1-URGENT')
SELECT method, count(*)::BIGINT AS n, count(*) FILTER (diff < -5000)::BIGINT AS better, count(*) FILTER (diff > 5000)::BIGINT AS worse, count(*) FILTER (abs(diff) <= 5000)::BIGINT AS equal FROM p GROUP BY method""")
def better_worse_equal(spark, d):
    """With a tolerance, less being better."""
    return C.better_worse(C.paired(results(spark, d), "region", "method", "value", "1-URGENT"), "method", -1, 5000)


@query("count_at_target", f"""WITH {RESULTS_SQL} SELECT method, count(*) FILTER (value <= 150000)::BIGINT AS hits FROM r GROUP BY method""")
def count_at_target(spark, d):
    """A15."""
    return results(spark, d).groupBy("method").agg(F.count_if(F.col("value") <= 150000).alias("hits"))


@query("common_set", """WITH x AS (SELECT o_custkey, o_orderpriority FROM orders), h AS (SELECT o_custkey FROM x GROUP BY o_custkey HAVING count(DISTINCT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END) = 3)
SELECT o_custkey, count(*)::BIGINT AS n FROM x WHERE o_custkey IN (SELECT o_custkey FROM h) GROUP BY o_custkey""")
def common_set(spark, d):
    """Customers that have an order of each of three priorities."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return C.complete(o, "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("average_ranks", """SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0::DOUBLE AS avg_rank FROM part""")
def average_ranks(spark, d):
    """W14."""
    return table(spark, d, "part").select("p_partkey", N.average_rank("p_size", "p_brand").alias("avg_rank"))


SCORED_SQL = "s AS (SELECT d.n_chars, l.quality = 1 AS pos FROM documents d JOIN labels l USING (doc_id))"


def scored(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("n_chars", (F.col("quality") == 1).alias("pos"))


@query("auc", f"""WITH {SCORED_SQL}, k AS (SELECT pos, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS r FROM s)
SELECT (sum(CASE WHEN pos THEN r ELSE 0 END) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos))::DOUBLE AS auc FROM k""")
def auc(spark, d):
    """A17."""
    return C.auc(scored(spark, d), "n_chars", "pos")


@query("threshold_fit", f"""WITH {SCORED_SQL}, v AS (SELECT n_chars, count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS q FROM s GROUP BY n_chars),
c AS (SELECT (n_chars + lead(n_chars) OVER (ORDER BY n_chars)) / 2.0::DOUBLE AS cut, sum(p) OVER (ORDER BY n_chars) AS fn, sum(q) OVER (ORDER BY n_chars) AS tn, sum(p) OVER () AS ps, sum(q) OVER () AS qs FROM v)
SELECT cut, ((ps - fn)::DOUBLE / ps::DOUBLE + tn::DOUBLE / qs::DOUBLE) / 2.0::DOUBLE AS balanced FROM c WHERE cut IS NOT NULL ORDER BY balanced DESC, cut LIMIT 1""")
def threshold_fit(spark, d):
    """A18, A19, W21."""
    return C.best_threshold(scored(spark, d), "n_chars", "pos")


@query("two_feature_rule")
def two_feature_rule(spark, d):
    """Rules of one feature at all midpoints, of two on a grid of 200 by 200."""
    s = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("n_chars", F.size(F.split("text", "\n")).alias("lines"), (F.col("quality") == 1).alias("pos"))
    return C.two_feature_rule(s, "n_chars", "lines", "pos")


@query("pooled_f1", """WITH c AS (SELECT o_orderpriority AS method, o_custkey % 50 AS region, count(*) FILTER (o_orderstatus = 'F') AS tp_base, count(*) FILTER (o_orderstatus = 'O') AS fn, count(*) FILTER (o_totalprice > 150000) AS tp_comp, nullif(count(*) FILTER (o_totalprice < 50000), 0) AS fp FROM orders GROUP BY ALL),
t AS (SELECT method, sum(tp_base)::BIGINT AS tp_base, sum(fn)::BIGINT AS fn, sum(tp_comp)::BIGINT AS tp_comp, sum(fp)::BIGINT AS fp FROM c WHERE fp IS NOT NULL GROUP BY method)
SELECT *, 2 * (tp_comp::DOUBLE / (tp_comp + fp)) * (tp_base::DOUBLE / (tp_base + fn)) / (tp_comp::DOUBLE / (tp_comp + fp) + tp_base::DOUBLE / (tp_base + fn)) AS f1 FROM t""")
def pooled_f1(spark, d):
    """Counts pooled over regions."""
    n = lambda c: F.count_if(c)
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method"), (F.col("o_custkey") % 50).alias("region")).agg(n(F.col("o_orderstatus") == "F").alias("tp_base"), n(F.col("o_orderstatus") == "O").alias("fn"), n(F.col("o_totalprice") > 150000).alias("tp_comp"), F.nullif(n(F.col("o_totalprice") < 50000), F.lit(0)).alias("fp"))
    return C.pooled(c, "method")


@query("replicate_rule", """WITH g AS (SELECT l_partkey, min(l_quantity) FILTER (l_returnflag = 'A') AS la, max(l_quantity) FILTER (l_returnflag = 'A') AS ha, min(l_quantity) FILTER (l_returnflag = 'N') AS lb, max(l_quantity) FILTER (l_returnflag = 'N') AS hb,
count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'N') AS nb FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, CASE WHEN ha < lb THEN 'better' WHEN la > hb THEN 'worse' ELSE 'tie' END AS verdict FROM g WHERE na > 1 AND nb > 1""")
def replicate_rule(spark, d):
    """A23."""
    return C.replicate_rule(table(spark, d, "lineitem"), "l_partkey", "l_returnflag", "l_quantity", "A", "N")


@query("noise_rule", """WITH g AS (SELECT l_partkey, l_returnflag AS f, avg(l_quantity) AS m, max(l_quantity) - min(l_quantity) AS noise FROM lineitem GROUP BY ALL)
SELECT a.l_partkey, CASE WHEN a.m - b.m < -(a.noise + b.noise) THEN 'better' WHEN a.m - b.m > a.noise + b.noise THEN 'worse' ELSE 'equal' END AS verdict FROM g a JOIN g b ON a.l_partkey = b.l_partkey AND a.f = 'A' AND b.f = 'N'""")
def noise_rule(spark, d):
    """Better or worse only beyond the replicates' noise."""
    x = table(spark, d, "lineitem")
    of = lambda f: F.when(F.col("l_returnflag") == f, F.col("l_quantity"))
    g = x.groupBy("l_partkey").agg(F.avg(of("A")).alias("ma"), F.avg(of("N")).alias("mb"), (F.max(of("A")) - F.min(of("A"))).alias("na"), (F.max(of("N")) - F.min(of("N"))).alias("nb")).where("ma IS NOT NULL AND mb IS NOT NULL")
    return C.noise_rule(g.withColumn("diff", F.col("ma") - F.col("mb")), "na", "nb").select("l_partkey", "verdict")


@query("seeded_sample", """WITH x AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('s1-' || o_orderkey), o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey FROM x WHERE k <= 3""")
def seeded_sample(spark, d):
    """Three orders of each customer, in the order of a hash."""
    return C.sampled(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], 3, "s1")


@query("weighted_sample")
def weighted_sample(spark, d):
    """Two orders of each customer, by total price."""
    return C.weighted_sample(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", ["o_orderkey"], "o_totalprice", 2, "w1")


@query("choice_of_best", f"""WITH {RESULTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY value DESC, method) AS n FROM r) SELECT region, method FROM k WHERE n = 1""")
def choice_of_best(spark, d):
    """A34, O8, O10."""
    return C.choice(results(spark, d), "region", "value", "method", "method")


@query("strategies_against_baseline", f"""WITH {RESULTS_SQL}, g AS (SELECT b.region, m.method, coalesce(r.value, b.value) AS v, b.value AS base FROM (SELECT * FROM r WHERE method = '1-URGENT') b CROSS JOIN (SELECT DISTINCT method FROM r) m LEFT JOIN (SELECT * FROM r WHERE region % 7 <> 3 OR method = '1-URGENT') r ON r.region = b.region AND r.method = m.method)
SELECT method, count(v)::BIGINT AS n, quantile_cont(v, 0.5) AS median, list_sort(list(v))[((count(v) - 1) // 4 + 1)::INT] AS quartile, count(*) FILTER (v > base + 100)::BIGINT AS better, count(*) FILTER (v < base - 100)::BIGINT AS worse FROM g GROUP BY method""")
def strategies_against_baseline(spark, d):
    """With some results missing."""
    r = results(spark, d).where((F.col("region") % 7 != 3) | (F.col("method") == "1-URGENT"))
    return C.against_baseline(r, "region", "method", "value", "1-URGENT", 100)


@query("run_summary", """WITH x AS (SELECT p_brand AS method, CASE p_size % 5 WHEN 0 THEN 'refused' WHEN 1 THEN 'timeout' ELSE 'ok' END AS status, p_retailprice AS sec FROM part)
SELECT method, count(*) FILTER (status = 'ok')::BIGINT AS ok, count(*) FILTER (status = 'refused')::BIGINT AS refused, count(*) FILTER (status = 'timeout')::BIGINT AS timeout, 0::BIGINT AS memout, 0::BIGINT AS failed,
quantile_cont(sec, 0.5) FILTER (status = 'ok') AS median, quantile_cont(sec, 0.9) FILTER (status = 'ok') AS p90, max(sec) FILTER (status = 'ok') AS max, round(sum(sec) FILTER (status = 'ok') / 3600, 6) AS hours FROM x GROUP BY method""")
def run_summary(spark, d):
    """A35, A36."""
    status = F.when(F.col("p_size") % 5 == 0, "refused").when(F.col("p_size") % 5 == 1, "timeout").otherwise("ok")
    x = table(spark, d, "part").select(F.col("p_brand").alias("method"), status.alias("status"), F.col("p_retailprice").alias("sec"))
    return C.run_summary(x, "method", "status", "sec").withColumn("hours", F.round("hours", 6))


@query("signed_rank")
def signed_rank(spark, d):
    """Signed-rank test of each method against the baseline."""
    return C.signed_rank(C.paired(results(spark, d), "region", "method", "value", "1-URGENT"), "method", "diff")


WEIGHT_SQL = " + ".join(f"(u > {e!r}::DOUBLE)::INT" for e in C.poisson_edges())


@query("bootstrap_ratio", f"""WITH k AS (SELECT o_orderpriority, o_totalprice, o_custkey, md5('7/' || o_orderkey) AS m FROM orders), j AS (SELECT *, ('0x' || substr(m, 1, 7))::BIGINT AS a, ('0x' || substr(m, 8, 7))::BIGINT AS b FROM k),
v AS (SELECT o_orderpriority, o_totalprice, o_custkey, draw, (a + draw * b) % {C.DRAW_PRIME} AS v FROM j, (SELECT unnest(generate_series(1, 1000)) AS draw)), s AS (SELECT *, v * v % {C.DRAW_PRIME} AS v2 FROM v),
u AS (SELECT *, (v2 * v2 % {C.DRAW_PRIME} * v % {C.DRAW_PRIME})::DOUBLE / {C.DRAW_PRIME}::DOUBLE + 0.5::DOUBLE / {C.DRAW_PRIME}::DOUBLE AS u FROM s), w AS (SELECT *, {WEIGHT_SQL} AS w FROM u),
d AS (SELECT o_orderpriority, draw, sum(w * o_totalprice) / nullif(sum(w * o_custkey), 0) AS r FROM w GROUP BY ALL), l AS (SELECT o_orderpriority, list_sort(list(r) FILTER (r IS NOT NULL)) AS r FROM d GROUP BY o_orderpriority),
t AS (SELECT o_orderpriority, sum(o_totalprice) / nullif(sum(o_custkey), 0) AS ratio FROM orders GROUP BY o_orderpriority)
SELECT o_orderpriority, round(ratio, 2) AS ratio, round(r[floor(len(r) * 0.025)::INT + 1], 2) AS low, round(r[ceil(len(r) * 0.975)::INT], 2) AS high FROM t JOIN l USING (o_orderpriority)""")
def bootstrap_ratio(spark, d):
    """Ratio of sums with its interval over 1000 draws."""
    r = C.bootstrap_ratio(table(spark, d, "orders"), "o_orderpriority", "o_totalprice", "o_custkey", "o_orderkey")
    return r.withColumns({c: F.round(c, 2) for c in ("ratio", "low", "high")})


@query("bootstrap_difference", f"""WITH {RESULTS_SQL}, p AS (SELECT a.method, a.region, a.value - b.value AS diff FROM r a JOIN r b ON a.region = b.region AND b.method = '1-URGENT' AND a.method <> '1-URGENT'),
x AS (SELECT method, draw, diff, (('0x' || substr(md5('7/' || draw || '/' || region), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM p, (SELECT unnest(generate_series(1, 2000)) AS draw)),
s AS (SELECT method, draw, sum(({WEIGHT_SQL}) * diff) / nullif(sum({WEIGHT_SQL}), 0) AS m FROM x GROUP BY ALL),
l AS (SELECT method, list_sort(list(m) FILTER (m IS NOT NULL)) AS m FROM s GROUP BY method), n AS (SELECT method, count(*) AS n, avg(diff) AS mean FROM p WHERE diff IS NOT NULL GROUP BY method)
SELECT method, n::BIGINT AS n, round(mean * n, 2) AS total, round(m[floor(len(m) * 0.025)::INT + 1] * n, 2) AS low, round(m[ceil(len(m) * 0.975)::INT] * n, 2) AS high FROM l JOIN n USING (method)""")
def bootstrap_difference(spark, d):
    """Each method's sum of differences to the baseline by region, with its interval over 2000 draws of regions."""
    pairs = C.paired(results(spark, d), "region", "method", "value", "1-URGENT").select("method", "region", "diff")
    return C.bootstrap_difference(pairs, "method", "diff", "region").withColumns({c: F.round(c, 2) for c in ("total", "low", "high")})


@query("micro_average_by_bin", """WITH x AS (SELECT CASE WHEN n_chars < 1000 THEN 'a' WHEN n_chars < 10000 THEN 'b' ELSE 'c' END AS bin, quality, toxic FROM documents JOIN labels USING (doc_id))
SELECT coalesce(bin, 'all') AS bin, sum(quality * (1 - toxic))::BIGINT AS tp, sum(quality * toxic)::BIGINT AS fp, sum(1 - quality)::BIGINT AS fn FROM x GROUP BY ROLLUP (bin)""")
def micro_average_by_bin(spark, d):
    """Counts by length bin and over all."""
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("bin", F.when(F.col("n_chars") < 1000, "a").when(F.col("n_chars") < 10000, "b").otherwise("c"))
    return x.rollup("bin").agg(F.sum(F.col("quality") * (1 - F.col("toxic"))).alias("tp"), F.sum(F.col("quality") * F.col("toxic")).alias("fp"), F.sum(1 - F.col("quality")).alias("fn")).withColumn("bin", F.coalesce("bin", F.lit("all")))


@query("nested_sets", """WITH x AS (SELECT o_custkey, o_totalprice, o_orderstatus FROM orders)
SELECT 'all' AS which, count(DISTINCT o_custkey)::BIGINT AS n FROM x UNION ALL SELECT 'large', count(DISTINCT o_custkey) FROM x WHERE o_totalprice > 150000 UNION ALL SELECT 'large open', count(DISTINCT o_custkey) FROM x WHERE o_totalprice > 150000 AND o_orderstatus = 'O'""")
def nested_sets(spark, d):
    """One pass, a row for each set that a row is in."""
    large = F.col("o_totalprice") > 150000
    sets = F.array(F.lit("all"), F.when(large, "large"), F.when(large & (F.col("o_orderstatus") == "O"), "large open"))
    return table(spark, d, "orders").select("o_custkey", F.explode(F.filter(sets, lambda x: x.isNotNull())).alias("which")).groupBy("which").agg(F.countDistinct("o_custkey").alias("n"))


@query("placement_classes", """WITH x AS (SELECT l_shipdate, l_quantity, l_discount FROM lineitem)
SELECT c AS class, count(*)::BIGINT AS n, avg((l_discount > 0.05)::INT)::DOUBLE AS share FROM x, (VALUES ('all', 0, 99), ('low', 0, 5), ('high', 30, 99)) v(c, lo, hi) WHERE l_quantity >= lo AND l_quantity < hi GROUP BY c""")
def placement_classes(spark, d):
    """Overlapping classes of one value."""
    q = F.col("l_quantity")
    classes = F.filter(F.array(F.lit("all"), F.when(q < 5, "low"), F.when(q >= 30, "high")), lambda x: x.isNotNull())
    return table(spark, d, "lineitem").select(F.explode(classes).alias("class"), (F.col("l_discount") > 0.05).cast("int").alias("hit")).groupBy("class").agg(F.count("*").alias("n"), F.avg("hit").alias("share"))


@query("quality_bins", """WITH x AS (SELECT o_orderpriority AS g, CASE WHEN p < 1 THEN '0' WHEN p < 5 THEN '1-4' WHEN p < 30 THEN '5-29' ELSE '30+' END AS bin FROM (SELECT o_orderpriority, o_custkey % 61 AS p FROM orders))
SELECT g, bin, count(*)::BIGINT AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY g)::DOUBLE AS share FROM x GROUP BY g, bin""")
def quality_bins(spark, d):
    """Bins and their shares."""
    from pyspark.sql import Window as W

    p = F.col("o_custkey") % 61
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.when(p < 1, "0").when(p < 5, "1-4").when(p < 30, "5-29").otherwise("30+").alias("bin"))
    n = x.groupBy("g", "bin").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n").cast("double") / F.sum("n").over(W.partitionBy("g")))


@query("effective_depth", """SELECT l_suppkey, round(sum(l_quantity * (1 - power(10::DOUBLE, -(l_linenumber::DOUBLE) / 10))), 4) AS depth FROM lineitem GROUP BY l_suppkey""")
def effective_depth(spark, d):
    """Quantities weighted by 1 - 10^(-q/10)."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_quantity") * (1 - F.pow(F.lit(10.0), -F.col("l_linenumber").cast("double") / 10))), 4).alias("depth"))


@query("pivot_report", f"""WITH {RESULTS_SQL} SELECT region, max(value) FILTER (method = '1-URGENT') AS urgent, max(value) FILTER (method = '2-HIGH') AS high, max(value) FILTER (method = '5-LOW') AS low FROM r GROUP BY region""")
def pivot_report(spark, d):
    """Methods as columns."""
    p = results(spark, d).groupBy("region").pivot("method", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.max("value"))
    return p.select("region", F.col("1-URGENT").alias("urgent"), F.col("2-HIGH").alias("high"), F.col("5-LOW").alias("low"))
