"""Panel and report queries: brands as groups of names, orders as walks and records, priorities as methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from braidwork.functions import sequences as S
from braidwork.operators import checks as K
from braidwork.operators import graphs as G
from braidwork.operators import haplotypes as H
from braidwork.operators import intervals as I
from braidwork.operators import panels as P
from braidwork.operators import windows as N
from braidwork.plans.scratch import materialize, partitions
from braidwork.queries.base import query, table
from braidwork.queries.compare import RESULTS_SQL, results
from braidwork.queries.paths import STEPS_SQL, order_steps

#: Sequences of parts and their strands in walks: an odd part is walked in reverse.
SEQ_SQL = "substr('ACGTTGCAAC', (1 + p_partkey % 5)::BIGINT, (1 + p_partkey % 4)::BIGINT)"
STRAND_SQL = f"CASE WHEN node % 2 = 1 THEN reverse(translate({SEQ_SQL}, 'ACGT', 'TGCA')) ELSE {SEQ_SQL} END"


def part_seqs(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("node"), F.substr(F.lit("ACGTTGCAAC"), (1 + k % 5).cast("int"), (1 + k % 4).cast("int")).alias("seq"))


def stranded(spark, d):
    return order_steps(spark, d).select("path", "step", "node", (F.col("node") % 2 == 1).alias("rev"))


@query("graph_spelling", f"WITH {STEPS_SQL} SELECT path, string_agg({STRAND_SQL}, '' ORDER BY step) AS seq FROM steps JOIN part ON p_partkey = node GROUP BY path")
def graph_spelling(spark, d):
    """What each walk spells."""
    return G.spelled(stranded(spark, d), part_seqs(spark, d), "path", "step")


@query("invalid_paths", f"""WITH {STEPS_SQL}, x AS (SELECT path, string_agg({STRAND_SQL}, '' ORDER BY step) AS seq, bool_or(node % 50 = 0) AS u FROM steps JOIN part ON p_partkey = node GROUP BY path)
SELECT path, CASE WHEN u THEN 'unknown node' ELSE 'differs' END AS problem FROM x WHERE u OR path % 7 = 0""")
def invalid_paths(spark, d):
    """Walks that step on a part that is not there (every fiftieth), or don't spell what is expected of them."""
    steps, nodes = stranded(spark, d), part_seqs(spark, d)
    wanted = G.spelled(steps, nodes, "path", "step").withColumn("seq", F.when(F.col("path") % 7 == 0, F.concat("seq", F.lit("N"))).otherwise(F.col("seq")))
    return K.invalid_paths(steps, nodes.where("node % 50 <> 0"), wanted)


@query("looked_up_brands", "SELECT p_brand, count(*)::BIGINT AS n, sum(l_quantity)::BIGINT AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def looked_up_brands(spark, d):
    """Each line's brand; a line without one would be an error."""
    names = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    rows = P.looked_up(table(spark, d, "lineitem").select("l_partkey", "l_quantity"), names, "l_partkey", "p_brand")
    return rows.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("stratum_lookup", "SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def stratum_lookup(spark, d):
    """Customers by the name of their nation; counted by key first, so the names meet one row a key."""
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return P.looked_up(n, table(spark, d, "nation"), "n_nationkey", "n_name").groupBy("n_name").agg(F.sum("n").alias("n"))


@query("reference_pairs", """WITH r AS (SELECT p_brand, min(p_partkey) AS reference FROM part GROUP BY p_brand)
SELECT p_brand, p_partkey, reference FROM part JOIN r USING (p_brand) WHERE p_partkey <> reference""")
def reference_pairs(spark, d):
    """Pairs of a brand's parts that hold its first part."""
    p = table(spark, d, "part").select("p_brand", "p_partkey")
    first = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first_"))
    return P.with_reference(p.join(first, "p_brand").withColumn("is_reference", F.col("p_partkey") == F.col("first_")), "p_brand", "p_partkey", "is_reference")


@query("nested_records", f"""WITH {STEPS_SQL}, b AS (SELECT path, arg_min(node, step) AS l, arg_max(node, step) AS r, max(step) AS last FROM steps GROUP BY path),
i AS (SELECT DISTINCT path, node FROM steps JOIN b USING (path) WHERE step > 1 AND step < last)
SELECT c.path AS child, p.path AS parent FROM b c JOIN i x ON x.node = c.l JOIN i y ON y.node = c.r AND y.path = x.path JOIN b p ON p.path = x.path WHERE p.path <> c.path AND NOT (p.l = c.l AND p.r = c.r)""")
def nested_records(spark, d):
    """Orders whose first and last parts both lie inside another order."""
    steps = order_steps(spark, d)
    bounds = steps.groupBy("path").agg(F.min_by("node", "step").alias("left"), F.max_by("node", "step").alias("right"), F.max("step").alias("last"))
    inside = steps.join(bounds.select("path", "last"), "path").where("step > 1 AND step < last").select(F.col("path").alias("id"), "node")
    return P.nested(bounds.select(F.col("path").alias("id"), "left", "right"), inside)


@query("missing_path_edges", f"""WITH {STEPS_SQL}, e AS (SELECT path, node AS a, lead(node) OVER (PARTITION BY path ORDER BY step) AS b FROM steps),
c AS (SELECT path, CASE WHEN a < -b THEN a ELSE -b END AS src, CASE WHEN a < -b THEN b ELSE -a END AS dst FROM e WHERE b IS NOT NULL)
SELECT src, dst, bool_or(path % 2 = 0) AS listed FROM c GROUP BY ALL""")
def missing_path_edges(spark, d):
    """U4: edges of even orders, and those that only odd ones walk."""
    e = N.edges(order_steps(spark, d), "path", "step").select("path", S.canonical_edge(F.col("src"), F.col("dst")).alias("e")).select("path", "e.src", "e.dst")
    return P.with_missing(e.where("path % 2 = 0"), e)


@query("input_orders", """SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS longest,
row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), p_partkey) AS shortest, row_number() OVER (PARTITION BY p_brand ORDER BY md5('7/' || p_partkey), p_partkey) AS random FROM part""")
def input_orders(spark, d):
    """O6."""
    out = table(spark, d, "part").select("p_brand", "p_partkey", F.length("p_name").alias("len"))
    for order in ("longest", "shortest", "random:7"):
        name = order.split(":")[0]
        out = P.ordered(out, "p_brand", order, "len", "p_partkey", name).withColumn(name, F.col(name).cast("long"))
    return out.drop("len")


@query("seed_set", """SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 3
OR row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1 OR row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey DESC) = 1 AS seed FROM part""")
def seed_set(spark, d):
    """Three heaviest parts of a brand, its longest and its shortest."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    return P.seeds(p, "p_brand", "p_partkey", "p_retailprice", "p_size", 3).select("p_brand", "p_partkey", "seed")


@query("most_improved", f"""WITH {RESULTS_SQL}, p AS (SELECT a.region, a.value - b.value AS diff FROM r a JOIN r b ON a.region = b.region AND a.method = '2-HIGH' AND b.method = '1-URGENT')
SELECT * FROM (SELECT region, diff, 'improved' AS side FROM p ORDER BY diff, region LIMIT 6) UNION ALL SELECT * FROM (SELECT region, diff, 'worsened' AS side FROM p ORDER BY diff DESC, region LIMIT 6)""")
def most_improved(spark, d):
    """The six regions that gain most against the baseline and the six that lose most (a top-k report)."""
    from braidwork.operators.compare import paired

    pairs = paired(results(spark, d), "region", "method", "value", "1-URGENT").where("method = '2-HIGH'")
    return P.extremes(pairs.select("region", "diff"), "diff", "region", 6)


@query("job_ranks", """SELECT o_orderkey, o_totalprice * CASE o_orderpriority WHEN '1-URGENT' THEN 0.25 WHEN '2-HIGH' THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN o_custkey % 10 = 0 THEN 0.125 ELSE 1.0 END::DOUBLE AS rank FROM orders""")
def job_ranks(spark, d):
    """Orders as jobs, in the order in which they should run."""
    o = table(spark, d, "orders")
    rank = P.job_rank(F.col("o_totalprice"), F.col("o_orderpriority"), {"1-URGENT": 0.25, "2-HIGH": 0.5}, F.col("o_custkey") % 10 == 0, 0.125)
    return o.select("o_orderkey", rank.alias("rank")).orderBy("rank", "o_orderkey")


@query("kinds_inside", """WITH p AS (SELECT l_returnflag, l_suppkey % 25 AS nat, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT AS s, 1 + l_linenumber % 3 AS nr, 1 + l_partkey % 2 AS na FROM lineitem)
, q AS (SELECT l_returnflag, nr = 1 AND na = 1 AS snv, s < 9131 + nat * 60 + 900 AND 9131 + nat * 60 < s + nr AS i FROM p)
SELECT l_returnflag, count(*) FILTER (snv AND i)::BIGINT AS snv_in, count(*) FILTER (snv AND NOT i)::BIGINT AS snv_out, count(*) FILTER (NOT snv AND i)::BIGINT AS indel_in, count(*) FILTER (NOT snv AND NOT i)::BIGINT AS indel_out FROM q GROUP BY l_returnflag""")
def kinds_inside(spark, d):
    """Lines as records of one to three days, inside or outside their nation's span of days."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    r = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 25).alias("nat"), day.alias("s"), (1 + F.col("l_linenumber") % 3).alias("nr"), (1 + F.col("l_partkey") % 2).alias("na"))
    r = r.withColumn("e", F.col("s") + F.col("nr"))
    k = F.col("n_nationkey")
    spans = table(spark, d, "nation").select(k.alias("n"), (9131 + k * 60).cast("long").alias("ws"), (9131 + k * 60 + 900).cast("long").alias("we"))
    place = r.select("nat", "s", "e").distinct()  # lines of one place are inside alike
    hit = I.overlap_join(place, spans, ("nat", "n"), ("s", "e"), ("ws", "we"), 900).select("nat", "s", "e").distinct().withColumn("hit", F.lit(True))
    marked = r.join(hit, ["nat", "s", "e"], "left")
    return P.kinds_inside(marked, "l_returnflag", (F.col("nr") == 1) & (F.col("na") == 1), F.col("hit").isNotNull())


@query("one_start_columns", """WITH c AS (SELECT l_returnflag, l_partkey, count(*) AS n, count(DISTINCT l_linenumber) = 1 AS same FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) FILTER (same)::BIGINT AS one_start, count(*)::BIGINT AS columns, round(coalesce(sum(n) FILTER (same), 0) / sum(n), 4) AS share FROM c GROUP BY l_returnflag""")
def one_start_columns(spark, d):
    """Parts as columns, lines as units that start at their number."""
    return P.one_start(table(spark, d, "lineitem"), "l_returnflag", "l_partkey", "l_linenumber")


@query("pooled_means", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS n, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS l_discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 8) AS l_tax FROM lineitem WHERE l_quantity > 0 GROUP BY ALL""")
def pooled_means(spark, d):
    """Rates pooled over units, by method and stratum."""
    means = P.pooled_means(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax"], "l_quantity")
    return means.withColumns({c: F.round(c, 8) for c in ("l_discount", "l_tax")})


@query("gate_table", """SELECT o_custkey % 50 AS region, count(*) FILTER (o_orderpriority = '1-URGENT')::BIGINT AS urgent_n, round(coalesce(sum(o_totalprice) FILTER (o_orderpriority = '1-URGENT'), 0), 2) AS urgent_total,
count(*) FILTER (o_orderpriority = '2-HIGH')::BIGINT AS high_n, round(coalesce(sum(o_totalprice) FILTER (o_orderpriority = '2-HIGH'), 0), 2) AS high_total FROM orders GROUP BY ALL""")
def gate_table(spark, d):
    """One row a region, the sums of each arm beside each other."""
    arms = {"urgent": "1-URGENT", "high": "2-HIGH"}
    sums = [x for arm, p in arms.items() for x in (F.count_if(F.col("o_orderpriority") == p).alias(f"{arm}_n"), F.round(F.coalesce(F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))), F.lit(0.0)), 2).alias(f"{arm}_total"))]
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("region")).agg(*sums)


@query("digest_differences", f"""WITH {STEPS_SQL}, x AS (SELECT path, md5(string_agg(node::VARCHAR, ',' ORDER BY step)) AS a FROM steps GROUP BY path), y AS (SELECT path, md5(string_agg(node::VARCHAR, ',' ORDER BY step)) AS b FROM steps WHERE node % 11 <> 0 GROUP BY path)
SELECT path, a, b FROM x FULL JOIN y USING (path) WHERE a IS DISTINCT FROM b""")
def digest_differences(spark, d):
    """Walks that change, or go, when every eleventh part is taken out."""
    steps = order_steps(spark, d)
    text = lambda s: s.groupBy("path").agg(F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "node"))), lambda x: x["node"].cast("string")), ",")).alias("digest"))
    return P.different(text(steps), text(steps.where("node % 11 <> 0")), "path", "digest")


@query("evaluable_set", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_quantity) >= 5 AND bool_and(coalesce(l_discount <= 0.08, false))")
def evaluable_set(spark, d):
    """Orders whose lines are all of a quantity of 5 or more, and of a discount of at most 8 %."""
    return P.evaluable(table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount"), "l_orderkey", F.col("l_discount") <= 0.08, "l_quantity", 5)


#: Names of parts without what is no letter, as sequences.
NAMES_SQL = "n AS (SELECT p_partkey, replace(p_name, ' ', '') AS s FROM part WHERE length(replace(p_name, ' ', '')) >= 7)"


def names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("")).alias("s")).where(F.length("s") >= 7)


@query("edited_sequences", f"WITH {NAMES_SQL} SELECT p_partkey, substr(s, 1, 1) || 'X' || substr(s, 4, 2) || 'yy' || substr(s, 6) AS edited, substr(s, 2, 1) = substr(s, 3, 1) AS same FROM n")
def edited_sequences(spark, d):
    """two edits applied; whether taking out the second letter or the third is the same event."""
    edit = lambda p, n, alt: F.struct(F.lit(p).alias("pos"), F.lit(n).alias("ref_length"), F.lit(alt).alias("alt"))
    same = S.same_event(F.col("s"), F.lit(1), F.lit(1), F.lit(""), F.lit(2), F.lit(1), F.lit(""))
    return names(spark, d).select("p_partkey", S.apply_edits(F.col("s"), F.array(edit(5, 0, "yy"), edit(1, 2, "X"))).alias("edited"), same.alias("same"))


@query("difference_reads", f"""WITH {NAMES_SQL} SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN substr(s, 1, 3) || 'TAC' || substr(s, 7) END AS read,
(length(s) - 3 - CASE WHEN p_partkey % 3 > 0 THEN 0 ELSE 1 END)::INT AS matches FROM (SELECT p_partkey, s FROM n) WHERE length(s) >= 8""")
def difference_reads(spark, d):
    """reads from difference strings, null where a string is one short of its path; its matches."""
    n, short = F.length("s"), F.when(F.col("p_partkey") % 3 > 0, 0).otherwise(1)
    cs = F.concat(F.lit(":3*"), F.lower(F.substr("s", F.lit(4), F.lit(1))), F.lit("t+ac-"), F.substr("s", F.lit(5), F.lit(2)), F.lit(":"), (n - 6 - short).cast("string"))
    return names(spark, d).where(n >= 8).select("p_partkey", S.read_of(F.col("s"), cs).alias("read"), S.cs_counts(cs)["matches"].alias("matches"))


@query("anchors", """SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey END AS node, CASE WHEN s_suppkey % 5 < 4 THEN s_suppkey % 5 IN (1, 3) END AS rev FROM supplier""")
def anchors(spark, d):
    """the four ways to write a handle, and one that is none."""
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    written = F.when(k % 5 == 0, F.concat(F.lit(">"), text)).when(k % 5 == 1, F.concat(F.lit("<"), text)).when(k % 5 == 2, F.concat(text, F.lit("+"))).when(k % 5 == 3, F.concat(text, F.lit("-"))).otherwise(text)
    return table(spark, d, "supplier").select("s_suppkey", S.anchor(written).alias("a")).select("s_suppkey", "a.node", "a.rev")


@query("walks_of_pieces", f"""WITH {STEPS_SQL}, c AS (SELECT p_partkey AS node, unnest(generate_series(1, ceil(p_size / 20.0)::BIGINT)) AS nth FROM part)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY step, CASE WHEN node % 2 = 1 THEN -nth ELSE nth END) AS step, node * 10 + nth AS piece, node % 2 = 1 AS rev FROM steps JOIN c USING (node)""")
def walks_of_pieces(spark, d):
    """Walks over parts cut into pieces of 20."""
    k = F.col("p_partkey")
    cut = table(spark, d, "part").select(k.alias("node"), F.explode(F.sequence(F.lit(1), F.ceil(F.col("p_size") / 20).cast("int"))).alias("nth")).withColumn("piece", F.col("node") * 10 + F.col("nth"))
    return P.expanded(stranded(spark, d), cut).withColumn("step", F.col("step").cast("long"))


#: Walks through layers: each even one has one node, each odd one three.
LAYERS_SQL = f"{STEPS_SQL}, l AS (SELECT path % 5 AS grp, path, step, 10 * step + CASE WHEN step % 2 = 0 THEN 0 ELSE node % 3 END AS node FROM steps)"


@query("bubble_alleles", f"""WITH {LAYERS_SQL}, e AS (SELECT DISTINCT grp, src, dst FROM (SELECT grp, node AS src, lead(node) OVER (PARTITION BY path ORDER BY step) AS dst FROM l) WHERE dst IS NOT NULL),
n AS (SELECT DISTINCT grp, node FROM (SELECT grp, src AS node FROM e UNION ALL SELECT grp, dst FROM e)),
c AS (SELECT grp, node FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.grp = n.grp AND e.src < n.node AND n.node < e.dst)),
m AS (SELECT l.*, c.node AS cut FROM l LEFT JOIN c ON c.grp = l.grp AND c.node = l.node),
w AS (SELECT *, last_value(cut IGNORE NULLS) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(cut IGNORE NULLS) OVER (PARTITION BY path ORDER BY step ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM m),
t AS (SELECT grp, path, a, b, string_agg(node::VARCHAR, ',' ORDER BY step) AS allele FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL)
SELECT grp, a AS "left", b AS "right", count(DISTINCT allele)::BIGINT AS alleles, count(*)::BIGINT AS paths FROM t GROUP BY ALL""")
def bubble_alleles(spark, d):
    """Distinct traversals between the places that no edge jumps over."""
    step = F.col("step").cast("long")
    layers = order_steps(spark, d).select((F.col("path") % 5).alias("grp"), "path", step.alias("step"), (10 * step + F.when(step % 2 == 0, 0).otherwise(F.col("node") % 3)).alias("node"))
    cuts = G.cut_points(N.edges(layers, ["grp", "path"], "step").select("grp", "src", "dst").distinct(), "grp")
    return G.bubbles(layers, cuts, "grp", "path", "step", "node")


#: Alleles of parts along a reference of a brand, and their trimmed form.
REFERENCE = "ACGTTGCAACGGTACCATGC"
ALLELES_SQL = f"""r AS (SELECT p_partkey AS id, p_brand AS brand, (p_partkey % 14)::INT AS pos, substr('{REFERENCE}', (1 + p_partkey % 14)::BIGINT, (1 + p_size % 4)::BIGINT) AS ref FROM part WHERE p_partkey % 8 < 5),
v AS (SELECT *, CASE id % 5 WHEN 0 THEN ref || 'CG' WHEN 1 THEN substr(ref, 1, 1) WHEN 2 THEN substr(ref, 1, 1) || 'A' || substr(ref, 2) WHEN 3 THEN substr(ref, 1, length(ref) - 1) || 'T' ELSE substr(ref, 1, 1) || ref END AS alt FROM r),
u AS (SELECT *, len(list_filter(range(1, least(length(ref), length(alt)) + 1), lambda i: right(ref, i) = right(alt, i))) AS z FROM v),
q AS (SELECT *, substr(ref, 1, length(ref) - z) AS r1, substr(alt, 1, length(alt) - z) AS a1 FROM u),
k AS (SELECT *, len(list_filter(range(1, least(length(r1), length(a1)) + 1), lambda i: substr(r1, 1, i) = substr(a1, 1, i))) AS y FROM q),
t AS (SELECT id, brand, pos, ref, alt, pos + y AS s, pos + y + length(r1) - y AS e, substr(a1, y + 1) AS ins FROM k)"""


def alleles(spark, d, p=""):
    k = F.col("p_partkey")
    ref = F.substr(F.lit(REFERENCE), (1 + k % 14).cast("int"), (1 + F.col("p_size") % 4).cast("int"))
    part = table(spark, d, "part").where(k % 8 < 5).select("p_partkey", "p_brand", "p_size").repartition(partitions(spark))
    rows = part.select(k.alias("id"), F.col("p_brand").alias("brand"), (k % 14).cast("int").alias("pos"), ref.alias("ref"))
    first, n = F.substr("ref", F.lit(1), F.lit(1)), F.length("ref")
    alt = F.when(F.col("id") % 5 == 0, F.concat("ref", F.lit("CG"))).when(F.col("id") % 5 == 1, first).when(F.col("id") % 5 == 2, F.concat(first, F.lit("A"), F.substr("ref", F.lit(2), n))).when(F.col("id") % 5 == 3, F.concat(F.substr("ref", F.lit(1), n - 1), F.lit("T"))).otherwise(F.concat(first, F.col("ref")))
    return rows.withColumn("alt", alt).withColumn("end", F.col("pos") + n).toDF(*(f"{p}{c}" for c in ("id", "brand", "pos", "ref", "alt", "end")))


@query("allele_conflicts", f"""WITH {ALLELES_SQL},
p AS (SELECT x.id AS id_a, y.id AS id_b, x.s AS s1, x.e AS e1, x.ins AS i1, y.s AS s2, y.e AS e2, y.ins AS i2, CASE
  WHEN x.s = x.e AND y.s = y.e THEN x.s = y.s
  WHEN x.s = x.e THEN (y.s < x.s AND x.s < y.e) OR (x.s = y.e AND ends_with(y.ins, x.ins)) OR (x.s = y.s AND starts_with(y.ins, x.ins))
  WHEN y.s = y.e THEN (x.s < y.s AND y.s < x.e) OR (y.s = x.e AND ends_with(x.ins, y.ins)) OR (y.s = x.s AND starts_with(x.ins, y.ins))
  ELSE greatest(x.s, y.s) < least(x.e, y.e) END AS changed,
  substr('{REFERENCE}', 1, x.pos) || x.alt || substr('{REFERENCE}', x.pos + length(x.ref) + 1) = substr('{REFERENCE}', 1, y.pos) || y.alt || substr('{REFERENCE}', y.pos + length(y.ref) + 1) AS one
  FROM t x JOIN t y ON x.brand = y.brand AND x.id < y.id AND x.pos < y.pos + length(y.ref) AND y.pos < x.pos + length(x.ref))
SELECT id_a, id_b, changed OR one AS conflict FROM p""")
def allele_conflicts(spark, d):
    """Pairs of a brand's alleles whose reference spans overlap, and whether they exclude each other."""
    rows, n = alleles(spark, d), partitions(spark)
    what = ["brand", "pos", "ref", "alt", "end"]
    # Equal alleles are judged once, and the verdicts of distinct ones dealt to all pairs of ids, which are the result. Two kinds meet once:
    # which stands first does not matter to the verdict, as all references are cut from one.
    kinds = materialize(rows.select(*what).distinct().withColumn("kind", F.monotonically_increasing_id()), "alleles")
    a, b = (kinds.toDF(*(f"{p}_{c}" for c in kinds.columns)) for p in "ab")
    bad = H.conflict(*(F.col(c) for c in ("a_pos", "a_ref", "a_alt", "b_pos", "b_ref", "b_alt")))
    meet = I.overlap_join(a, b, ("a_brand", "b_brand"), ("a_pos", "a_end"), ("b_pos", "b_end"), 8).where("a_kind <= b_kind")
    judged = materialize(meet.repartition(n).select("a_kind", "b_kind", bad.alias("conflict")), "conflicts")
    known = materialize(rows.join(kinds, what).select("id", "kind"), "kinds")
    # few bytes make many pairs, so they are dealt over all tasks, whatever they weigh
    left = known.select(F.col("id").alias("x"), F.col("kind").alias("a_kind")).join(judged, "a_kind").repartition(n, "b_kind")
    right = known.select(F.col("id").alias("y"), F.col("kind").alias("b_kind_")).repartition(n, "b_kind_")
    pairs = left.join(right, (F.col("b_kind") == F.col("b_kind_")) & (F.col("x") != F.col("y")) & ((F.col("a_kind") < F.col("b_kind")) | (F.col("x") < F.col("y"))))
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "conflict")
