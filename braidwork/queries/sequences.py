"""Sequence queries: part names as sequences, brands as regions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.functions import sequences as S
from braidwork.operators import kmers as K
from braidwork.operators import msa as M
from braidwork.operators import windows as N
from braidwork.queries.base import query, table


def names(spark, d):
    return table(spark, d, "part").select("p_brand", "p_partkey", F.upper("p_name").alias("seq"))


@query("dedup_union_weights", """WITH g AS (SELECT p_brand, p_name, count(*)::BIGINT AS weight, list_sort(list(p_partkey)) AS members FROM part GROUP BY ALL)
SELECT p_brand, 'u' || lpad(row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, length(p_name), p_name)::VARCHAR, 4, '0') AS uid, p_name, weight, members FROM g""")
def dedup_union_weights(spark, d):
    """Distinct sequences of a region with their weights and members, numbered in a fixed order."""
    g = table(spark, d, "part").groupBy("p_brand", "p_name").agg(F.count("*").alias("weight"), F.sort_array(F.collect_list("p_partkey")).alias("members"))
    n = F.row_number().over(W.partitionBy("p_brand").orderBy(F.desc("weight"), F.length("p_name"), "p_name"))
    return g.select("p_brand", F.concat(F.lit("u"), F.lpad(n.cast("string"), 4, "0")).alias("uid"), "p_name", "weight", "members")


KMERS_SQL = "k AS (SELECT p_brand, p_partkey, i AS pos, substr(upper(p_name), i::INT, 3) AS kmer FROM part, unnest(generate_series(1, length(p_name) - 2)) t(i))"


@query("kmer_counts", f"WITH {KMERS_SQL} SELECT p_brand, kmer, count(*)::BIGINT AS n FROM k GROUP BY ALL")
def kmer_counts(spark, d):
    """F18, D16."""
    return K.counts(names(spark, d), "p_brand", "seq", 3)


@query("kmer_redundancy", f"""WITH {KMERS_SQL}, p AS (SELECT p_brand, kmer, p_partkey, count(*) AS n FROM k GROUP BY ALL), c AS (SELECT p_brand, kmer, max(n) AS copies FROM p GROUP BY ALL),
l AS (SELECT p_brand, kmer, count(DISTINCT pos) AS places FROM k GROUP BY ALL)
SELECT p_brand, sum(places)::BIGINT AS places, sum(copies)::BIGINT AS copies, sum(places - copies)::BIGINT AS extra FROM c JOIN l USING (p_brand, kmer) GROUP BY p_brand""")
def kmer_redundancy(spark, d):
    """Distinct places of k-mers beyond their most copies in one sequence."""
    return K.redundancy(K.positions(names(spark, d), ["p_brand", "p_partkey"], "seq", 3), "p_brand", "p_partkey", F.col("pos"))


#: Every pair of a brand's distinct names, with their k-mers (or hash bins of them), how many each has and how many they share.
OVERLAP_SQL = """u AS (SELECT p_brand, upper(p_name) AS s, count(*)::BIGINT AS w FROM part GROUP BY ALL), x AS (SELECT p_brand, s, substr(s, i::INT, 3) AS kmer FROM u, unnest(generate_series(1, length(s) - 2)) t(i)),
k AS (SELECT p_brand, s, {item} AS item, count(*)::BIGINT AS n FROM x GROUP BY ALL), t AS (SELECT p_brand, s, w, coalesce((SELECT sum(n) FROM k WHERE k.p_brand = u.p_brand AND k.s = u.s), 0)::BIGINT AS n FROM u),
m AS (SELECT a.p_brand, a.s AS id_a, b.s AS id_b, sum(least(a.n, b.n))::BIGINT AS least FROM k a JOIN k b ON a.p_brand = b.p_brand AND a.item = b.item AND a.s < b.s GROUP BY ALL),
o AS (SELECT a.p_brand, a.s AS id_a, b.s AS id_b, a.w AS w_a, b.w AS w_b, a.n AS n_a, b.n AS n_b, coalesce(m.least, 0) AS least FROM t a JOIN t b ON a.p_brand = b.p_brand AND a.s < b.s LEFT JOIN m ON m.p_brand = a.p_brand AND m.id_a = a.s AND m.id_b = b.s)"""
KMER_OVERLAP_SQL, BIN_OVERLAP_SQL = OVERLAP_SQL.format(item="kmer"), OVERLAP_SQL.format(item="('0x' || substr(md5(kmer), 1, 15))::BIGINT % 4096")
JACCARD_SQL = "CASE WHEN n_a + n_b > 0 THEN least::DOUBLE / (n_a + n_b - least)::DOUBLE ELSE 1.0 END"


@query("kmer_jaccard", f"WITH {KMER_OVERLAP_SQL} SELECT p_brand, id_a, id_b, {JACCARD_SQL} AS jaccard FROM o")
def kmer_jaccard(spark, d):
    """weighted Jaccard similarity of distinct names."""
    return K.jaccard(names(spark, d).select("p_brand", "seq").distinct().withColumn("id", F.col("seq")), "p_brand", "id", "seq", 3)


@query("variable_kmers", f"""WITH {KMERS_SQL}, n AS (SELECT p_brand, count(*) AS n FROM part GROUP BY ALL)
SELECT p_brand, kmer, count(DISTINCT p_partkey)::BIGINT AS carriers FROM k JOIN n USING (p_brand) GROUP BY p_brand, kmer, n HAVING count(DISTINCT p_partkey) < n""")
def variable_kmers(spark, d):
    """The union less the intersection of k-mer sets."""
    return K.variable_kmers(names(spark, d), "p_brand", "p_partkey", "seq", 3)


@query("kmer_medoids", f"""WITH {KMER_OVERLAP_SQL}, sides AS (SELECT p_brand, id_a AS id, w_b * (1 - {JACCARD_SQL}) AS c FROM o UNION ALL SELECT p_brand, id_b, w_a * (1 - {JACCARD_SQL}) FROM o),
c AS (SELECT u.p_brand, u.s AS id, round(coalesce(sum(c), 0.0), 9) AS c FROM u LEFT JOIN sides ON sides.p_brand = u.p_brand AND sides.id = u.s GROUP BY u.p_brand, u.s)
SELECT p_brand, arg_min(id, {{'c': c, 'id': id}}) AS medoid FROM c GROUP BY p_brand""")
def kmer_medoids(spark, d):
    """A29."""
    g = names(spark, d).groupBy("p_brand", "seq").agg(F.count("*").alias("weight"))
    return K.medoids(g.withColumn("id", F.col("seq")), "p_brand", "id", "seq", "weight", 3)


@query("kmer_sketch", f"WITH {KMERS_SQL}, h AS (SELECT DISTINCT p_brand, ('0x' || substr(md5(kmer), 1, 15))::BIGINT AS hash FROM k) SELECT * FROM h WHERE hash % 4 = 0")
def kmer_sketch(spark, d):
    """F19."""
    return K.sketch(names(spark, d), "p_brand", "seq", 3, 4)


@query("binned_kmer_distance", f"WITH {BIN_OVERLAP_SQL} SELECT p_brand, id_a, id_b, n_a + n_b - 2 * least AS l1 FROM o")
def binned_kmer_distance(spark, d):
    """F21."""
    return K.binned_distance(names(spark, d).select("p_brand", "seq").distinct().withColumn("id", F.col("seq")), "p_brand", "id", "seq", 3)


@query("occurrence_tokens", f"WITH {KMERS_SQL} SELECT p_partkey, kmer, pos::BIGINT AS pos, row_number() OVER (PARTITION BY p_partkey, kmer ORDER BY pos)::BIGINT AS occurrence FROM k")
def occurrence_tokens(spark, d):
    """The j-th copy of a k-mer is a token of its own."""
    p = K.positions(names(spark, d), "p_partkey", "seq", 3).withColumn("pos", F.col("pos").cast("long") + 1)
    return N.occurrence(p, ["p_partkey", "kmer"], "pos")


@query("pair_edit_cost", """WITH u AS (SELECT DISTINCT p_brand, p_name FROM part), p AS (SELECT a.p_brand, a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS d FROM u a JOIN u b ON a.p_brand = b.p_brand AND a.p_name < b.p_name)
SELECT p_brand, count(*)::BIGINT AS pairs, sum(d)::BIGINT AS cost, sum(greatest(length(a), length(b)))::BIGINT AS longest, sum(d)::DOUBLE / sum(greatest(length(a), length(b)))::DOUBLE AS ratio FROM p GROUP BY p_brand""")
def pair_edit_cost(spark, d):
    """Edit distances over all pairs of distinct sequences of a region, as a ratio of sums."""
    u = table(spark, d, "part").select("p_brand", "p_name").distinct()
    a, b = u.select(F.col("p_brand"), F.col("p_name").alias("a")), u.select(F.col("p_brand").alias("brand_b"), F.col("p_name").alias("b"))
    p = a.join(b, (F.col("p_brand") == F.col("brand_b")) & (F.col("a") < F.col("b"))).withColumn("d", F.levenshtein("a", "b")).withColumn("m", F.greatest(F.length("a"), F.length("b")))
    return p.groupBy("p_brand").agg(F.count("*").alias("pairs"), F.sum("d").alias("cost"), F.sum("m").alias("longest"), (F.sum("d").cast("double") / F.sum("m")).alias("ratio"))


@query("reverse_complements", "SELECT p_partkey, reverse(translate(regexp_replace(upper(p_name), '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA')) AS rc FROM part")
def reverse_complements(spark, d):
    """F1, and the letter rule."""
    return names(spark, d).select("p_partkey", S.reverse_complement(S.letters(F.col("seq"))).alias("rc"))


@query("masked_runs", "SELECT p_partkey, regexp_replace(upper(p_name), '[^ACGT]+', '', 'g') AS seq, len(regexp_extract_all(upper(p_name), '[^ACGT]+'))::INT AS n FROM part")
def masked_runs(spark, d):
    """runs of other letters cut out."""
    return names(spark, d).select("p_partkey", S.masked(F.col("seq")).alias("m")).select("p_partkey", F.col("m.seq").alias("seq"), F.size("m.runs").alias("n"))


@query("trimmed_alleles", """WITH p AS (SELECT p_partkey, p_name AS r, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS a FROM part),
t AS (SELECT *, len(list_filter(range(1, least(length(r), length(a)) + 1), lambda x: right(r, x) = right(a, x))) AS k FROM p WHERE a IS NOT NULL), h AS (SELECT p_partkey, left(r, length(r) - k) AS r1, left(a, length(a) - k) AS a1 FROM t),
c AS (SELECT *, len(list_filter(range(1, least(length(r1), length(a1)) + 1), lambda x: left(r1, x) = left(a1, x))) AS j FROM h) SELECT p_partkey, (1 + j)::INT AS pos, substr(r1, j + 1) AS ref, substr(a1, j + 1) AS alt FROM c""")
def trimmed_alleles(spark, d):
    """neighbouring names of a brand as reference and alternative."""
    nxt = F.lead("p_name").over(W.partitionBy("p_brand").orderBy("p_partkey"))
    p = table(spark, d, "part").withColumn("alt", nxt).where("alt IS NOT NULL")
    return p.select("p_partkey", S.trimmed(F.lit(1), F.col("p_name"), F.col("alt")).alias("t")).select("p_partkey", "t.*")


CELLS_SQL = "c AS (SELECT p_brand, p_partkey AS row, i - 1 AS col, substr(rpad(upper(p_name), 14, '-'), i::INT, 1) AS ch FROM part, unnest(generate_series(1, 14)) t(i))"


WIDTH = 14


def cells_of(parts):
    return M.cells(parts.withColumn("aligned", F.rpad(F.upper("p_name"), WIDTH, "-")), "p_brand", "p_partkey", "aligned")


def cells(spark, d):
    return cells_of(table(spark, d, "part"))


#: Cells of names to their ends. Rows are not filled up with gaps: blocks and pairs of positions are made of bases alone.
WHOLE_CELLS_SQL = "c AS (SELECT p_brand, p_partkey AS row, i - 1 AS col, substr(upper(p_name), i::INT, 1) AS ch FROM part, unnest(generate_series(1, length(upper(p_name)))) t(i))"


def whole_cells(spark, d):
    return M.cells(names(spark, d), "p_brand", "p_partkey", "seq")


@query("consensus_columns", f"""WITH {CELLS_SQL}, n AS (SELECT p_brand, col, ch, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, col ORDER BY ch = '-', n DESC, ch) AS r FROM n)
SELECT p_brand, col::INT AS col, CASE WHEN ch <> '-' THEN ch END AS ch FROM k WHERE r = 1""")
def consensus_columns(spark, d):
    """A26."""
    return M.consensus(cells(spark, d), "p_brand")


@query("majority_consensus", f"""WITH {CELLS_SQL}, n AS (SELECT p_brand, col, ch, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY p_brand, col) AS a, sum(CASE WHEN ch <> '-' THEN n END) OVER (PARTITION BY p_brand, col) AS b FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, col ORDER BY n DESC, ch) AS r FROM t WHERE ch <> '-' AND b >= 0.5 * a)
SELECT p_brand, string_agg(ch, '' ORDER BY col) AS seq FROM k WHERE r = 1 GROUP BY p_brand""")
def majority_consensus(spark, d):
    """A27."""
    return M.weighted_consensus(cells(spark, d).withColumn("w", F.lit(1)), "p_brand", "w", 0.5)


@query("alignment_medoid", f"""WITH {CELLS_SQL}, x AS (SELECT p_brand, row, sum(a - b) AS cost FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, col) AS a, count(*) OVER (PARTITION BY p_brand, col, ch) AS b FROM c) GROUP BY ALL)
SELECT p_brand, row, cost::BIGINT AS cost FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cost, row) AS r FROM x) WHERE r = 1""")
def alignment_medoid(spark, d):
    """A28."""
    return M.medoid(cells(spark, d), "p_brand")


@query("sum_of_pairs", f"WITH {CELLS_SQL} SELECT a.p_brand, count(*) FILTER (a.ch <> b.ch)::BIGINT AS cost FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.col = b.col AND a.row < b.row GROUP BY a.p_brand")
def sum_of_pairs(spark, d):
    """In closed form, from column counts."""
    return M.sum_of_pairs(cells(spark, d), "p_brand")


@query("column_complexity", f"""WITH {CELLS_SQL}, b AS (SELECT * FROM c WHERE ch <> '-'), e AS (SELECT p_brand, col, ch, lead(col) OVER w AS c2, lead(ch) OVER w AS h2 FROM b WINDOW w AS (PARTITION BY p_brand, row ORDER BY col))
SELECT p_brand, columns, bases, edges FROM (SELECT p_brand, count(DISTINCT col)::BIGINT AS columns, count(DISTINCT (col, ch))::BIGINT AS bases FROM b GROUP BY 1) JOIN (SELECT p_brand, count(DISTINCT (col, ch, c2, h2))::BIGINT AS edges FROM e WHERE c2 IS NOT NULL GROUP BY 1) USING (p_brand)""")
def column_complexity(spark, d):
    """Nodes and edges of the graph of columns and bases."""
    return M.complexity(cells(spark, d), "p_brand")


@query("gap_fragments", f"""WITH {CELLS_SQL}, g AS (SELECT p_brand, row, min(col) AS lo, max(col) AS hi FROM (SELECT *, col - row_number() OVER (PARTITION BY row ORDER BY col) AS k FROM c WHERE ch = '-') GROUP BY p_brand, row, k)
SELECT p_brand, count(*)::BIGINT AS runs, count(DISTINCT (lo, hi))::BIGINT AS distinct_runs FROM g GROUP BY p_brand""")
def gap_fragments(spark, d):
    """A48, W5."""
    return M.gap_fragments(cells(spark, d), "p_brand")


@query("drop_gap_columns", f"""WITH {CELLS_SQL}, k AS (SELECT *, max((ch <> '-')::INT) OVER (PARTITION BY p_brand, col) AS x FROM c)
SELECT p_brand, row, string_agg(ch, '' ORDER BY col) AS aligned FROM k WHERE x = 1 GROUP BY p_brand, row""")
def drop_gap_columns(spark, d):
    """rows without the columns that hold no base."""
    return M.rows_of(M.drop_gap_columns(cells(spark, d), "p_brand"), "p_brand")


@query("msa_blocks", f"""WITH {WHOLE_CELLS_SQL}, k AS (SELECT p_brand, col, coalesce(list(row ORDER BY row) FILTER (ch <> '-'), []) AS s FROM c GROUP BY ALL), m AS (SELECT *, s IS DISTINCT FROM lag(s) OVER (PARTITION BY p_brand ORDER BY col) AS fresh FROM k),
b AS (SELECT p_brand, col, sum(fresh::INT) OVER (PARTITION BY p_brand ORDER BY col) AS block FROM m), t AS (SELECT p_brand, block, row, string_agg(ch, '' ORDER BY col) AS seq FROM c JOIN b USING (p_brand, col) WHERE ch <> '-' GROUP BY ALL)
SELECT p_brand, block::BIGINT AS block, seq, count(*)::INT AS n FROM t GROUP BY ALL""")
def msa_blocks(spark, d):
    """Blocks and their distinct strings."""
    return M.block_spellings(whole_cells(spark, d), "p_brand").groupBy("p_brand", "block", "seq").agg(F.count("*").cast("int").alias("n"))


@query("position_pairs", f"""WITH {WHOLE_CELLS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY col) - 1 AS pos FROM c WHERE ch <> '-')
SELECT a.p_brand, count(*)::BIGINT AS n, sum(a.pos * b.pos)::BIGINT AS s FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.col = b.col AND a.row < b.row GROUP BY a.p_brand""")
def position_pairs(spark, d):
    """Aligned position pairs, as counts and sums, in closed form."""
    return M.position_pair_sums(whole_cells(spark, d), "p_brand")
