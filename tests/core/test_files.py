"""Readers and writers on small files."""

import gzip

from pyspark.sql import functions as F

from braidwork.functions import sequences as S
from braidwork.operators import graphs as G
from braidwork.operators import haplotypes as H
from braidwork.operators import kmers as K
from braidwork.operators import msa as M
from braidwork.sources import files


def test_fasta_and_msa(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x=1 y=2\nacg\nTN\n>two\n\n>three\nA\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">zip\nacgt\n")
    got = [(r.name, r.descr, r.seq) for r in files.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("ord").collect()]
    assert got == [("one", "x=1 y=2", "ACGTN"), ("two", "", ""), ("three", "", "A")]
    assert files.read_fasta(spark, str(tmp_path / "b.fa.gz")).first().seq == "ACGT"
    assert files.described(files.read_fasta(spark, str(tmp_path / "a.fa"))).orderBy("ord").first().tags == {"x": "1", "y": "2"}
    (tmp_path / "m.pir").write_text(">P1;r1\nAC.G*\n>P1;r2\nA--G*\n")
    assert [(r.name, r.aligned) for r in files.read_msa(spark, str(tmp_path / "m.pir")).orderBy("ord").collect()] == [("r1", "AC-G"), ("r2", "A--G")]
    files.write_fasta(files.read_fasta(spark, str(tmp_path / "a.fa")), str(tmp_path / "out"))
    assert {(r.name, r.seq) for r in files.read_fasta(spark, str(tmp_path / "out")).collect()} == {("one", "ACGTN"), ("two", ""), ("three", "A")}


def test_graph_files(spark, tmp_path):
    text = "H\tVN:Z:1.0\nS\t1\tac\nS\t2\tG\nL\t1\t+\t2\t-\t0M\nP\tp\t1+,2-\t*\nW\ts\t1\tc\t0\t3\t>1<2\tWT:i:4\nW\ts\t1\tc\t0\t3\t>1\n"
    (tmp_path / "g.gfa").write_text(text)
    g = files.read_gfa(spark, str(tmp_path / "g.gfa"))
    assert {tuple(r) for r in g["nodes"].select("node", "seq").collect()} == {("1", "AC"), ("2", "G")}
    assert [tuple(r) for r in g["edges"].drop("file").collect()] == [("1", False, "2", True)]
    assert {(r.path, r.weight) for r in g["walks"].collect()} == {("s#1#c[0]", 4), ("s#1#c[0]#2", 1)}
    spelt = {r.path: r.seq for r in G.spelled(g["steps"], g["nodes"], "path", "step").collect()}
    assert spelt == {"p": "ACC", "s#1#c[0]": "ACC", "s#1#c[0]#2": "AC"}
    files.write_gfa(g["nodes"], g["edges"], g["steps"].where("path = 'p'"), str(tmp_path / "out"))
    again = files.read_gfa(spark, str(tmp_path / "out"))
    assert again["steps"].where("path = 'p'").count() == 2


def test_alignments_variants_intervals(spark, tmp_path):
    (tmp_path / "a.gaf").write_text("@head\nr1\t5\t0\t5\t+\t>1<2\t9\t1\t6\t5\t5\t60\tcs:Z::2*ag+t:1\tfn:Z:x\nshort\t1\n")
    r = files.read_gaf(spark, str(tmp_path / "a.gaf")).collect()
    assert len(r) == 1
    assert (r[0].mapq, r[0].mate, r[0].cs, [tuple(s) for s in r[0].steps]) == (60, 1, ":2*ag+t:1", [("1", False), ("2", True)])
    assert r[0].ops == [":2", "*ag", "+t", ":1"]
    (tmp_path / "v.vcf").write_text("##x\n#CHROM\nc\t5\t.\tAC\tA,<DEL>\t.\tPASS\tEND=9;X=1\tGT:PS\t0|1:7\nc\t20\tid\tG\tT\t.\tq\t.\tGT\t./1\n")
    v = files.read_vcf(spark, str(tmp_path / "v.vcf")).orderBy("pos").collect()
    assert (v[0].end, v[0].gt, v[0].phased, v[0].ps, v[0].id) == (9, [0, 1], True, "7", None)
    assert (v[1].gt, v[1].phased, v[1].ps) == ([None, 1], False, None)
    assert files.overlapping(files.read_vcf(spark, str(tmp_path / "v.vcf")), "c", 8, 10).count() == 1
    (tmp_path / "b.bed").write_text("#c\nc\t1\t5\t(AC)n\nc\t7\t9\t.\n")
    b = files.read_bed(spark, str(tmp_path / "b.bed")).withColumn("period", files.motif_period(F.col("id"))).orderBy("start0").collect()
    assert [(x.start0, x.id, x.period) for x in b] == [(1, "(AC)n", 2), (7, None, None)]
    (tmp_path / "q.fq").write_text("@r1 x\nACG\n+\n@II\n@r2\nTT\n+\n@@\n")
    assert [(x.name, x.seq, x.quality) for x in files.read_fastq(spark, str(tmp_path / "q.fq")).orderBy("ord").collect()] == [("r1", "ACG", "@II"), ("r2", "TT", "@@")]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()[0]


def test_sequence_functions(spark):
    lit = F.lit
    mask = lambda s, n=1: one(spark, S.masked(lit(s), n))
    assert (mask("ACNNNGT").seq, [tuple(r) for r in mask("ACNNNGT").runs]) == ("ACGT", [(2, "NNN")])
    assert (mask("NNACGTRN").seq, [tuple(r) for r in mask("NNACGTRN").runs]) == ("ACGT", [(0, "NN"), (4, "RN")])
    assert (mask("ACNGTNNNA", 2).seq, [tuple(r) for r in mask("ACNGTNNNA", 2).runs]) == ("ACNGTA", [(5, "NNN")])
    assert (mask("NNNN").seq, [tuple(r) for r in mask("NNNN").runs]) == ("", [(0, "NNNN")])
    for a, b, cost in (("ACGT", "AGGT", 4), ("ACGTAC", "A----C", 12), ("A" * 30, "A" + "-" * 28 + "A", 52)):
        assert one(spark, S.pair_cost(lit(a), lit(b))) == cost
    assert tuple(one(spark, S.trimmed(lit(10), lit("CAGT"), lit("CT")))) == (11, "AG", "")
    assert tuple(one(spark, S.trimmed(lit(10), lit("A"), lit("AA")))) == (10, "", "A")
    edits = F.array(F.struct(lit(4).alias("pos"), lit(0).alias("ref_length"), lit("TT").alias("alt")), F.struct(lit(1).alias("pos"), lit(2).alias("ref_length"), lit("").alias("alt")))
    assert one(spark, S.apply_edits(lit("ACGTA"), edits)) == "ATTTA"
    assert one(spark, S.same_event(lit("CAAAT"), lit(1), lit(1), lit(""), lit(3), lit(1), lit("")))
    assert one(spark, S.read_of(lit("ACGTA"), lit(":2*gt-t+cc:1"))) == "ACTCCA"
    assert one(spark, S.read_of(lit("ACGTA"), lit(":2"))) is None
    assert tuple(one(spark, S.cs_counts(lit(":2*gt-t+cc:1")))) == (3, 1, 2, 1)
    assert one(spark, S.reverse_complement(lit("AACGN"))) == "NCGTT"
    assert tuple(one(spark, S.path_name(lit("HG#1#chr1[77]")))) == ("HG", 1, "chr1", 77)
    assert [tuple(one(spark, S.anchor(lit(x)))) for x in (">12", "12-")] == [(12, False), (12, True)]
    assert [tuple(x) for x in one(spark, S.cigar_operations(lit("3=1X2D")))] == [(3, "="), (1, "X"), (2, "D")]
    effect = lambda p, r, a: one(spark, H.allele_effect(lit(p), lit(r), lit(a), lit(10), lit(14), lit("ACGTA"))).effect
    assert [effect(*x) for x in ((11, "C", "T"), (11, "G", "T"), (9, "A", "T"), (11, "C", "*"), (11, "C", "<DEL>"), (10, "A", "AT"), (14, "A", "AT"))] == ["ok", "ref_mismatch", "outside", "star", "symbolic", "ok", "ok"]


def test_alleles_clipped_to_a_span(spark):
    """Span 10 to 19 of reference ACGTTGCAAC: deletions and replacements over its edges, insertions at them, padding alone inside."""
    cases = [
        (5, "NNNNNACGTT", "N", ("ok", True, 10, "ACGTT", "")), (18, "ACAA", "GG", ("ok", True, 18, "AC", "")), (18, "ACAA", "GGTTCC", ("ok", True, 18, "AC", "GGTT")),
        (19, "CA", "CTTTA", ("edge_insertion", False, None, None, None)), (19, "C", "CTTT", ("ok", False, 20, "", "TTT")), (19, "CACGT", "C", ("outside", False, None, None, None)),
        (9, "ACGT", "A", ("ref_mismatch", False, None, None, None)), (9, "TA", "T", ("ok", False, 10, "A", "")), (11, "C", None, ("no_allele", False, None, None, None)), (11, "C", "x", ("symbolic", False, None, None, None)),
    ]
    rows = spark.createDataFrame([(i, p, r, a) for i, (p, r, a, _) in enumerate(cases)], "i int, pos int, ref string, alt string")
    made = rows.select("i", H.allele_effect(F.col("pos"), F.col("ref"), F.col("alt"), F.lit(10), F.lit(19), F.lit("ACGTTGCAAC")).alias("x")).collect()
    assert {r.i: tuple(r.x) for r in made} == {i: want for i, (*_, want) in enumerate(cases)}


def test_kmer_excess_golden_case(spark):
    rows = lambda *x: spark.createDataFrame([(0, i, r) for i, r in enumerate(x)], "g int, row int, aligned string")
    assert M.kmer_excess(rows("ACGTTGCA--", "ACGTTGCA--"), "g", "row", "aligned", 4).first().extra == 0
    assert M.kmer_excess(rows("ACGTTGCA--", "--ACGTTGCA"), "g", "row", "aligned", 4).first().extra == 5
    assert K.counts(spark.createDataFrame([("a", "AC")], "g string, s string"), "g", "s", 4).count() == 0


def test_graph_rewrites(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 5), (5, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(1, "A"), (2, "C"), (3, "G"), (4, "T"), (5, "G")], "node long, seq string")
    merged, edges = G.unchopped(nodes, e)
    assert {tuple(r) for r in merged.collect()} == {(1, "AC"), (3, "G"), (5, "G"), (4, "T")}
    assert {tuple(r) for r in edges.collect()} == {(1, 3), (1, 5), (3, 4), (5, 4)}
    assert {tuple(r) for r in G.merge_siblings(nodes, e).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 3)}
    assert G.cyclic_nodes(e).count() == 0
    assert {r.node for r in G.cyclic_nodes(e.unionByName(spark.createDataFrame([(3, 2)], "src long, dst long"))).collect()} >= {2, 3}
    assert {tuple(r) for r in G.levels(e).collect()} == {(1, 0), (2, 1), (3, 2), (5, 2), (4, 3)}
    assert {r.node for r in G.between(e, spark.createDataFrame([(2,)], "node long"), spark.createDataFrame([(3,)], "node long")).collect()} == {2, 3}
