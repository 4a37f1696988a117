"""Readers and writers of sequence, graph, alignment, variant and interval files, as DataFrames.

All are text scans parsed by column expressions; '.gz' files are read as they are. Record order is kept as an increasing
number (ord), as order carries meaning in these formats. Filters on the parsed columns run in the scan's own stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions.sequences import cs_operations, path_name


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.rtrim(F.col("value")).alias("line"))


def _opt(c: Column, missing: str = ".") -> Column:
    """Null for the format's sign of a missing value."""
    return F.when(c != missing, c)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, descr, seq): name is the header's first word, sequences are upper case."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "^>", "").alias("v"))
    head, body = F.regexp_replace(F.substring_index("v", "\n", 1), "\r$", ""), F.when(F.contains("v", F.lit("\n")), F.expr("substr(v, locate('\n', v) + 1)")).otherwise("")
    parsed = raw.where(F.trim("v") != "").withColumn("head_", head).withColumn("seq", F.upper(F.regexp_replace(body, "\\s+", "")))
    return parsed.select("file", "ord", F.regexp_extract("head_", "^(\\S+)", 1).alias("name"), F.trim(F.regexp_replace("head_", "^\\S+", "")).alias("descr"), "seq")


def described(df: DataFrame) -> DataFrame:
    """df with the k=v pairs of its descriptions as a map."""
    return df.withColumn("tags", F.str_to_map("descr", F.lit(" "), F.lit("=")))


def read_msa(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, descr, aligned) of aligned FASTA or PIR: '.' is a gap too, PIR's type line and '*' are dropped."""
    pir = F.regexp_extract("name", "^[A-Z][A-Z0-9];(\\S+)", 1)
    df = read_fasta(spark, path)
    return df.select("file", "ord", F.when(pir != "", pir).otherwise(F.col("name")).alias("name"), "descr", F.regexp_replace(F.translate("seq", ".", "-"), "\\*$", "").alias("aligned"))


def read_gfa(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (file, node, seq), edges (file, src, src_rev, dst, dst_rev), steps (file, path, step, node, rev), walks (file, path, sample, haplotype, contig, start, end, weight).

    Names of walks that occur again get #2, #3, ... in file order.
    """
    rows = _lines(spark, path).withColumn("f", F.split("line", "\t")).withColumn("kind", F.substr("line", F.lit(1), F.lit(1)))
    get = lambda i: F.get("f", F.lit(i))
    nodes = rows.where("kind = 'S'").select("file", get(1).alias("node"), F.upper(get(2)).alias("seq"))
    edges = rows.where("kind = 'L'").select("file", get(1).alias("src"), (get(2) == "-").alias("src_rev"), get(3).alias("dst"), (get(4) == "-").alias("dst_rev"))
    p = rows.where("kind = 'P'").select("file", "ord", get(1).alias("path"), F.split(get(2), ",").alias("parts"))
    steps_p = p.select("file", "path", F.posexplode("parts").alias("step", "s")).select("file", "path", "step", F.regexp_extract("s", "^(.*)[+-]$", 1).alias("node"), F.endswith("s", F.lit("-")).alias("rev"))
    name = F.concat(get(1), F.lit("#"), get(2), F.lit("#"), get(3), F.when(get(4) != "*", F.concat(F.lit("["), get(4), F.lit("]"))).otherwise(""))
    from pyspark.sql import Window as W

    w = rows.where("kind = 'W'").select("file", "ord", name.alias("name"), get(1).alias("sample"), get(2).alias("haplotype"), get(3).alias("contig"), _opt(get(4), "*").cast("long").alias("start"), _opt(get(5), "*").cast("long").alias("end"), get(6).alias("walk"), F.coalesce(F.nullif(F.regexp_extract("line", "\tWT:i:(\\d+)", 1), F.lit("")).cast("long"), F.lit(1)).alias("weight"))
    nth = F.row_number().over(W.partitionBy("file", "name").orderBy("ord"))
    w = w.withColumn("path", F.concat("name", F.when(nth > 1, F.concat(F.lit("#"), nth.cast("string"))).otherwise("")))
    steps_w = w.select("file", "path", F.posexplode(F.regexp_extract_all("walk", F.lit("([<>][^<>]+)"), F.lit(1))).alias("step", "s")).select("file", "path", "step", F.expr("substr(s, 2)").alias("node"), F.startswith("s", F.lit("<")).alias("rev"))
    return {"nodes": nodes, "edges": edges, "steps": steps_p.unionByName(steps_w), "walks": w.select("file", "path", "sample", "haplotype", "contig", "start", "end", "weight")}


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of 12 fields at least: name, spans, steps array<struct<node, rev>>, mapq, cs, mate, tags map. '*' is 0 or empty."""
    rows = _lines(spark, path).where(~F.startswith("line", F.lit("@"))).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 12)
    num = lambda i: F.coalesce(F.get("f", F.lit(i)).try_cast("long"), F.lit(0))
    steps = F.transform(F.regexp_extract_all(F.get("f", F.lit(5)), F.lit("([<>][^<>]+)"), F.lit(1)), lambda s: F.struct(F.substr(s, F.lit(2), F.length(s)).alias("node"), s.startswith("<").alias("rev")))
    tags = F.map_from_entries(F.transform(F.filter(F.slice("f", F.lit(13), F.size("f")), lambda t: t.rlike("^..:.:")), lambda t: F.struct(F.substr(t, F.lit(1), F.lit(2)), F.substr(t, F.lit(6), F.length(t)))))
    df = rows.select("file", "ord", F.get("f", F.lit(0)).alias("name"), num(1).alias("qlen"), num(2).alias("qs"), num(3).alias("qe"), steps.alias("steps"), num(6).alias("plen"), num(7).alias("ps"), num(8).alias("pe"), num(11).alias("mapq"), tags.alias("tags"))
    mate = F.when(F.map_contains_key("tags", F.lit("fn")), 1).when(F.map_contains_key("tags", F.lit("fp")), 2).otherwise(0)
    return df.withColumn("cs", F.try_element_at("tags", F.lit("cs"))).withColumn("mate", mate).withColumn("ops", cs_operations(F.col("cs")))


def read_vcf(spark: SparkSession, path: str, sample: int = 0) -> DataFrame:
    """(file, ord, chrom, pos, end, id, ref, alts, filter, gt, phased, ps): end from INFO for symbolic alleles; missing alleles are null."""
    rows = _lines(spark, path).where(~F.startswith("line", F.lit("#"))).withColumn("f", F.split("line", "\t")).where(F.size("f") >= 8)
    get = lambda i: F.get("f", F.lit(i))
    end = F.nullif(F.regexp_extract(get(7), "(?:^|;)END=(\\d+)", 1), F.lit("")).cast("long")
    keys, values = F.split(get(8), ":"), F.split(get(9 + sample), ":")
    of = lambda k: F.get(values, (F.array_position(keys, F.lit(k)) - 1).cast("int"))
    gt = F.when(F.array_contains(keys, "GT"), of("GT"))
    return rows.select(
        "file", "ord", get(0).alias("chrom"), get(1).cast("long").alias("pos"),
        F.when(get(4).contains("<"), F.coalesce(end, get(1).cast("long") + F.length(get(3)) - 1)).otherwise(get(1).cast("long") + F.length(get(3)) - 1).alias("end"),
        _opt(get(2)).alias("id"), F.upper(get(3)).alias("ref"), F.split(get(4), ",").alias("alts"), get(6).alias("filter"),
        F.transform(F.split(gt, "[|/]"), lambda a: a.try_cast("int")).alias("gt"), F.coalesce(F.contains(gt, F.lit("|")), F.lit(False)).alias("phased"), F.when(F.array_contains(keys, "PS"), _opt(of("PS"))).alias("ps"),
    )


def overlapping(records: DataFrame, chrom: str, low: int, high: int) -> DataFrame:
    """Records whose reference span overlaps [low, high], from 1, both ends in."""
    return records.where((F.col("chrom") == chrom) & (F.col("pos") <= high) & (F.col("end") >= low))


def read_bed(spark: SparkSession, path: str, names: tuple[str, ...] = ("id",)) -> DataFrame:
    """(contig, start0, end0, names ...): comments and track lines are left out, '.' is null."""
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser|\\s*$)")).withColumn("f", F.split("value", "\t"))
    return rows.select(F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).cast("long").alias("start0"), F.get("f", F.lit(2)).cast("long").alias("end0"), *(_opt(F.get("f", F.lit(3 + i))).alias(n) for i, n in enumerate(names)))


def motif_period(name: Column) -> Column:
    """The length of MOTIF in (MOTIF)n; null for other names."""
    m = F.regexp_extract(name, "^\\(([A-Za-z]+)\\)n", 1)
    return F.when(m != "", F.length(m))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, seq, quality) of four-line records."""
    raw = spark.read.option("lineSep", "\n@").text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "(?s)^@(?=[^\n]+\n[A-Za-z]*\n\\+)", "").alias("v"))
    # a quality line may begin with '@': such a piece has no '+' line, and belongs to the one before
    from pyspark.sql import Window as W

    whole = raw.withColumn("new_", F.col("v").rlike("(?s)^[^\n]+\n[A-Za-z]*\n\\+").cast("int")).withColumn("rec_", F.sum("new_").over(W.partitionBy("file").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)))
    joined = whole.groupBy("file", "rec_").agg(F.min("ord").alias("ord"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "v"))), lambda x: x["v"]), "\n@").alias("v")).withColumn("f", F.split("v", "\r?\n"))
    return joined.select("file", "ord", F.regexp_extract(F.get("f", F.lit(0)), "^(\\S+)", 1).alias("name"), F.upper(F.get("f", F.lit(1))).alias("seq"), F.get("f", F.lit(3)).alias("quality"))


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A tab-separated table with a header; '.' is null."""
    reader = spark.read.option("sep", "\t").option("header", True).option("nullValue", ".")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON documents, one a file, with their file and method (the folder); broken ones keep their text in _corrupt_record."""
    reader = spark.read.option("multiLine", True).option("mode", "PERMISSIVE")
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn("method", F.element_at(F.split("file", "/"), -2))


def tagged_union(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """The rows of all tables, columns by name, with the table's tag; columns that one lacks are null there."""
    out = None
    for name, df in tables.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq", compression: str | None = None) -> None:
    text = df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))
    text.write.text(path, compression=compression)


def write_gfa(nodes: DataFrame, edges: DataFrame, steps: DataFrame, path: str) -> None:
    """GFA text; walks are P lines, their steps in order."""
    sign = lambda c: F.when(F.col(c), "-").otherwise("+")
    s = nodes.select(F.concat_ws("\t", F.lit("S"), F.col("node").cast("string"), "seq").alias("value"))
    e = edges.select(F.concat_ws("\t", F.lit("L"), F.col("src").cast("string"), sign("src_rev"), F.col("dst").cast("string"), sign("dst_rev"), F.lit("0M")).alias("value"))
    walks = steps.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", F.concat(F.col("node").cast("string"), sign("rev")).alias("s")))), lambda x: x["s"]), ",").alias("w"))
    p = walks.select(F.concat_ws("\t", F.lit("P"), "path", "w", F.lit("*")).alias("value"))
    head = nodes.sparkSession.createDataFrame([("H\tVN:Z:1.0",)], "value string")
    head.unionByName(s).unionByName(e).unionByName(p).write.text(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("nullValue", ".").csv(path)


__all__ = [n for n in dir() if n.startswith(("read_", "write_"))] + ["described", "motif_period", "overlapping", "path_name", "tagged_union"]
