"""Walks over ordered steps: orders are paths, parts are nodes, part sizes are node lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from braidwork.queries.base import query, table

STEP_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]

STEPS_SQL = """steps AS (
  SELECT l_orderkey AS path, l_partkey AS node, p_size::BIGINT AS len,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS step
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def order_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """steps(path, node, len, step): the walk of each order over its parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *STEP_ORDER)
    nodes = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("len"))
    return (
        lines.join(nodes, lines.l_partkey == nodes.p_partkey)
        .withColumn("step", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*STEP_ORDER)))
        .select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("node"), "len", "step")
    )


@query("path_size_metrics", f"""WITH {STEPS_SQL}, linked AS (
  SELECT *, lead(node) OVER (PARTITION BY path ORDER BY step) AS nxt FROM steps)
SELECT path, count(*)::BIGINT AS n_steps, count(DISTINCT node)::BIGINT AS n_nodes,
       count(DISTINCT CASE WHEN nxt IS NOT NULL THEN least(node, nxt)::VARCHAR || '-' || greatest(node, nxt)::VARCHAR END)::BIGINT AS n_edges,
       sum(len)::BIGINT AS bp, round(1000.0::DOUBLE * count(DISTINCT node) / sum(len)::DOUBLE, 6) AS nodes_per_kb
FROM linked GROUP BY path""")
def path_size_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per path: steps, distinct nodes, distinct undirected edges, length, nodes per kb. One shuffle by path serves window and group."""
    steps = order_steps(spark, sf_dir).withColumn("nxt", F.lead("node").over(W.partitionBy("path").orderBy("step")))
    return (
        steps.groupBy("path")
        .agg(
            F.count("*").alias("n_steps"),
            F.size(F.collect_set("node")).cast("long").alias("n_nodes"),
            F.size(F.collect_set(F.when(F.col("nxt").isNotNull(), F.struct(F.least("node", "nxt"), F.greatest("node", "nxt"))))).cast("long").alias("n_edges"),
            F.sum("len").alias("bp"),
        )
        .withColumn("nodes_per_kb", F.round(1000.0 * F.col("n_nodes") / F.col("bp"), 6))
    )
