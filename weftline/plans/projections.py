"""The driver's star-schema and text tables read as fact tables of the contract graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPLIER_BASE, CUSTOMER_BASE = 1_000_000_000_000, 2_000_000_000_000
ROWS_PER_TASK = 4_000


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A narrow table whose rows mean much work, dealt over tasks of about ``ROWS_PER_TASK`` rows: its few bytes
    would be one split."""
    rows = read(spark, sf, name)
    return rows.repartition(-(-rows.count() // ROWS_PER_TASK) or 1, key)


def part_nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "part")
    repo = (F.col("p_partkey") % 25).cast("int")
    kind = F.when(F.col("p_size") % 5 == 0, "interface").when(F.col("p_size") % 5 == 1, "http_endpoint").when(F.col("p_size") % 5 == 2, "grpc_method").otherwise("service_class")
    path = F.concat(F.lit("/r"), repo, F.when(F.col("p_partkey") % 7 == 0, F.lit("/tests/")).otherwise(F.lit("/src/")), F.col("p_brand"), F.lit("/f"), F.col("p_partkey") % 200, F.lit(".java"))
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"), path.alias("file_path"),
        F.col("p_size").cast("int").alias("line_start"), (F.col("p_size") + 5).cast("int").alias("line_end"),
        F.col("p_brand").alias("package"), repo.alias("repo_id"),
        F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"),
    )


def supplier_nodes(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    return s.select(
        (F.col("s_suppkey") + SUPPLIER_BASE).alias("id"), F.col("s_name").alias("name"), F.lit("service_class").alias("kind"),
        F.concat(F.lit("/r"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 6 == 0, F.lit("/tests/s")).otherwise(F.lit("/src/s")), F.col("s_suppkey") % 40, F.lit(".java")).alias("file_path"),
        F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.concat(F.lit("pkg"), F.col("s_suppkey") % 12).alias("package"),
        F.col("s_nationkey").cast("int").alias("repo_id"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"),
    )


def import_facts(spark: SparkSession, sf: str) -> DataFrame:
    line = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey")
    part = read(spark, sf, "part").select("p_partkey", "p_name")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", F.col("p_name").alias("target")).distinct()
    return rows.select((F.col("l_suppkey") + SUPPLIER_BASE).alias("node_id"), "target")


def producers(spark: SparkSession, sf: str) -> DataFrame:
    """A supplier's site for a part produces the part's topic."""
    line = read(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()  # narrow keys: less to hold than sites
    node = F.col("l_suppkey") * 1_000_000 + F.col("l_partkey") + SUPPLIER_BASE
    return line.select(node.alias("node_id"), F.concat(F.lit("f"), (F.col("l_suppkey") * 37 + F.col("l_partkey")) % 500).alias("file_path"), F.concat(F.lit("part."), F.col("l_partkey")).alias("topic"), (F.col("l_suppkey") % 3 == 0).alias("heuristic"))


def consumers(spark: SparkSession, sf: str) -> DataFrame:
    """A customer of a part consumes the part's topic."""
    line = read(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    rows = line.join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select("o_custkey", "l_partkey").distinct()
    return rows.select((F.col("o_custkey") + CUSTOMER_BASE).alias("node_id"), F.concat(F.lit("f"), F.col("o_custkey") % 700).alias("file_path"), F.concat(F.lit("part."), F.col("l_partkey")).alias("topic"), (F.col("o_custkey") % 5 == 0).alias("heuristic"))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as documentation sections."""
    c = read(spark, sf, "conversations")
    return c.select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("file_path"), F.substring_index(F.col("text"), " ", 3).alias("title"),
        F.lit(1).alias("level"), F.col("turn").cast("int").alias("start_line"), F.col("turn").cast("int").alias("end_line"), F.col("text").alias("content"),
    )
