"""Graphs read from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.operators.graph import Graph, dedup, symmetrize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pairs(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    """Raw edges (src, dst, ts): each order's customer and the part of its first line, modulo the nodes, by order day."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).alias("ts"))
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(F.pmod("o_custkey", F.lit(modulus)).cast("int").alias("src"), F.pmod("l_partkey", F.lit(modulus)).cast("int").alias("dst"), "ts")


def customer_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The symmetric graph of order_pairs over customers' ids."""
    n = table(spark, sf_dir, "customer").count()
    return Graph(dedup(symmetrize(order_pairs(spark, sf_dir, n))), n)


def vector_graph(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    """The symmetric graph of order_pairs over the embeddings' ids, and the embeddings (id, embedding)."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("id"), "embedding")
    n = vectors.count()
    return Graph(dedup(symmetrize(order_pairs(spark, sf_dir, n))), n), vectors


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bipartite edges (src, dst) from customers to suppliers, whose ids follow the customers'."""
    n = table(spark, sf_dir, "customer").count()
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("int").alias("src"), (F.col("l_suppkey") + n).cast("int").alias("dst"))
