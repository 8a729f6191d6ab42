"""Readers for the shared relational tables and the views other operators take of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _node(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def parent_edges(spark: SparkSession, sf_dir: str, orders: bool = False) -> DataFrame:
    """(src, rel, dst) from parent to child: region, nation, then customer and supplier, and orders if asked for."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    parts = [
        nation.select(_node("R:", "n_regionkey").alias("src"), _node("N:", "n_nationkey").alias("dst")),
        customer.select(_node("N:", "c_nationkey").alias("src"), _node("C:", "c_custkey").alias("dst")),
        supplier.select(_node("N:", "s_nationkey").alias("src"), _node("S:", "s_suppkey").alias("dst")),
    ]
    if orders:
        parts.append(table(spark, sf_dir, "orders").select(_node("C:", "o_custkey").alias("src"), _node("O:", "o_orderkey").alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("src", F.lit("parent").alias("rel"), "dst")


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct related edges between suppliers and parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return lines.select(_node("S:", "l_suppkey").alias("src"), F.lit("related").alias("rel"), _node("P:", "l_partkey").alias("dst"))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, sha256, size) of a manifest whose files are the lines of orders."""
    line = table(spark, sf_dir, "lineitem")
    path = F.concat_ws("/", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    body = F.concat_ws("/", path, F.col("l_quantity").cast("long").cast("string"))
    return line.select("l_orderkey", path.alias("path"), F.sha2(body, 256).alias("sha256"), F.length(body).cast("long").alias("size"))
