"""Distributed union-find: alternating large-star and small-star contraction.

Every round is two aggregations and two joins on a node id, so a node with very many
links is pre-aggregated before the shuffle and its join side is split by adaptive
execution.  Nothing is collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import cut


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest reachable node.

    Null ends and self-links are ignored; repeated and reversed links count once; no
    links give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    state = cut(pairs.distinct())
    seen = None
    while True:
        both = state.union(state.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(floor.select("u", "m"))
        )
        state = cut(small.where("u > v").distinct())
        now = state.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if now == seen or not now["n"]:
            break
        seen = now
    roots = state.select(F.col("v").alias("u"), F.col("v"))
    return state.union(roots.distinct()).toDF("node", "component")
