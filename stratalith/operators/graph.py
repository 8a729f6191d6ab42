"""Graph walks over (src, rel, dst[, strength]) edges, one join of the frontier a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.lineage import cut


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both", rel: str | None = None) -> DataFrame:
    """(id, neighbour, rel) of the ``nodes`` (id)."""
    edges = edges.where(F.col("rel") == rel) if rel else edges
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), "rel")
    back = edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), "rel")
    both = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return both.join(nodes, "id", "left_semi")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, directed: bool = True) -> DataFrame:
    """(seed, id, steps) of the nodes within ``depth`` steps of each seed, itself at 0."""
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    if not directed:
        step = step.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("next")))
    step = step.distinct()
    seen = cut(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("steps")))
    frontier = seen
    for n in range(1, depth + 1):
        ahead = frontier.join(step, "id").select("seed", F.col("next").alias("id")).distinct()
        frontier = cut(ahead.join(seen, ["seed", "id"], "left_anti").withColumn("steps", F.lit(n)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_edges: int = 5) -> DataFrame:
    """(start, goal, path array<struct<rel, id>>, strength) of the shortest directed paths.

    Among equally short paths the least sequence of (rel, id) wins, as a walk that takes
    neighbours in that order finds it.  Strength multiplies along the path.
    The goals of a start share one walk, which ends with the last of them.
    """
    strength = F.col("strength") if "strength" in edges.columns else F.lit(1.0)
    step = edges.select(F.col("src").alias("at"), F.struct("rel", F.col("dst").alias("id")).alias("hop"), strength.alias("s"))
    hop = "array<struct<rel:string,id:string>>"
    none = [F.array().cast(hop).alias("path"), F.lit(1.0).alias("strength")]
    pairs = cut(pairs.select("start", "goal").distinct())
    found = pairs.where("start = goal").select("start", "goal", *none)
    missing = pairs.where("start <> goal")
    frontier = missing.select("start", F.col("start").alias("at")).distinct().select("start", "at", *none)
    seen = frontier.select("start", "at")
    for _ in range(max_edges):
        ahead = frontier.join(step, "at").select(
            "start", F.col("hop.id").alias("at"), F.concat("path", F.array(F.col("hop").cast("struct<rel:string,id:string>"))).alias("path"), (F.col("strength") * F.col("s")).alias("strength")
        )
        best = ahead.groupBy("start", "at").agg(F.min(F.struct("path", "strength")).alias("b")).select("start", "at", "b.path", "b.strength")
        frontier = cut(best.join(seen, ["start", "at"], "left_anti"))
        reached = frontier.withColumnRenamed("at", "goal")
        found = found.unionByName(missing.join(reached, ["start", "goal"]).select("start", "goal", "path", "strength"))
        missing = cut(missing.join(reached, ["start", "goal"], "left_anti"))
        seen = seen.unionByName(frontier.select("start", "at"))
        frontier = frontier.join(missing.select("start").distinct(), "start", "left_semi")
        if frontier.isEmpty():
            break
    return found.select("start", "goal", "path", "strength")


def common_neighbours(edges: DataFrame, nodes: list[str]) -> DataFrame:
    """Nodes next to every one of ``nodes``, in either direction."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    hits = both.where(F.col("src").isin(nodes)).groupBy("dst").agg(F.count_distinct("src").alias("n"))
    return hits.where(F.col("n") == len(set(nodes))).select(F.col("dst").alias("id"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, targets): the sorted (rel, dst) list of every node."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rel", "dst"))).alias("targets"))


def with_inverse(edges: DataFrame, rel: str, inverse: str) -> DataFrame:
    """Adds the inverse of each ``rel`` edge where it is absent."""
    new = edges.where(F.col("rel") == rel).select(F.col("dst").alias("src"), F.lit(inverse).alias("rel"), F.col("src").alias("dst"))
    return edges.unionByName(new.distinct().join(edges, ["src", "rel", "dst"], "left_anti"))
