"""Mixing sources to target weights by temperature.

A source with token share p gets the weight p**alpha / sum(p**alpha).  The exponent is
bisected, many exponents a pass over the source table, until the weights meet a target
entropy or the most repeated source a repetition limit.  A budget of tokens then gives
each source a quota: so many whole passes and a part of one more.  In every pass the
blocks of a source come in a keyed permutation of their own, and documents within a block
in hash order; the last pass stops where the quota is met.

Without a budget it is the least that shows every document at least once, so nothing is
lost.  A pass is cut at a place (block, hash) found per source on sums, first of stretches
of the block order, then of the blocks of one stretch, then inside one block, so a source
with most of the rows is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.llm.common import cut, stash

#: Tokens that a block is meant to hold, and stretches of the block order, as a power of two.
BLOCK_TOKENS, STRETCHES = 1 << 16, 12
#: Exponents tried in one pass, and passes: the exponent is exact to 32**-4.
FAN, PASSES = 33, 4
#: A source table of so many rows at most is broadcast; a longer one is shuffled.
BROADCAST_SOURCES = 1 << 18
ADDED = ("n_tokens", "weight", "repetition", "pass", "block", "block_order")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(shares: DataFrame, target_entropy: float | None, max_repetition: float, budget: float | None, total: float) -> float:
    """The greatest exponent of at least the target entropy, or the least within the repetition limit, in 0 .. 1."""
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * i / (FAN - 1) for i in range(FAN)]
        p = F.col("p")
        sums = []
        for i, a in enumerate(tried):
            sums += [F.sum(F.pow(p, F.lit(a))).alias(f"w{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}")]
        got = shares.agg(F.min("p").alias("least"), F.max("p").alias("most"), *sums).first()
        if got["most"] is None:
            return 1.0

        def fits(i: int) -> bool:
            a, w = tried[i], got[f"w{i}"]
            if target_entropy is not None:
                from math import log

                return log(w) - a * got[f"l{i}"] / w >= target_entropy
            spent = budget if budget is not None else total * w * got["most"] ** (1 - a)
            return spent / (total * w) * got["least"] ** (a - 1) <= max_repetition * (1 + 1e-12)

        good = [i for i in range(FAN) if fits(i)]
        if target_entropy is not None:
            if not good:
                return 0.0
            i = max(good)
            low, high = tried[i], tried[min(i + 1, FAN - 1)]
        else:
            if not good:
                return 1.0
            i = min(good)
            low, high = tried[max(i - 1, 0)], tried[i]
        if low == high:
            break
    return low if target_entropy is not None else high


def mixture(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    tokens: Column | None = None,
    budget: int | None = None,
    target_entropy: float | None = None,
    max_repetition: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """The rows of ``docs``, each as often as its source's quota shows it.

    Added columns, which replace any of their names: ``n_tokens``, ``weight`` and ``repetition`` of the source (passes over
    it, a fraction), ``pass`` from 0, ``block`` and ``block_order``, by which a reader
    takes the blocks of a pass; ``realised`` puts the rows in that order.  ``tokens`` counts
    a row's tokens (words if not given); it is evaluated once, in a copy of ``docs``.
    A null source is a source.  Rows equal in id and text are taken together; a source
    without tokens is shown once.  No rows give no rows.
    """
    counted = tokens if tokens is not None else word_count(F.col(text_col).cast("string"))
    key = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.lit(seed))
    rows = docs.drop(*(c for c in ADDED if c in docs.columns)).withColumns({"n_tokens": F.coalesce(counted.cast("long"), F.lit(0)), "__h": key, "__src": F.col(source_col).cast("string")})
    if tokens is not None:
        rows, _ = stash(rows)
        small = rows.select(F.col("__src").alias("__source"), F.col("n_tokens").alias("t"), F.col("__h").alias("h"))
    else:
        small, _ = stash(rows.select(F.col("__src").alias("__source"), F.col("n_tokens").alias("t"), F.col("__h").alias("h")))
    sources = cut(small.groupBy("__source").agg(F.sum("t").alias("held")))
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("held"), F.lit(0))).first()
    shares = sources.where("held > 0").withColumn("p", F.col("held") / F.lit(float(max(total, 1))))
    alpha = exponent(shares, target_entropy, max_repetition, budget, float(total))
    norm, most = shares.agg(F.sum(F.pow("p", F.lit(alpha))), F.max(F.pow("p", F.lit(1 - alpha)))).first()
    spent = float(budget) if budget is not None else (total * norm * most if total else 0.0)
    quota = F.col("weight") * F.lit(spent)
    plan = (
        sources.withColumn("weight", F.when(F.col("held") > 0, F.pow(F.col("held") / F.lit(float(max(total, 1))), F.lit(alpha)) / F.lit(norm or 1.0)).otherwise(0.0))
        .withColumn("repetition", F.when(F.col("held") > 0, F.round(quota / F.col("held"), 9)).otherwise(1.0))
        .withColumn("full", F.floor("repetition").cast("long"))
        .withColumn("rest", F.floor(quota - F.col("full") * F.col("held") + 1e-6).cast("long"))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("held") / BLOCK_TOKENS)).cast("long"))
    )

    def beside(rows: DataFrame, column: str, other: DataFrame) -> DataFrame:
        other = other.withColumnRenamed("__source", "__s")
        return rows.join(F.broadcast(other) if n_sources <= BROADCAST_SOURCES else other, F.col(column).eqNullSafe(F.col("__s")), "left").drop("__s")

    block = F.pmod(F.xxhash64("h", F.lit(seed + 1)), F.col("blocks"))
    order = lambda turn: F.xxhash64(F.col("block"), turn, F.lit(seed))
    # where the last pass stops: in which stretch of the order, at which block, where inside the block
    partial = plan.where("rest > 0")
    dealt = beside(small, "__source", partial.select("__source", "blocks", "full", "rest")).where("rest > 0").withColumn("block", block).withColumn("o", order(F.col("full")))
    upto = lambda *by: F.sum("t").over(Window.partitionBy("__source").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums, _ = stash(dealt.groupBy("__source", "block", "o", "rest").agg(F.sum("t").alias("t")).withColumn("stretch", F.shiftright("o", 64 - STRETCHES)))
    stretches = sums.groupBy("__source", "stretch", "rest").agg(F.sum("t").alias("t")).withColumn("upto", upto("stretch")).where("upto > rest")
    first = stretches.groupBy("__source").agg(F.min(F.struct("stretch", (F.col("rest") - F.col("upto") + F.col("t")).alias("rest"))).alias("s"))
    first = cut(first.select("__source", F.col("s.stretch").alias("at"), F.col("s.rest").alias("within")))
    edge = beside(sums, "__source", first).where("stretch = at").withColumn("upto", upto("o", "block")).where("upto > within").groupBy("__source").agg(
        F.min(F.struct("o", F.col("block").alias("b"), (F.col("within") - F.col("upto") + F.col("t")).alias("left"))).alias("e")
    )
    edge = cut(edge.select("__source", F.col("e.o").alias("stop_o"), F.col("e.b").alias("stop_b"), F.col("e.left").alias("left")))
    inside = beside(dealt.select("__source", "block", "h", "t"), "__source", edge).where("block = stop_b")
    by_hash = Window.partitionBy("__source", "block").orderBy("h")
    stop = inside.withColumn("upto", F.sum("t").over(by_hash)).where("upto <= left").groupBy("__source").agg(F.max("h").alias("stop_h"))
    plan = beside(beside(plan, "__source", edge.drop("left")), "__source", stop)
    plan = cut(plan.select("__source", "weight", "repetition", "full", "rest", "blocks", "stop_o", "stop_b", "stop_h"))
    last = order(F.col("full"))
    place, end = F.struct(last.alias("o"), F.col("block").alias("b")), F.struct(F.col("stop_o").alias("o"), F.col("stop_b").alias("b"))
    taken = (F.col("rest") > 0) & (F.col("stop_o").isNull() | (place < end) | ((place == end) & F.coalesce(F.col("__h") <= F.col("stop_h"), F.lit(False))))
    rows = beside(rows, "__src", plan).withColumn("h", F.col("__h")).withColumn("block", block)
    times = F.col("full") + F.when(taken, 1).otherwise(0)
    shown = rows.withColumn("__times", times).where("__times > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1)))
    return shown.withColumn("block_order", order(F.col("pass"))).select(*(c for c in docs.columns if c not in ADDED), "n_tokens", "weight", "repetition", "pass", "block", "block_order")


def realised(shown: DataFrame) -> DataFrame:
    """The rows of a mixture in its order: pass by pass, each by its permutation of blocks."""
    by = ["pass", "block_order", "block"]
    return shown.repartitionByRange(*by).sortWithinPartitions(*by)
