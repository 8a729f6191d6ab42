"""As-of, bracket and interval lookups over ordered samples, without a range join.

Samples and questions of a key meet in one sorted pass: a window carries the last sample
forward, so the cost is a sort per key, not the product of the two sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(samples: DataFrame, asked: DataFrame, key: str, time: str, value: str, default: float | None = None) -> DataFrame:
    """``asked`` (key, time, ...) with the ``value`` of the last sample at or before its time."""
    left = samples.select(key, time, F.lit(0).alias("__side"), F.struct(value).alias("__v"))
    own = [c for c in asked.columns if c not in (key, time)]
    right = asked.select(key, time, F.lit(1).alias("__side"), *own)
    both = left.unionByName(right, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1")
    out = F.col(f"__v.{value}") if default is None else F.coalesce(F.col(f"__v.{value}"), F.lit(default))
    return found.select(key, time, *own, out.alias(value))


def interpolated(anchors: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(key, tick, frame): ticks between two anchors (key, tick, frame) by linear interpolation, cut off to whole frames.

    Before the first and after the last anchor the frame of that anchor holds.
    """
    here = F.struct("tick", "frame")
    left = anchors.select(key, "tick", F.lit(0).alias("__side"), here.alias("__a"))
    right = asked.select(key, "tick", F.lit(1).alias("__side"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("tick", "__side")
    before = F.last("__a", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("__a", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    met = both.select(key, "tick", "__side", before.alias("p"), after.alias("n")).where("__side = 1")
    between = F.col("p.frame") + ((F.col("n.frame") - F.col("p.frame")) * (F.col("tick") - F.col("p.tick")) / (F.col("n.tick") - F.col("p.tick"))).cast("long")
    frame = F.when(F.col("p").isNull(), F.col("n.frame")).when(F.col("n").isNull() | (F.col("p.tick") == F.col("tick")), F.col("p.frame")).otherwise(between)
    return met.select(key, "tick", frame.alias("frame"))


def segment_at(segments: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """``asked`` (key, t) with the id of the segment (key, segment_id, start, end) whose [start, end) holds t, if one does.

    Segments of a key must not overlap; ``overlaps`` finds those that do.
    """
    samples = segments.select(key, F.col("start").alias("t"), F.struct("segment_id", "end").alias("s"))
    met = asof(samples, asked, key, "t", "s")
    return met.withColumn("segment_id", F.when(F.col("t") < F.col("s.end"), F.col("s.segment_id"))).drop("s")


def overlaps(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans that begin before the one before them ends."""
    before = F.lag(end).over(Window.partitionBy(key).orderBy(start, end))
    return spans.withColumn("previous_end", before).where(F.col(start) < F.col("previous_end"))


def not_rising(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value does not exceed the one before."""
    return rows.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(order))).where(F.col(value) <= F.col("previous"))
