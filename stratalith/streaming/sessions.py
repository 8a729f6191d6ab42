"""Session logs and event streams: the batch folds and their streaming forms.

Windows, watermarks and late data have no counterpart in the engine this one answers
for; they are extensions.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def latest(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last event of each key: the state after a fold in which the latest wins."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return events.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def hash_chain(events: DataFrame, key: str, order: str, body: Column) -> DataFrame:
    """(key, order, head): every event's hash over the head before it and its body.

    A chain is sequential by nature; chains of different keys run apart.
    """
    schema = f"{key} long, {order} long, head string"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        heads, head = [], GENESIS
        for text in rows["__body"]:
            head = hashlib.sha256(f"{head}|{text}".encode()).hexdigest()
            heads.append(head)
        return pd.DataFrame({key: rows[key], order: rows[order], "head": heads})

    return events.select(F.col(key).cast("long"), F.col(order).cast("long"), F.coalesce(body, F.lit("")).alias("__body")).groupBy(key).applyInPandas(run, schema)


def broken_links(log: DataFrame, key: str, order: str, body: Column) -> DataFrame:
    """Events of a written log (with ``head``) whose head does not follow from the one before."""
    before = F.coalesce(F.lag("head").over(Window.partitionBy(key).orderBy(order)), F.lit(GENESIS))
    return log.withColumn("__expected", F.sha2(F.concat_ws("|", before, body), 256)).where(F.col("head") != F.col("__expected")).drop("__expected")


def tumbling(events: DataFrame, time: str, width: str, *by: str, watermark: str | None = None) -> DataFrame:
    """Counts and value sums by window; batch or stream."""
    events = events.withWatermark(time, watermark) if watermark else events
    grouped = events.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return grouped.select(F.col("window.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, *by: str, watermark: str | None = None) -> DataFrame:
    events = events.withWatermark(time, watermark) if watermark else events
    grouped = events.groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return grouped.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def deduplicated(stream: DataFrame, time: str, watermark: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there to a Parquet sink and stops; a rerun takes up after the last commit."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def capture_violations(policy: DataFrame) -> DataFrame:
    """(session_id, violations): a capture is off unless enabled, consented and under a token."""
    tests = F.array(
        F.when(~F.coalesce("enabled", F.lit(False)), "not enabled"), F.when(~F.coalesce("consent", F.lit(False)), "no consent"), F.when(F.coalesce("token", F.lit("")) == "", "no token")
    )
    return policy.select("session_id", F.filter(tests, lambda v: v.isNotNull()).alias("violations"))
