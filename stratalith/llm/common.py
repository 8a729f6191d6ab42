"""Shared plumbing: tables, lineage cuts and bounded Arrow slices."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.shipping import ship

#: Text bytes that one vectorised pass looks at; one longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode, where none is configured."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stratalith-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives lost executors and ends the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame) -> tuple[DataFrame, str]:
    """A compressed columnar table in the shared folder, and its path.

    Plans read it until the application ends; then its file system deletes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Zero-copy slices of a batch with about ``limit`` bytes of text each."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
        yield batch.slice(int(lo), int(hi - lo))


def ragged(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array over one flat array."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def nonnull(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))
