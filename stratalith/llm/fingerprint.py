"""Document fingerprints: threshold-scaled sketches of character shingles.

A sketch retains every shingle hash below 2**64 / ``scale``; the threshold is the same
for all documents, so sketches merge by union and estimate containment between texts of
very different size.  A shingle is 12 consecutive code points; a shorter non-empty text
is one shingle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from stratalith.llm.common import ragged
from stratalith.llm.hashing import BASE, U, mix, windows

SHINGLE, SCALE = 12, 16
#: Rows that one partition of the neighbour pass is meant to hold.
BUCKET_ROWS = 4096
_LEAST_ID = -(2**63)


def shingle_hashes(text: str) -> np.ndarray:
    """Distinct hashes of the text's shingles, sorted."""
    points = mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(U) + U(1))
    if len(points) >= SHINGLE:
        return np.unique(windows(points, SHINGLE))
    acc = len(points)
    for p in points.tolist():
        acc = (acc * int(BASE) + p) % 2**64
    return mix(np.array([acc] if len(points) else [], dtype=U))


class Sketch:
    """kept: retained hashes, sorted; size, check: count and exclusive-or of all distinct hashes."""

    def __init__(self, text: str, scale: int = SCALE):
        every = shingle_hashes(text)
        self.kept = every[: np.searchsorted(every, U(2**64 // scale))]
        self.size, self.check = len(every), int(np.bitwise_xor.reduce(every)) if len(every) else 0

    def text(self) -> str:
        """Size, check value, then the retained hashes."""
        return f"{self.size:x}.{self.check:016x}.{base64.b64encode(self.kept.astype('>u8').tobytes()).decode()}"

    def common(self, other: Sketch) -> int:
        return len(np.intersect1d(self.kept, other.kept, assume_unique=True))

    def likeness(self, other: Sketch) -> float:
        """Estimated Jaccard similarity; two sketches without hashes are alike if their texts' shingles are."""
        if (self.size, self.check) == (other.size, other.check):
            return 1.0
        total = len(self.kept) + len(other.kept)
        both = self.common(other)
        return both / (total - both) if total else 0.0

    def containment(self, other: Sketch) -> float:
        """Estimated share of this text's shingles that the other has."""
        if (self.size, self.check) == (other.size, other.check):
            return 1.0
        return self.common(other) / len(self.kept) if len(self.kept) else 0.0


def _retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [Sketch(x or "").kept.view(np.int64) for x in batch.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(k) for k in kept])])
        flat = np.concatenate(kept) if kept else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("key"), ragged(flat, offsets, pa.int64())], names=["key", "hashes"])


def sketches(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, hashes): the mergeable sketch of every row; null and empty texts have none."""
    rows = docs.select(key.cast("string").alias("key"), text.cast("string").alias("text"))
    return rows.mapInArrow(_retained, "key string, hashes array<long>")


def merged(parts: DataFrame) -> DataFrame:
    """(key, hash): the union of the sketches of each key, one retained hash a row."""
    return parts.select("key", F.explode("hashes").alias("hash")).distinct()


def containments(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_key, right_key, containment) of merged sketches that share a hash: share of left's in right."""
    sizes = left.groupBy("key").agg(F.count("*").alias("n"))
    joined = left.toDF("left_key", "hash").join(right.toDF("right_key", "hash"), "hash")
    both = joined.groupBy("left_key", "right_key").agg(F.count("*").alias("both"))
    return both.join(sizes.withColumnRenamed("key", "left_key"), "left_key").select("left_key", "right_key", (F.col("both") / F.col("n")).alias("containment"))


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "contained_edited double, contained_next double"
)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and id; the last of a bucket is the first of the next one, only looked at."""
    names = [x.split()[0] for x in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def results():
        before = None
        for batch in batches:
            for bucket, borrowed, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "borrowed", "doc_id", "text")), strict=True):
                now = (bucket, doc_id, text or "", None if borrowed and before is None else Sketch(text or ""))
                if before is not None and before[0] == bucket:
                    yield _row(before, now)
                before = None if borrowed else now

    rows, size = [], 0
    for row in results():
        rows.append(row)
        size += len(row[3]) + len(row[4])
        if size > 8 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _row(own: tuple, following: tuple) -> tuple:
    _, doc_id, text, sketch = own
    half = len(text) // 2
    edited = text[: len(text) - half] + following[2][:half]
    other, after = Sketch(edited), following[3]
    return (
        doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), sketch.text(), other.text(),
        sketch.likeness(other), sketch.likeness(after), sketch.containment(other), sketch.containment(after),
    )


def fingerprints_with_neighbour(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness, one row a document.

    The edited text has its last half replaced by as many code points of the next
    document by id, or all it has; the last document takes the first.  A null text is
    empty; a null id comes first; rows that repeat an id are ordered by text.  A single
    row is its own next document.  Other columns are ignored; no rows give no rows.

    Ids are dealt out into ranges by approximate quantiles, so the texts are shuffled
    once; the first document of each range also goes to the range before it.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = base.count()
    ranges = max(1, min(-(-n // BUCKET_ROWS), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = F.array(*(F.lit(i / ranges) for i in range(1, max(2, ranges))))
    bounds = base.agg(F.percentile_approx("doc_id", shares, F.lit(max(10000, 20 * ranges)))).first()[0]
    edges = np.unique(np.array((bounds or []) if ranges > 1 else [], dtype=np.int64))
    rank = F.coalesce("doc_id", F.lit(_LEAST_ID))

    @pandas_udf("int")
    def bucket_of(x):
        return x.__class__(np.searchsorted(edges, x.to_numpy(), side="right").astype(np.int32))

    dealt = base.withColumn("bucket", bucket_of(rank) if len(edges) else F.lit(0))
    firsts = dealt.select("bucket", "doc_id").groupBy("bucket").agg(F.min(rank).alias("least")).orderBy("bucket").collect()
    lead = [(r["bucket"], r["least"]) for r in firsts]
    goes = spark.createDataFrame([(least, lead[i - 1][0]) for i, (_, least) in enumerate(lead)], "least long, to int")
    # at most four rows a shuffle partition
    borrowed = base.join(F.broadcast(goes), rank == F.col("least")).groupBy("to", "least").agg(F.min("text").alias("text"))
    sentinel = borrowed.select(F.nullif("least", F.lit(_LEAST_ID)).alias("doc_id"), "text", F.col("to").alias("bucket"), F.lit(True).alias("borrowed"))
    rows = dealt.withColumn("borrowed", F.lit(False)).unionByName(sentinel)
    ordered = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket", "borrowed", "doc_id", "text")
    return ordered.mapInArrow(_compare, OUT)
