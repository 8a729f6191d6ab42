"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives; all rows of the labelled sample, their labels
hidden, are the unlabelled text.  The risk is

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

and when the second term falls below zero the step climbs it instead, so the classifier
cannot fit the unlabelled positives as negatives.  The score is the mean of a few
logistic classifiers over hashed words and word beginnings, each present or not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import ragged, text_slices
from stratalith.llm.hashing import U, Words

#: Hashed features (a power of two), features that the classifiers keep, word beginnings in bytes.
DIMENSION, KEPT, HEADS = 1 << 20, 512, (3, 4, 5, 6)
#: At most so many labelled rows are drawn to fit on, the confirmed toxic ones among them first.
FIT_ROWS = 24_000
CLASSIFIERS, STEPS, RATE, DECAY = 3, 400, 0.08, 1e-4


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row, sorted, and offsets (rows + 1)."""
    words = Words(texts)
    mask, rows = U(DIMENSION - 1), len(texts)
    found, docs = [words.hashes(True) & mask], [words.doc]
    for i, head in enumerate(HEADS, 1):
        longer = words.end - words.start > head
        found.append((words.hashes(True, head)[longer] * U(2 * i + 1) >> U(40)) & mask)
        docs.append(words.doc[longer])
    keys = np.unique(np.concatenate(docs).astype(U) << U(32) | np.concatenate(found))
    return (keys & U(0xFFFFFFFF)).astype(np.int64), np.searchsorted((keys >> U(32)).astype(np.int64), np.arange(rows + 1))


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each kind that have each feature, summed over the partition."""
    counts = np.zeros((2, DIMENSION), dtype=np.int32)
    for whole in batches:
        for batch in text_slices(whole, "text"):
            flat, offsets = features(batch.column("text"))
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool), np.diff(offsets))
            counts[0] += np.bincount(flat, minlength=DIMENSION).astype(np.int32)
            counts[1] += np.bincount(flat[toxic], minlength=DIMENSION).astype(np.int32)
    some = np.flatnonzero(counts[0] > 0)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[0, some], pa.int64()), pa.array(counts[1, some], pa.int64())], names=["feature", "n", "n_toxic"])


def _selected(place: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, offsets = features(texts)
    at = place[flat]
    kept = at >= 0
    return at[kept], np.concatenate([[0], np.cumsum(kept)])[offsets]


def _examples(place: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                at, offsets = _selected(place, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), ragged(at.astype(np.int32), offsets, pa.int32())], names=["toxic", "at"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_pu(rows: list[np.ndarray], n_pos: int, prior: float, size: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias under the non-negative risk, by Adam on half samples.

    ``rows`` holds the features present in each example: ``n_pos`` positives, then the
    unlabelled ones.
    """
    rng = np.random.default_rng(seed)
    w, n = np.zeros(size + 1), len(rows)
    w[-1] = -1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    positive = np.arange(n) < n_pos
    for step in range(1, STEPS + 1):
        drawn = rng.random(n) < 0.5
        pos, unl = drawn & positive, drawn & ~positive
        pos, unl = pos if pos.any() else positive, unl if unl.any() else ~positive
        by_pos, by_unl = pos / pos.sum(), unl / max(1, unl.sum())
        z = np.bincount(owner, weights=w[flat], minlength=n) + w[-1]
        p, as_negative = _sigmoid(z), np.logaddexp(0, z)
        negative = as_negative @ by_unl - prior * (as_negative @ by_pos)
        below = p * (by_unl - prior * by_pos)
        slope = prior * (p - 1) * by_pos + below if negative >= 0 else -below
        g = np.append(np.bincount(flat, weights=slope[owner], minlength=size), slope.sum())
        g[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


class Model:
    """place: feature -> column or -1; weights and biases, one row a classifier."""

    def __init__(self, place: np.ndarray, weights: np.ndarray, biases: np.ndarray):
        self.place, self.weights, self.biases = place, weights, biases

    def scores(self, texts: pa.Array) -> np.ndarray:
        at, offsets = _selected(self.place, texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
        parts = [_sigmoid(np.bincount(owner, weights=w[at], minlength=len(texts)) + b) for w, b in zip(self.weights, self.biases, strict=True)]
        return np.mean(parts, axis=0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fits on labelled rows outside the held-out fold, at most ``fit_rows``, drawn by a hash of the id.

    A document with several labels is toxic if one says so; null ids and labels give no
    example.  The prior is the toxic share, smoothed; without a toxic example every score is
    the prior.
    """
    spark = docs.sparkSession
    learnt = (
        labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("toxic"))
        .where(F.col("lid").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("lid")))
        .groupBy("lid").agg(F.max("toxic").alias("toxic"))
    )
    n, n_toxic = learnt.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0))).first()
    # a few labels say little: the share starts from one toxic row in twenty
    prior = (n_toxic + 1) / (n + 20)
    place = np.full(DIMENSION, -1, dtype=np.int32)
    if not n_toxic:
        return Model(place, np.zeros((1, 1)), np.array([np.log(prior / (1 - prior))]))
    positives = learnt.where("toxic = 1").orderBy(F.xxhash64("lid"), "lid").limit(fit_rows // 2)
    unlabelled = learnt.select("lid", F.lit(0).alias("toxic")).orderBy(F.xxhash64("lid", F.lit(1)), "lid").limit(fit_rows - fit_rows // 2)
    drawn = positives.unionByName(unlabelled).toPandas()  # bounded by fit_rows
    ids = spark.createDataFrame(drawn.astype({"lid": "int64", "toxic": "int32"}), "lid long, toxic int")
    sample = docs.select(F.col(id_col).cast("long").alias("lid"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "lid").select("toxic", "text")
    counted = sample.mapInArrow(_frequencies, "feature long, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    n_rows, n_pos = len(drawn), max(1, int((drawn["toxic"] == 1).sum()))
    n_unl = max(1, n_rows - n_pos)
    share_pos, share_unl = F.col("n_toxic") / n_pos, (F.col("n") - F.col("n_toxic")) / n_unl
    lift = (share_pos - share_unl) / F.sqrt((share_unl + 1.0 / n_unl) / n_pos + share_unl / n_unl)
    best = counted.where("n_toxic > 1").select("feature", lift.alias("lift")).where("lift > 3").orderBy(F.desc("lift"), "feature").limit(KEPT).collect()
    for i, row in enumerate(best):
        place[row["feature"]] = i
    table = sample.mapInArrow(_examples(place), "toxic int, at array<int>").toArrow()
    toxic = table.column("toxic").to_numpy().astype(bool)
    if not toxic.any():
        return Model(place, np.zeros((1, 1)), np.array([np.log(prior / (1 - prior))]))
    rows = [np.asarray(x, dtype=np.int64) for x in table.column("at").to_pylist()]
    rows = [rows[i] for i in np.argsort(~toxic, kind="stable")]
    fitted = [fit_pu(rows, int(toxic.sum()), prior, max(1, len(best)), seed) for seed in range(CLASSIFIERS)]
    return Model(place, np.array([w for w, _ in fitted]), np.array([b for _, b in fitted]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; a null text is empty, a null id not held out.

    Only the text enters the score.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.place, model.weights, model.biases))  # at most 4 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                s = own.scores(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("doc_id"), held_out(id_).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((model.place, model.weights, model.biases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for whole in batches:
            for batch in text_slices(whole, text_col):
                yield batch.filter(pa.array(own.scores(batch.column(text_col)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
