"""MinHash near-duplicates by min-max hashing.

Every permutation gives two signature values, the least and the greatest permuted
shingle hash, so 129 permutations fill 258 rows: 43 bands of 6.  A pair of similarity
0.8 shares no band with probability (1 - 0.8**6)**43 = 2e-6.

Documents with equal shingle sets form a class first; ``linking`` searches and confirms
links between the representatives of classes on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import ragged, stash, text_slices
from stratalith.llm.linking import linked, only_ids, shared_spots, small
from stratalith.llm.hashing import U, Words, mix, shingles

PERMUTATIONS, BANDS = 129, 43
_rng = np.random.default_rng(8)
_MULTIPLIERS = _rng.integers(0, 2**63, PERMUTATIONS, dtype=U) * U(2) + U(1)
_OFFSETS = _rng.integers(0, 2**64, PERMUTATIONS, dtype=U)


def minmax_signature(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, 2 * PERMUTATIONS): least and greatest permuted hash of each non-empty row."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 2 * PERMUTATIONS), dtype=U)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(filled):
        starts = offsets[filled]
        for i in range(PERMUTATIONS):
            permuted = (values ^ (values >> U(29))) * _MULTIPLIERS[i] + _OFFSETS[i]
            permuted ^= permuted >> U(32)
            out[filled, 2 * i] = np.minimum.reduceat(permuted, starts)
            out[filled, 2 * i + 1] = np.maximum.reduceat(permuted, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(rows, BANDS): one hash of the rows of each band, different between bands."""
    rows = signature.shape[1] // BANDS
    keys = np.tile(np.arange(1, BANDS + 1, dtype=U), (len(signature), 1))
    for i in range(rows):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + signature[:, i::rows][:, :BANDS])
    return keys


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _checks(values: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """128 bits that tell unlike sets apart."""
    sums = (np.concatenate([[U(0)], np.cumsum(mix(values ^ U(salt)))]) for salt in (0, 0xD6E8FEB86659FD93))
    return [pa.array(_signed(s[offsets[1:]] - s[offsets[:-1]])) for s in sums]


def _signer(shingle: int, lower: bool, full: bool):
    """(id, n, k1, k2) of each text, and its band keys or, if ``full``, its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                values, offsets = shingles(Words(batch.column("text")), shingle, lower)
                sizes = np.diff(offsets)
                if full:
                    own = ragged(_signed(values), offsets, pa.int64())
                else:
                    keys = band_keys(minmax_signature(values, offsets))
                    own = ragged(_signed(keys[sizes > 0]).ravel(), np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *_checks(values, offsets), own], names=["id", "n", "k1", "k2", "set" if full else "bands"])

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, lower: bool = True
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Links join documents whose distinct shingle sets have a Jaccard similarity of at
    least ``percent`` / 100.  A text with fewer words than ``shingle`` is one shingle; a
    null, empty or blank text has none and is a component of its own.  Rows that repeat
    an id are documents of their own and each get a row; a row whose id is null has a
    null component and is kept.  Other columns are ignored.  No rows give no rows.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed, _ = stash(whole.mapInArrow(_signer(shingle, lower, False), "id long, n long, k1 long, k2 long, bands array<long>"))
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("least"))
    # a stored number stands for a class from here on
    classes, _ = stash(classes.withColumn("rep", F.monotonically_increasing_id()))
    n_classes = classes.count()
    firsts = signed.join(small(classes, n_classes), ["k1", "k2"]).where("id = least")
    repeats = firsts.groupBy("rep").agg(F.count("*").alias("c")).where("c > 1").select("rep")
    once = firsts.select("rep", "bands").join(repeats, "rep", "left_anti").union(firsts.join(repeats, "rep").groupBy("rep").agg(F.min("bands").alias("bands")))
    spots = shared_spots(once)
    needed, _ = stash(only_ids(classes, "rep", spots.select("rep").distinct(), n_classes))
    ids = needed.select("least").distinct()
    texts = only_ids(whole, "id", ids, ids.count()).mapInArrow(_signer(shingle, lower, True), "id long, n long, k1 long, k2 long, set array<long>")
    sets, _ = stash(texts.join(small(needed, n_classes), ["k1", "k2"]).where("id = least").select(F.col("rep").alias("id"), "set"))
    alone = sets.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    sets = sets.join(alone, "id", "left_anti").union(sets.join(alone, "id").groupBy("id").agg(F.min("set").alias("set")))
    final = linked(spots, lambda own, n: sets.join(small(own, n), "id"), percent)
    roots = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = roots.groupBy("component").agg(F.min("least").alias("root"))
    roots = roots.join(least, "component").select("k1", "k2", "root")
    component = F.when(F.col("n") > 0, F.coalesce("root", "id")).otherwise(F.col("id"))
    return (
        signed.select("id", "n", "k1", "k2").join(small(roots, n_classes), ["k1", "k2"], "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that represent their component; rows repeating an id stay or go together."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
