"""Repeated passages by Rabin-Karp hashing of every fixed-length word window.

Each chunk of documents hashes all its windows, keeps the first of those that repeat
inside the chunk, and deals the rest out to buckets by hash as packed arrays; a bucket
finds the windows that start earlier elsewhere.  A frequent window thus travels once a
chunk, not once an occurrence.  Marked starts return to their documents, a packed row
for many of them, and merge there into maximal removal intervals.  Windows are equal if
two independent hashes are: one of 64 bits, and one that picks the bucket, whose number
grows with the input.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import text_slices
from stratalith.llm.hashing import U, Words, mix, windows

#: Words that one chunk hashes together, and windows that one bucket is meant to hold.
CHUNK_WORDS, BUCKET_WINDOWS = 1 << 20, 3 << 20
#: Turns word hashes into those of the second window hash.
OTHER = U(0xC2B2AE3D27D4EB4F)
#: Documents that get their marks back together.
HOME_DOCS = 1024
_LEAST_ID = -(2**63)
_SENT = "bucket long, hashes binary, at binary, ids binary, home long, docs binary, starts binary"
_MARKS = "home long, docs binary, starts binary"


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


def _home(ids: np.ndarray, ths: np.ndarray, homes: int) -> np.ndarray:
    return (mix(ids.view(U) ^ mix(ths.view(U))) % U(homes)).astype(np.int64)


def _by_home(ids: np.ndarray, ths: np.ndarray, starts: np.ndarray, homes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Marked starts as one row a home: its documents with their counts, and the starts."""
    ids, ths = np.ascontiguousarray(ids), np.ascontiguousarray(ths)
    home = _home(ids, ths, homes)
    order = np.lexsort((starts, ths, ids, home))
    home, ids, ths, starts = home[order], ids[order], ths[order], starts[order].astype(np.int32)
    edges = np.flatnonzero(np.diff(home)) + 1
    for lo, hi in zip([0, *edges], [*edges, len(home)], strict=True) if len(home) else ():
        own = slice(lo, hi)
        opens = np.flatnonzero(np.concatenate([[True], (ids[own][1:] != ids[own][:-1]) | (ths[own][1:] != ths[own][:-1])]))
        counts = np.diff(np.append(opens, hi - lo))
        yield int(home[lo]), _pack(np.stack([ids[own][opens], ths[own][opens], counts])), _pack(starts[own])


def _chunk_rows(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, buckets: int, homes: int) -> pa.RecordBatch:
    ids, ths, counts, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.cumsum(counts) - counts
    order = np.lexsort((ths, ids))
    if len(order):
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (ths[order][1:] != ths[order][:-1])
        order = order[fresh]
    ids, ths, counts, first = ids[order], ths[order], counts[order], first[order]
    n = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    hashed, other = (windows(x, k)[first[doc] + start] if len(doc) else np.zeros(0, dtype=U) for x in (h, mix(h ^ OTHER)))
    by_hash = np.argsort(hashed, kind="stable")
    again = np.zeros(len(doc), dtype=bool)
    again[by_hash[1:]] = (hashed[by_hash[1:]] == hashed[by_hash[:-1]]) & (other[by_hash[1:]] == other[by_hash[:-1]])
    rows: list[tuple] = [
        (home % buckets, None, None, None, home, docs, starts) for home, docs, starts in _by_home(ids[doc[again]], ths[doc[again]], start[again], homes)
    ]
    sent = np.flatnonzero(~again)
    bucket = ((other[sent] >> U(20)) % U(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            w = sent[order[edges[b] : edges[b + 1]]]
            docs, place = np.unique(doc[w], return_inverse=True)
            at = np.stack([np.diff(place, prepend=0), start[w]]).astype(np.int32)
            rows.append((b, hashed[w].tobytes(), _pack(at), _pack(np.stack([ids[docs], ths[docs]])), None, None, None))
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SENT.split(", ")])


def _sender(k: int, buckets: int, homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for whole in batches:
            for batch in text_slices(whole, "text"):
                words = Words(batch.column("text"))
                parts.append((batch.column("id").to_numpy(), batch.column("th").to_numpy(), words.counts, words.hashes()))
                held += len(words.start)
                if held >= CHUNK_WORDS:
                    yield _chunk_rows(parts, k, buckets, homes)
                    parts, held = [], 0
        if parts:
            yield _chunk_rows(parts, k, buckets, homes)

    return run


def _find_repeats(group: pa.Table, homes: int) -> pa.Table:
    """The starts in one bucket whose window also starts earlier, by home."""
    rows, parts = [], []
    for hashes, at, ids, home, docs, starts in zip(*(group.column(c).to_pylist() for c in ("hashes", "at", "ids", "home", "docs", "starts")), strict=True):
        if hashes is None:
            rows.append((home, docs, starts))
        else:
            place, start = _unpack(at, np.int32).reshape(2, -1)
            own_ids, own_ths = _unpack(ids, np.int64).reshape(2, -1)
            place = np.cumsum(place)
            parts.append((np.frombuffer(hashes, dtype=U), own_ids[place], own_ths[place], start))
    if parts:
        h, ids, ths, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        inside = np.zeros(len(h), dtype=bool)
        inside[1:] |= same
        inside[:-1] |= same
        order = order[inside]
        h, ids, ths, start = h[order], ids[order], ths[order], start[order]
        order = np.lexsort((start, ths, ids, h))
        h, ids, ths, start = h[order], ids[order], ths[order], start[order]
        if len(h):
            opens = np.ones(len(h), dtype=bool)
            opens[1:] = h[1:] != h[:-1]
            lead = np.flatnonzero(opens)[np.cumsum(opens) - 1]
            later = (ids != ids[lead]) | (ths != ths[lead]) | (start != start[lead])
            rows.extend(_by_home(ids[later], ths[later], start[later], homes))
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["home", "docs", "starts"])


def _finder(homes: int):
    def run(group: pa.Table) -> pa.Table:
        return _find_repeats(group, homes)

    return run


def _shrinker(homes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in (part for whole in batches for part in text_slices(whole, "text")):
            blobs = [press.compress((x or "").encode()) for x in batch.column("text").to_pylist()]
            home = _home(batch.column("id").to_numpy(), batch.column("th").to_numpy(), homes)
            columns = [batch.column("doc_id"), batch.column("id"), batch.column("th"), pa.array(home), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "id", "th", "home", "blob"])

    return run


def _remover(k: int, with_text: bool):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        starts_of: dict[tuple[int, int], list[np.ndarray]] = {}
        for own, starts in zip(marks.column("docs").to_pylist(), marks.column("starts").to_pylist(), strict=True):
            ids, ths, counts = _unpack(own, np.int64).reshape(3, -1)
            for id_, th, part in zip(ids.tolist(), ths.tolist(), np.split(_unpack(starts, np.int32), np.cumsum(counts)[:-1]), strict=True):
                starts_of.setdefault((id_, th), []).append(part)
        n, removed, digests, kept_texts = [], [], [], []
        for id_, th, blob in zip(*(docs.column(c).to_pylist() for c in ("id", "th", "blob")), strict=True):
            words = zstandard.ZstdDecompressor().decompress(blob).split()
            kept = words
            if parts := starts_of.get((id_, th)):
                starts = np.unique(np.concatenate(parts))
                step = np.zeros(len(words) + 1, dtype=np.int32)
                step[starts] += 1
                step[starts + k] -= 1
                kept = list(itertools.compress(words, np.cumsum(step[:-1]) == 0))
            joined = b" ".join(kept)
            n.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                kept_texts.append(joined.decode())
        columns = [docs.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return pa.table(columns + [pa.array(kept_texts, pa.string())] * with_text, names=names + ["kept_text"] * with_text)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) for every row of ``docs``.

    A word goes if a ``window`` of words covers it whose sequence also starts earlier: in
    a smaller id, or earlier in the same document.  Null, empty and short texts lose
    nothing.  A null id comes before all others.  Rows equal in id and text are one
    document and share its result; rows that share only the id are documents of their
    own, ordered by a hash of the text.  Other columns are ignored.
    """
    spark = docs.sparkSession
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(_LEAST_ID)).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    size, n = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * BUCKET_WINDOWS)))
    homes = max(1, -(-n // HOME_DOCS))
    marks = (
        base.select("id", "th", "text").mapInArrow(_sender(window, buckets, homes), _SENT)
        .groupBy("bucket").applyInArrow(_finder(homes), _MARKS)
    )
    small = base.mapInArrow(_shrinker(homes), "doc_id long, id long, th long, home long, blob binary")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return small.groupBy("home").cogroup(marks.groupBy("home")).applyInArrow(_remover(window, with_text), out)
