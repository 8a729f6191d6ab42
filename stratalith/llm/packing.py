"""Packing by Karmarkar-Karp multiway differencing.

Whole windows are cut off long documents.  What remains of each document gathers into
groups of about ``GROUP`` windows; the set-differencing method merges the two partial
partitions of largest imbalance, the fullest window of one onto the emptiest of the
other, until one near-equal partition is left.  If a window exceeds the capacity the
pieces are cut finer, and at the finest cut the window count rises.  What is left at
the end of a partition fills windows of power-of-two length, which need no padding.

Groups form inside the partitions of the input, so nothing is shuffled and a task holds
one group at a time.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import text_slices
from stratalith.llm.token_count import WORD_PATTERN, byte_symbols

#: Windows of one group, tokens left free in each on average, and piece sizes tried.
GROUP, SLACK, CUTS = 32, 5, (1, 2, 4, 8, 16)
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids as the tokenizer file gives them.

    A byte-level file whose ids follow its merges, without normaliser or prefix, runs on
    the faster of the two libraries that read such vocabularies; any other on its own.
    The faster one refuses very long runs of white space; the other takes those texts too.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, before = spec["model"].get("vocab", {}), spec.get("pre_tokenizer") or {}
    merged = [vocab.get("".join(p if isinstance(p, list) else p.split(" "))) for p in spec["model"].get("merges", [])]
    plain = (
        spec["model"].get("type") == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and spec.get("normalizer") is None
        and merged and None not in merged and all(a < b for a, b in zip(merged, merged[1:]))
    )
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    by_own = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    if not plain:
        return by_own
    import tiktoken

    value = {c: b for b, c in enumerate(byte_symbols())}
    special = {a["content"]: a["id"] for a in spec["added_tokens"]}
    ranks = {bytes(value[c] for c in t): i for t, i in vocab.items() if t not in special}
    tool = tiktoken.Encoding("packed", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def by_either(text: str) -> np.ndarray:
        try:
            return tool.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)
        except ValueError:
            return by_own(text)

    return by_either


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Items of each of k windows of near-equal sums, by multiway Karmarkar-Karp."""
    n = len(sizes)
    if k == 1:
        return [list(range(n))]
    if not n:
        return [[] for _ in range(k)]
    child = np.full((2 * n, 2), -1, dtype=np.int64)
    made, parts, heap = n, {}, []
    for i in range(n):
        sums, nodes = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64)
        sums[-1], nodes[-1] = sizes[i], i
        parts[i] = (sums, nodes)
        heap.append((-int(sizes[i]), i))
    heapq.heapify(heap)
    for key in range(n, 2 * n - 1):
        (xs, xn), (ys, yn) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        sums, yn = xs + ys[::-1], yn[::-1]
        nodes = np.where(xn >= 0, xn, yn)
        both = np.flatnonzero((xn >= 0) & (yn >= 0))
        if len(both):
            new = np.arange(made, made + len(both))
            made += len(both)
            child[new, 0], child[new, 1] = xn[both], yn[both]
            nodes[both] = new
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        parts[key] = (sums, nodes)
        heapq.heappush(heap, (int(sums[0] - sums[-1]), key))
    (_, nodes), = parts.values()
    windows = []
    for node in nodes.tolist():
        items, open_ = [], [node] if node >= 0 else []
        while open_:
            x = open_.pop()
            if x < n:
                items.append(x)
            else:
                open_.extend(child[x].tolist())
        windows.append(sorted(items))
    return windows


class Piece:
    """A run of one document's ids."""

    __slots__ = ("doc_id", "ids", "start", "total")

    def __init__(self, doc_id, start: int, ids: np.ndarray, total: int):
        self.doc_id, self.start, self.ids, self.total = doc_id, start, ids, total

    def split(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:at], self.total), Piece(self.doc_id, self.start + at, self.ids[at:], self.total)


def balanced(pieces: list[Piece], capacity: int) -> list[list[Piece]]:
    """Windows of at most ``capacity`` tokens that hold all pieces, cut where that helps."""
    count = -(-sum(len(p.ids) for p in pieces) // capacity)
    while True:
        for cut in CUTS:
            most = max(1, capacity // cut)
            small = [Piece(p.doc_id, p.start + i, p.ids[i : i + most], p.total) for p in pieces for i in range(0, len(p.ids), most)]
            windows = differencing(np.array([len(p.ids) for p in small], dtype=np.int64), count)
            if max(sum(len(small[i].ids) for i in w) for w in windows) <= capacity:
                return [_joined([small[i] for i in w]) for w in windows if w]
        count += 1


def _joined(pieces: list[Piece]) -> list[Piece]:
    """Neighbouring cuts of one document that met in one window are one piece again."""
    out: list[Piece] = []
    for p in pieces:
        last = out[-1] if out else None
        if last is not None and last.doc_id == p.doc_id and last.total == p.total and last.start + len(last.ids) == p.start and last.ids.base is p.ids.base is not None:
            out[-1] = Piece(last.doc_id, last.start, np.concatenate([last.ids, p.ids]), last.total)
        else:
            out.append(p)
    return out


def _taken(pieces: list[Piece], tokens: int) -> tuple[list[Piece], list[Piece]]:
    """The first so many tokens, and the rest."""
    head, held = [], 0
    for i, p in enumerate(pieces):
        if held + len(p.ids) > tokens:
            at = tokens - held
            left, right = p.split(at)
            return head + [left] * (at > 0), [right, *pieces[i + 1 :]]
        head.append(p)
        held += len(p.ids)
    return head, []


def pack_stream(documents: Iterator[tuple[int | None, np.ndarray]], capacity: int) -> Iterator[list[Piece]]:
    """Windows over a stream of (id, ids); memory is one group and one document."""
    full = GROUP * (capacity - SLACK)
    rest: list[Piece] = []
    held = 0
    for doc_id, ids in documents:
        whole = len(ids) // capacity * capacity
        for i in range(0, whole, capacity):
            yield [Piece(doc_id, i, ids[i : i + capacity], len(ids))]
        if whole < len(ids):
            rest.append(Piece(doc_id, whole, ids[whole:], len(ids)))
            held += len(ids) - whole
        if held >= full:
            group, rest = _taken(rest, full)
            held -= full
            yield from balanced(group, capacity)
    windows = held // capacity
    if windows:
        group, rest = _taken(rest, windows * (capacity - SLACK))
        yield from balanced(group, capacity)
    left = sum(len(p.ids) for p in rest)
    while left:
        size = min(1 << (left.bit_length() - 1), 1 << (capacity.bit_length() - 1))
        group, rest = _taken(rest, size)
        left -= size
        yield group


def n_tokens(path: str, text: Column) -> Column:
    """Tokens of a text, without the closing id; a null text has none."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(path)
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return count(text)


def _packer(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(path), TaskContext.get().partitionId() << 36
        end = np.zeros(1, dtype=np.uint32)

        def documents():
            for whole in batches:
                for batch in text_slices(whole, "text"):
                    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                        yield doc_id, np.concatenate([encode(text or ""), end])

        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])
        for number, window in enumerate(pack_stream(documents(), capacity)):
            offset = 0
            for p in window:
                rows.append((p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, first + number, offset))
                offset += len(p.ids)
            if len(rows) >= 20000:
                yield flush()
                rows = []
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024) -> DataFrame:
    """One row for every piece of every document, with its window and its place there.

    A document is its ids and a closing id 0; a null text is empty.  Every row of
    ``docs`` is a document of its own, also if rows repeat or ids are null.  Other columns
    are ignored; no rows give no rows.  ``path`` must be readable by every executor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(path, capacity), OUT)
