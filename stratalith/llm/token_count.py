"""Token counts by byte-pair merging with a heap and a linked list.

A text is cut at the special strings, then into words by the vocabulary's pattern.  A
word starts as one symbol a byte in a doubly linked list; the adjacent pair of lowest
rank is popped off a heap and merged until none is left.  The count is the symbols
less the merges; no identifiers are made.  A bounded cache keeps counts of words.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import text_slices

#: Fixed value: the word pattern of this family of byte-level vocabularies.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED_WORDS = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class WordCounts(dict):
    """word -> tokens, filled on demand; long words are not kept, and a full cache starts anew."""

    def __init__(self, count):
        self.count = count

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= 48:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = n
        return n


class PairMerger:
    """Counts tokens as the tokenizer file at ``path`` makes them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") is not None:
            raise ValueError(f"{path} is not a byte-level file without normaliser and prefix")
        self.words = regex.compile(WORD_PATTERN)
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        numbers: dict[str, int] = {}
        number = lambda s: numbers.setdefault(s, len(numbers))
        self.byte = [number(s) for s in byte_symbols()]
        #: A pair of symbols, packed -> its rank; rank -> the merged symbol.
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merged.append(number(left + right))
            self.rank.setdefault(number(left) << 32 | number(right), rank)
        self.cache = WordCounts(self.word)

    def word(self, word: str) -> int:
        symbols = [self.byte[b] for b in word.encode()]
        n, rank_of = len(symbols), self.rank.get
        ranks = [rank_of(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:])]
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        if not heap:
            return n
        ranks.append(-1)
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 32)
            if ranks[i] != rank:  # one of the pair has merged since
                continue
            merges += 1
            new = symbols[i] = self.merged[rank]
            gone = after[i]
            ranks[gone] = ranks[i] = -1
            right, left = after[gone], before[i]
            after[i] = right
            if right < n:
                before[right] = i
                if (r := rank_of(new << 32 | symbols[right], -1)) >= 0:
                    ranks[i] = r
                    heapq.heappush(heap, r << 32 | i)
            if left >= 0:
                ranks[left] = r = rank_of(symbols[left] << 32 | new, -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | left)
        return n - merges

    def plain(self, text: str) -> int:
        return sum(map(self.cache.__getitem__, self.words.findall(text)))

    def count(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


@lru_cache(maxsize=2)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def _counter(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = merger(path)
        for whole in batches:
            for batch in text_slices(whole, "text"):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                counts = [tool.count(x) for x in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for every row of ``docs``, without a shuffle.

    ``path`` is a byte-level tokenizer file that every executor can read.  Null and empty
    texts have no tokens; special strings count one each; repeated rows and null ids keep
    their rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counter(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
