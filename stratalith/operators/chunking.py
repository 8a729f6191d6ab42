"""Chunks of bounded size, packed from whole paragraphs where they fit."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: bytes of a chunk.
CHUNK_BYTES = 512


def packed(parts: Iterable[str], most: int, glue: str) -> Iterator[str]:
    """Parts in order, joined while they stay within ``most`` bytes; a longer part stands alone."""
    held: list[str] = []
    size = 0
    for part in parts:
        n = len(part.encode())
        if held and size + n + len(glue) > most:
            yield glue.join(held)
            held, size = [], 0
        size += n + len(glue) * bool(held)
        held.append(part)
    if held:
        yield glue.join(held)


def chunks(text: str | None, most: int = CHUNK_BYTES) -> list[str]:
    """Paragraphs, parted by empty lines, packed into chunks; an oversize paragraph is packed from its words by itself."""
    paragraphs = [p for p in (p.strip() for p in (text or "").split("\n\n")) if p]
    out: list[str] = []
    for oversize, run in groupby(paragraphs, key=lambda p: len(p.encode()) > most):
        if oversize:
            for p in run:
                out.extend(packed(re.split(r"\s+", p), most, " "))
        else:
            out.extend(packed(run, most, "\n\n"))
    return out


def chunked(text: Column, most: int = CHUNK_BYTES) -> Column:
    """The chunks of a text as an array; a null or blank text has none."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([chunks(t, most) for t in texts.to_pylist()], pa.list_(pa.string()))

    return run(text)
