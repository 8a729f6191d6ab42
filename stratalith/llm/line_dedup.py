"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line's shingles are the ten characters from each word's beginning on, and in a word of
more than ten characters those from every place on until the word's last ten, so that
every character counts.  (Shingles from every place of every word would be six times as
many, and the interpreted array functions that make them already take most of the time.)
Equal lines collapse first, by 128 bits of hash.

The sorted shingle hashes are a MinHash signature under one permutation: from the least
hash of each eighth of the hash range on, three neighbours make a band key.  Lines of 4 to
28 shingles are keyed by every four neighbours of their sorted set, closed to a ring.  That
loses no link: where c shingles are common and d are not, at most 3 d of the fours
between common ones are torn, and c >= 4 d at 0.8.  Sets of up to 3 shingles are linked only
if equal.  ``linking`` confirms links on full sets (Jaccard 0.8) and joins them; of each
component the first line stays.

A pair with a line of more than 28 shingles has band keys on both sides.  One of long
lines of similarity 0.8 shares none with probability (1 - 0.8**3)**8 = 0.3 %, one of
similarity 0.9 with 3e-5.  Equality of shingles is by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import cut, stash
from stratalith.llm.linking import linked, only_ids, shared_spots, small

SHINGLE = 10
#: Neighbours in a key of a short line; a fifth would lose links at 0.8.
RING = 4
#: Shingles up to which a line has those keys, and from which on it has bands; lines on both sides of SHORT that are linked both have bands.
SHORT, LONG = 28, 23
#: Rows of a table of needed lines that is broadcast at most (50 MB).
BROADCAST_LINES = 1 << 20
#: What ``\s`` of a pattern stands for.
BLANKS = " \t\n\x0b\f\r"
_LEAST_ID = -(2**63)


def line_shingles(line: Column) -> Column:
    """Sorted distinct hashes of the characters from each word's beginning on, and through each longer word; none for a blank line."""
    pieces = F.regexp_extract_all(line, F.lit(rf"(?s)(?=(\S.{{0,{SHINGLE - 1}}}+))(?:\S{{1,{SHINGLE}}}+(?!\S)|\S)"), F.lit(1))
    return F.sort_array(F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(p))))


def band_keys(h: Column) -> Column:
    """Band keys of a sorted shingle set by its size."""
    n = F.size(h)
    # neighbours by ``get``: a slice copies the whole array; one beyond the end is null and leaves the hash as it is
    near = lambda s, i, n: [F.get(s, i + j) for j in range(1, n)]
    opens = lambda x, i: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(F.get(h, i - 1)), 61) != 0, F.lit(True))
    ring = lambda s: F.transform(h, lambda x, i: F.xxhash64(x, *near(s, i, RING)))
    eighths = F.transform(h, lambda x, i: F.when(opens(x, i), F.xxhash64(x, *near(h, i, 3), F.shiftright(x, 61))))
    none = F.array().cast("array<bigint>")
    return F.concat(
        F.when(n.between(1, 3), F.array(F.xxhash64(h))).otherwise(none),
        F.when(n.between(RING, SHORT), _bound(F.concat(h, F.slice(h, 1, RING - 1)), ring)).otherwise(none),
        F.when(n >= LONG, F.array_compact(eighths)).otherwise(none),
    )


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is looked at."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    lines = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))
    return docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(_LEAST_ID)).alias("id"), F.xxhash64(text).alias("th"), lines.alias("lines"))


def _banded(hashed: DataFrame) -> DataFrame:
    """(id, th, pos, lh, l2, bands) of the lines that are not blank; a filter on the bands would be pushed below them and make them twice."""
    written = hashed.where(F.ltrim("line", F.lit(BLANKS)) != "")
    return written.select("id", "th", "pos", "lh", "l2", _bound(line_shingles(F.col("line")), band_keys).alias("bands"))


def _place() -> Column:
    """One ordered number for (id, pos)."""
    return F.col("id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("pos")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(id, th, removed): for each document that loses lines, their places from 0, in order.

    ``id`` and ``th`` tell documents apart: the id (the least long for null) and a hash
    of the text.  A line goes if a like line of its component stands earlier: in a
    smaller id, or earlier in its document; documents that share an id keep what stands
    at one place in them.  Blank lines never go.  Rows equal in id and text are one document.
    """
    base = _documents(docs, id_col, text_col)
    placed = base.select("id", "th", F.posexplode("lines").alias("pos", "line"))
    hashed = placed.select("id", "th", "pos", F.xxhash64("line").alias("lh"), F.xxhash64(F.lit(7), "line").alias("l2"), "line")
    lined, _ = stash(_banded(hashed))
    lines, _ = stash(lined.groupBy("lh", "l2").agg(F.min(_place()).alias("at"), F.count("*").alias("copies")))
    # one 64-bit number stands for a line among its neighbours; lines that would share one are compared as a whole only
    clashing = cut(lines.groupBy("lh").agg(F.count("*").alias("c")).where("c > 1").select("lh"))
    spots = shared_spots(lined.join(F.broadcast(clashing), "lh", "left_anti").select(F.col("lh").alias("rep"), "bands"))
    again = base.groupBy("id", "th").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    texts = hashed if again else base.dropDuplicates(["id", "th"]).select("id", "th", F.posexplode("lines").alias("pos", "line")).withColumn("lh", F.xxhash64("line"))

    # one pass over the texts for all lines that share a band key
    ids = cut(spots.select("rep").distinct().toDF("lh"))
    n = ids.count()
    wanted = lines.join(small(ids, n), "lh").select("lh", "at")
    rows = texts.join(F.broadcast(wanted) if n <= BROADCAST_LINES else wanted, "lh").where(_place() == F.col("at"))
    sets, _ = stash(rows.select(F.col("lh").alias("id"), line_shingles(F.col("line")).alias("set")))

    found = linked(spots, lambda ids, n: only_ids(sets, "id", ids, n), percent).select(F.col("node").alias("lh"), "component")
    member = lines.join(found, "lh", "left").where("copies > 1 OR component IS NOT NULL")
    member = member.withColumns({"root": F.coalesce("component", "lh"), "alone": F.when(F.col("component").isNull(), F.col("l2"))})
    first = member.groupBy("root", "alone").agg(F.min("at").alias("first"))
    same = (member["root"] == first["root"]) & member["alone"].eqNullSafe(first["alone"])
    keeper, _ = stash(member.join(first, same).select("lh", "l2", "first"))
    gone = lined.select("id", "th", "pos", "lh", "l2").join(keeper, ["lh", "l2"]).where(_place() != F.col("first"))
    return gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def deduplicated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed), one row for every row of ``docs``.

    A null or empty text has no lines.  Other columns are ignored; no rows give no rows.
    """
    base = _documents(docs, id_col, text_col).select("doc_id", "id", "th", F.size("lines").cast("long").alias("n_lines"))
    joined = base.join(repeated_lines(docs, id_col, text_col, percent), ["id", "th"], "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with their repeated lines taken out of the text; no row goes."""
    gone = repeated_lines(docs, id_col, text_col, percent).toDF("__id", "__th", "__removed")
    text = F.col(text_col).cast("string")
    held = docs.withColumns({"__i": F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID)), "__t": F.xxhash64(text)})
    joined = held.join(gone, (F.col("__i") == F.col("__id")) & (F.col("__t") == F.col("__th")), "left")
    # one pass over the lines between the removed places: each gap is a slice
    edges = F.concat(F.array(F.lit(-1)), F.col("__removed"))
    lines = F.split(text, "\n")
    kept = F.flatten(
        F.zip_with(edges, F.concat(F.col("__removed"), F.array(F.size(lines))), lambda a, b: F.slice(F.col("__lines"), a + 2, b - a - 1))
    )
    joined = joined.withColumn("__lines", F.when(F.col("__removed").isNotNull(), lines))
    new = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, new).select(*docs.columns)
