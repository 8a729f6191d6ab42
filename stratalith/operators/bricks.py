"""From documents to bricks: sections with their claims and definitions, as columns.

Every expression looks at the whole text.  A null text has no section, an empty one a
single section without a heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.functions import text as T

SPACE = " \t\n\r\x0b\x0c"
#: Blanks and letters as the SQL's patterns know them: no vertical tab, and without case also the long s and the Kelvin sign.
_B, _L = r"[ \t\n\f\r]", r"a-zA-Z\x{17F}\x{212A}"
#: Headings are told line by line: their blanks hold no line feed.
HEADING = r"(?md)^#{1,6}[ \t\f\r]+(.+)$"
BULLET = rf"(?md)^[\-*•]{_B}+(.+)$"
NUMBERED = rf"(?md)^\d+[.)]{_B}+(.+)$"
_IS = rf"([{_L}][{_L} \t\n\f\r]+){_B}+[iI][sS\x{{17F}}]{_B}+(.+?)\."
IS = "(?d)" + _IS
#: ``IS``, tried only where a run of letters and blanks begins: within a run it matches there or nowhere.
IS_FROM_RUN = rf"(?d)(?:\G|[^{_L} \t\n\f\r]){_B}*" + _IS
COLON = rf"(?md)^([A-Z][a-zA-Z \t\n\f\r]++):{_B}+(.+)$"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def markdown(html: Column) -> Column:
    """Headings, list items and paragraphs of a page as Markdown lines, other markup dropped."""
    out = html
    for dropped in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<!--.*?-->"):
        out = F.regexp_replace(out, "(?s)" + dropped, "")
    out = F.regexp_replace(out, r"<h([1-6])[^>]*>", "\n## ")
    out = F.regexp_replace(F.regexp_replace(out, r"<li[^>]*>", "\n- "), r"<p>|<br>|</(?:h[1-6]|li|p|div)>", "\n")
    return F.regexp_replace(out, r"<[^>]*>", "")


def sections(text: Column) -> Column:
    """Array of (heading, content): what follows each heading, unless it is blank; the whole text where there is no heading.

    What stands before the first heading belongs to no section.
    """
    heads, parts = _all(text, HEADING), F.split(text, HEADING)
    under = F.transform(heads, lambda h, i: F.struct(stripped(h).alias("heading"), stripped(F.get(parts, i + 1)).alias("content")))
    return F.when(F.size(heads) > 0, F.filter(under, lambda s: s["content"] != "")).when(
        text.isNotNull(), F.array(F.struct(F.lit("").alias("heading"), stripped(text).alias("content")))
    )


def claims(content: Column) -> Column:
    """Array of (text, confidence): list items longer than 10, bullets first, or else of the first five sentences those of claim length."""
    listed = F.filter(F.transform(F.concat(_all(content, BULLET), _all(content, NUMBERED)), stripped), lambda c: F.length(c) > 10)
    rated = lambda c, x: F.transform(c, lambda t: F.struct(t.alias("text"), F.lit(x).alias("confidence")))
    return F.when(F.size(listed) > 0, rated(listed, 0.7)).otherwise(rated(T.claims(content), 0.5))


def definitions(content: Column) -> Column:
    """Array of (term, text): "X is Y." and then "X: Y" lines, of terms below 50 characters and texts beyond 10."""
    said = F.transform(_all(content, IS_FROM_RUN, 0), lambda m: F.struct(stripped(F.regexp_extract(m, IS, 1)).alias("term"), stripped(F.regexp_extract(m, IS, 2)).alias("text")))
    lines = F.transform(_all(content, COLON, 0), lambda m: F.struct(stripped(F.regexp_extract(m, COLON, 1)).alias("term"), stripped(F.regexp_extract(m, COLON, 2)).alias("text")))
    return F.filter(F.concat(said, lines), lambda d: (F.length(d["term"]) < 50) & (F.length(d["text"]) > 10))


def compiled(docs: DataFrame) -> DataFrame:
    """(id, pos, kind, title, summary, claims, definitions, confidence): a brick for each section of ``docs`` (id, title, text).

    A section that defines a term is a concept, any other a claim.
    """
    each = docs.select("id", F.col("title").alias("__title"), F.posexplode(sections(F.col("text"))).alias("pos", "s"))
    held = each.select("id", "pos", "__title", "s.heading", "s.content", claims(F.col("s.content")).alias("claims"), definitions(F.col("s.content")).alias("definitions"))
    title = F.when(F.col("heading") == "", F.col("__title")).otherwise(F.col("heading"))
    kind = F.when(F.size("definitions") > 0, "concept").otherwise("claim")
    return held.select("id", "pos", kind.alias("kind"), title.alias("title"), T.summary(F.col("content")).alias("summary"), "claims", "definitions", F.lit(0.8).alias("confidence"))


def pack_bricks(packs: DataFrame) -> DataFrame:
    """(pack_id, brick_id, kind, title, summary, confidence, parent): a concept for each pack and a brick for each of its claims.

    ``packs`` has pack_id, title, summary and claims, an array of (text, confidence); the
    n-th claim's brick hangs on the concept.
    """
    concept = F.concat(F.lit("brick_"), F.col("pack_id").cast("string"))
    first = packs.select("pack_id", concept.alias("brick_id"), F.lit("concept").alias("kind"), "title", "summary", F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("parent"))
    each = packs.select("pack_id", concept.alias("parent"), F.posexplode("claims").alias("pos", "c"))
    own = F.concat(F.col("parent"), F.lit("_claim_"), F.col("pos").cast("string"))
    title = F.concat(F.lit("Claim: "), F.substring("c.text", 1, 50), F.lit("..."))
    return first.unionByName(each.select("pack_id", own.alias("brick_id"), F.lit("claim").alias("kind"), title.alias("title"), F.col("c.text").alias("summary"), F.col("c.confidence").alias("confidence"), "parent"))


def expectations(status: Column, output: Column, behavior: Column, contains: Column, forbidden: Column) -> Column:
    """(behavior, contains, not_contains) of one answer: whether its status and its words are the expected ones.

    ``contains`` and ``forbidden`` are arrays of words, compared without case.
    """
    held = F.lower(output)
    as_expected = (
        F.when(behavior == "answer", status == "complete").when(behavior == "unknown", (status == "unknown") | output.contains("UNKNOWN"))
        .when(behavior == "partial", status.isin("partial", "complete")).otherwise(True)
    )
    return F.struct(
        as_expected.alias("behavior"), F.forall(contains, lambda w: held.contains(F.lower(w))).alias("contains"),
        (~F.exists(forbidden, lambda w: held.contains(F.lower(w)))).alias("not_contains"),
    )
