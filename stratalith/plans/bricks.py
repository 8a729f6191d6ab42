"""Queries over bricks, expectations, split gates and link resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.operators import bricks, packs
from stratalith.plans.artifacts import FILES, OTHER, RESOLUTIONS, fusion_target
from stratalith.plans.retrieval import CLAIMS, TITLE
from stratalith.sources.tables import manifest_files, parent_edges, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


MARKDOWN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g'),
 '<h[1-6][^>]*>', chr(10) || '## ', 'g'), '<li[^>]*>', chr(10) || '- ', 'g'), '<p>|<br>|</(?:h[1-6]|li|p|div)>', chr(10), 'g'), '<[^>]*>', '', 'g')"""
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: Sections by lines, numbered by the headings seen so far.
SECTIONS = f"""(WITH l AS (SELECT page_id, md, unnest(list_transform(string_split(md, chr(10)), lambda s, i: {{'i': i, 's': s}})) AS x FROM (SELECT page_id, {MARKDOWN} AS md FROM pages)),
 h AS (SELECT page_id, md, x.i AS i, x.s AS s, regexp_full_match(x.s, '#{{1,6}}\\s+.+') AS head FROM l), n AS (SELECT *, sum(head::INT) OVER (PARTITION BY page_id ORDER BY i) AS sec, sum(head::INT) OVER (PARTITION BY page_id) AS heads FROM h),
 g AS (SELECT page_id, sec, any_value(heads) AS heads, coalesce(max(CASE WHEN head THEN trim(regexp_replace(s, '^#+', ''), {WS}) END), '') AS heading, trim(coalesce(string_agg(CASE WHEN NOT head THEN s END, chr(10) ORDER BY i), ''), {WS}) AS content FROM n GROUP BY page_id, sec)
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY sec) - 1 AS pos, heading, content FROM g WHERE heads = 0 OR (sec > 0 AND content <> ''))"""
LISTED = f"""list_filter(list_transform(list_concat(regexp_extract_all(content, '(?m)^[\\-*•]\\s+(.+)$', 1), regexp_extract_all(content, '(?m)^\\d+[.)]\\s+(.+)$', 1)), lambda c: trim(c, {WS})), lambda c: length(c) > 10)"""
SAID = CLAIMS.replace("regexp_replace(text", "regexp_replace(content")
_pair = lambda p: f"list_zip(regexp_extract_all(content, '{p}', 1), regexp_extract_all(content, '{p}', 2))"
DEFINED = f"""list_filter(list_transform(list_concat({_pair("(?i)([A-Z][a-zA-Z" + chr(92) + "s]+)" + chr(92) + "s+is" + chr(92) + "s+(.+?)" + chr(92) + ".")}, {_pair("(?m)^([A-Z][a-zA-Z" + chr(92) + "s]+):" + chr(92) + "s+(.+)$")}),
 lambda d: {{'t': trim(d[1], {WS}), 'x': trim(d[2], {WS})}}), lambda d: length(d.t) < 50 AND length(d.x) > 10)"""


def _pages(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), bricks.markdown(F.col("html")).alias("text"))


@query(f"""WITH b AS (SELECT page_id, pos, heading, content, {LISTED} AS listed, {SAID} AS said, {DEFINED} AS defined FROM {SECTIONS})
 SELECT page_id, pos, CASE WHEN len(defined) > 0 THEN 'concept' ELSE 'claim' END AS kind, CASE WHEN heading = '' THEN url ELSE heading END AS title, sha256(substr(content, 1, 200)) AS summary,
 CASE WHEN len(listed) > 0 THEN len(listed) ELSE len(said) END::BIGINT AS n_claims, sha256(array_to_string(CASE WHEN len(listed) > 0 THEN listed ELSE said END, '|')) AS claims, CASE WHEN len(listed) > 0 THEN 0.7 WHEN len(said) > 0 THEN 0.5 ELSE 0 END::DOUBLE AS claim_confidence,
 len(defined)::BIGINT AS n_definitions, sha256(array_to_string(list_transform(defined, lambda d: d.t || ': ' || d.x), '|')) AS definitions, 0.8::DOUBLE AS confidence FROM b JOIN pages USING (page_id)""")
def compile_bricks(spark, d):
    """A brick for each section of every page, its claims and definitions as digests."""
    made = bricks.compiled(_pages(spark, d))
    digest = lambda a: F.sha2(F.array_join(a, "|"), 256)
    return made.select(
        F.col("id").alias("page_id"), F.col("pos").cast("long").alias("pos"), "kind", "title", F.sha2("summary", 256).alias("summary"), F.size("claims").cast("long").alias("n_claims"),
        digest(F.transform("claims", lambda c: c["text"])).alias("claims"), F.coalesce(F.get("claims", F.lit(0))["confidence"], F.lit(0.0)).alias("claim_confidence"),
        F.size("definitions").cast("long").alias("n_definitions"), digest(F.transform("definitions", lambda x: F.concat_ws(": ", x["term"], x["text"]))).alias("definitions"), "confidence",
    )


@query(f"""WITH p AS (SELECT doc_id, 'brick_' || doc_id AS id, text, {CLAIMS} AS c FROM documents), e AS (SELECT doc_id, id, unnest(list_transform(c, lambda x, i: {{'i': i - 1, 'x': x}})) AS c FROM p)
 SELECT doc_id AS pack_id, id AS brick_id, 'concept' AS kind, {TITLE} AS title, sha256(substr(text, 1, 200)) AS summary, 1.0::DOUBLE AS confidence, '' AS parent FROM p
 UNION ALL SELECT doc_id, id || '_claim_' || c.i, 'claim', 'Claim: ' || substr(c.x, 1, 50) || '...', sha256(c.x), 0.5, id FROM e""")
def compile_packs(spark, d):
    """Each document as a pack: its concept, and its claims as bricks of their own."""
    text = F.col("text")
    rated = F.transform(T.claims(text), lambda c: F.struct(c.alias("text"), F.lit(0.5).alias("confidence")))
    held = table(spark, d, "documents").select(F.col("doc_id").alias("pack_id"), T.title(text).alias("title"), T.summary(text).alias("summary"), rated.alias("claims"))
    # the parent of a claim is null where its document has no id
    parent = F.when(F.col("kind") == "concept", "").otherwise(F.col("parent"))
    return bricks.pack_bricks(held).withColumns({"summary": F.sha2("summary", 256), "parent": parent})


@query("""WITH t AS (SELECT a.conv_id, a.turn, a.text AS asked, b.text AS said FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
 c AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN CASE conv_id % 3 WHEN 0 THEN true ELSE false END WHEN 1 THEN conv_id % 3 = 2 OR contains(said, 'UNKNOWN') WHEN 2 THEN conv_id % 3 IN (0, 1) ELSE true END AS behavior,
 contains(lower(said), lower(string_split(asked, ' ')[1])) AS contains, NOT contains(lower(said), 'password') AND NOT contains(lower(said), 'token') AS not_contains FROM t)
 SELECT *, behavior AND contains AND not_contains AS passed FROM c""")
def eval_checks(spark, d):
    """Every answer held against what its question expects."""
    turns = table(spark, d, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said"))
    pick = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("conv_id") % by + 1).cast("int"))
    status, behavior = pick(3, "complete", "partial", "unknown"), pick(4, "answer", "unknown", "partial", "any")
    found = bricks.expectations(status, F.col("said"), behavior, F.slice(F.split("asked", " "), 1, 1), F.array(F.lit("password"), F.lit("token")))
    checks = asked.join(said, ["conv_id", "turn"]).select("conv_id", "turn", found.alias("c")).select("conv_id", "turn", "c.*")
    return checks.withColumn("passed", F.col("behavior") & F.col("contains") & F.col("not_contains"))


def _split_plan(files):
    """A directive for almost every file: some paths unknown, some children out of range, some files left out."""
    k, line = F.col("l_orderkey"), F.split("path", "/")[1].cast("int")
    source = F.when((k % 29 == 0) & (line == 2), F.concat("path", F.lit("?"))).otherwise(F.col("path"))
    child = F.when((k % 23 == 0) & (line > 1), 9).otherwise(line % 3).cast("long")
    transform = F.when(line == 4, "drop").when(line == 5, "slice").otherwise("copy")
    rows = files.where(~((k % 17 == 0) & (line == 1))).select(k.alias("manifest"), line.cast("long").alias("position"), source.alias("path"), child.alias("child"), transform.alias("transform"))
    return rows.withColumn("lossy", F.col("transform") == "slice")


@query(f"""WITH f AS (SELECT *, split_part(path, '/', 2)::INT AS line FROM {FILES}), p AS (SELECT l_orderkey AS k, line, path AS was, CASE WHEN l_orderkey % 29 = 0 AND line = 2 THEN path || '?' ELSE path END AS path, CASE WHEN l_orderkey % 23 = 0 AND line > 1 THEN 9 ELSE line % 3 END AS child, line = 4 AS dropped FROM f WHERE NOT (l_orderkey % 17 = 0 AND line = 1)),
 e AS (SELECT k, arg_min(CASE WHEN child > 2 THEN 'child out of range' ELSE 'unknown source' END, line) AS e FROM p WHERE NOT dropped AND (child > 2 OR path <> was) GROUP BY k),
 u AS (SELECT DISTINCT l_orderkey AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = f.l_orderkey AND p.path = f.path))
 SELECT DISTINCT l_orderkey AS manifest, CASE WHEN l_orderkey % 13 = 0 THEN 'fewer than two children' WHEN l_orderkey % 19 = 0 THEN 'integrity' WHEN u.k IS NOT NULL THEN 'silent split' ELSE coalesce(e, 'passed') END AS verdict
 FROM f LEFT JOIN u ON u.k = l_orderkey LEFT JOIN e ON e.k = l_orderkey""")
def fission_gate(spark, d):
    """The first gate that each manifest's split plan fails, or that it passed."""
    files = manifest_files(spark, d)
    held = files.withColumnRenamed("l_orderkey", "manifest")
    k = F.col("manifest")
    hashes = packs.pack_hash(held, "manifest")
    declared = hashes.select("manifest", F.when(k % 19 == 0, F.lit("other")).otherwise(F.col("pack_hash")).alias("declared"), F.when(k % 13 == 0, 1).otherwise(3).cast("long").alias("children"))
    return packs.split_verdict(held, declared, _split_plan(files))


@query(f"""SELECT l_orderkey AS manifest, path, CASE WHEN line = 4 THEN -1 ELSE line % 3 END AS child, CASE WHEN line = 4 THEN 'drop' WHEN line = 5 THEN 'slice' ELSE 'copy' END AS transform, line = 5 AS lossy
 FROM (SELECT *, split_part(path, '/', 2)::BIGINT AS line FROM {FILES}) WHERE l_orderkey % 13 <> 0 AND l_orderkey % 19 <> 0 AND NOT (l_orderkey % 17 = 0 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1))
 AND NOT (l_orderkey % 29 = 0 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 2)) AND NOT (l_orderkey % 23 = 0 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (2, 3, 5, 6, 7)))""")
def fission_lineage(spark, d):
    """Where each file of a split that passed its gates went; -1 for what was dropped."""
    passed = fission_gate(spark, d).where("verdict = 'passed'").select("manifest")
    plan = _split_plan(manifest_files(spark, d)).join(passed, "manifest", "left_semi")
    return plan.select("manifest", "path", F.when(F.col("transform") == "drop", -1).otherwise(F.col("child")).alias("child"), "transform", "lossy")


@query(f"""WITH c AS (SELECT coalesce(resolution, 'unresolved') AS r FROM {FILES} a JOIN {OTHER} b USING (path) LEFT JOIN {RESOLUTIONS} r USING (path) WHERE a.sha256 <> b.sha256)
 SELECT count(*) FILTER (r IN ('take_primary', 'take_secondary', 'unresolved')) AS total, count(*) FILTER (r IN ('take_primary', 'take_secondary')) AS resolved, count(*) FILTER (r = 'unresolved') AS unresolved, count(*) FILTER (r = 'unresolved') = 0 AS all_resolved FROM c""")
def conflict_summary(spark, d):
    """How many conflicts of a merge are settled, of those whose path the merge keeps or leaves open."""
    clashes = fusion_target(spark, d).where("side = 'conflict'")
    unresolved = F.count_if(F.col("resolution") == "unresolved")
    return clashes.agg(F.count("*").alias("total"), F.count_if(F.col("resolution") != "unresolved").alias("resolved"), unresolved.alias("unresolved"), (unresolved == 0).alias("all_resolved"))


@query("""SELECT DISTINCT 'N:' || n_nationkey AS id, 'R:' || n_regionkey AS related, 'parent' AS how FROM nation UNION ALL SELECT DISTINCT 'N:' || c_nationkey, 'C:' || c_custkey, 'child' FROM customer JOIN nation ON n_nationkey = c_nationkey
 UNION ALL SELECT DISTINCT 'N:' || s_nationkey, 'S:' || s_suppkey, 'child' FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def related_nodes(spark, d):
    """Parents and children of every nation."""
    edges = parent_edges(spark, d)
    up = edges.where(F.col("dst").startswith("N:")).select(F.col("dst").alias("id"), F.col("src").alias("related"), F.lit("parent").alias("how"))
    down = edges.where(F.col("src").startswith("N:")).select(F.col("src").alias("id"), F.col("dst").alias("related"), F.lit("child").alias("how"))
    return up.unionByName(down).distinct()


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, href, count(*) AS uses, href IN (SELECT '/' || name FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM benchmark)) AS resolved FROM l GROUP BY page_id, href""")
def link_resolution(spark, d):
    """Links of every page, and whether the word they lead to is known."""
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    known = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).select(F.concat(F.lit("/"), "name").alias("href"), F.lit(True).alias("known")).distinct()
    return links.groupBy("page_id", "href").agg(F.count("*").alias("uses")).join(known, "href", "left").select("page_id", "href", "uses", F.coalesce("known", F.lit(False)).alias("resolved"))
