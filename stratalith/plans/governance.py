"""Queries over gates, constraints, deltas, tokens, plans and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.operators import reasoning
from stratalith.sources.tables import manifest_files, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN 60 + p_size END AS vmaf, 30 + p_size % 20 AS psnr, 0.98 + (p_size % 3) * 0.01 AS ssim FROM part)
 SELECT p_partkey, coalesce(vmaf >= 95, false) OR coalesce(psnr >= 45 AND ssim >= 0.995, false) AS passed FROM m""")
def quality_gate(spark, d):
    size = F.col("p_size")
    vmaf, psnr, ssim = F.when(size % 5 != 0, 60 + size), 30 + size % 20, 0.98 + (size % 3) * 0.01
    passed = F.coalesce(vmaf >= 95, F.lit(False)) | F.coalesce((psnr >= 45) & (ssim >= 0.995), F.lit(False))
    return table(spark, d, "part").select("p_partkey", passed.alias("passed"))


CONSTRAINTS = ["not idiot", "the", "no password", "zebra"]


@query("""WITH t AS (SELECT doc_id, lower(array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ') || ' ' || substr(text, 1, 200)) AS t FROM documents),
 v AS (SELECT doc_id, (CASE WHEN contains(t, 'idiot') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'the') THEN 0 ELSE 0.5 END) + (CASE WHEN contains(t, 'password') THEN 1 ELSE 0 END) + (CASE WHEN contains(t, 'zebra') THEN 0 ELSE 0.5 END) AS v FROM t)
 SELECT doc_id, round(greatest(0, 1 - v * 0.2), 6)::DOUBLE AS alignment FROM v""")
def constraint_alignment(spark, d):
    """1 less a fifth a broken prohibition and a tenth a missing wish, down to 0."""
    text = F.lower(F.concat_ws(" ", T.title(F.col("text")), T.summary(F.col("text"))))
    broken = F.lit(0.0)
    for c in CONSTRAINTS:
        if c.startswith(("not ", "no ")):
            broken += F.when(text.contains(c.replace("not ", "").replace("no ", "")), 1.0).otherwise(0.0)
        else:
            broken += F.when(text.contains(c), 0.0).otherwise(0.5)
    return table(spark, d, "documents").select("doc_id", F.round(F.greatest(F.lit(0.0), 1 - broken * 0.2), 6).alias("alignment"))


@query("""WITH s AS (SELECT doc_id, text, substr(text, 1, 120) AS h FROM documents), p AS (SELECT *, CASE WHEN contains(h, '. ') THEN length(h) - length(string_split(h, '. ')[-1]) - 1 ELSE 0 END AS stop FROM s)
 SELECT doc_id, CASE WHEN length(text) <= 120 THEN text WHEN stop > 60 THEN substr(text, 1, stop) ELSE substr(text, 1, 117) || '...' END AS short FROM p""")
def truncate_sentence(spark, d):
    """At most 120 characters: up to the last sentence end past the middle, or cut with dots."""
    text, head = F.col("text"), F.substring("text", 1, 120)
    stop = F.when(head.contains(". "), F.length(head) - F.length(F.element_at(F.split(head, r"\. "), -1)) - 1).otherwise(0)
    short = F.when(F.length(text) <= 120, text).when(stop > 60, F.substr(text, F.lit(1), stop)).otherwise(F.concat(F.substring(text, 1, 117), F.lit("...")))
    return table(spark, d, "documents").select("doc_id", short.alias("short"))


@query("""SELECT user_id, count(DISTINCT CASE WHEN value >= 5 THEN 'pos' ELSE 'neg' END) > 1 AS contradictory, count(*) > 60 AS too_large, count(*) AS n FROM events GROUP BY user_id""")
def delta_validation(spark, d):
    """Whether a delta is too large or asserts both polarities of one key."""
    polarity = F.when(F.col("value") >= 5, "pos").otherwise("neg")
    return table(spark, d, "events").groupBy("user_id").agg((F.count_distinct(polarity) > 1).alias("contradictory"), (F.count("*") > 60).alias("too_large"), F.count("*").alias("n"))


@query("""SELECT a.doc_id, sha256(a.text) AS golden, sha256(b.text) AS actual FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE sha256(a.text) <> sha256(b.text)""")
def golden_differences(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    golden = docs.select("doc_id", F.col("h").alias("golden"))
    return golden.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("actual")), "doc_id").where("golden <> actual")


@query("""SELECT o_orderkey, o_custkey AS who, 'order ' || o_orderstatus AS what, strftime(o_orderdate, '%Y-%m-%d') AS "when", n_name AS "where", o_orderpriority AS why, c_mktsegment AS how
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def five_questions(spark, d):
    orders = table(spark, d, "orders")
    joined = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        "o_orderkey", F.col("o_custkey").alias("who"), F.concat(F.lit("order "), "o_orderstatus").alias("what"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("when"),
        F.col("n_name").alias("where"), F.col("o_orderpriority").alias("why"), F.col("c_mktsegment").alias("how"),
    )


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0)")
def dangling_references(spark, d):
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").where("doc_id % 9 <> 0").select("doc_id"), "doc_id", "left_anti")


@query("""WITH cur AS (SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN lower(source) ELSE lower(text) END AS t FROM documents WHERE doc_id % 33 <> 1)
 SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(t, '[^a-z0-9]+'), lambda x: length(x) >= 2))) AS token FROM cur) GROUP BY token HAVING count(*) >= 3""")
def incremental_index(spark, d):
    """Document frequencies after removals and replacements, from the old ones and the changed documents alone."""
    docs = table(spark, d, "documents")
    freq = lambda rows, c, sign: rows.select(F.explode(F.array_distinct(T.plain_tokens(F.col(c)))).alias("token"), F.lit(sign).alias("d"))
    replaced, removed = (F.col("doc_id") % 20 == 0), (F.col("doc_id") % 33 == 1)
    old = freq(docs, "text", 1).groupBy("token").agg(F.sum("d").alias("d"))
    change = freq(docs.where(removed | replaced), "text", -1).unionByName(freq(docs.where(replaced & ~removed), "source", 1))
    return old.unionByName(change.groupBy("token").agg(F.sum("d").alias("d"))).groupBy("token").agg(F.sum("d").alias("df")).where("df >= 3")


@query("""SELECT user_id, event_id, sha256(user_id || '|' || event_id || '|' || event_type || '|' || (event_id + 100)) AS token, event_type IN ('click', 'view') AND event_id + 100 >= 5000 AS allowed FROM events""")
def capability_tokens(spark, d):
    """A token over user, head, scope and expiry, and whether it holds for reading at time 5000."""
    expiry = F.col("event_id") + 100
    token = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_id").cast("string"), "event_type", expiry.cast("string")), 256)
    return table(spark, d, "events").select("user_id", "event_id", token.alias("token"), (F.col("event_type").isin("click", "view") & (expiry >= 5000)).alias("allowed"))


@query("""WITH f AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS path, l_orderkey, l_quantity::BIGINT AS q FROM lineitem)
 SELECT path, sha256(CASE WHEN l_orderkey % 4 = 0 THEN sha256(path || '/' || q) || ':redacted' ELSE sha256(path || '/' || q) END) AS sha256, l_orderkey % 4 = 0 AS redacted FROM f""")
def redact_manifest(spark, d):
    hit = F.col("l_orderkey") % 4 == 0
    body = F.when(hit, F.concat("sha256", F.lit(":redacted"))).otherwise(F.col("sha256"))
    return manifest_files(spark, d).select("path", F.sha2(body, 256).alias("sha256"), hit.alias("redacted"))


@query("""SELECT conv_id, sum(CASE WHEN role = 'user' AND NOT answered THEN 1 ELSE 0 END)::BIGINT AS open_claims FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NOT NULL AS answered FROM conversations) GROUP BY conv_id""")
def commitment_consistency(spark, d):
    """Questions of a session that no later turn answers."""
    answered = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).isNotNull()
    held = table(spark, d, "conversations").withColumn("answered", answered)
    return held.groupBy("conv_id").agg(F.count_if((F.col("role") == "user") & ~F.col("answered")).alias("open_claims"))


@query("""SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY quality DESC, n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)) WHERE rank <= 10""")
def needed_sources(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("quality"), F.desc("n_chars"), "doc_id")
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return joined.select("source", "doc_id", F.row_number().over(w).cast("long").alias("rank")).where("rank <= 10")


@query("""WITH c AS (SELECT source, count(*) AS total, count(l.doc_id) AS covered, coalesce(sum(l.toxic), 0) AS conflicts FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source)
 SELECT source, CASE WHEN total = 0 THEN 'UNKNOWN' WHEN covered = 0 THEN 'FAILED' WHEN covered < total OR conflicts > 0 THEN 'PARTIAL' ELSE 'COMPLETE' END AS status, round(covered / total, 6) AS coverage FROM c""")
def answer_status(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").withColumn("has", F.lit(1)), "doc_id", "left")
    parts = joined.groupBy("source").agg(F.count("*").alias("total"), F.count("has").alias("covered"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("conflicts"))
    status = reasoning.status(F.col("covered"), F.col("total"), F.col("conflicts"))
    return parts.select("source", status.alias("status"), F.round(F.col("covered") / F.col("total"), 6).alias("coverage"))


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '^(what is|define|explain)\\s+') THEN 'retrieve>synthesize>format' WHEN regexp_matches(t, '^(how|why|when|where)\\s+') THEN 'retrieve>deduce>synthesize>format'
 WHEN regexp_matches(t, '^(compare|difference|versus|vs)\\s+') THEN 'retrieve>compare>synthesize>format' WHEN regexp_matches(t, '^(find|search|list|show)\\s+') THEN 'retrieve>verify>format'
 WHEN regexp_matches(t, '^(prove|verify|confirm|check)\\s+') THEN 'retrieve>deduce>verify>format' WHEN regexp_matches(t, '^(is it true|does|can|will)\\s+') THEN 'retrieve>deduce>format' ELSE 'retrieve>synthesize>format' END AS steps
 FROM (SELECT conv_id, turn, lower(trim(text)) AS t FROM conversations)""")
def plan_steps(spark, d):
    """The plan of every turn, by its intent."""
    steps = F.array_join(reasoning.plan(T.intent(F.col("text"))), ">")
    return table(spark, d, "conversations").select("conv_id", "turn", steps.alias("steps"))


@query("""SELECT l_orderkey, string_agg(k || '=' || v, ',' ORDER BY k) AS attrs, coalesce(max(CASE WHEN k = 'A' THEN v END), 0) AS a FROM (SELECT l_orderkey, l_returnflag AS k, count(*) AS v FROM lineitem GROUP BY ALL) GROUP BY l_orderkey""")
def sorted_attributes(spark, d):
    """Open attributes as a map, read with a default and shown by key."""
    each = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("k")).agg(F.count("*").alias("v"))
    maps = each.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return maps.select("l_orderkey", shown.alias("attrs"), F.coalesce(F.try_element_at("m", F.lit("A")), F.lit(0).cast("long")).alias("a"))
