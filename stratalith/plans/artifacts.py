"""Queries over manifests, time lines, sessions, codecs and proofs."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.operators import codecs, packs, proofs, temporal
from stratalith.sources.tables import manifest_files, table
from stratalith.streaming import sessions

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


FILES = """(SELECT l_orderkey, l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS path,
 sha256(l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_quantity::BIGINT) AS sha256,
 length(l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || l_quantity::BIGINT) AS size FROM lineitem)"""
#: A second manifest: every seventh order missing, every eleventh changed.
OTHER = f"(SELECT l_orderkey, path, CASE WHEN l_orderkey % 11 = 0 THEN sha256(sha256) ELSE sha256 END AS sha256, size + CASE WHEN l_orderkey % 13 = 0 THEN 1 ELSE 0 END AS size FROM {FILES} WHERE l_orderkey % 7 <> 0)"


def _other(files):
    return files.where(F.col("l_orderkey") % 7 != 0).select(
        "l_orderkey", "path", F.when(F.col("l_orderkey") % 11 == 0, F.sha2("sha256", 256)).otherwise(F.col("sha256")).alias("sha256"),
        (F.col("size") + F.when(F.col("l_orderkey") % 13 == 0, 1).otherwise(0)).alias("size"),
    )


@query(f"SELECT l_orderkey AS manifest, count(*) AS n_files, sha256(string_agg(path || ':' || sha256 || chr(10), '' ORDER BY path)) AS pack_hash FROM {FILES} GROUP BY l_orderkey")
def manifest_pack_hash(spark, d):
    return packs.pack_hash(manifest_files(spark, d).withColumnRenamed("l_orderkey", "manifest"), "manifest")


STATUS = "CASE WHEN b.sha256 IS NULL THEN 'missing' WHEN a.sha256 IS NULL THEN 'extra' WHEN a.sha256 <> b.sha256 THEN 'hash' WHEN a.size <> b.size THEN 'size' ELSE 'ok' END"


@query(f"SELECT path, {STATUS} AS status FROM {FILES} a FULL JOIN {OTHER} b USING (path)")
def manifest_verify(spark, d):
    files = manifest_files(spark, d)
    return packs.compare(files, _other(files))


@query(f"SELECT {STATUS} AS status, count(*) AS n FROM {FILES} a FULL JOIN {OTHER} b USING (path) GROUP BY 1")
def tree_diff(spark, d):
    files = manifest_files(spark, d)
    return packs.compare(files, _other(files)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT path, count(DISTINCT sha256) AS n_hashes FROM (SELECT path, sha256 FROM {FILES} UNION ALL SELECT path, sha256 FROM {OTHER}) GROUP BY path HAVING count(DISTINCT sha256) > 1")
def fusion_conflicts(spark, d):
    files = manifest_files(spark, d)
    return packs.conflicts(files.select("path", "sha256").unionByName(_other(files).select("path", "sha256")))


RESOLUTIONS = """(SELECT DISTINCT path, CASE l_orderkey % 5 WHEN 0 THEN 'take_primary' WHEN 1 THEN 'take_secondary' WHEN 2 THEN 'skip' ELSE 'manual' END AS resolution FROM """ + FILES + " WHERE l_orderkey % 11 = 0 AND l_orderkey % 5 < 4)"


@query(f"""WITH j AS (SELECT path, a.sha256 AS ha, a.size AS za, b.sha256 AS hb, b.size AS zb, resolution, a.sha256 IS NOT NULL AND b.sha256 IS NOT NULL AND a.sha256 <> b.sha256 AS clash
 FROM {FILES} a FULL JOIN {OTHER} b USING (path) LEFT JOIN {RESOLUTIONS} r USING (path))
 SELECT path, coalesce(CASE WHEN NOT clash THEN coalesce(ha, hb) WHEN resolution = 'take_primary' THEN ha WHEN resolution = 'take_secondary' THEN hb END, '') AS sha256,
 coalesce(CASE WHEN NOT clash THEN CASE WHEN ha IS NULL THEN zb ELSE za END WHEN resolution = 'take_primary' THEN za WHEN resolution = 'take_secondary' THEN zb END, -1) AS size,
 CASE WHEN clash THEN 'conflict' WHEN hb IS NULL THEN 'primary' WHEN ha IS NULL THEN 'secondary' ELSE 'shared' END AS side, CASE WHEN clash THEN coalesce(resolution, 'unresolved') ELSE '' END AS resolution
 FROM j WHERE NOT clash OR resolution IS NULL OR resolution IN ('take_primary', 'take_secondary')""")
def fusion_target(spark, d):
    files = manifest_files(spark, d)
    k = F.col("l_orderkey") % 5
    how = files.where((F.col("l_orderkey") % 11 == 0) & (k < 4)).select("path", F.when(k == 0, "take_primary").when(k == 1, "take_secondary").when(k == 2, "skip").otherwise("manual").alias("resolution")).distinct()
    merged = packs.fuse(files.drop("l_orderkey"), _other(files).drop("l_orderkey"), how)
    return merged.withColumns({"sha256": F.coalesce("sha256", F.lit("")), "size": F.coalesce("size", F.lit(-1).cast("long")), "resolution": F.coalesce("resolution", F.lit(""))})


def _directives(files):
    k = F.col("l_orderkey")
    transform = F.when(k % 10 == 0, "drop").when(k % 10 == 1, "slice").otherwise("copy")
    return files.where(k % 17 != 0).select("path", (k % 3).cast("long").alias("child"), transform.alias("transform"), F.lit(5).cast("long").alias("length")).distinct()


SPLIT = f"""(SELECT l_orderkey % 3 AS child, path, CASE WHEN l_orderkey % 10 <> 0 THEN sha256 END AS sha256, CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_orderkey % 10 = 1 THEN least(size, 5) ELSE size END AS size,
 CASE WHEN l_orderkey % 10 = 0 THEN size ELSE 0 END AS lost, l_orderkey % 10 = 1 AND size > 5 AS truncated FROM {FILES} WHERE l_orderkey % 17 <> 0)"""


@query(f"SELECT child, path, coalesce(sha256, '') AS sha256, coalesce(size, -1) AS size, lost, truncated FROM {SPLIT}")
def fission_children(spark, d):
    files = manifest_files(spark, d)
    held = packs.split(files.drop("l_orderkey"), _directives(files))
    return held.withColumns({"sha256": F.coalesce("sha256", F.lit("")), "size": F.coalesce("size", F.lit(-1).cast("long"))})


@query(f"SELECT child, count(*) AS files, sum((sha256 IS NULL)::INT)::BIGINT AS dropped, sum(truncated::INT)::BIGINT AS truncated, sum(lost)::BIGINT AS bytes_lost FROM {SPLIT} GROUP BY child")
def fission_loss(spark, d):
    return fission_children(spark, d).groupBy("child").agg(F.count("*").alias("files"), F.count_if(F.col("sha256") == "").alias("dropped"), F.count_if(F.col("truncated")).alias("truncated"), F.sum("lost").alias("bytes_lost"))


@query(f"SELECT path FROM {FILES} WHERE l_orderkey % 17 = 0")
def split_unaccounted(spark, d):
    files = manifest_files(spark, d)
    return packs.unaccounted(files.drop("l_orderkey"), _directives(files))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS survivor, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_hash(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("survivor"), F.count("*").alias("copies"))


@query(f"SELECT sha256, count(*) AS paths, min(path) AS first_path FROM {FILES} WHERE sha256 LIKE '00%' GROUP BY sha256")
def hash_index_lookup(spark, d):
    return manifest_files(spark, d).where(F.col("sha256").startswith("00")).groupBy("sha256").agg(F.count("*").alias("paths"), F.min("path").alias("first_path"))


@query(f"SELECT l_orderkey AS manifest, sha256(string_agg(path || ':' || sha256 || chr(10), '' ORDER BY path) || chr(10)) AS commitment FROM {FILES} GROUP BY l_orderkey")
def seal_commitment(spark, d):
    line = F.struct("path", F.concat(F.col("path"), F.lit(":"), F.col("sha256"), F.lit("\n")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "")
    return manifest_files(spark, d).groupBy(F.col("l_orderkey").alias("manifest")).agg(packs.sealed(text).alias("commitment"))


@query(f"""SELECT l_orderkey % 100 AS receipt, bool_and(status <> 'hash') AS passed, string_agg(DISTINCT status, ',' ORDER BY status) AS gates FROM (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, {STATUS} AS status
 FROM {FILES} a FULL JOIN {OTHER} b USING (path)) GROUP BY 1""")
def receipt_gates(spark, d):
    files = manifest_files(spark, d)
    status = packs.compare(files, _other(files)).withColumn("receipt", F.split("path", "/")[0].cast("long") % 100)
    return status.groupBy("receipt").agg(F.every(F.col("status") != "hash").alias("passed"), F.array_join(F.array_sort(F.collect_set("status")), ",").alias("gates"))


@query(f"SELECT path FROM {FILES} WHERE NOT regexp_matches(path, '^(?:.*/)?13$') AND regexp_matches(path, '^1[^/]*/1/.*')")
def glob_policy(spark, d):
    return manifest_files(spark, d).where(T.allowed(F.col("path"), ["1*/1/**"], ["**/13"])).select("path")


@query("""WITH s AS (SELECT user_id, ts, value FROM events WHERE event_type = 'click'), q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
 SELECT q.event_id, q.user_id, coalesce(s.value, 0.5) AS value FROM q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts""")
def asof_last_value(spark, d):
    events = table(spark, d, "events")
    samples, asked = events.where("event_type = 'click'").select("user_id", "ts", "value"), events.where("event_type = 'error'").select("user_id", "ts", "event_id")
    return temporal.asof(samples, asked, "user_id", "ts", "value", default=0.5).select("event_id", "user_id", "value")


ANCHORS = "(SELECT user_id, event_id AS tick, event_id * 3 + (user_id % 7) AS frame FROM events WHERE event_id % 4 = 0)"


@query(f"""WITH a AS {ANCHORS}, q AS (SELECT user_id, event_id AS tick FROM events WHERE event_id % 4 = 1), b AS (SELECT user_id, tick, frame, lead(tick) OVER w AS tick2, lead(frame) OVER w AS frame2, row_number() OVER w AS n FROM a WINDOW w AS (PARTITION BY user_id ORDER BY tick))
 SELECT q.user_id, q.tick, CASE WHEN p.tick IS NULL THEN (SELECT frame FROM b f WHERE f.user_id = q.user_id AND f.n = 1) WHEN p.tick2 IS NULL OR p.tick = q.tick THEN p.frame
 ELSE p.frame + trunc((p.frame2 - p.frame) * (q.tick - p.tick) / (p.tick2 - p.tick))::BIGINT END AS frame FROM q LEFT JOIN b p ON p.user_id = q.user_id AND p.tick <= q.tick AND (p.tick2 IS NULL OR q.tick < p.tick2)""")
def bracket_interpolate(spark, d):
    events = table(spark, d, "events")
    anchors = events.where("event_id % 4 = 0").select("user_id", F.col("event_id").alias("tick"), (F.col("event_id") * 3 + F.col("user_id") % 7).alias("frame"))
    return temporal.interpolated(anchors, events.where("event_id % 4 = 1").select("user_id", F.col("event_id").alias("tick")), "user_id")


@query("""SELECT event_id, CASE WHEN epoch_us(ts) // 1000000 % 14400 < 10800 THEN epoch_us(ts) // 14400000000 ELSE -1 END AS segment_id FROM events""")
def interval_lookup(spark, d):
    """Segments of three hours, one every four."""
    asked = table(spark, d, "events").select(F.lit(0).alias("k"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("t"), "event_id")
    first, last = (F.floor(f("t") / 14400) for f in (F.min, F.max))
    bounds = asked.agg(first.cast("long").alias("a"), last.cast("long").alias("b"))
    day = (F.col("t") / 86400).cast("long")
    segments = bounds.select(F.explode(F.sequence("a", "b")).alias("segment_id")).select((F.col("segment_id") * 14400 / 86400).cast("long").alias("k"), "segment_id", (F.col("segment_id") * 14400).alias("start"), (F.col("segment_id") * 14400 + 10800).alias("end"))
    return temporal.segment_at(segments, asked.withColumn("k", day), "k").select("event_id", F.coalesce("segment_id", F.lit(-1)).alias("segment_id"))


@query("""WITH s AS (SELECT user_id, event_id AS a, event_id + (event_id % 200) AS b FROM events) SELECT user_id, a, prev AS previous_end FROM (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY a, b) AS prev FROM s) WHERE a < prev""")
def overlap_check(spark, d):
    spans = table(spark, d, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.col("event_id") % 200).alias("b"))
    return temporal.overlaps(spans, "user_id", "a", "b").select("user_id", "a", "previous_end")


@query("""SELECT user_id, event_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE value <= p""")
def monotonic_check(spark, d):
    return temporal.not_rising(table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id")


@query("""SELECT epoch_us(ts) // 14400000000 AS segment_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1""")
def fixed_segments(spark, d):
    segment = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 14400000000).cast("long")
    return table(spark, d, "events").groupBy(segment.alias("segment_id")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query()
def scene_thinning(spark, d):
    """A cut stays only if it comes more than the least duration after the last kept one: a fold by user."""
    cuts = table(spark, d, "events").where("value > 5").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("cuts"))
    kept = F.aggregate("cuts", F.array().cast("array<bigint>"), lambda k, c: F.when((F.size(k) == 0) | (c > F.coalesce(F.get(k, F.size(k) - 1), F.lit(0)) + 500), F.concat(k, F.array(c))).otherwise(k))
    return cuts.select("user_id", F.explode(kept).alias("cut"))


@query("""SELECT p_brand, arg_min(p_partkey, {'a': CASE WHEN p_size >= 10 THEN 0 ELSE 1 END, 'b': p_retailprice, 'c': p_partkey}) AS best, min(CASE WHEN p_size >= 10 THEN 0 ELSE 1 END) = 0 AS passed FROM part GROUP BY p_brand""")
def best_passing_encoder(spark, d):
    """The cheapest part of a brand that passes the gate; if none does, the cheapest of all."""
    order = F.struct(F.when(F.col("p_size") >= 10, 0).otherwise(1).alias("fails"), "p_retailprice", "p_partkey")
    best = table(spark, d, "part").groupBy("p_brand").agg(F.min(order).alias("b"))
    return best.select("p_brand", F.col("b.p_partkey").alias("best"), (F.col("b.fails") == 0).alias("passed"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def tumbling_events(spark, d):
    return sessions.tumbling(table(spark, d, "events"), "ts", "1 hour", "event_type")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
 SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, s""")
def session_events(spark, d):
    return sessions.sessions(table(spark, d, "events"), "ts", "6 hours", "user_id").select("user_id", "start", "end", "n")


@query("""SELECT conv_id, role, turn AS last_turn, CASE WHEN contains(text, '?') THEN 'open' WHEN length(text) > 200 THEN 'fulfilled' ELSE 'active' END AS status FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1""")
def commitment_state(spark, d):
    status = F.when(F.col("text").contains("?"), "open").when(F.length("text") > 200, "fulfilled").otherwise("active")
    return sessions.latest(table(spark, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", F.col("turn").alias("last_turn"), status.alias("status"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, sha256(repeat('0', 64) || '|' || role || ':' || text) AS head FROM conversations WHERE turn = 0 UNION ALL
 SELECT n.conv_id, n.turn, sha256(c.head || '|' || n.role || ':' || n.text) FROM c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1) SELECT conv_id, turn, head FROM c""")
def transition_chain(spark, d):
    return sessions.hash_chain(table(spark, d, "conversations"), "conv_id", "turn", F.concat_ws(":", "role", "text"))


@query("""SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, max(turn) AS longest FROM conversations GROUP BY role""")
def transition_counts(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("longest"))


@query("""WITH w AS (SELECT list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS phrase FROM w WHERE len(w) >= 3)
 SELECT phrase, count(*) AS count, 2 * count(*) AS score FROM g GROUP BY phrase HAVING count(*) >= 10""")
def ngram_phrases(spark, d):
    return codecs.ngram_phrases(table(spark, d, "documents").select("text"), 3, 10)


def _vectorised(name, column):
    return F.pandas_udf(getattr(codecs, name), codecs.SCHEMAS[name])(column)


@query()
def codec_race(spark, d):
    return table(spark, d, "documents").select("doc_id", _vectorised("raced", "text").alias("r")).select("doc_id", "r.branch", "r.n_in", "r.n_out")


@query("SELECT doc_id, true AS intact FROM documents")
def phrase_codec_roundtrip(spark, d):
    return table(spark, d, "documents").select("doc_id", _vectorised("phrase_round_trip", "text").alias("r")).select("doc_id", F.col("r.intact").alias("intact"))


@query("SELECT page_id, ceil(octet_length(encode(html)) / 2048)::BIGINT AS n_blocks, true AS intact FROM pages")
def container_roundtrip(spark, d):
    return table(spark, d, "pages").select("page_id", _vectorised("container_round_trip", "html").alias("r")).select("page_id", "r.n_blocks", "r.intact")


A, B, X, Y, Z = ["atom", "A"], ["atom", "B"], "x", "y", "z"
_PROOFS = [
    ([A, ["imp", A, B]], B, [("ASSUME", [], A), ("ASSUME", [], ["imp", A, B]), ("IMP_ELIM", [0, 1], B)]),
    ([], ["eq", X, X], [("EQ_REFL", [], ["eq", X, X])]),
    ([A], B, [("ASSUME", [], B)]),
    ([A, B], ["and", A, B], [("ASSUME", [], A), ("ASSUME", [], B), ("AND_INTRO", [0, 1], ["and", A, B])]),
    ([A, B], ["and", A, B], [("ASSUME", [], A), ("ASSUME", [], B), ("AND_INTRO", [1, 0], ["and", A, B])]),
    ([["and", A, B]], ["or", B, A], [("ASSUME", [], ["and", A, B]), ("AND_ELIM_R", [0], B), ("OR_INTRO_L", [1], ["or", B, A])]),
    ([A, ["not", A]], ["atom", "False"], [("ASSUME", [], ["not", A]), ("ASSUME", [], A), ("NOT_ELIM", [0, 1], ["atom", "False"])]),
    ([["eq", X, Y], ["eq", Y, Z]], ["eq", Z, X], [("ASSUME", [], ["eq", X, Y]), ("ASSUME", [], ["eq", Y, Z]), ("EQ_TRANS", [1, 0], ["eq", X, Z]), ("EQ_SYMM", [2], ["eq", Z, X])]),
    ([["eq", X, Y], ["atom", "P", X]], ["atom", "P", Y], [("ASSUME", [], ["atom", "P", X]), ("ASSUME", [], ["eq", X, Y]), ("EQ_SUBST_PRED", [0, 1], ["atom", "P", Y])]),
    ([A], A, [("REITERATE", [1], A), ("ASSUME", [], A)]),
    ([A], B, [("ASSUME", [], A)]),
]
_VERDICTS = ["pass", "pass", "n0: ASSUME fails", "pass", "n2: AND_INTRO fails", "pass", "pass", "pass", "pass", "n0: premise not derived", "conclusion is not the goal"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(_VERDICTS)) + ") AS t(proof_id, verdict)".replace("SELECT *", "SELECT proof_id::BIGINT AS proof_id, verdict"))
def proof_check(spark, d):
    nodes = [(i, k, f"n{k}", rule, [f"n{p}" for p in prem], json.dumps(f)) for i, (_, _, steps) in enumerate(_PROOFS) for k, (rule, prem, f) in enumerate(steps)]
    heads = [(i, json.dumps(s), json.dumps(g), f"n{len(steps) - 1}" if i != 9 else "n0") for i, (s, g, steps) in enumerate(_PROOFS)]
    table(spark, d, "region")  # ships the package
    return proofs.check_proofs(
        spark.createDataFrame(nodes, "proof_id long, pos int, node_id string, rule string, premises array<string>, formula string"),
        spark.createDataFrame(heads, "proof_id long, assumptions string, goal string, conclusion string"),
    )


@query("""SELECT 'C:' || c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 3""")
def ranked_members(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("id"), F.row_number().over(w).cast("long").alias("rank")).where("rank <= 3")
