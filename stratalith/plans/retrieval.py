"""Queries that search, score, extract from and rewrite texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.functions import vectors as V
from stratalith.operators import search
from stratalith.sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
STOP3 = "[" + ", ".join(f"'{w}'" for w in T.SCORING_STOP_WORDS) + "]"
T1 = lambda x: f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: length(t) > 2)"
T2 = lambda x: f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}_\\s\\-]', ' ', 'g'), '\\s+'), lambda t: length(t) >= 2 AND NOT list_contains({STOP}, t))"
#: ASCII words bounded by no other word character: other word characters are joined first.
T3 = lambda x: f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: regexp_full_match(t, '[a-z][a-z0-9]*') AND NOT list_contains({STOP3}, t))"
VT = lambda x: f"list_filter(list_transform(string_split_regex(lower({x}), '\\s+'), lambda t: regexp_replace(t, '^[.,!?;:()\"'']+|[.,!?;:()\"'']+$', '', 'g')), lambda t: length(t) > 2)"
TITLE = "array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ')"
SENTENCES = lambda x: f"list_transform(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' '))"
CLAIMS = f"list_filter(list_slice({SENTENCES('text')}, 1, 5), lambda s: length(s) > 20 AND length(s) < 300)"


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _first_item(spark, d):
    """The first eight words of the benchmark item of least id."""
    return table(spark, d, "benchmark").orderBy("item_id").limit(1).select(T.title(F.col("text")).alias("text"))


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.title(F.col("text")).alias("text"))


@query(f"""WITH q AS (SELECT list_distinct({T1("array_to_string(list_slice(string_split(text, ' '), 1, 8), ' ')")}) AS terms FROM benchmark ORDER BY item_id LIMIT 1),
 t AS (SELECT unnest(terms) AS token FROM q), d AS (SELECT doc_id, lower({TITLE}) AS title, lower(substr(text, 1, 200)) AS summary, unnest(list_distinct({T1("text")})) AS token FROM documents),
 s AS (SELECT doc_id, sum(CASE WHEN contains(title, token) THEN 10 WHEN contains(summary, token) THEN 5 ELSE 1 END)::BIGINT AS score, count(DISTINCT token) AS hits FROM d JOIN t USING (token) GROUP BY doc_id),
 c AS (SELECT doc_id, score, hits, round(hits / len(terms), 6) AS coverage FROM s, q)
 SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE coverage >= 0.5 AND score >= 1 QUALIFY rank <= 20""")
def define_scored_lookup(spark, d):
    """The twenty best documents for the words of one term."""
    found = search.scored_lookup(_docs(spark, d), T.index_tokens(F.col("text")), _first_item(spark, d))
    best = found.orderBy(F.desc("score"), "id").limit(20)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # of twenty rows
    return ranked.select(F.col("id").alias("doc_id"), "score", "hits", "coverage", F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT token, count(*) AS df, sum(n)::BIGINT AS cf FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({T1("text")}) AS token FROM documents) GROUP BY ALL) GROUP BY token HAVING count(*) >= 5""")
def inverted_index_stats(spark, d):
    index = search.postings(_docs(spark, d), T.index_tokens(F.col("text")))
    return index.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 5")


@query(f"""SELECT token, doc_id, n AS score, row_number() OVER (PARTITION BY token ORDER BY n DESC, doc_id) AS rank FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({T1("text")}) AS token FROM documents) GROUP BY ALL) QUALIFY rank <= 3""")
def inverted_topk_postings(spark, d):
    index = search.postings(_docs(spark, d), T.index_tokens(F.col("text")))
    w = Window.partitionBy("token").orderBy(F.desc("tf"), "id")
    return index.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("token", F.col("id").alias("doc_id"), F.col("tf").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""SELECT token, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({T2("text")}) AS token FROM documents) GROUP BY token), (SELECT count(*) AS n FROM documents)""")
def bm25_idf(spark, d):
    docs = _docs(spark, d)
    df = search.postings(docs, T.ranked_tokens(F.col("text"))).groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(search.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"""SELECT field, count(*) AS n, sum(l)::BIGINT AS total, round(avg(l), 6) AS mean FROM (SELECT 'text' AS field, len({T2("text")}) AS l FROM documents UNION ALL
 SELECT 'title', len({T2(TITLE)}) FROM documents) GROUP BY field""")
def bm25_field_stats(spark, d):
    docs = _docs(spark, d)
    fields = docs.select(F.lit("text").alias("field"), F.size(T.ranked_tokens(F.col("text"))).alias("l")).unionByName(
        docs.select(F.lit("title").alias("field"), F.size(T.ranked_tokens(T.title(F.col("text")))).alias("l"))
    )
    return fields.groupBy("field").agg(F.count("*").alias("n"), F.sum("l").alias("total"), F.round(F.avg("l"), 6).alias("mean"))


@query(f"""WITH docs AS (SELECT doc_id AS id, {T2("text")} AS tokens FROM documents), p AS (SELECT id, token, count(*) AS tf, any_value(l) AS l FROM (SELECT id, len(tokens) AS l, unnest(tokens) AS token FROM docs) GROUP BY ALL),
 p2 AS (SELECT id, token, sum(tf) AS tf, any_value(l) AS l FROM p GROUP BY id, token), s AS (SELECT count(*) AS n, avg(CASE WHEN len(tokens) > 0 THEN len(tokens) END) AS mean FROM docs),
 q AS (SELECT item_id AS query_id, unnest({T2(TITLE)}) AS token FROM benchmark), df AS (SELECT token, count(*) AS df FROM p2 GROUP BY token),
 r AS (SELECT query_id, id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), 6) AS score, count(DISTINCT token) AS matched
 FROM q JOIN p2 USING (token) JOIN df USING (token), s GROUP BY query_id, id)
 SELECT query_id, id AS doc_id, score, matched, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 5""")
def bm25_topk(spark, d):
    return search.bm25(_docs(spark, d), _queries(spark, d), 5).select("query_id", F.col("id").alias("doc_id"), "score", "matched", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH q AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split_regex(lower({TITLE}), '\\s+'), lambda t: t <> '')) AS q FROM benchmark),
 d AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower({TITLE}), '\\s+'), lambda t: t <> '')) AS t, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> ''))) AS token FROM documents),
 h AS (SELECT query_id, doc_id, round((2 * sum(list_contains(t, token)::INT) + 0.5 * count(*)) / any_value(n), 6) AS score FROM d JOIN (SELECT query_id, len(q) AS n, unnest(q) AS token FROM q) USING (token) GROUP BY ALL)
 SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM h QUALIFY rank <= 5""")
def source_search(spark, d):
    return search.overlap_search(_docs(spark, d), _queries(spark, d), 5).select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH c AS (SELECT DISTINCT doc_id, claim FROM (SELECT doc_id, unnest({CLAIMS}) AS claim FROM documents)), q AS (SELECT item_id AS query_id, list_distinct(string_split(lower({TITLE}), ' ')) AS q FROM benchmark),
 t AS (SELECT doc_id, claim, unnest(list_distinct(string_split(lower(claim), ' '))) AS token FROM c), s AS (SELECT query_id, doc_id, claim, round(count(*) / any_value(n) * 0.5, 6) AS score FROM t JOIN
 (SELECT query_id, len(q) AS n, unnest(q) AS token FROM q) USING (token) GROUP BY query_id, doc_id, claim)
 SELECT query_id, doc_id, sha256(claim) AS claim, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, claim) <= 10""")
def claim_search(spark, d):
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    claims = _docs(spark, d).select("id", F.explode(T.claims(F.col("text"))).alias("claim")).distinct()
    asked = _queries(spark, d).select("query_id", F.size(words(F.col("text"))).alias("n"), F.explode(words(F.col("text"))).alias("token"))
    hits = claims.select("id", "claim", F.explode(words(F.col("claim"))).alias("token")).join(asked, "token").groupBy("query_id", "id", "claim").agg(F.round(F.count("*") / F.first("n") * 0.5, 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "claim")
    return hits.withColumn("r", F.row_number().over(w)).where("r <= 10").select("query_id", F.col("id").alias("doc_id"), F.sha2("claim", 256).alias("claim"), "score")


@query(f"""WITH q AS (SELECT unnest(list_distinct({VT(TITLE)})) AS token FROM (SELECT * FROM benchmark ORDER BY item_id LIMIT 1)),
 h AS (SELECT doc_id, count(*) AS score FROM (SELECT doc_id, unnest(list_distinct({VT("text")})) AS token FROM documents) JOIN q USING (token) GROUP BY doc_id)
 SELECT doc_id, score, count(*) OVER () AS total FROM h QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= 10""")
def vault_search(spark, d):
    wanted = _first_item(spark, d).select(F.explode(F.array_distinct(T.vault_tokens(F.col("text")))).alias("token"))
    hits = _docs(spark, d).select("id", F.explode(F.array_distinct(T.vault_tokens(F.col("text")))).alias("token")).join(F.broadcast(wanted), "token")
    scored = hits.groupBy("id").agg(F.count("*").alias("score"))
    total = scored.agg(F.count("*").alias("total"))
    return scored.orderBy(F.desc("score"), "id").limit(10).crossJoin(F.broadcast(total)).select(F.col("id").alias("doc_id"), "score", "total")


@query(f"""WITH q AS (SELECT list_distinct({T3(TITLE)}) AS q FROM benchmark ORDER BY item_id LIMIT 1), b AS (SELECT doc_id, list_distinct({T3(TITLE + " || ' ' || substr(text, 1, 200)")}) AS b, {CLAIMS} AS claims FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(b) > 0 AND len(q) > 0 THEN 0.7 * len(list_intersect(q, b)) / len(q) + 0.3 * len(list_intersect(q, b)) / len(list_distinct(list_concat(q, b))) ELSE 0 END AS lexical,
 coalesce(list_max(list_transform(claims, lambda c: len(list_intersect(q, {T3("c")})) / len(q))), 0) AS claim FROM b, q)
 SELECT doc_id, round(lexical, 6) AS lexical, round(claim, 6) AS claim, round(0.3 * lexical + 0.25 * claim + 0.15 * 0.5 + 0.15 * 0.5 + 0.1 * 1.0, 6) AS total FROM s""")
def brick_score_breakdown(spark, d):
    q = _first_item(spark, d).select(F.array_distinct(T.scoring_tokens(F.col("text"))).alias("q"))
    held = _docs(spark, d).crossJoin(F.broadcast(q))  # one row
    own = F.array_distinct(T.scoring_tokens(F.concat_ws(" ", T.title(F.col("text")), T.summary(F.col("text")))))
    relevance = F.array_max(F.transform(T.claims(F.col("text")), lambda c: F.size(F.array_intersect(F.col("q"), T.scoring_tokens(c))) / F.size("q")))
    parts = held.select(F.col("id").alias("doc_id"), T.lexical_overlap(F.col("q"), own).alias("x"), F.coalesce(relevance, F.lit(0.0)).alias("c"))
    total = 0.3 * F.col("x") + 0.25 * F.col("c") + 0.15 * 0.5 + 0.15 * 0.5 + 0.1 * 1.0
    return parts.select("doc_id", F.round("x", 6).alias("lexical"), F.round("c", 6).alias("claim"), F.round(total, 6).alias("total"))


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct({T2("text")})) AS token FROM benchmark), t AS (SELECT DISTINCT unnest({T2("text")}) AS token FROM documents)
 SELECT query_id, token FROM q WHERE token NOT IN (SELECT token FROM t)""")
def known_unknown_tokens(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(T.ranked_tokens(F.col("text")))).alias("token"))
    known = _docs(spark, d).select(F.explode(T.ranked_tokens(F.col("text"))).alias("token")).distinct()
    return asked.join(known, "token", "left_anti").select("query_id", "token")


CLAIM_ROWS = [
    (1, "the bridge is always safe for heavy trucks"), (2, "the bridge is never safe for heavy trucks"), (3, "the engine has enough coolant in reserve"),
    (4, "the engine has not enough coolant in reserve"), (5, "rivers can freeze during long cold winters"), (6, "markets will open early tomorrow morning"),
    (7, "markets will not open early tomorrow morning"), (8, "this thing shines brightly"), (9, "rain implies wet streets"), (10, "if the valve leaks then the pump stops"),
    (11, "the tank is empty therefore the pump stops"), (12, "if rain falls then wet streets"),
]
CLAIM_VALUES = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in CLAIM_ROWS) + ") AS c(id, claim)"


def _contradiction_sql() -> str:
    tests = []
    for pos, neg in T.NEGATION_PAIRS:
        for p, q in ((pos, neg), (neg, pos)):
            a, b = f"list_distinct({T3(f"replace(a.claim, '{p}', '')")})", f"list_distinct({T3(f"replace(b.claim, '{q}', '')")})"
            tests.append(f"(contains(a.claim, '{p}') AND contains(b.claim, '{q}') AND len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) / greatest(len({a}), len({b})) > 0.6)")
    return " OR ".join(tests)


@query(f"SELECT a.id AS a, b.id AS b FROM {CLAIM_VALUES.replace('AS c(', 'AS a(')}, {CLAIM_VALUES.replace('AS c(', 'AS b(')} WHERE a.id < b.id AND ({_contradiction_sql()})")
def conflict_pairs(spark, d):
    """Contradicting claims, compared only where they share a word beyond stop words: a larger overlap needs one."""
    claims = spark.createDataFrame(CLAIM_ROWS, "id int, claim string")
    blocked = claims.select("id", "claim", F.explode(F.array_distinct(T.scoring_tokens(F.col("claim")))).alias("word"))
    a, b = (blocked.select("word", *(F.col(c).alias(c + s) for c in ("id", "claim"))) for s in "ab")
    pairs = a.join(b, "word").where("ida < idb").select("ida", "claima", "idb", "claimb").distinct()
    return pairs.where(T.contradictory(F.col("claima"), F.col("claimb"))).select(F.col("ida").alias("a"), F.col("idb").alias("b"))


@query(f"""WITH c AS (SELECT doc_id, unnest({CLAIMS}) AS claim FROM documents), w AS (SELECT doc_id, claim, list_distinct(string_split(lower(claim), ' ')) AS w FROM c),
 b AS (SELECT item_id, list_distinct(string_split(lower(s), ' ')) AS v, s FROM (SELECT item_id, unnest({SENTENCES('text')}) AS s FROM benchmark))
 SELECT DISTINCT item_id, doc_id, sha256(s) AS sentence FROM w JOIN b ON len(list_intersect(w, v)) / len(list_distinct(list_concat(w, v))) > 0.5""")
def claims_jaccard_match(spark, d):
    """Claims that share more than half of their words with a benchmark sentence."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    claims = _docs(spark, d).select("id", F.explode(T.claims(F.col("text"))).alias("claim")).select(F.col("id").alias("doc_id"), words(F.col("claim")).alias("w"))
    items = table(spark, d, "benchmark").select("item_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("item_id", F.sha2("s", 256).alias("sentence"), words(F.col("s")).alias("v"))
    return search.alike_by_half(claims, items.distinct()).select("item_id", "doc_id", "sentence").distinct()


@query(f"""WITH c AS (SELECT id, claim FROM {CLAIM_VALUES}), p AS (SELECT id, string_split(replace(claim, ' therefore ', ' implies '), ' implies ') AS parts, regexp_extract(claim, 'if (.+?) then (.+)', ['x', 'y']) AS r,
 contains(claim, ' implies ') OR contains(claim, ' therefore ') AS imp, contains(claim, 'if ') AND contains(claim, ' then ') AS cond FROM c),
 a AS (SELECT id, trim(parts[1]) AS premise, trim(parts[2]) AS conclusion, 'modus_ponens' AS rule, 0.9 AS confidence FROM p WHERE imp AND len(parts) = 2 UNION ALL
 SELECT id, trim(r.x), trim(r.y), 'conditional', 0.85 FROM p WHERE cond AND r.y <> '')
 SELECT id, premise, conclusion, rule, round(confidence, 6) AS confidence FROM a QUALIFY row_number() OVER (PARTITION BY conclusion ORDER BY id, rule DESC) = 1""")
def deduction_patterns(spark, d):
    """Premise and conclusion of implications, the first for each conclusion."""
    c = spark.createDataFrame(CLAIM_ROWS, "id int, claim string")
    parts = F.split(F.replace("claim", F.lit(" therefore "), F.lit(" implies ")), " implies ")
    implied = c.where(F.col("claim").contains(" implies ") | F.col("claim").contains(" therefore ")).where(F.size(parts) == 2)
    implied = implied.select("id", F.trim(parts[0]).alias("premise"), F.trim(parts[1]).alias("conclusion"), F.lit("modus_ponens").alias("rule"), F.lit(0.9).alias("confidence"))
    pattern = "if (.+?) then (.+)"
    cond = c.where(F.col("claim").rlike(pattern)).select(
        "id", F.trim(F.regexp_extract("claim", pattern, 1)).alias("premise"), F.trim(F.regexp_extract("claim", pattern, 2)).alias("conclusion"), F.lit("conditional").alias("rule"), F.lit(0.85).alias("confidence")
    )
    w = Window.partitionBy("conclusion").orderBy("id", F.desc("rule"))
    return implied.unionByName(cond).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@query("""SELECT doc_id, sha256(text) AS digest, ('0x' || substr(sha256(text), 1, 2))::INT / 255 AS first_value, ('0x' || substr(sha256(text), 63, 2))::INT / 255 AS last_value FROM documents""".replace("first_value,", "v0,").replace("last_value", "v31"))
def hash_embed(spark, d):
    held = _docs(spark, d).select("id", F.sha2("text", 256).alias("digest"), V.hash_embedding(F.col("text")).alias("v"))
    return held.select(F.col("id").alias("doc_id"), "digest", F.get("v", F.lit(0)).alias("v0"), F.get("v", F.lit(31)).alias("v31"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> query_id)
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def cosine_topk(spark, d):
    """The ten nearest vectors of each stated query, every hundredth id; few queries are broadcast."""
    held = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = held.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    scored = held.join(search.few(asked), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(V.cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 10")


CHUNKS = """(SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda s, i: {'i': i - 1, 's': s})) AS c FROM documents)"""


@query()
def chunk_documents(spark, d):
    """Chunks of at most 512 bytes, packed from paragraphs, with their stable ids."""
    from stratalith.operators.chunking import chunked

    c = _docs(spark, d).select("id", F.posexplode(chunked(F.col("text"))).alias("idx", "chunk"))
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("idx").cast("string"))
    return c.select(F.col("id").alias("doc_id"), F.col("idx").cast("long").alias("idx"), F.sha2(key, 256).alias("chunk_id"), F.octet_length("chunk").cast("long").alias("n_bytes"), F.sha2("chunk", 256).alias("chunk"))


@query("""SELECT a.item_id AS a, b.item_id AS b, round(1 - levenshtein(x, y) / greatest(length(x), length(y), 1), 6) AS fidelity FROM (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[^ -~\\s]', '?', 'g'), '\\s+', ' ', 'g')) AS x FROM benchmark) a
 JOIN (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[^ -~\\s]', '?', 'g'), '\\s+', ' ', 'g')) AS y FROM benchmark) b ON b.item_id = a.item_id + 1""")
def levenshtein_fidelity(spark, d):
    # the oracle measures bytes, so characters beyond ASCII count as one mark
    items = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"[^ -~\s]", "?").alias("text"))
    a, b = items.select(F.col("item_id").alias("a"), F.col("text").alias("x")), items.select(F.col("item_id").alias("b"), F.col("text").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(T.fidelity(F.col("x"), F.col("y")), 6).alias("fidelity"))


@query("""SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?]+\\s*'), lambda s: s <> ''))::BIGINT AS n_clauses, sha256(array_to_string(list_filter(string_split_regex(text, '[.!?]+\\s*'), lambda s: s <> ''), '. ')) AS canonical FROM documents""")
def clause_split(spark, d):
    clauses = F.filter(F.split("text", r"[.!?]+\s*"), lambda s: s != "")
    return _docs(spark, d).select(F.col("id").alias("doc_id"), F.size(clauses).cast("long").alias("n_clauses"), F.sha2(F.array_join(clauses, ". "), 256).alias("canonical"))


PATTERNS = [r"[a-z]+\.[0-9]+@mail[0-9]+\.example\.com", r"token = \"[0-9a-f]+\"", r"password=[0-9a-f]+"]


@query(f"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '{PATTERNS[0]}', '[REDACTED]', 'g') AS t1 FROM documents), b AS (SELECT *, regexp_replace(t1, 'token = "[0-9a-f]+"', '[REDACTED]', 'g') AS t2 FROM a)
 SELECT doc_id, (len(regexp_extract_all(text, '{PATTERNS[0]}')) + len(regexp_extract_all(t1, 'token = "[0-9a-f]+"')) + len(regexp_extract_all(t2, '{PATTERNS[2]}')))::BIGINT AS n,
 sha256(regexp_replace(t2, '{PATTERNS[2]}', '[REDACTED]', 'g')) AS digest FROM b""")
def redact_documents(spark, d):
    text = F.col("text")
    return _docs(spark, d).select(F.col("id").alias("doc_id"), T.redaction_count(text, PATTERNS).cast("long").alias("n"), F.sha2(T.redacted(text, PATTERNS), 256).alias("digest"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, 'password=[0-9a-f]+') THEN 'deny' WHEN regexp_matches(text, 'token = "[0-9a-f]+"') THEN 'redact' ELSE 'allow' END AS decision FROM documents""")
def policy_gates(spark, d):
    decision = F.when(F.col("text").rlike(PATTERNS[2]), "deny").when(F.col("text").rlike(PATTERNS[1]), "redact").otherwise("allow")
    return _docs(spark, d).select(F.col("id").alias("doc_id"), decision.alias("decision"))


@query("""SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}|token = "[0-9a-f]+"'))) AS secret FROM documents""")
def secret_scan(spark, d):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit('AKIA[0-9A-Z]{16}|token = "[0-9a-f]+"'), F.lit(0)))
    return _docs(spark, d).select(F.col("id").alias("doc_id"), F.explode(found).alias("secret"))


@query("""SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM pages""")
def page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.without_markup(F.col("html")), 256).alias("digest"))


@query("""SELECT page_id, i - 1 AS pos, heading FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<h[1-6]>([^<]+)</h[1-6]>', 1), lambda h, i: {'i': i, 'h': h})) AS x FROM pages), LATERAL (SELECT x.i::BIGINT AS i, x.h AS heading)""")
def section_split(spark, d):
    heads = F.regexp_extract_all("html", F.lit(r"<h[1-6]>([^<]+)</h[1-6]>"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(heads).alias("pos", "heading")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""SELECT doc_id, len({CLAIMS})::BIGINT AS n_claims, sha256(array_to_string({CLAIMS}, '|')) AS digest FROM documents""")
def claim_extract(spark, d):
    claims = T.claims(F.col("text"))
    return _docs(spark, d).select(F.col("id").alias("doc_id"), F.size(claims).cast("long").alias("n_claims"), F.sha2(F.array_join(claims, "|"), 256).alias("digest"))


@query("""SELECT doc_id, unnest(regexp_extract_all(text, '(?i)([A-Z][a-zA-Z ]{0,48}) is ([^.\\n]{11,})\\.', 1)) AS term FROM documents""")
def definition_extract(spark, d):
    terms = F.regexp_extract_all("text", F.lit(r"(?i)([A-Z][a-zA-Z ]{0,48}) is ([^.\n]{11,})\."), F.lit(1))
    return _docs(spark, d).select(F.col("id").alias("doc_id"), F.explode(terms).alias("term"))


@query(f"""WITH q AS (SELECT list_distinct({T3(TITLE)}) AS q FROM benchmark ORDER BY item_id LIMIT 1), s AS (SELECT doc_id, text, unnest(list_transform({SENTENCES("text")}, lambda s, i: {{'i': i, 's': s}})) AS x FROM documents),
 o AS (SELECT doc_id, text, x.i AS i, x.s AS s, len(list_intersect(q, {T3("x.s")})) AS n FROM s, q)
 SELECT doc_id, n::BIGINT AS overlap, sha256(CASE WHEN n > 0 THEN CASE WHEN length(s) > 300 THEN substr(s, 1, 297) || '...' ELSE s END WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) AS excerpt FROM o QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1""")
def excerpt_best_sentence(spark, d):
    """The sentence that shares most words with the query, the first of equals; the beginning of the text if none does."""
    q = _first_item(spark, d).select(F.array_distinct(T.scoring_tokens(F.col("text"))).alias("q"))
    held = _docs(spark, d).crossJoin(F.broadcast(q))
    scored = F.transform(T.sentences(F.col("text")), lambda s, i: F.struct(F.size(F.array_intersect(F.col("q"), T.scoring_tokens(s))).alias("n"), (-i).alias("i"), s.alias("s")))
    best = held.select("id", "text", F.array_max(scored).alias("b"))
    cut = lambda c, most, shown: F.when(F.length(c) > most, F.concat(F.substring(c, 1, shown), F.lit("..."))).otherwise(F.col(c))
    excerpt = F.when(F.col("b.n") > 0, cut("b.s", 300, 297)).otherwise(cut("text", 200, 200))
    return best.select(F.col("id").alias("doc_id"), F.col("b.n").cast("long").alias("overlap"), F.sha2(excerpt, 256).alias("excerpt"))


@query(f"""WITH c AS (SELECT doc_id, unnest({CLAIMS}) AS claim FROM documents), k AS (SELECT claim FROM c GROUP BY claim HAVING count(DISTINCT doc_id) > 1)
 SELECT doc_id, count(*) AS claims, sum((claim IN (SELECT claim FROM k))::INT)::BIGINT AS traced FROM c GROUP BY doc_id""")
def claim_traceability(spark, d):
    """Claims of each document, and how many of them another document makes too."""
    claims = _docs(spark, d).select("id", F.explode(T.claims(F.col("text"))).alias("claim")).withColumn("h", F.sha2("claim", 256))
    known = claims.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", F.lit(1).alias("known"))
    return claims.join(known, "h", "left").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("claims"), F.sum(F.coalesce("known", F.lit(0))).alias("traced"))


@query(f"""WITH t AS (SELECT lang, unnest(list_distinct({T3("text")})) AS w FROM documents), c AS (SELECT w, count(DISTINCT lang) AS n, min(lang) AS lang FROM t GROUP BY w)
 SELECT CASE WHEN n = 4 THEN 'common' ELSE 'only ' || lang END AS part, count(*) AS words FROM c WHERE n IN (1, 4) GROUP BY 1""")
def compare_common_diff(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(F.array_distinct(T.scoring_tokens(F.col("text")))).alias("w")).distinct()
    spread = words.groupBy("w").agg(F.count("*").alias("n"), F.min("lang").alias("lang")).where("n IN (1, 4)")
    return spread.groupBy(F.when(F.col("n") == 4, "common").otherwise(F.concat(F.lit("only "), "lang")).alias("part")).agg(F.count("*").alias("words"))


@query("""SELECT source, count(*) AS total, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS passed, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS failed,
 round(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) / count(*), 6) AS pass_rate FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def eval_summary(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    passed = F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0))
    return joined.groupBy("source").agg(F.count("*").alias("total"), passed.alias("passed"), F.count_if(F.col("toxic") == 1).alias("failed"), F.round(passed / F.count("*"), 6).alias("pass_rate"))


@query("""WITH r AS (SELECT doc_id % 10 AS iteration, avg(quality) AS rate, count(*) AS n FROM labels GROUP BY 1) SELECT round(arg_max(rate, iteration) - arg_min(rate, iteration), 6) AS delta, sum(n)::BIGINT AS total FROM r""")
def growth_metrics(spark, d):
    runs = table(spark, d, "labels").groupBy((F.col("doc_id") % 10).alias("iteration")).agg(F.avg("quality").alias("rate"), F.count("*").alias("n"))
    return runs.agg(F.round(F.max_by("rate", "iteration") - F.min_by("rate", "iteration"), 6).alias("delta"), F.sum("n").alias("total"))


@query("""WITH m AS (SELECT source, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT source AS topic, doc_id, missing FROM m JOIN (SELECT source, count(*) AS missing FROM m GROUP BY source) USING (source)""")
def missing_by_topic(spark, d):
    """Every document without a label beside the number of them in its topic."""
    missing = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")
    counted = missing.groupBy(F.col("source").alias("topic")).agg(F.count("*").alias("missing"))
    return missing.join(counted, F.col("source") == F.col("topic")).select("topic", "doc_id", "missing")


@query("""SELECT source, count(*) AS priority FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source ORDER BY priority DESC, source LIMIT 10""")
def topk_recommendations(spark, d):
    good = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(good, "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("priority")).orderBy(F.desc("priority"), "source").limit(10)


@query()
def context_select_greedy(spark, d):
    """The best documents of each query, contradicting ones pushed down."""
    from stratalith.operators.reasoning import select_greedily

    ranked = search.bm25(_docs(spark, d), _queries(spark, d), 15).select("query_id", "id", "score")
    claims = _docs(spark, d).select("id", T.claims(F.col("text")).alias("claims"))
    return select_greedily(ranked.join(claims, "id"), 8).withColumnRenamed("id", "doc_id")


@query(f"""WITH s AS (SELECT doc_id, unnest({SENTENCES("text")}) AS s FROM documents), a AS (SELECT doc_id, unnest({CLAIMS}) AS s FROM documents)
 SELECT doc_id, count(*) AS unapproved FROM (SELECT DISTINCT doc_id, s FROM s WHERE length(s) > 20 AND length(s) < 300 AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = s.doc_id AND a.s = s.s)) GROUP BY doc_id""")
def new_sentences(spark, d):
    """Sentences of claim length beyond the extracted claims, by document."""
    text, docs = F.col("text"), _docs(spark, d)
    said = docs.select("id", F.explode(T.sentences(text)).alias("s")).where((F.length("s") > 20) & (F.length("s") < 300)).distinct()
    known = docs.select("id", F.explode(T.claims(text)).alias("s")).distinct()
    return said.join(known, ["id", "s"], "left_anti").groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("unapproved"))


@query()
def no_new_claims(spark, d):
    """Benchmark sentences that no claim of the documents of their words supports, after normalisation."""
    from stratalith.operators.reasoning import unapproved

    text = F.col("text")
    said = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(T.sentences(text)).alias("text"))
    good = _docs(spark, d).select("id", F.explode(T.claims(text)).alias("text"))
    return unapproved(said, good).select(F.col("id").alias("item_id"), F.sha2("text", 256).alias("sentence"))


@query(f"""WITH c AS (SELECT doc_id, c.i AS idx, c.s AS chunk FROM {CHUNKS} WHERE trim(c.s) <> ''), e AS (SELECT *, list_transform(range(0, 32), lambda i: ('0x' || substr(sha256(chunk), 2 * i + 1, 2))::INT / 255) AS v FROM c),
 q AS (SELECT item_id, list_transform(range(0, 32), lambda i: ('0x' || substr(sha256(text), 2 * i + 1, 2))::INT / 255) AS q FROM benchmark WHERE item_id % 100 = 0),
 s AS (SELECT item_id, doc_id, idx::BIGINT AS idx, round(list_cosine_similarity(q::DOUBLE[], v::DOUBLE[]), 6) AS score FROM e, q) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, idx) <= 5""")
def rag_retrieve(spark, d):
    """The five lines nearest to each stated query, every hundredth item, by hash embedding; few queries are broadcast."""
    chunks = _docs(spark, d).select("id", F.posexplode(F.split("text", "\n")).alias("idx", "chunk")).where(F.trim("chunk") != "")
    asked = table(spark, d, "benchmark").where("item_id % 100 = 0").select("item_id", V.hash_embedding(F.col("text")).alias("q"))
    held = chunks.select(F.col("id").alias("doc_id"), F.col("idx").cast("long").alias("idx"), V.hash_embedding(F.col("chunk")).alias("v"))
    scored = held.join(search.few(asked)).select("item_id", "doc_id", "idx", F.round(V.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "idx")
    return scored.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")
