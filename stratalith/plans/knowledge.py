"""Queries over entities, edges, facts, rules and graph walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.operators import graph, rules
from stratalith.sources.tables import parent_edges, supply_edges, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PARENT = """(SELECT 'R:' || n_regionkey AS src, 'N:' || n_nationkey AS dst FROM nation UNION ALL
 SELECT 'N:' || c_nationkey, 'C:' || c_custkey FROM customer UNION ALL SELECT 'N:' || s_nationkey, 'S:' || s_suppkey FROM supplier)"""
SUPPLY = "(SELECT DISTINCT 'S:' || l_suppkey AS src, 'P:' || l_partkey AS dst FROM lineitem)"


@query("""SELECT 'R:' || r_regionkey AS id, 'Concept' AS type, r_name AS label FROM region UNION ALL SELECT 'N:' || n_nationkey, 'Concept', n_name FROM nation
 UNION ALL SELECT 'C:' || c_custkey, 'Claim', c_name FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'Artifact', s_name FROM supplier
 UNION ALL SELECT DISTINCT 'T:' || c_mktsegment, 'Tag', c_mktsegment FROM customer""")
def ir_entities(spark, d):
    def part(name, prefix, key, kind, label):
        return table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(label).alias("label"))

    out = part("region", "R:", "r_regionkey", "Concept", "r_name")
    for p in (
        part("nation", "N:", "n_nationkey", "Concept", "n_name"),
        part("customer", "C:", "c_custkey", "Claim", "c_name"),
        part("supplier", "S:", "s_suppkey", "Artifact", "s_name"),
        part("customer", "T:", "c_mktsegment", "Tag", "c_mktsegment").distinct(),
    ):
        out = out.unionByName(p)
    return out


@query(f"""SELECT src, 'parent' AS rel, dst FROM {PARENT} UNION ALL SELECT dst, 'child', src FROM {PARENT}
 UNION ALL SELECT 'C:' || c_custkey, 'tagged', 'T:' || c_mktsegment FROM customer""")
def ir_edges(spark, d):
    parent = parent_edges(spark, d)
    child = parent.select(F.col("dst").alias("src"), F.lit("child").alias("rel"), F.col("src").alias("dst"))
    tagged = table(spark, d, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("src"), F.lit("tagged").alias("rel"), F.concat(F.lit("T:"), "c_mktsegment").alias("dst"))
    return parent.unionByName(child).unionByName(tagged)


def facts(spark, d):
    """edge, type, hasTag and hasStatus facts of the hierarchy; empty values give none."""
    edge = parent_edges(spark, d).select(F.lit("edge").alias("predicate"), F.array("src", "rel", "dst").alias("args"))
    kind = ir_entities(spark, d).select(F.lit("type").alias("predicate"), F.array("id", "type").alias("args"))
    supplier = table(spark, d, "supplier").select(F.lit("hasTag").alias("predicate"), F.array(F.concat(F.lit("S:"), "s_suppkey"), F.concat(F.lit("nation"), "s_nationkey")).alias("args"))
    return edge.unionByName(kind).unionByName(supplier).where(F.forall("args", lambda a: a != ""))


@query(f"""SELECT 'edge' AS predicate, src || ',parent,' || dst AS args FROM {PARENT} UNION ALL
 SELECT 'hasTag', 'S:' || s_suppkey || ',nation' || s_nationkey FROM supplier UNION ALL
 SELECT 'type', id || ',' || type FROM (SELECT 'R:' || r_regionkey AS id, 'Concept' AS type FROM region UNION ALL SELECT 'N:' || n_nationkey, 'Concept' FROM nation
 UNION ALL SELECT 'C:' || c_custkey, 'Claim' FROM customer UNION ALL SELECT 'S:' || s_suppkey, 'Artifact' FROM supplier
 UNION ALL SELECT DISTINCT 'T:' || c_mktsegment, 'Tag' FROM customer)""")
def ir_facts(spark, d):
    return facts(spark, d).select("predicate", F.array_join("args", ",").alias("args"))


@query(f"""SELECT 'parent' AS rel, count(*) AS n, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM {PARENT}""")
def ir_counts(spark, d):
    return parent_edges(spark, d).groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query(f"""SELECT src, string_agg('parent>' || dst, '|' ORDER BY dst) AS targets FROM {PARENT} GROUP BY src""")
def ir_adjacency(spark, d):
    return graph.adjacency(parent_edges(spark, d)).select("src", F.array_join(F.transform("targets", lambda t: F.concat_ws(">", t["rel"], t["dst"])), "|").alias("targets"))


@query("""SELECT n_regionkey AS region, sha256(string_agg(n_nationkey || ':' || n_name, chr(10) ORDER BY n_nationkey)) AS content_hash FROM nation GROUP BY n_regionkey""")
def ir_content_hash(spark, d):
    line = F.struct(F.col("n_nationkey"), F.concat_ws(":", F.col("n_nationkey").cast("string"), "n_name").alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"])
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sha2(F.array_join(ordered, "\n"), 256).alias("content_hash"))


@query("""SELECT doc_id, CASE WHEN level = 2 THEN 'REDACTED' WHEN level = 1 THEN 'SENSITIVE' ELSE 'PUBLIC' END AS level FROM (
 SELECT d.doc_id, max(CASE WHEN l.toxic = 1 THEN 2 WHEN l.quality = 0 THEN 1 ELSE 0 END) AS level FROM documents d JOIN labels l USING (doc_id) GROUP BY d.doc_id) WHERE level < 2""")
def privacy_filter(spark, d):
    level = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    seen = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").groupBy("doc_id").agg(F.max(level).alias("level"))
    return seen.where("level < 2").select("doc_id", F.when(F.col("level") == 1, "SENSITIVE").otherwise("PUBLIC").alias("level"))


@query("""SELECT source, max(CASE WHEN toxic = 1 THEN 2 WHEN quality = 0 THEN 1 ELSE 0 END) AS level, bool_or(toxic = 1) AS redacted, count(*) AS n
 FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def sensitivity_merge(spark, d):
    level = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    joined = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return joined.groupBy("source").agg(F.max(level).alias("level"), F.bool_or(F.col("toxic") == 1).alias("redacted"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_orderpriority AS tier FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def facet_filter(spark, d):
    orders = table(spark, d, "orders").where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return orders.select("o_orderkey", F.col("o_orderpriority").alias("tier"))


@query("""SELECT o_orderpriority AS tier, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS n_f, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS n_o,
 sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT AS n_p FROM orders GROUP BY 1""")
def facet_lanes(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("tier")).agg(*(F.count_if(F.col("o_orderstatus") == s.upper()).alias(f"n_{s}") for s in "fop"))


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND (contains(lower(p_brand), '3') OR contains(lower(p_type), 'st'))""")
def substring_search(spark, d):
    low = lambda c: F.lower(F.col(c))
    return table(spark, d, "part").where(low("p_name").contains("a") & (low("p_brand").contains("3") | low("p_type").contains("st"))).select("p_partkey", "p_name")


@query(f"""WITH pub AS (SELECT 'C:' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'N:' || n_nationkey FROM nation WHERE n_regionkey <> 0)
 SELECT src, 'parent' AS rel, dst FROM {PARENT} WHERE src IN (SELECT id FROM pub) AND dst IN (SELECT id FROM pub)""")
def public_export_edges(spark, d):
    customers = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("C:"), "c_custkey").alias("id"))
    nations = table(spark, d, "nation").where("n_regionkey <> 0").select(F.concat(F.lit("N:"), "n_nationkey").alias("id"))
    return graph.induced(parent_edges(spark, d), customers.unionByName(nations)).select("src", "rel", "dst")


@query("""SELECT o_orderkey, 'created' AS event, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders UNION ALL
 SELECT o_orderkey, 'updated', strftime(shipped, '%Y-%m-%d') FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
 WHERE strftime(shipped, '%Y-%m-%d') <> strftime(o_orderdate, '%Y-%m-%d')""")
def timeline_events(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    shipped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last"))
    updated = orders.join(shipped, orders["o_orderkey"] == shipped["l_orderkey"]).where("last <> day").select("o_orderkey", F.lit("updated").alias("event"), F.col("last").alias("day"))
    return orders.select("o_orderkey", F.lit("created").alias("event"), "day").unionByName(updated)


V = tuple
RULE_CHILD = rules.Rule("R002", rules.Atom("edge", V(("?b", "child", "?a"))), (rules.Atom("edge", V(("?a", "parent", "?b"))),))
RULE_GRAND = rules.Rule(
    "R001", rules.Atom("ancestor", V(("?a", "?c"))), (rules.Atom("edge", V(("?a", "parent", "?b"))), rules.Atom("edge", V(("?b", "parent", "?c")))), (rules.Filter("neq", "?a", "?c"),)
)
RULE_TAG = rules.Rule(
    "R003", rules.Atom("tagRelated", V(("?a", "?b", "?t"))), (rules.Atom("hasTag", V(("?a", "?t"))), rules.Atom("hasTag", V(("?b", "?t")))), (rules.Filter("neq", "?a", "?b"),)
)
RULE_CONCEPT = rules.Rule("R005", rules.Atom("isConcept", V(("?x",))), (rules.Atom("type", V(("?x", "Concept"))),))
RULE_INFLUENCE = rules.Rule("R006", rules.Atom("influences", V(("?a", "?b"))), (rules.Atom("edge", V(("?a", "parent", "?b"))),))
RULE_CLOSURE = rules.Rule(
    "R007", rules.Atom("influences", V(("?a", "?c"))), (rules.Atom("influences", V(("?a", "?b"))), rules.Atom("influences", V(("?b", "?c")))),
    (rules.Filter("neq", "?a", "?b"), rules.Filter("neq", "?b", "?c"), rules.Filter("neq", "?a", "?c")),
)
RULE_SYMMETRIC = rules.Rule("R008", rules.Atom("edge", V(("?b", "related", "?a"))), (rules.Atom("edge", V(("?a", "related", "?b"))),))


def _one(rule, base):
    heads = rules.bindings(rule, [base] * len(rule.body))
    return heads.select(F.concat_ws(",", *(F.col(f"`{t}`") if t.startswith("?") else F.lit(t) for t in rule.head.args)).alias("args")).distinct()


@query(f"SELECT DISTINCT dst || ',child,' || src AS args FROM {PARENT}")
def rule_parent_inverse(spark, d):
    return _one(RULE_CHILD, facts(spark, d))


@query(f"SELECT DISTINCT a.src || ',' || b.dst AS args FROM {PARENT} a JOIN {PARENT} b ON a.dst = b.src WHERE a.src <> b.dst")
def rule_grandparent(spark, d):
    return _one(RULE_GRAND, facts(spark, d))


@query("""SELECT DISTINCT 'S:' || a.s_suppkey || ',S:' || b.s_suppkey || ',nation' || a.s_nationkey AS args FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey <> b.s_suppkey""")
def rule_tag_similarity(spark, d):
    return _one(RULE_TAG, facts(spark, d))


@query(f"SELECT DISTINCT dst || ',related,' || src AS args FROM {SUPPLY}")
def rule_symmetric(spark, d):
    base = supply_edges(spark, d).select(F.lit("edge").alias("predicate"), F.array("src", "rel", "dst").alias("args"))
    return _one(RULE_SYMMETRIC, base)


@query("""SELECT DISTINCT 'N:' || n_nationkey AS args FROM nation UNION SELECT 'R:' || r_regionkey FROM region""")
def rule_concepts(spark, d):
    return _one(RULE_CONCEPT, facts(spark, d))


@query("""SELECT p_partkey, p_brand FROM part WHERE p_brand >= 'Brand#2' AND p_brand < 'Brand#4' AND contains(p_type, 'E') AND regexp_matches(p_name, 't$') AND p_brand <> 'Brand#3'""")
def rule_filters(spark, d):
    base = table(spark, d, "part").select(F.lit("part").alias("predicate"), F.array(F.col("p_partkey").cast("string"), "p_brand", "p_type", "p_name").alias("args"))
    f = rules.Filter
    rule = rules.Rule(
        "F1", rules.Atom("hit", ("?k", "?b")), (rules.Atom("part", ("?k", "?b", "?t", "?n")),),
        (f("gte", "?b", "Brand#2"), f("lt", "?b", "Brand#4"), f("contains", "?t", "E"), f("matches", "?n", "t$"), f("neq", "?b", "Brand#3")),
    )
    return rules.bindings(rule, [base]).select(F.col("`?k`").cast("long").alias("p_partkey"), F.col("`?b`").alias("p_brand"))


def _closed(spark, d):
    return rules.fixpoint(facts(spark, d).where("predicate = 'edge'"), [RULE_INFLUENCE, RULE_CLOSURE])


CLOSURE = f"""WITH RECURSIVE t(src, dst, n) AS (SELECT src, dst, 1 FROM {PARENT} UNION SELECT t.src, p.dst, t.n + 1 FROM t JOIN {PARENT} p ON t.dst = p.src)"""


@query(f"{CLOSURE} SELECT DISTINCT src AS a, dst AS b FROM t")
def rule_influences_closure(spark, d):
    arg = lambda i: F.get("args", F.lit(i))
    return _closed(spark, d).where("predicate = 'influences'").select(arg(0).alias("a"), arg(1).alias("b"))


@query(f"{CLOSURE} SELECT DISTINCT src || ',' || dst AS args, CASE WHEN n = 1 THEN 'R006' ELSE 'R007' END AS rule_id, (1 + ceil(log2(n)))::INT AS round FROM t")
def firing_trace(spark, d):
    fired = rules.first_firings(_closed(spark, d))
    return fired.select(F.array_join("args", ",").alias("args"), "rule_id", "round")


@query(f"{CLOSURE} SELECT 'influences' AS predicate, 'R:1,C:1' AS args, count(*) > 0 AS proved FROM t WHERE src = 'R:1' AND dst = 'C:1'")
def prove_fact(spark, d):
    hit = rules.matching(_closed(spark, d), "influences", ["R:1", "C:1"])
    return hit.agg((F.count("*") > 0).alias("proved")).select(F.lit("influences").alias("predicate"), F.lit("R:1,C:1").alias("args"), "proved")


@query(f"""SELECT 'C:' || c_custkey AS id FROM customer WHERE 'C:' || c_custkey IN (SELECT dst FROM {PARENT} WHERE src = 'N:3') AND c_mktsegment = 'BUILDING'""")
def find_entities(spark, d):
    tags = table(spark, d, "customer").select(F.lit("hasTag").alias("predicate"), F.array(F.concat(F.lit("C:"), "c_custkey"), F.col("c_mktsegment")).alias("args"))
    base = facts(spark, d).unionByName(tags)
    claims = ir_entities(spark, d).where(F.lower("type") == "claim")
    return rules.entities_with(claims, base, [("edge", ["N:3", "parent", "?x"]), ("hasTag", ["?x", "BUILDING"])]).select("id")


@query(f"""{CLOSURE} SELECT 'R:' || r_regionkey AS start, 'C:' || c AS goal, min(n)::BIGINT AS n_edges FROM region, (SELECT unnest([1, 2, 3, 7, 11]) AS c), t WHERE t.src = 'R:' || r_regionkey AND t.dst = 'C:' || c GROUP BY 1, 2""")
def relate_shortest_path(spark, d):
    regions = table(spark, d, "region").select(F.concat(F.lit("R:"), "r_regionkey").alias("start"))
    pairs = regions.withColumn("goal", F.explode(F.array(*(F.lit(f"C:{c}") for c in (1, 2, 3, 7, 11)))))
    return graph.shortest_paths(parent_edges(spark, d), pairs).select("start", "goal", F.size("path").cast("long").alias("n_edges"))


@query("""SELECT 'R:' || n_regionkey AS start, 'C:' || c_custkey AS goal, 'parent>N:' || n_nationkey || '|parent>C:' || c_custkey AS path, round(0.5 * 0.8, 6) AS strength
 FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def path_strength(spark, d):
    edges = parent_edges(spark, d).withColumn("strength", F.when(F.col("src").startswith("R:"), 0.5).otherwise(0.8))
    goals = table(spark, d, "customer").select(F.concat(F.lit("C:"), "c_custkey").alias("goal"))
    pairs = goals.join(table(spark, d, "region").select(F.concat(F.lit("R:"), "r_regionkey").alias("start")), how="cross")
    path = F.array_join(F.transform("path", lambda h: F.concat_ws(">", h["rel"], h["id"])), "|")
    return graph.shortest_paths(edges, pairs, max_edges=2).select("start", "goal", path.alias("path"), F.round("strength", 6).alias("strength"))


@query(f"""WITH e AS (SELECT src, dst FROM {SUPPLY} UNION SELECT dst, src FROM {SUPPLY}), h1 AS (SELECT DISTINCT dst AS id FROM e WHERE src = 'S:1'),
 h2 AS (SELECT DISTINCT e.dst AS id FROM h1 JOIN e ON e.src = h1.id) SELECT id, min(steps) AS steps FROM (SELECT 'S:1' AS id, 0 AS steps UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""")
def khop_subgraph(spark, d):
    seed = spark.createDataFrame([("S:1",)], "id string")
    return graph.reach(supply_edges(spark, d), seed, 2, directed=False).select("id", "steps")


@query(f"SELECT src AS id, dst AS neighbour, 'out' AS direction FROM {SUPPLY} WHERE src IN ('S:2', 'S:5') UNION ALL SELECT dst, src, 'in' FROM {SUPPLY} WHERE dst = 'P:7'")
def neighbors(spark, d):
    edges, ids = supply_edges(spark, d), lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    out = graph.neighbours(edges, ids("S:2", "S:5"), "out", "related").select("id", "neighbour", F.lit("out").alias("direction"))
    return out.unionByName(graph.neighbours(edges, ids("P:7"), "in").select("id", "neighbour", F.lit("in").alias("direction")))


@query(f"SELECT dst AS id FROM {SUPPLY} WHERE src IN ('S:1', 'S:2') GROUP BY dst HAVING count(DISTINCT src) = 2")
def common_neighbors(spark, d):
    return graph.common_neighbours(supply_edges(spark, d), ["S:1", "S:2"])


@query(f"SELECT DISTINCT CASE WHEN src = 'N:4' THEN dst ELSE src END AS neighbour FROM {PARENT} WHERE src = 'N:4' OR dst = 'N:4'")
def incident_edges(spark, d):
    return graph.neighbours(parent_edges(spark, d), spark.createDataFrame([("N:4",)], "id string")).select("neighbour").distinct()


@query(f"""SELECT src, 'SUPPORTS' AS rel, dst FROM {SUPPLY} UNION ALL SELECT dst, 'DERIVED_FROM', src FROM {SUPPLY}""")
def graph_rewrite_derived(spark, d):
    return graph.with_inverse(supply_edges(spark, d).withColumn("rel", F.lit("SUPPORTS")).select("src", "rel", "dst"), "SUPPORTS", "DERIVED_FROM")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(trim(text)), '^(what is|define|explain)\\s+') THEN 'define' WHEN regexp_matches(lower(trim(text)), '^(how|why|when|where)\\s+') THEN 'explain'
 WHEN regexp_matches(lower(trim(text)), '^(compare|difference|versus|vs)\\s+') THEN 'compare' WHEN regexp_matches(lower(trim(text)), '^(find|search|list|show)\\s+') THEN 'find'
 WHEN regexp_matches(lower(trim(text)), '^(prove|verify|confirm|check)\\s+') THEN 'prove' WHEN regexp_matches(lower(trim(text)), '^(is it true|does|can|will)\\s+') THEN 'verify' ELSE 'unknown' END AS intent FROM conversations""")
def intent_classification(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.intent(F.col("text")).alias("intent"))
