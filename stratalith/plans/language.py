"""The query language: define, relate, find and prove, each answered by one row.

A result has the answer as JSON or UNKNOWN with its reason, the citations, and a trace
of the steps taken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.operators import graph, rules

RESULT = "kind string, answer string, unknown_reason string, citations array<string>, trace array<string>"


@dataclass(frozen=True)
class Parsed:
    kind: str
    terms: tuple[str, ...] = ()
    predicates: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())


def parse(query: str) -> Parsed:
    """One of the four forms, or kind ``unknown``."""
    text = query.strip()
    predicate = lambda s: (m[1], tuple(a.strip().strip("\"'") for a in m[2].split(",") if a.strip())) if (m := re.fullmatch(r"\s*(\w+)\s*\((.*)\)\s*", s)) else None
    if m := re.fullmatch(r"define\s+(.+)", text, re.I):
        return Parsed("define", (m[1].strip("\"' "),))
    if m := re.fullmatch(r"relate\s+(\"[^\"]+\"|\S+)\s+(?:and\s+|to\s+)?(\"[^\"]+\"|\S+)", text, re.I):
        return Parsed("relate", (m[1].strip('"'), m[2].strip('"')))
    if m := re.fullmatch(r"find\s+(\w+)(?:\s+where\s+(.+))?", text, re.I):
        parts = [predicate(p) for p in re.split(r"\s+and\s+", m[2], flags=re.I)] if m[2] else []
        return Parsed("find", (m[1],), tuple(parts)) if None not in parts else Parsed("unknown")
    if (m := re.fullmatch(r"prove\s+(.+)", text, re.I)) and (p := predicate(m[1])):
        return Parsed("prove", predicates=(p,))
    return Parsed("unknown")


@dataclass
class Knowledge:
    """entities (id, type, label, summary, level), edges (src, rel, dst), facts (predicate, args), and rules."""

    entities: DataFrame
    edges: DataFrame
    facts: DataFrame
    rules: list[rules.Rule] = field(default_factory=list)

    @property
    def spark(self):
        return self.entities.sparkSession

    def _row(self, kind: str, answer: str | None, reason: str | None, citations: list[str], trace: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(kind, answer or "UNKNOWN", reason, citations, trace)], RESULT)

    def ask(self, query: str, sensitive: bool = False) -> DataFrame:
        parsed = parse(query)
        if parsed.kind == "unknown":
            return self._row("unknown", None, "Query form not recognised", [], ["parse"])
        return getattr(self, "_" + parsed.kind)(parsed, sensitive)

    def _seen(self, sensitive: bool) -> DataFrame:
        return self.entities.where(F.col("level") <= (1 if sensitive else 0))

    def _define(self, q: Parsed, sensitive: bool) -> DataFrame:
        term = q.terms[0]
        one = self.spark.createDataFrame([(term,)], "term string").select(F.array_distinct(T.index_tokens(F.col("term"))).alias("q"))
        label = F.lower("label")
        scored = self._seen(sensitive).crossJoin(F.broadcast(one))  # one row
        points = lambda t: F.when(F.instr(label, t) > 0, 10).when(F.instr(F.lower(F.coalesce("summary", F.lit(""))), t) > 0, 5).otherwise(0)
        hits = F.filter(F.transform("q", points), lambda s: s > 0)
        score = F.aggregate(hits, F.lit(0), lambda a, s: a + s) + F.when(F.lower("id") == term.lower(), 100).otherwise(0)
        covered = F.when(F.size("q") > 0, F.size(hits) / F.size("q")).otherwise(0.0)
        best = scored.select("id", "type", "label", "summary", score.alias("score"), covered.alias("covered")).where((F.col("covered") >= 0.5) & (F.col("score") >= 1)).orderBy(F.desc("score"), "id").limit(1).collect()
        if not best:
            return self._row("define", None, f"No definition found for '{term}'", [], ["search", "lookup"])
        b = best[0]
        return self.spark.createDataFrame([(b["id"], b["type"], b["label"], b["summary"])], "id string, type string, title string, summary string").select(
            F.lit("define").alias("kind"), F.to_json(F.struct("id", "type", "title", "summary")).alias("answer"), F.lit(None).cast("string").alias("unknown_reason"), F.array("id").alias("citations"), F.array(F.lit("search"), F.lit("lookup")).alias("trace")
        )

    def _resolve(self, term: str, sensitive: bool) -> str | None:
        exact = (F.lower("id") == term.lower()) | (F.lower("label") == term.lower())
        part = F.instr(F.lower("id"), F.lit(term.lower())) + F.instr(F.lower("label"), F.lit(term.lower())) > 0
        found = self._seen(sensitive).where(exact | part).select("id", F.when(exact, 0).otherwise(1).alias("o")).orderBy("o", "id").limit(1).collect()
        return found[0]["id"] if found else None

    def _relate(self, q: Parsed, sensitive: bool) -> DataFrame:
        ends = [self._resolve(t, sensitive) for t in q.terms]
        for term, end in zip(q.terms, ends, strict=True):
            if end is None:
                return self._row("relate", None, f"Could not resolve '{term}'", [], ["resolve"])
        pair = self.spark.createDataFrame([tuple(ends)], "start string, goal string")
        path = graph.shortest_paths(self.edges, pair, max_edges=20).collect()
        if not path:
            return self._row("relate", None, f"No path from '{ends[0]}' to '{ends[1]}'", [], ["resolve", "graph_traverse"])
        hops = [(h["rel"], h["id"]) for h in path[0]["path"]]
        nodes = [ends[0], *(i for _, i in hops)]
        return self.spark.createDataFrame([(ends[0], ends[1], nodes, [r for r, _ in hops])], "from string, to string, path array<string>, relationships array<string>").select(
            F.lit("relate").alias("kind"), F.to_json(F.struct("from", "to", "path", "relationships")).alias("answer"), F.lit(None).cast("string").alias("unknown_reason"), F.col("path").alias("citations"), F.array(F.lit("resolve"), F.lit("graph_traverse")).alias("trace")
        )

    def _known(self) -> DataFrame:
        return rules.fixpoint(self.facts, self.rules) if self.rules else self.facts.withColumns({"rule_id": F.lit(None).cast("string"), "round": F.lit(0)})

    def _find(self, q: Parsed, sensitive: bool) -> DataFrame:
        typed = self._seen(sensitive).where(F.lower("type") == q.terms[0].lower())
        found = rules.entities_with(typed, self._known(), [(p, list(a)) for p, a in q.predicates])
        rows = found.agg(F.array_sort(F.collect_list("id")).alias("ids"))
        none = F.size("ids") == 0
        return rows.select(
            F.lit("find").alias("kind"), F.when(none, "UNKNOWN").otherwise(F.to_json(F.struct("ids"))).alias("answer"), F.when(none, f"No {q.terms[0]} fits").alias("unknown_reason"), F.col("ids").alias("citations"),
            F.array(F.lit("rules"), F.lit("filter")).alias("trace"),
        )

    def _prove(self, q: Parsed, sensitive: bool) -> DataFrame:
        predicate, args = q.predicates[0]
        exact = self._known().where((F.col("predicate") == predicate) & (F.to_json("args") == F.to_json(F.array(*(F.lit(a) for a in args)))))
        hit = exact.select("rule_id", "round").limit(1).collect()
        if not hit:
            return self._row("prove", None, f"Not derivable: {predicate}({', '.join(args)})", [], ["rules", "lookup"])
        rule = hit[0]["rule_id"]
        return self._row("prove", f'{{"proved":true,"rule":"{rule or "given"}","depth":{hit[0]["round"]}}}', None, [rule] if rule else [], ["rules", "lookup"])
