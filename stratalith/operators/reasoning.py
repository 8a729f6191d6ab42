"""Choosing, planning and checking: the steps between a ranked list and an answer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalith.functions.text import NEGATION_PAIRS, SCORING_STOP_WORDS

# The steps of each intent's plan.
PLANS = {
    "define": ["retrieve", "synthesize", "format"],
    "explain": ["retrieve", "deduce", "synthesize", "format"],
    "compare": ["retrieve", "compare", "synthesize", "format"],
    "find": ["retrieve", "verify", "format"],
    "prove": ["retrieve", "deduce", "verify", "format"],
    "verify": ["retrieve", "deduce", "format"],
    "unknown": ["retrieve", "synthesize", "format"],
}


def plan(intent: Column) -> Column:
    """The plan of an intent as an array of steps."""
    steps = F.create_map(*(x for k, v in PLANS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(F.element_at(steps, intent), F.element_at(steps, F.lit("unknown")))


def _tokens(text: str) -> set[str]:
    return set(re.findall(r"\b[a-z][a-z0-9]*\b", text.lower())) - set(SCORING_STOP_WORDS)


def contradict(a: str, b: str) -> bool:
    """The row form of ``functions.text.contradictory``, for folds that look at few claims."""
    for pos, neg in NEGATION_PAIRS:
        for p, q in ((pos, neg), (neg, pos)):
            if p in a and q in b:
                x, y = _tokens(a.replace(p, "")), _tokens(b.replace(q, ""))
                if x and y and len(x & y) / max(len(x), len(y)) > 0.6:
                    return True
    return False


def select_greedily(candidates: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, id, adjusted, rank): candidates in score order, each contradiction with a chosen one costing a half of half its score.

    ``candidates``: query_id, id, score, claims.  What is left at 0.1 or less is passed over.
    The choice is sequential in a query; queries run apart, on their few best candidates.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        chosen, out = [], []
        for r in rows.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            claims = {c.lower() for c in r.claims}
            penalty = min(1.0, 0.5 * sum(contradict(a, b) for a in claims for other in chosen for b in other))
            adjusted = r.score * (1 - 0.5 * penalty)
            if adjusted > 0.1:
                chosen.append(claims)
                out.append((r.query_id, r.id, adjusted, len(out) + 1))
            if len(out) >= most:
                break
        return pd.DataFrame(out, columns=["query_id", "id", "adjusted", "rank"])

    return candidates.groupBy("query_id").applyInPandas(run, "query_id long, id long, adjusted double, rank long")


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def unapproved(sentences: DataFrame, approved: DataFrame) -> DataFrame:
    """Sentences (id, text) that neither hold an approved text (id, text) of their id nor share over 0.7 of their words with one."""
    own = sentences.select("id", "text", normalised(F.col("text")).alias("s"))
    good = approved.select("id", normalised(F.col("text")).alias("a"))
    words = lambda c: F.array_distinct(F.split(c, " "))
    fits = F.contains("s", F.col("a")) | F.contains("a", F.col("s")) | (F.size(F.array_intersect(words(F.col("s")), words(F.col("a")))) / F.greatest(F.size(words(F.col("s"))), F.lit(1)) > 0.7)
    allowed = own.join(good, "id").where(fits).select("id", "text").distinct()
    return own.join(allowed, ["id", "text"], "left_anti").select("id", "text")


def status(covered: Column, total: Column, conflicts: Column) -> Column:
    """COMPLETE, PARTIAL, UNKNOWN or FAILED of an answer by its covered parts and conflicts."""
    return F.when(total == 0, "UNKNOWN").when(covered == 0, "FAILED").when((covered < total) | (conflicts > 0), "PARTIAL").otherwise("COMPLETE")
