"""A natural-deduction checker over proof nodes, one vectorised group a proof.

A formula is a nested list: ["atom", pred, args...], ["eq", a, b], ["and", p, q],
["or", p, q], ["imp", p, q] or ["not", p].  A node may use earlier nodes only; whatever is
not a right step fails the proof.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

FALSE = ["atom", "False"]


def _pair(p: list, test: Callable) -> bool:
    return len(p) == 2 and (test(p[0], p[1]) or test(p[1], p[0]))


def _substituted(eq, known, out) -> bool:
    one_place = known[0] == "atom" and out[0] == "atom" and len(known) == len(out) == 3 and known[1] == out[1]
    return eq[0] == "eq" and one_place and ((known[2], out[2]) in ((eq[1], eq[2]), (eq[2], eq[1])))


#: Whether formula f follows from premises p under the assumptions s.
RULES: dict[str, Callable[[list, list, list], bool]] = {
    "ASSUME": lambda f, p, s: not p and f in s,
    "REITERATE": lambda f, p, s: len(p) == 1 and f == p[0],
    "IMP_ELIM": lambda f, p, s: _pair(p, lambda a, b: b == ["imp", a, f]),
    "AND_INTRO": lambda f, p, s: len(p) == 2 and f == ["and", *p],
    "AND_ELIM_L": lambda f, p, s: len(p) == 1 and p[0][0] == "and" and f == p[0][1],
    "AND_ELIM_R": lambda f, p, s: len(p) == 1 and p[0][0] == "and" and f == p[0][2],
    "OR_INTRO_L": lambda f, p, s: len(p) == 1 and f[0] == "or" and f[1] == p[0],
    "OR_INTRO_R": lambda f, p, s: len(p) == 1 and f[0] == "or" and f[2] == p[0],
    "NOT_ELIM": lambda f, p, s: f == FALSE and _pair(p, lambda a, b: b == ["not", a]),
    "EQ_REFL": lambda f, p, s: not p and f[0] == "eq" and f[1] == f[2],
    "EQ_SYMM": lambda f, p, s: len(p) == 1 and p[0][0] == "eq" and f == ["eq", p[0][2], p[0][1]],
    "EQ_TRANS": lambda f, p, s: all(x[0] == "eq" for x in p) and _pair(p, lambda a, b: a[2] == b[1] and f == ["eq", a[1], b[2]]),
    "EQ_SUBST_PRED": lambda f, p, s: _pair(p, lambda a, b: _substituted(a, b, f)),
}


def check(nodes: list[tuple[str, str, list[str], list]], assumptions: list, goal: list, conclusion: str) -> str:
    """'pass', or what is wrong first."""
    derived: dict[str, list] = {}
    if not nodes:
        return "no nodes"
    for node_id, rule, premises, formula in nodes:
        if rule not in RULES:
            return f"{node_id}: unknown rule"
        if any(p not in derived for p in premises):
            return f"{node_id}: premise not derived"
        try:
            right = RULES[rule](formula, [derived[p] for p in premises], assumptions)
        except (IndexError, TypeError, KeyError):
            right = False
        if not right:
            return f"{node_id}: {rule} fails"
        derived[node_id] = formula
    if conclusion not in derived:
        return "conclusion missing"
    return "pass" if derived[conclusion] == goal else "conclusion is not the goal"


def check_proofs(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """(proof_id, verdict).

    ``nodes``: proof_id, pos, node_id, rule, premises array<string>, formula JSON;
    ``heads``: proof_id, assumptions, goal (JSON), conclusion.  A proof is small, so its
    nodes meet in one group.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if right.empty:
            return pd.DataFrame({"proof_id": [key[0]], "verdict": ["no head"]})
        h = right.iloc[0]
        steps = [(r.node_id, r.rule, list(r.premises), json.loads(r.formula)) for r in left.sort_values("pos").itertuples()]
        verdict = check(steps, json.loads(h.assumptions), json.loads(h.goal), h.conclusion)
        return pd.DataFrame({"proof_id": [key[0]], "verdict": [verdict]})

    return nodes.groupBy("proof_id").cogroup(heads.groupBy("proof_id")).applyInPandas(run, "proof_id long, verdict string")
