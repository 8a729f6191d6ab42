"""Named queries over the shared tables and the SQL that states the same rows."""

from __future__ import annotations

from stratalith.plans import artifacts, bricks, governance, knowledge, retrieval

MODULES = (knowledge, retrieval, artifacts, governance, bricks)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
