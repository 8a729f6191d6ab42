"""Searches and walks that must not make a row for every pair they look at."""

import random
import re

import pyarrow as pa

from stratalith.operators import graph, search


def test_goals_of_a_start_share_one_walk(spark, monkeypatch):
    rng = random.Random(5)
    edges = sorted({(f"n{rng.randrange(30)}", rng.choice("rs"), f"n{rng.randrange(30)}") for _ in range(90)})
    strength = {e: 0.5 + 0.01 * i for i, e in enumerate(edges)}
    pairs = [(s, f"n{g}") for s in ("n1", "n2", "n3") for g in range(30)]
    rows = []
    monkeypatch.setattr(graph, "cut", lambda df, cut=graph.cut: (held := cut(df), rows.append(held.count()))[0])
    found = graph.shortest_paths(
        spark.createDataFrame([(*e, strength[e]) for e in edges], "src string, rel string, dst string, strength double"), spark.createDataFrame(pairs, "start string, goal string"), 4
    ).collect()
    assert max(rows) <= len(pairs)
    wanted = {}
    for start in ("n1", "n2", "n3"):
        walks = {start: ((), 1.0)}
        wanted[start, start] = ((), 1.0)
        for _ in range(4):
            ahead = {}
            for at, (path, s) in walks.items():
                for src, rel, dst in edges:
                    if src == at and (start, dst) not in wanted:
                        ahead.setdefault(dst, []).append(((*path, (rel, dst)), s * strength[src, rel, dst]))
            walks = {at: min(ways) for at, ways in ahead.items()}
            wanted |= {(start, at): way for at, way in walks.items()}
    assert {(r["start"], r["goal"]): (tuple((h["rel"], h["id"]) for h in r["path"]), round(r["strength"], 9)) for r in found} == {k: (p, round(s, 9)) for k, (p, s) in wanted.items()}


WORDS = ["the", "a", "of", "sun", "moon", "Star", "sea", "hill", "é", "x1"]


def _texts(n: int, seed: int, longest: int = 14) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "\n", "\t "]) for _ in range(rng.randrange(longest))) for _ in range(n)]


def _overlaps(docs: list[tuple], queries: list[tuple], k: int) -> set:
    first = lambda t: " ".join(t.split(" ")[:8])
    out = set()
    for query, text in queries:
        asked, halves = set(text.lower().split()), {}
        for i, t in docs:
            both = asked & set((t or "").lower().split())
            if both:
                halves[i] = halves.get(i, 0) + len(both) + 4 * len(asked & set(first(t).lower().split()))
        best = sorted(halves.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(query, i, round(h / 2 / len(asked), 6), rank) for rank, (i, h) in enumerate(best, 1)}
    return out


def test_overlap_search_scores_where_it_reads(spark):
    docs, queries = [*((i, t) for i, t in enumerate(_texts(80, 1))), (80, None), (81, " the sun")], list(enumerate(_texts(6, 2, 6)))
    asked = spark.createDataFrame(queries, "query_id int, text string")
    found = search.overlap_search(spark.createDataFrame(docs, "id long, text string"), asked, 5)
    assert not re.search(r"hashpartitioning\(query_id#\d+L?, id#", found._jdf.queryExecution().toString())
    assert {tuple(r) for r in found.collect()} == _overlaps(docs, queries, 5)
    again = [*docs, (3, "the moon"), (3, "moon of")]
    assert {tuple(r) for r in search.overlap_search(spark.createDataFrame(again, "id long, text string"), asked, 5).collect()} == _overlaps(again, queries, 5)


def test_best_overlaps_in_blocks(monkeypatch):
    docs, queries = list(enumerate(_texts(60, 3))), list(enumerate(_texts(5, 4, 6)))
    random.Random(1).shuffle(docs)
    asked = pa.table({"query_id": [q for q, _ in queries], "q": pa.array([sorted(set(t.lower().split())) for _, t in queries], pa.list_(pa.string()))})
    rows = lambda part: pa.RecordBatch.from_pydict({"id": [i for i, _ in part], "title": [" ".join(t.split(" ")[:8]).lower() for _, t in part], "text": [t.lower() for _, t in part]})
    monkeypatch.setattr(search, "CELLS", 15)
    (found,) = search.best_overlaps(iter([rows(docs[:25]), rows(docs[25:])]), asked, 4)
    assert {(r["query_id"], r["id"], round(r["halves"] / 2 / r["n"], 6)) for r in found.to_pylist()} == {x[:3] for x in _overlaps(docs, queries, 4)}


def test_sets_meet_on_the_rarer_half_only(spark, monkeypatch):
    rng = random.Random(9)
    some = lambda: ["the", *rng.sample([f"w{i}" for i in range(12)], rng.randrange(6))]
    sets, asked = [some() for _ in range(60)], [some() for _ in range(20)]
    cuts = []
    monkeypatch.setattr(search, "cut", lambda df, cut=search.cut: (cuts.append(held := cut(df)), held)[1])
    found = search.alike_by_half(spark.createDataFrame(list(enumerate(sets)), "a int, w array<string>"), spark.createDataFrame(list(enumerate(asked)), "b int, v array<string>"))
    like = lambda x, y: len({*x} & {*y}) / len({*x} | {*y}) > 0.5
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a, x in enumerate(sets) for b, y in enumerate(asked) if like(x, y)}
    assert cuts[-1].where("__word = 'the'").count() == sum(len(y) == 1 for y in asked)
