"""The query language and the readers on small fixtures."""

import json

import pytest

from stratalith.operators import codecs, reasoning, rules
from stratalith.plans.language import Knowledge, parse
from stratalith.sources import packs

PACK = """id: {id}
title: {title}
summary: A long enough summary of {title}.
disclosure_tier: public
status: active
sensitivity: {{pii_risk: {risk}, contains_personal: false, redacted: false}}
tags: [maps, one-tag]
parents: []
children: []
related: []
claims: [first claim, second claim]
tests_or_falsifiers: [{{name: a}}, {{name: b}}]
"""


@pytest.fixture(scope="module")
def knowledge(spark):
    entities = spark.createDataFrame(
        [("C0001", "Concept", "Holodeck vision", "A room of light", 0), ("C0002", "Concept", "Pattern engine", "Finds patterns", 0), ("C0003", "Concept", "Hidden thing", "Secret", 2)],
        "id string, type string, label string, summary string, level int",
    )
    edges = spark.createDataFrame([("C0001", "child", "C0002"), ("C0002", "related", "C0001")], "src string, rel string, dst string")
    facts = spark.createDataFrame([("edge", ["C0001", "parent", "C0002"]), ("hasTag", ["C0001", "maps"])], "predicate string, args array<string>")
    rule = rules.Rule("R002", rules.Atom("edge", ("?b", "child", "?a")), (rules.Atom("edge", ("?a", "parent", "?b")),))
    return Knowledge(entities, edges, facts, [rule])


def test_define(knowledge):
    r = knowledge.ask("define Holodeck").first()
    assert json.loads(r.answer) == {"id": "C0001", "type": "Concept", "title": "Holodeck vision", "summary": "A room of light"}
    assert r.trace == ["search", "lookup"] and r.citations == ["C0001"]
    r = knowledge.ask("define XYZ_NONEXISTENT_TERM_12345").first()
    assert r.answer == "UNKNOWN" and "No definition found" in r.unknown_reason
    assert knowledge.ask("define Hidden thing").first().answer == "UNKNOWN"


def test_relate(knowledge):
    r = knowledge.ask("relate C0001 C0002").first()
    assert json.loads(r.answer) == {"from": "C0001", "to": "C0002", "path": ["C0001", "C0002"], "relationships": ["child"]} and "graph_traverse" in r.trace
    assert "Could not resolve" in knowledge.ask("relate C0001 UNKNOWN_CONCEPT_XYZ").first().unknown_reason


def test_find_and_prove(knowledge):
    assert json.loads(knowledge.ask("find concept where hasTag(?x, maps) and edge(?x, parent)").first().answer) == {"ids": ["C0001"]}
    assert json.loads(knowledge.ask("prove edge(C0002, child, C0001)").first().answer) == {"proved": True, "rule": "R002", "depth": 1}
    assert knowledge.ask("prove edge(C0001, child, C0002)").first().answer == "UNKNOWN"
    assert knowledge.ask("what now").first().kind == "unknown" and parse("find x where nonsense").kind == "unknown"


def test_packs(spark, tmp_path):
    for i, (risk, body) in enumerate([("none", PACK), ("high", PACK), ("none", "- just\n- a list\n")]):
        (tmp_path / f"c{i}").mkdir()
        (tmp_path / f"c{i}" / "pack.yaml").write_text(body.format(id=f"C000{i}", title=f"Title {i}", risk=risk))
    found = packs.read_packs(spark, str(tmp_path))
    errors = {r.path.rsplit("/", 2)[-2]: r.errors for r in packs.violations(found).collect()}
    assert errors["c0"] == errors["c1"] == [] and "unreadable" in errors["c2"]
    made = packs.entities(found).collect()
    assert sorted(r.type for r in made) == ["Claim"] * 4 + ["Concept"] * 2 + ["Tag"] * 2 + ["Test"] * 4
    assert {r.id for r in made if r.type == "Claim"} >= {"C0000:Claim:claims_0_"}
    edges = spark.createDataFrame([("C0000", "related", "C0000"), ("C0000", "related", "C0001")], "src string, rel string, dst string")
    packs.write_public(found, edges, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "edges")).count() == 1


def test_documents_containers_and_prompts(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.md").write_text("# Head\n**bold** and [link](x)\n")
    (root / "b.txt").write_text("plain")
    (root / "c.bin").write_bytes(codecs.pack_blocks(b"abc" * 3000))
    docs = packs.read_documents(spark, str(root), exclude=["*.txt"]).collect()
    assert [(d.title, d.text) for d in docs] == [("a", "Head\nbold and link\n")]
    index = packs.container_index(spark, str(root / "c.bin")).collect()
    assert [r.block for r in index] == list(range(5)) and {r.branch for r in index} <= set(codecs.BRANCHES)
    (tmp_path / "knowledge.yaml").write_text("- {id: p1, prompt: define x, expected_contains: [a]}\n")
    assert packs.read_prompts(spark, str(tmp_path / "knowledge.yaml")).first().category == "knowledge"
    (tmp_path / "sync.json").write_text("[[0, 10], [5, 20]]")
    assert packs.read_anchors(spark, str(tmp_path / "sync.json")).count() == 2


def test_greedy_selection(spark):
    rows = [(1, 1, 1.0, ["the road is always open now"]), (1, 2, 0.9, ["the road is never open now"]), (1, 3, 0.05, ["other"])]
    got = reasoning.select_greedily(spark.createDataFrame(rows, "query_id long, id long, score double, claims array<string>")).collect()
    assert [(r.id, round(r.adjusted, 6), r["rank"]) for r in got] == [(1, 1.0, 1), (2, 0.675, 2)]


def test_unapproved_claims(spark):
    said = spark.createDataFrame([(1, "The sky is blue."), (1, "Cats can fly away!")], "id long, text string")
    good = spark.createDataFrame([(1, "the sky is blue")], "id long, text string")
    assert [r.text for r in reasoning.unapproved(said, good).collect()] == ["Cats can fly away!"]
