"""Bricks, expectations and split gates on small literal inputs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalith.operators import bricks, packs

TEXT = "before\n# One\n- short\n- a bullet of some length\n2) a numbered line of some length\n\n## Two\n\n# Three\nThe sky is a very wide blue thing. It works. \nWord term: a meaning of some length\n"


def test_sections_claims_and_definitions(spark):
    docs = spark.createDataFrame([(1, "t", TEXT), (2, "plain", "  no heading, just a sentence of claim length. "), (3, "none", None), (4, "empty", "")], "id int, title string, text string")
    found = {(r["id"], r["pos"]): r for r in bricks.compiled(docs).collect()}
    assert sorted(found) == [(1, 0), (1, 1), (2, 0), (4, 0)]
    assert (found[1, 0]["title"], found[1, 0]["kind"]) == ("One", "claim")
    assert [(c["text"], c["confidence"]) for c in found[1, 0]["claims"]] == [("a bullet of some length", 0.7), ("a numbered line of some length", 0.7)]
    assert (found[1, 1]["title"], found[1, 1]["kind"]) == ("Three", "concept")
    assert [tuple(d) for d in found[1, 1]["definitions"]] == [("The sky", "a very wide blue thing"), ("Word term", "a meaning of some length")]
    assert found[1, 1]["claims"][0]["confidence"] == 0.5
    assert (found[2, 0]["title"], found[2, 0]["summary"]) == ("plain", "no heading, just a sentence of claim length.")
    assert found[4, 0]["summary"] == "" and not found[4, 0]["claims"]


def test_long_runs_of_words_are_looked_at_once(spark):
    text = "# h\n" + "word " * 200_000 + "is something of length. " + "Plain line\n" * 5_000
    row = bricks.compiled(spark.createDataFrame([(1, "", text)], "id int, title string, text string")).collect()[0]
    assert row["definitions"] == [] and row["kind"] == "claim"


def _plain(text):
    return [(a.strip(), b.strip()) for a, b in re.findall(r"([A-Z][a-zA-Z\s]+)\s+is\s+(.+?)\.", text, re.I | re.A) if len(a.strip()) < 50 and len(b.strip()) > 10]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["is", " ", " is ", ".", "\n", "Word", "x", ", ", "7", " a longer tail of it", "é"]), max_size=14).map("".join), min_size=30, max_size=30))
def test_definitions_as_the_plain_pattern_finds_them(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", bricks.definitions(F.col("t")).alias("d")).collect()
    for r in rows:
        assert [tuple(d) for d in r["d"]] == _plain(texts[r["i"]])


def test_expectations(spark):
    rows = [("complete", "Yes: RED", "answer"), ("partial", "UNKNOWN", "unknown"), ("unknown", "no", "partial"), ("failed", "red token", "other")]
    cols = [F.col(c) for c in ("status", "output", "behavior")]
    found = spark.createDataFrame(rows, "status string, output string, behavior string").select(bricks.expectations(*cols, F.array(F.lit("red")), F.array(F.lit("Token"))).alias("c"))
    assert [tuple(r["c"]) for r in found.collect()] == [(True, True, True), (True, False, True), (False, False, True), (True, True, False)]


def test_split_gates_in_their_order(spark):
    files = spark.createDataFrame([(m, p, "h" + p) for m in range(1, 7) for p in "ab"], "manifest int, path string, sha256 string")
    hashes = {r["manifest"]: r["pack_hash"] for r in packs.pack_hash(files, "manifest").collect()}
    declared = spark.createDataFrame([(m, "x" if m == 2 else hashes[m], 1 if m == 1 else 2) for m in range(1, 7)], "manifest int, declared string, children int")
    plan = [(m, 1, "a", 0, "copy") for m in range(1, 7)] + [(m, 2, "b", 5 if m == 4 else 1, "drop" if m == 6 else "copy") for m in range(1, 7) if m != 3] + [(5, 3, "z", 0, "copy"), (5, 4, "b", 9, "copy")]
    plan = spark.createDataFrame(plan, "manifest int, position int, path string, child int, transform string")
    assert {r["manifest"]: r["verdict"] for r in packs.split_verdict(files, declared, plan).collect()} == {
        1: "fewer than two children", 2: "integrity", 3: "silent split", 4: "child out of range", 5: "unknown source", 6: "passed",
    }
