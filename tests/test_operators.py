"""Operators on small literal inputs, where the answer is plain to see."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalith.functions import text as T
from stratalith.operators import codecs, graph, proofs, rules, temporal
from stratalith.streaming import sessions

A = rules.Atom


def args(found):
    return sorted(tuple(r["args"]) for r in found.collect())


def test_rules_repeat_variables_and_cycles(spark):
    facts = spark.createDataFrame([("edge", ["a", "b"]), ("edge", ["b", "c"]), ("edge", ["c", "a"]), ("edge", ["d", "d"])], "predicate string, args array<string>")
    loops = rules.Rule("r1", A("loop", ("?x",)), (A("edge", ("?x", "?x")),))
    path = rules.Rule("r2", A("path", ("?x", "?y")), (A("edge", ("?x", "?y")),))
    more = rules.Rule("r3", A("path", ("?x", "?z")), (A("path", ("?x", "?y")), A("edge", ("?y", "?z"))))
    found = rules.fixpoint(facts, [loops, path, more])
    assert args(found.where("predicate = 'loop'")) == [("d",)]
    assert args(found.where("predicate = 'path'")) == sorted([(x, y) for x in "abc" for y in "abc"] + [("d", "d")])
    assert found.where("predicate = 'path' AND round = 1").count() == 4


def test_rule_literals_filters_and_arity(spark):
    facts = spark.createDataFrame([("p", ["1", "x"]), ("p", ["2", "y"]), ("p", ["3", "x", "z"])], "predicate string, args array<string>")
    rule = rules.Rule("r", A("q", ("?a",)), (A("p", ("?a", "x")),), (rules.Filter("gte", "?a", "1"),))
    assert [r[0] for r in rules.bindings(rule, [facts]).collect()] == ["1"]
    unbound = rules.Rule("r", A("q", ("?a",)), (A("p", ("?a", "x")),), (rules.Filter("eq", "?b", "1"),))
    assert rules.bindings(unbound, [facts]).count() == 0
    assert rules.matching(facts, "p", [None, "?v"]).count() == 2


def test_rules_from_yaml():
    text = "rule_id: B\nhead: {predicate: h, args: ['?x']}\nbody: [{predicate: b, args: ['?x']}]\n---\nnote: skipped\n---\nrule_id: A\nhead: {predicate: h, args: ['?x']}\nbody: [{predicate: b, args: ['?x', k]}]\nfilters: [{op: neq, a: '?x', b: k}]\n"
    assert [r.rule_id for r in rules.load_rules(text)] == ["A", "B"]


def test_shortest_path_takes_least_sequence(spark):
    edges = spark.createDataFrame([("a", "r", "c"), ("a", "r", "b"), ("b", "r", "d"), ("c", "r", "d"), ("d", "r", "a")], "src string, rel string, dst string")
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("d", "zz")], "start string, goal string")
    found = {(r.start, r.goal): [h.id for h in r.path] for r in graph.shortest_paths(edges, pairs).collect()}
    assert found == {("a", "d"): ["b", "d"], ("a", "a"): []}


def test_contradictions(spark):
    rows = [("the bridge is always safe now", "the bridge is never safe now", True), ("cats sleep", "dogs bark", False), ("", "", False)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(T.contradictory(F.col("a"), F.col("b")) != F.col("want")).count() == 0


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.rs", "a.rs", True), ("*.rs", "d/a.rs", False), ("**/*.rs", "d/e/a.rs", True), ("**/*.rs", "a.rs", True), (".git/**", ".git/x/y", True), (".git/**", "a/.git", False)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(T.glob_pattern(glob), path)) == hit


def test_interpolation_is_clamped_and_cut(spark):
    anchors = spark.createDataFrame([(1, 0, 100), (1, 10, 205), (1, 20, 300)], "k int, tick long, frame long")
    asked = spark.createDataFrame([(1, t) for t in (-5, 0, 3, 10, 15, 99)], "k int, tick long")
    got = {r.tick: r.frame for r in temporal.interpolated(anchors, asked, "k").collect()}
    assert got == {-5: 100, 0: 100, 3: 131, 10: 205, 15: 252, 99: 300}


@given(st.binary(max_size=600), st.integers(0, 2**62))
@settings(max_examples=60, deadline=None)
def test_codecs_round_trip(data, n):
    assert codecs.decode_varint(codecs.encode_varint(n))[0] == n
    entries = codecs.phrases(data)
    assert codecs.phrase_decode(codecs.phrase_encode(data, entries), entries) == data
    assert codecs.unpack_blocks(codecs.pack_blocks(data, 128)) == data


def test_codec_refuses_another_dictionary():
    with pytest.raises(ValueError):
        codecs.phrase_decode(codecs.phrase_encode(b"abcabc", [b"abc"]), [b"abd"])
    assert len(codecs.phrase_encode(b"", [])) == 32


def test_proof_forward_reference_fails():
    a = ["atom", "A"]
    assert proofs.check([("n0", "REITERATE", ["n1"], a), ("n1", "ASSUME", [], a)], [a], a, "n0") == "n0: premise not derived"


def test_hash_chain_breaks_are_found(spark):
    events = spark.createDataFrame([(1, i, f"e{i}") for i in range(4)] + [(2, 0, "x")], "k long, n long, body string")
    log = sessions.hash_chain(events, "k", "n", F.col("body")).join(events, ["k", "n"])
    assert sessions.broken_links(log, "k", "n", F.col("body")).count() == 0
    changed = log.withColumn("body", F.when((F.col("k") == 1) & (F.col("n") == 2), "other").otherwise(F.col("body")))
    assert [(r.k, r.n) for r in sessions.broken_links(changed, "k", "n", F.col("body")).collect()] == [(1, 2)]


def test_stream_of_files_matches_batch(spark, tmp_path):
    schema = "ts timestamp, user_id long, value double"
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id) AS ts, id % 3 AS user_id, CAST(id AS double) AS value FROM range(240)")
    rows.write.parquet(str(tmp_path / "in"))
    batch = sessions.tumbling(rows, "ts", "1 hour", "user_id").count()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    live = sessions.tumbling(stream, "ts", "1 hour", "user_id", watermark="10 minutes")
    sessions.run_once(live, str(tmp_path / "out"), str(tmp_path / "log"))
    assert 0 < spark.read.parquet(str(tmp_path / "out")).count() <= batch


def test_chunks():
    from stratalith.operators.chunking import chunks

    assert chunks(None) == chunks(" \n\n ") == []
    assert chunks("aa\n\nbb\n\n\n\ncc", 8) == ["aa\n\nbb", "cc"]
    assert chunks("one\n\nfour five six\n\ntwo", 9) == ["one", "four five", "six", "two"]
    assert chunks("x" * 30 + " y", 9) == ["x" * 30, "y"]
    text = "\n\n".join(" ".join(["wörd"] * n) for n in (1, 3, 200, 2, 90, 1, 1))
    out = chunks(text)
    assert all(len(c.encode()) <= 512 for c in out) and " ".join(out).split() == text.split()


def test_phrases_match_longest_first():
    entries = [b"ab", b"abc", b"c"]
    woven = codecs.phrase_encode(b"xabcab\nc", entries)
    assert woven[32:] == b"\x00\x01x\x01\x01\x01\x00\x00\x01\n\x01\x02" and codecs.phrase_decode(woven, entries) == b"xabcab\nc"
    assert codecs.phrase_decode(codecs.phrase_encode(b"plain", []), []) == b"plain"
