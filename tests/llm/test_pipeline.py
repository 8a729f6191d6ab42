"""The pipeline's stages on the smallest tables, each judged on its own input."""

import collections
import zlib

import numpy as np
import public_tokenizers
from test_corpus_operators import WORD, brute_lines, closed
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before, seen = docs.columns, [tuple(r) for r in docs.collect()], {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r.asDict() for r in docs.collect()]
        assert name == "packing" or docs.columns == columns
    start = {r[0]: dict(zip(columns, r, strict=True)) for r in before}
    clean = {r["doc_id"]: r for r in seen["toxicity"]}
    assert 0 < len(clean) <= len(start) and all(clean[i] == start[i] for i in clean)
    gone = brute_lines(sorted((i, r["text"]) for i, r in clean.items()))
    lined = {r["doc_id"]: r for r in seen["line dedup"]}
    for i, r in clean.items():
        kept = "\n".join(x for p, x in enumerate(r["text"].split("\n")) if p not in gone[i])
        assert lined[i]["text"] == kept and lined[i]["n_chars"] == len(kept)
    sets = {}
    for i, r in lined.items():
        w = WORD.findall(r["text"].lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = closed(sorted(sets), links)
    single = {r["doc_id"]: r for r in seen["MinHash near-dedup"]}
    assert set(single) == {i for i in sets if root[i] == i} and all(single[i] == lined[i] for i in single)
    shown = collections.Counter(r["doc_id"] for r in seen["mixing"])
    assert set(shown) == set(single) and set(shown.values()) <= {1, 2}
    tool, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), collections.Counter()
    for i, n in shown.items():
        ids = np.array([*tool.encode(single[i]["text"], add_special_tokens=False).ids, 0], dtype="<u4")
        want[i] = n * len(ids)
        for p in (p for p in seen["packing"] if p["doc_id"] == i):
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    copies = {i for i, n in shown.items() if n > 1}
    where = {}
    for p in seen["packing"]:
        if p["doc_id"] in copies and p["start"] == 0:
            where.setdefault(p["doc_id"], []).append(p["sequence_id"])
    assert copies and all(len(set(w)) == len(w) for w in where.values())
    packed = collections.Counter()
    for p in seen["packing"]:
        packed[p["doc_id"]] += p["length"]
    assert packed == want


def test_entry_names():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
