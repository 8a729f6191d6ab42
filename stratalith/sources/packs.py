"""Readers and writers of packs, prompts, plain documents, containers, traces and receipts.

Directory scans go through Spark's own file readers, so any store that Spark reads will
do; files are parsed in Arrow batches on the executors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalith.functions.text import allowed
from stratalith.shipping import ship

PACK = (
    "path string, id string, title string, summary string, authorship string, disclosure_tier string, status string, created_date string, updated_date string, "
    "pii_risk string, contains_personal boolean, redacted boolean, tags array<string>, parents array<string>, children array<string>, related array<string>, "
    "claims array<string>, tests array<string>, error string"
)
_LISTS = ("tags", "parents", "children", "related", "claims")
_PLAIN = ("id", "title", "summary", "authorship", "created_date", "updated_date")


def _pack_row(path: str, content: bytes) -> dict:
    import yaml

    row: dict = {"path": path, "error": None}
    try:
        d = yaml.safe_load(content.decode())
        if not isinstance(d, dict):
            raise ValueError("not a mapping")
    except Exception as e:  # a bad file is a row that says so, as a scan must go on
        return row | {"error": str(e)[:200]}
    sensitivity = d.get("sensitivity") or {}
    row |= {k: None if d.get(k) is None else str(d[k]) for k in _PLAIN} | {k: [str(x) for x in d.get(k) or []] for k in _LISTS}
    row |= {"disclosure_tier": d.get("disclosure_tier") or "public", "status": d.get("status") or "draft"}
    row |= {"pii_risk": sensitivity.get("pii_risk") or "none", "contains_personal": bool(sensitivity.get("contains_personal")), "redacted": bool(sensitivity.get("redacted"))}
    return row | {"tests": [str(t.get("name")) for t in d.get("tests_or_falsifiers") or [] if isinstance(t, dict)]}


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in PACK.split(", "))])
    for batch in batches:
        rows = [_pack_row(p, c) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_packs(spark: SparkSession, root: str) -> DataFrame:
    """One row for each ``pack.yaml`` below ``root``; a file that cannot be read has ``error`` set."""
    files = ship(spark).read.format("binaryFile").option("pathGlobFilter", "pack.yaml").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "content").mapInArrow(_parsed, PACK)


def violations(packs: DataFrame) -> DataFrame:
    """(path, errors): every rule that each pack breaks; none for a valid one."""
    tiers, states, risks = ["public", "internal", "restricted"], ["draft", "active", "release"], ["none", "low", "medium", "high"]
    fails = lambda test, text: F.when(~F.coalesce(test, F.lit(False)), F.lit(text))
    tests = F.array(
        fails(F.col("error").isNull(), "unreadable"),
        fails(F.col("id").rlike("^C[0-9]{4}$"), "id"),
        fails(F.length("title").between(1, 200), "title"),
        fails(F.length("summary").between(10, 1000), "summary"),
        fails(F.col("disclosure_tier").isin(tiers), "disclosure_tier"),
        fails(F.col("status").isin(states), "status"),
        fails(F.col("pii_risk").isin(risks), "pii_risk"),
        fails(F.forall("tags", lambda t: t.rlike("^[a-z0-9-]+$")), "tags"),
        fails(F.size("tests") >= 2, "tests_or_falsifiers"),
    )
    return packs.select("path", F.filter(tests, lambda v: v.isNotNull()).alias("errors"))


def sensitivity_level(packs: DataFrame) -> DataFrame:
    """Adds ``level``: 2 redacted, 1 sensitive, 0 public."""
    level = F.when(F.col("redacted"), 2).when(F.col("pii_risk").isin("medium", "high") | F.col("contains_personal"), 1).otherwise(0)
    return packs.withColumn("level", level)


def entities(packs: DataFrame) -> DataFrame:
    """(id, type, label, level): a concept a pack, its claims and tests by place, and each tag once."""
    packs = sensitivity_level(packs.where("error IS NULL"))
    made = lambda kind, field: F.concat_ws(":", "id", F.lit(kind), F.regexp_replace(F.concat(F.lit(field + "["), F.col("pos").cast("string"), F.lit("]")), "[^a-zA-Z0-9_]", "_"))
    concept = packs.select(F.concat_ws(":", "id", F.lit("Concept"), F.lit("id")).alias("id"), F.lit("Concept").alias("type"), F.col("title").alias("label"), "level")
    parts = [
        packs.select("id", "level", F.posexplode(field).alias("pos", "label")).select(made(kind, name).alias("id"), F.lit(kind).alias("type"), "label", "level")
        for kind, field, name in (("Claim", "claims", "claims"), ("Test", "tests", "tests_or_falsifiers"))
    ]
    tags = packs.select(F.explode("tags").alias("label")).distinct().select(F.concat(F.lit("Tag:"), F.substring(F.sha2("label", 256), 1, 16)).alias("id"), F.lit("Tag").alias("type"), "label", F.lit(0).alias("level"))
    return concept.unionByName(parts[0]).unionByName(parts[1]).unionByName(tags)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, prompt, expected_behavior, expected_contains, expected_not_contains, tags) of YAML prompt lists; the category defaults to the file's stem."""
    schema = "id string, category string, prompt string, expected_behavior string, expected_contains array<string>, expected_not_contains array<string>, tags array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for file, content in zip(batch["path"], batch["content"], strict=True):
                loaded = yaml.safe_load(content.decode()) or []
                for p in loaded.get("prompts", []) if isinstance(loaded, dict) else loaded:
                    lists = {k: [str(x) for x in p.get(k) or []] for k in ("expected_contains", "expected_not_contains", "tags")}
                    rows.append({"id": str(p.get("id")), "category": p.get("category") or file.rsplit("/", 1)[-1].rsplit(".", 1)[0], "prompt": p.get("prompt"), "expected_behavior": p.get("expected_behavior") or "answer"} | lists)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return ship(spark).read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_documents(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = 1 << 20) -> DataFrame:
    """(id, path, title, text, content_hash) of text, Markdown, YAML and JSON files up to ``most_bytes``, by path globs."""
    files = ship(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where((F.col("length") <= most_bytes) & F.col("path").rlike(r"\.(txt|md|ya?ml|json)$"))
    relative = F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    text = F.col("content").cast("string")
    held = files.where(allowed(relative, include or [], exclude or []))
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    return held.select(F.concat(F.lit("doc_"), F.substring(F.sha2("path", 256), 1, 12)).alias("id"), "path", name.alias("title"), without_markdown(text).alias("text"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))


def without_markdown(text):
    """Text without fences, headings, emphasis, inline code and link targets."""
    for pattern, new in ((r"(?s)```.*?```", ""), (r"(?m)^#{1,6}\s+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"`([^`]+)`", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1")):
        text = F.regexp_replace(text, pattern, new)
    return text


def first_of_each_content(documents: DataFrame) -> DataFrame:
    """Documents of equal content are one; the least id survives."""
    return documents.groupBy("content_hash").agg(F.min_by(F.struct("id", "path", "title", "text"), "id").alias("d")).select("d.*", "content_hash")


def container_index(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, branch, offset, length, checksum) of every container below ``path``, without decoding."""
    from stratalith.operators.codecs import block_index

    schema = "path string, block int, branch string, offset long, length long, checksum long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *x) for p, c in zip(batch["path"], batch["content"], strict=True) for x in block_index(c)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return ship(spark).read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(tick, frame) of a JSON list of pairs."""
    pairs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<bigint>>")).alias("p"))
    return pairs.select(F.get("p", F.lit(0)).alias("tick"), F.get("p", F.lit(1)).alias("frame"))


def write_public(packs: DataFrame, edges: DataFrame, path: str) -> None:
    """Public packs, and the edges both of whose ends are public."""
    public = sensitivity_level(packs.where("error IS NULL")).where("disclosure_tier = 'public' AND level = 0")
    ids = public.select(F.col("id"))
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    public.write.mode("overwrite").json(f"{path}/packs")
    kept.write.mode("overwrite").json(f"{path}/edges")


def append_trace(result: DataFrame, path: str) -> None:
    """Adds a query result to a trace log; ``read_traces`` gives the newest first."""
    result.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path).orderBy(F.desc("at"))


def receipt(operation: str, gates: dict[str, str], inputs: list[str], outputs: list[str]) -> str:
    """Canonical JSON of a receipt; it passes if no gate fails."""
    body = {"operation": operation, "inputs": sorted(inputs), "outputs": sorted(outputs), "gates": gates, "passed": all(g != "fail" for g in gates.values())}
    return json.dumps(body, sort_keys=True, separators=(",", ":")) + "\n"
