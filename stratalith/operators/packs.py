"""Hashed file manifests: hashing, verifying, comparing, splitting, merging, redacting, sealing.

A manifest is a table (path, sha256, size); several are told apart by a manifest column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_hash(files: DataFrame, manifest: str) -> DataFrame:
    """(manifest, n_files, pack_hash): SHA-256 over the path-sorted ``path:sha256`` lines of each manifest."""
    line = F.struct("path", F.concat(F.col("path"), F.lit(":"), F.col("sha256"), F.lit("\n")).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["line"]), "")
    return files.groupBy(manifest).agg(F.count("*").alias("n_files"), F.sha2(text, 256).alias("pack_hash"))


def compare(declared: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status) of every path of either: missing, extra, hash, size or ok."""
    a = declared.select("path", F.col("sha256").alias("ha"), F.col("size").alias("za"))
    b = found.select("path", F.col("sha256").alias("hb"), F.col("size").alias("zb"))
    status = (
        F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").when(F.col("ha") != F.col("hb"), "hash").when(F.col("za") != F.col("zb"), "size").otherwise("ok")
    )
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def conflicts(files: DataFrame) -> DataFrame:
    """(path, n_hashes): paths that several manifests give different contents."""
    return files.groupBy("path").agg(F.count_distinct("sha256").alias("n_hashes")).where("n_hashes > 1")


def fuse(primary: DataFrame, secondary: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(path, sha256, size, side, resolution): the merged manifest.

    ``resolutions`` (path, resolution) say take_primary, take_secondary or skip for paths
    in conflict; a path in conflict without one is kept open with a null hash, and any
    other resolution drops the path.
    """
    a = primary.select("path", F.struct("sha256", "size").alias("a"))
    b = secondary.select("path", F.struct("sha256", "size").alias("b"))
    both = a.join(b, "path", "full_outer").join(resolutions, "path", "left")
    clash = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a.sha256") != F.col("b.sha256"))
    pick = (
        F.when(~clash, F.coalesce("a", "b")).when(F.col("resolution") == "take_primary", F.col("a")).when(F.col("resolution") == "take_secondary", F.col("b"))
    )
    side = F.when(clash, "conflict").when(F.col("b").isNull(), "primary").when(F.col("a").isNull(), "secondary").otherwise("shared")
    open_ = clash & F.col("resolution").isNull()
    rows = both.select("path", pick.alias("f"), side.alias("side"), F.when(clash, F.coalesce("resolution", F.lit("unresolved"))).alias("resolution"), open_.alias("open"))
    return rows.where(F.col("f").isNotNull() | F.col("open")).select("path", "f.sha256", "f.size", "side", "resolution")


def split(files: DataFrame, directives: DataFrame) -> DataFrame:
    """(child, path, sha256, size, lost, truncated): what each child of a split holds.

    ``directives`` (path, child, transform, length): copy, slice, filter, redact or drop.  A
    drop loses the bytes of the whole file; a slice that leaves some of it out is truncated.
    """
    joined = files.join(directives, "path")
    dropped, sliced = F.col("transform") == "drop", F.col("transform") == "slice"
    size = F.when(sliced, F.least("size", "length")).otherwise(F.col("size"))
    return joined.select("child", "path", F.when(~dropped, F.col("sha256")).alias("sha256"), F.when(~dropped, size).alias("size"), F.when(dropped, F.col("size")).otherwise(0).alias("lost"), (sliced & (F.col("size") > F.col("length"))).alias("truncated"))


def unaccounted(files: DataFrame, directives: DataFrame) -> DataFrame:
    """Paths that a split plan says nothing about."""
    return files.join(directives, "path", "left_anti").select("path")


def sealed(canonical: Column, salt: str = "") -> Column:
    """The commitment to a manifest's canonical text."""
    return F.sha2(F.concat(F.lit(salt), canonical, F.lit("\n")), 256)


def split_verdict(files: DataFrame, declared: DataFrame, plan: DataFrame) -> DataFrame:
    """(manifest, verdict): the first gate that each manifest's split plan fails, or ``passed``.

    ``files``: manifest, path, sha256; ``declared``: manifest, declared (its pack hash),
    children (how many); ``plan``: manifest, position, path, child, transform.  The gates in
    order: at least two children, the declared hash, every file in the plan, and then the
    first directive, by position, that names a child out of range or a path that is no
    file.  A manifest without files has the hash of none; directives of no manifest are ignored.
    """
    marked = files.select("manifest", "path", F.lit(1).alias("held"), F.lit(0).alias("told")).unionByName(
        plan.select("manifest", "path", F.lit(0).alias("held"), F.lit(1).alias("told"))
    )
    paths = marked.groupBy("manifest", "path").agg(F.max("held").alias("held"), F.max("told").alias("told"))
    silent = paths.groupBy("manifest").agg(F.bool_or((F.col("held") == 1) & (F.col("told") == 0)).alias("silent"))
    directives = plan.where("transform <> 'drop'").join(declared.select("manifest", "children"), "manifest").join(paths.select("manifest", "path", "held"), ["manifest", "path"])
    beyond = (F.col("child") < 0) | (F.col("child") >= F.col("children"))
    error = F.when(beyond, "child out of range").when(F.col("held") == 0, "unknown source")
    wrong = directives.select("manifest", "position", error.alias("error")).where("error IS NOT NULL").groupBy("manifest").agg(F.min_by("error", "position").alias("error"))
    hashes = pack_hash(files, "manifest").select("manifest", "pack_hash")
    none = F.sha2(F.lit(""), 256)
    verdict = (
        F.when(F.col("children") < 2, "fewer than two children").when(~F.coalesce("pack_hash", none).eqNullSafe(F.col("declared")), "integrity")
        .when(F.col("silent"), "silent split").otherwise(F.coalesce("error", F.lit("passed")))
    )
    return declared.join(hashes, "manifest", "left").join(silent, "manifest", "left").join(wrong, "manifest", "left").select("manifest", verdict.alias("verdict"))
