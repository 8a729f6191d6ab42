"""Embedding near-duplicates by NN-descent.

Equal vectors form a class first.  A neighbour graph over the classes starts from random
hyperplane cells, whose members are compared in bounded groups, and is refined by
joining neighbours of neighbours; there are as many tables of cells as the number of
hyperplanes asks for.  Edges at the threshold join components.  A list that is saturated, full of links, says nothing of
its further links.  Saturated members are therefore dealt into blocks with a centre and a
radius, blocks of different components that the angles do not rule out are compared,
and a link joins the components.  Then each saturated list is enlarged to its whole
component: members are compared block against block and only counts leave a block
pair, so every link is counted and no list of pairs is made.

Each round ends with an audit: the counted links of sampled vectors against brute force,
as the mean over the sampled vectors that have a link of the share that was found.  Below
``ENOUGH`` a further round adds tables of fresh hyperplanes; what is still below it after
the last round is reported as a warning with the recall.

All cosines are taken in double precision.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalith.llm.common import cut, stash
from stratalith.llm.components import components

NEIGHBOURS, TABLES, CELL, GROUP, BLOCK = 10, 16, 48, 256, 512
#: Further hyperplanes of a table, of which a large cell takes as many as it needs.
DEEP = 16
#: Chance that a pair at the threshold shares no cell.
APART = 0.001
AUDIT_QUERIES, ENOUGH, MOST_ROUNDS = 1024, 0.999, 4
AUDIT_SLICE = 2048
BROADCAST_ROWS = 1 << 18


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _to_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = [np.asarray(v, dtype=np.float64).tobytes() for v in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("size"), batch.column("dim"), pa.array(blobs, pa.binary())], names=["rep", "size", "dim", "vec"])


def _tables(bits: int, threshold: float) -> int:
    """Tables after which a pair at the threshold has met but for a chance of ``APART``."""
    same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return max(TABLES, math.ceil(math.log(APART) / math.log1p(-min(same, 0.999))))


def _celler(bits: int, tables: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, vecs, reps = batch.column("dim").to_numpy(), batch.column("vec").to_pylist(), batch.column("rep").to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = _unit([vecs[i] for i in at])
                planes = np.random.default_rng([int(dim), turn]).standard_normal((int(dim), tables * (bits + DEEP)))
                signs = (x @ planes > 0).reshape(len(at), tables, bits + DEEP)
                codes, deep = (part @ (1 << np.arange(part.shape[2])) for part in (signs[:, :, :bits], signs[:, :, bits:]))
                keys = (int(dim) * tables + np.arange(tables)) * (1 << bits) + codes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (keys.ravel(), deep.ravel(), np.repeat(reps[at], tables))] + [pa.array([vecs[i] for i in at for _ in range(tables)], pa.binary())],
                    names=["cell", "deep", "rep", "vec"],
                )

    return run


_EDGES = "rep long, near array<struct<s:double,id:long>>"


def _lists(reps: np.ndarray, x: np.ndarray, floor: np.ndarray | None = None):
    """Each member's nearest others of the group, above its floor."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(NEIGHBOURS, len(reps) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    for i in range(len(reps)):
        found = [(float(s[i, j]), int(reps[j])) for j in best[i] if (floor is None or s[i, j] > floor[i]) and reps[j] != reps[i]]
        if found:
            yield int(reps[i]), found


def _edge_table(rows: list) -> pa.Table:
    kind = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64())]))
    near = [[{"s": s, "id": i} for s, i in found] for _, found in rows]
    return pa.table([pa.array([r for r, _ in rows], pa.int64()), pa.array(near, kind)], names=["rep", "near"])


def _cell_neighbours(group: pa.Table) -> pa.Table:
    if group.num_rows < 2:
        return _edge_table([])
    return _edge_table(list(_lists(group.column("rep").to_numpy(), _unit(group.column("vec").to_pylist()))))


def _local_joins(group: pa.Table) -> pa.Table:
    """Neighbours of the same centre meet; only what improves a list is passed on."""
    centre = group.column("centre").to_numpy()
    order = np.argsort(centre, kind="stable")
    reps, floor, vecs = group.column("rep").to_numpy()[order], group.column("floor").to_numpy()[order], group.column("vec").to_pylist()
    edges = np.flatnonzero(np.diff(centre[order])) + 1
    rows = []
    for lo, hi in zip([0, *edges], [*edges, len(order)], strict=True):
        if hi - lo > 1:
            rows.extend(_lists(reps[lo:hi], _unit([vecs[i] for i in order[lo:hi]]), floor[lo:hi]))
    return _edge_table(rows)


def _merged(parts: DataFrame) -> DataFrame:
    """One list of the nearest for each member."""
    near = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("near"))), asc=False), 1, NEIGHBOURS)
    return parts.groupBy("rep").agg(near.alias("near"))


def _blocks_counter(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        side, reps, sizes = group.column("side").to_numpy(), group.column("rep").to_numpy(), group.column("size").to_numpy()
        x = _unit(group.column("vec").to_pylist())
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(b):  # a block against itself
            hit = x[a] @ x[a].T >= threshold
            np.fill_diagonal(hit, False)
            out = [(reps[a], hit @ sizes[a])]
        else:
            hit = x[a] @ x[b].T >= threshold
            out = [(reps[a], hit @ sizes[b]), (reps[b], hit.T @ sizes[a])]
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["rep", "linked"])

    return run


def _ball(group: pa.Table) -> pa.Table:
    """Centre and radius, an angle, of a block of saturated members."""
    x = _unit(group.column("vec").to_pylist())
    centre = x.sum(axis=0)
    length = np.linalg.norm(centre)
    centre = centre / length if length > 1e-9 else x[0]
    radius = float(np.arccos(np.clip(x @ centre, -1, 1).min()))
    fixed = [group.column(c).slice(0, 1).combine_chunks() for c in ("dim", "component", "block")]
    return pa.table([*fixed, pa.array([centre.tobytes()], pa.binary()), pa.array([radius])], names=["dim", "component", "block", "centre", "radius"])


def _ball_pairs(threshold: float):
    """Pairs of balls of different components that may hold a link, by the triangle inequality on angles."""
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6

    def run(group: pa.Table) -> pa.Table:
        side, part, block, radius = (group.column(c).to_numpy() for c in ("side", "component", "block", "radius"))
        x = np.frombuffer(b"".join(group.column("centre").to_pylist()), dtype=np.float64).reshape(group.num_rows, -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(b):  # a batch of balls against itself
            b = a
        near = np.arccos(np.clip(x[a] @ x[b].T, -1, 1)) <= radius[a][:, None] + radius[b][None, :] + reach
        i, j = np.nonzero(near & (part[a][:, None] != part[b][None, :]))
        i, j = a[i], b[j]
        i, j = np.where(part[i] < part[j], i, j), np.where(part[i] < part[j], j, i)
        return pa.table([pa.array(c, pa.int64()) for c in (part[i], block[i], part[j], block[j])], names=["ca", "ba", "cb", "bb"])

    return run


def _meeting(threshold: float):
    """The two components of a pair of blocks, if a link lies between the blocks."""

    def run(group: pa.Table) -> pa.Table:
        side, x = group.column("side").to_numpy(), _unit(group.column("vec").to_pylist())
        met = bool((x[side == 0] @ x[side == 1].T >= threshold).any())
        return group.select(["ca", "cb"]).slice(0, int(met))

    return run


def _across(joined: DataFrame, saturated: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(node, component) after every link between saturated members of different components."""
    held = joined.join(saturated.select(F.col("rep").alias("node")), "node", "left_semi")
    sized = held.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = held.join(sized, "component").select(F.col("node").alias("rep"), "component", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    members = cut(vectors.join(placed, "rep").select("component", "block", "dim", "vec"))
    balls = cut(members.groupBy("component", "block").applyInArrow(_ball, "dim long, component long, block long, centre binary, radius double"))
    n = balls.count()
    if n < 2:
        return joined
    batches = -(-n // BLOCK)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long")))
    dealt = balls.withColumn("own", F.pmod(F.xxhash64("component", "block"), F.lit(batches))).withColumn("other", other)
    met = dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": F.when(F.col("own") <= F.col("other"), 0).otherwise(1)}).drop("own", "other")
    pairs = cut(met.groupBy("dim", "lo", "hi").applyInArrow(_ball_pairs(threshold), "ca long, ba long, cb long, bb long").distinct())
    sides = (
        pairs.withColumn("ends", F.array(F.struct(F.lit(0).alias("side"), F.col("ca").alias("component"), F.col("ba").alias("block")), F.struct(F.lit(1).alias("side"), F.col("cb").alias("component"), F.col("bb").alias("block"))))
        .select("ca", "ba", "cb", "bb", F.inline("ends"))
    )
    faced = sides.join(members, ["component", "block"]).select("ca", "ba", "cb", "bb", "side", "vec")
    bridges = faced.groupBy("ca", "ba", "cb", "bb").applyInArrow(_meeting(threshold), "ca long, cb long")
    moved = components(bridges, "ca", "cb").toDF("component", "root")
    return cut(joined.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")))


def _auditor(queries: list[tuple[int, int, bytes]], threshold: float):
    """Links of each query, by brute force: (rep, linked) with one row a query and slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, AUDIT_SLICE):
                batch = whole.slice(start, AUDIT_SLICE)
                reps, sizes, dims, vecs = (batch.column(c).to_pylist() if c == "vec" else batch.column(c).to_numpy() for c in ("rep", "size", "dim", "vec"))
                for dim in np.unique(dims):
                    own = [q for q in queries if q[1] == dim]
                    at = np.flatnonzero(dims == dim)
                    if own:
                        ids = np.array([q[0] for q in own])
                        hit = (_unit([q[2] for q in own]) @ _unit([vecs[i] for i in at]).T >= threshold) & (ids[:, None] != reps[at][None, :])
                        linked = hit @ sizes[at]
                        some = np.flatnonzero(linked)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(linked[some], pa.int64())], names=["rep", "linked"])

    return run


def _seeded(vectors: DataFrame, bits: int, tables: int, turn: int) -> DataFrame:
    """Lists from the cells of random hyperplanes; a large cell is split by more of them, and dealt at random only where they do not part it."""
    cells = vectors.mapInArrow(_celler(bits, tables, turn), "cell long, deep long, rep long, vec binary")
    extra = F.least(F.ceil(F.log2(F.col("c") / GROUP)) + 1, F.lit(DEEP)).cast("int")
    large = cut(cells.groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > GROUP).select("cell", extra.alias("extra")))
    split = cells.join(_small(large), "cell", "left").withColumn("deep", F.when(F.col("extra").isNotNull(), F.expr("pmod(deep, shiftleft(1L, extra))")).otherwise(F.lit(-1).cast("long")))
    left = cut(split.where("extra IS NOT NULL").groupBy("cell", "deep").agg(F.count("*").alias("c")).where(F.col("c") > GROUP))
    salt = F.coalesce(F.pmod(F.xxhash64("rep", "cell"), F.ceil(F.col("c") / GROUP)), F.lit(0))
    dealt = split.join(_small(left), ["cell", "deep"], "left").withColumn("salt", salt).select("cell", "deep", "salt", "rep", "vec")
    return dealt.groupBy("cell", "deep", "salt").applyInArrow(_cell_neighbours, _EDGES)


def _small(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _counted(graph: DataFrame, vectors: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, component) of what has a link, and (rep, linked): the rows each vector is linked with."""
    links = cut(
        graph.select("rep", F.explode("near").alias("e")).where(F.col("e.s") >= threshold)
        .select(F.least("rep", "e.id").alias("a"), F.greatest("rep", "e.id").alias("b")).distinct()
    )
    saturated = graph.where((F.size("near") >= NEIGHBOURS) & (F.element_at("near", -1)["s"] >= threshold)).select("rep")
    joined = _across(cut(components(links, "a", "b")), saturated, vectors, threshold)
    full = joined.join(saturated, joined["node"] == saturated["rep"], "left_semi").select("component").distinct()
    sized = joined.join(full, "component", "left_semi").groupBy("component").agg(F.count("*").alias("members"))
    enlarged = cut(joined.join(sized, "component").select(F.col("node").alias("rep"), "component", F.ceil(F.col("members") / BLOCK).alias("blocks")))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    placed = vectors.join(enlarged, "rep").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = placed.select(
        "component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "rep", "size", "vec"
    )
    dense = paired.groupBy("component", "lo", "hi").applyInArrow(_blocks_counter(threshold), "rep long, linked long")
    both = links.union(links.select("b", "a")).toDF("rep", "other")
    sparse = (
        both.join(enlarged.select("rep"), "rep", "left_anti").join(vectors.select(F.col("rep").alias("other"), "size"), "other")
        .select("rep", F.col("size").alias("linked"))
    )
    return joined, cut(dense.union(sparse).groupBy("rep").agg(F.sum("linked").alias("linked")))


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing; so do rows with a null id, and vectors of different length.  Rows that repeat
    an id are vectors of their own.  Other columns are ignored; no rows give no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(
        F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0),
        F.lit(False),
    )
    keyed = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), fine.alias("fine")).withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64("v", F.lit(1))})
    rows = keyed.where("fine").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v"))
    # a stored number stands for a class from here on, since ids may repeat
    rows, _ = stash(rows.withColumn("rep", F.monotonically_increasing_id()))
    classes = rows.select("k1", "k2", "rep", "size", "least")
    vectors, _ = stash(rows.select("rep", "size", F.size("v").cast("long").alias("dim"), "v").mapInArrow(_to_binary, "rep long, size long, dim long, vec binary"))
    n = vectors.count()
    bits = max(1, int(np.ceil(np.log2(max(2, n / CELL)))))
    tables = _tables(bits, threshold)
    queries = [tuple(r) for r in vectors.orderBy(F.xxhash64("rep"), "rep").limit(AUDIT_QUERIES).select("rep", "dim", "vec").collect()]
    true = cut(vectors.mapInArrow(_auditor(queries, threshold), "rep long, linked long").groupBy("rep").agg(F.sum("linked").alias("true")))
    graph = None
    for turn in range(MOST_ROUNDS):
        seeds = _seeded(vectors, bits, tables, turn)
        graph = cut(_descended(cut(_merged(seeds if graph is None else graph.union(seeds))), vectors, n))
        joined, counted = _counted(graph, vectors, threshold)
        recall = _recall(true, counted)
        if recall >= ENOUGH:
            break
    else:
        warnings.warn(f"near_vectors: audited recall of links is {recall:.4f}, below {ENOUGH}", RuntimeWarning, stacklevel=2)
    found = (
        classes.join(counted, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", "least", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    roots = found.groupBy("component").agg(F.min("least").alias("component_id"))
    found = found.join(roots, "component").select("k1", "k2", "n_links", "component_id")
    out = keyed.select("vec_id", "fine", "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.when(F.col("fine"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id", F.when(F.col("fine"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _recall(true: DataFrame, counted: DataFrame) -> float:
    """Mean share of its links found, over the audited vectors that have one; a hot group counts by vector, not by link."""
    share = F.least(F.coalesce("linked", F.lit(0)) / F.col("true"), F.lit(1.0))
    return true.join(counted, "rep", "left").agg(F.coalesce(F.avg(share), F.lit(1.0))).first()[0]


def _descended(graph: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """One round: lists and reversed lists meet at their centres, and improvements merge in."""
    out = graph.select(F.col("rep").alias("centre"), F.explode("near.id").alias("rep"))
    back = out.select(F.col("rep").alias("centre"), F.col("centre").alias("rep"))
    # a centre that very many point to gathers a sample of them, drawn by hash before the shuffle's rows meet
    popular = back.groupBy("centre").agg(F.count("*").alias("c"))
    kept = back.join(popular, "centre").where(F.pmod(F.xxhash64("centre", "rep"), F.col("c")) < 2 * NEIGHBOURS).select("centre", "rep")
    floor = graph.select("rep", F.when(F.size("near") >= NEIGHBOURS, F.element_at("near", -1)["s"]).otherwise(F.lit(-2.0)).alias("floor"))
    members = out.union(kept).distinct().join(vectors.select("rep", "vec").join(floor, "rep"), "rep")
    groups = max(1, n // GROUP)
    better = members.withColumn("g", F.pmod(F.xxhash64("centre"), F.lit(groups))).groupBy("g").applyInArrow(_local_joins, _EDGES)
    return _merged(graph.select("rep", "near").union(better))
