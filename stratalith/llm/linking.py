"""From banded signatures to components: candidate search that stays linear in a group.

Members of a band are first compared with its most central member, the pivot, and a band
whose members it all joins is done.  What it leaves apart in a small band is compared one
by one with the others.  Union-find joins what is confirmed.

In a crowded band that would be the square of the group, so there the group's core p, what
more than half of it has, is subtracted.  A member x lacks A = p - x and adds E = x - p, and
with sizes a, e exactly

    |x & y| = |p| - |A_x | A_y| + |E_x & E_y|,

so with V = 100 a + P e a pair is linked at P percent if and only if (100 + P) (|A_x & A_y| +
|E_x & E_y|) is at least S = V_x + V_y - (100 - P) |p|.  All members are compared with the hub, the one of
least V.  Whoever has S <= 0 with the hub is linked to it; any other member has S > 0 with
every partner and shares an element of the differences with it.  Those are what a group
does *not* have in common, and an equi-join on them, on the rarest that the bounds call for
and under a bound on the whole overlap by bitmaps and then the overlap itself, finds every
link and makes no row for the pairs that only share the core.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalith.llm.common import cut, stash
from stratalith.llm.components import components

#: Members of a band up to which those in different components are compared one by one.
CROWD = 16
#: A table of so many ids at most (32 MB) is broadcast; a longer one is shuffled.
BROADCAST_IDS = 1 << 21


def only_ids(rows: DataFrame, column: str, ids: DataFrame, n: int) -> DataFrame:
    """Rows whose ``column`` is among the n distinct ``ids`` (one column), without a shuffle of the rows where that is safe."""
    ids = ids.toDF("__id")
    return rows.join(small(ids, n), rows[column] == F.col("__id"), "left_semi")


def small(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, broadcast if its n rows are few."""
    return F.broadcast(rows) if n <= BROADCAST_IDS else rows


def shared_spots(signed: DataFrame) -> DataFrame:
    """(rep, key, members) of the band keys that unlike members share; ``signed`` has (rep, bands), rows of a rep being alike; its copies count as members."""
    each = signed.select("rep", F.explode("bands").alias("key"))
    counted = each.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    keys, _ = stash(counted.where("lo < hi").select("key", "members"))
    return stash(each.join(small(keys, keys.count()), "key").select("rep", "key", "members").distinct())[0]


def confirmed(pairs: DataFrame, members: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a of ``members`` and b of ``others``, whose full sets have a Jaccard similarity of at least percent / 100."""
    left = members.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = others.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    return (
        left.join(small(pairs, pairs.count()), "a").join(right, "b")
        .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), common.alias("c"))
        .where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c")))
        .select("a", "b")
    )


def _led(spots: DataFrame) -> DataFrame:
    """(key, pivot): the member whose bands hold most members."""
    central = cut(spots.groupBy("rep").agg(F.sum("members").alias("weight")))
    weighed = spots.join(small(central, central.count()), "rep")
    order = F.shiftleft(F.least("weight", F.lit(2**31 - 1)), 32).bitwiseOR(F.xxhash64("rep").bitwiseAND(F.lit(2**32 - 1)))
    return weighed.groupBy("key").agg(F.max_by("rep", order).alias("pivot"))


def _torn(led: DataFrame, links: DataFrame) -> DataFrame:
    """(key, pivot, rep, members, c) of the bands that hold a member which their pivot does not join; c is the pivot where it does."""
    n = links.count()
    joined = small(links.select(F.col("a").alias("rep"), F.col("b").alias("pivot"), F.lit(True).alias("linked")), n)
    held = led.join(joined, ["rep", "pivot"], "left").withColumn("c", F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("rep"))).drop("linked")
    keys = cut(held.where((F.col("c") != F.col("pivot")) & (F.col("members") > 2)).select("key").distinct())
    return stash(held.join(small(keys, keys.count()), "key", "left_semi"))[0]


def _one_by_one(torn: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs of small bands that do not both hang on the pivot."""
    sized = torn.where(F.col("members") <= CROWD).join(sizes, "rep").select("key", "rep", "c", "n")
    x, y = (sized.select("key", *(F.col(c).alias(c + side) for c in ("rep", "c", "n"))) for side in "xy")
    alike = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent
    return x.join(y, "key").where((F.col("repx") < F.col("repy")) & (F.col("cx") != F.col("cy")) & alike).select(F.col("repx").alias("a"), F.col("repy").alias("b"))


def _differences(torn: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, rep, np, lacks, adds, a, e, v) of the members of crowded bands against the core of their pivot's group."""
    crowded = torn.where(F.col("members") > CROWD)
    members = cut(crowded.select("pivot", "rep").union(crowded.select("pivot", "pivot")).distinct())
    mine, its = sets.select(F.col("id").alias("rep"), F.col("set").alias("s")), sets.select(F.col("id").alias("pivot"), F.col("set").alias("p"))
    apart, _ = stash(
        mine.join(small(members, members.count()), "rep").join(its, "pivot")
        .select("pivot", "rep", F.size("p").cast("long").alias("np"), F.array_except("p", "s").alias("lacks"), F.array_except("s", "p").alias("adds"))
    )
    sized = cut(apart.groupBy("pivot").agg(F.count("*").alias("group")))
    told = apart.select("pivot", F.explode(F.concat(F.transform("lacks", lambda x: F.struct(x.alias("x"), F.lit(True).alias("lacked"))), F.transform("adds", lambda x: F.struct(x.alias("x"), F.lit(False).alias("lacked"))))).alias("d"))
    often = told.groupBy("pivot", "d.x", "d.lacked").agg(F.count("*").alias("df")).join(small(sized, sized.count()), "pivot").where(F.col("df") * 2 > F.col("group"))
    # at most twice as many as the mean difference has
    listed = lambda lacked: F.coalesce(F.collect_list(F.when(F.col("lacked") == lacked, F.col("x"))), F.array().cast("array<bigint>"))
    core = cut(often.groupBy("pivot").agg(listed(True).alias("not_core"), listed(False).alias("more_core")))
    none = F.array().cast("array<bigint>")
    moved = apart.join(small(core, core.count()), "pivot", "left").withColumns({"not_core": F.coalesce("not_core", none), "more_core": F.coalesce("more_core", none)})
    lacks = F.concat(F.array_except("lacks", "not_core"), F.array_except("more_core", "adds"))
    adds = F.concat(F.array_except("adds", "more_core"), F.array_except("not_core", "lacks"))
    moved = moved.select("pivot", "rep", (F.col("np") + F.size("more_core") - F.size("not_core")).alias("np"), lacks.alias("lacks"), adds.alias("adds"))
    return moved.withColumns({"a": F.size("lacks").cast("long"), "e": F.size("adds").cast("long")})


def _bits(values: Column) -> Column:
    """Four words of a bitmap of the values."""
    word = lambda j: F.aggregate(
        values, F.lit(0).cast("long"), lambda s, x: F.when(F.shiftright(x, 6).bitwiseAND(F.lit(3)) == j, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int")))).otherwise(s)
    )
    return F.array(*(word(j) for j in range(4)))


def _overlap_bound(bits: str, size: str) -> Column:
    """At least the number of values that x and y have in common, by their bitmaps and sizes."""
    x, y = F.col(bits + "x"), F.col(bits + "y")
    ones = lambda b: sum((F.bit_count(b[j]) for j in range(1, 4)), F.bit_count(b[0]))
    both = sum((F.bit_count(x[j].bitwiseAND(y[j])) for j in range(1, 4)), F.bit_count(x[0].bitwiseAND(y[0])))
    return both + F.least(F.col(size + "x") - ones(x), F.col(size + "y") - ones(y))


def _short(values: Column) -> Column:
    """The distinct 32-bit hashes of the values."""
    return F.array_distinct(F.transform(values, lambda x: F.hash(x)))


def _short_overlap(column: str, size: str) -> Column:
    """At least the number of values that x and y have in common, by their short hashes: as many as fell together in x may be missing from the common ones."""
    x, y = F.col(column + "x"), F.col(column + "y")
    return F.size(F.array_intersect(x, y)) + F.col(size + "x") - F.size(x)


def _by_differences(torn: DataFrame, apart: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs of crowded bands that the differences from the core do not rule out."""
    members = torn.where(F.col("members") > CROWD).select("pivot", "rep", "c").distinct()
    a, e, v, spare, vm, both = F.col("a"), F.col("e"), F.col("v"), (100 - percent) * F.col("np"), F.col("vm"), 100 + percent
    sized, _ = stash(
        apart.join(members, ["pivot", "rep"]).join(small(hubs, hubs.count()), "pivot").withColumn("far", v + vm > spare)
        .withColumns({"la": _bits(F.col("lacks")), "ad": _bits(F.col("adds"))})
    )
    q = F.col("np") - a
    up = lambda x, by: F.ceil(x / by).cast("long")
    # of its added elements a member shares so many with any partner; of the lacked ones, if it shares no added one, so many
    least_added = F.greatest(F.lit(1), up(percent * e - (100 - percent) * q, 100))
    least_lacked = F.when(F.col("far"), F.greatest(F.lit(1), up(v - spare, percent), up(v + vm - spare, both))).otherwise(F.floor((v - vm) / both) + 1)
    kept = ["rep", "c", "a", "e", "v", "far", "la", "ad", "lacks", "adds"]
    whole = sized.withColumns({"lacks": _short(F.col("lacks")), "adds": _short(F.col("adds"))}).select("pivot", "np", *kept)
    found = None
    for column, size, least, use in (("adds", e, least_added, F.lit(True)), ("lacks", a, least_lacked, percent * e <= (100 - percent) * q)):
        # the differences themselves only travel with the elements that are looked up
        rows = sized.where(use & (size >= least)).select("pivot", "rep", "far", (size - least + 1).alias("reach"), size.alias("size"), F.explode(column).alias("x"))
        often = rows.groupBy("pivot", "x").agg(F.count("*").alias("df"), F.max("far").alias("some_far")).where("df > 1 AND some_far").select("pivot", "x", "df")
        own = Window.partitionBy("pivot", "rep")
        # elements that no other member has come first in the order of rarity and meet nothing
        ranked = rows.join(often, ["pivot", "x"]).withColumns({"rank": F.row_number().over(own.orderBy("df", "x")), "met": F.count("*").over(own)})
        taken, _ = stash(ranked.where(F.col("rank") <= F.col("reach") - (F.col("size") - F.col("met"))).select("pivot", "x", "rep").join(whole, ["pivot", "rep"]))
        x, y = (taken.select("pivot", "x", "np", *(F.col(c).alias(c + side) for c in kept)) for side in "xy")
        need = F.col("vx") + F.col("vy") - (100 - percent) * F.col("np")
        bound = _overlap_bound("la", "a") + _overlap_bound("ad", "e")
        overlap = _short_overlap("lacks", "a") + _short_overlap("adds", "e")
        pairs = (
            x.where("farx").join(y.drop("np"), ["pivot", "x"])
            .where((F.col("cx") != F.col("cy")) & (~F.col("fary") | (F.col("repx") < F.col("repy"))) & (need <= both * bound) & (need <= both * overlap))
            .select(F.least("repx", "repy").alias("a"), F.greatest("repx", "repy").alias("b"))
        )
        found = pairs if found is None else found.union(pairs)
    return found


def linked(spots: DataFrame, fetch: Callable[[DataFrame, int], DataFrame], percent: int) -> DataFrame:
    """(node, component) of the members that have a link.

    ``spots`` has (rep, key, members): a member, a band key that it shares, and how many
    have it.  ``fetch`` gives (id, set) of the ids it is handed along with their number.
    """
    def got(ids: DataFrame) -> DataFrame:
        ids = cut(ids.toDF("id").distinct())
        return fetch(ids, ids.count())

    pivots = cut(_led(spots))
    led = spots.join(small(pivots, pivots.count()), "key")
    pairs = cut(led.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
    links = cut(confirmed(pairs, got(pairs.select("a")), got(pairs.select("b")), percent))
    torn = _torn(led, links)
    sets, _ = stash(got(torn.select("rep").union(torn.select("pivot"))))
    sizes = sets.select(F.col("id").alias("rep"), F.size("set").cast("long").alias("n"))
    across = _one_by_one(torn, sizes, percent)
    apart, _ = stash(_differences(torn, sets).withColumn("v", 100 * F.col("a") + percent * F.col("e")))
    hubs = cut(apart.groupBy("pivot").agg(F.min("v").alias("vm"), F.max_by("rep", F.struct(-F.col("v"), -F.col("rep"))).alias("hub")))
    if not hubs.isEmpty():
        to_hub = apart.join(small(hubs, hubs.count()), "pivot").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
        across = across.union(to_hub).union(_by_differences(torn, apart, hubs, percent))
    more = confirmed(cut(across.distinct()), sets, sets, percent)
    return components(links.union(more), "a", "b")
