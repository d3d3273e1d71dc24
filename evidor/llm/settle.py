"""Candidate pairs in groups of any size, without forming all pairs of a group.

Groups (bands of lines, trie nodes of documents) hold ids that may be similar. All members are compared with two of
them; where links leave several components, the pairs of different components are settled: formed in full in small groups,
or sieved by sketches while they are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, maybe_in, stored

#: Members of a group whose open pairs are formed in full; parts into which the rows of one id are dealt.
SMALL, SALTS = 64, 16
#: Ids of a group's largest component with which the others are compared in a round.
PICKS = 4
#: Longs of a sketch; ids of a group to a salt, and the most salts of a group.
WORDS, BLOCK, MOST_SALTS = 16, 128, 64


def shared_groups(keyed: DataFrame) -> DataFrame:
    """(key, id, m, lo, hi): the rows (key, id) of keys that hold several, with their number and two ids. Written once.

    In groups of more than three, lo is the id that shares its keys with most others: that of which others are edited
    copies, if there is one. Most keys occur once; they are sieved out before the join.
    """
    repeated = cut(keyed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    rows = stored(maybe_in(keyed, "key", repeated.select("key")).where("_maybe").select("key", "id").join(repeated, "key"), "groups")
    ends = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    large = rows.where("m > 3").select("key", "id", "m")
    score = large.groupBy("id").agg(F.sum("m").alias("score"))
    rank = F.col("score") * (1 << 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    middle = large.join(score, "id").groupBy("key").agg(F.max_by("id", rank).alias("middle"))
    ends = cut(ends.join(middle, "key", "left").select("key", F.coalesce("middle", "lo").alias("lo"), "hi"))
    out = stored(rows.join(ends, "key").select("key", "id", "m", "lo", "hi"), "groups")
    discard(rows)
    return out


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b), a < b: every id of a group with the group's smallest and largest."""
    ends = F.explode(F.array(*(F.struct(F.least("id", e).alias("a"), F.greatest("id", e).alias("b")) for e in ("lo", "hi"))))
    return shared.select(ends.alias("p")).select("p.a", "p.b").where("a < b").distinct()


def still_open(shared: DataFrame, roots: DataFrame | None, least: int = 2) -> DataFrame:
    """The rows of groups of ``least`` ids or more that are not all of one component, with their component as root. Written once."""
    rows = shared.where(F.col("m") >= least)
    rows = rows.withColumn("root", F.col("id")) if roots is None else rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    several = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    return cut(rows.join(several, "key", "left_semi").select("key", "id", "m", "lo", "hi", "root"))


def picked_pairs(rows: DataFrame, turn: int = 0, picks: int = PICKS, least: int = SMALL) -> DataFrame:
    """(a, b), a < b: in groups with many ids outside their largest component, each of those with ``picks`` ids of that.

    Others are picked in each turn. One link is enough to join that component, so that of many copies with small changes few are left to be settled pair
    by pair; the pairs grow with the rows and not with the square of a group.
    """
    order = [F.xxhash64(F.lit(turn * picks + k), "id") for k in range(picks)]
    each = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.array(*(F.min_by("id", by) for by in order)).alias("ids"))
    group = each.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root", "ids")).alias("main")).where(F.col("n") - F.col("main.c") >= least).select("key", "main")
    strays = rows.join(group, "key").where("root <> main.root").select("id", F.explode(F.array_distinct("main.ids")).alias("pick"))
    return strays.select(F.least("id", "pick").alias("a"), F.greatest("id", "pick").alias("b")).distinct()


def small_pairs(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b), a < b: ids of different components in groups of up to ``small``, but for those met by ``star_pairs``."""
    few = rows.where((F.col("m") <= small) & (F.col("id") != F.col("lo")) & (F.col("id") != F.col("hi"))).select("key", "id", "root")
    return few.alias("l").join(few.alias("r"), "key").where("l.id < r.id AND l.root <> r.root").select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def crossing_pairs(rows: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: all pairs of one group and different components whose sets can have a similarity of ``threshold``. Written once.

    ``sketches`` (id, n, w) holds the size of each id's set and, in the bits of an array of longs, the parity of its tokens
    by their hash. An element that only one of two sets has flips one bit, so that they differ in as many elements as bits at
    least: no pair that is similar is left out. The ids of a group's largest component are met by the others only, which are
    dealt to salts in large groups.
    """
    each = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    strays = F.sum("c") - F.max("c")
    salts = F.least(F.ceil(strays / BLOCK), F.lit(MOST_SALTS)).cast("int").alias("salts")
    group = each.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), salts)
    keys = rows.groupBy("id").agg(F.collect_set("key").alias("keys"))
    held = stored(rows.select("key", "id", "root").join(group, "key").join(sketches.join(keys, "id"), "id"), "held")
    left = held.where("root <> main").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    right = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    most = (F.col("l.n") + F.col("r.n")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    bits = sum((F.bit_count(F.get("l.w", F.lit(k)).bitwiseXOR(F.get("r.w", F.lit(k)))) for k in range(WORDS)), F.lit(0))
    once = (F.col("r.root") == F.col("r.main")) | (F.col("l.id") < F.col("r.id"))
    near = (F.col("l.root") != F.col("r.root")) & once & (F.abs(F.col("l.n") - F.col("r.n")) <= most) & (bits <= most)
    # of the groups that hold both, only the one with the smallest key makes the pair
    near &= F.array_min(F.array_intersect("l.keys", "r.keys")) == F.col("l.key")
    met = left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt")) & near)
    out = cut(met.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")))
    discard(held)
    return out


def parities(sets: DataFrame) -> DataFrame:
    """(id, n, w) of (id, x), one row for each of an id's distinct hashes x: their number, and the parity of those at each of 64 * WORDS bits."""
    words = sets.groupBy("id", F.pmod("x", F.lit(WORDS)).alias("k")).agg(F.count("*").alias("n"), F.expr("bit_xor(shiftleft(1L, cast(shiftrightunsigned(x, 58) as int)))").alias("w"))
    every = words.groupBy("id").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("w"))
    return every.select("id", "n", F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda k: F.coalesce(F.col("w")[k.cast("bigint")], F.lit(0).cast("bigint"))).alias("w"))


def dealt(*columns: str) -> Column:
    """The salt of a row, by a hash of ``columns``."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def at_every_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
