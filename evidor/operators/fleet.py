"""Placement and balance of sessions over nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spread import tasks


def candidates(nodes: DataFrame, memory: int, disk: int, regions: tuple[int, ...] = ()) -> DataFrame:
    """Nodes that are alive, have room, and stand in an allowed region (no regions: any)."""
    out = nodes.where(F.col("alive") & (F.col("memory") >= memory) & (F.col("disk") >= disk))
    return out.where(F.col("region").isin(*regions)) if regions else out


def ranked(nodes: DataFrame, home: int) -> DataFrame:
    """(node_id, place): home region first, then light load, much memory, much disk, small id."""
    return nodes.select("node_id", "zone", F.rank().over(Window.partitionBy("region").orderBy("load", F.desc("memory"), F.desc("disk"), "node_id")).alias("place"), (F.col("region") != home).alias("away"))


def propose(nodes: DataFrame, home: int, tolerate: int, memory: int = 0, disk: int = 0) -> DataFrame:
    """(seat, node_id, zone): 2 f + 1 nodes, one of each zone at most, best first; the first f + 1 also hold copies."""
    order = [F.col("region") != home, "load", F.desc("memory"), F.desc("disk"), "node_id"]
    best = candidates(nodes, memory, disk).withColumn("_r", F.row_number().over(Window.partitionBy("zone").orderBy(*order))).where("_r = 1")
    seats = best.orderBy(*order).limit(2 * tolerate + 1)
    return seats.withColumn("seat", F.row_number().over(Window.orderBy(*order))).select("seat", "node_id", "zone", (F.col("seat") <= tolerate + 1).alias("copies"))


def occupancy(members: DataFrame, domain: str = "zone") -> DataFrame:
    return members.groupBy(domain).agg(F.count("*").alias("members"))


def survives(members: DataFrame, losses: int, domain: str = "zone") -> DataFrame:
    """(voters, lost, ok): whether a majority is left after the ``losses`` fullest domains are gone."""
    worst = occupancy(members, domain).orderBy(F.desc("members"), domain).limit(losses).agg(F.coalesce(F.sum("members"), F.lit(0)).alias("lost"))
    total = members.agg(F.count("*").alias("voters"))
    return total.join(F.broadcast(worst)).select("voters", "lost", (F.col("voters") - F.col("lost") >= F.floor(F.col("voters") / 2) + 1).alias("ok"))


def heal(nodes: DataFrame, members: DataFrame, home: int, size: int) -> DataFrame:
    """(node_id, kept): voters that can keep their seat (alive, one a zone), and the best nodes of other zones for the rest."""
    order = [F.col("region") != home, "load", "node_id"]
    seats = nodes.join(members.select("node_id"), "node_id", "left_semi").where("alive").withColumn("_r", F.row_number().over(Window.partitionBy("zone").orderBy(*order))).where("_r = 1")
    free = nodes.where("alive").join(seats.select("zone"), "zone", "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy("zone").orderBy(*order))).where("_r = 1")
    need = seats.count()
    return seats.select("node_id", F.lit(True).alias("kept")).union(free.orderBy(*order).limit(max(0, size - need)).select("node_id", F.lit(False)))


def leader_counts(sessions: DataFrame) -> DataFrame:
    """(leader, led): sessions by leader, the pending one where there is one."""
    return sessions.groupBy(F.coalesce("pending", "active").alias("leader")).agg(F.count("*").alias("led"))


def leader_moves(sessions: DataFrame, voters: DataFrame) -> DataFrame:
    """(session, to): the least led other voter (session, node), where it leads at least two sessions fewer than the present leader."""
    led = leader_counts(sessions)
    now = sessions.select("session", F.coalesce("pending", "active").alias("leader")).join(led, "leader")
    other = voters.join(led.select(F.col("leader").alias("node"), F.col("led").alias("node_led")), "node", "left").fillna(0, ["node_led"])
    rows = now.join(other, "session").where((F.col("node") != F.col("leader")) & (F.col("node_led") + 2 <= F.col("led")))
    return rows.groupBy("session").agg(F.min_by("node", F.struct("node_led", "node")).alias("to"))


def range_faults(ranges: DataFrame) -> DataFrame:
    """(start): ranges whose end is not the start of another one; the last range, with the largest end, is right."""
    last = ranges.agg(F.max("end").alias("last"))
    loose = ranges.join(ranges.select(F.col("start").alias("end")), "end", "left_anti")
    return loose.join(F.broadcast(last)).where(F.col("end") != F.col("last")).select("start")


def balance(loads: DataFrame, above: int, below: int, most: int, streak: int = 3) -> DataFrame:
    """(group, action, range): at most one change of each group of ranges, from the newest ``streak`` loads of each range.

    The first range whose loads are all above the bound is split while the group has fewer than ``most``; else the first
    of two neighbours whose loads are all below is merged with the next.
    """
    newest = loads.withColumn("_r", F.row_number().over(Window.partitionBy("group", "range").orderBy(F.desc("at")))).where(F.col("_r") <= streak)
    full = F.count("*") == streak
    rows = newest.groupBy("group", "range").agg((full & (F.min("load") > above)).alias("over"), (full & (F.max("load") < below)).alias("under"))
    rows = rows.withColumn("pair", F.col("under") & F.coalesce(F.lead("under").over(Window.partitionBy("group").orderBy("range")), F.lit(False)))
    first = rows.groupBy("group").agg(F.min(F.when(F.col("over"), F.col("range"))).alias("split"), F.min(F.when(F.col("pair"), F.col("range"))).alias("merge"), F.count("*").alias("n"))
    splits = F.col("split").isNotNull() & (F.col("n") < most)
    return first.where(splits | F.col("merge").isNotNull()).select("group", F.when(splits, "split").otherwise("merge").alias("action"), F.when(splits, F.col("split")).otherwise(F.col("merge")).alias("range"))


def suspicion_deadline(suspects: DataFrame, most: float, least: float, expected: int) -> DataFrame:
    """(node, deadline): start + max - (max - min) ln(C + 1) / ln(K + 1) for C distinct confirmers, not below the minimum."""
    c = F.count_distinct(F.when(F.col("by") != F.col("origin"), F.col("by")))
    left = F.lit(most) - F.lit(most - least) * F.log(c + 1.0) / F.log(F.lit(expected + 1.0))
    return suspects.groupBy("node").agg(F.round(F.min("start") + F.greatest(left, F.lit(least)), 6).alias("deadline"))


def choose(sessions: DataFrame, led: DataFrame) -> DataFrame:
    """(session, leader): the other node where it leads two sessions fewer than the current one, else the current one."""
    a = led.select(F.col("node").alias("current"), F.col("led").alias("mine"))
    b = led.select(F.col("node").alias("other"), F.col("led").alias("best"))
    return sessions.join(a, "current").join(b, "other").select("session", F.when(F.col("best") + 2 <= F.col("mine"), F.col("other")).otherwise(F.col("current")).alias("leader"))


def home_move(nodes: DataFrame, voters: DataFrame, home: int) -> DataFrame:
    """(leaves, enters): the most loaded voter away from home, and the best home node in a zone that no other voter uses."""
    worst = voters.where(F.col("region") != home).orderBy(F.desc("load"), "node_id").limit(1)
    used = voters.join(worst.select("node_id"), "node_id", "left_anti").select("zone")
    best = nodes.where(F.col("alive") & (F.col("region") == home)).join(used, "zone", "left_anti").orderBy("load", "node_id").limit(1)
    return worst.select(F.col("node_id").alias("leaves")).join(F.broadcast(best.select(F.col("node_id").alias("enters"))))


def hold_left(dead: DataFrame, hold: int) -> DataFrame:
    """(hold): the longest time that is left of the hold of any dead member, not below 0."""
    return dead.agg(F.max(F.greatest(F.lit(0), hold - F.col("since"))).alias("hold"))


def guarantee(members: DataFrame, copies: str) -> DataFrame:
    """(region, tolerated): failures that both a quorum of the voters and the copies survive."""
    n, c = F.count("*"), F.count_if(F.expr(copies))
    voters = F.floor((n - 1) / 2).cast("double")
    return members.groupBy("region").agg(F.when(c > 0, F.least(voters, (c - 1).cast("double"))).otherwise(voters).alias("tolerated"))


def cached_routes(routes: DataFrame, broken: DataFrame, epoch: int) -> DataFrame:
    """(node_id, route): all routes of a partition (zone) with a revision gap are dropped, of others those of older epochs."""
    gaps = broken.withColumn("_gap", F.lit(True))
    return routes.join(gaps, "zone", "left").select("node_id", F.when(F.col("_gap"), "dropped").when(F.col("epoch") < epoch, "older").otherwise("kept").alias("route"))


def merge_ranges(ranges: DataFrame, lo: int, hi: int) -> DataFrame:
    """The map with the ranges of [lo, hi) as one of the next generation."""
    inside = (F.col("start") >= lo) & (F.col("end") <= hi)
    one = ranges.where(inside).agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("generation") + 1).alias("generation"))
    return ranges.where(~inside).unionByName(one)


def distance(a: list, b: list, height_a, height_b):
    """Network distance of two coordinates: Euclidean, plus both heights above the plane."""
    square = F.lit(0.0)
    for x, y in zip(a, b, strict=True):
        square = square + (x - y) * (x - y)
    return F.sqrt(square) + height_a + height_b


def distances(nodes: DataFrame, block: int = 1024) -> DataFrame:
    """(one, two, distance): every two nodes of a zone, by load and memory with disk as height.

    The nodes of a zone are dealt to blocks of about ``block``, and each two blocks are one key of the join, so that the
    pairs of one zone spread over many tasks.
    """
    zones = nodes.where("zone IS NOT NULL").groupBy("zone").agg(F.count("*").alias("n"))
    most, pairs = zones.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0))).first()
    blocks = max(1, -(-most // block))
    n = tasks(nodes, pairs // 8)
    rows = nodes.select("node_id", "zone", "load", "memory", "disk").withColumn("_own", F.pmod(F.xxhash64("node_id"), F.lit(blocks)))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    a = rows.withColumnRenamed("_own", "_p").withColumn("_q", every).repartition(n, "zone", "_p", "_q").alias("a")
    b = rows.withColumnRenamed("_own", "_q").withColumn("_p", every).repartition(n, "zone", "_p", "_q").alias("b")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("zone", "_p", "_q")] + [F.col("a.node_id") < F.col("b.node_id")])
    apart = distance([F.col("a.load"), F.col("a.memory")], [F.col("b.load"), F.col("b.memory")], F.col("a.disk"), F.col("b.disk"))
    return met.select(F.col("a.node_id").alias("one"), F.col("b.node_id").alias("two"), F.round(apart, 6).alias("distance"))


def phase_rank(phase):
    """0 to 7 along the assignment ladder; a failed assignment has no rank, so it is at least nothing."""
    # The ladder's order.
    ladder = ("Planned", "Offered", "Accepted", "Seeding", "CatchingUp", "Voting", "Leading", "Serving")
    out = F.lit(None).cast("int")
    for rank, name in enumerate(ladder):
        out = F.when(phase == name, rank).otherwise(out)
    return out


def grants(requests: DataFrame, base: int, most: int, gap: int, overload: int) -> DataFrame:
    """(worker, granted, extension): extensions asked for in order; each is half the last one, not below an eighth.

    Refused, in this order, when the worker is overloaded, has had ``most``, or asks within ``gap`` of the last grant.
    A worker's requests are folded in order, a batch at a time.
    """
    from collections.abc import Iterator

    import pandas as pd

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, last, total, out = None, 0, None, 0, []
        for batch in batches:
            for worker, start, load in zip(batch["worker"].tolist(), batch["start"].tolist(), batch["load"].tolist()):
                if worker != at:
                    if at is not None:
                        out.append((at, n, total))
                    at, n, last, total = worker, 0, None, 0
                if load > overload or n >= most or (last is not None and start - last < gap):
                    continue
                n, last, total = n + 1, start, total + max(base >> n, base >> 3)
        if at is not None:
            out.append((at, n, total))
        yield pd.DataFrame(out, columns=["worker", "granted", "extension"])

    ordered = requests.select("worker", "start", "load", "request").repartition("worker").sortWithinPartitions("worker", "start", "request")
    return ordered.mapInPandas(fold, "worker long, granted long, extension long")
