"""Graph and fixpoint operators: one DataFrame job a round, written to the checkpoint folder between rounds."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import is_active, is_terminal
from ..sources.ledger import Ledger
from .spread import by_key


def _cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the session's checkpoint folder; only a session in one process makes a local one where none is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evidor-"))
    return df.checkpoint(eager=True)


def _pairs(edges: DataFrame, relation: int, source: str = "claim_id", target: str = "target") -> DataFrame:
    return edges.where(F.col("relation") == relation).select(F.col("source").alias(source), F.col("target").alias(target))


def traverse(edges: DataFrame, roots: DataFrame, depth: int, forward: bool = True, relations: tuple[int, ...] = ()) -> DataFrame:
    """(id, depth) of what is reached from ``roots`` (id) within ``depth`` steps, at its smallest depth. No relations: all."""
    own, other = ("source", "target") if forward else ("target", "source")
    steps = edges.where(F.col("relation").isin(*relations)) if relations else edges
    steps = _cut(steps.select(F.col(own).alias("id"), F.col(other).alias("next")).distinct())
    reached = frontier = _cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    for k in range(1, depth + 1):
        frontier = _cut(frontier.join(steps, "id").select(F.col("next").alias("id")).distinct().join(reached, "id", "left_anti").withColumn("depth", F.lit(k)))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier) if k % 8 else _cut(reached.union(frontier))
    return reached


def bounded(edges: DataFrame, roots: DataFrame, depth: int, nodes: int, forward: bool = True) -> DataFrame:
    """(stop, nodes): why a traversal ends, and how many nodes its whole levels hold: NodeLimit, DepthLimit or Complete."""
    levels = traverse(edges, roots, depth + 1, forward).groupBy("depth").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    levels = levels.withColumn("total", so_far)
    inside = F.col("depth") <= depth
    held = F.max(F.when(inside & (F.col("total") <= nodes), F.col("total")))
    over, deeper = F.bool_or(inside & (F.col("total") > nodes)), F.bool_or(~inside)
    return levels.agg(F.when(over, "NodeLimit").when(deeper, "DepthLimit").otherwise("Complete").alias("stop"), F.coalesce(held, F.lit(0)).alias("nodes"))


def ancestors(edges: DataFrame, starts: DataFrame, most: int = 16) -> DataFrame:
    """(claim_id, ancestor, distance): causes of each start (claim_id), nearest first, at most ``most`` up."""
    cause = _cut(_pairs(edges, vocab.CAUSED_BY, "at", "up"))
    at = starts.select("claim_id", F.col("claim_id").alias("at"))
    out = None
    for k in range(1, most + 1):
        at = _cut(at.join(cause, "at").select("claim_id", F.col("up").alias("at")))
        if at.isEmpty():
            break
        step = at.select("claim_id", F.col("at").alias("ancestor"), F.lit(k).alias("distance"))
        out = step if out is None else out.union(step)
    return out if out is not None else at.select("claim_id", F.col("at").alias("ancestor"), F.lit(0).alias("distance"))


def followers(edges: DataFrame, claim: int, most: int = 64) -> DataFrame:
    """(follower, relation): the first distinct claims that refine, invalidate or are caused by ``claim``."""
    return edges.where((F.col("target") == claim) & F.col("relation").isin(8, 9, 15)).select(F.col("source").alias("follower"), "relation").distinct().orderBy("follower", "relation").limit(most)


def least_fixpoint(ledger: Ledger) -> DataFrame:
    """(claim_id, round): the satisfied claims of the least fixpoint, with the round in which they join (0: by status).

    A locally complete, active claim joins once all its dependencies are satisfied, all it awaits is satisfied or
    terminal, and all roots of its open monitors are settled. Rounds only add; a missing target is never met.
    """
    claims = _cut(ledger.claims.select("claim_id", "status", "local_complete"))
    satisfied = _cut(claims.where(F.col("status") == vocab.SATISFIED).select("claim_id", F.lit(0).alias("round")))
    over = claims.where(is_terminal(F.col("status"))).select(F.col("claim_id").alias("target"))
    needs = _pairs(ledger.edges, vocab.DEPENDS_ON).withColumn("strict", F.lit(True))
    needs = needs.union(_pairs(ledger.edges, vocab.AWAITS).withColumn("strict", F.lit(False)))
    held = ledger.monitors.where("NOT released").join(ledger.monitor_roots, "monitor_id")
    needs = needs.union(held.select(F.col("owner").alias("claim_id"), F.col("root").alias("target"), (F.col("predicate") == 1).alias("strict")))
    pending = _cut(claims.where(F.col("local_complete") & is_active(F.col("status"))).select("claim_id"))
    needs = needs.join(pending, "claim_id", "left_semi")
    lenient = needs.where("NOT strict").join(over, "target", "left_anti")
    unmet = _cut(needs.where("strict").unionByName(lenient).select("claim_id", "target").distinct())
    k = 0
    while True:
        k += 1
        unmet = _cut(unmet.join(satisfied.select(F.col("claim_id").alias("target")), "target", "left_anti"))
        fresh = _cut(pending.join(unmet, "claim_id", "left_anti").withColumn("round", F.lit(k)))
        if fresh.isEmpty():
            return satisfied
        satisfied = _cut(satisfied.union(fresh))
        pending = _cut(pending.join(fresh, "claim_id", "left_anti"))


def dependency_failed(ledger: Ledger) -> DataFrame:
    """(claim_id, witness, round): active claims that fail because a dependency is terminal and not satisfied, round by round.

    The witness is the failed dependency that was created first, as it stood before the round.
    """
    deps = _cut(_pairs(ledger.edges, vocab.DEPENDS_ON).join(ledger.claims.where(is_active(F.col("status"))).select("claim_id"), "claim_id", "left_semi"))
    failed = _cut(ledger.claims.where(is_terminal(F.col("status")) & (F.col("status") != vocab.SATISFIED)).select(F.col("claim_id").alias("target"), "created"))
    created = ledger.claims.select("claim_id", "created")
    out, k = None, 0
    while True:
        k += 1
        hit = _cut(deps.join(failed, "target").groupBy("claim_id").agg(F.min_by("target", F.struct("created", "target")).alias("witness")).withColumn("round", F.lit(k)))
        if out is not None and hit.isEmpty():
            return out
        out = hit if out is None else _cut(out.union(hit))
        if hit.isEmpty():
            return out
        deps = _cut(deps.join(hit, "claim_id", "left_anti"))
        failed = hit.join(created, "claim_id").select(F.col("claim_id").alias("target"), "created")


def cancel_closure(ledger: Ledger, root: int, status: int = vocab.CANCELLED) -> DataFrame:
    """(claim_id, status): the root with its status and all its active descendants by cause as Cancelled; terminal ones are passed through."""
    below = traverse(ledger.edges, ledger.claims.where(F.col("claim_id") == root).select(F.col("claim_id").alias("id")), 1 << 20, forward=False, relations=(vocab.CAUSED_BY,))
    rows = below.select(F.col("id").alias("claim_id")).join(ledger.claims.select("claim_id", F.col("status").alias("was")), "claim_id")
    return rows.where(is_active(F.col("was")) | (F.col("claim_id") == root)).select("claim_id", F.when(F.col("claim_id") == root, status).otherwise(vocab.CANCELLED).alias("status"))


def release_cascade(ledger: Ledger) -> DataFrame:
    """(claim_id, round): terminal, unreleased claims released because no claim they caused is unreleased, leaves first."""
    cause = _pairs(ledger.edges, vocab.CAUSED_BY, "child", "claim_id")
    open_claims = _cut(ledger.claims.where("NOT released").select("claim_id", "status"))
    holds = _cut(cause.join(open_claims.select(F.col("claim_id").alias("child")), "child", "left_semi"))
    waiting = _cut(open_claims.where(is_terminal(F.col("status"))).select("claim_id"))
    out, k = None, 0
    while True:
        k += 1
        free = _cut(waiting.join(holds, "claim_id", "left_anti").withColumn("round", F.lit(k)))
        out = free if out is None else _cut(out.union(free))
        if free.isEmpty():
            return out
        waiting = _cut(waiting.join(free, "claim_id", "left_anti"))
        holds = _cut(holds.join(free.select(F.col("claim_id").alias("child")), "child", "left_anti"))


def cyclic(edges: DataFrame, relations: tuple[int, ...] = (5, 8, 13)) -> DataFrame:
    """(id): what is left after peeling nodes without outgoing edges again and again: empty where there is no cycle."""
    left = _cut(edges.where(F.col("relation").isin(*relations)).select("source", "target").distinct())
    while True:
        kept = _cut(left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi"))
        if kept.count() == left.count():
            return kept.select(F.col("source").alias("id")).distinct()
        left = kept


def wait_edges(ledger: Ledger) -> DataFrame:
    """(source, target): unsettled waits of active claims on active claims, and on unmet roots of their open monitors."""
    active = ledger.claims.where(is_active(F.col("status"))).select("claim_id")
    waits = ledger.edges.where(F.col("relation").isin(vocab.DEPENDS_ON, vocab.AWAITS)).select("source", "target")
    waits = waits.union(ledger.monitors.where("NOT released").join(ledger.monitor_roots, "monitor_id").select(F.col("owner"), F.col("root")))
    waits = waits.join(active.select(F.col("claim_id").alias("source")), "source", "left_semi")
    return waits.join(active.select(F.col("claim_id").alias("target")), "target", "left_semi").select("source", "target").distinct()


def deadlock(ledger: Ledger, start: int) -> DataFrame:
    """(id, victim): the claims that wait for each other with ``start``, and the first created of them; empty if there is no cycle."""
    waits = _cut(wait_edges(ledger).withColumn("relation", F.lit(0)))
    root = ledger.claims.where(F.col("claim_id") == start).select(F.col("claim_id").alias("id"))
    ahead, behind = (traverse(waits, root, 1 << 20, forward=f).select("id") for f in (True, False))
    members = _cut(ahead.join(behind, "id", "left_semi"))
    loop = waits.where((F.col("source") == start) & (F.col("target") == start))
    real = members.count() > 1 or not loop.isEmpty()
    victim = members.join(ledger.claims.select(F.col("claim_id").alias("id"), "created"), "id").agg(F.min(F.struct("created", "id")).alias("v")).select("v.id").first()[0]
    return members.where(F.lit(real)).withColumn("victim", F.lit(victim).cast("bigint"))


def owners_ready(ledger: Ledger) -> DataFrame:
    """(claim_id): terminal claims without open monitor whose caused claims are all released."""
    children = _pairs(ledger.edges, vocab.CAUSED_BY, "child", "claim_id").join(ledger.claims.where("NOT released").select(F.col("claim_id").alias("child")), "child", "left_semi")
    watch = ledger.monitors.where("NOT released").select(F.col("owner").alias("claim_id"))
    return ledger.claims.where(is_terminal(F.col("status"))).select("claim_id").join(children, "claim_id", "left_anti").join(watch, "claim_id", "left_anti")


def unreachable(artifacts: DataFrame, referenced: DataFrame, before: int) -> DataFrame:
    """(artifact_id): contents that nothing refers to (hash) and that are older than the grace point."""
    return artifacts.join(referenced, "hash", "left_anti").where(F.col("created") < before).select("artifact_id")


def conflicts(writes: DataFrame, width: int) -> DataFrame:
    """(later, earlier): commands of one epoch (``width`` sequences) that touch the same claim, of which one comes later."""
    rows = writes.select(F.floor((F.col("sequence") - 1) / width).alias("epoch"), "claim_id", F.col("event_id").alias("n"))
    a, b = rows.withColumnRenamed("n", "later"), rows.withColumnRenamed("n", "earlier")
    return a.join(b, ["epoch", "claim_id"]).where("later > earlier").select("later", "earlier")


def families(ledger: Ledger, roots: DataFrame, most: int) -> DataFrame:
    """(root, members, eligible): a claim with all it caused, where that are up to ``most`` members.

    A family is eligible if all members are terminal and released and no claim outside that is not refers to one of
    them. A member is counted once, so a loop of causes ends; families that outgrow the bound are given up at once.
    """
    cause = _cut(_pairs(ledger.edges, vocab.CAUSED_BY, "child", "id"))
    at = found = _cut(roots.select(F.col("claim_id").alias("root"), F.col("claim_id").alias("id")).distinct())
    while True:
        at = _cut(at.join(cause, "id").select("root", F.col("child").alias("id")).distinct().join(found, ["root", "id"], "left_anti"))
        if at.isEmpty():
            break
        both = found.union(at)
        large = both.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most).select("root")
        large = _cut(large)
        found, at = _cut(both.join(large, "root", "left_anti")), at.join(large, "root", "left_anti")
    done = ledger.claims.select(F.col("claim_id").alias("id"), (is_terminal(F.col("status")) & F.col("released")).alias("ok"))
    others = ledger.edges.where(F.col("relation") != vocab.CAUSED_BY).join(done.where("NOT ok").select(F.col("id").alias("source")), "source", "left_semi")
    outside = found.join(others.select(F.col("target").alias("id"), "source").distinct(), "id").select("root", F.col("source").alias("id")).join(found, ["root", "id"], "left_anti")
    held = outside.select("root").distinct().withColumn("held", F.lit(True))
    sized = found.join(done, "id").groupBy("root").agg(F.count("*").alias("members"), F.bool_and("ok").alias("ok"))
    return sized.join(held, "root", "left").select("root", "members", (F.col("ok") & F.col("held").isNull()).alias("eligible"))


def failure_origins(ledger: Ledger, starts: DataFrame, most: int = 16) -> DataFrame:
    """(claim_id, origin, steps): the first created failed claim among the dependencies of each start, up to ``most`` steps away."""
    deps = _cut(_pairs(ledger.edges, vocab.DEPENDS_ON, "at", "next"))
    failed = ledger.claims.where(F.col("status") > vocab.SATISFIED).select(F.col("claim_id").alias("at"), "created")
    at = _cut(starts.select("claim_id", F.col("claim_id").alias("at")))
    hits = [at.withColumn("steps", F.lit(0)).limit(0)]
    for k in range(1, most + 1):
        at = _cut(at.join(deps, "at").select("claim_id", F.col("next").alias("at")).distinct())
        if at.isEmpty():
            break
        hits.append(at.withColumn("steps", F.lit(k)))
    best = reduce(DataFrame.union, hits).join(failed, "at").groupBy("claim_id").agg(F.min(F.struct("created", "at", "steps")).alias("b"))
    return best.select("claim_id", F.col("b.at").alias("origin"), F.col("b.steps").alias("steps"))


def propagate(ledger: Ledger) -> DataFrame:
    """(claim_id, status, released): all claims after the consequences of their state have come to rest.

    First dependencies fail, to the end. Then satisfaction, the release of claims whose caused ones are released, and the
    release of monitors (owner released, or all roots settled) are repeated until nothing changes, as an open monitor
    keeps its owner from being satisfied.
    """
    failed = _cut(dependency_failed(ledger).select("claim_id", F.lit(vocab.DEPENDENCY_FAILED).alias("new")))
    claims = _cut(ledger.claims.join(failed, "claim_id", "left").withColumn("status", F.coalesce("new", "status")).drop("new"))
    monitors = ledger.monitors
    while True:
        now = Ledger(**{**vars(ledger), "claims": claims, "monitors": monitors})
        reached = _cut(least_fixpoint(now).where("round > 0").select("claim_id", F.lit(vocab.SATISFIED).alias("new")))
        claims = claims.join(reached, "claim_id", "left").withColumn("status", F.coalesce("new", "status")).drop("new")
        free = _cut(release_cascade(Ledger(**{**vars(now), "claims": claims})).select("claim_id", F.lit(True).alias("free")))
        claims = _cut(claims.join(free, "claim_id", "left").withColumn("released", F.coalesce("free", "released")).drop("free"))
        held = monitors.where("NOT released").select("monitor_id", "owner")
        state = claims.select(F.col("claim_id").alias("root"), "status")
        open_roots = ledger.monitor_roots.join(state, "root", "left")
        unmet = ~F.coalesce(F.when(F.col("predicate") == 1, F.col("status") == vocab.SATISFIED).otherwise(is_terminal(F.col("status"))), F.lit(False))
        waiting = held.join(open_roots.where(unmet).select("monitor_id"), "monitor_id", "left_semi")
        waiting = waiting.join(claims.where("released").select(F.col("claim_id").alias("owner")), "owner", "left_anti").select("monitor_id", F.lit(False).alias("still"))
        before = monitors
        monitors = _cut(monitors.join(waiting, "monitor_id", "left").withColumn("released", F.coalesce("still", F.lit(True))).drop("still"))
        moved = before.where("NOT released").join(monitors.where("released").select("monitor_id"), "monitor_id", "left_semi")
        if moved.isEmpty():
            return claims.select("claim_id", "status", "released")


def _reached(edges: DataFrame, sign: int, steps: int = 3) -> DataFrame:
    """(id, ahead, behind) of every node of (source, target): the first node, by ``sign`` * id, that reaches it and that it reaches, or itself.

    Both ways are walked at once, several steps to a round. Every node has a loop, so that a step is one join.
    """
    ends = edges.select("source").union(edges.select("target")).distinct()
    ways = edges.select(F.lit(0).alias("way"), "source", "target").union(edges.select(F.lit(1), "target", "source"))
    ways = ways.union(ends.crossJoin(F.broadcast(ends.sparkSession.range(2))).select(F.col("id").cast("int"), "source", "source"))
    ways = _cut(by_key(ways, "way", "source").sortWithinPartitions("way", "source"))
    marks = _cut(ways.where("source = target").select("way", "source", (F.col("source") * sign).alias("mark")).distinct())
    total = F.sum(F.col("mark").cast("decimal(38, 0)"))
    before, now = None, marks.agg(total).first()[0]
    while now != before:
        for _ in range(steps):
            marks = ways.join(marks, ["way", "source"]).groupBy("way", F.col("target").alias("source")).agg(F.min("mark").alias("mark"))
        marks = _cut(marks)
        # marks only fall, so that an equal sum is an equal table
        before, now = now, marks.agg(total).first()[0]
    at = [F.max(F.when(F.col("way") == k, F.col("mark") * sign)).alias(name) for k, name in enumerate(("ahead", "behind"))]
    return _cut(marks.groupBy(F.col("source").alias("id")).agg(*at))


def components_of_cycles(edges: DataFrame) -> DataFrame:
    """(id, scc): strongly connected components of more than one node or with a loop, named by their smallest id.

    Nodes on no cycle are peeled off from both sides while that takes a tenth of the edges. Then every node takes the first
    node that reaches it and the first that it reaches: where they are one, its component is found. Nodes of one component
    have both in common, so that of the other edges those between different ones go. First is smallest and largest in turn.
    """
    left = _cut(edges.select("source", "target").distinct())
    size, out, sign = left.count(), None, 1
    while size:
        peeled = True
        while peeled and size:
            kept = left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target")
            left = _cut(kept.join(kept.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target"))
            size, peeled = (rest := left.count()), rest < 0.9 * size
        if not size:
            break
        seen = _reached(left, sign)
        found = seen.where("ahead = behind").select("id", F.col("ahead").alias("at"))
        loops = left.where("source = target").select(F.col("source").alias("id"), F.lit(True).alias("loop"))
        whole = found.join(loops, "id", "left").groupBy("at").agg(F.min("id").alias("scc"), F.count("*").alias("n"), F.max("loop").alias("loop"))
        real = found.join(whole.where("n > 1 OR loop").select("at", "scc"), "at").select("id", "scc")
        out = _cut(real if out is None else out.union(real))
        open_ends = seen.where("ahead <> behind")
        left = left.join(open_ends.toDF("source", "ahead", "behind"), "source").join(open_ends.toDF("target", "ahead", "behind"), ["target", "ahead", "behind"])
        left = _cut(left.select("source", "target"))
        size, sign = left.count(), -sign
    return left.select(F.col("source").alias("id"), F.col("target").alias("scc")) if out is None else out


def resolve_deadlines(ledger: Ledger, now: int) -> DataFrame:
    """(claim_id, outcome, victim) of every due, active claim: Deadlocked with the first created claim of its wait cycle, else Expired."""
    due = ledger.claims.where(is_active(F.col("status")) & (F.col("deadline_at") <= now)).select("claim_id")
    cycles = components_of_cycles(wait_edges(ledger))
    created = ledger.claims.select(F.col("claim_id").alias("id"), "created")
    victims = cycles.join(created, "id").groupBy("scc").agg(F.min_by("id", F.struct("created", "id")).alias("victim"))
    member = cycles.join(victims, "scc").select(F.col("id").alias("claim_id"), "victim")
    return due.join(member, "claim_id", "left").select("claim_id", F.when(F.col("victim").isNotNull(), "Deadlocked").otherwise("Expired").alias("outcome"), "victim")
