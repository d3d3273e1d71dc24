"""Joins, aggregates and set operations over the ledger's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import by_severity, completion_status, is_active, is_terminal, severity
from ..sources.ledger import Ledger
from .spread import by_key


def runs(verdicts: DataFrame) -> DataFrame:
    """(validation_id, attempts, final): a run is as good as its last attempt; final is null while that is open."""
    return verdicts.groupBy("validation_id").agg(F.count("*").alias("attempts"), F.max_by("verdict", "attempt").alias("final"))


def phase_state(ledger: Ledger, phase: int) -> DataFrame:
    """(claim_id, complete, passed) of every claim for one phase; both hold where it requires nothing."""
    required = ledger.validations.where((F.col("mode") == vocab.REQUIRED) & (F.col("phase") == phase)).select("validation_id", "claim_id")
    judged = required.join(runs(ledger.verdicts), "validation_id", "left")
    state = judged.groupBy("claim_id").agg(F.bool_and(F.col("final").isNotNull()).alias("complete"), F.bool_and(F.coalesce(F.col("final") == 1, F.lit(False))).alias("passed"))
    return ledger.claims.select("claim_id").join(state, "claim_id", "left").select("claim_id", F.coalesce("complete", F.lit(True)).alias("complete"), F.coalesce("passed", F.lit(True)).alias("passed"))


def claim_verdicts(ledger: Ledger) -> DataFrame:
    """(claim_id, verdict): the worst of the required checks after admission; null while one is open or there is none."""
    required = ledger.validations.where((F.col("mode") == vocab.REQUIRED) & (F.col("phase") > vocab.ADMISSION)).select("validation_id", "claim_id")
    judged = required.join(runs(ledger.verdicts), "validation_id", "left")
    worst = judged.groupBy("claim_id").agg(F.bool_and(F.col("final").isNotNull()).alias("done"), F.max(severity(F.col("final"))).alias("worst"))
    verdict = F.when(F.col("done"), by_severity(F.col("worst")))
    return ledger.claims.select("claim_id").join(worst, "claim_id", "left").select("claim_id", verdict.alias("verdict"))


def completions(ledger: Ledger) -> DataFrame:
    """(claim_id, next_status, complete): what the verdict makes of every claim that is being validated."""
    open_claims = ledger.claims.where(F.col("status") == vocab.VALIDATING).select("claim_id")
    v = claim_verdicts(ledger).join(open_claims, "claim_id", "left_semi")
    return v.select("claim_id", completion_status(F.col("verdict")).alias("next_status"), F.coalesce(F.col("verdict") == 1, F.lit(False)).alias("complete"))


def acceptance(ledger: Ledger) -> DataFrame:
    """(claim_id, outcome): Complete, Blocked or Pending of claims in validation, from admission, increments and verdict.

    All phases are judged in one pass over the runs of required checks.
    """
    required = ledger.validations.where(F.col("mode") == vocab.REQUIRED).select("validation_id", "claim_id", "phase")
    judged = required.join(runs(ledger.verdicts), "validation_id", "left")
    passed, late = F.coalesce(F.col("final") == 1, F.lit(False)), F.col("phase") > vocab.ADMISSION
    state = judged.groupBy("claim_id").agg(
        F.bool_and(F.when(F.col("phase") <= 2, passed)).alias("begun"), F.bool_and(F.when(late, F.col("final").isNotNull())).alias("done"), F.max(F.when(late, severity(F.col("final")))).alias("worst"))
    rows = ledger.claims.where(F.col("status") == vocab.VALIDATING).select("claim_id").join(state, "claim_id", "left")
    verdict = F.when(F.col("done"), by_severity(F.col("worst")))
    done = F.coalesce(F.col("begun"), F.lit(True)) & (verdict == 1)
    return rows.select("claim_id", F.when(F.coalesce(done, F.lit(False)), "Complete").when(verdict > 1, "Blocked").otherwise("Pending").alias("outcome"))


def expand(ledger: Ledger) -> DataFrame:
    """Every claim with its number of responses, its newest response and its number of validations."""
    back = ledger.responses.groupBy("claim_id").agg(F.count("*").alias("responses"), F.max("cycle").alias("latest"))
    checks = ledger.validations.groupBy("claim_id").agg(F.count("*").alias("checks"))
    return ledger.claims.select("claim_id", "status").join(back, "claim_id", "left").join(checks, "claim_id", "left").fillna(0, ["responses", "checks"])


def dangling(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges to a claim that does not exist."""
    return edges.join(claims.select(F.col("claim_id").alias("target")), "target", "left_anti").select("source", "relation", "target")


def dependency_status(ledger: Ledger) -> DataFrame:
    deps = ledger.edges.where(F.col("relation") == vocab.DEPENDS_ON).select(F.col("source").alias("claim_id"), "target")
    return deps.join(ledger.claims.select(F.col("claim_id").alias("target"), F.col("status").alias("target_status")), "target", "left").select("claim_id", "target", "target_status")


def root_states(ledger: Ledger) -> DataFrame:
    """(monitor_id, root, settled): predicate 1 waits for Satisfied, 2 for any terminal status; a missing root is open."""
    state = ledger.claims.select(F.col("claim_id").alias("root"), "status")
    met = F.when(F.col("predicate") == 1, F.col("status") == vocab.SATISFIED).otherwise(is_terminal(F.col("status")))
    return ledger.monitor_roots.join(state, "root", "left").select("monitor_id", "root", F.coalesce(met, F.lit(False)).alias("settled"))


def monitor_settlement(ledger: Ledger) -> DataFrame:
    return root_states(ledger).groupBy("monitor_id").agg(F.bool_and("settled").alias("settled"))


def failure_witness(ledger: Ledger) -> DataFrame:
    """(claim_id, witness): for active claims, the first created of the terminal dependencies that are not satisfied."""
    targets = ledger.claims.where(is_terminal(F.col("status")) & (F.col("status") != vocab.SATISFIED)).select(F.col("claim_id").alias("target"), F.col("created").alias("made"))
    deps = ledger.edges.where(F.col("relation") == vocab.DEPENDS_ON).select(F.col("source").alias("claim_id"), "target")
    active = ledger.claims.where(is_active(F.col("status"))).select("claim_id")
    return deps.join(targets, "target").join(active, "claim_id", "left_semi").groupBy("claim_id").agg(F.min_by("target", F.struct("made", "target")).alias("witness"))


def range_route(starts: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """(key, start): the last range that starts at or before each key, by buckets of ``width`` (ranges are no longer)."""
    ranges = starts.withColumn("bucket", F.floor(F.col("start") / width))
    near = keys.withColumn("bucket", F.explode(F.array(F.floor(F.col("key") / width), F.floor(F.col("key") / width) - 1)))
    return near.join(ranges, "bucket").where(F.col("start") <= F.col("key")).groupBy("key").agg(F.max("start").alias("start"))


def overlaps(ranges: DataFrame, lo: int, hi: int) -> DataFrame:
    """(start, end) parts of half-open ranges inside [lo, hi)."""
    return ranges.select(F.greatest("start", F.lit(lo)).alias("start"), F.least("end", F.lit(hi)).alias("end")).where("start < end")


def summary(ledger: Ledger) -> DataFrame:
    """(family, n): objects of each family."""
    out = None
    for name in ("claims", "responses", "validations", "artifacts", "monitors"):
        one = getattr(ledger, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "n")
        out = one if out is None else out.union(one)
    return out


def latest(table: DataFrame, key: str, order: str) -> DataFrame:
    """All rows with the largest ``order`` of their key, ties included."""
    return table.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def latest_status(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("claim_id").agg(F.max_by("status", F.struct("sequence", "ordinal")).alias("status"), F.count("*").alias("changes"))


def first_witness(artifacts: DataFrame) -> DataFrame:
    """(kind, producer, artifact_id, hash): the smallest artifact of each slot."""
    return artifacts.groupBy("kind", "producer").agg(F.min(F.struct("artifact_id", "hash")).alias("w")).select("kind", "producer", "w.artifact_id", "w.hash")


def counter_totals(samples: DataFrame) -> DataFrame:
    """(worker, total): sum of a counter's increments; a decrease is a reset, after which it counts from zero."""
    w = Window.partitionBy("worker").orderBy("request")
    last = F.lag("latency").over(w)
    step = F.when(last.isNull() | (F.col("latency") < last), F.col("latency")).otherwise(F.col("latency") - last)
    return samples.select("worker", step.alias("step")).groupBy("worker").agg(F.sum("step").alias("total"))


def audit(verdicts: DataFrame) -> DataFrame:
    """(validation_id, contiguous, sealed): attempts run 1, 2, .. and nothing comes after a verdict that is given as Pass."""
    w = Window.partitionBy("validation_id").orderBy("attempt")
    rows = by_key(verdicts, "validation_id").select("validation_id", (F.row_number().over(w) == F.col("attempt")).alias("ok"), ((F.col("verdict") == 1) & F.lead("attempt").over(w).isNotNull()).alias("late"))
    return rows.groupBy("validation_id").agg(F.bool_and("ok").alias("contiguous"), (~F.coalesce(F.bool_or("late"), F.lit(False))).alias("sealed"))


def diff(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """(key, change): keys added, removed or changed between two states with the same columns."""
    a, b = (t.select(key, F.xxhash64(*sorted(set(t.columns) - {key})).alias(n)) for t, n in ((one, "_a"), (two, "_b")))
    both = a.withColumn("_in_a", F.lit(True)).join(b.withColumn("_in_b", F.lit(True)), key, "full")
    change = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def audit_index(index: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """(missing, extra): rows that an index lacks or has beyond a rebuild."""
    return rebuilt.exceptAll(index).agg(F.count("*").alias("missing")).join(index.exceptAll(rebuilt).agg(F.count("*").alias("extra")))


def duplicates(artifacts: DataFrame, batch: DataFrame) -> DataFrame:
    """(hash, n, existing): contents that a batch holds more than once, or that exist already."""
    n = batch.groupBy("hash").agg(F.count("*").alias("n"))
    old = artifacts.select("hash").distinct().withColumn("existing", F.lit(True))
    return n.join(old, "hash", "left").select("hash", "n", F.coalesce("existing", F.lit(False)).alias("existing")).where("n > 1 OR existing")


def due_timers(ledger: Ledger, at: int, limit: int = 64) -> DataFrame:
    """The first timers due by ``at``: active claims and their open monitors."""
    claims = ledger.claims.where(is_active(F.col("status"))).select(F.col("deadline_at").alias("at"), F.lit("claim").alias("timer"), F.col("claim_id").alias("id"))
    owners = ledger.claims.select(F.col("claim_id").alias("owner"), "deadline_at")
    monitors = ledger.monitors.where("NOT released").join(owners, "owner").select("deadline_at", F.lit("monitor"), "monitor_id")
    return claims.union(monitors).where(F.col("at") <= at).orderBy("at", "timer", "id").limit(limit)


def retirement_candidates(claims: DataFrame, limit: int) -> DataFrame:
    return claims.where(is_terminal(F.col("status")) & F.col("released")).select("status", "claim_id").orderBy("status", "claim_id").limit(limit)


def covers(table: DataFrame, key: str, value: str, wanted: tuple) -> DataFrame:
    """(key, covered): whether a key's values include all wanted ones."""
    return table.groupBy(key).agg((F.count_distinct(F.when(F.col(value).isin(*wanted), F.col(value))) == len(set(wanted))).alias("covered"))


def response_outcomes(ledger: Ledger) -> DataFrame:
    """(claim_id, cause, outcome): Blocked by the first failed required check, Validated when all pass, else Evaluating."""
    judged = ledger.validations.where(F.col("mode") == vocab.REQUIRED).join(runs(ledger.verdicts), "validation_id", "left")
    cause, whole = F.min(F.when(F.col("final") > 1, F.col("validation_id"))), F.bool_and(F.coalesce(F.col("final") == 1, F.lit(False)))
    return judged.groupBy("claim_id").agg(cause.alias("cause"), F.when(cause.isNotNull(), "Blocked").when(whole, "Validated").otherwise("Evaluating").alias("outcome"))


def choose(rows: DataFrame, key: str, cursor: int, capacity: int) -> DataFrame:
    """(key): flagged rows first, then the rest, each beginning after the cursor and going round."""
    return rows.orderBy(F.desc("flagged"), F.col(key) <= cursor, key).limit(capacity).select(key)


def first_terminal(deltas: DataFrame) -> DataFrame:
    """(claim_id, status, at): the terminal status of each claim that has one, and the sequence at which it was reached."""
    over = deltas.where(is_terminal(F.col("status")))
    return over.groupBy("claim_id").agg(F.min_by("status", F.struct("sequence", "ordinal")).alias("status"), F.min("sequence").alias("at"))


def monitor_releases(ledger: Ledger, released: DataFrame) -> DataFrame:
    """(monitor_id, released_at): the sequence at which the last root of a monitor settles, or its owner (claim_id, at) is released before.

    A root that must be satisfied settles when that is its terminal status, any other when it has one.
    """
    over = first_terminal(ledger.deltas).withColumnRenamed("claim_id", "root")
    roots = ledger.monitor_roots.join(over, "root", "left")
    met = F.coalesce(F.when(F.col("predicate") == 1, F.col("status") == vocab.SATISFIED).otherwise(F.col("at").isNotNull()), F.lit(False))
    settled = roots.groupBy("monitor_id").agg(F.bool_and(met).alias("all"), F.max("at").alias("at")).where("all").select("monitor_id", "at")
    owned = ledger.monitors.join(released.withColumnRenamed("claim_id", "owner"), "owner").select("monitor_id", "at")
    return settled.union(owned).groupBy("monitor_id").agg(F.min("at").alias("released_at"))


def reconcile(committed: DataFrame, requests: DataFrame, floor: int) -> DataFrame:
    """(request, outcome): Committed wins, then BelowFloor, else Unknown."""
    have = committed.select("request").distinct().withColumn("_c", F.lit(True))
    outcome = F.when(F.col("_c"), "Committed").when(F.col("request") < floor, "BelowFloor").otherwise("Unknown")
    return requests.join(have, "request", "left").select("request", outcome.alias("outcome"))


def sticky_acceptance(ledger: Ledger) -> DataFrame:
    """(claim_id, outcome, at): the chronological reduction, in which the first verdict of a required check is final.

    Blocked at the first attempt (and then validation) whose verdict is not Pass; Validated at the last first verdict
    when all required checks have one; else Pending without a place.
    """
    first = ledger.verdicts.where("verdict IS NOT NULL").groupBy("validation_id").agg(F.min_by("verdict", "attempt").alias("verdict"), F.min("attempt").alias("attempt"))
    slots = ledger.validations.where(F.col("mode") == vocab.REQUIRED).select("validation_id", "claim_id").join(first, "validation_id", "left")
    broken = F.min(F.when(F.col("verdict") > 1, F.struct("attempt", "validation_id")))
    rows = slots.groupBy("claim_id").agg(broken.alias("broken"), F.bool_and(F.coalesce(F.col("verdict") == 1, F.lit(False))).alias("whole"), F.max("attempt").alias("last"))
    outcome = F.when(F.col("broken").isNotNull(), "Blocked").when(F.col("whole"), "Validated").otherwise("Pending")
    return rows.select("claim_id", outcome.alias("outcome"), F.when(F.col("broken").isNotNull(), F.col("broken.attempt")).when(F.col("whole"), F.col("last")).alias("at"))
