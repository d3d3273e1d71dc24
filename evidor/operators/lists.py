"""Lists of the ledger's objects, what belongs to them, and the joins that gather the context of one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import is_terminal
from ..sources.ledger import Ledger
from .derive import runs

#: Claims that a seed may name, and relations or scopes that a selection may list.
MOST_SEEDS, MOST_LISTED = 256, 16


def seed(ledger: Ledger, claims: list[int], prefix: int) -> DataFrame:
    """(kind, id): claims, responses and validations of the named claims as of a prefix; no names: of all."""
    if len(claims) > MOST_SEEDS:
        raise ValueError(f"at most {MOST_SEEDS} claims")
    then = ledger.at(prefix)
    own = then.claims.where(F.col("claim_id").isin(claims)).select("claim_id") if claims else then.claims.select("claim_id")
    back = ledger.responses.join(own, "claim_id", "left_semi").select(F.lit(2), (F.col("claim_id") * 1000 + F.col("cycle")))
    checks = ledger.validations.join(own, "claim_id", "left_semi").select(F.lit(3), "validation_id")
    return own.select(F.lit(1).alias("kind"), F.col("claim_id").alias("id")).union(back).union(checks)


def evaluations(ledger: Ledger, claim: int | None = None, validation: int | None = None, verdict: int | None = None) -> DataFrame:
    """(claim_id, validation_id, attempt, verdict): one row a result, so that a check with several may repeat."""
    rows = ledger.verdicts.join(ledger.validations.select("validation_id", "claim_id"), "validation_id")
    for name, value in (("claim_id", claim), ("validation_id", validation), ("verdict", verdict)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.select("claim_id", "validation_id", "attempt", "verdict")


def definitions(ledger: Ledger, evaluator: int) -> DataFrame:
    """(claim_id, validation_id, place): checks that an evaluator judges, or whose claim it issued, with their place in the claim."""
    rows = ledger.validations.join(ledger.claims.select("claim_id", "issuer"), "claim_id")
    return rows.where((F.col("evaluator") == evaluator) | (F.col("issuer") == evaluator)).select("claim_id", "validation_id", F.col("kind").alias("place"))


def receipts(ledger: Ledger, holder: int) -> DataFrame:
    """(claim_id, epoch, current): the receipts that a holder has or had; the newest of a claim is current."""
    newest = ledger.responses.groupBy("claim_id").agg(F.max("cycle").alias("newest"))
    mine = ledger.claims.where(F.col("subject") == holder).select("claim_id")
    rows = ledger.responses.join(mine, "claim_id", "left_semi").join(newest, "claim_id")
    return rows.select("claim_id", F.col("cycle").alias("epoch"), (F.col("cycle") == F.col("newest")).alias("current"))


def monitors_of(ledger: Ledger, owner: int) -> DataFrame:
    return ledger.monitors.where(F.col("owner") == owner).join(ledger.monitor_roots, "monitor_id").select("monitor_id", "released", "root", "predicate")


def claims_where(ledger: Ledger, relation: int, target: int, created_after: int, scopes: tuple[int, ...]) -> DataFrame:
    """(claim_id): claims with a relation to a target, created later, that have all the scopes (kinds of their checks)."""
    if len(scopes) > MOST_LISTED:
        raise ValueError(f"at most {MOST_LISTED} scopes")
    named = ledger.edges.where((F.col("relation") == relation) & (F.col("target") == target)).select(F.col("source").alias("claim_id")).distinct()
    rows = ledger.claims.where(F.col("created") > created_after).join(named, "claim_id", "left_semi").select("claim_id")
    return rows.join(having_all(ledger.validations, "claim_id", "kind", scopes), "claim_id", "left_semi")


def having_all(table: DataFrame, key: str, value: str, wanted: tuple) -> DataFrame:
    """(key): keys that have every wanted value."""
    return table.where(F.col(value).isin(*wanted)).groupBy(key).agg(F.count_distinct(value).alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def evidence(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of (id, hash) that a wanted reference (id, hash) names; a null hash names any content of the id."""
    asked = wanted.select("id", F.col("hash").alias("asked")).distinct()
    return table.join(asked, "id").where(F.col("asked").isNull() | (F.col("asked") == F.col("hash"))).select("id", "hash").distinct()


def manifest(references: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(set_id, pieces, valid): whether every reference (set_id, artifact_id, hash) of a set names an artifact with that content."""
    have = artifacts.select("artifact_id", "hash").withColumn("ok", F.lit(True))
    rows = references.join(have, ["artifact_id", "hash"], "left")
    return rows.groupBy("set_id").agg(F.count("*").alias("pieces"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("valid"))


def context(ledger: Ledger) -> DataFrame:
    """(validation_id, claim_id, status, evaluator, attempts, final, cycle): each required check with its claim, its run and the response it judges."""
    newest = ledger.responses.groupBy("claim_id").agg(F.max("cycle").alias("cycle"))
    checks = ledger.validations.where(F.col("mode") == vocab.REQUIRED).select("validation_id", "claim_id", "evaluator")
    rows = checks.join(ledger.claims.select("claim_id", "status"), "claim_id").join(runs(ledger.verdicts), "validation_id", "left").join(newest, "claim_id", "left")
    return rows.select("validation_id", "claim_id", "status", "evaluator", "attempts", "final", "cycle")


def count_budget(ledger: Ledger, most: int) -> DataFrame:
    """(objects, within): all objects together, and whether that is within the budget."""
    tables = (ledger.claims, ledger.validations, ledger.artifacts, ledger.responses, ledger.monitors)
    total = reduce(DataFrame.union, (t.agg(F.count("*").alias("n")) for t in tables)).agg(F.sum("n").alias("objects"))
    return total.select("objects", (F.col("objects") <= most).alias("within"))


def cause(verdict: Column) -> Column:
    """The kind of cause that a verdict gives; an open run and a pass give none."""
    # The verdicts' codes.
    return F.when(verdict == 2, "Failed").when(verdict == 3, "Incomplete").when(verdict == 4, "Errored")


def artifact_outcomes(ledger: Ledger) -> DataFrame:
    """(claim_id, outcome): of what a claim delivered: Blocked with a cause, Passed when all required checks pass, else Pending.

    The first attempt of a check that ends it is final.
    """
    first = ledger.verdicts.where("verdict IS NOT NULL").groupBy("validation_id").agg(F.min_by("verdict", "attempt").alias("verdict"))
    rows = ledger.validations.where(F.col("mode") == vocab.REQUIRED).select("validation_id", "claim_id").join(first, "validation_id", "left")
    blocked, passed = F.bool_or(F.coalesce(cause(F.col("verdict")).isNotNull(), F.lit(False))), F.bool_and(F.coalesce(F.col("verdict") == 1, F.lit(False)))
    return rows.groupBy("claim_id").agg(F.when(blocked, "Blocked").when(passed, "Passed").otherwise("Pending").alias("outcome"))


def audit_complete(ledger: Ledger) -> DataFrame:
    """(claim_id, complete): every check of a claim has ended, or was fenced (its claim is terminal), or never began and is only observed."""
    rows = ledger.validations.join(runs(ledger.verdicts), "validation_id", "left").join(ledger.claims.select("claim_id", "status"), "claim_id")
    ended = F.col("final").isNotNull() | is_terminal(F.col("status")) | (F.col("attempts").isNull() & (F.col("mode") != vocab.REQUIRED))
    return rows.groupBy("claim_id").agg(F.bool_and(ended).alias("complete"))


def all_edges(ledger: Ledger) -> DataFrame:
    """(kind, source, target, introduced): authored relations, and those that checks, evaluators, responses and monitors imply."""
    made = ledger.claims.select("claim_id", "created")
    checks = ledger.validations.join(made, "claim_id")
    back = ledger.responses.join(made, "claim_id")
    parts = [
        ledger.edges.select(F.lit("Relation").alias("kind"), "source", "target", "introduced"),
        checks.select(F.lit("ValidationOf"), "validation_id", "claim_id", "created"),
        checks.where(F.col("mode") == vocab.REQUIRED).select(F.lit("Requirement"), "claim_id", "validation_id", "created"),
        checks.select(F.lit("Evaluator"), "validation_id", "evaluator", "created"),
        back.select(F.lit("TestamentOf"), F.col("claim_id") * 1000 + F.col("cycle"), "claim_id", F.col("created") + F.col("cycle")),
        ledger.monitors.join(ledger.monitor_roots, "monitor_id").join(made.withColumnRenamed("claim_id", "owner"), "owner").select(F.lit("Watches"), "monitor_id", "root", "created"),
    ]
    return reduce(DataFrame.union, parts)


def wait_settled(claims: DataFrame, satisfied: DataFrame) -> DataFrame:
    """(claim_id, satisfied, terminal): a wait for an end is over as well when the graph has satisfied the claim."""
    met = satisfied.select("claim_id").distinct().withColumn("met", F.lit(True))
    rows = claims.join(met, "claim_id", "left").withColumn("met", F.coalesce("met", F.lit(False)))
    return rows.select("claim_id", F.col("met").alias("satisfied"), (F.col("met") | is_terminal(F.col("status"))).alias("terminal"))


def routes(sessions: DataFrame, delegations: DataFrame) -> DataFrame:
    """(session, leader, route): the leader of a session at its newest delegation; one of an older epoch is stale, without any there is none."""
    newest = delegations.groupBy("session").agg(F.max("epoch").alias("newest"), F.max_by("leader", "epoch").alias("leader"))
    rows = sessions.join(newest, "session", "left")
    state = F.when(F.col("leader").isNull(), "None").when(F.col("epoch") < F.col("newest"), "Stale").otherwise("Current")
    return rows.select("session", F.when(state == "Current", F.col("leader")).alias("leader"), state.alias("route"))


def served(requests: DataFrame) -> DataFrame:
    """(session, served): all three epochs (owner, route, request) have to agree; after a cutover only reads up to the cut are served."""
    equal = (F.col("owner") == F.col("routed")) & (F.col("routed") == F.col("asked"))
    behind = F.col("cut").isNull() | (F.col("is_read") & (F.col("prefix") <= F.col("cut")))
    return requests.select("session", F.when(~equal, "Fenced").when(~behind, "CutOver").otherwise("Served").alias("served"))


def readable(published: Column, consistency: Column, token: Column) -> Column:
    """What a read gets at the published prefix: the newest state, one at least as new as a token, the state of a token, or any."""
    late = F.when((consistency == "AtLeast") & (token > published), "NotYet").when((consistency == "Exact") & (token > published), "NotYet")
    return late.when(consistency == "Exact", F.concat(F.lit("At:"), token.cast("string"))).otherwise(F.concat(F.lit("At:"), published.cast("string")))


def history(invoked: DataFrame, published: DataFrame, completed: DataFrame) -> DataFrame:
    """(call, state): calls that were completed without being published are lost, published twice repeated, published only open."""
    out = published.groupBy("call").agg(F.count("*").alias("times"))
    rows = invoked.select("call").join(out, "call", "left").join(completed.select("call").distinct().withColumn("done", F.lit(True)), "call", "left")
    times = F.coalesce("times", F.lit(0))
    state = F.when(times > 1, "Repeated").when(F.col("done") & (times == 0), "Lost").when(F.col("done"), "Done").when(times > 0, "Open").otherwise("Pending")
    return rows.select("call", state.alias("state"))
