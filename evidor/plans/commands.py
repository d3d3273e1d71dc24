"""The registered queries of command guards: one for each command, with an independent SQL text.

The proposals are made from the claims by rules, so that every reason occurs: claims of all statuses, proposed to by the
issuer, the subject, the runtime and strangers, each with a number that is right for some.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import commands
from ..sources.ledger import Ledger

#: The time of the state, in microseconds, and the statuses of its claims by their number.
NOW = 800_000_000_000_000
#: Which number a command's proposals carry.
_NUMBERS = {
    "expire": "8000 + claim_id % 2000", "expire_monitor": "8000 + claim_id % 2000", "supersede": "claim_id + 7", "register_monitor": "claim_id + 3 * (claim_id % 5)",
    "register_artifact": "claim_id", "adopt_receipt": "claim_id % 9", "begin_increment": "1 + claim_id % 8", "close_testament": "claim_id % 9", "acknowledge_testament": "claim_id % 9",
    "record_verdict": "1 + claim_id % 3", "acquire_receipt": "1 + (claim_id % 3) % 2", "record_progress": "claim_id % 9", "begin_evidence": "claim_id % 9",
}


def staged(ledger: Ledger) -> Ledger:
    """The ledger with claims of all statuses, and some that name a predecessor."""
    claims = ledger.claims.withColumn("status", (1 + F.col("claim_id") % 20).cast("int"))
    claims = claims.withColumn("issuer", F.col("claim_id") % 7 + 1).withColumn("subject", F.col("claim_id") % 7 + 100)
    named = claims.where("claim_id % 7 = 0").select((F.col("claim_id") + 7).alias("source"), F.lit(5).alias("relation"), F.col("claim_id").alias("target"), F.col("created").alias("introduced"))
    return Ledger(**{**vars(ledger), "claims": claims, "edges": ledger.edges.unionByName(named)})


def proposals(ledger: Ledger, name: str) -> DataFrame:
    evaluators = ledger.validations.where("kind = 1").groupBy("claim_id").agg(F.min("evaluator").alias("evaluator"))
    rows = ledger.claims.join(evaluators, "claim_id", "left")
    actor = F.when(F.col("claim_id") % 11 == 3, 999).when(F.lit(name == "record_verdict"), F.coalesce("evaluator", F.lit(0)))
    role = {"post": "issuer", "cancel": "issuer", "supersede": "issuer", "register_monitor": "issuer", "acquire_receipt": "subject", "record_progress": "subject", "begin_evidence": "subject", "close_testament": "subject"}.get(name)
    actor = actor.otherwise(F.col(role) if role else F.lit(0))
    return rows.select("claim_id", actor.cast("bigint").alias("actor"), F.expr(_NUMBERS.get(name, "claim_id % 3")).cast("bigint").alias("n"))


_RUNS = "runs AS (SELECT validation_id, max(attempt) AS attempts, max(CASE WHEN r = 1 THEN verdict END) AS final FROM (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY attempt DESC) AS r FROM verdicts) GROUP BY 1)"
_STATE = "b AS (SELECT * REPLACE (CAST(1 + claim_id % 20 AS INT) AS status, claim_id % 7 + 1 AS issuer, claim_id % 7 + 100 AS subject) FROM claims)"
_ISSUER, _HOLDER, _RUNTIME = "issuer", "subject", "0"
_EVALUATOR = "coalesce((SELECT min(evaluator) FROM validations v WHERE v.claim_id = b.claim_id AND v.kind = 1), 0)"
_T, _W = "'Refused:TransitionForbidden'", "'Refused:WrongActor'"
_STAYS = "'Applied:' || status"
_E = "LEFT JOIN (SELECT claim_id AS ec, CAST(max(cycle) AS BIGINT) AS epoch, count(*) AS responses FROM responses GROUP BY 1) ON ec = claim_id"
_PHASE = """LEFT JOIN (SELECT claim_id AS pc, bool_and(final IS NOT NULL) AS complete, bool_and(coalesce(final = 1, FALSE)) AS passed FROM validations LEFT JOIN runs USING (validation_id)
    WHERE mode = 2 AND phase = {p} GROUP BY 1) ON pc = claim_id"""
_STALE = "epoch IS NULL OR n <> epoch"
#: command -> (who proposes, joins, outcome), where a is the actor and n the number.
_SQL: dict[str, tuple[str, str, str]] = {
    "post": (_ISSUER, "", f"CASE WHEN status <> 1 THEN {_T} WHEN a <> issuer THEN {_W} ELSE 'Applied:2' END"),
    "acquire_receipt": (_HOLDER, _PHASE.format(p=1) + " LEFT JOIN (SELECT source, min(target) AS unmet FROM edges WHERE relation = 6 AND target NOT IN (SELECT claim_id FROM b WHERE status = 8) GROUP BY 1) ON source = claim_id",
        f"CASE WHEN status <> 2 THEN {_T} WHEN a <> subject THEN {_W} WHEN NOT coalesce(passed, TRUE) THEN 'Informed:ValidationPending' WHEN unmet IS NOT NULL THEN 'Informed:DependencyPending:' || unmet WHEN n <> 1 THEN 'Refused:StaleReceipt' ELSE 'Applied:3' END"),
    "adopt_receipt": (_RUNTIME, _E, f"CASE WHEN a <> 0 THEN {_W} WHEN status NOT BETWEEN 3 AND 7 THEN {_T} WHEN epoch IS NULL OR n <> epoch + 1 THEN 'Refused:StaleReceipt' ELSE {_STAYS} END"),
    "record_progress": (_HOLDER, _E, f"CASE WHEN status NOT IN (3, 4) THEN {_T} WHEN a <> subject THEN {_W} WHEN {_STALE} THEN 'Refused:StaleReceipt' ELSE 'Applied:4' END"),
    "begin_evidence": (_HOLDER, _E, f"CASE WHEN status NOT IN (3, 4) THEN {_T} WHEN a <> subject THEN {_W} WHEN {_STALE} THEN 'Refused:StaleReceipt' ELSE {_STAYS} END"),
    "close_testament": (_HOLDER, _E, f"CASE WHEN status NOT IN (3, 4) THEN {_T} WHEN a <> subject THEN {_W} WHEN n <> coalesce(responses, 0) THEN 'Refused:InvalidManifest' ELSE 'Applied:5' END"),
    "acknowledge_testament": (_RUNTIME, _E, f"CASE WHEN a <> 0 THEN {_W} WHEN status <> 5 THEN {_T} WHEN {_STALE} THEN 'Refused:InvalidManifest' ELSE 'Applied:6' END"),
    "begin_whole_work": (_RUNTIME, _E + " " + _PHASE.format(p=2), f"CASE WHEN a <> 0 THEN {_W} WHEN status <> 6 THEN {_T} WHEN NOT coalesce(complete, TRUE) THEN 'Informed:ValidationPending' WHEN epoch IS NULL THEN 'Refused:InvalidManifest' ELSE 'Applied:7' END"),
    "begin_increment": (_RUNTIME, "LEFT JOIN (SELECT claim_id AS vc, kind, phase FROM validations) ON vc = claim_id AND kind = n",
        f"CASE WHEN a <> 0 THEN {_W} WHEN status NOT BETWEEN 3 AND 6 THEN {_T} WHEN phase IS NULL THEN 'Refused:UnknownObject' WHEN phase <> 2 THEN 'Refused:InvalidRelation' ELSE {_STAYS} END"),
    "record_verdict": (_EVALUATOR, "LEFT JOIN (SELECT claim_id AS vc, validation_id AS vid, evaluator FROM validations WHERE kind = 1) ON vc = claim_id LEFT JOIN runs ON runs.validation_id = vid",
        f"CASE WHEN vid IS NULL THEN 'Refused:UnknownObject' WHEN a <> evaluator THEN {_W} WHEN final IN (1, 2, 3) THEN {_T} WHEN n <> coalesce(attempts, 0) + 1 THEN 'Refused:InvalidAttempt' ELSE {_STAYS} END"),
    "complete_whole_work": (_RUNTIME, """LEFT JOIN (SELECT claim_id AS wc, count(*) = count(final) AS done, max(CASE final WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 2 THEN 3 END) AS s
        FROM validations LEFT JOIN runs USING (validation_id) WHERE mode = 2 AND phase > 1 GROUP BY 1) ON wc = claim_id""",
        f"CASE WHEN a <> 0 THEN {_W} WHEN status <> 7 THEN {_T} WHEN NOT coalesce(done, FALSE) THEN 'Informed:ValidationPending' ELSE CASE s WHEN 0 THEN 'Applied:8' WHEN 1 THEN 'Applied:12' WHEN 2 THEN 'Applied:14' ELSE 'Applied:13' END END"),
    "fail_post": (_RUNTIME, "", f"CASE WHEN a <> 0 THEN {_W} WHEN status > 2 THEN {_T} WHEN n = 0 THEN 'Refused:InvalidSchema' ELSE 'Applied:9' END"),
    "fail_receipt": (_RUNTIME, "", f"CASE WHEN a <> 0 THEN {_W} WHEN status <> 2 THEN {_T} WHEN n = 0 THEN 'Refused:InvalidSchema' ELSE 'Applied:10' END"),
    "fail_testament": (_RUNTIME, "", f"CASE WHEN a <> 0 THEN {_W} WHEN status NOT IN (3, 4) THEN {_T} WHEN n = 0 THEN 'Refused:InvalidSchema' ELSE 'Applied:11' END"),
    "cancel": (_ISSUER, "", f"CASE WHEN status >= 8 THEN {_T} WHEN a <> issuer THEN {_W} ELSE 'Applied:15' END"),
    "revoke": (_RUNTIME, "", f"CASE WHEN a <> 0 THEN {_W} WHEN status >= 8 THEN {_T} ELSE 'Applied:17' END"),
    "expire": (_RUNTIME, "", f"CASE WHEN a <> 0 THEN {_W} WHEN status >= 8 THEN 'Noop' WHEN n * 86400000000 < deadline_at THEN 'Refused:DeadlineNotDue' ELSE 'Applied:16' END"),
    "supersede": (_ISSUER, "LEFT JOIN (SELECT claim_id AS sc, issuer AS issuer2, subject AS subject2 FROM b) ON sc = n",
        f"CASE WHEN a <> issuer THEN {_W} WHEN NOT coalesce(issuer2 = issuer AND subject2 = subject AND claim_id % 7 = 0, FALSE) THEN 'Refused:InvalidRelation' WHEN status >= 8 THEN {_STAYS} ELSE 'Applied:18' END"),
    "register_monitor": (_ISSUER, "LEFT JOIN (SELECT monitor_id FROM monitors) ON monitor_id = claim_id",
        f"CASE WHEN status >= 8 THEN {_T} WHEN a <> issuer THEN {_W} WHEN monitor_id IS NOT NULL THEN 'Refused:ObjectIdConflict' WHEN deadline_at <= {NOW} THEN 'Refused:MissingDeadline' WHEN n NOT IN (SELECT claim_id FROM b) THEN 'Refused:UnknownObject' ELSE {_STAYS} END"),
    "release_scope": (_RUNTIME, "", f"CASE WHEN a <> 0 THEN {_W} WHEN status < 8 OR claim_id IN (SELECT target FROM edges JOIN b ON b.claim_id = source WHERE relation = 8 AND NOT released) THEN 'Informed:DependencyPending' ELSE {_STAYS} END"),
    "register_artifact": (_RUNTIME, "LEFT JOIN (SELECT artifact_id, min(artifact_id) OVER (PARTITION BY hash) AS first FROM artifacts) ON artifact_id = n",
        f"CASE WHEN a <> 0 THEN {_W} WHEN first IS NULL THEN 'Refused:UnknownObject' WHEN first < n THEN 'Duplicate:' || first ELSE 'Applied:0' END"),
    "expire_monitor": (_RUNTIME, "LEFT JOIN (SELECT monitor_id, m.released AS gone, b.deadline_at AS due FROM monitors m JOIN b ON b.claim_id = owner) ON monitor_id = claim_id",
        f"CASE WHEN a <> 0 THEN {_W} WHEN due IS NULL THEN 'Refused:UnknownObject' WHEN gone THEN 'Noop' WHEN n * 86400000000 < due THEN 'Refused:DeadlineNotDue' ELSE 'Applied:16' END"),
}


def sql(name: str) -> str:
    """The oracle of a command, behind the ledger's common table expressions."""
    who, joins, outcome = _SQL[name]
    asked = f"c AS (SELECT *, CAST({_NUMBERS.get(name, 'claim_id % 3')} AS BIGINT) AS n, CAST(CASE WHEN claim_id % 11 = 3 THEN 999 ELSE {who} END AS BIGINT) AS a FROM b)"
    return f", {_STATE}, {_RUNS}, {asked} SELECT claim_id, a AS actor, n, {outcome} AS outcome FROM c {joins}"


def run(ledger: Ledger, name: str) -> DataFrame:
    state = staged(ledger)
    return commands.outcomes(state, name, proposals(state, name), NOW)
