"""The registered queries of ``operators.lists``: name -> (query, SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators import graph, lists
from ..sources.ledger import Ledger

_RUNS = "runs AS (SELECT validation_id, max(attempt) AS attempts, max(CASE WHEN r = 1 THEN verdict END) AS final FROM (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY attempt DESC) AS r FROM verdicts) GROUP BY 1)"
_SEED = ", ".join(str(3 * k) for k in range(200))


def _references(L: Ledger) -> DataFrame:
    """Sets of the artifacts of one producer and size class; every 17th reference names another content."""
    own = F.when(F.col("artifact_id") % 17 == 4, F.lit("0")).otherwise(F.col("hash"))
    return L.artifacts.select((F.col("artifact_id") % 40).alias("set_id"), "artifact_id", own.alias("hash"))


def _requests(L: Ledger) -> DataFrame:
    c = F.col("claim_id")
    return L.claims.select(c.alias("session"), (c % 4).alias("owner"), F.when(c % 5 == 0, c % 3).otherwise(c % 4).alias("routed"), (c % 4).alias("asked"),
                           F.when(c % 3 == 0, c % 100).alias("cut"), (c % 2 == 0).alias("is_read"), (c % 150).alias("prefix"))


QUERIES: dict[str, tuple[Callable[[Ledger], DataFrame], str]] = {
    "seed_scan": (lambda L: lists.seed(L, [3 * k for k in range(200)], 500),
        f"""SELECT 1 AS kind, claim_id AS id FROM claims WHERE claim_id IN ({_SEED}) AND created <= 500 UNION ALL SELECT 2, r.claim_id * 1000 + cycle FROM responses r JOIN claims c ON c.claim_id = r.claim_id
        WHERE c.claim_id IN ({_SEED}) AND created <= 500 UNION ALL SELECT 3, validation_id FROM validations v JOIN claims c ON c.claim_id = v.claim_id WHERE c.claim_id IN ({_SEED}) AND created <= 500"""),
    "native_claim_evaluations": (lambda L: lists.evaluations(L, claim=33), "SELECT claim_id, v.validation_id, attempt, verdict FROM verdicts r JOIN validations v ON v.validation_id = r.validation_id WHERE claim_id = 33"),
    "declaration_evaluations": (lambda L: lists.evaluations(L, claim=33, validation=265), "SELECT 33 AS claim_id, validation_id, attempt, verdict FROM verdicts WHERE validation_id = 265 AND EXISTS (SELECT 1 FROM validations WHERE claim_id = 33 AND validation_id = 265)"),
    "native_list_evaluations": (lambda L: lists.evaluations(L, verdict=3), "SELECT claim_id, validation_id, attempt, verdict FROM verdicts JOIN validations USING (validation_id) WHERE verdict = 3"),
    "native_list_definitions": (lambda L: lists.definitions(L, 7), "SELECT v.claim_id, validation_id, kind AS place FROM validations v, claims c WHERE c.claim_id = v.claim_id AND 7 IN (evaluator, issuer)"),
    "native_list_receipts": (lambda L: lists.receipts(L, 17), "SELECT claim_id, cycle AS epoch, cycle = max(cycle) OVER (PARTITION BY claim_id) AS current FROM responses WHERE claim_id IN (SELECT claim_id FROM claims WHERE subject = 17)"),
    "native_list_monitors": (lambda L: lists.monitors_of(L, 4), "SELECT monitor_id, released, root, predicate FROM monitors JOIN monitor_roots USING (monitor_id) WHERE owner = 4"),
    "native_list_events": (lambda L: L.deltas.where("sequence > 50 OR (sequence = 50 AND ordinal > 1)").select("sequence", "ordinal", "claim_id", "action"),
        "SELECT sequence, ordinal, claim_id, action FROM deltas WHERE (sequence, ordinal) > (50, 1)"),
    "native_list_claims": (lambda L: lists.claims_where(L, vocab.CAUSED_BY, 3, 20, (1, 2)),
        "SELECT claim_id FROM claims WHERE created > 20 AND claim_id IN (SELECT source FROM edges WHERE relation = 8 AND target = 3) AND claim_id IN (SELECT claim_id FROM validations WHERE kind = 1) AND claim_id IN (SELECT claim_id FROM validations WHERE kind = 2)"),
    "select_scopes": (lambda L: lists.having_all(L.validations, "claim_id", "kind", (1, 3, 5)),
        "SELECT claim_id FROM validations GROUP BY 1 HAVING list_contains(list(kind), 1) AND list_contains(list(kind), 3) AND list_contains(list(kind), 5)"),
    "select_inputs": (lambda L: lists.having_all(L.artifacts, "producer", "kind", ("en", "de")),
        "SELECT producer FROM artifacts GROUP BY 1 HAVING count(CASE WHEN kind = 'en' THEN 1 END) > 0 AND count(CASE WHEN kind = 'de' THEN 1 END) > 0"),
    "select_outcome_confidence": (lambda L: L.responses.where("author = 'assistant' AND size = 120").select("claim_id", "cycle"), "SELECT claim_id, cycle FROM responses WHERE author = 'assistant' AND size = 120"),
    "relation_match": (lambda L: lists.evidence(L.artifacts.select(F.col("artifact_id").alias("id"), "hash"), L.artifacts.select(F.col("artifact_id").alias("id"), F.when(F.col("artifact_id") % 3 == 1, F.col("hash")).when(F.col("artifact_id") % 3 == 2, "0").alias("hash"))),
        "SELECT DISTINCT artifact_id AS id, hash FROM artifacts WHERE artifact_id % 3 <> 2"),
    "testament_manifest": (lambda L: lists.manifest(_references(L), L.artifacts),
        "SELECT artifact_id % 40 AS set_id, count(*) AS pieces, count(CASE WHEN artifact_id % 17 = 4 THEN 1 END) = 0 AS valid FROM artifacts GROUP BY 1"),
    "validation_context": (lists.context, f"""WITH {_RUNS} SELECT v.validation_id, v.claim_id, status, evaluator, attempts, final, (SELECT max(cycle) FROM responses r WHERE r.claim_id = v.claim_id) AS cycle
        FROM validations v JOIN claims c ON c.claim_id = v.claim_id LEFT JOIN runs ON runs.validation_id = v.validation_id WHERE mode = 2"""),
    "object_count_budget": (lambda L: lists.count_budget(L, 1_000_000), """SELECT CAST(n AS BIGINT) AS objects, n <= 1000000 AS within FROM (SELECT (SELECT count(*) FROM claims) + (SELECT count(*) FROM validations) + (SELECT count(*) FROM artifacts)
        + (SELECT count(*) FROM responses) + (SELECT count(*) FROM monitors) AS n)"""),
    "blocking_cause": (lambda L: L.verdicts.select("validation_id", "attempt", lists.cause(F.col("verdict")).alias("cause")).where("cause IS NOT NULL"),
        "SELECT validation_id, attempt, ['Failed', 'Incomplete', 'Errored'][verdict - 1] AS cause FROM verdicts WHERE verdict > 1"),
    "artifact_outcome": (lists.artifact_outcomes, """, f AS (SELECT validation_id, arg_min(verdict, attempt) AS verdict FROM verdicts WHERE verdict IS NOT NULL GROUP BY 1)
        SELECT claim_id, CASE WHEN max(coalesce(verdict, 0)) > 1 THEN 'Blocked' WHEN min(coalesce(verdict, 0)) = 1 THEN 'Passed' ELSE 'Pending' END AS outcome FROM validations LEFT JOIN f USING (validation_id) WHERE mode = 2 GROUP BY 1"""),
    "audit_complete": (lists.audit_complete, f"""WITH {_RUNS} SELECT v.claim_id, count(CASE WHEN final IS NULL AND status < 8 AND (attempts IS NOT NULL OR mode = 2) THEN 1 END) = 0 AS complete
        FROM validations v JOIN claims c ON c.claim_id = v.claim_id LEFT JOIN runs ON runs.validation_id = v.validation_id GROUP BY 1"""),
    "edges_project": (lists.all_edges, """, v AS (SELECT validations.*, created FROM validations JOIN claims USING (claim_id))
        SELECT 'Relation' AS kind, source, target, introduced FROM edges UNION ALL SELECT 'ValidationOf', validation_id, claim_id, created FROM v UNION ALL SELECT 'Requirement', claim_id, validation_id, created FROM v WHERE mode = 2
        UNION ALL SELECT 'Evaluator', validation_id, evaluator, created FROM v UNION ALL SELECT 'TestamentOf', claim_id * 1000 + cycle, claim_id, created + cycle FROM responses JOIN claims USING (claim_id)
        UNION ALL SELECT 'Watches', monitor_id, root, created FROM monitors JOIN monitor_roots USING (monitor_id) JOIN claims ON claim_id = owner"""),
    "native_wait_settled": (lambda L: lists.wait_settled(L.claims, L.claims.where("status = 8 OR (status = 7 AND local_complete)")),
        "SELECT claim_id, status = 8 OR (status = 7 AND local_complete) AS satisfied, status >= 8 OR (status = 7 AND local_complete) AS terminal FROM claims"),
    "route_lookup": (lambda L: lists.routes(L.claims.select(F.col("claim_id").alias("session"), (F.col("claim_id") % 4).alias("epoch")), L.responses.select(F.col("claim_id").alias("session"), F.col("cycle").cast("bigint").alias("epoch"), (F.col("cycle") * 10).alias("leader"))),
        """SELECT claim_id AS session, CASE WHEN claim_id % 4 >= m THEN m * 10 END AS leader, CASE WHEN m IS NULL THEN 'None' WHEN claim_id % 4 < m THEN 'Stale' ELSE 'Current' END AS route
        FROM claims LEFT JOIN (SELECT claim_id, max(cycle) AS m FROM responses GROUP BY 1) USING (claim_id)"""),
    "serving_fence": (lambda L: lists.served(_requests(L)), """SELECT claim_id AS session, CASE WHEN claim_id % 5 = 0 AND claim_id % 3 <> claim_id % 4 THEN 'Fenced'
        WHEN claim_id % 3 = 0 AND NOT (claim_id % 2 = 0 AND claim_id % 150 <= claim_id % 100) THEN 'CutOver' ELSE 'Served' END AS served FROM claims"""),
    "read_consistency": (lambda L: L.claims.select("claim_id", lists.readable(F.lit(1000), F.element_at(F.array(*map(F.lit, ("Linearizable", "AtLeast", "Exact", "StaleProjection"))), (F.col("claim_id") % 4 + 1).cast("int")), F.col("created")).alias("read")),
        "SELECT claim_id, CASE WHEN claim_id % 4 IN (1, 2) AND created > 1000 THEN 'NotYet' WHEN claim_id % 4 = 2 THEN 'At:' || created ELSE 'At:1000' END AS read FROM claims"),
    "history_match": (lambda L: lists.history(L.samples.select(F.col("request").alias("call")), L.deltas.where("status > 1").select(F.col("event_id").alias("call")).union(L.deltas.where("status = 8").select("event_id")), L.samples.where("outcome IN ('signup', 'click')").select(F.col("request").alias("call"))),
        """, p AS (SELECT event_id AS call, count(*) AS n FROM (SELECT event_id FROM deltas WHERE status > 1 UNION ALL SELECT event_id FROM deltas WHERE status = 8) GROUP BY 1)
        SELECT request AS call, CASE WHEN coalesce(n, 0) > 1 THEN 'Repeated' WHEN outcome IN ('signup', 'click') AND n IS NULL THEN 'Lost' WHEN outcome IN ('signup', 'click') THEN 'Done' WHEN n > 0 THEN 'Open' ELSE 'Pending' END AS state
        FROM samples LEFT JOIN p ON p.call = request"""),
    "traverse_stop": (lambda L: graph.bounded(L.edges, L.claims.where("claim_id = 0").select(F.col("claim_id").alias("id")), depth=3, nodes=400, forward=False), """, walk AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS depth UNION SELECT source, depth + 1 FROM walk JOIN edges ON target = id WHERE depth < 4),
        d AS (SELECT id, min(depth) AS depth FROM walk GROUP BY 1), c AS (SELECT depth, sum(count(*)) OVER (ORDER BY depth) AS n FROM d GROUP BY 1)
        SELECT CASE WHEN (SELECT coalesce(min(depth), 99) FROM c WHERE n > 400) <= 3 THEN 'NodeLimit' WHEN EXISTS (SELECT 1 FROM d WHERE depth = 4) THEN 'DepthLimit' ELSE 'Complete' END AS stop,
               CAST((SELECT max(n) FROM c WHERE depth <= 3 AND n <= 400) AS BIGINT) AS nodes"""),
}
