"""The registered ledger queries: for each a DataFrame over the sample ledger, and an independent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import scalars
from ..operators import commands, derive, fleet, graph, measure, reads
from ..sources.ledger import Ledger, duckdb_prefix, sample_ledger
from ..streaming import deltas as stream
from . import commands as proposed
from . import lists as listed

Query = Callable[[Ledger], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}
#: The spacing of bins and gaps, and a time in May 1995, in microseconds.
DAY = 86_400_000_000
DUE = 800_000_000_000_000


def query(name: str, sql: str | None):
    def put(f: Query) -> Query:
        _FOUND[name] = (f, sql)
        return f
    return put


def _without(L: Ledger, edges: DataFrame, end: str) -> DataFrame:
    """(id): the claims that are at this end of none of the edges."""
    return L.claims.select(F.col("claim_id").alias("id")).join(edges.select(F.col(end).alias("id")), "id", "left_anti")


def _rows(L: Ledger, sql: str) -> DataFrame:
    return L.claims.sparkSession.sql(sql)


# Reads and lists

query("get_object", "SELECT claim_id, issuer, status FROM claims WHERE claim_id = 77")(
    lambda L: reads.get_object(L.claims, "claim_id", 77).select("claim_id", "issuer", "status"))
query("get_objects", "SELECT ord, w.claim_id, c.claim_id IS NOT NULL AS found FROM (SELECT range AS ord, range * 700 AS claim_id FROM range(40)) w LEFT JOIN claims c ON c.claim_id = w.claim_id")(
    lambda L: reads.get_objects(L.claims, "claim_id", _rows(L, "SELECT id AS ord, id * 700 AS claim_id FROM range(40)")))
query("identity_lookup", "SELECT hash, min(artifact_id) AS artifact_id FROM artifacts WHERE hash IN (SELECT hash FROM artifacts WHERE artifact_id % 10 = 3) GROUP BY hash")(
    lambda L: reads.identity_lookup(L.artifacts, L.artifacts.where("artifact_id % 10 = 3").select("hash")))
query("scan_objects", "SELECT claim_id, status, created FROM claims")(lambda L: L.claims.select("claim_id", "status", "created").orderBy("claim_id"))
query("scan_by_claim", """SELECT 1 AS kind, claim_id AS id, claim_id FROM claims UNION ALL SELECT 2, cycle, claim_id FROM responses UNION ALL SELECT 3, validation_id, claim_id FROM validations
    UNION ALL SELECT 4, artifact_id, claim_id FROM artifacts JOIN responses ON cycle = 1 AND artifact_id = claim_id""")(
    lambda L: reads.by_claim(L, L.claims.select("claim_id").union(L.responses.select("claim_id")).union(L.validations.select("claim_id")).distinct(),
                             L.responses.where("cycle = 1").select("claim_id", F.col("claim_id").alias("artifact_id"))))
query("scan_status", "SELECT claim_id, issuer FROM claims WHERE status = 8")(lambda L: reads.list_family(L, "claims", status=8).select("claim_id", "issuer"))
query("scan_deadlines_through", f"SELECT claim_id, deadline_at FROM claims WHERE status < 8 AND deadline_at <= {DUE}")(lambda L: reads.deadlines_through(L.claims, DUE))
query("scan_required", "SELECT phase, validation_id FROM validations WHERE claim_id = 33 AND mode = 2")(lambda L: reads.required(L.validations, 33))
query("scan_forward", "SELECT target, relation FROM edges WHERE source = 19")(lambda L: reads.adjacent(L.edges, 19))
query("scan_reverse", "SELECT source, relation FROM edges WHERE target = 19")(lambda L: reads.adjacent(L.edges, 19, forward=False))
query("objects_after", "SELECT status, claim_id FROM claims WHERE (status, claim_id) > (7, 500) ORDER BY status, claim_id LIMIT 50")(
    lambda L: reads.after(L.claims.select("status", "claim_id"), ["status", "claim_id"], (7, 500), 50))
query("artifact_after", "SELECT artifact_id, hash FROM artifacts WHERE artifact_id > 100 ORDER BY artifact_id LIMIT 25")(
    lambda L: reads.after(L.artifacts.select("artifact_id", "hash"), ["artifact_id"], (100,), 25))
query("validation_results", """SELECT validation_id, CAST(NULL AS INT) AS attempt, verdict, attempt AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY attempt DESC) AS r FROM verdicts) WHERE r = 1
    UNION ALL SELECT validation_id, CAST(attempt AS INT), verdict, NULL FROM verdicts""")(lambda L: reads.validation_results(L.verdicts, L.validations))
query("list_claims", "SELECT claim_id, issuer, subject, status FROM claims WHERE status = 8 AND action = 3")(
    lambda L: reads.list_family(L, "claims", status=8, action=3).select("claim_id", "issuer", "subject", "status"))
query("list_validations", "SELECT validation_id, claim_id, evaluator FROM validations WHERE phase = 2 AND mode = 2 AND kind = 1")(
    lambda L: reads.list_family(L, "validations", phase=2, mode=2, kind=1).select("validation_id", "claim_id", "evaluator"))
query("list_artifacts", "SELECT artifact_id, hash FROM artifacts WHERE kind = 'en' AND producer = 'src3'")(
    lambda L: reads.list_family(L, "artifacts", kind="en", producer="src3").select("artifact_id", "hash"))
query("list_testaments", "SELECT claim_id, cycle FROM responses WHERE author = 'assistant'")(lambda L: reads.list_family(L, "responses", author="assistant").select("claim_id", "cycle"))
query("select_relations", """SELECT e.source FROM (SELECT DISTINCT source FROM edges WHERE relation = 7 AND target = source + 1) e
    JOIN (SELECT DISTINCT source FROM edges WHERE relation = 7 AND target - source = 1) f ON e.source = f.source""")(
    lambda L: reads.with_all_relations(L.edges, _rows(L, "SELECT 7 AS relation, 1L AS offset")))
query("select_created_range", "SELECT claim_id, created FROM claims WHERE created > 100 AND created <= 900")(lambda L: reads.created_range(L.claims, 100, 900).select("claim_id", "created"))
query("list_validators", "SELECT DISTINCT claim_id FROM validations WHERE evaluator BETWEEN 1 AND 5 AND kind = 2")(lambda L: reads.handlers_match(L.validations, 1, 5, 2))
query("native_list_responses", "SELECT cycle, author, CAST(size AS INT) AS size FROM responses WHERE claim_id = 5")(lambda L: reads.responses_newest_first(L.responses, 5))
query("native_list_deliveries", """SELECT created AS sequence, 'posted' AS kind, claim_id FROM claims WHERE subject = 10 AND status >= 2 AND created > 50
    UNION ALL SELECT created + cycle, 'response', c.claim_id FROM claims c JOIN responses r ON c.claim_id = r.claim_id WHERE issuer % 100 = 10 AND created + cycle > 50""")(
    lambda L: reads.deliveries(L, 10, 50))
query("keyset_page", """SELECT artifact_id, size FROM (SELECT artifact_id, size, sum(size) OVER (ORDER BY artifact_id) AS t FROM (SELECT * FROM artifacts ORDER BY artifact_id LIMIT 40)) WHERE t <= 100000""")(
    lambda L: reads.page(L.artifacts.select("artifact_id", "size"), ["artifact_id"], "size", 40, 100_000))
query("read_at_prefix", "SELECT status, count(*) AS n FROM claims WHERE created <= 1000 GROUP BY status")(lambda L: L.at(1000).claims.groupBy("status").agg(F.count("*").alias("n")))

# Joins and aggregates

query("claim_expand", """SELECT c.claim_id, c.status, coalesce(r.n, 0) AS responses, latest, coalesce(v.n, 0) AS checks FROM claims c
    LEFT JOIN (SELECT claim_id, count(*) AS n, max(cycle) AS latest FROM responses GROUP BY 1) r ON r.claim_id = c.claim_id
    LEFT JOIN (SELECT claim_id, count(*) AS n FROM validations GROUP BY 1) v ON v.claim_id = c.claim_id""")(derive.expand)
query("dangling_edges", "SELECT source, relation, target FROM edges WHERE target NOT IN (SELECT claim_id FROM claims WHERE created <= 700)")(lambda L: derive.dangling(L.edges, L.at(700).claims))
query("dependency_status", "SELECT source AS claim_id, target, status AS target_status FROM edges LEFT JOIN claims ON claim_id = target WHERE relation = 6")(derive.dependency_status)
query("monitor_settlement", """SELECT monitor_id, bool_and(coalesce(CASE WHEN predicate = 1 THEN status = 8 ELSE status >= 8 END, FALSE)) AS settled
    FROM monitor_roots LEFT JOIN claims ON claim_id = root GROUP BY 1""")(derive.monitor_settlement)
query("range_route", "SELECT key, max(start) AS start FROM (SELECT claim_id AS key FROM claims) JOIN (SELECT claim_id AS start FROM claims WHERE claim_id % 64 = 0) ON start <= key GROUP BY key")(
    lambda L: derive.range_route(L.claims.where("claim_id % 64 = 0").select(F.col("claim_id").alias("start")), L.claims.select(F.col("claim_id").alias("key")), 64))
query("read_plan_fragments", "SELECT greatest(claim_id, 150) AS start, least(claim_id + 64, 1111) AS \"end\" FROM claims WHERE claim_id % 64 = 0 AND greatest(claim_id, 150) < least(claim_id + 64, 1111)")(
    lambda L: derive.overlaps(L.claims.where("claim_id % 64 = 0").select(F.col("claim_id").alias("start"), (F.col("claim_id") + 64).alias("end")), 150, 1111))
query("ledger_summary", "SELECT 'claims' AS family, count(*) AS n FROM claims UNION ALL SELECT 'responses', count(*) FROM responses UNION ALL SELECT 'validations', count(*) FROM validations UNION ALL SELECT 'artifacts', count(*) FROM artifacts UNION ALL SELECT 'monitors', count(*) FROM monitors")(derive.summary)
_RUNS = "runs AS (SELECT validation_id, max(attempt) AS attempts, max(CASE WHEN r = 1 THEN verdict END) AS final FROM (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY attempt DESC) AS r FROM verdicts) GROUP BY 1)"
query("run_summary", f"WITH {_RUNS} SELECT * FROM runs")(lambda L: derive.runs(L.verdicts))
for _name, _phase in (("phase_admission", 1), ("phase_increment", 2), ("phase_whole_work", 3)):
    query(_name, f"""WITH {_RUNS} SELECT c.claim_id, coalesce(bool_and(CASE WHEN v.validation_id IS NULL THEN NULL ELSE final IS NOT NULL END), TRUE) AS complete,
        coalesce(bool_and(CASE WHEN v.validation_id IS NULL THEN NULL ELSE coalesce(final = 1, FALSE) END), TRUE) AS passed
        FROM claims c LEFT JOIN (SELECT * FROM validations WHERE mode = 2 AND phase = {_phase}) v ON v.claim_id = c.claim_id LEFT JOIN runs ON runs.validation_id = v.validation_id GROUP BY c.claim_id""")(
        lambda L, p=_phase: derive.phase_state(L, p))
_VERDICT = f"""{_RUNS}, worst AS (SELECT claim_id, count(*) = count(final) AS done, max(CASE final WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 WHEN 2 THEN 3 END) AS s
    FROM validations LEFT JOIN runs USING (validation_id) WHERE mode = 2 AND phase > 1 GROUP BY 1),
    verdict AS (SELECT claim_id, status, CASE WHEN done THEN CASE s WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 2 END END AS verdict FROM claims LEFT JOIN worst USING (claim_id))"""
query("claim_verdict", f"WITH {_VERDICT} SELECT claim_id, verdict FROM verdict")(derive.claim_verdicts)
query("verdict_by_status", f"WITH {_VERDICT} SELECT status, verdict, count(*) AS n FROM verdict GROUP BY 1, 2")(
    lambda L: derive.claim_verdicts(L).join(L.claims.select("claim_id", "status"), "claim_id").groupBy("status", "verdict").agg(F.count("*").alias("n")))
query("completion_status", f"WITH {_VERDICT} SELECT claim_id, CASE verdict WHEN 2 THEN 13 WHEN 4 THEN 14 WHEN 3 THEN 12 END AS next_status, coalesce(verdict = 1, FALSE) AS complete FROM verdict WHERE status = 7")(derive.completions)
query("acceptance", f"""WITH {_VERDICT}, ph AS (SELECT claim_id, bool_and(coalesce(final = 1, FALSE)) FILTER (WHERE phase = 1) AS p1, bool_and(coalesce(final = 1, FALSE)) FILTER (WHERE phase = 2) AS p2
    FROM validations LEFT JOIN runs USING (validation_id) WHERE mode = 2 GROUP BY 1)
    SELECT claim_id, CASE WHEN coalesce(p1, TRUE) AND coalesce(p2, TRUE) AND verdict = 1 THEN 'Complete' WHEN verdict > 1 THEN 'Blocked' ELSE 'Pending' END AS outcome
    FROM verdict LEFT JOIN ph USING (claim_id) WHERE status = 7""")(derive.acceptance)
query("latest_evaluation", "SELECT claim_id, cycle, author FROM responses r WHERE cycle = (SELECT max(cycle) FROM responses s WHERE s.claim_id = r.claim_id)")(
    lambda L: derive.latest(L.responses, "claim_id", "cycle").select("claim_id", "cycle", "author"))
query("current_status_from_deltas", "SELECT claim_id, arg_max(status, sequence * 10 + ordinal) AS status, count(*) AS changes FROM deltas GROUP BY 1")(lambda L: derive.latest_status(L.deltas))
query("slot_coverage", "SELECT kind, producer, artifact_id, hash FROM (SELECT *, row_number() OVER (PARTITION BY kind, producer ORDER BY artifact_id, hash) AS r FROM artifacts) WHERE r = 1")(lambda L: derive.first_witness(L.artifacts))
query("counter_totals", """SELECT worker, CAST(sum(CASE WHEN p IS NULL OR latency < p THEN latency ELSE latency - p END) AS BIGINT) AS total
    FROM (SELECT *, lag(latency) OVER (PARTITION BY worker ORDER BY request) AS p FROM samples) GROUP BY 1""")(lambda L: derive.counter_totals(L.samples))
query("audit_cohort", """SELECT validation_id, bool_and(attempt = r) AS contiguous, NOT coalesce(bool_or(verdict = 1 AND nxt IS NOT NULL), FALSE) AS sealed FROM
    (SELECT *, row_number() OVER (PARTITION BY validation_id ORDER BY attempt) AS r, lead(attempt) OVER (PARTITION BY validation_id ORDER BY attempt) AS nxt FROM verdicts) GROUP BY 1""")(lambda L: derive.audit(L.verdicts))
query("state_diff", """SELECT coalesce(a.claim_id, b.claim_id) AS claim_id, CASE WHEN a.claim_id IS NULL THEN 'added' WHEN b.claim_id IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM (SELECT claim_id, status FROM claims WHERE created <= 9000) a FULL JOIN (SELECT claim_id, CASE WHEN claim_id % 50 = 0 THEN 16 ELSE status END AS status FROM claims WHERE claim_id % 40 <> 7) b ON a.claim_id = b.claim_id
    WHERE a.claim_id IS NULL OR b.claim_id IS NULL OR a.status <> b.status""")(
    lambda L: derive.diff(L.at(9000).claims.select("claim_id", "status"), L.claims.where("claim_id % 40 <> 7").select("claim_id", F.when(F.col("claim_id") % 50 == 0, 16).otherwise(F.col("status")).alias("status")), "claim_id"))
query("index_audit", """SELECT (SELECT count(*) FROM (SELECT status, claim_id FROM claims EXCEPT ALL SELECT status, claim_id FROM claims WHERE claim_id % 97 <> 5)) AS missing,
    (SELECT count(*) FROM (SELECT status, claim_id FROM claims WHERE claim_id % 97 <> 5 EXCEPT ALL SELECT status, claim_id FROM claims)) AS extra""")(
    lambda L: derive.audit_index(L.claims.where("claim_id % 97 <> 5").select("status", "claim_id"), L.claims.select("status", "claim_id")))
query("dup_in_batch", """SELECT b.hash, n, old.hash IS NOT NULL AS existing FROM (SELECT hash, count(*) AS n FROM artifacts WHERE artifact_id >= 500 GROUP BY 1) b
    LEFT JOIN (SELECT DISTINCT hash FROM artifacts WHERE artifact_id < 500) old ON old.hash = b.hash WHERE n > 1 OR old.hash IS NOT NULL""")(
    lambda L: derive.duplicates(L.artifacts.where("artifact_id < 500"), L.artifacts.where("artifact_id >= 500")))
query("failure_witness", """SELECT claim_id, target AS witness FROM (SELECT c.claim_id, e.target, row_number() OVER (PARTITION BY c.claim_id ORDER BY t.created, t.claim_id) AS r
    FROM claims c JOIN edges e ON e.source = c.claim_id AND relation = 6 JOIN claims t ON t.claim_id = e.target WHERE c.status < 8 AND t.status > 8) WHERE r = 1""")(derive.failure_witness)
query("due_timers", f"""SELECT "at", timer, id FROM (SELECT deadline_at AS "at", 'claim' AS timer, claim_id AS id FROM claims WHERE status < 8
    UNION ALL SELECT deadline_at, 'monitor', monitor_id FROM monitors JOIN claims ON owner = claim_id WHERE NOT monitors.released) WHERE "at" <= {DUE} ORDER BY "at", timer, id LIMIT 64""")(lambda L: derive.due_timers(L, DUE))
query("retirement_candidates", "SELECT status, claim_id FROM claims WHERE status >= 8 AND released ORDER BY status, claim_id LIMIT 200")(lambda L: derive.retirement_candidates(L.claims, 200))

# Measures

_RANKED = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {t}"
_PICK = "max(CASE WHEN i = floor(((n - 1) * {q} + 500) / 1000) THEN latency END) AS {p}"
_PICKS = ", ".join(_PICK.format(q=q, p=p) for p, q in measure.POINTS.items())
query("write_report", f"SELECT outcome, max(n) AS n, {_PICKS}, max(latency) AS max FROM ({_RANKED.format(k='outcome', t='samples')}) GROUP BY 1")(lambda L: measure.nearest_rank(L.samples, ["outcome"]))
query("percentiles_nearest_rank", f"SELECT worker, outcome, max(n) AS n, {_PICKS}, max(latency) AS max FROM ({_RANKED.format(k='worker, outcome', t='samples')}) GROUP BY 1, 2")(lambda L: measure.nearest_rank(L.samples, ["worker", "outcome"]))
query("throughput", "SELECT count(*) AS n, round(count(*) / ((max(start) - min(start)) / 1e6), 6) AS per_second FROM samples")(lambda L: measure.throughput(L.samples))
query("status_transitions", "SELECT previous, status, count(*) AS n FROM (SELECT status, lag(status) OVER (PARTITION BY claim_id ORDER BY sequence, ordinal) AS previous FROM deltas) GROUP BY 1, 2")(lambda L: measure.transitions(L.deltas))
query("ordinal_gaps", "SELECT sequence, ordinal FROM (SELECT *, lag(ordinal) OVER (PARTITION BY sequence ORDER BY ordinal) AS p FROM deltas WHERE event_id % 17 <> 3) WHERE ordinal <> coalesce(p + 1, 0)")(
    lambda L: measure.ordinal_gaps(L.deltas.where("event_id % 17 <> 3")))
query("prefix_contiguity", "SELECT sequence FROM (SELECT sequence, lag(sequence) OVER (ORDER BY sequence) AS p FROM (SELECT DISTINCT sequence FROM deltas WHERE sequence % 13 <> 5)) WHERE p IS NOT NULL AND sequence <> p + 1")(
    lambda L: measure.sequence_gaps(L.deltas.where("sequence % 13 <> 5")))
query("rtt_median_mad", """SELECT worker, request, m AS median, list_sort(list_transform(v, lambda x: abs(x - m)))[len(v) // 2 + 1] AS mad, m + greatest(4 * list_sort(list_transform(v, lambda x: abs(x - m)))[len(v) // 2 + 1], 1000) AS tail
    FROM (SELECT *, v[len(v) // 2 + 1] AS m FROM (SELECT worker, request, list_sort(list(latency) OVER (PARTITION BY worker ORDER BY request ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)) AS v FROM samples))""")(lambda L: measure.rtt_tail(L.samples))
query("rtt_ewma", """, numbered AS (SELECT worker, latency, row_number() OVER (PARTITION BY worker ORDER BY request) AS i FROM samples),
    fold AS (SELECT worker, i, latency AS s, latency >> 1 AS v FROM numbered WHERE i = 1
    UNION ALL SELECT n.worker, n.i, f.s - (f.s >> 3) + (n.latency >> 3), f.v - (f.v >> 2) + (abs(f.s - n.latency) >> 2) FROM fold f JOIN numbered n ON n.worker = f.worker AND n.i = f.i + 1)
    SELECT worker, arg_max(s, i) AS smoothed, arg_max(v, i) AS variation FROM fold GROUP BY 1""")(lambda L: measure.rtt_ewma(L.samples))
_BIN = f"(SELECT *, CAST(floor(start / {DAY * 1.0}) AS BIGINT) AS bin FROM samples)"
query("tumbling_latency", f"SELECT bin, max(n) AS n, {_PICK.format(q=500, p='p50')}, {_PICK.format(q=990, p='p99')}, max(latency) AS max, count(*) FILTER (WHERE latency > 90000) AS slow FROM ({_RANKED.format(k='bin', t=_BIN)}) GROUP BY 1")(
    lambda L: measure.tumbling(L.samples, DAY, 90_000))
query("slow_clusters", f"""SELECT worker, min(start) AS start, max(start) AS "end", count(*) AS n, max(latency) AS worst FROM (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY start, request) AS c FROM
    (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY worker ORDER BY start, request) <= {DAY} THEN 0 ELSE 1 END AS new FROM samples WHERE latency > 60000)) GROUP BY worker, c
    ORDER BY worst DESC, start, worker LIMIT 64""")(lambda L: measure.slow_clusters(L.samples, 60_000, DAY))
_HALF = "(SELECT *, CASE WHEN start <= (SELECT floor((min(start) + max(start)) / 2.0) FROM samples) THEN 1 ELSE 2 END AS half FROM samples)"
query("half_split", f"SELECT half, max(n) AS n, {_PICK.format(q=500, p='p50')}, {_PICK.format(q=990, p='p99')}, max(latency) AS max FROM ({_RANKED.format(k='half', t=_HALF)}) GROUP BY 1")(lambda L: measure.halves(L.samples))

# Graph

query("edges_by_relation", "SELECT relation, count(*) AS n, count(DISTINCT target) AS targets FROM edges GROUP BY 1")(
    lambda L: L.edges.groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct("target").alias("targets")))
_ROOTS = "SELECT claim_id AS id FROM claims WHERE claim_id NOT IN (SELECT source FROM edges WHERE relation = 8)"
_LEAVES = "SELECT claim_id AS id FROM claims WHERE claim_id NOT IN (SELECT target FROM edges WHERE relation IN (6, 7))"
query("traverse_bfs", f""", walk AS (SELECT id, 0 AS depth FROM ({_ROOTS}) UNION SELECT source, depth + 1 FROM walk JOIN edges ON target = id WHERE depth < 3)
    SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY 1""")(
    lambda L: graph.traverse(L.edges, _without(L, L.edges.where("relation = 8"), "source"), 3, forward=False))
query("traverse_relations", f""", walk AS (SELECT id, 0 AS depth FROM ({_LEAVES}) UNION SELECT target, depth + 1 FROM walk JOIN edges ON source = id WHERE depth < 20 AND relation IN (6, 7))
    SELECT id, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY 1""")(
    lambda L: graph.traverse(L.edges, _without(L, L.edges.where("relation IN (6, 7)"), "target"), 20, relations=(6, 7)))
query("lineage_ancestors", """, up AS (SELECT source AS claim_id, target AS ancestor, 1 AS distance FROM edges WHERE relation = 8
    UNION ALL SELECT claim_id, target, distance + 1 FROM up JOIN edges ON source = ancestor AND relation = 8 WHERE distance < 16) SELECT claim_id, ancestor, CAST(distance AS INT) AS distance FROM up""")(
    lambda L: graph.ancestors(L.edges, L.claims.select("claim_id")))
query("lineage_followers", "SELECT DISTINCT source AS follower, relation FROM edges WHERE target = 21 AND relation IN (8, 9, 15)")(lambda L: graph.followers(L.edges, 21))
query("least_fixpoint", None)(graph.least_fixpoint)
query("dependency_failed", """, bad AS (SELECT claim_id AS id, 0 AS k FROM claims WHERE status > 8
    UNION SELECT source, k + 1 FROM bad JOIN edges ON target = id AND relation = 6 JOIN claims ON claim_id = source AND status < 8),
    first AS (SELECT id, min(k) AS k FROM bad GROUP BY 1)
    SELECT claim_id, witness, CAST(k AS INT) AS round FROM (SELECT f.id AS claim_id, e.target AS witness, f.k, row_number() OVER (PARTITION BY f.id ORDER BY c.created, e.target) AS r
    FROM first f JOIN edges e ON e.source = f.id AND relation = 6 JOIN first g ON g.id = e.target AND g.k = f.k - 1 JOIN claims c ON c.claim_id = e.target WHERE f.k > 0) WHERE r = 1""")(graph.dependency_failed)
query("cancel_closure", """, below AS (SELECT 3 AS id UNION ALL SELECT source FROM below JOIN edges ON target = id AND relation = 8)
    SELECT claim_id, CASE WHEN claim_id = 3 THEN 17 ELSE 15 END AS status FROM below JOIN claims ON claim_id = id WHERE status < 8 OR claim_id = 3""")(lambda L: graph.cancel_closure(L, 3, 17))
query("release_cascade", """, o AS (SELECT claim_id, status FROM claims WHERE NOT released), p AS (SELECT source, target FROM edges WHERE relation = 8 AND target IN (SELECT claim_id FROM o)),
    up AS (SELECT claim_id AS id, status, claim_id AS top, 0 AS k FROM o UNION ALL SELECT id, status, target, k + 1 FROM up JOIN p ON source = top)
    SELECT top AS claim_id, CAST(max(k) + 1 AS INT) AS round FROM up GROUP BY 1 HAVING bool_and(status >= 8)""")(graph.release_cascade)
_BACK = "SELECT claim_id AS source, target FROM (SELECT claim_id, claim_id * 64 + 9 AS target FROM claims WHERE claim_id IN (1, 2)) WHERE target IN (SELECT claim_id FROM claims)"
query("acyclic_check", f""", g AS (SELECT DISTINCT source, target FROM edges WHERE relation IN (5, 8, 13) UNION {_BACK}), walk AS (SELECT source AS s, target AS t FROM g UNION SELECT s, target FROM walk JOIN g ON source = t)
    SELECT DISTINCT s AS id FROM walk WHERE t IN (SELECT s FROM walk WHERE s = t)""")(
    lambda L: graph.cyclic(L.edges.unionByName(L.claims.where("claim_id IN (1, 2)").select(F.col("claim_id").alias("source"), F.lit(8).alias("relation"), (F.col("claim_id") * 64 + 9).alias("target"), "created")
                                               .join(L.claims.select(F.col("claim_id").alias("target")), "target", "left_semi").withColumnRenamed("created", "introduced"))))
query("cycle_members", """, r AS (SELECT DISTINCT source, target FROM edges WHERE relation = 7) SELECT a.source AS id FROM r a JOIN r b ON a.target = b.source AND b.target = a.source""")(lambda L: graph.cyclic(L.edges, (vocab.AWAITS,)))
query("wait_neighbors", """SELECT DISTINCT source, target FROM (SELECT source, target FROM edges WHERE relation IN (6, 7) UNION ALL SELECT owner, root FROM monitors JOIN monitor_roots USING (monitor_id) WHERE NOT released)
    JOIN claims a ON a.claim_id = source JOIN claims b ON b.claim_id = target WHERE a.status < 8 AND b.status < 8""")(graph.wait_edges)
query("deadlock", """, w AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM edges WHERE relation IN (6, 7) UNION ALL SELECT owner, root FROM monitors JOIN monitor_roots USING (monitor_id) WHERE NOT released)
    JOIN claims a ON a.claim_id = source JOIN claims b ON b.claim_id = target WHERE a.status < 8 AND b.status < 8),
    f AS (SELECT 14 AS id UNION SELECT target FROM f JOIN w ON source = id), b AS (SELECT 14 AS id UNION SELECT source FROM b JOIN w ON target = id),
    m AS (SELECT id FROM f WHERE id IN (SELECT id FROM b) AND id IN (SELECT claim_id FROM claims))
    SELECT CAST(id AS BIGINT) AS id, CAST((SELECT arg_min(claim_id, created) FROM claims WHERE claim_id IN (SELECT id FROM m)) AS BIGINT) AS victim FROM m
    WHERE (SELECT count(*) FROM m) > 1 OR EXISTS (SELECT 1 FROM w WHERE source = 14 AND target = 14)""")(lambda L: graph.deadlock(L, 14))
query("owner_release_ready", """SELECT claim_id FROM claims WHERE status >= 8 AND claim_id NOT IN (SELECT owner FROM monitors WHERE NOT released)
    AND claim_id NOT IN (SELECT target FROM edges JOIN claims c ON c.claim_id = source WHERE relation = 8 AND NOT c.released)""")(graph.owners_ready)
query("gc_reachability", "SELECT artifact_id FROM artifacts WHERE created < 600 AND hash NOT IN (SELECT hash FROM artifacts WHERE artifact_id % 3 = 0)")(
    lambda L: graph.unreachable(L.artifacts, L.artifacts.where("artifact_id % 3 = 0").select("hash"), 600))
query("epoch_conflict_dag", "SELECT a.event_id AS later, b.event_id AS earlier FROM deltas a JOIN deltas b ON a.claim_id = b.claim_id AND floor((a.sequence - 1) / 16.0) = floor((b.sequence - 1) / 16.0) AND a.event_id > b.event_id")(
    lambda L: graph.conflicts(L.deltas, 16))

# Fleet

_OK = "alive AND memory >= 8 AND disk >= 16"
query("placement_candidates", f"SELECT node_id, zone FROM nodes WHERE {_OK} AND region IN (1, 2)")(lambda L: fleet.candidates(L.nodes, 8, 16, (1, 2)).select("node_id", "zone"))
query("candidate_order", "SELECT node_id, zone, CAST(row_number() OVER (PARTITION BY region ORDER BY load, memory DESC, disk DESC, node_id) AS INT) AS place, region <> 2 AS away FROM nodes")(lambda L: fleet.ranked(L.nodes, 2))
_SEATS = f"""(SELECT CAST(row_number() OVER (ORDER BY region <> 2, load, memory DESC, disk DESC, node_id) AS INT) AS seat, node_id, zone FROM
    (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY region <> 2, load, memory DESC, disk DESC, node_id) AS r FROM nodes WHERE {_OK}) WHERE r = 1)"""
query("propose_placement", f"SELECT seat, node_id, zone, seat <= 3 AS copies FROM {_SEATS} WHERE seat <= 5")(lambda L: fleet.propose(L.nodes, 2, 2, 8, 16))
query("domain_occupancy", "SELECT zone, count(*) AS members FROM nodes WHERE alive GROUP BY 1")(lambda L: fleet.occupancy(L.nodes.where("alive")))
query("verify_placement", """SELECT (SELECT count(*) FROM nodes WHERE alive) AS voters, CAST(sum(members) AS BIGINT) AS lost,
    (SELECT count(*) FROM nodes WHERE alive) - sum(members) >= floor((SELECT count(*) FROM nodes WHERE alive) / 2.0) + 1 AS ok
    FROM (SELECT zone, count(*) AS members FROM nodes WHERE alive GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4)""")(lambda L: fleet.survives(L.nodes.where("alive"), 4))
query("heal_placement", """, seats AS (SELECT node_id, zone FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY region <> 2, load, node_id) AS r FROM nodes WHERE alive AND node_id % 6 = 1) WHERE r = 1),
    free AS (SELECT node_id, row_number() OVER (ORDER BY region <> 2, load, node_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY region <> 2, load, node_id) AS r FROM nodes WHERE alive AND zone NOT IN (SELECT zone FROM seats)) WHERE r = 1)
    SELECT node_id, TRUE AS kept FROM seats UNION ALL SELECT node_id, FALSE FROM free WHERE place <= greatest(0, 15 - (SELECT count(*) FROM seats))""")(
    lambda L: fleet.heal(L.nodes, L.nodes.where("node_id % 6 = 1"), 2, 15))
_SESSIONS = "SELECT claim_id AS session, claim_id % 7 AS active, CASE WHEN claim_id % 5 = 0 THEN claim_id % 3 END AS pending FROM claims"
query("leader_counts", f"SELECT coalesce(pending, active) AS leader, count(*) AS led FROM ({_SESSIONS}) GROUP BY 1")(lambda L: fleet.leader_counts(_sessions(L)))
query("leader_move", f""", s AS ({_SESSIONS}), led AS (SELECT coalesce(pending, active) AS leader, count(*) AS led FROM s GROUP BY 1)
    SELECT session, node AS "to" FROM (SELECT s.session, v.node, row_number() OVER (PARTITION BY s.session ORDER BY coalesce(o.led, 0), v.node) AS r FROM s JOIN led l ON l.leader = coalesce(s.pending, s.active)
    JOIN (SELECT claim_id AS session, unnest([claim_id % 7, (claim_id + 1) % 7, (claim_id + 3) % 9]) AS node FROM claims) v ON v.session = s.session LEFT JOIN led o ON o.leader = v.node
    WHERE v.node <> l.leader AND coalesce(o.led, 0) + 2 <= l.led) WHERE r = 1""")(
    lambda L: fleet.leader_moves(_sessions(L), L.claims.select(F.col("claim_id").alias("session"), F.explode(F.array(F.col("claim_id") % 7, (F.col("claim_id") + 1) % 7, (F.col("claim_id") + 3) % 9)).alias("node"))))
query("range_map_valid", "SELECT claim_id * 10 AS start FROM claims WHERE claim_id IN (199, 499)")(
    lambda L: fleet.range_faults(L.claims.where("claim_id NOT IN (200, 500)").select((F.col("claim_id") * 10).alias("start"), (F.col("claim_id") * 10 + 10).alias("end"))))
query("range_balance", """, last AS (SELECT worker, min(latency) AS lo, max(latency) AS hi, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY request DESC) AS r FROM samples) WHERE r <= 3 GROUP BY 1),
    m AS (SELECT worker % 10 AS "group", worker AS "range", n = 3 AND lo > 40000 AS over, n = 3 AND hi < 30000 AS under FROM last),
    p AS (SELECT *, under AND coalesce(lead(under) OVER (PARTITION BY "group" ORDER BY "range"), FALSE) AS pair FROM m)
    SELECT "group", CASE WHEN count(CASE WHEN over THEN 1 END) > 0 AND count(*) < 1000 THEN 'split' ELSE 'merge' END AS action,
           CASE WHEN count(CASE WHEN over THEN 1 END) > 0 AND count(*) < 1000 THEN min(CASE WHEN over THEN "range" END) ELSE min(CASE WHEN pair THEN "range" END) END AS "range"
    FROM p GROUP BY 1 HAVING (count(CASE WHEN over THEN 1 END) > 0 AND count(*) < 1000) OR count(CASE WHEN pair THEN 1 END) > 0""")(
    lambda L: fleet.balance(L.samples.select((F.col("worker") % 10).alias("group"), F.col("worker").alias("range"), F.col("request").alias("at"), F.col("latency").alias("load")), 40_000, 30_000, 1000))
query("suspicion_deadline", """SELECT worker AS node, round(min(start) / 1e6 + greatest(30 - 25 * ln(count(DISTINCT CASE WHEN request % 13 <> worker % 13 THEN request % 13 END) + 1.0) / ln(21.0), 5), 6) AS deadline FROM samples GROUP BY 1""")(
    lambda L: fleet.suspicion_deadline(L.samples.select(F.col("worker").alias("node"), (F.col("start") / 1e6).alias("start"), (F.col("request") % 13).alias("by"), (F.col("worker") % 13).alias("origin")), 30.0, 5.0, 20))

# Stream

query("delta_stream", "SELECT sequence, ordinal, claim_id, action FROM deltas")(lambda L: L.deltas.select("sequence", "ordinal", "claim_id", "action"))
query("delta_filter", "SELECT sequence, ordinal, claim_id FROM deltas WHERE claim_id IN (SELECT claim_id FROM claims WHERE status = 8)")(
    lambda L: stream.of_claims(L.deltas, L.claims.where("status = 8").select("claim_id")).select("sequence", "ordinal", "claim_id"))
query("resume_after", "SELECT sequence, ordinal FROM deltas WHERE sequence > 40 OR (sequence = 40 AND ordinal > 1)")(lambda L: stream.after(L.deltas, 40, 1).select("sequence", "ordinal"))
query("seed_then_tail", "SELECT claim_id, 'seed' AS part, count(*) AS n FROM deltas WHERE sequence <= 100 GROUP BY 1 UNION ALL SELECT claim_id, 'tail', count(*) FROM deltas WHERE sequence > 100 GROUP BY 1")(
    lambda L: L.deltas.where("sequence <= 100").groupBy("claim_id").agg(F.lit("seed").alias("part"), F.count("*").alias("n")).union(stream.after(L.deltas, 100).groupBy("claim_id").agg(F.lit("tail"), F.count("*"))))
_CONSUMERS = "SELECT DISTINCT user_id AS consumer, user_id * 3 + 20 AS sequence, CASE WHEN user_id % 2 = 0 THEN 4611686018427387904 ELSE 1 END AS ordinal, user_id % 5 = 0 AS protected, user_id * 10 AS expires, user_id % 7 = 3 AS resync FROM events"
query("retention_limit", f"SELECT least(coalesce(min(CASE WHEN ordinal >= 4611686018427387904 THEN sequence ELSE sequence - 1 END), 2000), 2000) AS keep_from FROM ({_CONSUMERS}) WHERE protected OR (expires > 60 AND NOT resync)")(
    lambda L: stream.retention_limit(_consumers(L), 2000, 60))
query("resync", f"SELECT consumer, CASE WHEN sequence < 40 THEN 'HistoryExpired' WHEN NOT protected AND expires <= 60 THEN 'LeaseExpired' WHEN 100050 - sequence > 100000 THEN 'SlowConsumer' END AS reason FROM ({_CONSUMERS})")(
    lambda L: stream.resync_reason(_consumers(L), 100_050, 40, 60))
query("consumer_dedup", "SELECT sequence, ordinal FROM deltas")(lambda L: stream.deduplicated(L.deltas.union(L.deltas.where("ordinal = 2"))).select("sequence", "ordinal"))
query("claim_wait", "SELECT claim_id, CASE WHEN status = 8 THEN 'Met' WHEN status > 8 THEN 'Unmet' ELSE 'Pending' END AS satisfied, CASE WHEN status >= 8 THEN 'Met' ELSE 'Pending' END AS terminal, CASE WHEN released THEN 'Met' ELSE 'Pending' END AS released FROM claims")(
    lambda L: L.claims.select("claim_id", F.when(F.col("status") == vocab.SATISFIED, "Met").when(scalars.is_terminal(F.col("status")), "Unmet").otherwise("Pending").alias("satisfied"),
                              F.when(scalars.is_terminal(F.col("status")), "Met").otherwise("Pending").alias("terminal"), F.when(F.col("released"), "Met").otherwise("Pending").alias("released")))
query("replay", """, r AS (SELECT claim_id, status, max(status) OVER w AS best FROM deltas WINDOW w AS (PARTITION BY claim_id ORDER BY sequence, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT claim_id, status, best IS NULL OR (best < 8 AND status >= best) AS ok FROM r)
    SELECT claim_id, CAST(max(CASE WHEN ok THEN status END) AS BIGINT) AS status, count(CASE WHEN ok THEN 1 END) AS changes, count(CASE WHEN NOT ok THEN 1 END) AS refused FROM k GROUP BY 1""")(lambda L: stream.replay(L.deltas))

# Further reads, checks and planners

query("object_events", "SELECT sequence, ordinal, action FROM deltas WHERE claim_id = 12")(lambda L: L.deltas.where("claim_id = 12").select("sequence", "ordinal", "action").orderBy("sequence", "ordinal"))
query("list_testament_of_claim_guard", "SELECT r.claim_id, cycle, size FROM responses r WHERE cycle = 1 AND r.claim_id IN (SELECT claim_id FROM claims WHERE subject % 2 = 1)")(
    lambda L: reads.guarded(L.responses, L.claims.where("subject % 2 = 1"), 1).select("claim_id", "cycle", F.col("size").cast("bigint").alias("size")))
query("index_scan", """SELECT 'issuer' AS predicate, claim_id FROM claims WHERE issuer = 100 UNION ALL SELECT 'subject', claim_id FROM claims WHERE subject = 17 UNION ALL SELECT 'status', claim_id FROM claims WHERE status = 13
    UNION ALL SELECT 'created', claim_id FROM claims WHERE created = 51 UNION ALL SELECT 'relation', source FROM edges WHERE relation = 7 UNION ALL SELECT 'verdict', validation_id FROM verdicts WHERE verdict = 3""")(
    lambda L: reads.index_scan(L, {"issuer": 100, "subject": 17, "status": 13, "created": 51, "relation": 7, "verdict": 3}))
query("receipt_chain", "SELECT claim_id, max(cycle) AS epoch, count(*) AS adoptions FROM responses GROUP BY 1")(lambda L: L.responses.groupBy("claim_id").agg(F.max("cycle").alias("epoch"), F.count("*").alias("adoptions")))
query("required_schema_cover", "SELECT producer, count(DISTINCT kind) FILTER (WHERE kind IN ('en', 'de', 'fr', 'es')) = 4 AS covered FROM artifacts GROUP BY 1")(lambda L: derive.covers(L.artifacts, "producer", "kind", ("en", "de", "fr", "es")))
query("response_outcome", f"""WITH {_RUNS}, j AS (SELECT claim_id, validation_id, final FROM validations LEFT JOIN runs USING (validation_id) WHERE mode = 2)
    SELECT claim_id, min(CASE WHEN final > 1 THEN validation_id END) AS cause, CASE WHEN count(CASE WHEN final > 1 THEN 1 END) > 0 THEN 'Blocked' WHEN bool_and(coalesce(final = 1, FALSE)) THEN 'Validated' ELSE 'Evaluating' END AS outcome FROM j GROUP BY 1""")(derive.response_outcomes)
query("delivery_report", f"SELECT outcome, max(n) AS n, {_PICK.format(q=500, p='p50')}, {_PICK.format(q=950, p='p95')}, max(latency) AS max FROM ({_RANKED.format(k='outcome', t="samples WHERE outcome IN ('purchase', 'refund', 'click')")}) GROUP BY 1")(
    lambda L: measure.nearest_rank(L.samples.where("outcome IN ('purchase', 'refund', 'click')"), ["outcome"], points={"p50": 500, "p95": 950}))
query("percentiles_approximate", None)(lambda L: L.samples.groupBy("outcome").agg(*(F.percentile_approx("latency", p / 1000, 1000).alias(n) for n, p in measure.POINTS.items())))
query("metrics_choose", """SELECT claim_id FROM (SELECT claim_id, status = 13 AS flagged FROM claims) ORDER BY NOT flagged, claim_id <= 400, claim_id LIMIT 3000""")(
    lambda L: derive.choose(L.claims.select("claim_id", (F.col("status") == 13).alias("flagged")), "claim_id", 400, 3000))
query("session_survey", "SELECT region, count(*) AS hosted, count(*) FILTER (WHERE NOT alive) AS stopped, count(*) FILTER (WHERE load > 5000) AS stretched, max(load) AS worst FROM nodes GROUP BY 1")(
    lambda L: L.nodes.groupBy("region").agg(F.count("*").alias("hosted"), F.count_if(~F.col("alive")).alias("stopped"), F.count_if(F.col("load") > 5000).alias("stretched"), F.max("load").alias("worst")))
query("monitor_release", """, t AS (SELECT claim_id, arg_min(status, sequence * 10 + ordinal) AS status, min(sequence) AS reached FROM deltas WHERE status >= 8 GROUP BY 1),
    settled AS (SELECT monitor_id, max(t.reached) AS reached FROM monitor_roots LEFT JOIN t ON t.claim_id = root GROUP BY 1 HAVING bool_and(coalesce(CASE WHEN predicate = 1 THEN status = 8 ELSE TRUE END AND reached IS NOT NULL, FALSE))),
    owned AS (SELECT monitor_id, reached FROM monitors JOIN t ON t.claim_id = owner JOIN claims c ON c.claim_id = owner AND c.released)
    SELECT monitor_id, min(reached) AS released_at FROM (SELECT * FROM settled UNION ALL SELECT * FROM owned) GROUP BY 1""")(
    lambda L: derive.monitor_releases(L, derive.first_terminal(L.deltas).join(L.claims.where("released"), "claim_id", "left_semi").select("claim_id", "at")))
query("reconcile_request", "SELECT w.request, CASE WHEN s.request IS NOT NULL THEN 'Committed' WHEN w.request < 300 THEN 'BelowFloor' ELSE 'Unknown' END AS outcome FROM (SELECT range * 3 AS request FROM range(400)) w LEFT JOIN (SELECT request FROM samples WHERE request % 2 = 0) s ON s.request = w.request")(
    lambda L: derive.reconcile(L.samples.where("request % 2 = 0"), _rows(L, "SELECT id * 3 AS request FROM range(400)"), 300))
query("history_check", """SELECT sequence, count(*) AS changes, count(*) = max(ordinal) + 1 AS whole, count(DISTINCT event_id) = count(*) AS once FROM deltas GROUP BY 1""")(
    lambda L: L.deltas.groupBy("sequence").agg(F.count("*").alias("changes"), (F.count("*") == F.max("ordinal") + 1).alias("whole"), (F.count_distinct("event_id") == F.count("*")).alias("once")))
query("retirement_family", """, below AS (SELECT claim_id AS root, claim_id AS id FROM claims UNION ALL SELECT root, source FROM below JOIN edges ON target = id AND relation = 8)
    , held AS (SELECT b.root FROM below b JOIN edges e ON e.target = b.id AND e.relation <> 8 JOIN claims k ON k.claim_id = e.source AND NOT (k.status >= 8 AND k.released)
      WHERE NOT EXISTS (SELECT 1 FROM below o WHERE o.root = b.root AND o.id = e.source))
    SELECT root, count(*) AS members, bool_and(status >= 8 AND released) AND root NOT IN (SELECT root FROM held) AS eligible FROM below JOIN claims ON claim_id = id GROUP BY 1 HAVING count(*) <= 64""")(
    lambda L: graph.families(L, L.claims.select("claim_id"), 64))
query("failure_path", """, p AS (SELECT source AS claim_id, target AS node, 1 AS steps FROM edges WHERE relation = 6 UNION SELECT claim_id, target, steps + 1 FROM p JOIN edges ON source = node AND relation = 6 WHERE steps < 16)
    SELECT claim_id, origin, steps FROM (SELECT p.claim_id, node AS origin, CAST(steps AS INT) AS steps, row_number() OVER (PARTITION BY p.claim_id ORDER BY created, node, steps) AS r FROM p JOIN claims c ON c.claim_id = node WHERE status > 8) WHERE r = 1""")(
    lambda L: graph.failure_origins(L, L.claims.select("claim_id")))
query("propagate", None)(graph.propagate)
query("choose_leader", """SELECT session, CASE WHEN best + 2 <= mine THEN other ELSE current END AS leader FROM (SELECT c.claim_id AS session, c.claim_id % 7 AS current, (c.claim_id + 3) % 7 AS other, a.n AS mine, b.n AS best
    FROM claims c JOIN (SELECT claim_id % 7 AS k, count(*) AS n FROM claims WHERE status < 8 GROUP BY 1) a ON a.k = c.claim_id % 7 JOIN (SELECT claim_id % 7 AS k, count(*) AS n FROM claims WHERE status < 8 GROUP BY 1) b ON b.k = (c.claim_id + 3) % 7)""")(
    lambda L: fleet.choose(L.claims.select(F.col("claim_id").alias("session"), (F.col("claim_id") % 7).alias("current"), ((F.col("claim_id") + 3) % 7).alias("other")), L.claims.where("status < 8").groupBy((F.col("claim_id") % 7).alias("node")).agg(F.count("*").alias("led"))))
query("home_move", """, v AS (SELECT * FROM nodes WHERE alive AND node_id % 4 = 1), worst AS (SELECT node_id FROM v WHERE region <> 2 ORDER BY load DESC, node_id LIMIT 1),
    best AS (SELECT node_id FROM nodes WHERE alive AND region = 2 AND zone NOT IN (SELECT zone FROM v WHERE node_id NOT IN (SELECT node_id FROM worst)) ORDER BY load, node_id LIMIT 1)
    SELECT worst.node_id AS leaves, best.node_id AS enters FROM worst, best""")(lambda L: fleet.home_move(L.nodes, L.nodes.where("alive AND node_id % 4 = 1"), 2))
query("deaths_stand_for", "SELECT max(greatest(0, 900 - load % 1000)) AS hold FROM nodes WHERE NOT alive")(lambda L: fleet.hold_left(L.nodes.where("NOT alive").select((F.col("load") % 1000).alias("since")), 900))
query("effective_guarantee", """SELECT region, min(t) AS tolerated FROM (SELECT region, 'voters' AS role, floor((count(*) - 1) / 2.0) AS t FROM nodes WHERE alive GROUP BY 1 UNION ALL SELECT region, 'copies', count(*) - 1.0 FROM nodes WHERE alive AND node_id % 2 = 0 GROUP BY 1) GROUP BY 1""")(
    lambda L: fleet.guarantee(L.nodes.where("alive"), "node_id % 2 = 0"))
query("route_changes", """SELECT node_id, CASE WHEN zone % 3 = 0 THEN 'dropped' WHEN load % 5 < 2 THEN 'older' ELSE 'kept' END AS route FROM nodes""")(
    lambda L: fleet.cached_routes(L.nodes.select("node_id", "zone", (F.col("load") % 5).alias("epoch")), L.nodes.where("zone % 3 = 0").select("zone").distinct(), 2))
query("range_replace", """SELECT claim_id * 10 AS start, CASE WHEN claim_id = 40 THEN 430 ELSE claim_id * 10 + 10 END AS "end", CASE WHEN claim_id = 40 THEN 2 ELSE 1 END AS generation FROM claims WHERE claim_id NOT IN (41, 42)""")(
    lambda L: fleet.merge_ranges(L.claims.select((F.col("claim_id") * 10).alias("start"), (F.col("claim_id") * 10 + 10).alias("end"), F.lit(1).alias("generation")), 400, 430))
query("tick_pace", """, v AS (SELECT worker, list_sort(list(latency)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY request DESC) AS r FROM samples) WHERE r <= 16 GROUP BY 1),
    m AS (SELECT worker, v, v[len(v) // 2 + 1] AS m FROM v), d AS (SELECT worker, m, list_sort(list_transform(v, lambda x: abs(x - m)))[len(v) // 2 + 1] AS mad FROM m)
    SELECT worker, CAST(ceil((10 * (m + greatest(4 * mad, 1000))) / 10.0) AS BIGINT) AS period, 10 * 300000 >= 10 * (m + greatest(4 * mad, 1000)) AS steady FROM d""")(
    lambda L: measure.tick_pace(L.samples, 10, 300_000))
query("span_intersection", "SELECT greatest(a.claim_id * 10, 333) AS lo, least(a.claim_id * 10 + 10, 777) AS hi FROM claims a WHERE greatest(a.claim_id * 10, 333) < least(a.claim_id * 10 + 10, 777)")(
    lambda L: derive.overlaps(L.claims.select((F.col("claim_id") * 10).alias("start"), (F.col("claim_id") * 10 + 10).alias("end")), 333, 777).toDF("lo", "hi"))
query("windowed_changes", f"SELECT CAST(floor(start / {7 * DAY * 1.0}) AS BIGINT) AS week, outcome, count(*) AS n FROM samples GROUP BY 1, 2")(
    lambda L: L.samples.groupBy(F.floor(F.col("start") / (7 * DAY)).alias("week"), "outcome").agg(F.count("*").alias("n")))


query("deadline_resolution", f""", w AS (SELECT DISTINCT source, target FROM (SELECT source, target FROM edges WHERE relation IN (6, 7) UNION ALL SELECT owner, root FROM monitors JOIN monitor_roots USING (monitor_id) WHERE NOT released)
    JOIN claims a ON a.claim_id = source JOIN claims b ON b.claim_id = target WHERE a.status < 8 AND b.status < 8),
    reach AS (SELECT source AS x, target AS y FROM w UNION SELECT x, target FROM reach JOIN w ON source = y),
    scc AS (SELECT a.x AS id, a.y AS other FROM reach a JOIN reach b ON a.x = b.y AND a.y = b.x),
    victims AS (SELECT id, other AS victim FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY created, other) AS r FROM scc JOIN claims ON claim_id = other) WHERE r = 1)
    SELECT claim_id, CASE WHEN victim IS NULL THEN 'Expired' ELSE 'Deadlocked' END AS outcome, victim FROM claims LEFT JOIN victims ON id = claim_id WHERE status < 8 AND deadline_at <= {DUE + 200 * 366 * DAY}""")(
    lambda L: graph.resolve_deadlines(L, DUE + 200 * 366 * DAY))
query("acceptance_projection", """SELECT claim_id, CASE WHEN b IS NOT NULL THEN 'Blocked' WHEN whole THEN 'Validated' ELSE 'Pending' END AS outcome, CAST(CASE WHEN b IS NOT NULL THEN b WHEN whole THEN last END AS INT) AS at FROM
    (SELECT claim_id, min(CASE WHEN verdict > 1 THEN attempt END) AS b, bool_and(coalesce(verdict = 1, FALSE)) AS whole, max(attempt) AS last FROM validations LEFT JOIN
    (SELECT validation_id, arg_min(verdict, attempt) AS verdict, min(attempt) AS attempt FROM verdicts WHERE verdict IS NOT NULL GROUP BY 1) USING (validation_id) WHERE mode = 2 GROUP BY 1)""")(derive.sticky_acceptance)
query("network_distance", """SELECT a.node_id AS one, b.node_id AS two, round(sqrt((a.load - b.load) * (a.load - b.load) + (a.memory - b.memory) * (a.memory - b.memory)) + a.disk + b.disk, 6) AS distance
    FROM nodes a JOIN nodes b ON a.zone = b.zone AND a.node_id < b.node_id""")(
    lambda L: fleet.distances(L.nodes))
query("assignment_phase", "SELECT outcome, CASE outcome WHEN 'signup' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 7 END AS rank, coalesce(CASE outcome WHEN 'signup' THEN 1 WHEN 'view' THEN 3 WHEN 'purchase' THEN 7 END >= 3, FALSE) AS at_least, count(*) AS n FROM samples GROUP BY ALL")(
    lambda L: L.samples.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("rank", fleet.phase_rank(F.when(F.col("outcome") == "signup", "Offered").when(F.col("outcome") == "view", "Seeding").when(F.col("outcome") == "purchase", "Serving").otherwise("Failed")))
    .select("outcome", "rank", F.coalesce(F.col("rank") >= 3, F.lit(False)).alias("at_least"), "n"))
query("extension_grant", f""", q AS (SELECT worker, start, latency, row_number() OVER (PARTITION BY worker ORDER BY start, request) AS i FROM samples),
    f AS (SELECT worker, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS last, CAST(0 AS BIGINT) AS total FROM q WHERE q.i = 1
    UNION ALL SELECT worker, i, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN start ELSE last END, CASE WHEN ok THEN total + greatest(1048576 >> n, 131072) ELSE total END
    FROM (SELECT f.worker, q.i, n, last, total, start, latency <= 90000 AND n < 5 AND (last IS NULL OR start - last >= {DAY}) AS ok FROM f JOIN q ON q.worker = f.worker AND q.i = f.i + 1))
    SELECT worker, max(n) AS granted, CAST(max(total) AS BIGINT) AS extension FROM f GROUP BY 1""")(lambda L: fleet.grants(L.samples.select("worker", "start", F.col("latency").alias("load"), "request"), 1 << 20, 5, DAY, 90_000))

# Scalars

query("status_predicates", "SELECT claim_id, status >= 8 AS terminal, status < 8 AS active FROM claims")(
    lambda L: L.claims.select("claim_id", scalars.is_terminal(F.col("status")).alias("terminal"), scalars.is_active(F.col("status")).alias("active")))
query("report_verdict", """SELECT claim_id, CASE WHEN claim_id % 6 = 5 THEN 2 WHEN claim_id % 4 > 2 THEN 2 WHEN claim_id % 3 = 0 THEN 3 ELSE 1 END AS verdict FROM claims""")(
    lambda L: L.claims.select("claim_id", scalars.report_verdict(F.when(F.col("claim_id") % 6 == 5, F.lit('{"passed": 1, "failed": 0}')).otherwise(
        F.format_string('{"passed": %d, "failed": %d, "skipped": 0}', F.col("claim_id") % 3, F.greatest(F.col("claim_id") % 4 - 2, F.lit(0))))).alias("verdict")))
query("id_hex", "SELECT claim_id, lpad(lower(to_hex(claim_id)), 32, '0') AS hex FROM claims")(lambda L: L.claims.select("claim_id", scalars.id_hex(F.col("claim_id")).alias("hex")))
query("kind_and_scope", "SELECT kind, producer, regexp_full_match(kind, '[a-z0-9_./-]{1,128}') AS kind_ok, length(producer) > 0 AND trim(producer) = producer AS scope_ok, count(*) AS n FROM artifacts GROUP BY ALL")(
    lambda L: L.artifacts.groupBy("kind", "producer").agg(F.count("*").alias("n")).withColumns({"kind_ok": scalars.valid_kind(F.col("kind")), "scope_ok": scalars.valid_scope(F.col("producer"))}))


def _sessions(L: Ledger) -> DataFrame:
    return L.claims.select(F.col("claim_id").alias("session"), (F.col("claim_id") % 7).alias("active"), F.when(F.col("claim_id") % 5 == 0, F.col("claim_id") % 3).alias("pending"))


def _consumers(L: Ledger) -> DataFrame:
    user = F.col("claim_id")
    return L.deltas.select(user).distinct().select(
        user.alias("consumer"), (user * 3 + 20).alias("sequence"), F.when(user % 2 == 0, F.lit(stream.RESOLVED)).otherwise(F.lit(1)).alias("ordinal"),
        (user % 5 == 0).alias("protected"), (user * 10).alias("expires"), (user % 7 == 3).alias("resync"))


# Guards of commands

for _name in commands.GUARDS:
    query(f"command_{_name}", proposed.sql(_name))(lambda L, n=_name: proposed.run(L, n))


for _name, (_query, _text) in listed.QUERIES.items():
    query(_name, _text)(_query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(sample_ledger(spark, sf_dir)) for name, (f, _) in _FOUND.items()}


@cache
def oracle_sql() -> dict[str, str]:
    """Each text after the ledger's tables: a leading WITH goes on as further tables, a leading comma too."""
    out = {}
    for name, (_, sql) in _FOUND.items():
        if sql is not None:
            sql = sql.strip()
            out[name] = f"{duckdb_prefix()}{', ' + sql[5:] if sql.startswith('WITH ') else sql if sql.startswith(',') else ' ' + sql}"
    return out
