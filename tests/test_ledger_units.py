"""Small fixtures: sources and sinks, errors, cycles, pages and the stream forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evidor.functions import scalars
from evidor.operators import graph, measure, reads
from evidor.sources.ledger import Ledger, read_documents, sample_ledger
from evidor.streaming import deltas as stream


def test_strict_documents(spark, tmp_path):
    good = {"claim_id": 1, "issuer": 2, "subject": 3, "action": 4, "description": "x"}
    rows = [good, good | {"extra": 1}, {k: v for k, v in good.items() if k != "issuer"}, good | {"issuer": "no"}]
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    accepted, refused = read_documents(spark, str(tmp_path / "d.json"))
    assert [r.claim_id for r in accepted.collect()] == [1] and refused.count() == 4


def test_write_and_read_back(spark, sf, tmp_path):
    ledger = sample_ledger(spark, sf)
    ledger.write(str(tmp_path / "ledger"))
    again = Ledger.read(spark, str(tmp_path / "ledger"))
    for name in ("claims", "edges", "verdicts"):
        a, b = getattr(ledger, name), getattr(again, name)
        assert a.select(*sorted(a.columns)).exceptAll(b.select(*sorted(a.columns))).count() == 0


def test_status_scan_is_pruned(spark, sf, tmp_path):
    sample_ledger(spark, sf).write(str(tmp_path / "ledger"))
    plan = reads.list_family(Ledger.read(spark, str(tmp_path / "ledger")), "claims", status=8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(status" in plan


def test_foreign_predicate_is_refused(spark, sf):
    with pytest.raises(ValueError):
        reads.list_family(sample_ledger(spark, sf), "claims", phase=1)
    with pytest.raises(ValueError):
        reads.created_range(sample_ledger(spark, sf).claims, 5, 5)


def test_page_refuses_a_first_item_above_the_bound(spark):
    rows = spark.createDataFrame([(1, 500), (2, 10)], "k long, size long")
    with pytest.raises(Exception, match="larger than a page"):
        reads.page(rows, ["k"], "size", 10, 100).collect()
    assert reads.page(rows, ["k"], "size", 10, 505).count() == 1


@pytest.mark.parametrize("seed", range(3))
def test_traverse_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.choice((6, 7)), rng.randrange(30), 0) for _ in range(45)]
    df = spark.createDataFrame(edges, "source long, relation int, target long, introduced long")
    want, front = {0: 0, 1: 0}, {0, 1}
    for k in range(1, 5):
        front = {t for s, r, t, _ in edges if s in front and r == 6 and t not in want}
        want |= dict.fromkeys(front, k)
    got = graph.traverse(df, spark.createDataFrame([(0,), (1,)], "id long"), 4, relations=(6,))
    assert {r.id: r.depth for r in got.collect()} == want


def test_cycles(spark):
    df = spark.createDataFrame([(1, 8, 2), (2, 8, 3), (3, 8, 1), (4, 8, 1), (5, 8, 6)], "source long, relation int, target long")
    assert {r.id for r in graph.cyclic(df).collect()} >= {1, 2, 3} and 5 not in {r.id for r in graph.cyclic(df).collect()}


def test_nearest_rank(spark):
    rng = random.Random(1)
    rows = [(g, rng.randrange(50)) for g in range(4) for _ in range(rng.randrange(1, 40))]
    got = {r.g: r for r in measure.nearest_rank(spark.createDataFrame(rows, "g long, latency long"), ["g"]).collect()}
    for g in got:
        v = sorted(x for k, x in rows if k == g)
        assert [got[g].p50, got[g].p99, got[g].max] == [v[((len(v) - 1) * q + 500) // 1000] for q in (500, 990)] + [v[-1]]


def test_report_verdict(spark):
    rows = [('{"passed":1,"failed":0,"skipped":0}', 1), ('{"passed":0,"failed":0,"skipped":2}', 3), ('{"passed":1,"failed":2,"skipped":0}', 2),
            ('{"passed":1,"failed":0}', 2), ('{"passed":1,"failed":0,"skipped":0,"x":1}', 2), ("no", 2), (None, 2)]
    got = spark.createDataFrame(rows, "r string, want int").select("want", scalars.report_verdict(F.col("r")).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_stream_equals_batch(spark, sf, tmp_path):
    deltas = sample_ledger(spark, sf).deltas.select("claim_id", "sequence", "ordinal", "status", "action", (F.timestamp_seconds(F.col("sequence") * 60)).alias("at"))
    deltas.repartition(3).write.parquet(str(tmp_path / "in"))
    source = stream.read_stream(spark, str(tmp_path / "in"), deltas.schema)
    out = stream.windowed(source, "10 days", "1 hour").writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    out.awaitTermination()
    want = {(r.window.start, r.action): r.n for r in stream.windowed(deltas, "10 days", "1 hour").collect()}
    assert {(r.window.start, r.action): r.n for r in spark.table("windowed").collect()} == want


def test_status_stream_skips_repeats(spark, sf, tmp_path):
    deltas = sample_ledger(spark, sf).deltas.select("claim_id", "sequence", "ordinal", F.col("status").cast("long").alias("status"))
    deltas.union(deltas.where("ordinal = 1")).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = stream.status_stream(stream.read_stream(spark, str(tmp_path / "in"), deltas.schema)).writeStream.outputMode("update").format("memory").queryName("statuses").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    out.awaitTermination()
    from evidor.operators.derive import latest_status

    want = {(r.claim_id, r.status, r.changes) for r in latest_status(deltas).collect()}
    assert {tuple(r) for r in spark.table("statuses").collect()} == want


@pytest.mark.parametrize("seed", range(4))
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(25), rng.randrange(25)) for _ in range(35)] + [(100, 100), (200, 201)]
    reach = {x: {x2 for a, x2 in edges if a == x} for x in range(202)}
    for _ in range(30):
        reach = {x: r | {z for y in r for z in reach[y]} for x, r in reach.items()}
    want = {x: min(y for y in reach[x] if x in reach[y]) for x in reach if x in reach[x]}
    got = graph.components_of_cycles(spark.createDataFrame(edges, "source long, target long"))
    assert {r.id: r.scc for r in got.collect()} == want


def test_extension_grants(spark, sf):
    from evidor.operators import fleet

    samples = sample_ledger(spark, sf).samples.select("worker", "start", F.col("latency").alias("load"), "request")
    want, last = {}, {}
    for r in sorted(samples.collect(), key=lambda r: (r.worker, r.start, r.request)):
        n, total = want.setdefault(r.worker, (0, 0))
        if r.load <= 90_000 and n < 5 and (r.worker not in last or r.start - last[r.worker] >= 86_400_000_000):
            want[r.worker], last[r.worker] = (n + 1, total + max((1 << 20) >> n, (1 << 20) >> 3)), r.start
    got = fleet.grants(samples, 1 << 20, 5, 86_400_000_000, 90_000).collect()
    assert {r.worker: (r.granted, r.extension) for r in got} == want


def run_stream(df, name, path, mode):
    out = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", path).start()
    out.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_cursor_registry(spark, tmp_path):
    schema = "consumer long, n long, command string, sequence long, expires long"
    rows = [(1, 1, "Register", 5, 50), (1, 2, "Acknowledge", 9, 0), (1, 3, "Acknowledge", 7, 0), (1, 4, "Renew", 0, 80),
            (2, 1, "Acknowledge", 3, 0), (3, 1, "Register", 1, 10), (3, 2, "RequireResync", 0, 0), (3, 3, "Acknowledge", 8, 0), (3, 4, "BeginSeed", 0, 0),
            (4, 1, "Register", 1, 10), (4, 2, "RequireResync", 0, 0), (4, 3, "BeginSeed", 0, 0), (4, 4, "CompleteSeed", 40, 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = run_stream(stream.cursor_registry(source), "registry", str(tmp_path / "c"), "update")
    assert {tuple(r) for r in got} == {(1, "Live", 9, 80), (3, "Seeding", 1, 10), (4, "Live", 40, 10)}


def test_due_stream(spark, tmp_path):
    schema = "claim_id long, at timestamp, due long"
    for k, rows in enumerate([[(1, 10, 20_000), (2, 11, 900_000_000)], [(3, 500, 600_000_000)], [(4, 501, 700_000_000)]]):
        df = spark.createDataFrame(rows, "claim_id long, at long, due long").select("claim_id", F.timestamp_seconds("at").alias("at"), "due")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run_stream(stream.due_stream(source, "1 second"), "due", str(tmp_path / "c"), "append")
    assert [tuple(r) for r in got] == [(1, 20_000)]


def test_rtt_ewma_is_folded_without_collecting(spark):
    from evidor.operators import measure

    rows = [(w, i, (i * 7919 + (w or 5) * 31) % 5000) for w in (1, 2, None) for i in range(300)] + [(3, 0, 9), (4, 0, 8), (4, 1, None), (4, 2, 8)]
    got = measure.rtt_ewma(spark.createDataFrame(rows, "worker long, request long, latency long").repartition(5))
    assert "collect_list" not in got._jdf.queryExecution().toString()
    want = {3: (9, 4), 4: (None, None)}
    for w in (1, 2, None):
        values = [x for k, _, x in rows if k == w]
        s, v = values[0], values[0] >> 1
        for x in values[1:]:
            s, v = s - (s >> 3) + (x >> 3), v - (v >> 2) + (abs(s - x) >> 2)
        want[w] = (s, v)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert {r.worker: (r.smoothed, r.variation) for r in got.collect()} == want
    finally:
        spark.conf.set(key, before)


def test_families_end_on_loops_and_at_the_bound(spark, sf):
    L = sample_ledger(spark, sf)
    ids = [r.claim_id for r in L.claims.orderBy("claim_id").limit(6).collect()]
    loop = [(ids[0], 8, ids[1]), (ids[1], 8, ids[0])] + [(i, 8, ids[2]) for i in ids[3:]]
    edges = spark.createDataFrame([(*e, 1) for e in loop], "source long, relation int, target long, introduced long")
    got = {r.root: r.members for r in graph.families(Ledger(**{**vars(L), "edges": edges}), L.claims.where(F.col("claim_id").isin(ids)).select("claim_id"), 3).collect()}
    assert got == {ids[0]: 2, ids[1]: 2, **{i: 1 for i in ids[3:]}}


def test_failure_origins_of_nothing(spark, sf):
    L = sample_ledger(spark, sf)
    assert graph.failure_origins(L, L.claims.limit(0).select("claim_id")).count() == 0


def test_commands_give_every_reason(spark, sf):
    from evidor.operators.commands import GUARDS, outcomes
    from evidor.plans import commands

    L = sample_ledger(spark, sf)
    for name in GUARDS:
        got = {tuple(r.outcome.split(":")[:2]) for r in commands.run(L, name).select("outcome").distinct().collect()}
        assert len(got) > 2 or name == "revoke", name
    # the holder of the newest receipt
    newest = L.responses.groupBy("claim_id").agg(F.max("cycle").cast("long").alias("n")).join(L.claims, "claim_id").orderBy("claim_id").limit(5)
    for name, status, applied in (("record_progress", 3, "Applied:4"), ("begin_evidence", 4, "Applied:4"), ("acknowledge_testament", 5, "Applied:6")):
        state = Ledger(**{**vars(L), "claims": L.claims.withColumn("status", F.lit(status))})
        actor = F.lit(0).cast("long") if name == "acknowledge_testament" else F.col("subject")
        right = outcomes(state, name, newest.select("claim_id", actor.alias("actor"), "n"))
        assert {r.outcome for r in right.collect()} == {applied}
        wrong = outcomes(state, name, newest.select("claim_id", actor.alias("actor"), (F.col("n") + 1).alias("n")))
        assert all(r.outcome.startswith("Refused:") for r in wrong.collect())
    unknown = spark.createDataFrame([(-1, 0, 1)], "claim_id long, actor long, n long")
    assert outcomes(L, "revoke", unknown).first().outcome == "Refused:UnknownObject"


def test_balance_takes_one_change_of_current_streaks(spark):
    from evidor.operators import fleet

    loads = [(1, r, t, v) for r, values in {1: [9, 9, 9, 1, 1, 1], 2: [1, 1, 1], 3: [9, 1, 9, 9, 9]}.items() for t, v in enumerate(values)]
    loads += [(2, r, t, 1) for r in (4, 5, 6) for t in range(3)] + [(3, 7, 0, 1), (3, 8, 0, 1)]
    df = spark.createDataFrame(loads, "group long, range long, at long, load long")
    assert {tuple(r) for r in fleet.balance(df, 5, 3, 10).collect()} == {(1, "split", 3), (2, "merge", 4)}
    assert {tuple(r) for r in fleet.balance(df, 5, 3, 3).collect()} == {(1, "merge", 1), (2, "merge", 4)}


def test_bounded_traversal(spark):
    edges = spark.createDataFrame([(k, 6, k + 1) for k in range(5)], "source long, relation int, target long")
    start = spark.createDataFrame([(0,)], "id long")
    got = [tuple(graph.bounded(edges, start, d, n).first()) for d, n in ((9, 100), (2, 100), (9, 3))]
    assert got == [("Complete", 6), ("DepthLimit", 3), ("NodeLimit", 3)]
