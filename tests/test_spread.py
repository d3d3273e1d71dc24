"""Shares of tasks: bounded by rows, with the results of the plain form."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidor.operators import derive, fleet, graph, reads, spread


def verdicts(spark, n=4000):
    """Runs of 1 to 5 attempts, with open ones and some that go on after a Pass."""
    rows = [(i, k + 1 + (i % 50 == 0), (i * 7 + k) % 4 or None) for i in range(n) for k in range(i % 5 + 1)]
    return spark.createDataFrame(rows, "validation_id long, attempt int, verdict int"), rows


def shares(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_verdicts_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(spread, "ROWS", 500)
    df, rows = verdicts(spark)
    checks = spark.createDataFrame([(i,) for i in range(3900)], "validation_id long")
    out = reads.validation_results(df, checks)
    want = {}
    for i, a, v in rows:
        if i < 3900:
            want.setdefault(i, []).append((a, v))
    flat = [r for i, run in sorted(want.items()) for r in [(i, None, max(run)[1], len(run)), *((i, a, v, None) for a, v in sorted(run, key=lambda x: x[0]))]]
    assert [tuple(r) for r in out.collect()] == flat
    assert shares(out) < 2500
    audited = derive.audit(df)
    late = {i: (all(a == k + 1 for k, (a, _) in enumerate(run)), all(v != 1 for _, v in run[:-1])) for i, run in want.items()}
    assert {r.validation_id: (r.contiguous, r.sealed) for r in audited.collect() if r.validation_id < 3900} == late
    assert shares(audited) < 600


def test_distances_of_a_large_zone(spark):
    rows = [(i, 1 if i % 10 else i % 3, i * i % 97, i % 11, i % 7) for i in range(300)] + [(900, None, 1, 1, 1)]
    nodes = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.LongType()) for n in ("node_id", "zone", "load", "memory", "disk")]))
    out = fleet.distances(nodes, block=32)
    got = sorted(tuple(r) for r in out.collect())
    want = sorted((a[0], b[0], round(((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 + a[4] + b[4], 6)) for a in rows for b in rows if a[1] is not None and a[1] == b[1] and a[0] < b[0])
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want))
    assert shares(out) < 0.6 * len(got)


def test_components_need_few_rounds(spark, monkeypatch):
    rounds, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: rounds.append(1) or cut(df))
    pairs = 10
    edges = [e for k in range(pairs) for e in ((2 * k, 2 * k + 1), (2 * k + 1, 2 * k), (2 * k + 1, 2 * k + 2))] + [(50, 50), (2 * pairs, 50), (60, 0)]
    got = graph.components_of_cycles(spark.createDataFrame(edges, "source long, target long"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, i // 2 * 2) for i in range(2 * pairs)] + [(50, 50)]
    assert len(rounds) < 30
