"""Every registered ledger query against its SQL, and the others against brute force."""

import glob
import os
from types import SimpleNamespace

import duckdb
import pytest

from evidor.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    con.register("got", df.toPandas())
    con.execute(f"CREATE OR REPLACE TEMP TABLE want AS {registry.oracle_sql()[name]}")
    assert sorted(df.columns) == sorted(r[0] for r in con.sql("DESCRIBE want").fetchall())
    for a, b in (("got", "want"), ("want", "got")):
        assert con.sql(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []
    con.unregister("got")


def tables(spark):
    L = registry.sample_ledger(spark, SF)
    return L, {r.claim_id: r for r in L.claims.collect()}, L.edges.collect(), {r.monitor_id: r for r in L.monitors.collect()}, L.monitor_roots.collect()


def brute_fixpoint(claims, edges, monitors, roots, status=None):
    status = status or {i: r.status for i, r in claims.items()}
    done = {i for i in claims if status[i] == 8}

    def met(target, strict):
        return target in done or (not strict and target in claims and status[target] >= 8)

    needs = {}
    for e in edges:
        if e.relation in (6, 7):
            needs.setdefault(e.source, []).append((e.target, e.relation == 6))
    for r in roots:
        if not monitors[r.monitor_id].released:
            needs.setdefault(monitors[r.monitor_id].owner, []).append((r.root, r.predicate == 1))
    while True:
        new = {i for i, r in claims.items() if i not in done and r.local_complete and status[i] < 8 and all(met(*n) for n in needs.get(i, ()))}
        if not new:
            return done
        done |= new


def test_least_fixpoint(spark):
    L, *rest = tables(spark)
    assert {r.claim_id for r in registry.queries()["least_fixpoint"](spark, SF).collect()} == brute_fixpoint(*rest)


def test_release_cascade(spark):
    L, claims, edges, *_ = tables(spark)
    children = {}
    for e in edges:
        if e.relation == 8:
            children.setdefault(e.target, []).append(e.source)
    released = {i for i, r in claims.items() if r.released}
    fresh, k = {}, 0
    while True:
        k += 1
        new = {i for i, r in claims.items() if r.status >= 8 and i not in released and all(c in released for c in children.get(i, ()))}
        if not new:
            break
        released |= new
        fresh |= dict.fromkeys(new, k)
    assert {r.claim_id: r.round for r in registry.queries()["release_cascade"](spark, SF).collect()} == fresh


def test_propagate(spark):
    L, claims, edges, monitors, roots = tables(spark)
    status = {i: r.status for i, r in claims.items()}
    deps = [(e.source, e.target) for e in edges if e.relation == 6]
    while True:
        hit = {s for s, t in deps if status[s] < 8 and status.get(t, 0) > 8}
        if not hit:
            break
        status |= dict.fromkeys(hit, 19)
    released = {i for i, r in claims.items() if r.released}
    held = {i: SimpleNamespace(owner=m.owner, released=m.released) for i, m in monitors.items()}
    children = {}
    for e in edges:
        if e.relation == 8:
            children.setdefault(e.target, []).append(e.source)
    while True:
        before = (dict(status), set(released), [m.released for m in held.values()])
        status |= dict.fromkeys(brute_fixpoint(claims, edges, held, roots, status), 8)
        while new := {i for i, s in status.items() if s >= 8 and i not in released and all(c in released for c in children.get(i, ()))}:
            released |= new
        for i, m in held.items():
            own = [r for r in roots if r.monitor_id == i]
            m.released = m.released or m.owner in released or all(status.get(r.root, 0) == 8 if r.predicate == 1 else status.get(r.root, 0) >= 8 for r in own)
        if before == (status, released, [m.released for m in held.values()]):
            break
    got = {r.claim_id: (r.status, r.released) for r in registry.queries()["propagate"](spark, SF).collect()}
    assert got == {i: (s, i in released) for i, s in status.items()}
    assert any(m.released and not monitors[i].released for i, m in held.items())


def test_replay(spark):
    L = registry.sample_ledger(spark, SF)
    want = {}
    for r in sorted(L.deltas.collect(), key=lambda r: (r.sequence, r.ordinal)):
        status, n, refused = want.get(r.claim_id, (0, 0, 0))
        want[r.claim_id] = (status, n, refused + 1) if status >= 8 or r.status < status else (r.status, n + 1, refused)
    assert {r.claim_id: (r.status, r.changes, r.refused) for r in registry.queries()["replay"](spark, SF).collect()} == want


def test_percentiles_approximate(spark):
    exact = {r.outcome: r.p50 for r in registry.queries()["write_report"](spark, SF).collect()}
    for r in registry.queries()["percentiles_approximate"](spark, SF).collect():
        assert abs(r.p50 - exact[r.outcome]) <= 0.05 * exact[r.outcome]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())
