"""Settling of groups: sketches leave out no similar pair and let few others pass."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("evidor.llm")
from evidor.llm import settle  # noqa: E402


def test_crossing_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(300)]
    sets = {1000 + i: set(rng.sample(base, 300 - rng.randrange(70))) | {rng.getrandbits(63) for _ in range(rng.randrange(30))} for i in range(150)}
    sets |= {2000 + i: set(rng.sample(base, 1 + rng.randrange(5))) for i in range(30)}
    root = {i: 1000 if i < 1080 else i for i in sets}
    # two groups that overlap, so that some pairs are met twice
    groups = {1: list(sets), 2: [i for i in sets if i % 2]}
    rows = spark.createDataFrame([(k, i, root[i]) for k, ids in groups.items() for i in ids], "key long, id long, root long")
    sketches = settle.parities(spark.createDataFrame([(i, x) for i, s in sets.items() for x in s], "id long, x long"))
    assert {r.id: r.n for r in sketches.collect()} == {i: len(s) for i, s in sets.items()}
    got = [(r.a, r.b) for r in settle.crossing_pairs(rows, sketches, 0.8).collect()]
    open_pairs = [(a, b) for a in sets for b in sets if a < b and root[a] != root[b]]
    want = {(a, b) for a, b in open_pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and want and want <= set(got) <= set(open_pairs)
    assert len(got) - len(want) < 0.2 * (len(open_pairs) - len(want))


def test_picked_pairs(spark):
    main, few = {1: range(100, 250), 2: range(1000, 1150)}, {1: range(300, 450), 2: range(2000, 2010)}
    rows = [(k, i, 100) for k in main for i in main[k]] + [(k, i, i) for k in few for i in few[k]]
    rows = spark.createDataFrame(rows, "key long, id long, root long")
    first, second = ({(r.a, r.b) for r in settle.picked_pairs(rows, k).collect()} for k in (0, 1))
    assert {b for _, b in first} == set(few[1]) and {a for a, _ in first | second} <= set(main[1])
    assert len(first) <= settle.PICKS * len(few[1]) and not {a for a, _ in first} & {a for a, _ in second}


def test_a_pair_is_made_in_one_of_its_groups(spark, monkeypatch):
    """Copies with small changes share several groups; the join makes each of their pairs once, not once a group."""
    given = []
    monkeypatch.setattr(settle, "cut", lambda df: given.append(df) or df.localCheckpoint())
    tokens = list(range(200))
    sketches = settle.parities(spark.createDataFrame([(i, x * 7919) for i in range(20) for x in tokens], "id long, x long"))
    rows = spark.createDataFrame([(k, i, i) for k in range(5) for i in range(20) if k or i % 2], "key long, id long, root long")
    got = sorted((r.a, r.b) for r in settle.crossing_pairs(rows, sketches, 0.8).collect())
    assert got == [(a, b) for a in range(20) for b in range(a + 1, 20)]
    assert "Aggregate" not in given[-1]._jdf.queryExecution().optimizedPlan().toString()
