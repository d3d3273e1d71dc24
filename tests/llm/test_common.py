"""Written rows and bounded helpers of the training-data operators."""

import time
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from evidor.llm import packing, toxicity
from evidor.llm.common import cut, discard, maybe_in, stored


def test_few_rows_of_many_partitions_are_read_in_few_tasks(spark):
    df = spark.range(40).repartition(200).withColumn("xs", F.array("id", F.lit(None).cast("bigint")))
    out = cut(df)
    assert sorted(map(tuple, out.collect())) == [(i, [i, None]) for i in range(40)]
    assert out.rdd.getNumPartitions() < 50 and out.dtypes == df.dtypes
    assert cut(df.where("id < 0")).isEmpty()


def test_the_matrix_of_hits_takes_little_more_than_itself():
    rng = np.random.default_rng(3)
    counts, units = rng.integers(0, 9, (1500, 512), np.uint8), rng.random(1500)
    packed = [c.tobytes() for c in counts]
    tracemalloc.start()
    x = toxicity.matrix(units.tolist(), packed)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert x.dtype == np.float32 and (x[:, 1:] == counts).all() and (x[:, 0] == units.astype(np.float32)).all()
    assert peak < 1.5 * x.nbytes and toxicity.matrix([], []).shape[0] == 0


def test_room_is_mended_only_where_it_changes():
    class Counted(list):
        writes = 0

        def __setitem__(self, i, value):
            Counted.writes += 1
            super().__setitem__(i, value)

    room = packing.Room(2048)
    room.best = Counted(room.best)
    for s in range(1000):
        room.put(2048, 0.0, s)
    assert Counted.writes < 100
    assert [room.take(2048)[1] for _ in range(1000)] == list(range(1000)) and room.take(1) is None


def test_memory_of_byte_runs():
    """What a worker holds while it hashes follows the chunk, and hashes do not depend on it."""
    import random
    import tracemalloc

    import pyarrow as pa

    from evidor.llm import suffix_dedup, wordhash
    from evidor.llm.anchors import runs

    rng = random.Random(1)
    column = pa.array([rng.randbytes(5000) for _ in range(400)], pa.binary())

    def spans(most):
        found = []
        for lo, _, data, offsets in wordhash.chunks(column, most):
            row, key, span, a, _, _ = runs(wordhash.Prefix(data), wordhash.Prefix(data, 1), offsets, 100, 20)
            found += zip((row + lo).tolist(), key.tolist(), span.tolist(), (a - offsets[row]).tolist())
        return found

    wordhash.powers.__defaults__[1].clear()
    tracemalloc.start()
    got = spans(suffix_dedup.CHUNK)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    assert got == spans(1 << 20)


def test_shuffle_files_of_done_steps_are_deleted(spark):
    found = stored(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")))
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager()
    shuffles = lambda: {x.split("_")[1] for x in map(str, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(manager.diskBlockManager().getAllBlocks())) if x.startswith("shuffle_")}
    there = shuffles()
    discard(found)
    ended = time.time() + 20
    while (left := shuffles()) >= there and time.time() < ended:
        time.sleep(0.2)
    assert there and not left >= there


def test_few_ids_are_sieved_without_an_exchange(spark):
    ids = cut(spark.range(0, 600, 3).repartition(9))
    flagged = maybe_in(spark.range(600), "id", ids)
    assert {r.id for r in flagged.where("_maybe").collect()} >= set(range(0, 600, 3))
    assert "hashpartitioning" not in flagged._jdf.queryExecution().executedPlan().toString()
