"""Latency and sequence analytics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a value below its cell.
CELL_BITS = 10
POINTS = {"p50": 500, "p95": 950, "p99": 990, "p999": 999}


def nearest_rank(samples: DataFrame, keys: list[str], value: str = "latency", points: dict[str, int] = POINTS) -> DataFrame:
    """Percentiles at index floor(((n - 1) * permille + 500) / 1000) of the sorted whole numbers of each group, and the maximum.

    Values are counted, and the counts summed by cells of 2^CELL_BITS values; only in the cell that holds a percentile are
    values ranked, so that a group of any size is ranked in many small windows. Null values are left out.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")).withColumn("_cell", F.shiftright(F.col(value).cast("bigint"), CELL_BITS))
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_in"), F.max(value).alias("_most"))
    w = Window.partitionBy(*keys)
    cells = cells.withColumn("_before", F.sum("_in").over(w.orderBy("_cell")) - F.col("_in")).withColumn("_n", F.sum("_in").over(w))
    index = [F.struct(F.lit(name).alias("point"), F.floor(((F.col("_n") - 1) * permille + 500) / 1000).alias("at")) for name, permille in points.items()]
    wanted = cells.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_cell").alias("_where"), "_before", "_in", F.explode(F.array(*index)).alias("p"))
    wanted = wanted.where((F.col("_before") <= F.col("p.at")) & (F.col("p.at") < F.col("_before") + F.col("_in")))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    inside = counts.join(wanted, same & (F.col("_cell") == F.col("_where"))).withColumn("_point", F.col("p.point"))
    so_far = F.sum("_c").over(Window.partitionBy(*keys, "_point").orderBy(value))
    picked = inside.withColumn("_to", F.col("_before") + so_far).where(F.col("_to") > F.col("p.at"))
    names = [F.min(F.when(F.col("_point") == name, F.col(value))).alias(name) for name in points]
    picked = picked.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(*names)
    groups = cells.groupBy(*keys).agg(F.max("_n").alias("n"), F.max("_most").alias("max"))
    return groups.join(picked, same).select(*keys, "n", *points, "max")


def throughput(samples: DataFrame) -> DataFrame:
    """(n, per_second): events a second from first to last start, 0 when no time passes."""
    span = (F.max("start") - F.min("start")) / 1e6
    return samples.agg(F.count("*").alias("n"), F.when(span > 0, F.round(F.count("*") / span, 6)).otherwise(0.0).alias("per_second"))


def transitions(deltas: DataFrame) -> DataFrame:
    """(previous, status, n): how often one status follows another in a claim's order of changes."""
    w = Window.partitionBy("claim_id").orderBy("sequence", "ordinal")
    return deltas.select(F.lag("status").over(w).alias("previous"), "status").groupBy("previous", "status").agg(F.count("*").alias("n"))


def ordinal_gaps(deltas: DataFrame) -> DataFrame:
    """(sequence, ordinal): changes that do not continue their sequence from ordinal 0 by one each."""
    w = Window.partitionBy("sequence").orderBy("ordinal")
    return deltas.withColumn("_p", F.lag("ordinal").over(w)).where(F.col("ordinal") != F.coalesce(F.col("_p") + 1, F.lit(0))).select("sequence", "ordinal")


def sequence_gaps(sequences: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(sequence): published sequences that do not follow their predecessor by one; the first one is no gap.

    Neighbours are found by an anti join with sequence + 1, so that no window runs over all rows in one task.
    """
    seen = sequences.select("sequence").distinct()
    first = seen.agg(F.min("sequence").alias("first"))
    broken = seen.join(seen.select((F.col("sequence") + 1).alias("sequence")), "sequence", "left_anti")
    return broken.join(F.broadcast(first), F.col("sequence") > F.col("first")).select("sequence")


def rtt_tail(samples: DataFrame, size: int = 16, least: int = 1000) -> DataFrame:
    """(worker, request, median, mad, tail) over the last ``size`` samples: upper median, median absolute deviation, median + max(4 mad, least)."""
    w = Window.partitionBy("worker").orderBy("request").rowsBetween(1 - size, 0)
    upper = lambda a: F.element_at(a, (F.size(a) / 2).cast("int") + 1)
    rows = samples.select("worker", "request", F.sort_array(F.collect_list("latency").over(w)).alias("_v")).withColumn("median", upper(F.col("_v")))
    rows = rows.withColumn("_d", F.sort_array(F.transform("_v", lambda x: F.abs(x - F.col("median"))))).withColumn("mad", upper(F.col("_d")))
    return rows.select("worker", "request", "median", "mad", (F.col("median") + F.greatest(4 * F.col("mad"), F.lit(least))).alias("tail"))


def tick_pace(samples: DataFrame, election: int, period: int) -> DataFrame:
    """(worker, period, steady): the least tick period whose ``election`` ticks are ten tails of the newest round trips, and whether ``period`` is enough."""
    newest = rtt_tail(samples).groupBy("worker").agg(F.max_by("tail", "request").alias("tail"))
    return newest.select("worker", F.ceil(10 * F.col("tail") / election).alias("period"), (F.lit(election * period) >= 10 * F.col("tail")).alias("steady"))


def rtt_ewma(samples: DataFrame) -> DataFrame:
    """(worker, smoothed, variation): integer smoothing by eighths and quarters over a worker's samples in order.

    The first sample sets smoothed to itself and variation to half of it. A worker's samples are folded in order, a batch
    at a time; after a null latency both are null.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, at, s, v, out = False, None, None, None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["worker", "smoothed", "variation"])

        for batch in batches:
            for worker, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not started or worker != at:
                    if started:
                        out.append((at, s, v))
                    started, at, s, v = True, worker, x, None if x is None else x >> 1
                elif s is None or x is None:
                    s = v = None
                else:
                    s, v = s - (s >> 3) + (x >> 3), v - (v >> 2) + (abs(s - x) >> 2)
            if len(out) > 10_000:
                yield rows()
                out = []
        if started:
            out.append((at, s, v))
            yield rows()

    ordered = samples.select(F.col("worker").cast("bigint"), F.col("latency").cast("bigint"), "request").repartition("worker").sortWithinPartitions("worker", "request", "latency")
    return ordered.select("worker", "latency").mapInArrow(fold, "worker long, smoothed long, variation long")


def tumbling(samples: DataFrame, bin_us: int, slow: int) -> DataFrame:
    """(bin, n, p50, p99, max, slow): latencies by fixed bins of start time."""
    rows = samples.withColumn("bin", F.floor(F.col("start") / bin_us))
    counts = rows.groupBy("bin").agg(F.count_if(F.col("latency") > slow).alias("slow"))
    return nearest_rank(rows, ["bin"], points={"p50": 500, "p99": 990}).join(counts, "bin")


def slow_clusters(samples: DataFrame, slow: int, gap_us: int, most: int = 64) -> DataFrame:
    """(worker, start, end, n, worst): runs of slow samples of a worker, split where two are more than ``gap_us`` apart; the worst ``most``."""
    w = Window.partitionBy("worker").orderBy("start", "request")
    rows = samples.where(F.col("latency") > slow).withColumn("_new", F.coalesce(F.col("start") - F.lag("start").over(w) > gap_us, F.lit(True)).cast("int"))
    rows = rows.withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = rows.groupBy("worker", "_c").agg(F.min("start").alias("start"), F.max("start").alias("end"), F.count("*").alias("n"), F.max("latency").alias("worst")).drop("_c")
    return out.orderBy(F.desc("worst"), "start", "worker").limit(most)


def halves(samples: DataFrame) -> DataFrame:
    """(half, n, p50, p99, max): samples that start in the first and in the second half of the measured time."""
    middle = samples.agg(F.floor((F.min("start") + F.max("start")) / 2).alias("middle"))
    rows = samples.join(F.broadcast(middle)).withColumn("half", F.when(F.col("start") <= F.col("middle"), 1).otherwise(2))
    return nearest_rank(rows, ["half"], points={"p50": 500, "p99": 990})
