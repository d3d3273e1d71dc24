"""The ordered change stream: batch forms, and the same as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocab import FIRST_TERMINAL

#: Ordinal of a position that stands after every change of its sequence.
RESOLVED = (1 << 62)
#: Sequences that a consumer may lag behind before it has to start again.
MOST_LAG = 100_000


def of_claims(deltas: DataFrame, claims: DataFrame | None) -> DataFrame:
    """All changes, or those of the given claims (claim_id); changes without claim belong to none."""
    return deltas if claims is None else deltas.join(claims, "claim_id", "left_semi")


def after(deltas: DataFrame, sequence: int, ordinal: int = RESOLVED) -> DataFrame:
    """Changes strictly after a position, in order."""
    return deltas.where((F.col("sequence") > sequence) | ((F.col("sequence") == sequence) & (F.col("ordinal") > ordinal))).orderBy("sequence", "ordinal")


def retained_prefix(sequence: Column, ordinal: Column) -> Column:
    """The sequence up to which a position has seen everything: its own if resolved, else the one before."""
    return F.when(ordinal >= RESOLVED, sequence).otherwise(sequence - 1)


def retention_limit(consumers: DataFrame, published: int, now: int) -> DataFrame:
    """(keep_from): the least prefix of consumers that are protected, or neither expired nor in resync; at most ``published``."""
    held = consumers.where(F.col("protected") | ((F.col("expires") > now) & ~F.col("resync")))
    least = F.min(retained_prefix(F.col("sequence"), F.col("ordinal")))
    return held.agg(F.least(F.coalesce(least, F.lit(published)), F.lit(published)).alias("keep_from"))


def resync_reason(consumers: DataFrame, published: int, floor: int, now: int) -> DataFrame:
    """(consumer, reason): why a consumer has to start from a seed again; null where it does not."""
    reason = F.when(F.col("sequence") < floor, "HistoryExpired").when(~F.col("protected") & (F.col("expires") <= now), "LeaseExpired")
    return consumers.select("consumer", reason.when(F.lit(published) - F.col("sequence") > MOST_LAG, "SlowConsumer").alias("reason"))


def deduplicated(deliveries: DataFrame) -> DataFrame:
    """Each change once, however often it was delivered."""
    return deliveries.dropDuplicates(["sequence", "ordinal"])


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 8) -> DataFrame:
    """Changes written as Parquet, as a stream of at most ``files`` files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(deltas: DataFrame, late: str, width: str) -> DataFrame:
    """Counts of changes by event-time window and action; what is later than the watermark is dropped in a stream."""
    return deltas.withWatermark("at", late).groupBy(F.window("at", width), "action").agg(F.count("*").alias("n"))


def status_stream(deltas: DataFrame) -> DataFrame:
    """(claim_id, status, changes) after every batch in which a claim changed; repeated positions are skipped.

    State of a claim: its newest position, status, and number of changes.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, ordinal, status, n = state.get if state.exists else (-1, -1, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["sequence", "ordinal"])
        for r in rows.itertuples():
            if (r.sequence, r.ordinal) > (seq, ordinal):
                seq, ordinal, status, n = int(r.sequence), int(r.ordinal), int(r.status), n + 1
        state.update((seq, ordinal, status, n))
        yield pd.DataFrame([(key[0], status, n)], columns=["claim_id", "status", "changes"])

    return deltas.groupBy("claim_id").applyInPandasWithState(step, "claim_id long, status long, changes long", "sequence long, ordinal long, status long, changes long", "update", "NoTimeout")


def replay(deltas: DataFrame) -> DataFrame:
    """(claim_id, status, changes, refused): the claim lifecycle folded in order; a change after a terminal status, or to a lower one, is refused.

    A refused change is below the highest so far or behind a terminal one, so the highest status before a change decides.
    """
    before = F.max("status").over(Window.partitionBy("claim_id").orderBy("sequence", "ordinal").rowsBetween(Window.unboundedPreceding, -1))
    kept = F.col("before").isNull() | ((F.col("before") < FIRST_TERMINAL) & (F.col("status") >= F.col("before")))
    rows = deltas.select("claim_id", F.col("status").cast("bigint").alias("status"), before.cast("bigint").alias("before")).withColumn("kept", kept)
    return rows.groupBy("claim_id").agg(F.max(F.when(F.col("kept"), F.col("status"))).alias("status"), F.count_if("kept").alias("changes"), F.count_if(~F.col("kept")).alias("refused"))


def cursor_registry(commands: DataFrame) -> DataFrame:
    """(consumer, mode, sequence, expires) after each batch of commands (consumer, n, command, sequence, expires).

    Commands: Register, Acknowledge (forward only), Renew, RequireResync, BeginSeed, CompleteSeed. Commands of unknown
    consumers are ignored but for Register; a consumer in resync takes no acknowledgement until its seed is complete.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        mode, seq, expires = state.get if state.exists else (None, 0, 0)
        for c in pd.concat(list(batches)).sort_values("n").itertuples():
            if mode is None and c.command != "Register":
                continue
            if c.command == "Register" and mode is None:
                mode, seq, expires = "Live", int(c.sequence), int(c.expires)
            elif c.command == "Acknowledge" and mode == "Live":
                seq = max(seq, int(c.sequence))
            elif c.command == "Renew":
                expires = max(expires, int(c.expires))
            elif c.command == "RequireResync":
                mode = "Resync"
            elif c.command == "BeginSeed" and mode == "Resync":
                mode = "Seeding"
            elif c.command == "CompleteSeed" and mode == "Seeding":
                mode, seq = "Live", int(c.sequence)
        if mode is not None:
            state.update((mode, seq, expires))
            yield pd.DataFrame([(key[0], mode, seq, expires)], columns=["consumer", "mode", "sequence", "expires"])

    return commands.groupBy("consumer").applyInPandasWithState(step, "consumer long, mode string, sequence long, expires long", "mode string, sequence long, expires long", "update", "NoTimeout")


def due_stream(deadlines: DataFrame, late: str) -> DataFrame:
    """(claim_id, due): a claim once its newest deadline lies before the watermark of the logged times (column at)."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (due,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], due)], columns=["claim_id", "due"])
            return
        rows = pd.concat(list(batches)).sort_values("at")
        due = int(rows["due"].iloc[-1])
        state.update((due,))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return deadlines.withWatermark("at", late).groupBy("claim_id").applyInPandasWithState(step, "claim_id long, due long", "due long", "append", "EventTimeTimeout")
