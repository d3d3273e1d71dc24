"""Reading, lineage cuts and size checks shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table, in estimated bytes, that an operator may broadcast after counting it.
BROADCAST_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session in one process makes a local one where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evidor-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written rows.

    Written as files and not as a checkpoint, which would keep every partition: Spark packs small files into few tasks, so
    that steps on few rows do not write a shuffle file for each of many empty ones.
    """
    return stored(df, "cut")


def stored(df: DataFrame, name: str = "rows", by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder, in folders ``by`` a column, and read back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*[by] if by else []).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*found: DataFrame) -> None:
    """Deletes what ``stored`` wrote; only for rows from which all that is needed has been written elsewhere."""
    for df in found:
        remove_folder(df.sparkSession, df.stored_at)
    release(found[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and broadcasts of steps that are done.

    They stay until the driver happens to collect the objects that stand for them, which takes long where plans are small
    beside the heap: disk and the driver's memory would grow with the number of steps.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Rows that one task may take, so that a step on a few is not dealt over all shuffle partitions.
FEW = 1 << 14


def together(df: DataFrame, n: int) -> DataFrame:
    """``df``, of ``n`` rows, in one partition if they are few: groups and joins of it need no exchange."""
    return df.coalesce(1) if n <= FEW else df


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``limit`` bytes, else as it is (a shuffle join then)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def fair_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows, so that long texts do not make huge batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > 1000:
        spark.conf.set(key, "1000")


#: Largest id filter, in bits; it is broadcast as 64-bit words. Fuller filters let more rows pass and stay right.
FILTER_BITS = 1 << 25


def maybe_in(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with a column _maybe: false only where ``key`` is certainly not in the one column of ``ids``.

    A filter of bounded size over the ids is broadcast, so that a join that follows shuffles few rows beside its matches.
    """
    (name,) = ids.columns
    n = ids.count()
    bits = min(FILTER_BITS, 1 << (16 * n + 1023).bit_length())
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(bits))
    words = together(ids, n).select(slot(name).alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_bits"))
    held = rows.withColumn("_slot", slot(key)).join(F.broadcast(words), F.shiftright("_slot", 6) == F.col("_word"), "left")
    return held.withColumn("_maybe", F.coalesce(F.expr("getbit(_bits, cast(_slot & 63 as int)) = 1"), F.lit(False))).drop("_slot", "_word", "_bits")


def drop_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in the one column of ``ids``; only likely matches are shuffled."""
    (name,) = ids.columns
    flagged = maybe_in(docs, "doc_id", ids)
    likely = flagged.where("_maybe").drop("_maybe").join(ids.select(F.col(name).alias("doc_id")), "doc_id", "left_anti")
    return flagged.where("NOT _maybe").drop("_maybe").unionByName(likely.select(*docs.columns))
