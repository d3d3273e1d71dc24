"""Substring deduplication with a log-structured fingerprint index.

The index holds sorted, immutable runs of what earlier batches contained: fingerprints of all 50-word windows of a
batch, those that share an anchor and stand side by side as one row, with the first document of each class. A run is a
table bucketed and sorted by anchor. A new batch becomes a run, is merge-joined with the older ones bucket by bucket,
and only what meets there is judged: windows whose anchor is known with other content around it are verified by
122-bit hashes of their words. Runs are compacted into one when there are FANOUT of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash as W
from .anchors import RUNS, classes_of, emit, judge, likely, merged, runs, with_hash
from .common import cut, fair_batches, maybe_in, remove_folder, shared_folder, stored

#: Words of a window and of the n-gram that anchors it; batches of the registered query; runs that trigger compaction.
WINDOW, GRAM, BATCHES, FANOUT = 50, 20, 3, 2
#: Columns of a run of the index.
INDEX = "key BIGINT, span BIGINT, n BIGINT, a BIGINT, b BIGINT, last BIGINT, doc_id BIGINT, txt INT"


def fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The anchor runs of every text, with word numbers counted in each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(2)):
                start, end, first = W.words(data, offsets)
                values, others = (W.Prefix(W.Prefix(data, k).spans(start, end), k) for k in (0, 1))
                row, key, span, a, b, last = runs(values, others, first, window, gram)
                yield emit(batch, row, lo, {"key": key, "span": span, "a": a - first[row], "b": b - first[row], "last": last - first[row]})

    return with_hash(docs).mapInArrow(run, RUNS)


def window_hashes(docs: DataFrame, opened: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w1, w2, a, b, doc_id, txt): two independent hashes of the windows of the runs in ``opened``, and the words each covers with its repeats."""
    wanted = cut(opened.groupBy("doc_id", "txt").agg(*(F.collect_list(c).alias(c) for c in ("a", "b", "last"))))
    texts = maybe_in(with_hash(docs), "doc_id", wanted.select("doc_id")).where("_maybe").join(wanted, ["doc_id", "txt"]).select("doc_id", "txt", "text", "a", "b", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(2)):
                start, end, first = W.words(data, offsets)
                one, two = (W.Prefix(W.Prefix(data, k).spans(start, end), k) for k in (0, 1))
                lists = [batch.column(c)[lo:hi] for c in (3, 4, 5)]
                row = np.repeat(np.arange(hi - lo), lists[0].value_lengths().to_numpy())
                a, b, last = (x.flatten().to_numpy() + first[row] for x in lists)
                count = b - a + 1
                run_no = np.repeat(np.arange(len(a)), count)
                at = np.arange(len(run_no)) - np.repeat(np.cumsum(count) - count, count) + a[run_no]
                row, final = row[run_no], at + (last[run_no] - at) // count[run_no] * count[run_no]
                yield emit(batch, row, lo, {"w1": one.spans(at, at + window), "w2": two.spans(at, at + window), "a": at - first[row], "b": final + window - first[row]})

    return texts.mapInArrow(run, "w1 long, w2 long, a long, b long, doc_id long, txt int")


class FingerprintIndex:
    """Runs of the documents seen so far, as bucketed tables in ``folder``. Batches come in ascending order of doc_id.

    ``runs`` names the folders of the runs; with them ``open`` takes the index up again in a later session.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.folder = folder or f"{shared_folder(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.tables: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, runs: list[str], folder: str, buckets: int, **sizes: int) -> FingerprintIndex:
        """The index whose runs stand in the folders ``runs``, written with ``buckets`` buckets."""
        index = cls(spark, folder, buckets=buckets, **sizes)
        for path in runs:
            name = f"fingerprints_{uuid.uuid4().hex}"
            spark.sql(f"CREATE TABLE {name} ({INDEX}) USING parquet CLUSTERED BY (key) SORTED BY (key, span) INTO {buckets} BUCKETS LOCATION '{path}'")
            index.runs.append(path)
            index.tables[path] = name
        return index

    def write(self, rows: DataFrame) -> str:
        """``rows`` as a run of the index; its folder."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}"
        dealt = rows.repartition(self.buckets, "key")
        dealt.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key", "span").option("path", path).saveAsTable(name)
        self.tables[path] = name
        return path

    def read(self, path: str) -> DataFrame:
        return self.spark.table(self.tables[path])

    def forget(self, path: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")
        remove_folder(self.spark, path)

    def compact(self) -> None:
        """All runs as one, with the first document of each class; the old ones go once it stands."""
        if len(self.runs) > 1:
            every = reduce(DataFrame.unionByName, map(self.read, self.runs))
            kept = every.groupBy("key", "span").agg(F.sum("n").alias("n"), *(F.min_by(c, "doc_id").alias(c) for c in ("a", "b", "last")), F.min("doc_id").alias("doc_id"), F.min_by("txt", "doc_id").alias("txt"))
            old, self.runs = self.runs, [self.write(kept)]
            for path in old:
                self.forget(path)

    def drop(self) -> None:
        """Removes all runs."""
        for path in self.runs:
            self.forget(path)
        self.runs = []

    def add(self, batch: DataFrame, texts: DataFrame) -> DataFrame:
        """(doc_id, txt, ranges): half-open word ranges of the batch that repeat an earlier document. ``texts`` holds all documents so far."""
        if len(self.runs) >= self.fanout:
            self.compact()
        found = stored(fingerprints(batch, self.window, self.gram), "found")
        path = self.write(classes_of(found))
        new = self.read(path)
        known = None
        if self.runs:
            # buckets of the run and of the older ones are merged in place: neither side is exchanged
            met = [self.read(old).join(new.select("key"), "key", "left_semi") for old in self.runs]
            known = cut(reduce(DataFrame.unionByName, met))
        classes = judge(new, known)
        rows = stored(likely(found, classes.select("key")).join(classes, ["key", "span"]), "judged")
        again = rows.where("first < doc_id").select("doc_id", "txt", "a", (F.col("last") + self.window).alias("b"))
        own = rows.where("first = doc_id AND fresh").select("doc_id", "txt", "a", "b", "last")
        if known is not None:
            own = own.union(known.join(classes, ["key", "span"]).where("first = doc_id AND fresh").select("doc_id", "txt", "a", "b", "last"))
        hashes = window_hashes(texts, own, self.window)
        hashes = stored(hashes, "windows")
        first = cut(hashes.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("final")).where("first < final"))
        proved = maybe_in(hashes, "w1", first.select("w1")).where("_maybe").join(first, ["w1", "w2"]).where("first < doc_id").select("doc_id", "txt", "a", "b")
        self.runs.append(path)
        return cut(again.union(proved).groupBy("doc_id", "txt").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))


def remove(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every document without the words in its ranges (doc_id, txt, ranges)."""
    docs = docs.select("doc_id", F.hash("text").alias("txt"), "text")
    flagged = maybe_in(docs, "doc_id", ranges.select("doc_id"))
    some = flagged.where("_maybe").join(ranges, ["doc_id", "txt"], "left").select("doc_id", "text", "ranges")
    kind = ranges.schema["ranges"].dataType
    every = flagged.where("NOT _maybe").select("doc_id", "text", F.lit(None).cast(kind).alias("ranges")).unionByName(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1).cast(pa.large_binary()), batch.column(2)):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                gone = list(merged([(s["a"], s["b"]) for s in spans.as_py() or ()]))
                for a, b in reversed(gone):
                    del words[a:b]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return every.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: every word goes that a window repeated from a smaller doc_id covers.

    Windows are judged on the input. Null text has no words; a null doc_id has no order, so its text is kept whole
    and removes nothing. Rows that repeat an id are judged each by its own text, and none of them against another; rows
    that repeat id and text come out alike. An empty table gives no rows. Other columns are not carried.
    """
    fair_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    cuts = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    index, found = FingerprintIndex(docs.sparkSession, window=window), None
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        batch = docs.where("doc_id IS NOT NULL" if lo is None else F.col("doc_id") > lo)
        so_far = docs.where("doc_id IS NOT NULL")
        if hi is not None:
            batch, so_far = batch.where(F.col("doc_id") <= hi), so_far.where(F.col("doc_id") <= hi)
        part = index.add(batch, so_far)
        # verified windows of historical documents were judged with their own batch
        part = part if lo is None else part.where(F.col("doc_id") > lo)
        found = part if found is None else found.unionByName(part)
    index.drop()
    return remove(docs, found)


def digests(deduplicated: DataFrame) -> DataFrame:
    """The kept texts as their SHA-256."""
    return deduplicated.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
first AS (SELECT k, min(doc_id) AS m FROM wins GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM wins JOIN first USING (k) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
