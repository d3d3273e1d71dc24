"""Anchors of repeated windows: for every window of a text the smallest n-gram hash in it, found in one pass.

Two equal windows have the same anchor at the same place, so windows need comparing only where anchors are equal.
Consecutive windows with one anchor form a run; runs with equal anchors and equal whole content are one class. Where a
text repeats itself so closely that equal runs follow each other, they are one row that tells where the last one ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import cut, maybe_in

_BITS = 24
_LOW = W.U((1 << _BITS) - 1)

#: key: hash of the anchor; span: hash, by another base, of the run's content and the anchor's place; txt: hash of the
#: document's text, which tells rows with one doc_id apart; a, b: the run's first and last window start; last: b, or the
#: last window start of the equal runs that follow it without a gap.
RUNS = "key long, span long, a long, b long, last long, doc_id long, txt int"


def starts_of(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every whole window; ``first`` holds the rows' bounds."""
    count = np.maximum(np.diff(first) - window + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[:-1][row]


def runs(values: W.Prefix, others: W.Prefix, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, key, span, a, b, last) of every run, with positions counted over all rows; span is hashed from ``others``."""
    h = values.windows(gram)
    row, start = starts_of(first, window)
    if not len(start):
        return row, *(np.zeros(0, W.U),) * 2, start, start, start
    width = window - gram + 1
    at = np.empty(len(h) - width + 1, np.int64)
    step = 1 << (_BITS - 1)
    for lo in range(0, len(at), step):
        part = h[lo:min(len(h), lo + step + width - 1)]
        low = (part & ~_LOW) | np.arange(len(part), dtype=W.U)
        have = 1
        while have < width:
            shift = min(have, width - have)
            low = np.minimum(low[:len(low) - shift], low[shift:])
            have += shift
        at[lo:lo + len(low)] = (low & _LOW).astype(np.int64) + lo
    place = at[start]
    head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (row[1:] != row[:-1])])
    a, b, place = start[head], start[np.r_[head[1:], len(start)] - 1], place[head]
    span = W.mix(others.spans(a, b + window) + (place - a).astype(W.U) * W.U(0xD6E8FEB86659FD93))
    row, key = row[head], h[place]
    if len(row) > 1:
        same = (key[1:] == key[:-1]) & (span[1:] == span[:-1]) & (row[1:] == row[:-1])
        head = np.flatnonzero(np.r_[True, ~same])
        return row[head], key[head], span[head], a[head], b[head], b[np.r_[head[1:], len(b)] - 1]
    return row, key, span, a, b, b


def classes_of(found: DataFrame) -> DataFrame:
    """One row a class: key, span, n runs, and the first document with one of its runs there."""
    return found.groupBy("key", "span").agg(F.count("*").alias("n"), *(F.min_by(c, "doc_id").alias(c) for c in ("a", "b", "last")), F.min("doc_id").alias("doc_id"), F.min_by("txt", "doc_id").alias("txt"))


def judge(classes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, span, first, m, fresh): the classes of anchors with several runs, here or in ``known``. Written once.

    first: the first document of the class; m: the classes of the anchor; fresh: one of several has no run in ``known``.
    All of it is grouped with partial sums, so that a run that a third of all documents hold is no task's burden.
    """
    keys = classes.groupBy("key").agg(F.sum("n").alias("n"))
    if known is not None:
        keys = keys.join(known.select("key").distinct().withColumn("past", F.lit(True)), "key", "left").where("n > 1 OR past")
    else:
        keys = keys.where("n > 1")
    keys = cut(keys.select("key"))
    every = likely(classes, keys).select("key", "span", "doc_id", F.lit(True).alias("new"))
    if known is not None:
        every = every.union(known.select("key", "span", "doc_id", F.lit(False)))
    each = cut(every.groupBy("key", "span").agg(F.min("doc_id").alias("first"), F.min("new").alias("unseen")))
    anchors = each.groupBy("key").agg(F.count("*").alias("m"), F.max("unseen").alias("any"))
    return cut(each.join(anchors, "key").select("key", "span", "first", "m", (F.col("any") & (F.col("m") > 1)).alias("fresh")))


def likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is not in the one column of ``keys``."""
    return maybe_in(rows, "key", keys).where("_maybe").select(*rows.columns)


def with_hash(docs: DataFrame) -> DataFrame:
    """doc_id, txt, text of the documents that have an id."""
    return docs.where("doc_id IS NOT NULL").select("doc_id", F.hash("text").alias("txt"), "text")


def emit(batch: pa.RecordBatch, rows: np.ndarray, lo: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A batch of the given 64-bit columns with doc_id and txt, taken by row."""
    rows = pa.array(rows + lo)
    arrays = [pa.array(v.view(np.int64) if v.dtype == W.U else v.astype(np.int64)) for v in columns.values()]
    return pa.RecordBatch.from_arrays([*arrays, batch.column(0).take(rows), batch.column(1).take(rows)], names=[*columns, "doc_id", "txt"])


def merged(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The union of half-open ranges, as ascending maximal runs."""
    at = None
    for a, b in sorted(ranges):
        if at is None:
            at = [a, b]
        elif a <= at[1]:
            at[1] = max(at[1], b)
        else:
            yield tuple(at)
            at = [a, b]
    if at is not None:
        yield tuple(at)
