"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), which is linear in the number of
features. The parameters are fitted in numpy on a bounded sample of labelled rows and sent to the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import fair_batches

#: Word buckets, rank of the interactions, and labelled rows used for fitting at most.
BUCKETS, RANK, FIT_ROWS = 1 << 16, 8, 8000
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 128, 0.02, 1e-4, 7
THRESHOLD, FOLDS = 0.3, 5

_CLASSES = [W.table_of(c) for c in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\v\f\r", b"\n", b".,;:", b"!?", b"|", b"#$%&*@~^_=+<>/\\", bytes(range(128, 256)), b"()[]{}\"'`-")]
N_STATS = 2 * len(_CLASSES) + 9


def structure(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rows x N_STATS: shares of byte classes and whether they occur, word shape and repetition, and length metadata."""
    n, rows = np.diff(offsets).astype(float), len(offsets) - 1
    row_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    row_of_word = np.repeat(np.arange(rows), np.diff(first))
    n_words = np.diff(first).astype(float)
    cols = []
    for c in _CLASSES:
        count = np.bincount(row_of_byte[c[data]], minlength=rows)
        cols += [count / np.maximum(n, 1), np.log1p(count)]
    size = (end - start).astype(float)
    mean = np.bincount(row_of_word, size, rows) / np.maximum(n_words, 1)
    var = np.bincount(row_of_word, size * size, rows) / np.maximum(n_words, 1) - mean * mean

    def fresh(values: np.ndarray, row: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Share of distinct values in each row, and the share of its most frequent one."""
        if not len(values):
            return np.ones(rows), np.zeros(rows)
        order = np.lexsort((values, row))
        v, r = values[order], row[order]
        head = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (r[1:] != r[:-1])])
        runs = np.diff(np.r_[head, len(v)])
        top = np.zeros(rows)
        np.maximum.at(top, r[head], runs)
        return np.bincount(r[head], minlength=rows) / np.maximum(total, 1), top / np.maximum(total, 1)

    distinct, top = fresh(hashes, row_of_word, n_words)
    same = row_of_word[1:] == row_of_word[:-1]
    pairs = W.mix(hashes[1:] * W.U(3) + hashes[:-1])[same] if len(hashes) > 1 else hashes[:0]
    distinct2, top2 = fresh(pairs, row_of_word[1:][same] if len(hashes) > 1 else row_of_word[:0], np.maximum(n_words - 1, 0))
    twice = np.bincount(row_of_word[1:][same & (hashes[1:] == hashes[:-1])], minlength=rows) / np.maximum(n_words, 1) if len(hashes) > 1 else np.zeros(rows)
    cols += [mean, np.sqrt(np.maximum(var, 0)), distinct, top, np.where(n_words > 1, distinct2, 1), top2, twice, np.log1p(n_words), np.log1p(n)]
    return np.stack(cols, 1)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, statistics, row, bucket, value): for each chunk, its sparse unit-length word vectors."""
    for lo, hi, data, offsets in W.chunks(column):
        start, end, first = W.words(data, offsets)
        hashes = W.Prefix(W.LOWER[data]).spans(start, end)
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        key, count = np.unique(row * BUCKETS + (hashes % W.U(BUCKETS)).astype(np.int64), return_counts=True)
        row, bucket = key // BUCKETS, key % BUCKETS
        value = np.log1p(count)
        norm = np.sqrt(np.bincount(row, value * value, hi - lo))
        yield lo, hi, structure(data, offsets, start, end, first, hashes), row, bucket, value / norm[row]


class Machine:
    """Weights of the factorisation machine; the statistics are the features after the word buckets."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.std = mean, std
        self.w0 = np.zeros(1)
        self.w = np.zeros(BUCKETS + N_STATS)
        self.v = rng.normal(0, 0.02, (BUCKETS + N_STATS, RANK))

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.std, -4, 4) / 4

    def raw(self, stats: np.ndarray, row: np.ndarray, bucket: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, the sums of v x, and the scaled statistics."""
        n, x = len(stats), self.scaled(stats)
        vx = self.v[bucket] * value[:, None]
        sums = np.stack([np.bincount(row, vx[:, f], n) for f in range(RANK)], 1) + x @ self.v[BUCKETS:]
        squares = np.bincount(row, (vx * vx).sum(1), n) + (x * x) @ (self.v[BUCKETS:] ** 2).sum(1)
        linear = self.w0 + np.bincount(row, self.w[bucket] * value, n) + x @ self.w[BUCKETS:]
        return linear + 0.5 * ((sums * sums).sum(1) - squares), sums, x

    def fit(self, stats: np.ndarray, docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> None:
        """Adagrad on the logistic loss; rows of the rarer label weigh up to three times as much."""
        rng = np.random.default_rng(SEED)
        share = np.clip(label.mean(), 0.05, 0.95)
        weight = np.where(label == 1, 1.0, min(3.0, max(1 / 3, share / (1 - share))))
        grad2 = [np.full_like(p, 1e-3) for p in (self.w0, self.w, self.v)]
        for _ in range(EPOCHS):
            order = rng.permutation(len(label))
            for at in range(0, len(order), BATCH):
                part = order[at:at + BATCH]
                row = np.repeat(np.arange(len(part)), [len(docs[i][0]) for i in part])
                bucket = np.concatenate([docs[i][0] for i in part])
                value = np.concatenate([docs[i][1] for i in part])
                z, sums, x = self.raw(stats[part], row, bucket, value)
                g = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part)
                used, inverse = np.unique(bucket, return_inverse=True)
                gw = np.bincount(inverse, g[row] * value, len(used))
                gv_each = g[row, None] * value[:, None] * (sums[row] - self.v[bucket] * value[:, None])
                gv = np.stack([np.bincount(inverse, gv_each[:, f], len(used)) for f in range(RANK)], 1)
                tail = np.arange(BUCKETS, BUCKETS + N_STATS)
                index = np.r_[used, tail]
                gw = np.r_[gw, g @ x] + DECAY * self.w[index]
                gv = np.r_[gv, x.T @ (g[:, None] * sums) - ((x * x).T @ g)[:, None] * self.v[tail]] + DECAY * self.v[index]
                for p, h, i, d in ((self.w0, grad2[0], slice(None), np.array([g.sum()])), (self.w, grad2[1], index, gw), (self.v, grad2[2], index, gv)):
                    h[i] += d * d
                    p[i] -= RATE * 5 * d / np.sqrt(h[i])


    def centre(self, z: np.ndarray, label: np.ndarray) -> None:
        """Shifts the bias so that THRESHOLD lies in the middle of the cut that best balances both labels' errors."""
        ones, zeros = np.sort(z[label == 1]), np.sort(z[label == 0])
        if not len(ones) or not len(zeros):
            return
        edges = np.sort(z)
        cuts = np.r_[edges[0] - 1, (edges[1:] + edges[:-1]) / 2]
        right = 1 - np.searchsorted(ones, cuts) / len(ones) + np.searchsorted(zeros, cuts) / len(zeros)
        best = np.flatnonzero(right >= right.max() - 1e-12)
        self.w0 = self.w0 + np.log(THRESHOLD / (1 - THRESHOLD)) - (edges[max(best[0] - 1, 0)] + edges[best[-1]]) / 2


def held_out(id_col: str, folds: int, fold: int):
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Machine:
    """Fits on the ``fit_rows`` labelled rows with the smallest hashes of their ids, outside the held-out fold.

    Labels that are null are left out; with no labelled row left every text scores about 0.5.
    """
    fair_batches(docs.sparkSession)
    chosen = labels.where(~held_out("doc_id", FOLDS, 0) & F.col("quality").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "quality").limit(fit_rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0)
            for lo, hi, stats, row, bucket, value in features(batch.column(1)):
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([label[lo:hi].cast(pa.int32()), pa.array([s.tobytes() for s in stats]), pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["quality", "stats", "bucket", "value"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text", "doc_id").mapInArrow(extract, "quality int, stats binary, bucket binary, value binary").collect()
    rows.sort(key=lambda r: (bytes(r.stats), r.quality))
    if not rows:
        return Machine(np.zeros(N_STATS), np.ones(N_STATS))
    stats = np.stack([np.frombuffer(r.stats) for r in rows])
    machine = Machine(stats.mean(0), stats.std(0) + 1e-6)
    words = [(np.frombuffer(r.bucket, np.int32), np.frombuffer(r.value, np.float32).astype(float)) for r in rows]
    label = np.array([float(r.quality) for r in rows])
    machine.fit(stats, words, label)
    z = []
    for at in range(0, len(rows), BATCH):
        part = words[at:at + BATCH]
        row = np.repeat(np.arange(len(part)), [len(b) for b, _ in part])
        z.append(machine.raw(stats[at:at + BATCH], row, np.concatenate([b for b, _ in part]), np.concatenate([v for _, v in part]))[0])
    machine.centre(np.concatenate(z), label)
    return machine


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts are scored by their statistics.

    Rows that repeat an id are scored each. Other columns are not read. An empty table gives no rows.
    """
    fair_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((machine.mean, machine.std, machine.w0, machine.w.astype(np.float32), machine.v.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.__new__(Machine)
        m.mean, m.std, m.w0, m.w, m.v = shared.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for lo, hi, stats, row, bucket, value in features(batch.column(2)):
                z[lo:hi] = m.raw(stats, row, bucket, value)[0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out("doc_id", FOLDS, 0), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
