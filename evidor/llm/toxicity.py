"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all rows of the fitting folds, labels unread, is the unlabelled set. Word and word-start
hashes that are far more common in positives are selected; a linear model over their counts minimises

    prior * E_pos[l(s)] + max(0, E_unl[l(-s)] - prior * E_pos[l(-s)]),   l(s) = 1 / (1 + exp(s)),

so that unlabelled toxic texts are not learnt as negatives. The prior is the toxic share of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import cut, fair_batches

#: Rows used for fitting at most, and features selected at most.
POSITIVES, UNLABELLED, SELECTED = 4000, 8000, 512
#: Lengths in bytes of the word starts that are features beside the whole words.
STARTS = (4, 5, 6)
#: Positives that a feature occurs in at least: fewer could be chance, whatever the sample's size.
LEAST = 4
#: A word's count and a text's length are saturating features: a word said 8 times marks a text as much as one said more
#: often, and no text is so long that hits in it say nothing. Every word of a text is read and counted.
MOST_COUNT, STEPS, RATE, DECAY = 8, 1000, 0.05, 1e-4
#: A text's number of words counts as a feature in units of UNIT_WORDS, up to MOST_UNITS: a hit in a long text says less.
UNIT_WORDS, MOST_UNITS = 250, 8
THRESHOLD, FOLDS, HELD_FOLD = 0.3, 4, 2


def hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of each word, lower case between non-alphanumeric ASCII, and of the starts of longer words; each row's units of length."""
    low = W.LOWER[data]
    start, end, first = W.words(low, offsets, W.NOT_ALNUM)
    row, spans = np.repeat(np.arange(len(offsets) - 1), np.diff(first)), W.Prefix(low)
    rows, out = [row], [spans.spans(start, end)]
    for n in STARTS:
        long = end - start > n
        rows.append(row[long])
        out.append(spans.spans(start[long], start[long] + n) ^ W.U(n))
    return np.concatenate(rows), np.concatenate(out), np.minimum(np.diff(first) / UNIT_WORDS, MOST_UNITS)


def risk_step(theta: np.ndarray, xp: np.ndarray, xu: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk at ``theta`` and the direction to step against: its slope, or where the bracket is negative the bracket's, reversed."""
    sp, su = 1 / (1 + np.exp(-xp @ theta)), 1 / (1 + np.exp(-xu @ theta))
    slope_p = prior * ((sp * (1 - sp)) @ xp) / len(xp)
    as_pos, as_neg = -slope_p, ((su * (1 - su)) @ xu) / len(xu) - slope_p
    bracket = su.mean() - prior * sp.mean()
    return prior * (1 - sp).mean() + max(0, bracket), as_pos + as_neg if bracket >= 0 else -as_neg


def matrix(units: list[float], counts: list[bytes]) -> np.ndarray:
    """A row for each text: its units of length, and its counts from bytes. No number is a Python object on the way."""
    out = np.zeros((len(units), 1 + (len(counts[0]) if counts else 0)), np.float32)
    for row, unit, packed in zip(out, units, counts):
        row[0], row[1:] = unit, np.frombuffer(packed, np.uint8)
    return out


class Detector:
    """Selected hashes in ascending order, their weights, the weight of a unit of length and the bias."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.astype(W.U))
        self.weights, self.unit, self.bias = np.zeros(len(hashes)), 0.0, 0.0

    def counts(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, end row, units of length, row, feature, capped count) for each chunk."""
        sieve = np.zeros(1 << 16, bool)
        sieve[(self.hashes & W.U(0xFFFF)).astype(np.int64)] = True
        for lo, hi, data, offsets in W.chunks(column):
            row, h, units = hashes_of(data, offsets)
            maybe = sieve[(h & W.U(0xFFFF)).astype(np.int64)]
            row, h = row[maybe], h[maybe]
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            hit = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
            key, count = np.unique(row[hit] * max(1, len(self.hashes)) + at[hit], return_counts=True)
            yield lo, hi, units, key // max(1, len(self.hashes)), key % max(1, len(self.hashes)), np.minimum(count, MOST_COUNT)

    def fit(self, pos: np.ndarray, unl: np.ndarray, prior: float) -> None:
        """Adam on the non-negative risk, full batch; where the bracket is negative its gradient is reversed. Units come first."""
        theta = np.r_[np.log(prior / (1 - prior)), np.zeros(1 + len(self.hashes))].astype(np.float32)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        xp, xu = np.c_[np.ones(len(pos), np.float32), pos], np.c_[np.ones(len(unl), np.float32), unl]
        del pos, unl
        for t in range(1, STEPS + 1):
            g = risk_step(theta, xp, xu, prior)[1]
            g[1:] += DECAY * theta[1:]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.bias, self.unit, self.weights = float(theta[0]), float(theta[1]), theta[2:]


def in_fold(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Detector:
    """Fits on at most ``positives`` confirmed rows and ``unlabelled`` rows of any kind, those with the smallest id hashes.

    No label of the held-out fold is read. Without a confirmed row every text gets the same low score.
    """
    fair_batches(docs.sparkSession)
    open_labels = labels.where(~in_fold() & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    n, n_toxic = open_labels.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.9, max(0.001, n_toxic / max(1, n)))
    pos = open_labels.where("toxic = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(positives).withColumn("pos", F.lit(True))
    unl = docs.select("doc_id").where(~in_fold()).orderBy(F.xxhash64("doc_id")).limit(unlabelled).distinct().withColumn("pos", F.lit(False))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(1)):
                row, h, units = hashes_of(data, offsets)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                ends = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64))), pa.array(units)], names=["pos", "h", "units"])

    sample = docs.select("doc_id", "text").join(F.broadcast(pos.unionByName(unl)), "doc_id").select("pos", "text")
    sample = cut(sample.mapInArrow(extract, "pos boolean, h array<long>, units double"))
    n_pos, n_unl = sample.agg(F.count_if("pos"), F.count_if(~F.col("pos"))).first()
    detector = Detector(np.zeros(0, np.int64))
    if not n_pos or not n_unl:
        detector.bias = -5.0
        return detector
    each = sample.select("pos", F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("u"))
    expected = (F.col("u") + 0.5) * (n_pos / n_unl)
    each = each.where(F.col("p") >= LEAST).withColumn("z", (F.col("p") - expected) / F.sqrt(expected)).where((F.col("z") > 4) & (F.col("p") > 3 * expected))
    detector = Detector(np.array([r.h for r in each.orderBy(F.desc("z"), "h").limit(SELECTED).select("h").collect()], np.int64).view(W.U))
    known = detector.hashes

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h in batch.column(1):
                h = h.values.to_numpy().view(W.U)
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                found.append(np.bincount(at[known[at] == h], minlength=len(known)).clip(max=MOST_COUNT).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], names=["pos", "units", "x"])

    hits = sample.mapInArrow(counted, "pos boolean, units double, x binary").collect() if len(known) else []
    x = matrix([r.units for r in hits], [r.x for r in hits])
    is_pos = np.array([r.pos for r in hits], bool)
    del hits
    if len(x):
        order = np.lexsort((*x.T[::-1], is_pos))
        pos, unl = x[order[is_pos[order]]], x[order[~is_pos[order]]]
        del x
        sides = [unl, pos]
        del pos, unl
        detector.fit(sides.pop(), sides.pop(), prior)
    else:
        detector.bias = float(np.log(prior / (1 - prior)))
    return detector


def score_toxicity(docs: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; null and empty texts get the score of a text without hits.

    Rows that repeat an id are scored each. Other columns are not read. An empty table gives no rows.
    """
    fair_batches(docs.sparkSession)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.full(batch.num_rows, detector.bias)
            for lo, hi, units, row, feature, count in detector.counts(batch.column(2)):
                z[lo:hi] += detector.unit * units + np.bincount(row, detector.weights[feature] * count, hi - lo)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), in_fold().alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with its columns, without the rows that score THRESHOLD or more."""
    fair_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.full(batch.num_rows, detector.bias)
            for lo, hi, units, row, feature, count in detector.counts(batch.column(at)):
                z[lo:hi] += detector.unit * units + np.bincount(row, detector.weights[feature] * count, hi - lo)
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) < THRESHOLD))

    return docs.mapInArrow(clean, docs.schema)
