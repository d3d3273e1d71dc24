"""Deduplication of repeated byte strings by suffix sorting.

Only suffixes that can repeat are sorted: runs of 100-byte windows whose anchor occurs more than once. Copies of a
run with the same content are one run; what differs around a common anchor is sorted by deep-shallow sorting: a
multikey quicksort on 8-byte words to a shallow depth, and blind tries for the groups that still agree there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .anchors import RUNS, emit, merged, runs, with_hash
from .common import cut, fair_batches, maybe_in, stored

#: Bytes of a window and of the n-gram that anchors it; depth in bytes of the quicksort.
WINDOW, GRAM, SHALLOW = 100, 20, 24
#: Bytes of text hashed at once; what a Python worker holds is some hundred times that.
CHUNK = 1 << 18
#: Classes of an anchor beyond which its windows are dealt one by one.
HOT = 1 << 15
#: Elements of a segment from which the quicksort splits no further.
FEW = 4096


class BlindTrie:
    """A trie of strings of one length that keeps only the positions where strings differ.

    An insertion walks down by the characters at those positions, compares with the one leaf it meets, and branches
    where the two first differ. Leaves hold the numbers of equal strings.
    """

    def __init__(self, text: bytes, number: int):
        self.root: list = [None, text, [number]]

    def insert(self, text: bytes, number: int) -> None:
        node = self.root
        while node[0] is not None:
            child = node[1].get(text[node[0]])
            if child is None:
                child = next(iter(node[1].values()))
            node = child
        leaf = node[1]
        if leaf == text:
            node[2].append(number)
            return
        low, high = 0, len(text)
        while high - low > 1:
            mid = (low + high) // 2
            if leaf[low:mid] == text[low:mid]:
                low = mid
            else:
                high = mid
        node = self.root
        while node[0] is not None and node[0] < low:
            node = node[1][text[node[0]]]
        new = [None, text, [number]]
        if node[0] == low:
            node[1][text[low]] = new
        else:
            node[:] = [low, {leaf[low]: node[:], text[low]: new}, None]

    def ordered(self) -> Iterator[list[int]]:
        """The numbers of equal strings, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[0] is None:
                yield node[2]
            else:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]


def multikey_quicksort(word, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): 0..n-1 sorted by ``word(numbers, d)``, d < depth, and where strings with other words begin.

    All segments are split at once: each at the median of three into less, equal and greater, of which the equal part
    goes on with the next word. A segment is done when it has one element or no word left; when none has more than
    FEW, the rest is sorted directly.
    """
    order, level, begins = np.arange(n), np.zeros(n, np.int64), np.zeros(n, bool)
    begins[:1] = True
    active = np.arange(n)
    while len(active):
        start = np.flatnonzero(np.r_[True, begins[active[1:]] | (active[1:] != active[:-1] + 1)])
        size = np.diff(np.r_[start, len(active)])
        live = (size > 1) & (level[active[start]] < depth)
        keep = np.repeat(live, size)
        active, size = active[keep], size[live]
        if not len(active):
            break
        start = np.cumsum(size) - size
        own = np.repeat(np.arange(len(size)), size)
        numbers, d = order[active], level[active]
        if size.max() <= FEW:
            left = [word(numbers, np.minimum(d + k, depth - 1)) for k in range(depth)]
            by = np.lexsort((*left[::-1], own))
            order[active], level[active] = numbers[by], depth
            begins[active] = np.r_[True, np.any([np.diff(x[by].view(np.int64)) != 0 for x in (*left, own)], axis=0)]
            break
        key = word(numbers, d)
        middle, final = key[start + size // 2], key[start + size - 1]
        low, high = np.minimum(key[start], middle), np.maximum(key[start], middle)
        pivot = np.minimum(np.maximum(low, final), high)[own]
        side = (key > pivot).astype(np.int8) - (key < pivot)
        at = start[own]
        place = np.empty(len(active), np.int64)
        filled = np.zeros(len(size), np.int64)
        heads = np.zeros(len(active), bool)
        for s in (-1, 0, 1):
            mine = side == s
            before = np.cumsum(mine) - mine
            rank = before - before[start][own]
            place[mine] = (at + filled[own] + rank)[mine]
            many = np.add.reduceat(mine, start, dtype=np.int64)
            heads[(start + filled)[many > 0]] = True
            filled += many
        order[active[place]] = numbers
        level[active[place]] = d + (side == 0)
        begins[active] = heads
    return order, begins


def deep_shallow(text: bytes, starts: np.ndarray, depth: int = WINDOW, shallow: int = SHALLOW) -> Iterator[np.ndarray]:
    """Numbers of ``starts`` in the order of the ``depth``-byte strings there, equal strings together."""
    data = np.frombuffer(text + bytes(8), np.uint8)
    words = np.zeros(len(text) + 1, W.U)
    for i in range(8):
        words = (words << W.U(8)) | data[i:i + len(words)]
    word = lambda numbers, d: words[starts[numbers] + 8 * d]
    order, begins = multikey_quicksort(word, len(starts), shallow // 8)
    bounds = np.flatnonzero(np.r_[begins, True])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        part = order[a:b]
        if b - a == 1:
            yield part
            continue
        at = starts[part].tolist()
        rest = [text[s + shallow:s + depth] for s in at]
        if b - a == 2:
            if rest[0] == rest[1]:
                yield part
            else:
                first = 0 if rest[0] < rest[1] else 1
                yield part[first:first + 1]
                yield part[1 - first:2 - first]
            continue
        trie = BlindTrie(rest[0], 0)
        for i in range(1, len(rest)):
            trie.insert(rest[i], i)
        for numbers in trie.ordered():
            yield part[numbers]


def byte_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The anchor runs of every text's bytes, with positions counted in each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in W.chunks(batch.column(2), CHUNK):
                row, key, span, a, b, last = runs(W.Prefix(data), W.Prefix(data, 1), offsets, window, gram)
                yield emit(batch, row, lo, {"key": key, "span": span, "a": a - offsets[row], "b": b - offsets[row], "last": last - offsets[row]})

    return with_hash(docs).mapInArrow(run, RUNS)


def repeats(found: DataFrame) -> DataFrame:
    """(key, doc_id, txt, a, b, last, again, m): runs of classes met earlier (again), of anchors with m > 1 classes, and runs that repeat."""
    rows = found.repartition("key")
    # rows that repeat an id and its text share their rank
    same, anchor = Window.partitionBy("key", "span").orderBy("doc_id", "txt", "a"), Window.partitionBy("key").orderBy("span")
    rows = rows.withColumn("again", F.rank().over(same) > 1).withColumn("nth", F.dense_rank().over(anchor))
    rows = rows.withColumn("m", F.max("nth").over(Window.partitionBy("key")))
    return rows.where("again OR m > 1 OR last > b").select("key", "doc_id", "txt", "a", "b", "last", "again", "m")


def fragments(docs: DataFrame, opened: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, part, doc_id, txt, a, piece): the bytes under the windows a..b of each run; part is 0.

    Of an anchor with more than HOT classes each window is a piece of its own, and part is a hash of its ends, so that
    only windows that may be equal stay together.
    """
    wanted = cut(opened.groupBy("doc_id", "txt").agg(F.collect_set(F.struct("key", "a", "b", (F.col("m") > HOT).alias("hot"))).alias("runs")))
    texts = maybe_in(with_hash(docs), "doc_id", wanted.select("doc_id")).where("_maybe").join(wanted, ["doc_id", "txt"]).select("doc_id", "txt", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, txt, text, spans in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.large_binary()), batch.column(3)):
                text, rows = text.as_py() or b"", []
                for s in spans.as_py():
                    if s["hot"]:
                        for a in range(s["a"], s["b"] + 1):
                            piece = text[a:a + window]
                            rows.append((s["key"], int.from_bytes(piece[:4] + piece[-4:], "little", signed=True), a, piece))
                    else:
                        rows.append((s["key"], 0, s["a"], text[s["a"]:s["b"] + window]))
                for lo in range(0, len(rows), 4096):
                    key, part, a, piece = zip(*rows[lo:lo + 4096])
                    n = len(key)
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(part, pa.int64()), pa.array([doc.as_py()] * n, pa.int64()), pa.array([txt.as_py()] * n, pa.int32()), pa.array(a, pa.int64()), pa.array(piece, pa.binary())], names=["key", "part", "doc_id", "txt", "a", "piece"])

    return texts.mapInArrow(run, "key long, part long, doc_id long, txt int, a long, piece binary")


def sorted_repeats(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, txt, a, b): byte ranges of windows that equal an earlier one, by sorting the suffixes of the pieces of each anchor."""
    def flush(key: list, part: list, doc: list, txt: list, at: list, piece: list) -> pa.RecordBatch:
        count = np.array([len(p) - window + 1 for p in piece])
        base = np.cumsum([0, *map(len, piece)])[:-1]
        row = np.repeat(np.arange(len(piece)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        text, starts = b"".join(piece), base[row] + inner
        doc_id, txt, place = np.array(doc)[row], np.array(txt)[row], np.array(at)[row] + inner
        by = np.lexsort((place, txt, doc_id))
        moved = (np.diff(doc_id[by]) != 0) | (np.diff(txt[by]) != 0) | (np.diff(place[by]) != 0)
        order = np.empty(len(row), np.int64)
        order[by] = np.cumsum(np.r_[0, moved])
        groups = [numbers for numbers in deep_shallow(text, starts, window) if len(numbers) > 1]
        out = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        if groups:
            size = np.array([len(g) for g in groups])
            first = np.minimum.reduceat(order[out], np.cumsum(size) - size)
            out = out[order[out] != np.repeat(first, size)]
        out = out[np.argsort(order[out])]
        d, t, p = doc_id[out], txt[out], place[out]
        head = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] > p[:-1] + 1)])[:len(d)]
        tail = np.r_[head[1:], len(d)] - 1
        return pa.RecordBatch.from_arrays([pa.array(d[head], pa.int64()), pa.array(t[head], pa.int32()), pa.array(p[head], pa.int64()), pa.array(p[tail] + window if len(d) else p, pa.int64())], names=["doc_id", "txt", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], [], []]
        held = 0
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                if held > 1 << 18 and (values[0] != rows[0][-1] or values[1] != rows[1][-1]):
                    yield flush(*rows)
                    rows, held = [[], [], [], [], [], []], 0
                for column, value in zip(rows, values):
                    column.append(value)
                held += len(values[5])
        if rows[0]:
            yield flush(*rows)

    return pieces.repartition("key", "part").sortWithinPartitions("key", "part", "doc_id", "a").mapInArrow(run, "doc_id long, txt int, a long, b long")


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every document: bytes covered by an earlier string go.

    A string of ``window`` bytes is earlier by doc_id, or by its place in the same document; all are judged on the
    input. Null text is empty. A null doc_id has no order: its text is kept whole and removes nothing. Rows that
    repeat an id with another text stand in the order of their texts' hashes; rows that repeat id and text are one
    document and come out alike. An empty table gives no rows. Other columns are not carried.
    """
    fair_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    judged = stored(repeats(byte_runs(docs, window)), "judged")
    again = judged.where("again").select("doc_id", "txt", "a", (F.col("b") + window).alias("b"))
    close = judged.where("last > b").select("doc_id", "txt", (F.col("b") + 1).alias("a"), (F.col("last") + window).alias("b"))
    sorted_out = sorted_repeats(fragments(docs, judged.where("m > 1 AND NOT again"), window), window)
    ranges = cut(again.union(close).union(sorted_out).groupBy("doc_id", "txt").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))
    flagged = maybe_in(docs.select("doc_id", F.hash("text").alias("txt"), "text"), "doc_id", ranges.select("doc_id"))
    some = flagged.where("_maybe").join(ranges, ["doc_id", "txt"], "left").select("doc_id", "text", "ranges")
    every = flagged.where("NOT _maybe").select("doc_id", "text", F.lit(None).cast(ranges.schema["ranges"].dataType).alias("ranges")).unionByName(some)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, kept = [], [], [], []
            for text, found in zip(batch.column(1).cast(pa.large_binary()), batch.column(2)):
                text = text.as_py() or b""
                gone = list(merged([(s["a"], s["b"]) for s in found.as_py() or ()]))
                n.append(len(text))
                removed.append(sum(b - a for a, b in gone))
                spans.append(len(gone))
                kept.append(b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return every.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(deduplicated: DataFrame) -> DataFrame:
    """The kept bytes as their SHA-256."""
    return deduplicated.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 AS BIGINT) - 99)) AS s FROM d)),
hits AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM wins) WHERE r > 1),
marks AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM hits),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS c FROM marks) GROUP BY doc_id, c),
ends AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM runs UNION ALL SELECT doc_id, 0, min(a) FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * e.a + 1, 2 * (coalesce(e.b, len(h) // 2) - e.a)), '' ORDER BY e.a) AS t FROM ends e JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN h ELSE coalesce(t, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
