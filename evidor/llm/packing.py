"""Cost-balanced packing of token sequences.

Every document becomes ids and a closing id. Its full runs of ``capacity`` ids are sequences of their own. The rest
of each document is packed in groups of bounded size: documents go in descending length to the sequence with the
lowest estimated cost (a linear term, and a quadratic one for attention within a document) that still has room. As
many sequences are opened as the group's tokens need; what fits nowhere whole is cut into the gaps that are left, so
a group pads at most the end of its sequences by less than one capacity.
"""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import fair_batches

CAPACITY, END_ID = 2048, 1
#: Documents of one packing group, about; a group is what one task holds at once (2 bytes for each id).
GROUP_DOCS = 2000
#: Cost of n ids of one document: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PARTS = "grp long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class Encoder:
    """The ids of a ``tokenizers`` file; its rank file beside it, for the same ids, is used where there is one."""

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast, ranks = None, path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def crc(ids: bytes) -> int:
    """CRC-32 of ids held as 32-bit little-endian integers."""
    return zlib.crc32(ids)


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


class Room:
    """Open sequences by the room they have: finds the cheapest with at least so much room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.heaps: dict[int, list] = {}
        self.best = [(float("inf"), -1, 0)] * (2 * self.size)

    def _mend(self, room: int) -> None:
        i, best = room + self.size, self.best
        heap = self.heaps.get(room)
        new = heap[0] if heap else (float("inf"), -1, 0)
        # what does not change in a node does not change above it
        while i and best[i] != new:
            best[i] = new
            new = min(new, best[i ^ 1])
            i >>= 1

    def put(self, room: int, spent: float, seq: int) -> None:
        if room > 0:
            heapq.heappush(self.heaps.setdefault(room, []), (spent, seq, room))
            self._mend(room)

    def take(self, least: int) -> tuple[float, int, int] | None:
        """(cost so far, sequence, room) of the cheapest with ``least`` room or more; it leaves the structure."""
        lo, hi, found = least + self.size, 2 * self.size, (float("inf"), -1, 0)
        while lo < hi:
            if lo & 1:
                found, lo = min(found, self.best[lo]), lo + 1
            if hi & 1:
                hi -= 1
                found = min(found, self.best[hi])
            lo, hi = lo >> 1, hi >> 1
        if found[1] < 0:
            return None
        heapq.heappop(self.heaps[found[2]])
        self._mend(found[2])
        return found


def plan(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of every piece of a group of items shorter than ``capacity``."""
    total = sum(lengths)
    opened = -(-total // capacity)
    room, left = Room(capacity), dict.fromkeys(range(opened), capacity)
    for s in left:
        room.put(capacity, 0.0, s)
    out, cut_later = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if not n:
            continue
        found = room.take(n)
        if found is None:
            cut_later.append(i)
            continue
        spent, s, had = found
        out.append((i, 0, n, s, capacity - had))
        left[s] = had - n
        room.put(had - n, spent + cost(n), s)
    gaps = sorted(((r, s) for s, r in left.items() if r), key=lambda g: (-g[0], g[1]))
    at = 0
    for i in cut_later:
        start = 0
        while start < lengths[i]:
            r, s = gaps[at]
            n = min(r, lengths[i] - start)
            out.append((i, start, n, s, capacity - r))
            start += n
            gaps[at] = (r - n, s)
            at += gaps[at][0] == 0
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` ids: the columns of ``PIECES``.

    Null text is an empty document: the closing id alone. Rows that repeat an id are documents of their own. An empty
    table gives no rows. Other columns are not carried. Sequence ids are unique but not consecutive.
    """
    fair_batches(docs.sparkSession)
    groups = max(1, -(-docs.count() // group_docs))
    names = [c.split()[0] for c in _PARTS.split(", ")]
    schema = pa.schema([*((c, pa.int64()) for c in names[:-1]), (names[-1], pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of ``capacity`` ids, and the rest of each document with its ids (2 bytes each where they fit)."""
        encoder = Encoder(tokenizer)
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for grp, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.array([*encoder.ids(text.as_py() or ""), END_ID], dtype="<u4")
                full = len(ids) // capacity * capacity
                for start in range(0, full, capacity):
                    rows.append((grp, doc, start, capacity, crc(ids[start:start + capacity].tobytes()), len(ids), None))
                if tail := len(ids) - full:
                    kept = ids[full:].astype("<u2") if ids[full:].max() < 1 << 16 else ids[full:]
                    rows.append((grp, doc, full, tail, crc(ids[full:].tobytes()), len(ids), kept.tobytes()))
                    held += kept.nbytes
                if len(rows) >= 2000 or held > 4 << 20:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    def arrange(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        """Places the pieces of one group; a cut piece's checksum is taken from its own ids."""
        part = part.sort_values(["doc_id", "start", "doc_tokens", "ids_crc32"], kind="stable").reset_index(drop=True)
        whole = part[part["length"] == capacity].assign(offset=0)
        whole["sequence_id"] = (int(key[0]) << 32) + np.arange(len(whole))
        rest = part[part["length"] < capacity].reset_index(drop=True)
        lengths = rest["length"].tolist()
        placed = pd.DataFrame(plan(lengths, capacity), columns=["item", "cut", "n", "seq", "offset"])
        out = rest.iloc[placed["item"]].reset_index(drop=True).assign(offset=placed["offset"], sequence_id=(int(key[0]) << 32) + len(whole) + placed["seq"])
        # in lists, as setting single cells of a frame takes longer than all the rest
        was, cut, size, sums, packed = (c.tolist() for c in (out["length"], placed["cut"], placed["n"], out["ids_crc32"], out["ids"]))
        for i in np.flatnonzero(placed["n"].to_numpy() != out["length"].to_numpy()).tolist():
            width = 2 if len(packed[i]) == 2 * was[i] else 4
            ids = np.frombuffer(packed[i], f"<u{width}", size[i], cut[i] * width)
            sums[i] = crc(ids.astype("<u4").tobytes())
        out = out.assign(start=out["start"] + placed["cut"], length=size, ids_crc32=sums)
        return pd.concat([whole, out], ignore_index=True)[[c.split()[0] for c in PIECES.split(", ")]]

    dealt = docs.select(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(groups)).alias("grp"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return dealt.mapInArrow(encode, _PARTS).groupBy("grp").applyInPandas(arrange, PIECES)
