"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations only.

Pass one finds, for the slots of every text hash, which were met at least twice, and packs them into a filter of 4 KB
bitmaps. Pass two tests each hash against the filter: a hash with a slot that was met once occurs once, and its row
goes straight to the result. Only the others, copies and a few false positives, are shuffled and grouped. Where a filter
for all rows would be too large to broadcast, the hashes are split into segments, each with its own filter and passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

#: Bits of a filter for each row, and of the filter of a segment (16 MB): its broadcast is bounded by that.
BITS_A_ROW, SEGMENT_BITS = 16, 1 << 27
#: Bits of a bitmap, as Spark's bitmap functions form them.
BLOCK_BITS = 32768
#: Parts into which the rows of one hash are dealt when the group's head is joined back.
SALTS = 32


def normalised(text: Column) -> Column:
    """Runs of space, tab, LF, VT, FF and CR as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def repeated_slots(hashed: DataFrame, bits: int) -> DataFrame:
    """(block, bits): the filter of ``bits`` slots as bitmaps, with a bit for each slot that was met at least twice."""
    slots = hashed.select(F.explode(F.array(*(F.pmod(F.col(h), F.lit(bits)) for h in ("h1", "h2")))).alias("slot"))
    again = slots.groupBy("slot").agg(F.count("*").alias("n")).where("n > 1").select((F.col("slot") + 1).alias("v"))
    return again.groupBy((F.bitmap_bucket_number("v") - 1).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))


def possibly_repeated(hashed: DataFrame, blocks: DataFrame, bits: int) -> DataFrame:
    """``hashed`` with a column _again: false only where a hash certainly occurs once. Nothing is exchanged."""
    again = F.lit(True)
    for i, h in enumerate(("h1", "h2")):
        slot = F.pmod(F.col(h), F.lit(bits))
        have = F.broadcast(blocks.select(F.col("block").alias(f"_k{i}"), F.col("bits").alias(f"_b{i}")))
        hashed = hashed.join(have, F.floor(slot / BLOCK_BITS) == F.col(f"_k{i}"), "left")
        place = slot % BLOCK_BITS
        octet = F.conv(F.hex(F.substring(f"_b{i}", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
        again = again & F.coalesce(F.getbit(octet, (place % 8).cast("int")) == 1, F.lit(False))
    return hashed.withColumn("_again", again).drop("_k0", "_b0", "_k1", "_b1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal if equal after normalisation of white space; of equal texts the row with the smallest id stays.
    Null text counts as empty. Rows that repeat an id and text share keep_id and are all marked kept; a null id stays
    only in a group that has no other. An empty table gives no rows; other columns of ``docs`` are not carried.
    """
    need = max(1 << 15, docs.count() * BITS_A_ROW)
    bits = min(segment_bits, 1 << (need - 1).bit_length())
    segments = -(-need // bits)
    digest = docs.select(F.col(id_col).alias("_id"), F.sha2(normalised(F.col(text_col)), 256).alias("_sha"))
    hashed = digest.select("_id", "_sha", F.xxhash64("_sha").alias("h1"), F.xxhash64("_sha", F.lit(1)).alias("h2"))
    hashed = stored(hashed.withColumn("segment", F.pmod(F.xxhash64("_sha", F.lit(2)), F.lit(segments)).cast("int")), "hashes", "segment")
    flagged = []
    for k in range(segments):
        part = hashed.where(F.col("segment") == k)
        blocks = cut(repeated_slots(part, bits).coalesce(max(1, bits >> 22)))
        flagged.append(cut(possibly_repeated(part, blocks, bits).select("_id", "_sha", "_again")))
    flagged = reduce(DataFrame.union, flagged)
    once = flagged.where(~F.col("_again")).select("_id", "_sha", F.col("_id").alias("_keep"), F.lit(1).cast("bigint").alias("_n"))
    maybe = flagged.where("_again").select("_id", "_sha", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int").alias("_salt"))
    heads = maybe.groupBy("_sha").agg(F.min("_id").alias("_keep"), F.count("*").alias("_n"))
    heads = heads.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = maybe.join(heads, ["_sha", "_salt"]).select("_id", "_sha", "_keep", "_n")
    return once.unionByName(again).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.col("_sha").alias("text_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
