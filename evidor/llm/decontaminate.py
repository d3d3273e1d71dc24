"""Benchmark decontamination by a distributed positional inverted index, in DataFrame operations only.

The index stores the postings (term, document, position) of the documents for the terms of the benchmark. Every window
of an item is looked up by its rarest terms: their lists, each shifted by the term's offset in the window, are
intersected, and what is left is compared with the words of the document. The same lists give proximity matches, where the two rarest terms stand
within a slack of their distance in the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, maybe_in, small, stored
from .settle import at_every_salt, dealt

#: Words of a window; lists intersected for each window.
WINDOW, RAREST = 10, 2
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, other letters as they are; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win, item_id, w): every run of ``size`` words of an item, or all its words if it has fewer; win numbers them."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda i: F.slice("w", i + 1, size))).alias("w")).distinct()
    return w.select(F.xxhash64("item_id", "w").alias("win"), "item_id", "w")


def positional_index(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, pos, t): the postings of the documents for the terms of the windows, terms as hashes. Written once.

    A filter of bounded size picks the terms, so nothing is exchanged and a frequent term is no task's burden; the few
    other terms that pass it do no harm. The outer form, as Spark would find the words again to leave out empty texts.
    """
    terms = cut(wins.select(F.explode("w").alias("term")).select(F.xxhash64("term").alias("t")).distinct())
    places = docs.select("doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "term")).where("term IS NOT NULL")
    return stored(maybe_in(places.select("doc_id", "pos", F.xxhash64("term").alias("t")), "t", terms).where("_maybe").drop("_maybe"), "postings")


def lists(index: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, win, start, rank): the postings of the terms (t, win, offset, rank) looked up, shifted by their offsets.

    Where the terms are too many to be broadcast, the postings of one are dealt to salts.
    """
    if found.count() * 64 <= BROADCAST_BYTES:
        met = index.join(F.broadcast(found), "t")
    else:
        met = index.withColumn("salt", dealt("doc_id")).join(at_every_salt(found), ["t", "salt"])
    return met.select("doc_id", "win", (F.col("pos") - F.col("offset")).alias("start"), "rank")


def lookups(index: DataFrame, wins: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(t, win, offset, rank): for each window its ``rarest`` places with the fewest postings. A window with a term that has none is left out."""
    places = wins.select("win", F.posexplode("w").alias("offset", "term")).select("win", "offset", F.xxhash64("term").alias("t"))
    counts = index.groupBy("t").agg(F.count("*").alias("n"))
    ranked = places.join(counts, "t", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by = Window.partitionBy("win")
    ranked = ranked.withColumn("least", F.min("n").over(by)).withColumn("rank", F.row_number().over(by.orderBy("n", "offset")))
    return ranked.where((F.col("least") > 0) & (F.col("rank") <= rarest)).select("t", "win", "offset", "rank")


def candidates(index: DataFrame, found: DataFrame, wins: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(doc_id, win, start): places where all shifted lists of a window meet."""
    met = lists(index, found).where("start >= 0").groupBy("doc_id", "win", "start").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("seen"))
    need = wins.select("win", F.least(F.size("w"), F.lit(rarest)).alias("need"))
    return met.join(small(need, 32), "win").where(F.bit_count("seen") == F.col("need")).select("doc_id", "win", "start")


def near(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = 3) -> DataFrame:
    """(doc_id, item_id, off_by): proximity matches, where a window's two rarest terms are off by 0 to ``slack`` words."""
    wins = cut(windows(items, size))
    index = positional_index(docs, wins)
    shifted = lists(index, cut(lookups(index, wins, 2)))
    cell = F.floor(F.col("start") / (slack + 1))
    one = shifted.where("rank = 1").select("doc_id", "win", F.col("start").alias("a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    two = shifted.where("rank = 2").select(F.col("doc_id").alias("_id"), "win", F.col("start").alias("b"), cell.alias("cell"))
    close = one.join(two, (F.col("doc_id").eqNullSafe(F.col("_id"))) & (one["win"] == two["win"]) & (one["cell"] == two["cell"])).where(F.abs(F.col("a") - F.col("b")) <= slack)
    close = close.select("doc_id", one["win"], F.abs(F.col("a") - F.col("b")).alias("off"))
    return close.join(small(wins.select("win", "item_id"), 64), "win").groupBy("doc_id", "item_id").agg(F.min("off").alias("off_by"))


def matches(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items): for each document its (start, length) of exact matches and their items.

    Items or texts that are null or without words match nothing. A row that repeats an id and its text is the same
    document; rows that repeat an id with another text are judged each by its own words, and so are rows with a null id.
    """
    docs = docs.select("doc_id", "text")
    wins = cut(windows(items, size))
    index = positional_index(docs, wins)
    found = cut(lookups(index, wins))
    places = cut(candidates(index, found, wins).groupBy("doc_id").agg(F.collect_list(F.struct("start", "win")).alias("places")))
    docs = maybe_in(docs, "doc_id", places.select("doc_id"))
    key, n_words = F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("bigint").alias("n_words")
    none = docs.where("NOT _maybe").select("doc_id", key, n_words).distinct()
    empty = [F.array().cast(f"array<{kind}>").alias(name) for name, kind in (("spans", "struct<start:int,length:int>"), ("items", "string"))]
    places = places.withColumnRenamed("doc_id", "_id")
    with_places = docs.where("_maybe").join(places, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_w", words(F.col("text")))
    read = F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["win"].alias("win"), F.slice("_w", p["start"] + 1, size).alias("seen")))
    rows = with_places.select("doc_id", key, F.size("_w").cast("bigint").alias("n_words"), F.explode_outer(read).alias("p"))
    rows = rows.select("doc_id", "text_key", "n_words", "p.*").join(small(wins, 256), "win", "left")
    same = F.slice("seen", 1, F.size("w")) == F.col("w")
    some = rows.groupBy("doc_id", "text_key", "n_words").agg(
        F.collect_set(F.when(same, F.struct("start", F.size("w").alias("length")))).alias("spans"),
        F.collect_set(F.when(same, F.col("item_id"))).alias("items"))
    return some.unionByName(none.select("*", *empty))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; see ``matches``."""
    hit = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))))
    found = matches(docs, items, size)
    return found.select(
        "doc_id", "n_words", hit.cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
         FROM places, (SELECT DISTINCT n FROM wins) WHERE i + n - 1 <= len(w)) JOIN wins USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
which AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN which USING (doc_id)
"""
