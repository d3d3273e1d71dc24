"""Join of near-duplicate documents by the Jaccard similarity of word n-grams: a MinHash LSH forest.

A document's signature is cut into trees; a tree's part of it is a path in a prefix trie. The search starts with
documents whose whole paths are equal in some tree and shortens the prefixes by one value at a time: what meets in a
trie node is verified on the whole n-gram sets and united. From the similarities of the links found follows which
share of such links the depth reached finds; the descent ends when that share is the target. Within the classes that
result all links are then counted exactly, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import cut, discard, fair_batches, maybe_in, stored
from .components import components
from .settle import at_every_salt, dealt, shared_groups, small_pairs, star_pairs, still_open

SHINGLE, THRESHOLD = 5, 0.8
#: Trees and values of a path; the share of links that the depth reached is to find, by the similarities of those found,
#: and the share of links right at the threshold.
TREES, DEPTH, TARGET, TARGET_LEAST = 12, 6, 0.9995, 0.99
#: Documents of a block, and n-grams that a block may hold: larger documents come in smaller blocks.
BLOCK, BLOCK_GRAMS = 2048, 1 << 22
#: Documents of a node up to which its open pairs are formed; more are compared block by block.
SMALL = 8

_rng = np.random.default_rng(11)
_ODD = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * W.U(2) + W.U(1)
_XOR = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def found_share(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair meets in some tree at a depth."""
    return 1 - (1 - similarity**depth) ** trees


def deep_enough(links: DataFrame, depth: int, threshold: float) -> bool:
    """Whether the links (a, b, s) found down to ``depth`` are the target share of all, each standing for 1 / its probability."""
    if found_share(threshold, depth) < TARGET_LEAST:
        return False
    share = 1 - F.pow(1 - F.pow(F.greatest("s", F.lit(threshold)), F.lit(depth)), F.lit(TREES))
    found, every = links.agg(F.count("*"), F.sum(1 / share)).first()
    return not found or found >= TARGET * every


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, row bounds in them, second hashes) by chunk: each row's distinct n-gram hashes in ascending order.

    Words are lower-case runs of letters and digits; a text of fewer than ``size`` words is one n-gram of all of them.
    """
    for lo, hi, data, offsets in W.chunks(column):
        low = W.LOWER[data]
        start, end, first = W.words(low, offsets, W.NOT_ALNUM)
        words, others = (W.Prefix(W.Prefix(low, k).spans(start, end), k) for k in (0, 1))
        n = np.diff(first)
        grams = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(hi - lo), grams)
        at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + first[:-1][row]
        hashes, second = (p.spans(at, at + np.minimum(n[row], size)) for p in (words, others))
        order = np.lexsort((hashes, row))
        hashes, second, row = hashes[order], second[order], row[order]
        fresh = np.r_[True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])][:len(row)]
        hashes, second, row = hashes[fresh], second[fresh], row[fresh]
        yield lo, hi, hashes, np.searchsorted(row, np.arange(hi - lo + 1)), second


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n, set1, set2, sig): n-gram count, two independent keys of the n-gram set, and the signature; n is 0 without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, bounds, second in shingle_sets(batch.column(1), size):
                n = np.diff(bounds)
                filled = np.flatnonzero(n)
                sig = np.zeros((hi - lo, TREES * DEPTH), np.uint32)
                keys = np.zeros((2, hi - lo), np.uint64)
                if len(filled):
                    at = bounds[:-1][filled]
                    for j in range(TREES * DEPTH):
                        sig[filled, j] = (np.minimum.reduceat((hashes ^ _XOR[j]) * _ODD[j], at) >> W.U(32)).astype(np.uint32)
                    keys[0, filled] = np.add.reduceat(W.mix(hashes), at)
                    keys[1, filled] = np.add.reduceat(W.mix(second), at)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n, pa.int64()), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "n", "set1", "set2", "sig"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, set1 long, set2 long, sig binary")


def nodes(heads: DataFrame, depth: int) -> DataFrame:
    """(key, id): for each tree, the trie node at ``depth``."""
    keys = [F.xxhash64(F.lit(t), F.substring("sig", 4 * t * DEPTH + 1, 4 * depth)) for t in range(TREES)]
    return heads.select("id", F.explode(F.array(*keys)).alias("key"))


def gram_sets(docs: DataFrame, ids: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(id, grams): the n-gram hashes, as ascending binary, of the documents (id, set1). Written once."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, bounds, _ in shingle_sets(batch.column(1), size):
                filled = np.flatnonzero(np.diff(bounds))
                key = np.zeros(hi - lo, np.uint64)
                if len(filled):
                    key[filled] = np.add.reduceat(W.mix(hashes), bounds[:-1][filled])
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(key.view(np.int64)), pa.array([hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["id", "set1", "grams"])

    texts = maybe_in(docs.select(F.col("doc_id").cast("bigint").alias("id"), "text"), "id", ids.select("id")).where("_maybe").select("id", "text")
    # rows that repeat an id are told apart by their sets; equal rows are one
    return stored(texts.mapInArrow(sets, "id long, set1 long, grams binary").join(ids, ["id", "set1"]).select("id", "grams").dropDuplicates(["id"]), "grams")


def verified(pairs: DataFrame, grams: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, s): the pairs whose whole n-gram sets have a Jaccard similarity s of ``threshold`` or more."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)) - 1e-9:
                    continue
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                found[i] = shared / (len(both) - shared)
            keep = pa.array(found >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["a", "b", "s"]).filter(keep)

    rows = pairs.join(grams.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(grams.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, s double")


def in_blocks(groups: DataFrame, grams: DataFrame) -> DataFrame:
    """(grp, i, j, side, grams, and the columns of ``groups``): each (grp, id, ..) once for each two blocks of its group it is in.

    A group's ids are dealt to blocks by hash, so that a block has about BLOCK ids and BLOCK_GRAMS n-grams.
    """
    sized = groups.join(grams.select("id", F.shiftright(F.length("grams"), 3).alias("n")), "id")
    room = F.least(F.lit(BLOCK), F.greatest(F.lit(1), (F.lit(BLOCK_GRAMS) / F.max("n")).cast("int")))
    blocks = sized.groupBy("grp").agg(F.ceil(F.count("*") / room).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    placed = groups.join(blocks, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), *groups.columns)
    dealt_rows = pairs.join(grams, "id").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "side", "id")
    return dealt_rows.select("grp", "i", "j", "side", "grams", *(c for c in groups.columns if c != "grp"))


def similarities(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of each set of ``left`` and each of ``right``; tokens that one set alone holds are only counted."""
    n = np.array([len(s) for s in sets])
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    often = count[token] > 1
    token, row = np.unique(token[often], return_inverse=True)[1], row[often]
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    shared, step = np.zeros((len(left), len(right)), np.float32), 2048
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, step):
        a, b = np.searchsorted(token, (lo, lo + step))
        sides = []
        for at, width in zip(place, (len(left), len(right))):
            mine = at[row[a:b]] >= 0
            matrix = np.zeros((width, step), np.float32)
            matrix[at[row[a:b][mine]], token[a:b][mine] - lo] = 1
            sides.append(matrix)
        shared += sides[0] @ sides[1].T
    return shared / np.maximum(n[left][:, None] + n[right] - shared, 1)


def by_block(rows: DataFrame, schema: str, compare) -> DataFrame:
    """``compare(columns, sets, left, right)`` for each two blocks of ``in_blocks``, one at a time; within a block left is right."""
    names = rows.columns[5:]
    fields = schema.split(", ")
    kinds = [pa.float64() if f.endswith("double") else pa.int64() for f in fields]

    def settle(held: list[list], same: bool) -> tuple:
        side, sets = np.array(held[0]), held[1]
        left = np.flatnonzero(side == 0)
        right = left if same else np.flatnonzero(side == 1)
        return compare({name: values for name, values in zip(names, held[2:])}, sets, left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in (0, 1, 2, 3, *range(5, batch.num_columns))]
            for at, packed in zip(zip(*columns), batch.column(4)):
                if at[:3] != key:
                    if key is not None:
                        out.append(settle(held, key[1] == key[2]))
                    key, held = at[:3], [[] for _ in range(len(at) - 1)]
                for column, value in zip(held, (at[3], np.frombuffer(packed.as_buffer(), np.uint64).copy(), *at[4:])):
                    column.append(value)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), kind) for c, kind in zip(zip(*out), kinds)], names=[f.split()[0] for f in fields])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(settle(held, key[1] == key[2]), kinds)], names=[f.split()[0] for f in fields])

    return rows.mapInArrow(run, schema)


def spanning(near: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Cells (row, column) of a matrix between the numbers ``left`` and ``right`` that keep connected what all its cells connect."""
    seen, out = np.zeros(n, bool), []
    at = {}
    for k, (numbers, matrix) in enumerate(((left, near), (right, near.T))):
        for row, number in enumerate(numbers.tolist()):
            at.setdefault(number, []).append((matrix[row], right if k == 0 else left, k, row))
    for start in at:
        if seen[start]:
            continue
        seen[start], stack = True, [start]
        while stack:
            for cells, others, k, row in at[stack.pop()]:
                new = np.flatnonzero(cells & ~seen[others])
                seen[others[new]] = True
                stack += others[new].tolist()
                out += [(row, c) if k == 0 else (c, row) for c in new.tolist()]
    return out


def crowded_links(rows: DataFrame, grams: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, s): links that unite the roots of large nodes (key, id, root), compared block by block; pairs are not written.

    A pair that shares several of the nodes is compared in that of them with the smallest key.
    """
    held = rows.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    groups = rows.select(F.col("key").alias("grp"), "id", "root").join(held, "id").withColumn("mine", F.col("grp"))

    def compare(columns: dict, sets: list, left: np.ndarray, right: np.ndarray) -> tuple:
        ids, root, mine = np.array(columns["id"]), np.array(columns["root"]), columns["mine"][0]
        s = similarities(sets, left, right)
        near = (s >= threshold - 1e-6) & (root[left][:, None] != root[right])
        if near.any():
            keys = [set(k) for k in columns["keys"]]
            for x, y in np.argwhere(near).tolist():
                near[x, y] = min(keys[left[x]] & keys[right[y]]) == mine
        found = spanning(near, left, right, len(ids))
        x, y = (np.array([f[k] for f in found], int) for k in (0, 1))
        a, b = ids[left[x]], ids[right[y]]
        return np.minimum(a, b), np.maximum(a, b), s[x, y].astype(float)

    return by_block(in_blocks(groups, grams), "a long, b long, s double", compare)


def descend(docs: DataFrame, heads: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """(id, root) of the heads (id, set1, sig) that have a link, the links (a, b, s) that were followed, and the n-gram sets read; or None.

    Pairs that share a node are settled depth by depth: verified once, or found in one class through others. Those of
    large nodes that are open then are compared block by block at the last depth, whose nodes hold all deeper ones.
    """
    roots = links = tried = grams = shared = None

    def follow(pairs: DataFrame) -> None:
        nonlocal roots, links, tried
        fresh = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        found = cut(verified(fresh, grams, threshold))
        tried = fresh if tried is None else cut(tried.union(fresh))
        links = found if links is None else cut(links.union(found))
        if roots is None or not found.isEmpty():
            roots = components(links)

    for depth in range(DEPTH, 0, -1):
        if shared is not None:
            discard(shared)
        shared = shared_groups(nodes(heads, depth))
        rows = still_open(shared, roots)
        if not rows.isEmpty():
            ids = rows.select("id").distinct()
            need = cut(maybe_in(heads, "id", ids if grams is None else cut(ids.join(grams, "id", "left_anti"))).where("_maybe").select("id", "set1"))
            more = gram_sets(docs, need if grams is None else need.join(grams, "id", "left_anti"), size)
            grams = more if grams is None else grams.union(more)
            follow(star_pairs(rows).union(small_pairs(rows, SMALL)).distinct())
        if deep_enough(links, depth, threshold) if links is not None else found_share(threshold, depth) >= TARGET:
            break
    if roots is not None:
        crowd = still_open(shared, roots, SMALL + 1)
        if not crowd.isEmpty():
            more = cut(crowded_links(crowd.select("key", "id", "root"), grams, threshold))
            if not more.isEmpty():
                links = cut(links.union(more))
                roots = components(links)
    return roots, links, grams


def link_counts(classes: DataFrame, grams: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links): for each id of (id, root) the others of its class with a similarity of ``threshold`` or more.

    A class is cut into blocks, and each two blocks are compared by themselves; pairs are counted and not written.
    """
    def compare(columns: dict, sets: list, left: np.ndarray, right: np.ndarray) -> tuple:
        ids = np.array(columns["id"])
        near = similarities(sets, left, right) >= threshold - 1e-6
        if left is right:
            np.fill_diagonal(near, False)
            return ids[left], near.sum(1)
        return np.r_[ids[left], ids[right]], np.r_[near.sum(1), near.sum(0)]

    counted = by_block(in_blocks(classes.select(F.col("root").alias("grp"), "id"), grams), "id long, n_links long", compare)
    return counted.groupBy("id").agg(F.sum("n_links").alias("n_links"))


def membership(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, head_id, n, set1, sig): documents with equal n-gram sets share a head, the smallest doc_id among them. Written once.

    Only sets that occur more than once, and few others, are shuffled; a group's rows are dealt to salts.
    """
    known = stored(sketches(docs, size), "sketches")
    named = known.where("n > 0 AND doc_id IS NOT NULL")
    repeated = cut(named.groupBy("set1", "set2").agg(F.min("doc_id").alias("head_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    flagged = maybe_in(known, "set1", repeated.select("set1"))
    alone = flagged.where("NOT _maybe").withColumn("head_id", F.col("doc_id"))
    some = flagged.where("_maybe").withColumn("salt", dealt("doc_id", "set1")).join(at_every_salt(repeated), ["set1", "set2", "salt"], "left")
    some = some.withColumn("head_id", F.when(F.col("n") > 0, F.coalesce("head_id", "doc_id")).otherwise(F.col("doc_id")))
    out = stored(alone.select("doc_id", "head_id", "n", "set1", "sig").union(some.select("doc_id", "head_id", "n", "set1", "sig")), "members")
    discard(known)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, head_id (equal n-gram sets), class_id (linked heads, smallest id), n_links of its head.

    n_links counts the other heads of its class with a similarity of ``threshold`` or more, all of them. A document
    without words is its own head and has no links, nor has one with a null id. Rows that repeat an id are one
    document: that with the smallest set key is searched, and all share what it finds. An empty table gives no rows.
    """
    fair_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    members = membership(docs, size)
    heads = members.where("n > 0 AND doc_id = head_id").select(F.col("doc_id").alias("id"), "set1", "sig")
    twice = cut(heads.groupBy("id").agg(F.count("*").alias("c"), F.min("set1").alias("least")).where("c > 1").drop("c"))
    if not twice.isEmpty():
        heads = heads.join(twice, "id", "left").where("least IS NULL OR set1 = least").drop("least").dropDuplicates(["id"])
    heads = stored(heads, "heads")
    roots, links, grams = descend(docs, heads, threshold, size)
    discard(heads)
    if roots is None:
        return members.select("doc_id", "head_id", F.col("head_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    info = cut(roots.join(link_counts(roots, grams, threshold), "id", "left").withColumnRenamed("id", "head_id"))
    flagged = maybe_in(members.select("doc_id", "head_id"), "head_id", info.select("head_id"))
    some = flagged.where("_maybe").withColumn("salt", dealt("doc_id")).join(at_every_salt(info), ["head_id", "salt"], "left")
    some = some.select("doc_id", "head_id", F.coalesce("root", "head_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    alone = flagged.where("NOT _maybe").select("doc_id", "head_id", F.col("head_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return alone.union(some)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, md5_number(array_to_string(list_slice(w, s, s + 4), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
sets AS (SELECT doc_id, md5(string_agg(CAST(g AS VARCHAR), ' ' ORDER BY g)) AS k, count(*) AS n FROM grams GROUP BY doc_id),
heads AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS head_id FROM sets),
h AS (SELECT doc_id, n, g FROM heads JOIN grams USING (doc_id) WHERE doc_id = head_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n) + any_value(y.n) AS n FROM h x JOIN h y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) WHERE shared >= 0.8 * (n - shared)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM sym UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.other),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n_links FROM sym GROUP BY a)
SELECT d.doc_id, coalesce(head_id, d.doc_id) AS head_id, coalesce(root, head_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN heads USING (doc_id) LEFT JOIN roots ON roots.id = head_id LEFT JOIN degree ON degree.id = head_id
"""
