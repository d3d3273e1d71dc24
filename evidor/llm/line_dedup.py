"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

Equal lines are one line at once. Every character shingle of a line is hashed; the smallest hash in each of 12 ranges of
hash values is its signature (one permutation), and two neighbouring ranges are a band. Lines that share a band are
compared on their whole shingle sets, linked lines are united by distributed union-find, and the first line of each
component stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, maybe_in, stored
from .components import components
from .settle import at_every_salt, crossing_pairs, dealt, parities, picked_pairs, shared_groups, star_pairs, still_open

#: Characters of a shingle, bands of two ranges (a line at the threshold shares one with probability
#: 1 - (1 - 0.8^2)^6 = 0.998), and the similarity from which lines are the same.
SHINGLE, BANDS, THRESHOLD = 9, 6, 0.8
#: Ranges in which two lines must agree to be compared: at the threshold fewer of 12 agree with probability 0.0006.
AGREE = 5
#: Rounds in which what is left open is compared with some of its group before all pairs are formed.
ROUNDS = 2


def tidy(line: Column) -> Column:
    """What is compared: lower case without white space at the ends."""
    return F.trim(F.lower(line))


def coded(line: Column) -> Column:
    """Four bytes for each character, so that a shingle is found without counting characters from the start."""
    return F.encode(line, "UTF-32")


def places(code: Column) -> Column:
    """The numbers of the characters at which a shingle of a coded line starts; 0 for a shorter line, which is one shingle."""
    return F.sequence(F.lit(0), F.greatest(F.shiftright(F.length(code), 2) - SHINGLE, F.lit(0)))


def shingle(code: Column, place: Column) -> Column:
    return F.xxhash64(F.substring(code, place * 4 + 1, F.lit(4 * SHINGLE)))


def shingles(line: Column) -> Column:
    """Distinct hashes of the shingles at each character of a line."""
    # as the variable of a lambda, the code is formed once and not copied for each shingle
    hashed = F.transform(F.array(coded(line)), lambda code: F.transform(places(code), lambda i: shingle(code, i)))
    return F.array_distinct(F.get(hashed, F.lit(0)))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line): the lines of every text, by line feeds, from 0; null text has none."""
    # the outer form, as Spark would split once more to leave empty arrays out
    return docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")).where("line IS NOT NULL")


def signatures(once: DataFrame) -> DataFrame:
    """(id, c, sig): of every distinct line of (id, t) its number of places and the smallest hash in each range, null where none is.

    Lines are taken apart into shingles and grouped again as rows of numbers, which Spark compiles into one loop.
    """
    ranges = 2 * BANDS
    code = once.select("id", coded(F.col("t")).alias("code"))
    each = code.select("id", "code", F.explode_outer(places(F.col("code"))).alias("i")).select("id", "i", shingle(F.col("code"), F.col("i")).alias("h"))
    # the upper half of a hash tells its range, the lower half its place there
    each = each.select("id", "i", F.shiftrightunsigned(F.shiftrightunsigned("h", 32) * ranges, 32).alias("r"), F.shiftright(F.shiftleft("h", 32), 32).cast("int").alias("v"))
    least = each.groupBy("id").agg(F.count_if(F.col("i") == 0).alias("c"), *(F.min(F.when(F.col("r") == k, F.col("v"))).alias(f"m{k}") for k in range(ranges)))
    return least.select("id", "c", F.array(*(f"m{k}" for k in range(ranges))).alias("sig"))


def band_keys(sig: Column) -> Column:
    """A key for each band that holds a shingle."""
    return F.array_compact(keys_by_band(sig))


def keys_by_band(sig: Column) -> Column:
    def key(k: int) -> Column:
        one, two = F.get(sig, F.lit(2 * k)), F.get(sig, F.lit(2 * k + 1))
        return F.when(F.coalesce(one, two).isNotNull(), F.xxhash64(F.lit(k), one, two))

    return F.array(*(key(k) for k in range(BANDS)))


def related(shared: DataFrame, sigs: DataFrame) -> DataFrame:
    """The rows (key, id) of ``shared`` that agree with another one of their group in a range besides the band. Written once.

    Of the ranges besides the band a pair has to agree in AGREE - 2, and so in one at least of all but AGREE - 3 of them: no
    pair that is compared is lost, and most rows that met by chance are.
    """
    ranges = 2 * BANDS
    banded = shared.join(sigs, "id").withColumn("band", F.array_position(keys_by_band(F.col("sig")), F.col("key")).cast("int") - 1)
    others = F.slice(F.filter(F.sequence(F.lit(0), F.lit(ranges - 1)), lambda j: F.shiftright(j, 1) != F.col("band")), 1, ranges - 2 - (AGREE - 3))
    each = banded.select("key", "id", "sig", F.explode(others).alias("j")).select("key", "id", F.xxhash64("key", "j", F.get("sig", F.col("j"))).alias("more"))
    met = cut(each.groupBy("more").agg(F.count("*").alias("n")).where("n > 1").select("more"))
    several = maybe_in(each, "more", met).where("_maybe").join(met, "more").select("key", "id").distinct()
    return stored(shared.join(several, ["key", "id"]), "related")


def promising(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures (id, sig) agree in AGREE ranges at least."""
    one, two = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x")), sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"))
    same = sum((F.get("x", F.lit(k)).eqNullSafe(F.get("y", F.lit(k))).cast("int") for k in range(2 * BANDS)), F.lit(0))
    return pairs.join(one, "a").join(two, "b").where(same >= AGREE).select("a", "b")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, t): the lines in the one column of ``wanted``; written once. Their shingles take many times their room."""
    found = lines(docs).select(tidy(F.col("line")).alias("t")).where("t <> ''").select(F.xxhash64("t").alias("id"), "t")
    return stored(maybe_in(found, "id", wanted).where("_maybe").groupBy("id").agg(F.min("t").alias("t")), "lines")


def similar(texts: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): the pairs whose whole shingle sets have a Jaccard similarity of ``threshold`` or more."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("y")), "b")
    # in an array, so that the sets are formed once a pair
    sets = both.select("a", "b", F.explode(F.array(F.struct(shingles(F.col("x")).alias("x"), shingles(F.col("y")).alias("y")))).alias("s"))
    # |x & y| / |x | y| >= t, written so that the intersection is formed once
    x, y = F.col("s.x"), F.col("s.y")
    return sets.where(F.size(F.array_intersect(x, y)) >= threshold / (1 + threshold) * (F.size(x) + F.size(y)) - 1e-9).select("a", "b")


def line_classes(docs: DataFrame, once: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, root): for the hash of every line (id, sig) that has a near duplicate, the smallest hash of its component.

    All pairs of lines that share a band are settled: compared, or found in one component through others. Signatures are
    compared first, so that the texts of most lines that met by chance are not read.
    """
    shared = shared_groups(once.select("id", F.explode_outer(band_keys(F.col("sig"))).alias("key")))
    sigs = stored(maybe_in(once, "id", cut(shared.select("id").distinct())).where("_maybe").select("id", "sig"), "signatures")
    stars = cut(promising(star_pairs(shared), sigs))
    large = related(shared.where("m > 3"), sigs)
    discard(shared)
    wanted = stars.select(F.explode(F.array("a", "b")).alias("id")).union(large.select("id"))
    texts = texts_of(docs, cut(wanted.distinct()))
    links = cut(similar(texts, stars, threshold))
    roots = components(links)

    def linked(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = cut(promising(pairs, sigs))
        few = maybe_in(texts, "id", cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())).where("_maybe").select("id", "t")
        found = cut(similar(few, pairs, threshold))
        if found.isEmpty():
            return links, roots
        return (more := links.union(found)), components(more)

    rows = still_open(large, roots)
    for k in range(ROUNDS):
        pairs = cut(picked_pairs(rows, k))
        if pairs.isEmpty():
            break
        links, roots = linked(pairs)
        rows = still_open(large, roots)
    discard(large)
    if not rows.isEmpty():
        few = maybe_in(texts, "id", cut(rows.select("id").distinct())).where("_maybe")
        sketches = parities(few.select("id", F.explode(shingles(F.col("t"))).alias("x")))
        links, roots = linked(crossing_pairs(rows, sketches, threshold))
    discard(texts, sigs)
    return roots


def mark(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, line_no, line_class, kept) of every line of every document.

    Of the lines of a class the first stays, by doc_id (null before others) and then line number. Blank lines have no
    class and stay. Rows that repeat an id share their kept places: the same line at the same place stays in each.
    Null text has no lines, an empty table gives none. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = lines(docs).select("doc_id", "line_no", F.nullif(tidy(F.col("line")), F.lit("")).alias("t"))
    named = found.select("doc_id", "line_no", F.when(F.col("t").isNotNull(), F.xxhash64("t")).alias("id"), "t")
    once = stored(signatures(named.where("id IS NOT NULL")))
    twice = cut(once.where("c > 1").select("id"))
    roots = line_classes(docs, once, threshold)
    discard(once)
    every = stored(named.drop("t"))
    # lines that occur once and have no near duplicate stay; the others are gathered by class
    every = maybe_in(every, "id", twice.union(roots.select("id")))
    alone = every.where("NOT _maybe").select("doc_id", "line_no", F.col("id").alias("line_class"), F.lit(True).alias("kept"))
    salted = every.where("_maybe").withColumn("salt", dealt("doc_id", "line_no"))
    everywhere = at_every_salt(roots)
    classed = stored(salted.join(everywhere, ["id", "salt"], "left").select("doc_id", "line_no", F.coalesce("root", "id").alias("line_class")))
    first = classed.groupBy("line_class").agg(F.min(F.struct("doc_id", "line_no")).alias("f"))
    first = first.select(F.col("f.doc_id").alias("_d"), F.col("f.line_no").alias("_n"), F.col("line_class").alias("_c"))
    at = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("line_no") == F.col("_n")) & (F.col("line_class") == F.col("_c"))
    return alone.unionByName(classed.join(first, at, "left").select("doc_id", "line_no", "line_class", F.col("_c").isNotNull().alias("kept")))


def without_duplicates(docs: DataFrame, threshold: float = THRESHOLD, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with its columns, each text without the lines that are not kept; n_chars, where there is one, follows it.

    Without ``keep_emptied`` documents of which nothing but white space is left are dropped: all they said stands elsewhere.
    """
    gone = mark(docs, threshold).where("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    joined = docs.join(gone.withColumnRenamed("doc_id", "_id"), docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    if not keep_emptied:
        out = out.where(F.col("_gone").isNull() | F.col("text").rlike(r"\S"))
    return out.select(*docs.columns)
