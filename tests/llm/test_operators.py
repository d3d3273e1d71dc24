"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("evidor.llm")
from evidor.llm import components as cc  # noqa: E402
from evidor.llm import anchors, decontaminate, exact_dedup, html_extract, line_dedup, ngram_join, packing, quality, substring_dedup, suffix_dedup, toxicity  # noqa: E402
from evidor.llm import wordhash as W  # noqa: E402
from evidor.llm.queries import tokenizer_path  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, extra=""):
    """Rows of documents from texts, or (id, text) pairs; with clashing extra columns where asked for."""
    rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    for name in extra.split():
        df = df.withColumn(name, F.lit(7))
    return df.repartition(3)


CLASH = "_id _sha h1 h2 slot word bits n keys key id a b node rest kept text_key spans items term pos grp ids _maybe _slot root salt"


def words(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=0, n=40):
    """Texts with copies, near copies, shared passages, repeats inside, nulls, empties and one long text."""
    rng = random.Random(seed)
    passage, base = words(rng, 70, 5000), words(rng, 120, 5000)
    out = [None, "", "   \n\t", "x", words(rng, 3000, 50), passage * 3, "a b " * 120, "ab" * 400]
    for i in range(n):
        own = words(rng, rng.randrange(1, 150), 3000)
        kind = i % 5
        if kind == 0:
            out.append(own)
        elif kind == 1:
            out.append(f"{own}\n{passage}\n{own[::-1]}")
        elif kind == 2:
            edited = base.split()
            edited[rng.randrange(len(edited))] = "changed"
            out.append(" ".join(edited))
        elif kind == 3:
            out.append(out[rng.randrange(len(out))])
        else:
            out.append(f"É{own}é\r\n{own}")
    return out


# Substring dedup

def brute_substring(texts):
    seen, out = {}, {}
    split = {i: (t or "").encode().split() for i, t in texts}
    for i in sorted(split):
        for s in range(len(split[i]) - 49):
            seen.setdefault(tuple(split[i][s:s + 50]), i)
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - 49):
            if seen[tuple(w[s:s + 50])] < i:
                gone |= set(range(s, s + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_dedup(spark, batches):
    texts = list(enumerate(corpus(1)))
    got = substring_dedup.digests(substring_dedup.substring_dedup(table(spark, texts, CLASH), batches=batches)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substring(texts)
    assert sum(r.n_removed for r in got) > 0


def test_substring_index_is_incremental(spark):
    texts = list(enumerate(corpus(2)))
    docs = table(spark, texts).select("doc_id", "text")
    index, parts = substring_dedup.FingerprintIndex(spark, fanout=2, buckets=3), []
    for lo in range(0, len(texts), 10):
        if lo == 30:
            index = substring_dedup.FingerprintIndex.open(spark, index.runs, index.folder, 3, fanout=2)
        found = index.add(docs.where(f"doc_id >= {lo} AND doc_id < {lo + 10}"), docs.where(f"doc_id < {lo + 10}"))
        parts.append(found.where(f"doc_id >= {lo}"))
        assert len(index.runs) <= 3
    ranges = parts[0]
    for p in parts[1:]:
        ranges = ranges.union(p)
    got = substring_dedup.digests(substring_dedup.remove(docs, ranges)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substring(texts)
    index.drop()
    assert not index.runs


def test_substring_runs_are_joined_in_place(spark):
    """Buckets of a run meet those of another without an exchange."""
    texts = list(enumerate(corpus(2)))
    docs = table(spark, texts).select("doc_id", "text")
    index = substring_dedup.FingerprintIndex(spark, buckets=3)
    for part in (docs.where("doc_id < 20"), docs.where("doc_id >= 20")):
        index.runs.append(index.write(anchors.classes_of(substring_dedup.fingerprints(part))))
    one, two = map(index.read, index.runs)
    plan = one.hint("merge").join(two.select("key"), "key", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    index.drop()


def test_repeated_ids_are_judged_by_their_own_text(spark):
    rng = random.Random(31)
    p, other = words(rng, 80, 10**6), words(rng, 80, 10**6)
    docs = table(spark, [(1, p), (2, p), (2, other), (3, other), (3, other)])
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == [(1, 0), (2, 0), (2, 80), (3, 80), (3, 80)]
    size = {p: len(p), other: len(other)}
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == sorted([(1, 0), (2, size[p]), (2, 0), (3, size[other]), (3, size[other])])
    alone = table(spark, [(5, other), (5, other)])
    assert [r.n_removed for r in suffix_dedup.suffix_dedup(alone).collect()] == [0, 0]


def test_hashes_of_parity_sequences_differ(spark):
    """Sequences on which any polynomial modulo a power of two has one value."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    for which in (0, 1):
        h = [W.Prefix(np.frombuffer(t.encode(), np.uint8), which).windows(1024)[0] for t in (one, two)]
        assert h[0] != h[1]
    w = words(random.Random(4), 60, 10**6)
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(table(spark, [(1, f"{w} {one} {w[::-1]}"), (2, f"{w[::-1]} {two} {w}")])).collect()}
    assert got[1] == 0 and got[2] == 120


def test_products_modulo_the_prime():
    rng = np.random.default_rng(3)
    x, y = (np.r_[rng.integers(0, W.PRIME, 200, np.uint64), np.array([0, 1, W.PRIME - 1], np.uint64)] for _ in range(2))
    assert W.times(x, y).tolist() == [int(a) * int(b) % W.PRIME for a, b in zip(x, y)]


def test_substring_null_id_and_empty(spark):
    t = words(random.Random(3), 80)
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(table(spark, [(None, t), (1, t), (2, t)])).collect()}
    assert got == {None: 0, 1: 0, 2: 80}
    assert substring_dedup.substring_dedup(table(spark, [(1, "x")]).limit(0)).count() == 0


# Suffix dedup

def brute_suffix(texts):
    seen, out = set(), {}
    for i, t in sorted(texts, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = b"\1" * 100
            seen.add(b[s:s + 100])
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark):
    texts = list(enumerate(corpus(4)))
    got = suffix_dedup.digests(suffix_dedup.suffix_dedup(table(spark, texts, CLASH))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_suffix(texts)
    assert suffix_dedup.suffix_dedup(table(spark, [(1, "x")]).limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_sorts(seed):
    rng = random.Random(seed)
    text = b"".join(rng.choice([b"abcabcabc" * 12, b"x" * 120, bytes(rng.choices(b"ab", k=130)), b"abcabcabc" * 11 + b"z" * 10]) for _ in range(30))
    starts = np.array(rng.sample(range(len(text) - 100), 300))
    groups = [[text[s:s + 100] for s in starts[g]] for g in suffix_dedup.deep_shallow(text, starts)]
    assert all(len(set(g)) == 1 for g in groups)
    heads = [g[0] for g in groups]
    assert heads == sorted(set(heads)) and sum(map(len, groups)) == 300


# Line dedup

def brute_lines(texts):
    def grams(t):
        return frozenset(t[k:k + 9] for k in range(max(1, len(t) - 8)))

    every = {(i, n): line.lower().strip(" ") for i, t in texts if t is not None for n, line in enumerate(t.split("\n"))}
    distinct = sorted({t for t in every.values() if t})
    sets = {t: grams(t) for t in distinct}
    root = {t: t for t in distinct}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]:
                root[find(a)] = find(b)
    first, out = {}, {}
    for place in sorted(every):
        t = every[place]
        out[place] = not t or first.setdefault(find(t), place) == place
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    base = [words(rng, 40, 900) for _ in range(12)]
    texts = list(corpus(5, 10))
    for _ in range(30):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            w = rng.choice(base).split()
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = "edited"
            lines.append(" ".join(w) if rng.random() < 0.9 else "")
        texts.append("\n".join(lines))
    texts = list(enumerate(texts))
    got = {(r.doc_id, r.line_no): r.kept for r in line_dedup.mark(table(spark, texts, CLASH)).collect()}
    assert got == brute_lines(texts)
    cleaned = {r.doc_id: r for r in line_dedup.without_duplicates(table(spark, texts)).collect()}
    for i, t in texts:
        want = None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if got[i, n])
        assert cleaned[i].text == want and cleaned[i].n_chars == len(want or "")


def full_line_links(lines):
    """Every pair of distinct lines whose sets of all character shingles have a Jaccard similarity of 0.8 or more."""
    size = line_dedup.SHINGLE
    sets = [{t[i:i + size] for i in range(max(1, len(t) - size + 1))} for t in lines]
    return {(i, j) for j in range(len(lines)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9}


def kept_lines(lines):
    """For lines in order, whether each is the first of its component of full_line_links."""
    root = list(range(len(lines)))
    for i, j in sorted(full_line_links(lines)):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return [root[i] == i for i in range(len(lines))]


def test_line_dedup_full_shingles(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(n))
    urls = [f"https://www.example.com/{word(40)}" for _ in range(12)]
    urls += [urls[0] + "x", urls[1][:-1]]
    same = han(9)
    texts = [same + han(40) for _ in range(6)] + ["/usr/local/share/" + word(50) for _ in range(6)] + urls
    long = " ".join(word(60) for _ in range(3))
    texts += [long, long[:2] + "~" + long[2:], word(700), "short", "shor", "a", "b"]
    texts.append(texts[-5][:350] + "~" + texts[-5][350:])
    got = {r.doc_id: r.kept for r in line_dedup.mark(table(spark, texts)).collect()}
    want = kept_lines(texts)
    assert want.count(False) == 4
    assert [got[i] for i in range(len(texts))] == want


def test_line_dedup_crowded_band(spark):
    """A band that holds every line: the components of all pairs are found, also of lines that no pivot resembles."""
    rng = random.Random(9)
    texts = []
    for _ in range(4):
        line = words(rng, 30, 900).split()
        for _ in range(30):
            line[rng.randrange(len(line))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(line))
    texts += [words(rng, 20, 900) for _ in range(40)]
    rng.shuffle(texts)
    docs = table(spark, texts)
    t = line_dedup.tidy(F.col("text"))
    once = docs.select(F.xxhash64(t).alias("id"), F.array(F.lit(1), *[F.lit(None).cast("int")] * 11).alias("sig"))
    ids = {r.id: r.doc_id for r in docs.select("doc_id", F.xxhash64(t).alias("id")).collect()}
    found = {}
    for r in line_dedup.line_classes(docs, once).collect():
        found.setdefault(r.root, set()).add(ids[r.id])
    root = list(range(len(texts)))
    for i, j in full_line_links(texts):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)
    assert len(want) > 40


def test_line_dedup_edges(spark):
    assert line_dedup.mark(table(spark, [(1, "x")]).limit(0)).count() == 0
    rows = line_dedup.mark(table(spark, [(1, "same line"), (1, "same line"), (2, "SAME line \n"), (3, None)])).collect()
    assert sorted((r.doc_id, r.line_no, r.kept) for r in rows) == [(1, 0, True), (1, 0, True), (2, 0, False), (2, 1, True)]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(25)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.id: r.root for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}


# Exact dedup

def test_exact_dedup(spark):
    texts = [(i, t) for i, t in enumerate(corpus(6))] + [(100, "a  b"), (101, "a\tb"), (102, "a b "), (103, "a b"), (None, "a b"), (104, "a b"), (104, "a b")]
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in texts:
        groups.setdefault(norm(t), []).append(i)
    want = sorted((repr(i), min(x for x in groups[norm(t)] if x is not None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in texts)
    for bits in (exact_dedup.SEGMENT_BITS, 1 << 14, 1 << 9):
        got = exact_dedup.exact_dedup(table(spark, texts, CLASH), segment_bits=bits).collect()
        assert sorted((repr(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(table(spark, [(1, "x")]).limit(0)).count() == 0


def test_exact_dedup_shuffles_only_possible_repeats(spark):
    """Of three million rows the filter lets the copies and a few others pass, and the test against it exchanges nothing."""
    n, copies = 3_000_000, 500
    hashed = spark.range(n, numPartitions=8).select(F.xxhash64("id").alias("h1"), F.xxhash64("id", F.lit(1)).alias("h2"))
    hashed = hashed.union(hashed.where(F.pmod("h1", F.lit(n // copies)) == 0))
    bits = 1 << 26
    flagged = exact_dedup.possibly_repeated(hashed, exact_dedup.cut(exact_dedup.repeated_slots(hashed, bits)), bits)
    again = flagged.where("_again").count()
    true = hashed.groupBy("h1", "h2").count().where("count > 1").agg(F.sum("count")).first()[0]
    assert true <= again <= true + 0.03 * n
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan and "hashpartitioning" not in plan


# Quality and toxicity

def labelled(spark, seed, n=240):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good, toxic = rng.random() < 0.7, rng.random() < 0.25
        w = words(rng, rng.randrange(20, 120), 400).split()
        if not good:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            for k in rng.sample(range(len(w)), 5):
                w[k] = rng.choice(["vile", "rotten", "scummy"])
        docs.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(good), int(toxic)))
    docs += [(n, None), (n + 1, ""), (n + 2, "z" * 200_000), (n, "a repeated id")]
    labels += [(n + 1, None, None), (5000, 1, 1)]
    truth = {i: (g, t) for i, g, t in labels}
    return table(spark, docs, "score label h units pos"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth, len(docs)


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_classifiers(spark, which):
    docs, labels, truth, n = labelled(spark, 8)
    if which == "quality":
        run = lambda d, l: quality.score_quality(d, quality.fit_quality(d, l))
        folds, fold, k = 5, 0, 0
    else:
        run = lambda d, l: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, l))
        folds, fold, k = 4, 2, 1
    rows = run(docs, labels).collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    held = [r for r in rows if r.held_out and truth.get(r.doc_id, (None, None))[k] is not None]
    assert len(held) > 10 and sum(r.predicted == truth[r.doc_id][k] for r in held) >= 0.9 * len(held)
    # labels of the held-out fold change nothing
    flipped = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string")) % folds == fold, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    key = lambda r: (r.doc_id, r.score)
    assert sorted(map(key, run(docs, flipped).collect())) == sorted(map(key, rows))
    assert run(docs.limit(0), labels).count() == 0
    assert run(docs, labels.limit(0)).count() == n


def test_factorisation_identity():
    m = quality.Machine(np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    rng = np.random.default_rng(1)
    m.w[:], m.v[:] = rng.normal(size=m.w.shape), rng.normal(size=m.v.shape)
    bucket, value, stats = np.array([3, 9, 70]), np.array([0.5, -1.0, 2.0]), rng.normal(size=(1, quality.N_STATS))
    x = np.zeros(len(m.w))
    x[bucket] = value
    x[quality.BUCKETS:] = m.scaled(stats)[0]
    i = np.flatnonzero(x)
    pairs = sum(m.v[a] @ m.v[b] * x[a] * x[b] for k, a in enumerate(i) for b in i[:k])
    assert np.isclose(m.raw(stats, np.zeros(3, int), bucket, value)[0][0], m.w0[0] + m.w @ x + pairs)


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_positive_unlabelled_risk(shift):
    """The risk against a plain loop, and its step against differences; with ``shift`` positives score so high that the bracket is negative."""
    rng = np.random.default_rng(2)
    xp, xu, prior = rng.normal(size=(7, 3)), rng.normal(size=(11, 3)), 0.4
    theta = np.array([0.3, -0.7, 0.2])
    if shift:
        xp, xu = xp + shift * np.sign(theta), xu - shift * np.sign(theta)
    loss = lambda s: 1 / (1 + np.exp(s))

    def parts(t):
        first = prior * sum(loss(x @ t) for x in xp) / 7
        return first, sum(loss(-(x @ t)) for x in xu) / 11 - prior * sum(loss(-(x @ t)) for x in xp) / 7

    risk, step = toxicity.risk_step(theta, xp, xu, prior)
    first, bracket = parts(theta)
    assert (bracket < 0) == bool(shift) and np.isclose(risk, first + max(0, bracket))
    for k in range(3):
        d = np.eye(3)[k] * 1e-6
        slope = [(a - b) / 2e-6 for a, b in zip(parts(theta + d), parts(theta - d))]
        assert np.isclose(step[k], -slope[1] if shift else sum(slope), atol=1e-6)


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_classifiers_score_rows_without_id(spark, which):
    docs, labels, _, n = labelled(spark, 8)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 40 != 7, F.col("doc_id")))
    run = (lambda: quality.score_quality(docs, quality.fit_quality(docs, labels))) if which == "quality" else (lambda: toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)))
    rows = run().collect()
    assert len(rows) == n and any(r.doc_id is None for r in rows) and all(0 <= r.score <= 1 and not (r.doc_id is None and r.held_out) for r in rows)


def test_packing_and_pages_without_id(spark):
    rows = packing.pack(table(spark, [(None, "some words"), (None, "other"), (1, "some words")]), tokenizer_path()).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "None", "None"]
    pages = spark.createDataFrame([(None, "u", "<article><p>" + PARAGRAPHS[0] + "</p></article>")], "page_id long, url string, html string")
    assert [tuple(r)[:2] for r in html_extract.extract(pages).collect()] == [(None, "u")]


def test_without_toxic_keeps_columns_and_clean_rows(spark):
    docs, labels, truth, n = labelled(spark, 9)
    detector = toxicity.fit_toxicity(docs, labels)
    kept = toxicity.without_toxic(docs, detector)
    assert kept.columns == docs.columns
    want = sorted((str(r.doc_id) for r in toxicity.score_toxicity(docs, detector).where("predicted = 0").collect()))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


# Packing

def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = [(i, t) for i, t in enumerate(corpus(7)) if i != 3] + [(50, "special <|endoftext|> inside"), (51, "  tab\t  x\n\n\ny  "), (52, "😀 ünï 12345")]
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    rows = packing.pack(table(spark, texts, CLASH), tokenizer_path(), group_docs=10).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(ids[i][at:at + r.length], "<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[i]), zlib.crc32(part))
            at += r.length
        assert at == len(ids[i])
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    assert packing.pack(table(spark, [(1, "x")]).limit(0), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_wastes_less_than_one_sequence(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randrange(1, 2048), 1100, 1]) for _ in range(300)]
    pieces = packing.plan(lengths)
    used = {}
    for i, start, n, s, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert used.get(s, 0) == offset
        used[s] = offset + n
    assert max(used.values()) <= 2048 and len(used) == -(-sum(lengths) // 2048)
    for i, n in enumerate(lengths):
        assert sum(p[2] for p in pieces if p[0] == i) == n


# Decontamination

def brute_hits(texts, items, size=10):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = {}
    for i, t in items:
        w = low(t)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            wins.setdefault(tuple(w[s:s + size]), set()).add(str(i))
    out = {}
    for d, t in texts:
        w, hit, found = low(t), set(), set()
        for s in range(len(w)):
            for n in {len(k) for k in wins}:
                k = tuple(w[s:s + n])
                if len(k) == n and k in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[k]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def test_decontaminate(spark):
    rng = random.Random(11)
    items = [(i, words(rng, rng.choice([4, 10, 25]), 2000)) for i in range(12)] + [(20, None), (21, "..."), (22, "Short One"), (23, "Émile É é"), (7, "again the same id here")]
    texts = []
    for i in range(40):
        own = words(rng, rng.randrange(0, 60), 2000)
        item = rng.choice(items)[1] or ""
        part = " ".join(item.split()[: rng.choice([3, 9, 30])])
        texts.append((i, rng.choice([own, f"{own}, {part.upper()}; {own}", f"{own} {item}{item}", "émile É é short ONE", None, "word " * 5000])))
    docs = table(spark, texts, CLASH)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(1)).withColumn("w", F.lit(2))
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect()}
    assert got == brute_hits(texts, items)
    none = decontaminate.decontaminate(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.contaminated for r in none)
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    item = " ".join(f"t{k}" for k in range(12))
    one = spark.createDataFrame([("q", item)], "item_id string, text string")
    rows = decontaminate.decontaminate(table(spark, [(None, f"x {item}"), (None, "other words"), (1, item)]), one).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in rows) == [("1", 12, 12), ("None", 2, 0), ("None", 13, 12)]


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    docs = table(spark, ["alpha beta and gamma delta epsilon zeta eta theta iota kappa", "alpha x", "kappa iota"])
    got = {r.doc_id: r.off_by for r in decontaminate.near(docs, items, slack=2).collect()}
    assert set(got) == {0} and got[0] in (0, 1)


# N-gram join

def brute_join(texts):
    low = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    sets = {i: frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for i, w in ((i, low(t)) for i, t in texts)}
    head, rep = {}, {}
    for i in sorted(sets):
        head[i] = rep.setdefault(sets[i], i) if sets[i] else i
    heads = sorted(h for h in set(head.values()) if sets[h])
    links = [(a, b) for k, b in enumerate(heads) for a in heads[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {h: h for h in set(head.values())}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: (head[i], find(head[i])) for i in sets}, links


def test_ngram_join(spark):
    texts = list(enumerate(corpus(12, 60)))
    want, links = brute_join(texts)
    got = ngram_join.near_duplicates(table(spark, texts, CLASH)).collect()
    assert {r.doc_id: (r.head_id, r.class_id) for r in got} == want and len(got) == len(texts)
    assert links and {r.doc_id: r.n_links for r in got} == {i: sum(want[i][0] in pair for pair in links) for i, _ in texts}


@pytest.mark.parametrize("n, edits", [(30, 1), (200, 1)])
def test_ngram_join_counts_all_links_of_edited_copies(spark, n, edits):
    rng = random.Random(n)
    base, texts = words(rng, 120, 10**6).split(), []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(120), edits):
            w[k] = f"e{i}x{k}"
        texts.append((i, " ".join(w)))
    want, links = brute_join(texts)
    assert len(links) > 10 * n or n == 30
    got = ngram_join.near_duplicates(table(spark, texts)).collect()
    degree = {i: 0 for i, _ in texts}
    for pair in links:
        for i in pair:
            degree[i] += 1
    assert {r.doc_id: r.n_links for r in got} == degree
    assert {r.doc_id: (r.head_id, r.class_id) for r in got} == want


def test_link_counts_in_several_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base, texts = words(rng, 60, 10**6).split(), []
    for i in range(40):
        w = list(base)
        w[rng.randrange(60)] = f"e{i}"
        texts.append((i, " ".join(w)))
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    want, links = brute_join(texts)
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(table(spark, texts)).collect()}
    assert got == {i: sum(i in pair for pair in links) for i, _ in texts}


def test_large_open_groups_are_settled(spark):
    """Pairs of a group that neither of its two ends resembles, by the set join."""
    rng = random.Random(6)
    texts = []
    for g in range(5):
        base = words(rng, 80, 10**6).split()
        for i in range(30):
            w = list(base)
            w[rng.randrange(80)] = f"e{g}x{i}"
            texts.append((len(texts), " ".join(w)))
    want, links = brute_join(texts)
    docs = table(spark, texts)
    heads = ngram_join.membership(docs).select(F.col("doc_id").alias("id"), "set1")
    grams = ngram_join.gram_sets(docs, heads)
    for root in (F.col("id"), -1 - F.floor(F.col("id") / 3)):
        rows = heads.select(F.explode(F.expr("array(1L, 2L)")).alias("key"), "id", root.cast("long").alias("root"))
        found = ngram_join.crowded_links(rows, grams).collect()
        parts = {r.id: r.root for r in cc.components(spark.createDataFrame([(r.a, r.b) for r in found] + [(x.id, x.root) for x in rows.collect()], "a long, b long")).collect()}
        assert {(r.a, r.b) for r in found} <= set(links) and len(found) < len(links)
        assert all(parts[a] == parts[b] for a, b in links)
    assert all(parts[a] != parts[b] for a, b in ((0, 30), (30, 60), (60, 90), (90, 120)))


def test_descent_follows_the_similarities_found(spark):
    rows = lambda s: spark.createDataFrame([(k, k + 1, s) for k in range(50)], "a long, b long, s double")
    assert not ngram_join.deep_enough(rows(0.99), 6, 0.8) and ngram_join.deep_enough(rows(0.99), 5, 0.8)
    assert not ngram_join.deep_enough(rows(0.81), 4, 0.8) and ngram_join.deep_enough(rows(0.81), 3, 0.8)


# HTML extraction

def test_html_extract(spark):
    pages = [
        (1, '<html><head><title>T</title><script>var a="</p><p>x";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy  now.</div>'
            "<article><h1>A  &amp; B</h1><p>First <b>bold</b>ly\n said.<p>Second &lt;tag&gt; &#233;.</article><footer>&copy; site</footer></body></html>"),
        (2, None), (3, ""), (4, "no markup at all"), (5, "<" * 5000), (6, "<article><p>x" + "<div>" * 3000 + "deep"), (7, '<p title="a>b">un<!-- c -->closed <script>'),
    ]
    df = spark.createDataFrame([(i, f"u{i}", h) for i, h in pages] + [(1, None, pages[0][1])], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(2))
    rows = html_extract.extract(df).collect()
    assert len(rows) == 8 and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.page_id == 1] == ["A & B First boldly said. Second <tag> é."] * 2
    assert all(r.text == "" for r in rows if r.page_id in (2, 3))
    assert html_extract.extract(df.limit(0)).count() == 0


def test_chain_on_unseen_pages():
    chain = html_extract.fit_chain()
    right = total = 0
    for page, labels in html_extract.labelled_pages(80, seed=77):
        found = chain.decode([f for _, f in html_extract.blocks(page)])
        right += sum(a == b for a, b in zip(found, labels))
        total += len(labels)
    assert right >= 0.98 * total


PARAGRAPHS = [f"Sentence number {k} tells of rivers and of the long road that leads there, as it always did." for k in range(4)]
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></nav>'
FOOT = "<footer><div>&copy; 2024 Some Site</div></footer>"


@pytest.mark.parametrize("before, after", [
    ('<div class="story">', "</div>"), ("<article>", "</article>"), ("<article><div>", "</div></article>"), ("<div>" * 600 + "<article>", "</article>" + "</div>" * 600),
    ('<div class="wrapper"><div class="row"><main>', '<div class="comments"><h3>Comments</h3><div class="comment"><p>nice one</p></div></div></main></div></div>'),
])
def test_layouts_the_chain_was_not_fitted_on(before, after):
    told = "".join(f"<p>{t}</p>" for t in PARAGRAPHS)
    assert html_extract.main_text(f"<html><body>{NAV}{before}{told}{after}{FOOT}</body></html>", html_extract.fit_chain()) == " ".join(PARAGRAPHS)


def test_html_parts_inside_an_article():
    chain = html_extract.fit_chain()
    a, b, c, d = (f"<p>{t}</p>" for t in PARAGRAPHS)
    page = f"<html><body>{NAV}<article><div>{a}<aside><p>See also this.</p></aside>{b}</div><table><tr><td>Year</td><td>2020</td></tr><tr><td>Sum</td><td>1,204</td></tr></table></article>{FOOT}</body></html>"
    assert html_extract.main_text(page, chain) == f"{PARAGRAPHS[0]} {PARAGRAPHS[1]} Year 2020 Sum 1,204"
    quoted = f"""<article>{a}<p data-x="(5000 {'y' * 5000}> leaked" title='a > b'>{PARAGRAPHS[1]}</p><p a="b>{c}{d}</article>"""
    assert [t for t, _ in html_extract.blocks(quoted)][:2] == PARAGRAPHS[:2]
    assert not any("leaked" in t for t, _ in html_extract.blocks(quoted))
    assert html_extract.blocks("<a b=" * 20000 + "<" * 20000)[0][0].startswith("<a b=<a b=")
    assert [t for t, _ in html_extract.blocks("<b>" * 20000 + "<p>x" * 200)] == ["x"] * 200


def random_chain(seed, features=4):
    rng = np.random.default_rng(seed)
    chain = html_extract.Chain([str(k) for k in range(features)])
    chain.emit, chain.move = rng.normal(size=(features, 2)), rng.normal(size=(2, 2))
    page = [[str(k) for k in range(features) if rng.random() < 0.5] for _ in range(rng.integers(1, 8))]
    return chain, page, rng.integers(0, 2, len(page)).tolist()


def chain_score(chain, page, labels):
    score = sum(chain.emit[int(f), y] for features, y in zip(page, labels) for f in features)
    return score + sum(chain.move[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_finds_the_best_of_all_labels(seed):
    chain, page, _ = random_chain(seed)
    every = list(itertools.product((0, 1), repeat=len(page)))
    assert np.isclose(chain_score(chain, page, chain.decode(page)), max(chain_score(chain, page, y) for y in every))


def test_chain_gradient():
    drawn = [random_chain(seed) for seed in range(5)]
    chain, pages, labels = drawn[0][0], [d[1] for d in drawn], [d[2] for d in drawn]
    batch = chain.padded(pages, labels)

    def likelihood():
        return sum(chain_score(chain, p, y) - np.log(sum(np.exp(chain_score(chain, p, z)) for z in itertools.product((0, 1), repeat=len(p)))) for p, y in zip(pages, labels))

    value, by_emit, by_move = chain.gradient(*batch)
    assert np.isclose(value, likelihood())
    for weights, slope in ((chain.emit, by_emit), (chain.move, by_move)):
        for at in np.ndindex(weights.shape):
            weights[at] += 1e-5
            up = likelihood()
            weights[at] -= 2e-5
            assert np.isclose((up - likelihood()) / 2e-5, slope[at], atol=1e-4)
            weights[at] += 1e-5


# Words and hashes

def test_words_and_hashes():
    texts = ["", None, " a  bb\tccc\x0bé", "x" * 10, "a bb", "   "]
    column = pa.array(texts)
    for most in (1, 8, 1 << 20):
        out = {}
        for lo, hi, data, offsets in W.chunks(column, most):
            start, end, first = W.words(data, offsets)
            for r in range(hi - lo):
                out[lo + r] = [data[start[k]:end[k]].tobytes().decode() for k in range(first[r], first[r + 1])]
        assert out == {i: (t or "").split() for i, t in enumerate(texts)}
    sliced = pa.array(["skip", "a bb", None, "c"]).slice(1)
    assert [hi - lo for lo, hi, *_ in W.chunks(sliced)] == [3]
    p = W.Prefix(np.arange(50, dtype=np.uint64) % 7)
    assert p.spans(np.array([0, 7]), np.array([20, 27]))[0] == p.spans(np.array([7]), np.array([27]))[0]


def test_html_raw_and_deep_elements():
    text = lambda page: [t for t, _ in html_extract.blocks(page)]
    for empty in ("<svg class='i'/>", "<svg viewBox=0 />", "<script src='x'/>", "<noscript>", "<template>", "<svg>"):
        assert text(f"<p>one</p>{empty}<p>two</p><svg><text>no</text></svg><p>three</p>") == ["one", "two", "three"], empty
    assert text("<p>a</p><svg><svg><text>x</text></svg><text>y</text></svg><p>b</p><script>c<p>d</p>") == ["a", "b"]
    assert text("<script src=/x/>no</script><p>a</p>") == ["a"]
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p><object><p>fallback</p></object>") == ["so x=1 holds", "fallback"]
    deep = html_extract.blocks("<nav>" + "<b>" * 400 + "menu</nav><article><p>text</p></article>")
    assert [(t, "in:nav" in f) for t, f in deep] == [("menu", True), ("text", False)]


def test_substring_section_repeated_in_its_own_document(spark):
    rng = random.Random(21)
    v, p, z, x, y, other = (words(rng, n, 10**6) for n in (40, 60, 40, 60, 60, 100))
    docs = table(spark, [(1, f"{x} {p} {y}"), (2, f"{v} {p} {z} {other} {v} {p} {z}")])
    got = {r.doc_id: (r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(docs).collect()}
    assert got == {1: (0, f"{x} {p} {y}"), 2: (120, f"{v} {z} {other} {v} {z}")}
