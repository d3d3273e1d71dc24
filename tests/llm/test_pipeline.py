"""The stages one by one and as a whole, on the smallest sample tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    toxic = {r[0] for r in duckdb.sql(f"SELECT doc_id FROM '{sf}/labels.parquet' WHERE toxic = 1").fetchall()}
    for name, stage in pipeline.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert out.columns == columns
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids
        if name == "toxicity":
            assert len(ids - left) < 0.2 * len(ids) and (ids - left) & toxic
        if name == "line_dedup":
            full = {r.doc_id for r in docs.where(r"text RLIKE '\\S'").select("doc_id").collect()}
            assert not out.where(r"text IS NOT NULL AND NOT text RLIKE '\\S'").where(F.col("doc_id").isin(*full)).count()
            assert len(ids - left) < 0.2 * len(ids)
        docs, ids = out, left
    from evidor.llm.decontaminate import decontaminate

    assert not decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").count()


def test_run(spark, sf):
    rows = pipeline.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0 and rows.count() > 0


def test_queries_match_sql(spark, sf):
    from evidor.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got = QUERIES[name](spark, sf)
        cols = ", ".join(sorted(got.columns))
        con.register("got", got.toPandas())
        assert con.sql(f"SELECT {cols} FROM got EXCEPT ALL SELECT {cols} FROM ({sql})").fetchall() == []
        assert con.sql(f"SELECT {cols} FROM ({sql}) EXCEPT ALL SELECT {cols} FROM got").fetchall() == []


def small_corpus(spark, folder):
    """Tables with toxic, repeated, nearly repeated, contaminated, empty and null rows; the documents as (id, text)."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    clean = [f"{say(40)}\n{say(50)}" for _ in range(150)]
    toxic = [f"{say(20)} vile rotten {say(10)} scummy vile {say(10)}" for _ in range(30)]
    item = say(15)
    rows = list(enumerate(clean + toxic))
    edited = clean[2].replace("\n", " ").split()
    edited[60] = "edited"
    rows += [(200, clean[0]), (201, None), (202, ""), (203, clean[1].split("\n")[0] + "\n" + say(30)), (204, " ".join(edited)), (205, f"{say(30)} {item} {say(5)}"), (None, say(35)), (206, clean[3].upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i >= 150)) for i in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("q1", item), ("q2", None)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, rows, item


def test_stages_against_brute_force(spark, tmp_path):
    from test_operators import brute_hits, brute_join, brute_lines

    folder = str(tmp_path / "t")
    docs, rows, item = small_corpus(spark, folder)
    stages = dict(pipeline.STAGES)
    step = lambda name, docs: spark.createDataFrame(stages[name](spark, docs, folder).collect(), docs.schema)
    kept = step("toxicity", docs)
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & set(range(150, 180)) and ids == {i for i, _ in rows if i is None or not 150 <= i < 180}
    texts = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.collect()]
    stay = brute_lines(texts)
    cleaned = {i: None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if stay[i, n]) for i, t in texts}
    want = {i: t for i, t in cleaned.items() if t == dict(texts)[i] or t.strip()}
    kept = step("line_dedup", kept)
    got = {-1 if r.doc_id is None else r.doc_id: r.text for r in kept.collect()}
    assert got == want and {201, 202} <= set(got) and not {200, 206} & set(got)
    classes, _ = brute_join([(i, t) for i, t in got.items() if i >= 0])
    kept = step("ngram_join", kept)
    left = {-1 if r.doc_id is None else r.doc_id: r.text for r in kept.collect()}
    assert left == {i: t for i, t in got.items() if i < 0 or classes[i][1] == i} and 204 not in left
    hits = brute_hits(list(left.items()), [("q1", item), ("q2", None)])
    kept = step("decontamination", kept)
    final = {-1 if r.doc_id is None else r.doc_id: r.text for r in kept.collect()}
    assert final == {i: t for i, t in left.items() if not hits[i][4]} and 205 not in final and 205 in left
    pieces = stages["packing"](spark, kept, folder).collect()
    assert {-1 if r.doc_id is None else r.doc_id for r in pieces} == set(final)


def test_run_on_an_empty_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    docs, *_ = small_corpus(spark, folder)
    empty = str(tmp_path / "e")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{empty}/{name}.parquet")
    assert pipeline.run(spark, empty).count() == 0
