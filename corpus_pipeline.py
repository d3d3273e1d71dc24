"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept.

``run`` writes each stage as Parquet in the session's shared checkpoint folder and reads it back for the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidor.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from evidor.llm.common import cut, drop_ids, remove_folder, shared_folder, table
from evidor.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity detector does not reject."""
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line or nearly so; those of which nothing is left are dropped."""
    return line_dedup.without_duplicates(docs, keep_emptied=False)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates, and all that have none."""
    classes = ngram_join.near_duplicates(docs)
    return drop_ids(docs, cut(classes.where("doc_id <> class_id").select("doc_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return drop_ids(docs, cut(found.where("contaminated").select("doc_id").distinct()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot express the classifier, the fuzzy joins or the tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages. A stage's folder goes when the next one is written."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
