"""The ledger's tables: derived from the sample tables, read from Parquet, or read from authored JSON documents.

``TABLES`` is plain SQL that Spark and DuckDB both run, so that an operator and its oracle see the same input.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Name -> SELECT over the sample tables and the names before it. MICROS(x) is x in microseconds of the epoch.
TABLES = {
    "claims": """
SELECT o_orderkey AS claim_id, o_custkey AS issuer, (o_custkey * 7 + 3) % 100 AS subject, o_orderkey + 1 AS created, MICROS(o_orderdate) AS deadline_at,
       CASE WHEN o_orderstatus = 'O' THEN 2 WHEN o_orderstatus = 'P' THEN 7 WHEN o_orderkey % 5 = 0 THEN 13 WHEN o_orderkey % 7 = 0 THEN 15 ELSE 8 END AS status,
       CAST(substring(o_orderpriority, 1, 1) AS INT) AS action, (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS local_complete,
       (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS released
FROM orders""",
    "edges": """
SELECT claim_id AS source, 8 AS relation, CAST(floor((claim_id - 1) / 8.0) AS BIGINT) AS target, created AS introduced FROM claims WHERE claim_id > 0
UNION ALL SELECT claim_id, 6, CAST(floor(claim_id / 2.0) AS BIGINT), created FROM claims WHERE claim_id > 0 AND claim_id % 3 = 1
UNION ALL SELECT claim_id, 6, claim_id - 1, created FROM claims WHERE claim_id % 10 = 9
UNION ALL SELECT claim_id, 7, CASE WHEN claim_id % 10 = 4 THEN claim_id + 1 ELSE claim_id - 1 END, created FROM claims WHERE claim_id % 10 IN (4, 5)""",
    "validations": """
SELECT l_orderkey * 8 + l_linenumber AS validation_id, l_orderkey AS claim_id, min(l_suppkey) AS evaluator,
       CASE WHEN l_linenumber % 2 = 1 THEN 2 ELSE 1 END AS mode, 1 + l_linenumber % 3 AS phase, CAST(l_linenumber AS INT) AS kind
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "verdicts": """
SELECT l_orderkey * 8 + l_linenumber AS validation_id,
       row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS attempt,
       CASE WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'R' THEN 2 WHEN l_linestatus = 'F' THEN 3 END AS verdict
FROM lineitem""",
    "nodes": """
SELECT s_suppkey AS node_id, s_nationkey AS zone, n_regionkey AS region, CAST(floor(s_acctbal) AS BIGINT) AS load, (s_suppkey * 37) % 64 AS memory,
       (s_suppkey * 53) % 512 AS disk, s_suppkey % 11 <> 3 AS alive
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "deltas": """
SELECT CAST(floor(event_id / 4.0) AS BIGINT) + 1 AS sequence, event_id % 4 AS ordinal, user_id AS claim_id, event_type AS action, event_id,
       CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 4 WHEN 'purchase' THEN 8 ELSE 13 END AS status
FROM events""",
    "samples": """
SELECT event_id AS request, MICROS(ts) AS start, CAST(round(value * 1000) AS BIGINT) AS latency, event_type AS outcome, user_id AS worker FROM events""",
    "artifacts": """
SELECT doc_id AS artifact_id, lang AS kind, source AS producer, sha256(coalesce(text, '')) AS hash, doc_id + 1 AS created, n_chars AS size FROM documents""",
    "responses": """
SELECT conv_id AS claim_id, turn AS cycle, role AS author, length(text) AS size FROM conversations""",
    "monitors": """
SELECT claim_id AS monitor_id, CAST(floor(claim_id / 3.0) AS BIGINT) AS owner, claim_id % 9 = 0 AS released FROM claims WHERE claim_id % 3 = 0""",
    "monitor_roots": """
SELECT monitor_id, monitor_id + 1 AS root, 1 AS predicate FROM monitors UNION ALL SELECT monitor_id, monitor_id + 2, 2 FROM monitors WHERE monitor_id % 2 = 0""",
}
_NEEDS = {"claims": ["orders"], "edges": ["claims"], "validations": ["lineitem"], "verdicts": ["lineitem"], "nodes": ["supplier", "nation"], "deltas": ["events"], "samples": ["events"],
          "artifacts": ["documents"], "responses": ["conversations"], "monitors": ["claims"], "monitor_roots": ["monitors"]}


def _dialect(sql: str, micros: str, sha: str) -> str:
    return re.sub(r"sha256\((coalesce\([^)]*\))\)", sha, re.sub(r"MICROS\((\w+)\)", micros, sql))


def duckdb_prefix() -> str:
    """The ledger's tables as common table expressions for an oracle query."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({_dialect(sql, r'epoch_us(\1)', r'sha256(\1)')})" for name, sql in TABLES.items())


@dataclass
class Ledger:
    """One DataFrame for each table of the ledger."""

    claims: DataFrame
    edges: DataFrame
    validations: DataFrame
    verdicts: DataFrame
    nodes: DataFrame
    deltas: DataFrame
    samples: DataFrame
    artifacts: DataFrame
    responses: DataFrame
    monitors: DataFrame
    monitor_roots: DataFrame

    def at(self, prefix: int) -> Ledger:
        """The ledger as of a sequence: what was created later is left out."""
        kept = {f.name: getattr(self, f.name) for f in fields(self)}
        for name, column in (("claims", "created"), ("artifacts", "created"), ("edges", "introduced"), ("deltas", "sequence")):
            kept[name] = kept[name].where(F.col(column) <= prefix)
        return Ledger(**kept)

    def write(self, path: str) -> None:
        """Every table as Parquet under ``path``; claims by status, so that status scans read only theirs."""
        for f in fields(self):
            writer = getattr(self, f.name).write.mode("overwrite")
            (writer.partitionBy("status") if f.name == "claims" else writer).parquet(f"{path}/{f.name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Ledger:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})


def sample_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    """The ledger derived from the sample tables in ``sf_dir``."""
    found: dict[str, DataFrame] = {}
    for name, sql in TABLES.items():
        text = _dialect(sql, r"unix_micros(CAST(\1 AS TIMESTAMP))", r"sha2(\1, 256)")
        for need in _NEEDS[name]:
            text = re.sub(rf"\b(FROM|JOIN) {need}\b", rf"\1 {{{need}}}", text)
        inputs = {need: found.get(need) or spark.read.parquet(f"{sf_dir}/{need}.parquet") for need in _NEEDS[name]}
        found[name] = spark.sql(text, **inputs)
    return Ledger(**found)


CLAIM_DOCUMENT = T.StructType([
    T.StructField("claim_id", T.LongType()), T.StructField("issuer", T.LongType()), T.StructField("subject", T.LongType()),
    T.StructField("action", T.IntegerType()), T.StructField("description", T.StringType())])


def read_documents(spark: SparkSession, path: str, schema: T.StructType = CLAIM_DOCUMENT) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) authored JSON documents, one on a line: unknown or missing fields and wrong types are refused."""
    names = sorted(schema.fieldNames())
    lines = spark.read.text(path).select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("doc"), F.array_sort(F.json_object_keys("value")).alias("keys"))
    good = (F.col("keys") == F.array(*(F.lit(n) for n in names))) & ~F.array_contains(F.array(*(F.col(f"doc.{n}").isNull() for n in names)), True)
    good = F.coalesce(good, F.lit(False))
    return lines.where(good).select("doc.*"), lines.where(~good).select("value")
