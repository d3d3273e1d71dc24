"""Point reads, ordered scans and filtered lists. All optional predicates are conjunctive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import is_active
from ..sources.ledger import Ledger
from .spread import tasks

#: Predicates that each family has; others are refused.
PREDICATES = {
    "claims": ("claim_id", "issuer", "subject", "status", "action"),
    "validations": ("claim_id", "evaluator", "kind", "phase", "mode"),
    "artifacts": ("kind", "producer", "hash"),
    "responses": ("claim_id", "author"),
}


def list_family(ledger: Ledger, family: str, **predicates) -> DataFrame:
    """Rows of a family that meet all predicates; one that does not belong to the family is an error."""
    if unknown := set(predicates) - set(PREDICATES[family]):
        raise ValueError(f"{family} has no predicate {', '.join(sorted(unknown))}")
    out = getattr(ledger, family)
    for name, value in predicates.items():
        out = out.where(F.col(name) == value)
    return out


def get_object(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def get_objects(table: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(ord, key, found): the requests (ord, key) in order, with whether there is such an object."""
    have = table.select(key).distinct().withColumn("found", F.lit(True))
    return wanted.join(have, key, "left").select("ord", key, F.coalesce("found", F.lit(False)).alias("found"))


def identity_lookup(artifacts: DataFrame, hashes: DataFrame) -> DataFrame:
    """(hash, artifact_id): the smallest object with each wanted content hash."""
    return artifacts.join(hashes, "hash", "left_semi").groupBy("hash").agg(F.min("artifact_id").alias("artifact_id"))


def deadlines_through(claims: DataFrame, at: int) -> DataFrame:
    """Active claims due by ``at``, in order of deadline and id."""
    return claims.where(is_active(F.col("status")) & (F.col("deadline_at") <= at)).select("claim_id", "deadline_at").orderBy("deadline_at", "claim_id")


def required(validations: DataFrame, claim: int) -> DataFrame:
    """Required validations of a claim, in order of phase and id."""
    return validations.where((F.col("claim_id") == claim) & (F.col("mode") == vocab.REQUIRED)).select("phase", "validation_id").orderBy("phase", "validation_id")


def adjacent(edges: DataFrame, node: int, forward: bool = True) -> DataFrame:
    own, other = ("source", "target") if forward else ("target", "source")
    return edges.where(F.col(own) == node).select(other, "relation").orderBy(other, "relation")


def after(table: DataFrame, keys: list[str], cursor: tuple, limit: int) -> DataFrame:
    """The next ``limit`` rows strictly after ``cursor`` in the order of ``keys``."""
    beyond = F.lit(False)
    for i in reversed(range(len(keys))):
        beyond = (F.col(keys[i]) > cursor[i]) | ((F.col(keys[i]) == cursor[i]) & beyond)
    return table.where(beyond).orderBy(*keys).limit(limit)


def by_claim(ledger: Ledger, claims: DataFrame, attached: DataFrame) -> DataFrame:
    """(kind, id, claim_id): claims, responses, validations and attached artifacts (claim_id, artifact_id) of the wanted claims (claim_id)."""
    families = (ledger.claims.select(F.lit(1).alias("kind"), F.col("claim_id").alias("id"), "claim_id"),
                ledger.responses.select(F.lit(2), F.col("cycle"), "claim_id"),
                ledger.validations.select(F.lit(3), "validation_id", "claim_id"),
                attached.join(ledger.artifacts.select("artifact_id"), "artifact_id").select(F.lit(4), "artifact_id", "claim_id"))
    return families[0].union(families[1]).union(families[2]).union(families[3]).join(claims, "claim_id", "left_semi").select("kind", "id", "claim_id")


def validation_results(verdicts: DataFrame, validations: DataFrame) -> DataFrame:
    """A summary row (attempt null) for each run, then its attempts: validation_id, attempt, verdict, attempts."""
    n = tasks(verdicts, verdicts.count())
    known = validations.select("validation_id").repartition(n, "validation_id")
    rows = verdicts.repartition(n, "validation_id").join(known, "validation_id", "left_semi")
    # in ranges of ids, so that a run's rows stand together and the order needs no further exchange
    rows = rows.select("validation_id", "attempt", "verdict").repartitionByRange(n, "validation_id")
    run = Window.partitionBy("validation_id").orderBy("attempt")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select("*", F.row_number().over(run).alias("_r"), F.max_by("verdict", "attempt").over(whole).alias("_last"), F.count("*").over(whole).alias("_n"))
    summary = F.struct(F.lit(None).cast("int").alias("attempt"), F.col("_last").alias("verdict"), F.col("_n").alias("attempts"))
    own = F.struct(F.col("attempt"), F.col("verdict"), F.lit(None).cast("bigint").alias("attempts"))
    each = rows.select("validation_id", F.explode(F.when(F.col("_r") == 1, F.array(summary, own)).otherwise(F.array(own))).alias("_e"))
    return each.select("validation_id", "_e.*").orderBy("validation_id", F.asc_nulls_first("attempt"))


def with_all_relations(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sources that have every wanted (relation, offset): a relational division by edges to source + offset."""
    have = edges.select("source", "relation", (F.col("target") - F.col("source")).alias("offset")).distinct()
    n = wanted.distinct().count()
    return have.join(wanted.distinct(), ["relation", "offset"]).groupBy("source").count().where(F.col("count") == n).select("source")


def created_range(table: DataFrame, after_: int, through: int) -> DataFrame:
    """Created after ``after_`` (not at it) and up to ``through``; an empty range is an error."""
    if after_ >= through:
        raise ValueError("after must be less than through")
    return table.where((F.col("created") > after_) & (F.col("created") <= through))


def handlers_match(validations: DataFrame, evaluator_from: int, evaluator_to: int, kind: int) -> DataFrame:
    """Claims with one validation that meets both predicates itself."""
    handlers = validations.groupBy("claim_id").agg(F.collect_list(F.struct("evaluator", "kind")).alias("handlers"))
    return handlers.where(F.exists("handlers", lambda h: h["evaluator"].between(evaluator_from, evaluator_to) & (h["kind"] == kind))).select("claim_id")


def responses_newest_first(responses: DataFrame, claim: int) -> DataFrame:
    return responses.where(F.col("claim_id") == claim).select("cycle", "author", "size").orderBy(F.desc("cycle"))


def deliveries(ledger: Ledger, participant: int, position: int) -> DataFrame:
    """(sequence, kind, claim_id) after a position: claims posted to a participant, and responses to claims it issued."""
    to = ledger.claims.where((F.col("subject") == participant) & (F.col("status") >= vocab.POSTED)).select(F.col("created").alias("sequence"), F.lit("posted").alias("kind"), "claim_id")
    own = ledger.claims.where(F.col("issuer") % 100 == participant).select("claim_id", "created")
    back = ledger.responses.join(own, "claim_id").select((F.col("created") + F.col("cycle")).alias("sequence"), F.lit("response").alias("kind"), "claim_id")
    return to.union(back).where(F.col("sequence") > position)


def page(table: DataFrame, keys: list[str], size: str, max_items: int, max_bytes: int) -> DataFrame:
    """The longest first page in key order within both bounds; a first row above ``max_bytes`` alone is an error."""
    rows = table.orderBy(*keys).limit(max_items)
    total = F.sum(size).over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    checked = rows.withColumn("_total", total).withColumn("_first", F.row_number().over(Window.orderBy(*keys)) == 1)
    too_large = F.raise_error(F.lit("the first item is larger than a page"))
    return checked.where(F.when(F.col("_first") & (F.col(size) > max_bytes), too_large.cast("boolean")).otherwise(F.col("_total") <= max_bytes)).drop("_total", "_first")


def guarded(responses: DataFrame, parents: DataFrame, cycle: int) -> DataFrame:
    """Responses of a cycle whose claim is one of ``parents``; others give an empty list, not an error."""
    return responses.where(F.col("cycle") == cycle).join(parents.select("claim_id"), "claim_id", "left_semi")


def index_scan(ledger: Ledger, predicates: dict[str, int]) -> DataFrame:
    """(predicate, claim_id): the ids that each single predicate selects; relation gives sources, verdict gives validations."""
    out = None
    for name, value in predicates.items():
        table, key = (ledger.edges, "source") if name == "relation" else (ledger.verdicts, "validation_id") if name == "verdict" else (ledger.claims, "claim_id")
        one = table.where(F.col(name) == value).select(F.lit(name).alias("predicate"), F.col(key).alias("claim_id"))
        out = one if out is None else out.union(one)
    return out
