"""Guards of the ledger's commands: a batch of proposals is judged against one state, each rule by joins and expressions.

A proposal is (claim_id, actor, n); actor 0 is the runtime, and n is what the command names: a receipt's epoch, an attempt,
a cycle or a count. Each rule gives an outcome: ``Applied:<status>``, ``Refused:<reason>``, ``Informed:<reason>`` or
``Noop``; the first rule that objects decides. Guards that need nothing of other tables cost no join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.scalars import completion_status, is_terminal
from ..sources.ledger import Ledger
from .derive import claim_verdicts, phase_state, runs

#: A condition (a text or a column) and the outcome where it holds.
Rules = list[tuple[Column | str, str]]


def decided(rules: Rules, applied: Column | str) -> Column:
    """The outcome of the first rule whose condition holds; a null condition does not hold."""
    out = F.lit(applied) if isinstance(applied, str) else applied
    for condition, outcome in reversed(rules):
        out = F.when(F.expr(condition) if isinstance(condition, str) else condition, outcome).otherwise(out)
    return out


def _standing(*statuses: int) -> tuple[str, str]:
    return f"status NOT IN ({', '.join(map(str, statuses))})", "Refused:TransitionForbidden"


def _actor(column: str) -> tuple[str, str]:
    return f"actor <> {column}", "Refused:WrongActor"


_RUNTIME, _ISSUER, _HOLDER = _actor("0"), _actor("issuer"), _actor("subject")
_ACTIVE = (f"status >= {vocab.FIRST_TERMINAL}", "Refused:TransitionForbidden")


def _receipts(ledger: Ledger) -> DataFrame:
    """(claim_id, epoch, responses): the newest cycle of each claim, which stands for its receipt's epoch."""
    return ledger.responses.groupBy("claim_id").agg(F.max("cycle").cast("bigint").alias("epoch"), F.count("*").alias("responses"))


def _at_epoch(n: Column | None = None) -> tuple[Column, str]:
    return F.coalesce(F.col("n") != (F.col("epoch") if n is None else n), F.lit(True)), "Refused:StaleReceipt"


def post(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    return asked, decided([_standing(1), _ISSUER], "Applied:2")


def acquire_receipt(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    """Posted; the subject; admission passed; all dependencies satisfied, else the smallest open one; epoch one."""
    admitted = phase_state(ledger, vocab.ADMISSION).select("claim_id", "passed")
    done = ledger.claims.where(F.col("status") == vocab.SATISFIED).select(F.col("claim_id").alias("target"))
    unmet = ledger.edges.where(F.col("relation") == vocab.DEPENDS_ON).join(done, "target", "left_anti").groupBy(F.col("source").alias("claim_id")).agg(F.min("target").alias("unmet"))
    facts = asked.join(admitted, "claim_id", "left").join(unmet, "claim_id", "left")
    pending = F.concat(F.lit("Informed:DependencyPending:"), F.col("unmet").cast("string"))
    late = F.when(F.col("unmet").isNotNull(), pending).when(F.col("n") != 1, "Refused:StaleReceipt").otherwise("Applied:3")
    return facts, decided([_standing(2), _HOLDER, (~F.col("passed"), "Informed:ValidationPending")], late)


def adopt_receipt(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    facts = asked.join(_receipts(ledger), "claim_id", "left")
    return facts, decided([_RUNTIME, _standing(3, 4, 5, 6, 7), _at_epoch(F.col("epoch") + 1)], F.concat(F.lit("Applied:"), F.col("status").cast("string")))


def record_progress(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    return asked.join(_receipts(ledger), "claim_id", "left"), decided([_standing(3, 4), _HOLDER, _at_epoch()], "Applied:4")


def begin_evidence(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    facts = asked.join(_receipts(ledger), "claim_id", "left")
    return facts, decided([_standing(3, 4), _HOLDER, _at_epoch()], F.concat(F.lit("Applied:"), F.col("status").cast("string")))


def close_testament(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    """The holder closes with the exact number of staged pieces."""
    facts = asked.join(_receipts(ledger), "claim_id", "left")
    wrong = F.col("n") != F.coalesce("responses", F.lit(0))
    return facts, decided([_standing(3, 4), _HOLDER, (wrong, "Refused:InvalidManifest")], "Applied:5")


def acknowledge_testament(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    stale = F.coalesce(F.col("n") != F.col("epoch"), F.lit(True))
    return asked.join(_receipts(ledger), "claim_id", "left"), decided([_RUNTIME, _standing(5), (stale, "Refused:InvalidManifest")], "Applied:6")


def begin_whole_work(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    increments = phase_state(ledger, 2).select("claim_id", "complete")
    facts = asked.join(increments, "claim_id", "left").join(_receipts(ledger), "claim_id", "left")
    rules = [_RUNTIME, _standing(6), (~F.col("complete"), "Informed:ValidationPending"), (F.col("epoch").isNull(), "Refused:InvalidManifest")]
    return facts, decided(rules, "Applied:7")


def begin_increment(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    """n numbers a check of the claim, which has to be one of increments."""
    facts = asked.join(ledger.validations.select("claim_id", F.col("kind").cast("bigint").alias("n"), "phase"), ["claim_id", "n"], "left")
    rules = [_RUNTIME, _standing(3, 4, 5, 6), (F.col("phase").isNull(), "Refused:UnknownObject"), (F.col("phase") != 2, "Refused:InvalidRelation")]
    return facts, decided(rules, F.concat(F.lit("Applied:"), F.col("status").cast("string")))


def record_verdict(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    """n is the attempt of the claim's first check: the evaluator's next one of a run that is open or ended in an error."""
    first = ledger.validations.where("kind = 1").select("claim_id", "validation_id", "evaluator")
    facts = asked.join(first, "claim_id", "left").join(runs(ledger.verdicts), "validation_id", "left")
    rules = [(F.col("validation_id").isNull(), "Refused:UnknownObject"), _actor("evaluator"),
             (F.coalesce(F.col("final").isin(1, 2, 3), F.lit(False)), "Refused:TransitionForbidden"),
             (F.col("n") != F.coalesce("attempts", F.lit(0)) + 1, "Refused:InvalidAttempt")]
    return facts, decided(rules, F.concat(F.lit("Applied:"), F.col("status").cast("string")))


def complete_whole_work(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    facts = asked.join(claim_verdicts(ledger), "claim_id", "left")
    reached = F.when(F.col("verdict") == 1, vocab.SATISFIED).otherwise(completion_status(F.col("verdict")))
    return facts, decided([_RUNTIME, _standing(7), (F.col("verdict").isNull(), "Informed:ValidationPending")], F.concat(F.lit("Applied:"), reached.cast("string")))


def _fails(*statuses: int, to: int) -> Callable:
    """n = 0 says that the evidence is no error report."""
    def rule(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
        return asked, decided([_RUNTIME, _standing(*statuses), (F.col("n") == 0, "Refused:InvalidSchema")], f"Applied:{to}")
    return rule


def cancel(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    return asked, decided([_ACTIVE, _ISSUER], "Applied:15")


def revoke(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    return asked, decided([_RUNTIME, _ACTIVE], "Applied:17")


def expire(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    """n is the time in days at which the timer fires; a terminal claim takes no notice."""
    early = F.col("n") * 86_400_000_000 < F.col("deadline_at")
    return asked, decided([_RUNTIME, (is_terminal(F.col("status")), "Noop"), (early, "Refused:DeadlineNotDue")], "Applied:16")


def supersede(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    """n is the successor, which has to name the same issuer and subject and the predecessor."""
    after = ledger.claims.select(F.col("claim_id").alias("n"), F.col("issuer").alias("issuer2"), F.col("subject").alias("subject2"))
    named = ledger.edges.where("relation = 5").select(F.col("source").alias("n"), F.col("target").alias("claim_id")).distinct().withColumn("named", F.lit(True))
    facts = asked.join(after, "n", "left").join(named, ["n", "claim_id"], "left")
    alike = F.coalesce((F.col("issuer") == F.col("issuer2")) & (F.col("subject") == F.col("subject2")) & F.col("named"), F.lit(False))
    kept = F.when(is_terminal(F.col("status")), F.concat(F.lit("Applied:"), F.col("status").cast("string"))).otherwise("Applied:18")
    return facts, decided([_ISSUER, (~alike, "Refused:InvalidRelation")], kept)


def register_monitor(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    """A monitor with the claim's number on root n, due with the claim; it has to be new, and the root has to exist."""
    have = ledger.monitors.select(F.col("monitor_id").alias("claim_id"), F.lit(True).alias("taken"))
    root = ledger.claims.select(F.col("claim_id").alias("n"), F.lit(True).alias("there"))
    facts = asked.join(have, "claim_id", "left").join(root, "n", "left")
    late = F.col("deadline_at") <= F.col("now")
    rules = [_ACTIVE, _ISSUER, (F.col("taken"), "Refused:ObjectIdConflict"), (late, "Refused:MissingDeadline"), (F.col("there").isNull(), "Refused:UnknownObject")]
    return facts, decided(rules, F.concat(F.lit("Applied:"), F.col("status").cast("string")))


def release_scope(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    held = ledger.edges.where(F.col("relation") == vocab.CAUSED_BY).join(ledger.claims.where("NOT released").select(F.col("claim_id").alias("source")), "source", "left_semi")
    held = held.select(F.col("target").alias("claim_id"), F.lit(True).alias("held")).distinct()
    waits = ~is_terminal(F.col("status")) | F.coalesce("held", F.lit(False))
    return asked.join(held, "claim_id", "left"), decided([_RUNTIME, (waits, "Informed:DependencyPending")], F.concat(F.lit("Applied:"), F.col("status").cast("string")))


def register_artifact(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    """An artifact of number n: content that stands under a smaller number is a duplicate of the smallest."""
    first = ledger.artifacts.groupBy("hash").agg(F.min("artifact_id").alias("first"))
    held = ledger.artifacts.join(first, "hash").select(F.col("artifact_id").cast("bigint").alias("n"), "first")
    again = F.concat(F.lit("Duplicate:"), F.col("first").cast("string"))
    late = F.when(F.col("first").isNull(), "Refused:UnknownObject").when(F.col("first") < F.col("n"), again).otherwise("Applied:0")
    return asked.join(held, "n", "left"), decided([_RUNTIME], late)


def expire_monitor(ledger: Ledger, asked: DataFrame) -> tuple[DataFrame, Column]:
    """The monitor with the claim's number; n is the day on which its owner's deadline fires."""
    due = ledger.claims.select(F.col("claim_id").alias("owner"), F.col("deadline_at").alias("due"))
    held = ledger.monitors.join(due, "owner").select(F.col("monitor_id").alias("claim_id"), F.col("released").alias("gone"), "due")
    rules = [_RUNTIME, (F.col("due").isNull(), "Refused:UnknownObject"), (F.col("gone"), "Noop"), (F.col("n") * 86_400_000_000 < F.col("due"), "Refused:DeadlineNotDue")]
    return asked.join(held, "claim_id", "left"), decided(rules, "Applied:16")


GUARDS: dict[str, Callable[[Ledger, DataFrame], tuple[DataFrame, Column]]] = {
    "post": post, "acquire_receipt": acquire_receipt, "adopt_receipt": adopt_receipt, "record_progress": record_progress, "begin_evidence": begin_evidence,
    "close_testament": close_testament, "acknowledge_testament": acknowledge_testament, "begin_whole_work": begin_whole_work, "begin_increment": begin_increment,
    "record_verdict": record_verdict, "complete_whole_work": complete_whole_work, "fail_post": _fails(1, 2, to=9), "fail_receipt": _fails(2, to=10),
    "fail_testament": _fails(3, 4, to=11), "cancel": cancel, "revoke": revoke, "expire": expire, "supersede": supersede, "register_monitor": register_monitor,
    "release_scope": release_scope, "register_artifact": register_artifact, "expire_monitor": expire_monitor,
}


def outcomes(ledger: Ledger, name: str, proposals: DataFrame, now: int = 0) -> DataFrame:
    """(claim_id, actor, n, outcome) of the proposals (claim_id, actor, n) of one command; one for no claim is refused."""
    claims = ledger.claims.select("claim_id", "issuer", "subject", "status", "deadline_at")
    asked = proposals.join(claims, "claim_id", "left").withColumn("now", F.lit(now))
    facts, outcome = GUARDS[name](ledger, asked)
    return facts.select("claim_id", "actor", "n", F.when(F.col("status").isNull(), "Refused:UnknownObject").otherwise(outcome).alias("outcome"))
