"""Scalar rules of the ledger as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def is_terminal(status: Column) -> Column:
    return status >= vocab.FIRST_TERMINAL


def is_active(status: Column) -> Column:
    return status < vocab.FIRST_TERMINAL


def severity(verdict: Column) -> Column:
    """0 mild to 3 severe; null for a verdict that is not given yet."""
    out = F.lit(None).cast("int")
    for code, rank in vocab.SEVERITY.items():
        out = F.when(verdict == code, rank).otherwise(out)
    return out


def by_severity(rank: Column) -> Column:
    """The verdict of a severity."""
    out = F.lit(None).cast("int")
    for code, r in vocab.SEVERITY.items():
        out = F.when(rank == r, code).otherwise(out)
    return out


def completion_status(verdict: Column) -> Column:
    """The claim status that a whole-work verdict leads to; null where it passes or is open."""
    return F.when(verdict == 2, 13).when(verdict == 4, 14).when(verdict == 3, 12)


def report_verdict(report: Column) -> Column:
    """The verdict of a test report {passed, failed, skipped}: unknown keys, missing keys or wrong types fail it."""
    doc = F.from_json(report, "passed bigint, failed bigint, skipped bigint")
    keys = F.array_sort(F.json_object_keys(report))
    whole = (keys == F.array(F.lit("failed"), F.lit("passed"), F.lit("skipped"))) & (doc["passed"] >= 0) & (doc["failed"] >= 0) & (doc["skipped"] >= 0)
    return F.when(~F.coalesce(whole, F.lit(False)), 2).when(doc["failed"] > 0, 2).when(doc["passed"] == 0, 3).otherwise(1)


def id_hex(number: Column, digits: int = 32) -> Column:
    """An id as lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def valid_kind(kind: Column) -> Column:
    """Whether an artifact kind has 1 to 128 characters of a-z, 0-9 and _ . / -"""
    return kind.rlike(r"^[a-z0-9_./-]{1,128}$")


def valid_scope(key: Column) -> Column:
    """Whether a scope key is not empty, has no space at its ends and no NUL."""
    return (F.length(key) > 0) & (F.trim(key) == key) & (F.instr(key, "\0") == 0)
