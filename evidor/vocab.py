"""Vocabulary of the ledger."""

# The ledger's numeric codes.
CLAIM_STATUS = {
    1: "Generated", 2: "Posted", 3: "Received", 4: "Progressed", 5: "TestamentGenerated", 6: "TestamentAcknowledged",
    7: "Validating", 8: "Satisfied", 9: "PostFailed", 10: "ReceiptFailed", 11: "TestamentGenerationFailed",
    12: "ValidationIncomplete", 13: "ValidationFailed", 14: "ValidationErrored", 15: "Cancelled", 16: "Expired",
    17: "Revoked", 18: "Superseded", 19: "DependencyFailed", 20: "Deadlocked",
}
RELATION_KIND = {
    1: "Issuer", 2: "Subject", 3: "Evaluator", 4: "ClaimAction", 5: "Supersedes", 6: "DependsOn", 7: "Awaits", 8: "CausedBy",
    9: "Refines", 10: "ConflictsWith", 11: "DerivedFrom", 12: "Reviews", 13: "Amends", 14: "ContributedBy", 15: "Invalidates",
}
VERDICT = {1: "Pass", 2: "Fail", 3: "Incomplete", 4: "Error"}
VALIDATION_PHASE = {1: "Admission", 2: "Increment", 3: "WholeWork"}
VALIDATION_MODE = {1: "Observe", 2: "Required"}

POSTED, VALIDATING, SATISFIED, FAILED, CANCELLED, EXPIRED, DEPENDENCY_FAILED, DEADLOCKED = 2, 7, 8, 13, 15, 16, 19, 20
#: Statuses from this code on are terminal.
FIRST_TERMINAL = 8
DEPENDS_ON, AWAITS, CAUSED_BY = 6, 7, 8
ADMISSION, REQUIRED = 1, 2
#: Verdicts from mild to severe; the order of the codes is another.
SEVERITY = {1: 0, 3: 1, 4: 2, 2: 3}
