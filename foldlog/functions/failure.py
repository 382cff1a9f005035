"""What a failed commit means: replay it, isolate its events, or halt."""

from __future__ import annotations

INTEGRITY, TRANSIENT, STRUCTURAL = "integrity", "transient", "structural"
#: Names that labels give to SQLSTATEs.
NAMES = {
    "23505": "unique_violation", "23502": "not_null_violation", "23503": "foreign_key_violation", "23514": "check_violation", "22001": "string_data_right_truncation",
    "22003": "numeric_value_out_of_range", "22012": "division_by_zero", "22018": "invalid_character_value_for_cast", "40001": "serialization_failure", "40P01": "deadlock_detected",
    "53300": "too_many_connections", "53200": "out_of_memory", "57014": "query_canceled", "57P01": "admin_shutdown", "57P02": "crash_shutdown", "57P03": "cannot_connect_now",
    "57P04": "database_dropped", "25006": "read_only_sql_transaction", "08006": "connection_failure", "42703": "undefined_column", "42P01": "undefined_table", "42501": "insufficient_privilege",
}


class CommitFailure(Exception):
    """A commit that failed with a SQLSTATE; position names the event, if one is to blame."""

    def __init__(self, state: str | None, message: str = "", position: int | None = None):
        super().__init__(message or label_of_state(state))
        self.state, self.position = state, position

    def getSqlState(self) -> str | None:  # noqa: N802  the name that Spark's exceptions have
        return self.state


class ConstraintFailure(Exception):
    """A declared constraint of a read model that a row breaks."""

    def __init__(self, kind: str, name: str):
        super().__init__(f"{kind} constraint {name}")
        self.kind, self.name = kind, name


class BatchCommitError(Exception):
    """A batch that stays uncommitted and is delivered again."""

    def __init__(self, count: int, reason: str):
        super().__init__(f"{count} events were not committed: {reason}")
        self.count, self.reason = count, reason


def state_of(error: BaseException) -> str | None:
    for name in ("getSqlState", "getSQLState"):
        ask = getattr(error, name, None)
        if ask:
            try:
                return ask()
            except Exception:
                return None
    return None


def classify_state(state: str) -> str:
    """The order matters: 57P04 is structural though its class is transient."""
    if state == "57P04":
        return STRUCTURAL
    if state in ("40001", "40P01", "25006"):
        return TRANSIENT
    group = state[:2]
    if group in ("22", "23"):
        return INTEGRITY
    return TRANSIENT if group in ("08", "53", "57") else STRUCTURAL


def classify(error: object) -> str:
    if isinstance(error, ConstraintFailure):
        return INTEGRITY
    if isinstance(error, ConnectionError):
        return TRANSIENT
    if isinstance(error, BaseException):
        state = state_of(error)
        if state:
            return classify_state(state)
        if isinstance(error, CommitFailure):
            return TRANSIENT
    return STRUCTURAL


def label_of_state(state: str | None) -> str:
    return "no SQLSTATE" if state is None else f"{state} ({NAMES[state]})" if state in NAMES else state


def label(error: object) -> str:
    if isinstance(error, ConstraintFailure):
        return f"ConstraintFailure ({error.kind}: {error.name})"
    state = state_of(error) if isinstance(error, BaseException) else None
    return label_of_state(state) if state else type(error).__name__
