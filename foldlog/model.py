"""Envelopes, handler results, and the engine's own tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

ENVELOPE = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("stream_id", T.StringType(), False), T.StructField("type", T.StringType(), False),
    T.StructField("data", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("position", T.LongType(), False), T.StructField("occurred_at", T.TimestampType()),
])
_TEXTS = T.MapType(T.StringType(), T.StringType())
STEP = T.StructType([T.StructField("name", T.StringType()), T.StructField("action", T.StringType()), T.StructField("table", T.StringType()), T.StructField("key", _TEXTS), T.StructField("set", _TEXTS), T.StructField("inc", T.MapType(T.StringType(), T.LongType()))])
#: kind: insert update delete multi skip (success), error exception (failure), invalid, or null (no clause matched).
RESULT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("steps", T.ArrayType(STEP)), T.StructField("reason", T.StringType()), T.StructField("error", T.StringType()), T.StructField("stacktrace", T.StringType())])

POSITIONS = "projection_name string, projection_version int, stream_id string, position bigint, updated_at timestamp"
DEAD_LETTERS = (
    "id bigint, projection_name string, projection_version int, position bigint, stream_id string, event_type string, event_data string, "
    "error_kind string, error_message string, error_stacktrace string, occurred_at timestamp"
)
PROGRESS = "projection_name string, projection_version int, position bigint, occurred_at timestamp, updated_at timestamp"
SCHEMAS = {"positions": POSITIONS, "dead_letters": DEAD_LETTERS, "progress": PROGRESS}
#: Versions of the installed schema: 1 adds positions and dead letters, 2 adds progress.
SCHEMA_TABLES = {1: ("positions", "dead_letters"), 2: ("progress",)}


def schema_steps(from_: int, to: int) -> list[str]:
    """The engine's tables that schema versions beyond from_ up to to add."""
    top = max(SCHEMA_TABLES)
    if not 0 <= from_ <= to <= top:
        raise ValueError(f"schema versions go from 0 to {top}, upwards; not from {from_} to {to}")
    return [t for v in range(from_ + 1, to + 1) for t in SCHEMA_TABLES[v]]


SUCCESS = ("insert", "update", "delete", "multi", "skip")
FAILURE = ("error", "exception")
RESERVED_KEYS = ("event", "position", "dead_letter")
#: A pseudo-name under which merged steps are kept; it never collides.
IGNORED_KEYS = ("merge",)


@dataclass(frozen=True)
class Event:
    id: str
    stream_id: str
    type: str
    data: Any
    position: int
    occurred_at: Any = None
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("id", "stream_id", "type", "position"):
            if getattr(self, name) is None:
                raise ValueError(f"an event needs {name}")
        object.__setattr__(self, "metadata", self.metadata or {})


@dataclass(frozen=True)
class Insert:
    table: str
    row: dict[str, Any]


@dataclass(frozen=True)
class Update:
    table: str
    where: dict[str, Any]
    set: dict[str, Any] = field(default_factory=dict)
    inc: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Upsert:
    """Insert a row, or set and add to the one that has its key."""

    table: str
    key: dict[str, Any]
    set: dict[str, Any] = field(default_factory=dict)
    inc: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Delete:
    table: str
    where: dict[str, Any]


@dataclass(frozen=True)
class Multi:
    """Named steps that are applied together."""

    steps: dict[str, Insert | Update | Upsert | Delete]


@dataclass(frozen=True)
class Skip:
    pass


@dataclass(frozen=True)
class Error:
    reason: str


@dataclass(frozen=True)
class Table:
    """A read model: its columns as a Spark DDL string, its primary key, columns that may not be null."""

    name: str
    ddl: str
    key: tuple[str, ...]
    required: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T._parse_datatype_string(self.ddl)
