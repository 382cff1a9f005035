"""Declaring a projection: checked when it is declared, not when it runs."""

from __future__ import annotations

from dataclasses import dataclass, fields
from typing import Any

from foldlog.functions.scalars import RETRY_ATTEMPTS, RETRY_BACKOFF, version_suffix_warning

#: Options of earlier designs, and what to do instead.
LEGACY = {
    "consistency": "commits are always atomic; drop it", "application": "give the log as source=", "repo": "give the tables' place as target=", "schema_prefix": "give the target another root",
}


def retry_plan(option: Any = None) -> tuple[int, list[int]]:
    """Attempts and waits in milliseconds: None and True mean the default, False a single attempt, a dict parts of both."""
    if option is False:
        return 1, []
    given = {} if option in (None, True) else option
    if not isinstance(given, dict) or set(given) - {"attempts", "backoff"}:
        raise ValueError("retry is False, True or a dict of attempts and backoff")
    attempts, backoff = given.get("attempts", RETRY_ATTEMPTS), list(given.get("backoff", RETRY_BACKOFF))
    if not isinstance(attempts, int) or isinstance(attempts, bool) or attempts < 1:
        raise ValueError("retry attempts have to be a positive integer")
    if any(not isinstance(x, int) or isinstance(x, bool) or x < 0 for x in backoff):
        raise ValueError("retry backoff has to be integers, 0 or more")
    if len(backoff) < attempts - 1:
        raise ValueError(f"{attempts} attempts need {attempts - 1} waits; backoff has {len(backoff)}")
    return attempts, backoff


@dataclass(frozen=True)
class Projection:
    name: str
    source: Any
    target: Any
    handler: Any
    parallelism: int
    version: int = 1
    partition_by: str = "stream_id"
    batch_size: int = 50
    batch_timeout_ms: int = 100
    retry: Any = None
    lag_interval_ms: int = 5000

    @property
    def identity(self) -> tuple[str, int]:
        return self.name, self.version


def declare(**options: Any) -> Projection:
    """A checked projection. Mistakes are reported in a fixed order, the options of earlier designs first."""
    from foldlog.sources.logs import Source
    from foldlog.targets.base import Target

    for name, instead in LEGACY.items():
        if name in options:
            raise ValueError(f"{name} is not an option: {instead}")
    known = [f.name for f in fields(Projection)]
    unknown = sorted(set(options) - set(known))
    if unknown:
        raise ValueError(f"unknown options {', '.join(unknown)}; there are {', '.join(known)}")
    for name in ("name", "source", "target", "handler"):
        if options.get(name) is None:
            raise ValueError(f"{name} is missing")
    if not isinstance(options["name"], str) or not options["name"]:
        raise ValueError("name has to be a string")
    if "parallelism" not in options:
        raise ValueError("parallelism is missing: how many partitions process streams side by side")
    for name in ("parallelism", "version", "batch_size"):
        value = options.get(name, 1)
        if not isinstance(value, int) or isinstance(value, bool) or value < 1:
            raise ValueError(f"{name} has to be a positive integer")
    for name in ("batch_timeout_ms", "lag_interval_ms"):
        value = options.get(name, 0)
        if not isinstance(value, int) or value < 0:
            raise ValueError(f"{name} has to be an integer, 0 or more")
    if options.get("partition_by", "stream_id") != "stream_id":
        raise ValueError("partition_by: only stream_id keeps a stream in order")
    if not isinstance(options["source"], Source):
        raise ValueError("source has to be a Source")
    if not isinstance(options["target"], Target):
        raise ValueError("target has to be a Target")
    if not (hasattr(options["handler"], "apply") or callable(options["handler"])):
        raise ValueError("handler has to be Rules, a Function or a callable")
    retry_plan(options.get("retry"))
    version_suffix_warning(options["name"])
    return Projection(**options)
