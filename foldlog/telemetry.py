"""Events of the engine on the driver: attach callables by name prefix."""

from __future__ import annotations

import time
from collections.abc import Callable

#: All events: what is measured with each, and what else it says.
CATALOG = {
    # told once a batch, summed over its events: they are handled on executors
    "event.start": (("system_time", "count", "duration"), ("projection",)),
    "event.stop": (("duration", "count"), ("projection",)),
    "event.exception": (("duration", "count"), ("projection",)),
    "event.skipped": (("system_time", "count"), ("projection", "reason")),
    "batch.stop": (("duration", "batch_size"), ("projection",)),
    "dead_letter": (("system_time",), ("projection", "position", "stream_id", "event_type", "error_kind")),
    "started": (("system_time",), ("projection",)),
    "paused": (("system_time",), ("projection",)),
    "resumed": (("system_time",), ("projection",)),
    "cursors.loaded": (("count",), ("projection", "source")),
    "lag": (("lag_ms", "position"), ("projection", "status")),
    "halted": (("system_time",), ("projection", "reason", "failure")),
    "source.standby": (("attempt", "retry_in_ms"), ("subscription", "reason")),
    "source.subscribed": (("attempts",), ("subscription",)),
    "source.batch.failed": (("count",), ("subscription", "reason")),
}


class Bus:
    def __init__(self):
        self._handlers: list[tuple[str, Callable[[str, dict, dict], None]]] = []

    def attach(self, prefix: str, handler: Callable[[str, dict, dict], None]) -> Callable[[], None]:
        entry = (prefix, handler)
        self._handlers.append(entry)
        return lambda: self._handlers.remove(entry)

    def listens(self, name: str) -> bool:
        return any(name.startswith(prefix) for prefix, _ in self._handlers)

    def emit(self, name: str, measured: dict | None = None, **said) -> None:
        if name not in CATALOG:
            raise ValueError(f"unknown event {name}")
        measured = {"system_time": time.time()} | (measured or {})
        for prefix, handler in list(self._handlers):
            if name.startswith(prefix):
                try:
                    handler(name, measured, said)
                except Exception:  # a listener's failure is not the engine's
                    pass


bus = Bus()
