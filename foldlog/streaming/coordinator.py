"""The states of a projection and which commands each allows."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

INITIALIZING, RUNNING, PAUSED, DRAINING, HALTED, STOPPED = "initializing", "running", "paused", "draining", "halted", "stopped"
_ALLOWED = {"pause": {RUNNING}, "resume": {PAUSED}, "stop": {RUNNING, PAUSED, HALTED}}


class InvalidState(Exception):
    def __init__(self, state: str):
        super().__init__(f"not possible while {state}")
        self.state = state


@dataclass
class Coordinator:
    """Holds the state; commands that a state doesn't allow raise InvalidState, repeated ones too."""

    state: str = INITIALIZING
    halt_reason: object = None
    ready_state: str = RUNNING
    started: bool = False
    lock: threading.RLock = field(default_factory=threading.RLock)

    def allow(self, command: str) -> None:
        if self.state not in _ALLOWED[command]:
            raise InvalidState(self.state)

    def ready(self) -> bool:
        """The query runs: go to the state it was lost from. True the first time ever."""
        with self.lock:
            if self.state == INITIALIZING:
                self.state = self.ready_state
            first, self.started = not self.started, True
            return first

    def lost(self) -> None:
        with self.lock:
            if self.state in (RUNNING, PAUSED, HALTED):
                self.ready_state, self.state = self.state, INITIALIZING

    def pause(self) -> None:
        with self.lock:
            self.allow("pause")
            self.state = PAUSED

    def resume(self) -> None:
        with self.lock:
            self.allow("resume")
            self.state = RUNNING

    def drain(self) -> None:
        with self.lock:
            self.allow("stop")
            self.state = DRAINING if self.state == RUNNING else STOPPED

    def stopped(self) -> None:
        with self.lock:
            self.state = STOPPED

    def halt(self, reason: object) -> bool:
        """Terminal, from any state but itself; the first reason stays."""
        with self.lock:
            if self.state == HALTED:
                return False
            self.state, self.ready_state = HALTED, HALTED
            if self.halt_reason is None:
                self.halt_reason = reason
            return True


@dataclass
class Circuit:
    """Replays in passing and whole-batch failures in a row, for one projection."""

    transient: int = 0
    wipeouts: int = 0

    def replay_ms(self) -> int:
        from foldlog.functions.scalars import circuit_delay_ms

        self.transient += 1
        return circuit_delay_ms(self.transient)

    def wiped(self, attempted: int) -> bool:
        """Whether a batch of which nothing but integrity failures came is the end."""
        from foldlog.functions.scalars import WIPEOUT_STREAK

        self.wipeouts += 1
        return attempted > 1 or self.wipeouts >= WIPEOUT_STREAK

    def applied(self) -> None:
        self.transient = self.wipeouts = 0


@dataclass
class Budget:
    """So many restarts in so many seconds."""

    limit: int = 30
    seconds: float = 60.0
    times: list[float] = field(default_factory=list)

    def spend(self, now: float) -> bool:
        self.times = [t for t in self.times if now - t < self.seconds] + [now]
        return len(self.times) <= self.limit
