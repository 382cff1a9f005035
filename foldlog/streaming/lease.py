"""One writer per checkpoint: numbered lease files, each made so that one writer only succeeds; losers stand by."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

from foldlog.functions.scalars import subscribe_delay_ms
from foldlog.streaming import files
from foldlog.telemetry import bus


class Lease:
    """The holder is named in the file of the highest number below ``<folder>/lease``.

    Taking, renewing and releasing each create the next number, so of two writers that saw the same holder one fails
    and nobody deletes a fresh lease. A lease that was not renewed for ``seconds`` may be taken over.
    """

    def __init__(self, spark: SparkSession, folder: str, seconds: float = 30.0):
        self.spark, self.folder, self.seconds, self.owner = spark, f"{folder.rstrip('/')}/lease", seconds, uuid.uuid4().hex
        self.renewed = 0.0

    def _newest(self) -> tuple[int, str | None, float]:
        """Number, holder and time of the newest lease; number 0 if there never was one, no holder if released."""
        found = [int(n) for n in files.names(self.spark, self.folder) if n.isdigit()]
        if not found:
            return 0, None, 0.0
        text = files.read(self.spark, f"{self.folder}/{max(found):012d}")
        if text is None:  # gone meanwhile, so a newer one is there
            return self._newest()
        owner, when = text.split()
        return max(found), None if owner == "-" else owner, float(when)

    def holder(self) -> tuple[str, float] | None:
        """Who holds it, and when it was renewed."""
        _, owner, when = self._newest()
        return None if owner is None else (owner, when)

    def _next(self, number: int, owner: str) -> bool:
        now = time.time()
        if not files.create(self.spark, f"{self.folder}/{number + 1:012d}", f"{owner} {now}"):
            return False
        for n in files.names(self.spark, self.folder):
            if n.isdigit() and int(n) <= number:
                files.remove(self.spark, f"{self.folder}/{n}")
        self.renewed = now if owner == self.owner else 0.0
        return True

    def take(self) -> bool:
        number, owner, when = self._newest()
        if owner not in (None, self.owner) and time.time() - when < self.seconds:
            return False
        return self._next(number, self.owner)

    def renew(self) -> bool:
        """False if another writer has it now, or had it."""
        number, owner, _ = self._newest()
        return owner == self.owner and self._next(number, self.owner)

    def held(self) -> bool:
        """Whether it was renewed so lately that nobody may have taken it over."""
        return time.time() - self.renewed < self.seconds

    def release(self) -> None:
        number, owner, _ = self._newest()
        if owner == self.owner:
            self._next(number, "-")
        self.renewed = 0.0

    def wait(self, name: str, most: int | None = None, sleep=time.sleep, given_up=lambda: False) -> int:
        """Stand by until the lease is ours; the number of attempts, 0 if given up before."""
        attempt = 1
        while not self.take():
            if given_up():
                return 0
            if most and attempt >= most:
                raise TimeoutError(f"{name} is held by another writer")
            delay = subscribe_delay_ms(attempt)
            bus.emit("source.standby", {"attempt": attempt, "retry_in_ms": delay}, subscription=name, reason="held by another writer")
            sleep(delay / 1000)
            attempt += 1
        bus.emit("source.subscribed", {"attempts": attempt}, subscription=name)
        return attempt
