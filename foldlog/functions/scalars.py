"""Scalar rules as columns and, where the driver needs them, as plain functions of the same name."""

from __future__ import annotations

import random
import re
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Delays of the transient circuit in milliseconds, then its ceiling.
CIRCUIT_DELAYS, CIRCUIT_CEILING = (0, 100, 500, 1000, 5000, 15000), 30000
#: Delays between attempts to subscribe; later ones hold, then jitter sets in.
SUBSCRIBE_DELAYS, SUBSCRIBE_HOLD, SUBSCRIBE_LATE = (50, 100, 200, 400, 800), 1000, 60000
SUBSCRIBE_HOLD_UNTIL, SUBSCRIBE_JITTER = 35, 5000
#: Attempts and waits of the default retry.
RETRY_ATTEMPTS, RETRY_BACKOFF = 3, (100, 1000, 10000)
WIPEOUT_STREAK = 3


def partition_of(stream_id: Column, n: int) -> Column:
    """The processing partition of a stream, 0 to n - 1; a function of the id alone."""
    _positive(n)
    return F.pmod(F.xxhash64(stream_id.cast("string")), F.lit(n)).cast("int")


def portable_partition_of(stream_id: Column, n: int) -> Column:
    """The same by a digest that other SQL engines have too."""
    _positive(n)
    return F.conv(F.substring(F.md5(stream_id.cast("string")), 1, 8), 16, 10).cast("bigint") % n


def _positive(n: int) -> None:
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise ValueError("the number of partitions has to be a positive integer")


def _curve(n: Column, delays: tuple[int, ...], beyond: Column | int) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, delays)), n.cast("int")), beyond if isinstance(beyond, Column) else F.lit(beyond))


def circuit_delay(n: Column) -> Column:
    """Milliseconds before replay number n (from 1) of a batch that failed in passing."""
    return _curve(n, CIRCUIT_DELAYS, CIRCUIT_CEILING)


def circuit_delay_ms(n: int) -> int:
    return CIRCUIT_DELAYS[n - 1] if n <= len(CIRCUIT_DELAYS) else CIRCUIT_CEILING


def subscribe_delay(n: Column) -> Column:
    """Milliseconds before attempt n + 1, without jitter."""
    return _curve(n, SUBSCRIBE_DELAYS, F.when(n <= SUBSCRIBE_HOLD_UNTIL, SUBSCRIBE_HOLD).otherwise(SUBSCRIBE_LATE))


def subscribe_delay_ms(n: int) -> int:
    if n <= len(SUBSCRIBE_DELAYS):
        return SUBSCRIBE_DELAYS[n - 1]
    return SUBSCRIBE_HOLD if n <= SUBSCRIBE_HOLD_UNTIL else SUBSCRIBE_LATE + random.randint(1, SUBSCRIBE_JITTER)


def retry_wait(attempt: Column, attempts: int = RETRY_ATTEMPTS, backoff: tuple[int, ...] = RETRY_BACKOFF) -> Column:
    """Milliseconds between attempt and the next; null after the last."""
    return F.when(attempt < attempts, F.try_element_at(F.array(*map(F.lit, backoff)), attempt.cast("int")))


def lag_ms(occurred_at: Column, now: Column) -> Column:
    """The age of an event in whole milliseconds, never negative; null without an event."""
    return F.when(occurred_at.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.expr("0") + F.floor((F.unix_micros(now) - F.unix_micros(occurred_at)) / 1000).cast("bigint")))


def failure_class(state: Column) -> Column:
    """integrity, transient or structural, by SQLSTATE. No SQLSTATE counts as transient: a connection's failure."""
    group = F.substring(state, 1, 2)
    return (
        F.when(state.isNull(), "transient").when(state == "57P04", "structural").when(state.isin("40001", "40P01", "25006"), "transient")
        .when(group.isin("22", "23"), "integrity").when(group.isin("08", "53", "57"), "transient").otherwise("structural")
    )


def version_suffix_warning(name: str) -> None:
    found = re.fullmatch(r"(.*)_v\d+", name)
    if found:
        warnings.warn(f"the name {name!r} ends in a version; declare version= and call the projection {found[1]!r}", stacklevel=3)
