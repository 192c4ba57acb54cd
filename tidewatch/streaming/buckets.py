"""Sessions of a stream dealt to buckets: a keyed state holds what is kept of all sessions of a bucket, column by column.

Spark hands a Python processor one key at a time, and each look at its state is a call between two processes. A bucket takes the
samples of all its sessions in one go, with one read and one write.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

#: Part of the state's layout: a checkpoint goes on only with the number that it began with. A micro-batch writes the entries of
#: all sessions of the buckets that it touches; some hundreds in each cost less than the calls do.
BUCKETS = 512


def bucket_of(session: Column) -> Column:
    return F.pmod(F.xxhash64(session), F.lit(BUCKETS)).cast("int")


class Entries:
    """A state variable with an entry (a tuple in the order of ``columns``) per session of the bucket."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, columns: str):
        kinds = (c.rsplit(" ", 1) for c in columns.split(", "))
        self.value = handle.getValueState(name, "session array<string>, " + ", ".join(f"{n} array<{kind}>" for n, kind in kinds))

    def read(self) -> dict[str, tuple]:
        kept = self.value.get()
        return {session: tuple(entry) for session, *entry in zip(*kept, strict=True)} if kept else {}

    def write(self, entries: dict[str, tuple]) -> None:
        if entries:
            self.value.update((list(entries), *map(list, zip(*entries.values(), strict=True))))
        else:
            self.value.clear()


def move_timer(handle: StatefulProcessorHandle, before: Iterable[int], after: Iterable[int], rung: bool = False) -> None:
    """A bucket has one timer, at the first of the times that its sessions wait for; Spark drops one that has rung."""
    was, now = min(before, default=None), min(after, default=None)
    if was == now:
        return
    if was is not None and not rung:
        handle.deleteTimer(was)
    if now is not None:
        handle.registerTimer(now)


def rung_at(timerValues, expiredTimerInfo) -> int:
    """What sessions have waited for up to this time is due."""
    return max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
