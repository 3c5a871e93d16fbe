"""The fold behind the block list: candidates in the order of time, in memory only what is in force."""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from typing import TYPE_CHECKING

import pandas as pd

if TYPE_CHECKING:
    from weirflow.operators.context import BlockLimits

SECOND = 1_000_000


class Blocks:
    """Sources in force, oldest first, and the times of the last minute's additions."""

    def __init__(self, limits: BlockLimits):
        self.limits, self.ttl = limits, int(limits.ttl * SECOND)
        self.since: OrderedDict[str, int] = OrderedDict()
        self.added: deque[int] = deque()
        self.ended: list[tuple[str, int, int | None, str]] = []

    def expire(self, now: int) -> None:
        while self.ttl > 0 and self.since:
            source, since = next(iter(self.since.items()))
            if since >= now - self.ttl:
                return
            del self.since[source]
            self.ended.append((source, since, since + self.ttl, "expired"))

    def add(self, source: str, now: int) -> bool:
        """Whether the source is in force after this."""
        self.expire(now)
        if source in self.since:
            return True
        while self.added and self.added[0] < now - 60 * SECOND:
            self.added.popleft()
        full = 0 < self.limits.most <= len(self.since)
        if full and self.ttl <= 0:
            return False
        if full:
            oldest, since = self.since.popitem(last=False)
            self.ended.append((oldest, since, now, "evicted"))
        if 0 < self.limits.per_minute <= len(self.added):
            return False
        self.since[source] = now
        self.added.append(now)
        return True


def fold(batches: Iterator[pd.DataFrame], limits: BlockLimits) -> Iterator[pd.DataFrame]:
    blocks = Blocks(limits)
    names = ["src_ip", "blocked_us", "ended_us", "end"]

    def out() -> pd.DataFrame:
        rows, blocks.ended = blocks.ended, []
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"blocked_us": "int64", "ended_us": "Int64"})

    for batch in batches:
        for source, now in zip(batch["src_ip"].tolist(), batch["ts_us"].tolist()):
            blocks.add(source, now)
        yield out()
    blocks.ended += [(s, t, None, "in force") for s, t in blocks.since.items()]
    yield out()
