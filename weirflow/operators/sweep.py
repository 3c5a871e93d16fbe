"""Exact incremental statistics of a sliding window, for the features that need its histogram or the gaps between its rows."""

from __future__ import annotations

import math
from collections import Counter, deque

import pandas as pd
import pyarrow as pa

EPS = 1e-6
MICRO = 1_000_000


class Histogram:
    """Counts of values, and how many values have each count."""

    def __init__(self):
        self.counts: Counter = Counter()
        self.sizes: Counter = Counter()
        self.n = 0

    def _move(self, value, by: int) -> None:
        old = self.counts[value]
        new = old + by
        if old:
            self.sizes[old] -= 1
            if not self.sizes[old]:
                del self.sizes[old]
        if new:
            self.sizes[new] += 1
            self.counts[value] = new
        else:
            del self.counts[value]
        self.n += by

    def add(self, value) -> None:
        self._move(value, 1)

    def remove(self, value) -> None:
        self._move(value, -1)

    @property
    def distinct(self) -> int:
        return len(self.counts)

    @property
    def most(self) -> int:
        return max(self.sizes, default=0)

    def entropy(self) -> float:
        if not self.n:
            return 0.0
        return -sum(m * (c / self.n) * math.log2(c / self.n + EPS) for c, m in sorted(self.sizes.items()))


class Gaps:
    """Moments of the gaps between neighbours and of neighbouring gaps, in whole microseconds, so that nothing drifts."""

    def __init__(self):
        self.times: deque[int] = deque()
        self.n = self.s = self.q = 0
        self.pairs = self.xy = 0
        self.first_gap = self.last_gap = 0

    def add(self, t: int) -> None:
        if self.times:
            gap = t - self.times[-1]
            if self.n:
                self.xy += self.last_gap * gap
            else:
                self.first_gap = gap
            self.n, self.s, self.q, self.last_gap = self.n + 1, self.s + gap, self.q + gap * gap, gap
        self.times.append(t)

    def remove(self) -> None:
        first = self.times.popleft()
        if self.n:
            gap = self.times[0] - first
            self.n, self.s, self.q = self.n - 1, self.s - gap, self.q - gap * gap
            if self.n:
                self.first_gap = self.times[1] - self.times[0]
                self.xy -= gap * self.first_gap
            else:
                self.first_gap = self.last_gap = 0

    def variation(self) -> float:
        """Standard deviation over mean plus eps, in seconds; 0 without gaps."""
        if not self.n:
            return 0.0
        variance = (self.n * self.q - self.s * self.s) / (self.n * self.n)
        return (math.sqrt(variance) / MICRO) / (self.s / self.n / MICRO + EPS)

    def autocorrelation(self) -> float:
        """Correlation of gaps with the next ones; 0 with fewer than three gaps or where either side hardly varies."""
        if self.n < 3:
            return 0.0
        m = self.n - 1
        sx, sy = self.s - self.last_gap, self.s - self.first_gap
        vx = m * (self.q - self.last_gap**2) - sx * sx
        vy = m * (self.q - self.first_gap**2) - sy * sy
        if math.sqrt(vx) / m / MICRO <= EPS or math.sqrt(vy) / m / MICRO <= EPS:
            return 0.0
        return (m * self.xy - sx * sy) / math.sqrt(vx) / math.sqrt(vy)


class Sweep:
    """A sweep over rows sorted by (key, ts_us, seq): subclasses keep windows of the current key."""

    keys: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    names: tuple[str, ...] = ()

    def __init__(self):
        self.key = None

    def start(self) -> None:
        raise NotImplementedError

    def row(self, ts: int, *values) -> tuple:
        """The features of a row from the rows before it; then the row is taken in."""
        raise NotImplementedError

    def measures(self, keys: list[tuple], columns: list[list]) -> list[tuple]:
        """The features of rows in order, given the values of their keys and of ts_us and what is read."""
        rows = []
        for key, *values in zip(keys, *columns):
            if key != self.key:
                self.key = key
                self.start()
            rows.append(self.row(*values))
        return rows

    def batch(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """An Arrow batch with the features; its own columns are passed on as they are."""
        keys = list(zip(*(batch.column(k).to_pylist() for k in self.keys)))
        rows = self.measures(keys, [batch.column(c).to_pylist() for c in ("ts_us", *self.reads)])
        made = [pa.array([r[k] for r in rows], pa.float64()) for k in range(len(self.names))]
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *self.names])

    def __call__(self, batch: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return batch.reindex(columns=[*batch.columns, *self.names])
        keys = list(zip(*(batch[k].tolist() for k in self.keys)))
        rows = self.measures(keys, [batch[c].tolist() for c in ("ts_us", *self.reads)])
        return pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=list(self.names))], axis=1)


class Active:
    """Rows that began within a span and have not ended: what ends or leaves the span never comes back."""

    def __init__(self, span: int):
        self.span = span
        self.ends: list[int] = []

    def count(self, ts: int) -> int:
        import heapq

        while self.ends and self.ends[0] < ts:
            heapq.heappop(self.ends)
        return len(self.ends)

    def add(self, ts: int, end: int) -> None:
        import heapq

        heapq.heappush(self.ends, min(end, ts + self.span))


def end_us(ts: int, seconds: float) -> int:
    """The last whole microsecond of a row that lasts so long."""
    return ts + math.floor(min(seconds, 1e9) * MICRO + 1e-6)


class BySource(Sweep):
    """Features over 60 and 300 seconds of one source, and of its pairs with destinations."""

    keys = ("src_ip",)
    reads = ("dst_ip", "dst_port", "total_bytes", "duration")
    names = ("h_active_src", "h_dst_distinct", "h_dport_distinct", "h_dst_entropy", "h_dport_entropy", "h_iat_cv_60", "h_mode", "h_pair_distinct", "h_dport_most", "h_dport_most_60", "h_pair_iat_cv", "h_pair_autocorr")

    def __init__(self, short: int = 60 * MICRO, long: int = 300 * MICRO, active: int = 10 * MICRO):
        super().__init__()
        self.short, self.long, self.active_span = short, long, active

    def start(self) -> None:
        self.long_rows, self.short_rows = deque(), deque()
        self.dst, self.dport, self.pair, self.size, self.dport_60 = (Histogram() for _ in range(5))
        self.gaps, self.active = Gaps(), Active(self.active_span)
        self.pairs: dict[str, Gaps] = {}

    def _mode(self) -> int:
        if not self.size.n:
            return 0
        most = self.size.most
        if self.size.sizes[most] == 1:
            return next(v for v, c in self.size.counts.items() if c == most)
        return next(r[3] for r in self.long_rows if self.size.counts[r[3]] == most)

    def _leave(self, ts: int) -> None:
        while self.long_rows and self.long_rows[0][0] < ts - self.long:
            _, d, p, s = self.long_rows.popleft()
            self.dst.remove(d), self.dport.remove(p), self.pair.remove((d, p)), self.size.remove(s)
            self.pairs[d].remove()
            if not self.pairs[d].times:
                del self.pairs[d]
        while self.short_rows and self.short_rows[0][0] < ts - self.short:
            self.dport_60.remove(self.short_rows.popleft()[1])
            self.gaps.remove()

    def row(self, ts, dst, dport, total, duration) -> tuple:
        self._leave(ts)
        own = self.pairs.get(dst)
        out = (self.active.count(ts), self.dst.distinct, self.dport.distinct, self.dst.entropy(), self.dport.entropy(), self.gaps.variation(), self._mode(), self.pair.distinct, self.dport.most, self.dport_60.most)
        out += (own.variation(), own.autocorrelation()) if own else (0.0, 0.0)
        size = int(total // 128)
        self.long_rows.append((ts, dst, dport, size)), self.short_rows.append((ts, dport))
        self.dst.add(dst), self.dport.add(dport), self.pair.add((dst, dport)), self.size.add(size), self.dport_60.add(dport)
        self.gaps.add(ts), self.active.add(ts, end_us(ts, duration)), self.pairs.setdefault(dst, Gaps()).add(ts)
        return out


class ByDestination(Sweep):
    """Features over 10 and 60 seconds of one destination, and the active rows of its ports."""

    keys = ("dst_ip",)
    reads = ("src_ip", "dst_port", "duration")
    names = ("h_active_dst", "h_src_distinct_60", "h_src_distinct_10", "h_src_entropy_60", "h_active_service")

    def __init__(self, short: int = 10 * MICRO, long: int = 60 * MICRO):
        super().__init__()
        self.short, self.long = short, long

    def start(self) -> None:
        self.long_rows, self.short_rows = deque(), deque()
        self.src_60, self.src_10, self.active = Histogram(), Histogram(), Active(self.short)
        self.services: dict[int, Active] = {}

    def row(self, ts, src, dport, duration) -> tuple:
        while self.long_rows and self.long_rows[0][0] < ts - self.long:
            _, s, p = self.long_rows.popleft()
            self.src_60.remove(s)
            # What is active has begun in the short span: a port without such rows is forgotten.
            if p in self.services and not self.services[p].count(ts):
                del self.services[p]
        while self.short_rows and self.short_rows[0][0] < ts - self.short:
            self.src_10.remove(self.short_rows.popleft()[1])
        service = self.services.setdefault(dport, Active(self.short))
        out = (self.active.count(ts), self.src_60.distinct, self.src_10.distinct, self.src_60.entropy(), service.count(ts))
        self.long_rows.append((ts, src, dport)), self.short_rows.append((ts, src))
        end = end_us(ts, duration)
        self.src_60.add(src), self.src_10.add(src), self.active.add(ts, end), service.add(ts, end)
        return out


class Around(Sweep):
    """Counts over the rows of a key in a span up to each row, the row itself included: of all rows, or of the distinct values of a column."""

    def __init__(self, key: str, measures: dict[str, tuple[str | None, int]]):
        super().__init__()
        self.keys, self.names = (key,), tuple(measures)
        self.spans = [span for _, span in measures.values()]
        columns = [column for column, _ in measures.values()]
        self.reads = tuple(dict.fromkeys(c for c in columns if c is not None))
        self.places = [self.reads.index(c) if c is not None else None for c in columns]

    def start(self) -> None:
        self.held = [(deque(), Histogram()) for _ in self.spans]

    def row(self, ts, *values) -> tuple:
        out = []
        for (rows, counts), span, place in zip(self.held, self.spans, self.places):
            while rows and rows[0][0] < ts - span:
                counts.remove(rows.popleft()[1])
            value = None if place is None else values[place]
            rows.append((ts, value)), counts.add(value)
            out.append(counts.n if place is None else counts.distinct)
        return tuple(out)
