"""Gap filling, on/off states and corrected buckets on a stream, one state per series.

State is small whatever a series' length: open buckets, the last known value and the rows that later ones
may still change. Buckets close by event-time timers, once the watermark has passed them, so order and
lateness of readings within the watermark's delay do not matter; readings later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor


@dataclass(frozen=True)
class SeriesRules:
    """What the batch operators do with the same numbers; steps are buckets of `every` seconds."""

    every: int = 10
    long_gap: int = 12
    fill: int = 6
    low: float = 5.0
    high: float = 1e9
    min_on: int = 1
    min_off: int = 0
    min_activation: int = 0

    @property
    def least(self) -> int:
        return max(self.min_on, self.min_activation, 1)

    @property
    def settled(self) -> int | None:
        """Steps after the last reading beyond which nothing that comes can change a row: the gap is long, and off. None: a gap may be on."""
        return None if self.low <= 0 <= self.high else max(self.long_gap, self.min_off, self.fill) + 1


class Series:
    """One series: buckets in order come in, rows (k, x, raw, status) leave once they are final."""

    def __init__(self, rules: SeriesRules, last: int | None = None, value: float | None = None, on: int = 0, gap: int = 0, held: list[tuple] = ()):
        self.rules, self.last, self.value = rules, last, value
        self.on, self.gap = on, gap  # steps of the on run so far, with gaps within it, and of the off gap after it
        self.held = list(held)  # (k, x, raw) of rows that are not final: a run that is too short, and the gap
        self.done: list[tuple] = []

    def add(self, k: int, x: float) -> None:
        """The next bucket with a value; those between are missing."""
        if self.last is not None:
            n = k - self.last - 1
            for i in range(1, n + 1):
                self._row(self.last + i, 0.0 if n > self.rules.long_gap else self.value if i <= self.rules.fill else None)
        self.last, self.value = k, x
        self._row(k, x)

    def _row(self, k: int, x: float | None) -> None:
        raw = int(x is not None and self.rules.low <= x <= self.rules.high)
        self.held.append((k, x, raw))
        if raw:
            self.on, self.gap = self.on + self.gap + 1, 0
            if self.on >= self.rules.least:
                self._leave(len(self.held), 1)
        elif not self.on:
            self._leave(1, 0)
        else:
            self.gap += 1
            if self.gap > self.rules.min_off:
                self.settle()

    def settle(self) -> None:
        """The run is over, as at the end of a series."""
        if self.on:
            self._leave(len(self.held) - self.gap, int(self.on >= self.rules.least))
            self._leave(self.gap, 0)
        self.on = self.gap = 0

    def _leave(self, n: int, status: int) -> None:
        self.done += ((k, x, raw, status) for k, x, raw in self.held[:n])
        del self.held[:n]


class _States(StatefulProcessor):
    def __init__(self, rules: SeriesRules, keys: list[str]):
        self.rules, self.keys = rules, keys

    def init(self, handle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "k bigint", "total double, n bigint")
        self.series = handle.getValueState("series", "last bigint, value double, steps_on bigint, gap bigint, ks array<bigint>, xs array<double>, raws array<int>")
        self.timer = handle.getValueState("timer", "at bigint")

    def _set_timer(self, at: int) -> None:
        if self.timer.exists():
            before = self.timer.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = self.series.get()[0] if self.series.exists() else None
        mark, sums = timerValues.getCurrentWatermarkInMs(), {}
        for frame in rows:
            for k, x in zip((frame["second"] // self.rules.every).tolist(), frame["watts"].tolist(), strict=True):
                if x == x and (closed is None or k > closed) and (k + 1) * self.rules.every * 1000 > mark:
                    total, n = sums.get(k, (0.0, 0))
                    sums[k] = total + x, n + 1
        for k, (total, n) in sums.items():
            if self.buckets.containsKey((k,)):
                before = self.buckets.getValue((k,))
                total, n = total + before[0], n + before[1]
            self.buckets.updateValue((k,), (total, n))
        if sums:
            self._set_timer((min(sums) + 1) * self.rules.every * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        mark, width = timerValues.getCurrentWatermarkInMs(), self.rules.every * 1000
        open_ = sorted((k[0], v[0], v[1]) for k, v in self.buckets.iterator())
        series = Series(self.rules)
        if self.series.exists():
            last, value, on, gap, ks, xs, raws = self.series.get()
            series = Series(self.rules, last, value, on, gap, list(zip(ks, xs, raws, strict=True)))
        ready = [b for b in open_ if (b[0] + 1) * width <= mark]
        for k, total, n in ready:
            series.add(k, total / n)
            self.buckets.removeKey((k,))
        rest = open_[len(ready) :]
        reach = self.rules.settled
        limit = None if series.last is None or reach is None else (series.last + 1 + reach) * width
        # the next reading, if there is one, begins beyond the limit
        if limit is not None and limit <= mark and (not rest or rest[0][0] > series.last + reach):
            series.settle()
        if series.last is not None:
            ks, xs, raws = zip(*series.held, strict=True) if series.held else ((), (), ())
            self.series.update((series.last, series.value, series.on, series.gap, list(ks), list(xs), list(raws)))
        later = [(rest[0][0] + 1) * width] if rest else []
        if limit is not None and series.held:
            later.append(limit)
        if later:
            self._set_timer(max(min(later), mark + 1))
        if series.done:
            made = pd.DataFrame(series.done, columns=["k", "x", "raw", "status"])
            for name, value in zip(reversed(self.keys), reversed(key), strict=True):
                made.insert(0, name, value)
            yield made.astype({"x": float})

    def close(self) -> None:
        pass


def states(stream: DataFrame, keys: list[str], rules: SeriesRules, late: str = "1 minute", ts: str = "ts", value: str = "watts") -> DataFrame:
    """keys, k, x, raw, status: regularise.fill_long_gaps_zero, forward_fill and status.status on a stream of readings.

    A row leaves once no later reading can change it: a bucket when the watermark has passed it, a short on
    run when it is long enough or its off gap exceeds min_off, the end of a series when it has been
    silent for longer than any rule reaches. Buckets without readings leave with the next reading, as the batch
    has them only up to the last one. Null and NaN readings are left out. Needs the RocksDB state store.
    """
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    rows = stream.withWatermark(ts, late).selectExpr(*(f"`{k}`" for k in keys), f"`{ts}`", f"unix_seconds(cast(`{ts}` as timestamp)) as second", f"cast(`{value}` as double) as watts").where("watts is not null")
    return rows.groupBy(*keys).transformWithStateInPandas(_States(rules, keys), f"{kinds}, k long, x double, raw int, status int", "append", "eventTime")


class _Corrected(StatefulProcessor):
    def __init__(self, keys: list[str], every: int):
        self.keys, self.every = keys, every

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "id string", "k bigint")
        self.buckets = handle.getMapState("buckets", "k bigint", "total double, n bigint, revision int")
        self.timer = handle.getValueState("timer", "at bigint")

    def _ends(self, k: int) -> int:
        """The watermark at which a bucket is closed for good."""
        return (k + 1) * self.every * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mark, touched, ids = timerValues.getCurrentWatermarkInMs(), {}, {}
        for frame in rows:
            for i, second, x in zip(frame["id"].tolist(), frame["second"].tolist(), frame["watts"].tolist(), strict=True):
                k = second // self.every
                if self._ends(k) <= mark or i in ids or self.seen.containsKey((i,)):
                    continue
                ids[i] = k
                total, n = touched.get(k, (0.0, 0))
                touched[k] = total + x, n + 1
        for i, k in ids.items():
            self.seen.updateValue((i,), (k,))
        out = []
        for k, (total, n) in sorted(touched.items()):
            revision = 1
            if self.buckets.containsKey((k,)):
                before = self.buckets.getValue((k,))
                total, n, revision = total + before[0], n + before[1], before[2] + 1
            self.buckets.updateValue((k,), (total, n, revision))
            out.append((*key, k, total / n, n, revision))
        if touched:
            self._wait(self._ends(min(touched)))
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "k", "x", "readings", "revision"])

    def _wait(self, at: int) -> None:
        if self.timer.exists():
            before = self.timer.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.timer.update((at,))
        self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        mark = timerValues.getCurrentWatermarkInMs()
        for i in [k[0] for k, v in self.seen.iterator() if self._ends(v[0]) <= mark]:
            self.seen.removeKey((i,))
        open_ = [k[0] for k, _ in self.buckets.iterator()]
        for k in open_:
            if self._ends(k) <= mark:
                self.buckets.removeKey((k,))
        rest = [k for k in open_ if self._ends(k) > mark]
        if rest:
            self._wait(self._ends(min(rest)))
        return iter(())

    def close(self) -> None:
        pass


def corrected_means(stream: DataFrame, keys: list[str], id_col: str, every: int = 10, late: str = "10 minutes", ts: str = "ts", value: str = "watts") -> DataFrame:
    """keys, k, x, readings, revision: the mean of a bucket as soon as it has readings, and again, with a higher revision, as often as later ones change it.

    A reading that repeats an id changes nothing while its bucket is open. A bucket is open until the
    watermark, `late` behind the newest reading, has passed its end; later readings are dropped, and its
    state with its ids goes. A reader takes the row with the highest revision for each (keys, k). Rows with
    a null id or value, or NaN, are left out. Needs the RocksDB state store.
    """
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    rows = stream.withWatermark(ts, late)
    rows = rows.selectExpr(*(f"`{k}`" for k in keys), f"`{ts}`", f"cast(`{id_col}` as string) as id", f"unix_seconds(cast(`{ts}` as timestamp)) as second", f"cast(`{value}` as double) as watts")
    rows = rows.where("id is not null and watts is not null and not isnan(watts)")
    return rows.groupBy(*keys).transformWithStateInPandas(_Corrected(keys, every), f"{kinds}, k long, x double, readings long, revision int", "append", "eventTime")
