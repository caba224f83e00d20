"""Keyed state of the streams: typed value and list state per key, event-time timers, one vectorised step a micro-batch.

A step gets the state of a key and its rows of a micro-batch in order, as columns, and returns the new state and what comes out. Rows of
one key are held in memory for one micro-batch, whose size the source bounds (``maxFilesPerTrigger`` and the like).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

Step = Callable[[tuple | None, pd.DataFrame], tuple[tuple | None, pd.DataFrame | None]]
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ordered(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    frame = pd.concat(list(frames), ignore_index=True)
    if len(frame) > 1:  # the further columns cost more than the first, and count only where that has ties
        frame = frame.sort_values(order[:1] if frame[order[0]].is_unique else order, kind="stable", ignore_index=True)
    return frame


def _with_keys(names: list[str], key: tuple, out: pd.DataFrame) -> pd.DataFrame:
    """``out`` with the key's columns before it."""
    for at, (name, value) in enumerate(zip(names, key)):
        out.insert(at, name, [value] * len(out))
    return out


class Fold(StatefulProcessor):
    """One value of the types ``state`` per key, folded with ``step``. With ``idle_ms`` and a watermark the state goes when that much time has
    passed after the key's last row (a step that looks no further back loses nothing)."""

    def __init__(self, keys: list[str], state: str, step: Step, order: list[str], idle_ms: int | None = None):
        self.keys, self.state, self.step, self.order, self.idle_ms = keys, state, step, order, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.value.get()) if self.value.exists() else None
        frame = _ordered(rows, self.order)
        value, out = self.step(held, frame)
        if value is not None:
            self.value.update(value)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(frame["ts_ms"].iloc[-1]) + self.idle_ms)
        if out is not None and len(out):
            yield _with_keys(self.keys, key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter([])

    def close(self) -> None:
        pass


class Recent(Fold):
    """A value and the times of the last ``keep`` time units before the key's last row (a list). ``step`` gets the list as a third argument."""

    def __init__(self, keys: list[str], state: str, step: Callable, time: str, keep: int):
        super().__init__(keys, state, step, [time])
        self.time, self.keep = time, keep

    def init(self, handle) -> None:
        super().init(handle)
        self.times = handle.getListState("times", "t long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.value.get()) if self.value.exists() else None
        before = np.array([t for (t,) in self.times.get()], np.int64) if self.times.exists() else np.zeros(0, np.int64)
        frame = _ordered(rows, self.order)
        value, out = self.step(held, frame, before)
        every = np.sort(np.concatenate([before, frame[self.time].to_numpy(np.int64)]))
        self.times.put([(int(t),) for t in every[every >= every[-1] - self.keep]])
        if value is not None:
            self.value.update(value)
        if out is not None and len(out):
            yield _with_keys(self.keys, key, out)


class Silence(StatefulProcessor):
    """Tells a key whose rows stop for more than ``silence_ms``, once until its next row: (last_ms)."""

    def __init__(self, keys: list[str], silence_ms: int):
        self.keys, self.silence_ms = keys, silence_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("last", "last_ms long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([f["ts_ms"].to_numpy(np.int64) for f in rows]))
        last, told = tuple(self.value.get()) if self.value.exists() else (None, False)
        every = times if last is None else np.sort(np.append(times, last))
        ends = every[:-1][np.diff(every) > self.silence_ms]
        ends = ends[ends != last] if told else ends
        newest = int(every[-1])
        self.value.update((newest, told and newest == last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not (told and newest == last):
            self.handle.registerTimer(newest + self.silence_ms)
        if len(ends):
            yield _with_keys(self.keys, key, pd.DataFrame({"last_ms": ends}))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.value.get()
        if not told:
            self.value.update((last, True))
            yield _with_keys(self.keys, key, pd.DataFrame({"last_ms": [last]}))

    def close(self) -> None:
        pass


class TraceBuffer(StatefulProcessor):
    """The open spans of many traces: a key is a bucket of trace ids, so a micro-batch costs a call a bucket and not one a trace. State is a
    list of (trace, time, span), written anew with each call, and one timer, that of the trace that is due first."""

    def __init__(self, keys: list[str], timeout_ms: int):
        self.keys, self.timeout_ms = keys, timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.spans = handle.getListState("spans", "trace_id string, ts_ms long, span string")

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.spans.get()) if self.spans.exists() else [], columns=["trace_id", "ts_ms", "span"])

    def _turn(self, key, frame: pd.DataFrame, watermark: int | None) -> Iterator[pd.DataFrame]:
        """Cut the spans of each trace, in order, where one comes ``timeout_ms`` after the first of its buffer. The last buffer of a trace stays
        open, unless the watermark has come to its end."""
        traces, times, spans = frame["trace_id"].tolist(), frame["ts_ms"].tolist(), frame["span"].tolist()
        starts = []
        for at, (trace, time) in enumerate(zip(traces, times)):
            if not starts or trace != traces[starts[-1]] or time >= times[starts[-1]] + self.timeout_ms:
                starts.append(at)
        out, kept, due = [], [], None
        for at, until in zip(starts, [*starts[1:], len(traces)]):
            ends = times[at] + self.timeout_ms
            last = until == len(traces) or traces[until] != traces[at]
            if last and (watermark is None or ends > watermark):
                kept += zip(traces[at:until], times[at:until], spans[at:until])
                due = ends if due is None else min(due, ends)
            else:
                out.append((traces[at], times[at], f"[{','.join(spans[at:until])}]"))
        if kept:
            self.spans.put(kept)
        else:
            self.spans.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due is not None:
            self.handle.registerTimer(due)
        if out:
            yield _with_keys(self.keys, key, pd.DataFrame(out, columns=["trace_id", "first_ms", "spans"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [f[["trace_id", "ts_ms", "span"]] for f in rows]
        held = self._held()
        yield from self._turn(key, _ordered(iter([held, *new] if len(held) else new), ["trace_id", "ts_ms", "span"]), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, keys: list[str], processor: StatefulProcessor, output: str, event_time: bool = False) -> DataFrame:
    """``rows`` through ``processor`` by key; output columns are the keys and then those of ``output``. Typed state is kept by the RocksDB store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    told = ", ".join(f"`{k}` {fields[k]}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, f"{told}, {output}", "append", "EventTime" if event_time else "None")


# ---- steps


def dedup_step(ttl_ms: int, names: list[str]) -> Step:
    """Let an event pass if none of its key passed within ``ttl_ms`` before it."""

    def step(value, rows):
        times, passed = rows["ts_ms"].to_numpy(np.int64), []
        last = value[0] if value else None
        at = 0 if last is None else int(np.searchsorted(times, last + ttl_ms))
        while at < len(times):
            passed.append(at)
            last = int(times[at])
            at = max(at + 1, int(np.searchsorted(times, last + ttl_ms)))
        return (last,), rows.iloc[passed][names].reset_index(drop=True)

    return step


def throughput_step(window_ms: int, drop: float = 0.5, learn: int = 20, rearm: float = 0.75) -> Callable:
    """Arrivals of a key: fire once when their rate over the window is under ``drop`` of the learned one."""

    def step(value, rows, before):
        n, base, down = value or (0, 0.0, False)
        times = rows["ts_ms"].to_numpy(np.int64)
        every = np.concatenate([before, times])
        rates = (np.arange(len(before), len(every)) + 1 - np.searchsorted(every, times - window_ms)) / (window_ms / 60_000)
        out = []
        for ts, rate in zip(times.tolist(), rates.tolist()):  # each learned rate follows from the one before
            if n < learn:
                base = rate if n == 0 else 0.9 * base + 0.1 * rate
            elif rate / max(base, 1e-9) < drop and not down:
                down = True
                out.append((ts, rate, base))
            elif rate / max(base, 1e-9) >= rearm:
                down, base = False, 0.95 * base + 0.05 * rate
            n += 1
        return (n, base, down), pd.DataFrame(out, columns=["ts_ms", "rate", "base"])

    return step


def spike_step(window: int, times_base: float = 5.0, least: int = 10, minute: int = 60_000_000, time: str = "ts_us") -> Callable:
    """Events of a signature: the base rate is frozen once ``least`` events lie in twice the window, as that of their older half over the
    time that it spans (two events at least, not all at once); from that event on those fire whose rate over the window is ``times_base`` of it."""

    def step(value, rows, before):
        base = value[0] if value else None
        times = rows[time].to_numpy(np.int64)
        every = np.concatenate([before, times])
        ends = np.arange(len(before), len(every)) + 1
        per_min = (ends - np.searchsorted(every, times - window, side="right")) / (window / minute)
        from_ = 0
        if base is None:
            starts = np.searchsorted(every, times - 2 * window, side="right")
            half = (ends - starts) // 2
            spans = every[np.maximum(starts + half - 1, starts)] - every[starts]
            ready = np.flatnonzero((ends - starts >= least) & (half >= 2) & (spans > 0))
            if not len(ready):
                return None, None
            from_ = int(ready[0])
            base = float(half[from_] / (spans[from_] / minute))
        hit = from_ + np.flatnonzero(per_min[from_:] >= base * times_base)
        return (base,), pd.DataFrame({time: times[hit], "per_min": per_min[hit], "base": base})

    return step


def learn_step(n: int) -> Step:
    """Count, mean and sum of squared deviations of the first ``n`` samples; later ones come out with them."""

    def step(value, rows):
        count, mean, squares = value or (0, 0.0, 0.0)
        values = rows["value"].to_numpy(float)
        part, rest = values[: max(0, n - count)], rows.iloc[max(0, n - count) :]
        if len(part):
            own, total = part.mean(), count + len(part)
            squares += ((part - own) ** 2).sum() + (own - mean) ** 2 * count * len(part) / total
            mean += (own - mean) * len(part) / total
            count = total
        out = pd.DataFrame({"ts_ms": rest["ts_ms"], "value": rest["value"], "mean": mean, "std": (squares / count) ** 0.5})
        return (count, float(mean), float(squares)), out.reset_index(drop=True)

    return step


def promotion_step(threshold: int, warmup_until_ms: int | None = None) -> Step:
    """Promotes at the ``threshold``-th detection, or at the first one if that comes before ``warmup_until_ms``; once."""

    def step(value, rows):
        n, times = value[0] if value else 0, rows["ts_ms"].to_numpy(np.int64)
        if n == 0 and warmup_until_ms is not None and times[0] < warmup_until_ms:
            return (len(times) + threshold,), pd.DataFrame({"ts_ms": times[:1], "detections": [1]})
        at = threshold - n - 1
        out = pd.DataFrame({"ts_ms": times[at : at + 1], "detections": threshold}) if 0 <= at < len(times) else None
        return (n + len(times),), out

    return step


def drift_step(value, rows):
    """"drift" when it begins, "restored" when it ends."""
    flags = rows["drifting"].to_numpy(bool)
    at = np.flatnonzero(flags != np.r_[value[0] if value else False, flags[:-1]])
    change = np.where(flags[at], "drift", "restored")
    return (bool(flags[-1]),), pd.DataFrame({"ts_ms": rows["ts_ms"].to_numpy(np.int64)[at], "change": change})
