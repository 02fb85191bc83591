"""Stateful operators with timers: what has to happen when no further row comes.

Each is a processor of Structured Streaming's ``transformWithState``: states and event-time timers per key. Rows of a micro-batch are taken in the order of their time, and
whatever falls due between two of them is done first; timers do the same once the watermark has passed. So results don't depend on how the stream
is cut into batches, as long as no row is later than the watermark allows. Streams need the state store of ``larkspur.session.stream_session``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspur.session import in_order

_LATE = "10 minutes"


def _frame(**columns: list) -> Iterator[pd.DataFrame]:
    """One frame of plain Python values, if there are any."""
    if next(iter(columns.values())):
        yield pd.DataFrame({k: pd.Series(v, dtype=object) for k, v in columns.items()})


def _applied(stream: DataFrame, keys: list[str], processor: StatefulProcessor, out: str, late: str) -> DataFrame:
    """``processor`` over the rows of a key by (us, event_id); ``ts`` is the event time."""
    rows, processor.ordered = in_order(stream.withWatermark("ts", late), keys, ["us", "event_id"])
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


class _Timed(StatefulProcessor):
    """A key has one timer at most, for what falls due next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def due(self, us: int | None) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if us is not None:
            self.handle.registerTimer(-(-int(us) // 1000))

    def close(self) -> None:
        pass


class Watch:
    """STR-11: whether a camera is up. It goes down with a status that says so, or after ``stale`` microseconds without any; an alert follows once, ``after`` microseconds down,
    and a recovery is only told if the alert was."""

    def __init__(self, stale: int, after: int, state: tuple | None = None) -> None:
        self.stale, self.after = stale, after
        self.online, self.since, self.told, self.seen = state or (True, None, False, None)

    def state(self) -> tuple:
        return self.online, self.since, self.told, self.seen

    def deadline(self) -> int | None:
        if self.online:
            return None if self.seen is None else self.seen + self.stale
        return None if self.told else self.since + self.after

    def advance(self, until: int) -> Iterator[tuple[int, str]]:
        """What falls due up to ``until``."""
        while (at := self.deadline()) is not None and at <= until:
            if self.online:
                self.online, self.since, self.told = False, at, False
                yield at, "down"
            else:
                self.told = True
                yield at, "alert"

    def status(self, us: int, online: bool) -> Iterator[tuple[int, str]]:
        yield from self.advance(us - 1)
        if online:
            if not self.online and self.told:
                yield us, "recovered"
            self.online, self.since, self.told, self.seen = True, None, False, us
        elif self.online:
            self.online, self.since, self.told = False, us, False
            yield us, "down"
        yield from self.advance(us)


class _Watchdog(_Timed):
    def __init__(self, stale: int, after: int) -> None:
        self.stale, self.after = stale, after

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("watch", "online boolean, since long, told boolean, seen long")

    def _keep(self, watch: Watch) -> None:
        self.state.update(watch.state())
        self.due(watch.deadline())

    def _told(self, key: tuple, found: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        return _frame(camera_id=[key[0]] * len(found), us=[us for us, _ in found], change=[c for _, c in found])

    def _watch(self) -> Watch:
        return Watch(self.stale, self.after, tuple(self.state.get()) if self.state.exists() else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watch = self._watch()
        for batch in self.ordered(rows):
            yield from self._told(key, [x for us, online in zip(batch["us"], batch["online"], strict=True) for x in watch.status(int(us), bool(online))])
        self._keep(watch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watch = self._watch()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())  # what follows from it may be due too
        found = list(watch.advance(1000 * now))
        self._keep(watch)
        return self._told(key, found)


def watchdog(stream: DataFrame, stale: float, after: float = 300.0, late: str = _LATE) -> DataFrame:
    """STR-11: (camera_id, us, change) from statuses (camera_id, ts, us, event_id, online): down, alert and recovered, each at its own time, silent cameras included."""
    return _applied(stream, ["camera_id"], _Watchdog(int(stale * 1e6), int(after * 1e6)), "camera_id string, us long, change string", late)


class _Confirm(_Timed):
    def __init__(self, n: int, window: int) -> None:
        self.n, self.window = n, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.hits = handle.getListState("hits", "us long")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hits = [h[0] for h in self.hits.get()] if self.hits.exists() else []
        done = bool(self.done.get()[0]) if self.done.exists() else False
        for batch in self.ordered(rows):
            fired = []
            for us, event_id in zip(batch["us"].tolist(), batch["event_id"].tolist(), strict=True):
                if hits and done and us - hits[-1] > 2 * self.window:
                    hits, done = [], False
                hits = [h for h in [*hits, us] if us - h <= self.window][-self.n :]
                if len(hits) >= self.n and not done:
                    done = True
                    fired.append(event_id)
            yield from _frame(camera_id=[key[0]] * len(fired), label=[key[1]] * len(fired), event_id=fired)
        self.hits.put([(h,) for h in hits])
        self.done.update((done,))
        self.due(hits[-1] + 2 * self.window + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """After twice the window without a hit the next one starts anew, so nothing needs to be known."""
        self.hits.clear()
        self.done.clear()
        return iter([])


def confirm(stream: DataFrame, n: int = 3, window: float = 5.0, late: str = _LATE) -> DataFrame:
    """STR-1: first hit of n within the window per camera and label (camera_id, label, ts, us, event_id); re-armed after twice the window of silence, when the key's state goes."""
    return _applied(stream, ["camera_id", "label"], _Confirm(n, int(window * 1e6)), "camera_id string, label string, event_id long", late)


class _Gates(_Timed):
    """STR-17: see ``gate_chain``."""

    def __init__(self, rate: int, cooldowns: dict[str, int]) -> None:
        self.rate, self.cooldowns = rate, cooldowns

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.camera = handle.getValueState("camera", "us long")
        self.labels = handle.getMapState("labels", "label string", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        camera = self.camera.get()[0] if self.camera.exists() else None
        before = {k[0]: v[0] for k, v in self.labels.iterator()} if self.labels.exists() else {}
        labels = dict(before)
        for batch in self.ordered(rows):
            reasons = []
            for us, label, early, late in zip(batch["us"].tolist(), batch["label"].tolist(), batch["early"].tolist(), batch["late"].tolist(), strict=True):
                reason = early or None
                if not reason and camera is not None and us - camera < self.rate:
                    reason = "rate_limited"
                if not reason and label in labels and us - labels[label] < self.cooldowns.get(label, 0):
                    reason = "cooling_down"
                reason = reason or late or None
                if not reason:
                    camera = labels[label] = us
                reasons.append(reason)
            yield from _frame(event_id=batch["event_id"].tolist(), reason=reasons)
        if camera is not None:
            self.camera.update((camera,))
        for label, us in labels.items():
            if before.get(label) != us:
                self.labels.updateValue((label,), (us,))
        self.due(self._end(camera, labels))

    def _end(self, camera: int | None, labels: dict[str, int]) -> int | None:
        """When no anchor of the camera can stop anything any more."""
        return max([*([camera + self.rate] if camera is not None else []), *(us + self.cooldowns.get(k, 0) for k, us in labels.items())], default=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.camera.clear()
        self.labels.clear()
        return iter([])


def gate_chain(stream: DataFrame, rate: float, cooldowns: dict[str, float], late: str = _LATE) -> DataFrame:
    """STR-17: (event_id, reason): the first gate that stops each event, null if it is told.

    ``early`` is the reason of the stateless gates before the rate limit (see ``streaming.events.skip_reason``), ``late`` that of those after the cooldown, both null
    if none stops it. A camera's rate limit and the cooldown of its labels count from the last event that passed the *whole* chain. Once all of them are over, the camera's state goes.
    """
    us = {k: int(v * 1e6) for k, v in cooldowns.items()}
    rows = stream.select("camera_id", "ts", "us", "event_id", "label", F.coalesce("early", F.lit("")).alias("early"), F.coalesce("late", F.lit("")).alias("late"))
    return _applied(rows, ["camera_id"], _Gates(int(rate * 1e6), us), "event_id long, reason string", late)
