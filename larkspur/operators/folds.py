"""Ordered folds whose reference moves only on acceptance, which no window function says.

A key's rows arrive sorted by Spark and stream through a small Python step in Arrow batches, so a key of any length needs
one state, not its rows, in memory. Keys are dealt out by hash; a key's own order is the operator's meaning and isn't split.

Every fold also takes a stream: the state of a key is then kept between micro-batches, whose rows are taken in order.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.session import in_order

Step = Callable[[Any, dict], tuple[Any, Any]]


def ordered_fold(rows: DataFrame, keys: list[str], order: str, used: list[str], step: Step, out: str) -> DataFrame:
    """Add the column ``out`` ("name type"): step(state, row) -> (state, value), from state None at each key's first row.

    Rows of one place in the order go by their event_id, if there is one.
    """
    columns, name = rows.columns, out.split()[0]
    at, need = [columns.index(k) for k in keys], list(dict.fromkeys([order, *used]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            ids = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True))
            values = [batch.column(columns.index(c)).to_pylist() for c in need]
            found = []
            for key, *row in zip(ids, *values, strict=True):
                if key != last:
                    last, state = key, None
                state, value = step(state, dict(zip(need, row, strict=True)))
                found.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _TYPES[out.split()[1]])], names=[*batch.schema.names, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), out])
    if rows.isStreaming:
        return _live_fold(rows, keys, order, need, step, name, schema)
    return rows.repartition(*keys).sortWithinPartitions(*keys, order, *_ties(columns)).mapInArrow(run, schema)


def _ties(columns: list[str]) -> list[str]:
    return [c for c in ("event_id",) if c in columns]


def _plain(values: pd.Series) -> list:
    """Python values of a column; missing ones (and NaN, which pandas doesn't tell from them) are None."""
    return [v if isinstance(v, (list, np.ndarray)) else None if pd.isna(v) else v for v in values.tolist()]


def _live_fold(rows: DataFrame, keys: list[str], order: str, need: list[str], step: Step, name: str, schema: str) -> DataFrame:
    """The fold over a stream; a key's state is what ``step`` returned last."""
    rows, ordered = in_order(rows, keys, [order, *_ties(rows.columns)])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = pickle.loads(state.get[0]) if state.exists else None  # noqa: S301  our own state
        for batch in ordered(parts):
            found = []
            for row in zip(*(_plain(batch[c]) for c in need), strict=True):
                now, value = step(now, dict(zip(need, row, strict=True)))
                found.append(value)
            yield batch.assign(**{name: pd.Series(found, index=batch.index, dtype=object)})
        state.update((pickle.dumps(now),))

    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


_TYPES = {"array<long>": pa.list_(pa.int64()), "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def cooldown(rows: DataFrame, keys: list[str], at_us: str, seconds: float) -> DataFrame:
    """STR-3/4/6: rows at least ``seconds`` after the key's last accepted row."""
    us = int(seconds * 1_000_000)

    def step(last, row):
        ok = last is None or row[at_us] - last >= us
        return (row[at_us] if ok else last), ok

    return ordered_fold(rows, keys, at_us, [], step, "passed boolean").where("passed").drop("passed")


def capped_cooldown(rows: DataFrame, keys: list[str], at_us: str, day: str, seconds: float, cap: int) -> DataFrame:
    """STR-7: a cooldown with at most ``cap`` accepted rows a day."""
    us = int(seconds * 1_000_000)

    def step(state, row):
        last, today, n = state or (None, None, 0)
        n = n if row[day] == today else 0
        ok = (last is None or row[at_us] - last >= us) and n < cap
        return ((row[at_us], row[day], n + 1) if ok else (last, row[day], n)), ok

    return ordered_fold(rows, keys, at_us, [day], step, "passed boolean").where("passed").drop("passed")


def recordings(rows: DataFrame, keys: list[str], at_us: str, tail: float = 3.0, longest: float = 120.0) -> DataFrame:
    """STR-9: the number of the recording that each motion belongs to: it ends after ``tail`` silent seconds or ``longest`` in all."""

    def step(state, row):
        n, start, last = state or (0, None, None)
        t = row[at_us]
        if start is None or t - last > tail * 1e6 or t - start > longest * 1e6:
            n, start = n + 1, t
        return (n, start, t), n

    return ordered_fold(rows, keys, at_us, [], step, "recording int")


def latch(rows: DataFrame, keys: list[str], order: str, value: str, on: float, off: float) -> DataFrame:
    """WIN-11 for any ``on`` and ``off``, also off > on: rows where the state turns on."""

    def step(state, row):
        v = row[value]
        if v is None:
            return state, False
        now = (v >= off) if state else (v >= on)
        return now, bool(now and not state)

    return ordered_fold(rows, keys, order, [value], step, "fired boolean").where("fired").drop("fired")


def keep_changed(rows: DataFrame, keys: list[str], order: str, hash64: str, most: int) -> DataFrame:
    """WIN-10: rows whose hash differs in more than ``most`` bits from the last *kept* one."""

    def step(kept, row):
        ok = kept is None or ((kept ^ row[hash64]) & (2**64 - 1)).bit_count() > most
        return (row[hash64] if ok else kept), ok

    return ordered_fold(rows, keys, order, [hash64], step, "kept boolean").where("kept").drop("kept")


def freeze_runs(rows: DataFrame, keys: list[str], order: str, hash64: str, most: int = 3) -> DataFrame:
    """WIN-9: per row, how many duplicates of the last unique hash have come in a row (0: it is unique)."""

    def step(state, row):
        anchor, n = state or (None, 0)
        if anchor is not None and ((anchor ^ row[hash64]) & (2**64 - 1)).bit_count() <= most:
            return (anchor, n + 1), n + 1
        return (row[hash64], 0), 0

    return ordered_fold(rows, keys, order, [hash64], step, "duplicates int")


def interval_lanes(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """WIN-30: the lowest lane whose last interval has ended. The state is one end per lane; lanes wait in heaps, those in use by their end and free ones by number,
    so a row's work hardly grows with the lanes. A row of a stream that starts before the one before it has them dealt anew."""

    def step(state, row):
        ends, used, free, last = state or ([], [], [], None)
        now = row[start]
        if last is not None and now < last:
            used = [(e, i) for i, e in enumerate(ends) if e > now]
            free = [i for i, e in enumerate(ends) if e <= now]  # ascending, so a heap
            heapq.heapify(used)
        while used and used[0][0] <= now:
            heapq.heappush(free, heapq.heappop(used)[1])
        at = heapq.heappop(free) if free else len(ends)
        ends[at : at + 1] = [row[end]]
        heapq.heappush(used, (row[end], at))
        return (ends, used, free, now), at

    return ordered_fold(rows, keys, start, [end], step, "lane int")


def moving_interval(rows: DataFrame, keys: list[str], at_us: str, weight: float = 0.1, reset: float = 30.0) -> DataFrame:
    """WIN-16: exponential mean of the seconds between rows, started anew after a long pause."""

    def step(state, row):
        last, mean = state or (None, None)
        gap = None if last is None else (row[at_us] - last) / 1e6
        mean = mean if gap is None else (None if gap > reset else gap if mean is None else (1 - weight) * mean + weight * gap)
        return (row[at_us], mean), mean

    return ordered_fold(rows, keys, at_us, [], step, "mean double")


def majority(rows: DataFrame, keys: list[str], order: str, label: str, last: int = 5) -> DataFrame:
    """WIN-8: a track's label: it changes only to one with strictly more of the last votes, the latest of equals."""

    def step(state, row):
        now, votes = state or (row[label], [])
        votes = [*votes, row[label]][-last:]
        best = max(dict.fromkeys(reversed(votes)), key=votes.count)
        now = best if votes.count(best) > votes.count(now) else now
        return (now, votes), now

    return ordered_fold(rows, keys, order, [label], step, "dominant string")


def event_gate(rows: DataFrame, keys: list[str], at_us: str, label: str, seconds: float = 10.0, always: str = "person") -> DataFrame:
    """STR-10: events at least ``seconds`` after the last accepted one; ``always`` passes and moves the anchor too."""

    def step(last, row):
        ok = last is None or row[label] == always or row[at_us] - last >= seconds * 1e6
        return (row[at_us] if ok else last), ok

    return ordered_fold(rows, keys, at_us, [label], step, "passed boolean").where("passed").drop("passed")


def watchdog(rows: DataFrame, keys: list[str], at_us: str, online: str, after: float = 300.0) -> DataFrame:
    """STR-11: down, alert (once, after ``after`` seconds down) and recovered (only if there was an alert), from status rows; null where nothing changes.

    A camera that sends nothing has no rows here: ``streaming.stateful.watchdog`` has timers for those.
    """

    def step(state, row):
        since, told = state or (None, False)
        if row[online]:
            return (None, False), "recovered" if told else None
        if since is None:
            return (row[at_us], False), "down"
        if not told and row[at_us] - since >= after * 1e6:
            return (since, True), "alert"
        return (since, told), None

    return ordered_fold(rows, keys, at_us, [online], step, "change string")


def disk_warnings(rows: DataFrame, keys: list[str], at_us: str, free_gb: str, least: float = 2.0, again: float = 86_400.0) -> DataFrame:
    """STR-11: rows with less than ``least`` GB free, more than ``again`` seconds after the key's last such warning."""
    return cooldown(rows.where(F.col(free_gb) < least), keys, at_us, again + 1e-6)


def sunset_once(rows: DataFrame, keys: list[str], at_us: str, altitude: str, day: str, low: float = -2.0, high: float = 5.0, minutes: float = 12.0) -> DataFrame:
    """STR-15: the first row of a day at which the sun has been within the band for ``minutes``; then the day is done."""

    def step(state, row):
        since, done = state or (None, None)
        if done == row[day] or row[altitude] is None:
            return (since, done), False
        if not low <= row[altitude] <= high:
            return (None, done), False
        if since is None:
            return (row[at_us], done), False
        if row[at_us] - since < minutes * 60e6:
            return (since, done), False
        return (None, row[day]), True

    return ordered_fold(rows, keys, at_us, [altitude, day], step, "fired boolean").where("fired").drop("fired")


def guarded_backfill(rows: DataFrame, keys: list[str], order: str, value: str, strict: str, recheck: int = 3, least_slots: int = 100, share: float = 0.6, in_a_row: int = 20) -> DataFrame:
    """WIN-32 with its guards: what becomes of each slot of a capture, as the column ``outcome``.

    A slot with a value is ``fresh``. One without takes the last fresh one (``backfilled``), but after ``recheck`` of those in a row only if that frame also passes the stricter test
    (``strict``); if it doesn't, it is forgotten, and slots are ``missing`` until the next fresh one. Once more than ``share`` of ``least_slots`` or more
    slots are backfilled, or more than ``in_a_row`` in a row, the capture ends: all further slots have the reason.
    """

    def step(state, row):
        held, fine, run, filled, slots, ended = state or (False, False, 0, 0, 0, None)
        if ended:
            return state, ended
        if row[value] is not None:
            held, fine, run, outcome = True, bool(row[strict]), 0, "fresh"
        else:
            if held and run >= recheck and not fine:
                held, run = False, 0
            run, filled, outcome = (run + 1, filled + 1, "backfilled") if held else (run, filled, "missing")
        slots += 1
        if slots >= least_slots and filled > share * slots:
            ended = "too_many_backfills"
        elif run > in_a_row:
            ended = "too_many_in_a_row"
        return (held, fine, run, filled, slots, ended), outcome

    return ordered_fold(rows, keys, order, [value, strict], step, "outcome string")


BLOB_IOU, BLOB_ACCEPT, BLOB_MISSES = 0.10, 0.25, 4


def _overlap(a: tuple, b: tuple) -> float:
    """IoU of two (x, y, w, h) boxes."""
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / (a[2] * a[3] + b[2] * b[3] - both) if both else 0.0


def _affinity(a: tuple, b: tuple) -> float:
    """1 + IoU of clearly overlapping boxes, else nearness of the centres for the size of ``a``."""
    if (share := _overlap(a, b)) >= BLOB_IOU:
        return 1 + share
    apart = np.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2)
    return max(0.0, 1 - apart / (4 * (np.hypot(a[2], a[3]) + 1)))


def blob_tracks(frames: DataFrame, keys: list[str], at_us: str, boxes: str) -> DataFrame:
    """STR-13: the track of every motion blob of a frame.

    ``boxes`` is an array of x, y, w, h of one blob after the other, a bounded list; ``tracks`` has a number for each. A
    blob joins the free track of the highest affinity over 0.25, else it starts one; a track ends after more than four frames without a blob.
    """

    def step(state, row):
        live, following = state or ({}, 0)
        flat = [float(v) for v in (row[boxes] if row[boxes] is not None else [])]
        free, out, seen = set(live), [], {}
        for blob in zip(*[iter(flat)] * 4, strict=True):
            near, who = max(((_affinity(blob, live[n][0]), -n) for n in free), default=(0.0, 0))
            if near > BLOB_ACCEPT:
                number = -who
                free.discard(number)
            else:
                number, following = following, following + 1
            seen[number] = (blob, 0)
            free.discard(number)
            out.append(number)
        for n in free:
            if live[n][1] < BLOB_MISSES:
                seen[n] = (live[n][0], live[n][1] + 1)
        return (seen, following), out

    return ordered_fold(frames, keys, at_us, [boxes], step, "tracks array<long>")


def coherent_tracks(tracked: DataFrame, keys: list[str], at_us: str, boxes: str, width: float, least_share: float = 0.04, least_age: int = 3) -> DataFrame:
    """STR-13: age, net displacement and whether it is coherent, of every track of ``blob_tracks``; frames of one time go by their event_id, if there is one."""
    at = F.struct(at_us, *_ties(tracked.columns))
    blobs = tracked.select(*keys, at.alias("at"), F.posexplode("tracks").alias("i", "track"), F.col(boxes).alias("b"))
    corner = lambda k: F.get("b", 4 * F.col("i") + k)
    centre = F.struct((corner(0) + corner(2) / 2).alias("x"), (corner(1) + corner(3) / 2).alias("y"))
    ends = blobs.groupBy(*keys, "track").agg(F.count("*").alias("age"), F.min_by(centre, "at").alias("a"), F.max_by(centre, "at").alias("b"))
    net = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return ends.select(*keys, "track", "age", net.alias("net"), ((F.col("age") >= least_age) & (net >= F.greatest(F.lit(1.0), F.lit(least_share * width)))).alias("coherent"))
