"""Live twins of the stateful operators: sessions, cooldown and tracks over event streams; those with timers are in ``stateful``.

Streams are ordered by event time within a micro-batch and bounded by watermarks, which the batch operators don't need.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larkspur.operators import tracking
from larkspur.session import in_order

#: Rows that a live tracker gives out at a time.
OUT_ROWS = 8192

EVENT_STREAM = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A file stream of the events table."""
    return spark.readStream.schema(EVENT_STREAM).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def session_lanes(stream: DataFrame, gap: str = "2 minutes", late: str = "10 minutes") -> DataFrame:
    """WIN-6 live: a lane is given out when the watermark has passed its end."""
    rows = stream.withWatermark("ts", late)
    out = rows.groupBy("camera_id", "label", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return out.select("camera_id", "label", "start", "end", "n")


def counts(stream: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """STR-16 live: tumbling or sliding counts per camera."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = stream.withWatermark("ts", late).groupBy("camera_id", window.alias("w")).agg(F.count("*").alias("n"))
    return out.select("camera_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cooldown(stream: DataFrame, seconds: float) -> DataFrame:
    """STR-3: events at least ``seconds`` after the key's last accepted one; suppressed events don't move the anchor."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for rows in ordered(parts):
            passed = []
            for us, event_id in zip(rows["us"], rows["event_id"], strict=True):
                if last is None or us - last >= 1e6 * seconds:
                    last = int(us)
                    passed.append(int(event_id))
            yield pd.DataFrame({"camera_id": key[0], "label": key[1], "event_id": passed}, columns=["camera_id", "label", "event_id"])
        state.update((last,))

    rows, ordered = in_order(stream.select("camera_id", "label", "event_id", F.unix_micros("ts").alias("us")), ["camera_id", "label"], ["us", "event_id"])
    return rows.groupBy("camera_id", "label").applyInPandasWithState(step, "camera_id string, label string, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def live_tracks(stream: DataFrame) -> DataFrame:
    """STR-2: the tracker over a stream of detections (camera_id, us, label, score, x1, y1, x2, y2); one frame is one instant of a camera.

    The state is what association can still need, so it doesn't grow with the stream. Each frame's samples are given out at once.
    """
    schema = "camera_id string, track_id long, us long, label string, score double, x1 double, y1 double, x2 double, y2 double, source string"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = pickle.loads(state.get[0]) if state.exists else tracking.Tracker()  # noqa: S301  our own state
        names, out = [c.split()[0] for c in schema.split(", ")], []
        rows = (r for part in ordered(parts) for r in part.itertuples())  # a frame may go on in the next part
        for us, frame in itertools.groupby(rows, key=lambda r: r.us):
            dets = [(r.label, float(r.score), (float(r.x1), float(r.y1), float(r.x2), float(r.y2))) for r in frame]
            tracker.frames += 1
            tracking.associate(tracker, dets, tracker.frames, us / 1e6)
            out += [(key[0], x.number, int(us), x.label, s[3], *s[2], s[5]) for x in tracker.tracks() for s in x.samples[-1:] if s[0] == tracker.frames]
            tracking.forget(tracker)
            if len(out) >= OUT_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        state.update((pickle.dumps(tracker),))
        yield pd.DataFrame(out, columns=names)

    stream, ordered = in_order(stream, ["camera_id"], ["us", "label", "score", "x1", "y1", "x2", "y2"])
    return stream.groupBy("camera_id").applyInPandasWithState(step, schema, "tracks binary", "append", GroupStateTimeout.NoTimeout)


GATES = ("enabled", "muted", "camera_muted", "label_off", "below_score", "suppressed", "rate_limited", "cooling_down", "off_schedule", "silent")


def skip_reason(given: dict[str, Column]) -> Column:
    """STR-17: the first gate of the notification chain that stops an event, null if all let it through."""
    out = F.lit(None).cast("string")
    for gate in reversed(GATES):
        stopped = ~given.get(gate, F.lit(True)) if gate == "enabled" else given.get(gate, F.lit(False))
        out = F.when(stopped, gate).otherwise(out)
    return out


def around_live(frames: DataFrame, triggers: DataFrame, before: str = "5 seconds", after: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """STR-12 live: frames within ``before`` and ``after`` of a trigger of their camera, as (event_id, trigger).

    A stream-stream join: both sides have watermarks and the range bounds how long either can still meet the other, so what no longer can is dropped from the state.
    A join in a stream looks at all rows of its key, so the key is a camera and a slot of half the range's length; a trigger goes to each of the three or four slots that its range touches, a frame to its own,
    so they meet once.
    """
    slot = lambda at: F.floor(F.unix_micros(at) / F.expr(f"greatest(1, unix_micros(timestamp_seconds(0) + INTERVAL {before} + INTERVAL {after}) / 2)"))
    f = frames.select(F.col("event_id"), F.col("camera_id"), F.col("ts"), slot(F.col("ts")).alias("slot")).withWatermark("ts", late)
    t = triggers.select(F.col("event_id").alias("trigger"), F.col("camera_id").alias("of"), F.col("ts").alias("at")).withWatermark("at", late)
    touched = F.sequence(slot(F.col("at") - F.expr(f"INTERVAL {before}")), slot(F.col("at") + F.expr(f"INTERVAL {after}")))
    t = t.withColumn("near", F.explode(touched))
    met = (F.col("camera_id") == F.col("of")) & (F.col("slot") == F.col("near")) & (F.col("ts") >= F.col("at") - F.expr(f"INTERVAL {before}")) & (F.col("ts") <= F.col("at") + F.expr(f"INTERVAL {after}"))
    return f.join(t, met).select("event_id", "trigger")


def first_unlocks(stream: DataFrame, key: str, folder: str) -> DataStreamWriter:
    """STR-18 live: the first event of each value of ``key``, written once to ``folder``/unlocks; what is written stays, whatever comes later.

    A batch is reduced to one row a value before it meets the unlocks of earlier batches, so a value that half of the events have costs one row. A batch that runs twice leaves the same.
    """
    schema = f"{key} string, event_id long, ts timestamp, batch int"

    def step(batch: DataFrame, number: int) -> None:
        first = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("ts", "event_id")).alias("first")).select(key, "first.event_id", "first.ts")
        if number:
            known = batch.sparkSession.read.schema(schema).option("basePath", f"{folder}/unlocks").parquet(f"{folder}/unlocks/batch=*").where(F.col("batch") < number)
            first = first.join(known.select(key), key, "left_anti")
        first.coalesce(1).write.mode("overwrite").parquet(f"{folder}/unlocks/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/log")
