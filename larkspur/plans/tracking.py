"""Tracking queries: a camera and an hour stand for a clip, an event for a detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import tracking
from larkspur.plans import plan
from larkspur.plans.sql import EVENTS
from larkspur.sources.events import events_view as events


def detections(spark, sf_dir):
    rows = events(spark, sf_dir)
    t = F.minute("ts") * 60 + F.second("ts")
    box = {"x1": F.col("x1") % 300, "y1": F.col("y1") % 200, "x2": F.col("x1") % 300 + 80, "y2": F.col("y1") % 200 + 80}
    return rows.select(F.concat_ws("/", "camera_id", F.date_format("ts", "ddHH")).alias("clip"), t.cast("int").alias("f"), t.cast("double").alias("t"), "label", "score", *[v.cast("double").alias(k) for k, v in box.items()])


@plan("trk_01_tracks")
def _(spark, sf_dir):
    return tracking.track(detections(spark, sf_dir))


@plan("trk_10_whole_clips")
def _(spark, sf_dir):
    """Finished clips: tracks that go on or lie on each other are one, and static tracks and ghosts are gone."""
    found = tracking.once(tracking.track(detections(spark, sf_dir), whole=True, frame=(380, 280)))
    return tracking.summaries(tracking.keep_real(tracking.without_static(found, 0.8), 0.8))


def given(spark, sf_dir):
    """Tracks as they are given: a camera's day is a clip, an hour a frame, a user's remainder a track."""
    rows = events(spark, sf_dir)
    box = {"x1": F.col("x1") % 300, "y1": F.col("y1") % 200, "x2": F.col("x1") % 300 + 80, "y2": F.col("y1") % 200 + 80}
    sample = F.struct("event_id", "score", F.when(F.col("k") % 10 == 0, "predicted").otherwise("detect").alias("source"), *[v.cast("double").alias(k) for k, v in box.items()])
    one = rows.groupBy(F.concat_ws("/", "camera_id", F.date_format("ts", "dd")).alias("clip"), (F.col("user_id") % 4).cast("int").alias("track_id"), F.hour("ts").alias("f")).agg(F.min(sample).alias("s"))
    return one.select("clip", "track_id", "f", F.col("f").cast("double").alias("t"), "s.x1", "s.y1", "s.x2", "s.y2", "s.score", F.when(F.col("track_id") < 3, "cat").otherwise("bird").alias("label"), "s.source")


_GIVEN = """g0 AS (SELECT camera_id || '/' || strftime(ts, '%d') AS clip, CAST(user_id % 4 AS INT) AS track_id, CAST(hour(ts) AS INT) AS f, event_id, k, score, x1 % 300 AS x1, y1 % 200 AS y1 FROM e),
    g1 AS (SELECT *, row_number() OVER (PARTITION BY clip, track_id, f ORDER BY event_id) AS rn FROM g0),
    g AS (SELECT clip, track_id, f, CAST(f AS DOUBLE) AS t, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, x1 + 80.0::DOUBLE AS x2, y1 + 80.0::DOUBLE AS y2, score, CASE WHEN track_id < 3 THEN 'cat' ELSE 'bird' END AS label, CASE WHEN k % 10 = 0 THEN 'predicted' ELSE 'detect' END AS source FROM g1 WHERE rn = 1)"""


@plan(
    "trk_10_stitch",
    f"""WITH {EVENTS}, {_GIVEN}, d AS (SELECT clip, CAST(track_id * 4 + f // 6 AS INT) AS track_id, any_value(label) AS label, min(t) AS t0, max(t) AS t1, arg_min({{'x': x1, 'y': y1}}, f) AS head, arg_max({{'x': x1, 'y': y1}}, f) AS tail FROM g WHERE source = 'detect' GROUP BY 1, 2),
    p AS (SELECT b.clip, b.track_id, a.track_id AS before, b.t0 - a.t1 AS wait FROM d b JOIN d a ON a.clip = b.clip AND a.label = b.label AND a.track_id <> b.track_id
          WHERE b.t0 - a.t1 BETWEEN 0 AND 6 AND sqrt((b.head.x - a.tail.x) ** 2 + (b.head.y - a.tail.y) ** 2) <= 128),
    n AS (SELECT *, row_number() OVER (PARTITION BY clip, track_id ORDER BY wait, before) AS rn FROM p)
    SELECT clip, track_id, before, wait FROM n WHERE rn = 1""",
)
def _(spark, sf_dir):
    """JN-11 on tracks that take turns: every quarter of the day is a track of its own."""
    return tracking.stitch_candidates(given(spark, sf_dir).withColumn("track_id", (F.col("track_id") * 4 + F.floor(F.col("f") / 6)).cast("int")))


@plan(
    "trk_10_without_static",
    f"""WITH {EVENTS}, {_GIVEN}, s AS (SELECT *, sqrt((x1 - lag(x1) OVER v) ** 2 + (y1 - lag(y1) OVER v) ** 2) AS step FROM g WHERE source = 'detect' WINDOW v AS (PARTITION BY clip, track_id ORDER BY f)),
    m AS (SELECT clip, track_id, count(*) AS n, list_sort(list(score))[count(*) // 2 + 1] AS middle, sqrt((arg_max(x1, f) - arg_min(x1, f)) ** 2 + (arg_max(y1, f) - arg_min(y1, f)) ** 2) AS net, coalesce(max(step), 0) AS step FROM s GROUP BY 1, 2)
    SELECT g.clip, g.track_id, count(*) AS samples FROM g LEFT JOIN m ON m.clip = g.clip AND m.track_id = g.track_id WHERE NOT coalesce(n >= 3 AND middle < 0.55 AND net < 240 AND step < 240, false) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return tracking.without_static(given(spark, sf_dir), 0.55, 3.0).groupBy("clip", "track_id").agg(F.count("*").alias("samples"))


@plan(
    "trk_11_ghost_prune",
    f"""WITH {EVENTS}, {_GIVEN}, d AS (SELECT *, lead(t, 2) OVER (PARTITION BY clip, track_id ORDER BY t) - t AS span FROM g WHERE source = 'detect'),
    c AS (SELECT clip, track_id, coalesce(bool_or(span <= 2), false) AS confirmed, max(score) AS best FROM d GROUP BY 1, 2)
    SELECT clip, track_id, arg_max(g.label, f) AS label, min(t) AS first_t, max(t) AS last_t, count(*) FILTER (source = 'detect') AS hits, max(score) FILTER (source = 'detect') AS best
    FROM g JOIN c USING (clip, track_id) WHERE c.best >= 0.97 OR confirmed GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return tracking.summaries(tracking.keep_real(given(spark, sf_dir), 0.97, 3, 2.0))


_DET = "t0 AS (SELECT camera_id || '/' || strftime(ts, '%d%H') AS clip, CAST(minute(ts) * 60 + second(ts) AS INT) AS f, label, score FROM e)"


@plan("trk_09_best_moment", f"WITH {EVENTS}, {_DET}, r AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, f, label) AS rn FROM t0) SELECT clip, f, label, score FROM r WHERE rn = 1")
def _(spark, sf_dir):
    rows = detections(spark, sf_dir).withColumn("source", F.lit("detect"))
    return tracking.best_moments(rows).select("clip", "f", "label", "score")


@plan("trk_12_reindex_plan", f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'missing' ELSE 'stale' END AS why FROM e WHERE event_id % 3 <> 0 OR event_id % 6 = 0")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    sidecars = rows.where("event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 6 == 0, 3).otherwise(4).alias("schema"))
    return tracking.reindex_plan(rows, sidecars)


@plan(
    "jn_20_tracks_at_time",
    f"""WITH {EVENTS}, {_GIVEN}, s AS (SELECT clip, track_id, min(t) AS t0, max(t) FILTER (source = 'detect') AS t1, arg_max({{'t': t, 'x': x1, 'y': y1}}, t) FILTER (t <= 12.5) AS a, arg_min({{'t': t, 'x': x1, 'y': y1}}, t) FILTER (t >= 12.5) AS b FROM g GROUP BY 1, 2),
    i AS (SELECT clip, track_id, coalesce(a, b) AS a, coalesce(b, a) AS b FROM s WHERE t0 - 1 <= 12.5 AND t1 + 1 >= 12.5),
    v AS (SELECT *, CASE WHEN b.t > a.t THEN (12.5::DOUBLE - a.t) / (b.t - a.t) ELSE 0 END AS w FROM i)
    SELECT clip, track_id, round(a.x + w * (b.x - a.x), 6) AS x1, round(a.y + w * (b.y - a.y), 6) AS y1, round(a.x + 80 + w * (b.x - a.x), 6) AS x2, round(a.y + 80 + w * (b.y - a.y), 6) AS y2 FROM v""",
)
def _(spark, sf_dir):
    """WIN-31 too: every track's interpolated box at half past twelve."""
    at = tracking.at_time(given(spark, sf_dir), 12.5, 1.0)
    return at.select("clip", "track_id", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@plan(
    "jn_12_mean_overlap",
    f"""WITH {EVENTS}, {_GIVEN}, d AS (SELECT * FROM g WHERE source = 'detect'),
    p AS (SELECT a.clip, a.track_id AS a, b.track_id AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i FROM d a JOIN d b ON a.clip = b.clip AND a.label = b.label AND a.f = b.f AND a.track_id < b.track_id)
    SELECT clip, a, b, round(avg(i / (12800 - i)), 6) AS overlap, count(*) AS frames FROM p GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    return tracking.mean_overlap(given(spark, sf_dir)).withColumn("overlap", F.round("overlap", 6))


@plan("trk_10_merge_overlaps")
def _(spark, sf_dir):
    return tracking.merge_overlapping(tracking.once(tracking.track(detections(spark, sf_dir), listed=True)))
