"""Queries over time: novelty, confirmation, sessions, hysteresis, runs, calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import folds, temporal
from larkspur.plans import plan
from larkspur.plans.sql import EVENTS, WEATHER, walk
from larkspur.sources.events import events_view as events
from larkspur.sources.events import weather_view as weather

_HOURS = "CASE lab WHEN 'person' THEN 6.0 WHEN 'bird' THEN 4.0 WHEN 'cat' THEN 8.0 WHEN 'squirrel' THEN 12.0 ELSE 8.0 END"
#: Users stand for cameras here: gaps of hours need sparser keys than five cameras.
_NOVELTY = f"""{EVENTS},
  n0 AS (SELECT event_id, 'user_' || user_id AS cam, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, labels FROM e WHERE time <> ''),
  n1 AS (SELECT event_id, cam, s, unnest(labels) AS lab, unnest(range(len(labels))) AS pos FROM n0),
  n2 AS (SELECT * FROM n1 WHERE lab <> 'motion'),
  n3 AS (SELECT *, max(s) OVER w AS ps, max(CAST(s AS HUGEINT) * 1000000000 + event_id) OVER w AS pk FROM n2 WINDOW w AS (PARTITION BY cam, lab ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  n4 AS (SELECT event_id, cam, s, lab, pos, CAST(pk % 1000000000 AS BIGINT) AS previous, (s - ps) / 3600.0 AS gap_h FROM n3 WHERE ps IS NOT NULL),
  n5 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY gap_h DESC, pos) AS rn FROM n4 WHERE gap_h >= {_HOURS}),
  n6 AS (SELECT event_id, cam, s, lab, previous, round(gap_h, 1) AS gap_hours FROM n5 WHERE rn = 1)"""


def _as_users(spark, sf_dir):
    return events(spark, sf_dir).withColumn("camera_id", F.concat(F.lit("user_"), F.col("user_id")))


@plan("win_01_first_since", f"WITH {_NOVELTY} SELECT event_id, cam AS camera_id, lab AS label, previous, gap_hours FROM n6")
def _(spark, sf_dir):
    return temporal.first_since(_as_users(spark, sf_dir)).select("event_id", "camera_id", "label", "previous", "gap_hours")


@plan("win_02_record_gap", f"WITH {_NOVELTY} SELECT event_id, gap_hours > coalesce(max(gap_hours) OVER (PARTITION BY cam, lab ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS is_new_record FROM n6")
def _(spark, sf_dir):
    return temporal.first_since(_as_users(spark, sf_dir)).select("event_id", "is_new_record")


CONFIRM_SQL = f"""WITH {EVENTS}, h AS (SELECT event_id, camera_id, label, epoch_us(ts) AS us FROM e),
    a AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY camera_id, label ORDER BY us) > 3600000000 THEN 1 ELSE 0 END AS cut FROM h),
    b AS (SELECT *, sum(cut) OVER (PARTITION BY camera_id, label ORDER BY us) AS sitting,
                 count(*) OVER (PARTITION BY camera_id, label ORDER BY us RANGE BETWEEN 1800000000 PRECEDING AND CURRENT ROW) AS hits FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY camera_id, label, sitting ORDER BY us) AS rn FROM b WHERE hits >= 3)
    SELECT event_id, camera_id, label FROM c WHERE rn = 1"""


@plan("win_03_confirm_live", CONFIRM_SQL)
def _(spark, sf_dir):
    hits = events(spark, sf_dir).select("event_id", "camera_id", "label", temporal.micros(F.col("ts")).alias("us"))
    return temporal.confirm_live(hits, ["camera_id", "label"], "us", 3, 1800).select("event_id", "camera_id", "label")


@plan(
    "win_04_confirm_clip",
    f"""WITH {EVENTS}, s AS (SELECT camera_id, label, epoch_us(ts) / 1000000.0 AS t FROM e),
    a AS (SELECT *, lead(t, 2) OVER (PARTITION BY camera_id, label ORDER BY t) - t AS span FROM s)
    SELECT camera_id, label, coalesce(bool_or(span <= 60), false) AS confirmed FROM a GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    samples = events(spark, sf_dir).select("camera_id", "label", (temporal.micros(F.col("ts")) / 1000000.0).alias("t"))
    return temporal.confirm_clip(samples, ["camera_id", "label"], "t", 3, 60)


@plan("win_05_two_of_three", f"WITH {EVENTS} SELECT event_id, CAST(sum(CAST(k > 50 AS INT)) OVER (PARTITION BY camera_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS INT) >= 2 AS motion FROM e")
def _(spark, sf_dir):
    return temporal.two_of_three(events(spark, sf_dir), ["camera_id"], "event_id", F.col("k") > 50).select("event_id", "motion")


@plan(
    "win_06_session_lanes",
    f"""WITH {EVENTS}, a AS (SELECT camera_id, label, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 120 MINUTE THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY camera_id, label ORDER BY ts)),
    b AS (SELECT *, sum(cut) OVER (PARTITION BY camera_id, label ORDER BY ts) AS g FROM a)
    SELECT camera_id, label, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM b GROUP BY camera_id, label, g""",
)
def _(spark, sf_dir):
    return temporal.session_lanes(events(spark, sf_dir), "120 minutes")


@plan("win_07_swim_lanes", f"WITH {EVENTS}, x AS (SELECT *, camera_id AS lane FROM e WHERE CAST(epoch(TIMESTAMP '2024-01-20 12:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT) BETWEEN 0 AND 7200) SELECT lane, arg_max(label, (ts, event_id)) AS label, count(*) AS n FROM x GROUP BY 1")
def _(spark, sf_dir):
    return temporal.swim_lanes(events(spark, sf_dir).withColumn("lane", F.col("camera_id")), "2024-01-20 12:00:00", 7200)


@plan(
    "win_11_hysteresis",
    f"""WITH {WEATHER}, a AS (SELECT ts, gust, CASE WHEN gust >= 150 THEN 1 WHEN gust < 80 THEN 0 END AS m FROM w),
    b AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (ORDER BY ts), 0) AS s FROM a),
    c AS (SELECT *, coalesce(lag(s) OVER (ORDER BY ts), 0) AS p FROM b) SELECT ts, gust FROM c WHERE s = 1 AND p = 0""",
)
def _(spark, sf_dir):
    rows = weather(spark, sf_dir).withColumn("station", F.lit("one"))
    return temporal.hysteresis(rows, ["station"], "ts", "gust", 150, 80).select("ts", "gust")


@plan("win_12_latest_slot", f"WITH {WEATHER} SELECT ts, gust, rain FROM w WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' AND coalesce(gust, rain) IS NOT NULL ORDER BY ts DESC LIMIT 1")
def _(spark, sf_dir):
    return temporal.latest_slot(weather(spark, sf_dir), "ts", ["gust", "rain"], "2024-01-15 00:00:00").select("ts", "gust", "rain")


@plan("win_13_latest_values", f"WITH {WEATHER} SELECT arg_max(gust, ts) FILTER (gust IS NOT NULL) AS gust, arg_max(rain, ts) FILTER (rain IS NOT NULL) AS rain FROM w")
def _(spark, sf_dir):
    return temporal.latest_values(weather(spark, sf_dir), "ts", ["gust", "rain"])


_ISLANDS = """a AS (SELECT *, CASE WHEN flag IS DISTINCT FROM lag(flag) OVER (PARTITION BY camera_id ORDER BY event_id) OR row_number() OVER (PARTITION BY camera_id ORDER BY event_id) = 1 THEN 1 ELSE 0 END AS cut FROM x),
    b AS (SELECT *, sum(cut) OVER (PARTITION BY camera_id ORDER BY event_id) AS run FROM a)"""


@plan("win_14_runs", f"WITH {EVENTS}, x AS (SELECT camera_id, event_id, k < 70 AS flag FROM e), {_ISLANDS} SELECT camera_id, flag, min(event_id) AS start, max(event_id) AS \"end\", count(*) AS n FROM b GROUP BY camera_id, run, flag")
def _(spark, sf_dir):
    return temporal.islands(events(spark, sf_dir), ["camera_id"], "event_id", F.col("k") < 70)


@plan(
    "win_14_chart_lines",
    f"""WITH {EVENTS}, x AS (SELECT camera_id, event_id, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY camera_id) AS n,
        CASE WHEN k < 70 THEN CAST(k AS DOUBLE) END AS busy, CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 3 <> 0 THEN 4.0::DOUBLE END AS flat FROM e),
    u AS (SELECT camera_id, event_id, i, n, unnest(['busy', 'value', 'flat']) AS field, unnest([busy, value, flat]) AS v FROM x),
    a AS (SELECT *, CASE WHEN v IS NOT NULL AND lag(v) OVER o IS NULL THEN 1 ELSE 0 END AS starts, min(v) OVER p AS lo, max(v) OVER p AS hi FROM u WINDOW p AS (PARTITION BY camera_id, field), o AS (PARTITION BY camera_id, field ORDER BY i)),
    b AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY camera_id, field ORDER BY i) AS BIGINT) AS run FROM a)
    SELECT camera_id, event_id, field, run, round(i / (n - 1), 6) AS x, round(CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE 1 - (v - lo) / (hi - lo) END, 6) AS y, count(*) OVER (PARTITION BY camera_id, field, run) >= 6 AS smooth FROM b WHERE v IS NOT NULL""",
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select(
        "camera_id", "event_id", F.when(F.col("k") < 70, F.col("k")).alias("busy"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 3 != 0, 4.0).alias("flat")
    )
    lines = temporal.chart_lines(rows, ["camera_id"], "event_id", ["busy", "value", "flat"])
    return lines.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@plan("win_21_longest_run", f"WITH {EVENTS}, x AS (SELECT camera_id, event_id, k < 70 AS flag FROM e), {_ISLANDS}, c AS (SELECT camera_id, count(*) AS n FROM b WHERE flag GROUP BY camera_id, run) SELECT camera_id, max(n) AS longest FROM c GROUP BY 1")
def _(spark, sf_dir):
    runs = temporal.islands(events(spark, sf_dir), ["camera_id"], "event_id", F.col("k") < 70)
    return runs.where("flag").groupBy("camera_id").agg(F.max("n").alias("longest"))


@plan(
    "win_15_subsample",
    f"""WITH {EVENTS}, x AS (SELECT camera_id, event_id, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) - 1 AS nth, count(*) OVER (PARTITION BY camera_id) AS n FROM e)
    SELECT camera_id, event_id FROM x WHERE nth IN (SELECT CAST(floor(i * n / 48) AS BIGINT) FROM range(48) t(i))""",
)
def _(spark, sf_dir):
    return temporal.every_kth(events(spark, sf_dir), ["camera_id"], "event_id", 48).select("camera_id", "event_id")


@plan("win_17_thunder_rising", f"WITH {WEATHER}, x AS (SELECT *, (epoch(ts) - epoch(TIMESTAMP '2024-01-10 06:00:00')) / 60 AS m FROM w), y AS (SELECT arg_max(gust, ts) FILTER (m <= 0) AS now, max(gust) FILTER (m BETWEEN 0 AND 90) AS peak FROM x) SELECT now, peak, least(1.0, peak / 3000) AS score FROM y WHERE (now IS NULL OR now < 500) AND peak >= 15")
def _(spark, sf_dir):
    return temporal.rising(weather(spark, sf_dir), "ts", "gust", "2024-01-10 06:00:00", 500, 15)


@plan("win_18_front_passing", f"WITH {WEATHER}, s AS (SELECT CAST(epoch(ts) AS BIGINT) AS s, gust, rain FROM w) SELECT a.s, b.s AS s2, b.gust - a.gust AS d_cloud, b.rain - a.rain AS d_gust FROM s a JOIN s b ON b.s > a.s AND b.s - a.s <= 3600 WHERE abs(b.gust - a.gust) > 50 AND abs(b.rain - a.rain) > 20 ORDER BY 1, 2 LIMIT 1")
def _(spark, sf_dir):
    return temporal.front_passing(weather(spark, sf_dir), "ts", "gust", "rain")


@plan("win_19_storm_front", f"WITH {WEATHER} SELECT arg_max(ts, gust) AS ts, max(gust) AS gust, least(1.0, max(gust) / 120) AS score FROM w WHERE rain > 70")
def _(spark, sf_dir):
    rows = weather(spark, sf_dir).where("rain > 70")
    return rows.agg(F.max_by("ts", "gust").alias("ts"), F.max("gust").alias("gust"), F.least(F.lit(1.0), F.max("gust") / 120).alias("score"))


_CLIPS = "c0 AS (SELECT *, camera_id || '/' || strftime(date_trunc('hour', ts), '%d%H') AS clip, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM e)"


def clips(spark, sf_dir):
    """Events of a camera and hour stand for the samples of a track."""
    return events(spark, sf_dir).withColumn("clip", F.concat_ws("/", "camera_id", F.date_format("ts", "ddHH")))


_STEPS = f"{_CLIPS}, c1 AS (SELECT *, sqrt((cx - lag(cx) OVER v) ** 2 + (cy - lag(cy) OVER v) ** 2) AS step FROM c0 WINDOW v AS (PARTITION BY clip ORDER BY event_id)), c2 AS (SELECT clip, round(sqrt((arg_max(cx, event_id) - arg_min(cx, event_id)) ** 2 + (arg_max(cy, event_id) - arg_min(cy, event_id)) ** 2), 4) AS net, round(coalesce(sum(step), 0), 4) AS path, round(coalesce(max(step), 0), 4) AS max_step, count(*) AS age FROM c1 GROUP BY 1)"


@plan("win_20_track_motion", f"WITH {EVENTS}, {_STEPS} SELECT clip, net, path, max_step, age FROM c2")
def _(spark, sf_dir):
    out = temporal.track_motion(clips(spark, sf_dir), ["clip"], "event_id")
    return out.select("clip", *[F.round(c, 4).alias(c) for c in ("net", "path", "max_step")], "age")


@plan("win_23_static_tracks", f"WITH {EVENTS}, {_STEPS}, m AS (SELECT clip, list_sort(list(score))[len(list(score)) // 2 + 1] AS s, list_sort(list(x2 - x1))[count(*) // 2 + 1] AS w, list_sort(list(y2 - y1))[count(*) // 2 + 1] AS h FROM c0 GROUP BY 1) SELECT c2.clip, age >= 3 AND s < 0.55 AND least(w, h) > 0 AND net < 5.0 * least(w, h) AND max_step < 5.0 * least(w, h) AS static FROM c2 JOIN m ON c2.clip = m.clip")
def _(spark, sf_dir):
    return temporal.static_false_positive(clips(spark, sf_dir), ["clip"], "event_id", 0.55, 5.0)


@plan("win_24_goal_windows", "SELECT * FROM (VALUES ('december', NULL::TIMESTAMP, NULL::TIMESTAMP), ('april_rolling_week', '2024-04-01'::TIMESTAMP, '2024-04-05 10:30:00'::TIMESTAMP), ('year_to_date', '2024-01-01', '2024-04-05 10:30:00'), ('current_calendar_month', '2024-04-01', '2024-04-05 10:30:00'), ('current_rolling_week', '2024-03-29 10:30:00', '2024-04-05 10:30:00')) t(name, start, \"end\")")
def _(spark, sf_dir):
    parts = []
    for name in ("december", "april_rolling_week", "year_to_date", "current_calendar_month", "current_rolling_week"):
        start, end = temporal.goal_window(name, "2024-04-05 10:30:00")
        parts.append(spark.range(1).select(F.lit(name).alias("name"), start.alias("start"), end.alias("end")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan("win_26_last_sunday", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, strftime(last_day(o_orderdate) - CAST(dayofweek(last_day(o_orderdate)) AS INT), '%Y-%m-%d') AS sunday FROM orders")
def _(spark, sf_dir):
    day = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).distinct()
    return day.select(F.date_format("month", "yyyy-MM").alias("month"), temporal.last_sunday(F.col("month")).cast("string").alias("sunday"))


@plan(
    "win_32_backfill",
    f"""WITH {EVENTS}, x AS (SELECT camera_id, event_id, CASE WHEN k >= 40 THEN k END AS v FROM e),
    a AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY event_id) AS filled, count(v) OVER (PARTITION BY camera_id ORDER BY event_id) AS since FROM x)
    SELECT camera_id, event_id, coalesce(filled, -1) AS filled, CAST(row_number() OVER (PARTITION BY camera_id, since ORDER BY event_id) - CASE WHEN since > 0 THEN 1 ELSE 0 END AS INT) AS reused FROM a""",
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("camera_id", "event_id", F.when(F.col("k") >= 40, F.col("k")).alias("v"))
    return temporal.backfill(rows, ["camera_id"], "event_id", "v").select("camera_id", "event_id", F.coalesce("filled", F.lit(-1)).alias("filled"), "reused")


def _backfill_sql() -> str:
    dropped = "(r.v IS NULL AND w.held AND w.run >= 3 AND NOT w.fine)"
    filled = f"(r.v IS NULL AND w.held AND NOT {dropped})"
    run = f"CASE WHEN r.v IS NOT NULL THEN 0 WHEN {filled} THEN w.run + 1 ELSE CASE WHEN {dropped} THEN 0 ELSE w.run END END"
    count = f"(w.filled + CASE WHEN {filled} THEN 1 ELSE 0 END)"
    return walk(
        f"SELECT camera_id || '/' || CAST(ts AS DATE) AS capture, event_id, epoch_us(ts) AS us, {_SLOT_SQL} AS v, k % 3 = 0 AS fine_now FROM e",
        "v IS NOT NULL AS held, v IS NOT NULL AND fine_now AS fine, 0 AS run, 0 AS filled, 1 AS slots, CAST(NULL AS VARCHAR) AS ended, CASE WHEN v IS NOT NULL THEN 'fresh' ELSE 'missing' END AS outcome",
        f"""r.v IS NOT NULL OR (w.held AND NOT {dropped}) AS held, CASE WHEN r.v IS NOT NULL THEN r.fine_now ELSE w.fine END AS fine, {run} AS run, {count} AS filled, w.slots + 1 AS slots,
        CASE WHEN w.ended IS NOT NULL THEN w.ended WHEN w.slots + 1 >= 20 AND {count} > 0.5 * (w.slots + 1) THEN 'too_many_backfills' WHEN {run} > 8 THEN 'too_many_in_a_row' END AS ended,
        CASE WHEN w.ended IS NOT NULL THEN w.ended WHEN r.v IS NOT NULL THEN 'fresh' WHEN {filled} THEN 'backfilled' ELSE 'missing' END AS outcome""",
        "capture, event_id, outcome",
        key="capture",
    )


_SLOT_SQL = "CASE WHEN (hour(ts) < 10 AND k < 70) OR (hour(ts) >= 10 AND k >= 45) THEN k END"


@plan("win_32_guarded_backfill", _backfill_sql())
def _(spark, sf_dir):
    """A capture for each camera and day, that ends after half of twenty slots or eight in a row."""
    rows = events(spark, sf_dir).select(F.concat_ws("/", "camera_id", F.col("ts").cast("date")).alias("capture"), "event_id", temporal.micros(F.col("ts")).alias("us"), F.expr(_SLOT_SQL).alias("v"), (F.col("k") % 3 == 0).alias("fine"))
    return folds.guarded_backfill(rows, ["capture"], "us", "v", "fine", least_slots=20, share=0.5, in_a_row=8).select("capture", "event_id", "outcome")


@plan("win_33_identical_runs", f"WITH {EVENTS}, x AS (SELECT camera_id, event_id, k % 3 AS flag FROM e), {_ISLANDS}, c AS (SELECT camera_id, count(*) AS n FROM b GROUP BY camera_id, run) SELECT camera_id, CAST(sum(n - 1) AS BIGINT) AS repeats, max(n) AS longest FROM c GROUP BY 1")
def _(spark, sf_dir):
    runs = temporal.islands(events(spark, sf_dir), ["camera_id"], "event_id", F.col("k") % 3)
    return runs.groupBy("camera_id").agg(F.sum(F.col("n") - 1).alias("repeats"), F.max("n").alias("longest"))


@plan("win_34_trails", f"WITH {EVENTS}, {_CLIPS}, r AS (SELECT clip, event_id, cx, row_number() OVER (PARTITION BY clip ORDER BY event_id DESC) AS rn FROM c0) SELECT clip, count(*) AS points, sum(cx) AS cx FROM r WHERE rn <= 5 GROUP BY 1 HAVING count(*) >= 2")
def _(spark, sf_dir):
    rows = temporal.trails(clips(spark, sf_dir), ["clip"], "event_id", 5)
    return rows.select("clip", F.size("trail").cast("long").alias("points"), F.aggregate("trail", F.lit(0.0), lambda a, p: a + p["x"]).alias("cx"))


def cooldown_sql(keys: str, seconds: str, out: str = "event_id") -> str:
    """The anchor moves on acceptance only: a recursive walk from accepted event to accepted event."""
    return f"""WITH RECURSIVE {EVENTS}, o AS (SELECT event_id, camera_id, label, epoch_us(ts) AS us FROM e),
    walk AS (SELECT {keys}, min(us) AS us FROM o GROUP BY {keys}
             UNION ALL
             SELECT n.* FROM (SELECT {', '.join('o.' + k for k in keys.split(', '))}, min(o.us) AS us FROM walk JOIN o ON {' AND '.join(f'o.{k} = walk.{k}' for k in keys.split(', '))} AND o.us >= walk.us + CAST({seconds} AS BIGINT) * 1000000 GROUP BY {', '.join('o.' + k for k in keys.split(', '))}, walk.us) n)
    SELECT {out} FROM o JOIN walk ON {' AND '.join(f'o.{k} = walk.{k}' for k in keys.split(', '))} AND o.us = walk.us"""


@plan("str_03_cooldown", cooldown_sql("camera_id, label", "7200"))
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "camera_id", "label", temporal.micros(F.col("ts")).alias("us"))
    return folds.cooldown(rows, ["camera_id", "label"], "us", 7200.0).select("event_id")


@plan("str_04_rate_limit", cooldown_sql("camera_id", "3600"))
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "camera_id", "label", temporal.micros(F.col("ts")).alias("us"))
    return folds.cooldown(rows, ["camera_id"], "us", 3600.0).select("event_id")


@plan("str_05_mutes", f"WITH {EVENTS}, m(camera_id, label, a, b) AS (VALUES ('cam_1', NULL, TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06'), ('cam_2', 'bird', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-20')) SELECT event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.camera_id = e.camera_id AND (m.label IS NULL OR m.label = e.label) AND e.ts >= a AND e.ts < b)")
def _(spark, sf_dir):
    mutes = F.broadcast(spark.createDataFrame([("cam_1", None, "2024-01-05", "2024-01-06"), ("cam_2", "bird", "2024-01-10", "2024-01-20")], "camera_id string, label string, a string, b string")).alias("m")  # a fixed table
    rows = events(spark, sf_dir).alias("e")
    on = (F.col("m.camera_id") == F.col("e.camera_id")) & (F.col("m.label").isNull() | (F.col("m.label") == F.col("e.label")))
    on = on & (F.col("e.ts") >= F.col("m.a").cast("timestamp_ntz")) & (F.col("e.ts") < F.col("m.b").cast("timestamp_ntz"))
    return rows.join(mutes, on, "left_anti").select("event_id")


@plan("str_16_sliding_reconnects", f"WITH {EVENTS} SELECT event_id, count(*) OVER (PARTITION BY camera_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM e WHERE label = 'person'")
def _(spark, sf_dir):
    from pyspark.sql import Window

    rows = events(spark, sf_dir).where("label = 'person'").withColumn("us", temporal.micros(F.col("ts")))
    day = Window.partitionBy("camera_id").orderBy("us").rangeBetween(-86_400_000_000, 0)
    return rows.select("event_id", F.count("*").over(day).alias("n"))


@plan(
    "win_30_lane_partition",
    walk(
        'SELECT camera_id, event_id, epoch_us(ts) AS start, epoch_us(ts) + (event_id % 97 + 1) * 60000000 AS "end" FROM e',
        'ARRAY["end"]::BIGINT[] AS lanes, 0 AS lane',
        """CASE WHEN list_min(w.lanes) <= r.start THEN list_transform(w.lanes, lambda x, i: CASE WHEN i = list_position(list_transform(w.lanes, lambda y: y <= r.start), true) THEN r."end" ELSE x END) ELSE list_append(w.lanes, r."end") END AS lanes,
        CASE WHEN list_min(w.lanes) <= r.start THEN list_position(list_transform(w.lanes, lambda y: y <= r.start), true) - 1 ELSE len(w.lanes) END AS lane""",
        'camera_id, event_id, start, "end", CAST(lane AS INT) AS lane',
        order="start, event_id",
    ),
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("camera_id", "event_id", temporal.micros(F.col("ts")).alias("start"))
    return folds.interval_lanes(rows.withColumn("end", F.col("start") + (F.col("event_id") % 97 + 1) * 60_000_000), ["camera_id"], "start", "end")


#: Four hashes, 3, 8 and 24 bits apart from the first.
HASHES = (0, 7, 255, 16777215)
_HASH = f"list_extract({list(HASHES)}::BIGINT[], CAST(k % 4 + 1 AS INT))"


def hashed(spark, sf_dir):
    return events(spark, sf_dir).select("camera_id", "event_id", F.element_at(F.array(*[F.lit(x).cast("long") for x in HASHES]), F.col("k") % 4 + 1).alias("hash"))


@plan(
    "win_10_near_duplicates",
    walk(f"SELECT camera_id, event_id, {_HASH} AS hash FROM e", "hash AS anchor, true AS kept", "CASE WHEN bit_count(xor(w.anchor, r.hash)) > 4 THEN r.hash ELSE w.anchor END AS anchor, bit_count(xor(w.anchor, r.hash)) > 4 AS kept", "camera_id, event_id, hash", "kept", "event_id"),
)
def _(spark, sf_dir):
    return folds.keep_changed(hashed(spark, sf_dir), ["camera_id"], "event_id", "hash", 4)
