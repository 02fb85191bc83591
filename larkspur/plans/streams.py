"""Streaming queries, run over the events table to the end; their batch twins are the window queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import folds
from larkspur.plans import plan
from larkspur.plans.reports import CAPPED_SQL, watchdog_sql
from larkspur.plans.sql import EVENTS, walk
from larkspur.plans.temporal import CONFIRM_SQL, cooldown_sql
from larkspur.session import shared_folder, stream_session
from larkspur.sources.events import LABEL_OF
from larkspur.sources.events import events_view as events
from larkspur.streaming import events as live
from larkspur.streaming import stateful


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.create_map(*[F.lit(x) for kv in LABEL_OF.items() for x in kv])[F.col("event_type")]
    rows = live.event_stream(spark, f"{sf_dir}/events.parquet*")
    return rows.select("event_id", "ts", F.concat(F.lit("cam_"), F.col("user_id") % 5).alias("camera_id"), label.alias("label"))


def _run(stream: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """All of a stream's output, by a query that ends when its input does, as a table of ``spark`` (the stream's own session, if none is given)."""
    spark = spark or stream.sparkSession
    folder = shared_folder(spark, "stream")
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@plan("str_01_live_confirm", CONFIRM_SQL)
def _(spark, sf_dir):
    return _run(stateful.confirm(_micros(stream_session(spark), sf_dir), 3, 1800.0), spark)


@plan("str_03_live_cooldown", cooldown_sql("camera_id, label", "7200", "o.event_id, o.camera_id, o.label"))
def _(spark, sf_dir):
    return _run(live.cooldown(_stream(stream_session(spark), sf_dir), 7200.0), spark)


@plan(
    "str_06_live_sessions",
    f"""WITH {EVENTS}, a AS (SELECT camera_id, label, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 120 MINUTE THEN 1 ELSE 0 END AS cut FROM e WINDOW w AS (PARTITION BY camera_id, label ORDER BY ts)),
    b AS (SELECT *, sum(cut) OVER (PARTITION BY camera_id, label ORDER BY ts) AS g FROM a),
    c AS (SELECT camera_id, label, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM b GROUP BY camera_id, label, g)
    SELECT camera_id, label, n FROM c WHERE "end" + INTERVAL 120 MINUTE <= (SELECT max(ts) FROM e) - INTERVAL 10 MINUTE""",
)
def _(spark, sf_dir):
    """Lanes whose end the watermark has passed when the input ends."""
    return _run(live.session_lanes(_stream(spark, sf_dir), "120 minutes")).select("camera_id", "label", "n")


@plan(
    "str_17_gate_chain",
    f"""WITH {EVENTS} SELECT event_id, CASE WHEN k % 31 = 0 THEN 'enabled' WHEN k % 29 = 0 THEN 'muted' WHEN k % 23 = 0 THEN 'camera_muted' WHEN label = 'motion' THEN 'label_off' WHEN score < 0.3 THEN 'below_score' WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 'off_schedule' END AS reason FROM e""",
)
def _(spark, sf_dir):
    k, h = F.col("k"), F.hour("ts")
    gates = {"enabled": k % 31 != 0, "muted": k % 29 == 0, "camera_muted": k % 23 == 0, "label_off": F.col("label") == "motion", "below_score": F.col("score") < 0.3, "off_schedule": (h >= 22) | (h < 6)}
    return events(spark, sf_dir).select("event_id", live.skip_reason(gates).alias("reason"))


@plan("str_02_live_tracks")
def _(spark, sf_dir):
    rows = _stream(stream_session(spark), sf_dir)
    at = F.col("event_id")
    box = {"x1": at * 37 % 300, "y1": at * 53 % 200, "x2": at * 37 % 300 + 80, "y2": at * 53 % 200 + 80}
    found = rows.select("camera_id", F.unix_micros("ts").alias("us"), "label", (at % 100 / 100.0).alias("score"), *[v.cast("double").alias(k) for k, v in box.items()])
    return _run(live.live_tracks(found), spark)


def _micros(spark, sf_dir):
    return _stream(spark, sf_dir).withColumn("us", F.unix_micros("ts"))


@plan("str_07_live_capped_triggers", f"SELECT camera_id, event_id FROM ({CAPPED_SQL})")
def _(spark, sf_dir):
    rows = _micros(stream_session(spark), sf_dir).select("camera_id", "event_id", "us", F.when(F.col("event_id") % 997 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"))
    return _run(folds.capped_cooldown(rows, ["camera_id"], "us", "day", 4 * 3600.0, 2), spark).select("camera_id", "event_id")


@plan(
    "str_08_live_hysteresis",
    f"""WITH {EVENTS}, a AS (SELECT camera_id, event_id, epoch_us(ts) AS us, event_id * 37 % 100 AS v FROM e),
    b AS (SELECT *, CASE WHEN v >= 90 THEN 1 WHEN v < 30 THEN 0 END AS m FROM a),
    c AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY camera_id ORDER BY us, event_id), 0) AS s FROM b),
    d AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY camera_id ORDER BY us, event_id), 0) AS p FROM c) SELECT camera_id, event_id, CAST(v AS DOUBLE) AS v FROM d WHERE s = 1 AND p = 0""",
)
def _(spark, sf_dir):
    rows = _micros(stream_session(spark), sf_dir).select("camera_id", "event_id", "us", (F.col("event_id") * 37 % 100).cast("double").alias("v"))
    return _run(folds.latch(rows, ["camera_id"], "us", "v", 90.0, 30.0), spark).select("camera_id", "event_id", "v")


@plan("str_11_live_watchdog", f"SELECT camera_id, event_id, online, change FROM ({watchdog_sql('event_id * 37 % 100 < 70')})")
def _(spark, sf_dir):
    rows = _micros(stream_session(spark), sf_dir).select("camera_id", "event_id", (F.col("event_id") * 37 % 100 < 70).alias("online"), "us")
    return _run(folds.watchdog(rows, ["camera_id"], "us", "online", 1800.0), spark).where("change is not null").select("camera_id", "event_id", "online", "change")


@plan("str_12_live_pre_roll", f"WITH {EVENTS}, f AS (SELECT event_id, camera_id, epoch_us(ts) AS us, label FROM e), t AS (SELECT * FROM f WHERE label = 'person' AND event_id % 10 = 0) SELECT f.event_id, t.event_id AS trigger FROM f JOIN t ON f.camera_id = t.camera_id AND f.us BETWEEN t.us - 600000000 AND t.us + 300000000")
def _(spark, sf_dir):
    own = stream_session(spark)
    triggers = _stream(own, sf_dir).where("label = 'person' AND event_id % 10 = 0")
    return _run(live.around_live(_stream(own, sf_dir), triggers, "10 minutes", "5 minutes"), spark)


@plan("str_18_live_unlocks", f"WITH {EVENTS} SELECT bird_species, arg_min(event_id, (ts, event_id)) AS event_id FROM e WHERE bird_species IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    rows = live.event_stream(spark, f"{sf_dir}/events.parquet*").where("event_type = 'click'")
    rows = rows.select("event_id", "ts", F.concat(F.lit("species_"), F.get_json_object("props", "$.k").cast("int") % 12).alias("bird_species"))
    folder = shared_folder(spark, "unlocks")
    live.first_unlocks(rows, "bird_species", folder).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("bird_species string, event_id long").parquet(f"{folder}/unlocks/batch=*")


STALE_S, AFTER_S = 3600, 1800


@plan(
    "str_11_silent_watchdog",
    f"""WITH {EVENTS}, s AS (SELECT camera_id, event_id, epoch_us(ts) AS us, event_id * 37 % 100 < 70 AS up, lead(epoch_us(ts)) OVER (PARTITION BY camera_id ORDER BY ts, event_id) AS following FROM e),
    t AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 AS mark FROM e), f AS (SELECT camera_id, max(us) AS final FROM s GROUP BY 1),
    p AS (SELECT camera_id, us, event_id, up FROM s UNION ALL SELECT camera_id, us + {STALE_S}000000, event_id, false FROM s, t WHERE up AND us + {STALE_S}000000 < coalesce(following, mark + 1)),
    q AS (SELECT *, lag(up, 1, true) OVER (PARTITION BY camera_id ORDER BY us, event_id) AS was FROM p),
    c AS (SELECT *, lead(us) OVER (PARTITION BY camera_id ORDER BY us, event_id) AS ended FROM q WHERE up <> was),
    d AS (SELECT c.camera_id, us, ended, us + {AFTER_S}000000 <= coalesce(ended - 1, greatest(mark, final)) AS told FROM c JOIN f ON f.camera_id = c.camera_id, t WHERE NOT up)
    SELECT camera_id, us, 'down' AS change FROM d UNION ALL SELECT camera_id, us + {AFTER_S}000000, 'alert' FROM d WHERE told UNION ALL SELECT camera_id, ended, 'recovered' FROM d WHERE told AND ended IS NOT NULL""",
)
def _(spark, sf_dir):
    """Cameras that say they are down, and cameras that say nothing for an hour."""
    rows = _micros(stream_session(spark), sf_dir).select("camera_id", "ts", "us", "event_id", (F.col("event_id") * 37 % 100 < 70).alias("online"))
    return _run(stateful.watchdog(rows, float(STALE_S), float(AFTER_S)), spark)


COOLDOWNS = {"person": 1800.0, "cat": 3600.0, "bird": 7200.0, "squirrel": 7200.0}
_EARLY = {"enabled": "event_id % 31 = 0", "muted": "event_id % 29 = 0", "camera_muted": "event_id % 23 = 0", "label_off": "label = 'motion'", "below_score": "event_id * 37 % 100 < 30", "suppressed": "event_id % 19 = 0"}
_LATE = {"off_schedule": "hour(ts) >= 22 OR hour(ts) < 6", "silent": "event_id % 17 = 0"}


def _reason(gates: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {stopped} THEN '{gate}'" for gate, stopped in gates.items()) + " END"


def _gates_sql() -> str:
    anchor = "CASE r.label " + " ".join(f"WHEN '{k}' THEN w.last_{k}" for k in COOLDOWNS) + " END"
    wait = "CASE r.label " + " ".join(f"WHEN '{k}' THEN {int(v * 1e6)}" for k, v in COOLDOWNS.items()) + " END"
    reason = f"coalesce(r.early, CASE WHEN r.us - w.last < 600000000 THEN 'rate_limited' END, CASE WHEN r.us - {anchor} < {wait} THEN 'cooling_down' END, r.late)"
    first = ["coalesce(early, late) AS reason", "CASE WHEN early IS NULL AND late IS NULL THEN us END AS last", *(f"CASE WHEN early IS NULL AND late IS NULL AND label = '{k}' THEN us END AS last_{k}" for k in COOLDOWNS)]
    after = [f"{reason} AS reason", f"CASE WHEN {reason} IS NULL THEN r.us ELSE w.last END AS last", *(f"CASE WHEN {reason} IS NULL AND r.label = '{k}' THEN r.us ELSE w.last_{k} END AS last_{k}" for k in COOLDOWNS)]
    return walk(f"SELECT camera_id, event_id, label, epoch_us(ts) AS us, {_reason(_EARLY)} AS early, {_reason(_LATE)} AS late FROM e", ", ".join(first), ", ".join(after), "event_id, reason")


@plan("str_17_live_gates", _gates_sql())
def _(spark, sf_dir):
    """All ten gates: six before the rate limit of ten minutes a camera and the cooldown of its labels, two after."""
    rows = _micros(stream_session(spark), sf_dir)
    given = rows.select("*", F.expr(_reason(_EARLY)).alias("early"), F.expr(_reason(_LATE)).alias("late"))
    return _run(stateful.gate_chain(given, 600.0, COOLDOWNS), spark)


def _blobs(rows):
    """A frame per event: one or two blobs that wander with the event's number."""
    n = F.col("event_id")
    one = [n * 7 % 900, n * 3 % 500, F.lit(60), F.lit(40)]
    two = [F.lit(100) + n % 50, F.lit(100) + n % 40, F.lit(50), F.lit(50)]
    flat = lambda box: F.array(*[c.cast("double") for c in box])
    return rows.select("camera_id", "event_id", "us", F.when(n % 3 == 0, F.concat(flat(one), flat(two))).otherwise(flat(two)).alias("boxes"))


def _nearest(blob: str, tracks: str) -> str:
    """SQL of struct(s, m): the highest affinity of a blob to one of the tracks, and minus that track's number (ties: the smaller number)."""
    both = f"greatest(least({blob}.x + {blob}.w, t.x + t.w) - greatest({blob}.x, t.x), 0) * greatest(least({blob}.y + {blob}.h, t.y + t.h) - greatest({blob}.y, t.y), 0)"
    share = f"({both}) / ({blob}.w * {blob}.h + t.w * t.h - {both})"
    apart = f"sqrt(({blob}.x + {blob}.w / 2 - t.x - t.w / 2) ** 2 + ({blob}.y + {blob}.h / 2 - t.y - t.h / 2) ** 2)"
    near = f"greatest(0, 1 - {apart} / (4 * (sqrt({blob}.w ** 2 + {blob}.h ** 2) + 1)))"
    return f"list_sort(list_transform({tracks}, lambda t: {{'s': CASE WHEN {share} >= 0.1 THEN 1 + {share} ELSE {near} END, 'm': -t.n}}), 'DESC')[1]"


def _blobs_sql(out: str) -> str:
    """A recursion from frame to frame of a camera: ``live`` are its tracks as they were last seen, ``t1`` and ``t2`` those of the frame's blobs."""
    box = lambda *xywh: "{" + ", ".join(f"'{k}': ({v})::DOUBLE" for k, v in zip("xywh", xywh, strict=True)) + "}"
    one, two = box("event_id * 7 % 900", "event_id * 3 % 500", "60", "40"), box("100 + event_id % 50", "100 + event_id % 40", "50", "50")
    seen = lambda n, b: f"{{'n': {n}, 'x': {b}.x, 'y': {b}.y, 'w': {b}.w, 'h': {b}.h, 'misses': 0}}"
    return f"""WITH RECURSIVE {EVENTS},
    r AS MATERIALIZED (SELECT camera_id, event_id, epoch_us(ts) AS us, CASE WHEN event_id % 3 = 0 THEN {one} ELSE {two} END AS a, CASE WHEN event_id % 3 = 0 THEN {two} END AS b, row_number() OVER (PARTITION BY camera_id ORDER BY ts, event_id) AS rn FROM e),
    w AS (SELECT camera_id, event_id, us, a, b, rn, [{seen("0::BIGINT", "a")}] || CASE WHEN b IS NULL THEN [] ELSE [{seen("1::BIGINT", "b")}] END AS live, CASE WHEN b IS NULL THEN 1 ELSE 2 END::BIGINT AS following, 0::BIGINT AS t1, CASE WHEN b IS NOT NULL THEN 1 END::BIGINT AS t2 FROM r WHERE rn = 1
      UNION ALL
      SELECT camera_id, event_id, us, a, b, rn, [{seen("t1", "a")}] || CASE WHEN b IS NULL THEN [] ELSE [{seen("t2", "b")}] END
             || list_transform(list_filter(old, lambda t: t.n <> t1 AND t.n IS DISTINCT FROM t2 AND t.misses < 4), lambda t: {{'n': t.n, 'x': t.x, 'y': t.y, 'w': t.w, 'h': t.h, 'misses': t.misses + 1}}), f2, t1, t2
      FROM (SELECT *, CASE WHEN b IS NULL THEN NULL WHEN m2.s > 0.25 THEN -m2.m ELSE f1 END AS t2, f1 + CASE WHEN b IS NULL OR m2.s > 0.25 THEN 0 ELSE 1 END AS f2
        FROM (SELECT *, {_nearest("b", "list_filter(old, lambda t: t.n <> t1)")} AS m2
          FROM (SELECT *, CASE WHEN m1.s > 0.25 THEN -m1.m ELSE f0 END AS t1, f0 + CASE WHEN m1.s > 0.25 THEN 0 ELSE 1 END AS f1
            FROM (SELECT r.*, w.live AS old, w.following AS f0, {_nearest("r.a", "w.live")} AS m1 FROM w JOIN r ON r.camera_id = w.camera_id AND r.rn = w.rn + 1))))),
    o AS (SELECT camera_id, event_id, us, 0 AS place, t1 AS track, a AS box FROM w UNION ALL SELECT camera_id, event_id, us, 1, t2, b FROM w WHERE b IS NOT NULL)
    {out}"""


@plan(
    "str_13_blob_tracks",
    _blobs_sql(
        """, c AS (SELECT camera_id, track, count(*) AS age, arg_min({'x': box.x + box.w / 2, 'y': box.y + box.h / 2}, (us, event_id)) AS h, arg_max({'x': box.x + box.w / 2, 'y': box.y + box.h / 2}, (us, event_id)) AS l FROM o GROUP BY 1, 2),
    n AS (SELECT camera_id, track, age, sqrt((l.x - h.x) ** 2 + (l.y - h.y) ** 2) AS net FROM c)
    SELECT camera_id, track, age, round(net, 6) AS net, age >= 3 AND net >= 51.2 AS coherent FROM n"""
    ),
)
def _(spark, sf_dir):
    rows = _blobs(events(spark, sf_dir).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))))
    found = folds.coherent_tracks(folds.blob_tracks(rows, ["camera_id"], "us", "boxes"), ["camera_id"], "us", "boxes", 1280.0)
    return found.withColumn("net", F.round("net", 6))


@plan("str_13_live_blob_tracks", _blobs_sql("SELECT camera_id, event_id, place, track FROM o"))
def _(spark, sf_dir):
    tracked = _run(folds.blob_tracks(_blobs(_micros(stream_session(spark), sf_dir)), ["camera_id"], "us", "boxes"), spark)
    return tracked.select("camera_id", "event_id", F.posexplode("tracks").alias("place", "track"))
