"""Reports and rules over several operators: coverage, capture statistics, timelines, detectors, zones."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.functions import geo, rules
from larkspur.operators import folds, goals, store, temporal
from larkspur.plans import plan
from larkspur.plans.scalars import _diamond
from larkspur.plans.sql import EVENTS, WEATHER, walk
from larkspur.plans.temporal import _HASH, hashed
from larkspur.sources.events import events_view as events
from larkspur.sources.events import row_ify
from larkspur.sources.events import weather_view as weather


@plan("agg_13_class_peaks", f"WITH {EVENTS} SELECT camera_id, label, count(*) AS tracks, max(score) AS best, count(*) FILTER (score >= 0.55) AS confirmed FROM e GROUP BY 1, 2")
def _(spark, sf_dir):
    return events(spark, sf_dir).groupBy("camera_id", "label").agg(F.count("*").alias("tracks"), F.max("score").alias("best"), F.count_if(F.col("score") >= 0.55).alias("confirmed"))


@plan("agg_14_cloud_coverage", f"WITH {EVENTS} SELECT count(*) AS events_total, count(*) FILTER (event_id % 3 = 0) AS with_sidecar, min(CASE WHEN event_id % 3 = 0 THEN ts END) AS first_ts, max(CASE WHEN event_id % 3 = 0 THEN ts END) AS last_ts FROM e")
def _(spark, sf_dir):
    has = F.col("event_id") % 3 == 0
    return events(spark, sf_dir).agg(F.count("*").alias("events_total"), F.count_if(has).alias("with_sidecar"), F.min(F.when(has, F.col("ts"))).alias("first_ts"), F.max(F.when(has, F.col("ts"))).alias("last_ts"))


@plan("agg_18_capture_stats", f"WITH {EVENTS}, x AS (SELECT event_id, CASE WHEN k % 3 = 0 THEN 'too_dark(' || k || ')' WHEN k % 3 = 1 THEN 'scene_' || (k % 2) || '(x)' ELSE 'pink(y)' END AS reason FROM e) SELECT regexp_extract(reason, '^([^(]*)', 1) AS head, count(*) AS n, arg_min(reason, event_id) AS example, count(*) FILTER (reason LIKE 'scene%') AS scene FROM x GROUP BY 1")
def _(spark, sf_dir):
    k = F.col("k")
    reason = F.when(k % 3 == 0, F.concat(F.lit("too_dark("), k, F.lit(")"))).when(k % 3 == 1, F.concat(F.lit("scene_"), k % 2, F.lit("(x)"))).otherwise("pink(y)")
    rows = events(spark, sf_dir).select("event_id", reason.alias("reason"))
    return rows.groupBy(rules.reason_head(F.col("reason")).alias("head")).agg(F.count("*").alias("n"), F.min_by("reason", "event_id").alias("example"), F.count_if(F.col("reason").startswith("scene")).alias("scene"))


@plan("agg_23_fps_ratchet", f"WITH {EVENTS}, r AS (SELECT camera_id, score, row_number() OVER (PARTITION BY camera_id ORDER BY event_id DESC) AS rn FROM e), m AS (SELECT camera_id, avg(score) AS mean, count(*) AS n FROM r WHERE rn <= 3 GROUP BY 1) SELECT camera_id, CASE WHEN n = 3 AND mean < 0.6 THEN CASE WHEN mean * 20 <= 5 THEN 5 WHEN mean * 20 <= 10 THEN 10 WHEN mean * 20 <= 15 THEN 15 ELSE 20 END ELSE 20 END AS fps FROM m")
def _(spark, sf_dir):
    w = Window.partitionBy("camera_id").orderBy(F.desc("event_id"))
    last = events(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("camera_id").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    bucket = F.array_min(F.filter(F.array(*map(F.lit, (5, 10, 15, 20))), lambda b: b >= F.col("mean") * 20))
    return last.select("camera_id", F.when((F.col("n") == 3) & (F.col("mean") < 0.6), bucket).otherwise(20).alias("fps"))


@plan("agg_24_bytes_today", f"WITH {EVENTS} SELECT camera_id, CAST(sum(event_id % 1000 + 1) AS BIGINT) AS bytes FROM e WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY 1")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")).groupBy("camera_id").agg(F.sum(F.col("event_id") % 1000 + 1).alias("bytes"))


@plan("agg_27_live_evidence", f"WITH {EVENTS}, x AS (SELECT label, score FROM e WHERE ts > TIMESTAMP '2024-01-15 11:00:00' AND ts <= TIMESTAMP '2024-01-15 12:00:00'), s AS (SELECT label, count(*) AS raw, count(*) FILTER (score >= 0.5) AS passed, count(*) FILTER (score < 0.5) AS below FROM x GROUP BY 1), c(label) AS (VALUES ('cat'), ('bird'), ('fox')) SELECT coalesce(s.label, c.label) AS label, coalesce(raw, 0) AS raw, coalesce(passed, 0) AS passed, coalesce(below, 0) AS below, s.label IS NULL AS missing FROM s FULL JOIN c ON s.label = c.label")
def _(spark, sf_dir):
    near = events(spark, sf_dir).where((F.col("ts") > F.lit("2024-01-15 11:00:00").cast("timestamp_ntz")) & (F.col("ts") <= F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")))
    seen = near.groupBy("label").agg(F.count("*").alias("raw"), F.count_if(F.col("score") >= 0.5).alias("passed"), F.count_if(F.col("score") < 0.5).alias("below"), F.lit(False).alias("missing"))
    wanted = F.broadcast(spark.createDataFrame([("cat",), ("bird",), ("fox",)], "label string"))  # a fixed table
    return seen.join(wanted, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "passed", "below")], F.coalesce("missing", F.lit(True)).alias("missing"))


@plan("agg_29_batch_summary", f"WITH {EVENTS} SELECT camera_id, count(*) AS images, count(*) FILTER (len(labels) > 0) AS with_detections, round(avg(CASE WHEN k <> 7 THEN value END), 6) AS avg_ms FROM e GROUP BY 1")
def _(spark, sf_dir):
    return events(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("images"), F.count_if(F.size("labels") > 0).alias("with_detections"), F.round(F.avg(F.when(F.col("k") != 7, F.col("value"))), 6).alias("avg_ms"))


@plan("agg_31_encode_check", f"WITH {EVENTS} SELECT event_id, least(25.0, greatest(1.0, k / 4.0)) AS fps, least(100.0, round(100.0 * k / 90, 2)) AS coverage, k < 0.95 * 90 AS short FROM e")
def _(spark, sf_dir):
    k = F.col("k")
    return events(spark, sf_dir).select("event_id", F.least(F.lit(25.0), F.greatest(F.lit(1.0), k / 4.0)).alias("fps"), F.least(F.lit(100.0), F.round(100.0 * k / 90, 2)).alias("coverage"), (k < 0.95 * 90).alias("short"))


@plan(
    "win_08_majority_label",
    walk(
        "SELECT camera_id, event_id, label FROM e",
        "[label] AS votes, label AS dominant",
        """list_append(w.votes, r.label)[-5:] AS votes,
        CASE WHEN len(list_filter(list_append(w.votes, r.label)[-5:], lambda x: x = w.dominant)) < list_max(list_transform(list_append(w.votes, r.label)[-5:], lambda v: len(list_filter(list_append(w.votes, r.label)[-5:], lambda x: x = v))))
             THEN list_extract(list_sort(list_transform(list_append(w.votes, r.label)[-5:], lambda v, i: {'n': len(list_filter(list_append(w.votes, r.label)[-5:], lambda x: x = v)), 'i': i, 'v': v})), -1).v ELSE w.dominant END AS dominant""",
        "camera_id, event_id, label, dominant",
        order="event_id",
    ),
)
def _(spark, sf_dir):
    return folds.majority(events(spark, sf_dir).select("camera_id", "event_id", "label"), ["camera_id"], "event_id", "label")


@plan(
    "win_09_freeze_runs",
    walk(f"SELECT camera_id, event_id, {_HASH} AS hash FROM e", "hash AS anchor, 0 AS duplicates", "CASE WHEN bit_count(xor(w.anchor, r.hash)) <= 3 THEN w.anchor ELSE r.hash END AS anchor, CASE WHEN bit_count(xor(w.anchor, r.hash)) <= 3 THEN w.duplicates + 1 ELSE 0 END AS duplicates", "camera_id, event_id, hash, CAST(duplicates AS INT) AS duplicates", order="event_id"),
)
def _(spark, sf_dir):
    return folds.freeze_runs(hashed(spark, sf_dir), ["camera_id"], "event_id", "hash")


@plan(
    "win_16_mean_interval",
    walk(
        "SELECT camera_id, event_id, epoch_us(ts) AS us FROM e",
        "CAST(NULL AS DOUBLE) AS mean",
        "CASE WHEN (r.us - w.us) / 1000000.0 > 3600 THEN NULL WHEN w.mean IS NULL THEN CAST((r.us - w.us) / 1000000.0 AS DOUBLE) ELSE 0.9::DOUBLE * w.mean + 0.1::DOUBLE * CAST((r.us - w.us) / 1000000.0 AS DOUBLE) END AS mean",
        "camera_id, event_id, us, round(mean, 6) AS mean",
    ),
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("camera_id", "event_id", temporal.micros(F.col("ts")).alias("us"))
    return folds.moving_interval(rows, ["camera_id"], "us", 0.1, 3600.0).withColumn("mean", F.round("mean", 6))


@plan("win_27_sun_window", f"WITH {EVENTS} SELECT event_id, ts - INTERVAL 2520 SECOND AS start, ts + INTERVAL 1080 SECOND AS \"end\" FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", (F.col("ts") - F.expr("interval 2520 seconds")).alias("start"), (F.col("ts") + F.expr("interval 1080 seconds")).alias("end"))


_RUNS = """r0 AS (SELECT camera_id, event_id, CASE WHEN k < 20 THEN 'masked' WHEN k < 40 THEN 'predicted' WHEN k < 60 THEN 'weak' ELSE 'confirmed' END AS status FROM e),
    r1 AS (SELECT *, CASE WHEN status IS DISTINCT FROM lag(status) OVER w THEN 1 ELSE 0 END AS cut FROM r0 WINDOW w AS (PARTITION BY camera_id ORDER BY event_id)),
    r2 AS (SELECT *, sum(cut) OVER (PARTITION BY camera_id ORDER BY event_id) AS run FROM r1),
    r3 AS (SELECT camera_id, run, status, min(event_id) AS start, max(event_id) AS last FROM r2 GROUP BY 1, 2, 3),
    r4 AS (SELECT camera_id, status, start, coalesce(lead(start) OVER (PARTITION BY camera_id ORDER BY start), last) AS "end" FROM r3)"""


def _status_runs(spark, sf_dir):
    k = F.col("k")
    status = F.when(k < 20, "masked").when(k < 40, "predicted").when(k < 60, "weak").otherwise("confirmed")
    runs = temporal.islands(events(spark, sf_dir), ["camera_id"], "event_id", status)
    after = F.lead("start").over(Window.partitionBy("camera_id").orderBy("start"))
    return runs.select("camera_id", F.col("flag").alias("status"), "start", F.coalesce(after, F.col("end")).alias("end"))


@plan("win_28_status_runs", f'WITH {EVENTS}, {_RUNS} SELECT camera_id, status, start, "end" FROM r4')
def _(spark, sf_dir):
    return _status_runs(spark, sf_dir)


@plan("win_29_track_tiers", f"""WITH {EVENTS}, {_RUNS} SELECT camera_id, CASE WHEN sum(CASE WHEN status = 'masked' THEN "end" - start ELSE 0 END) >= 0.95 * sum("end" - start) THEN 'masked' ELSE 'confirmed' END AS tier FROM r4 GROUP BY 1""")
def _(spark, sf_dir):
    span = F.col("end") - F.col("start")
    masked = F.sum(F.when(F.col("status") == "masked", span).otherwise(0)) >= 0.95 * F.sum(span)
    return _status_runs(spark, sf_dir).groupBy("camera_id").agg(F.when(masked, "masked").otherwise("confirmed").alias("tier"))


@plan("fn_20_detector_scales", f"WITH {WEATHER} SELECT ts, least(1.0, gust / 3000) AS thunder, least(1.0, rain / 20) AS heavy FROM w WHERE gust IS NOT NULL AND rain IS NOT NULL")
def _(spark, sf_dir):
    rows = weather(spark, sf_dir).where("gust is not null and rain is not null")
    return rows.select("ts", F.least(F.lit(1.0), F.col("gust") / 3000).alias("thunder"), F.least(F.lit(1.0), F.col("rain") / 20).alias("heavy"))


@plan("fn_21_thresholds", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 4 = 0 THEN 0.55 ELSE k / 100.0 END AS spawn, least(CASE WHEN k % 5 = 0 THEN 0.2 ELSE k / 50.0 END, CASE WHEN k % 4 = 0 THEN 0.55 ELSE k / 100.0 END) AS floor, least(k / 80.0, 0.95) AS iou FROM e")
def _(spark, sf_dir):
    k = F.col("k")
    or_default = lambda c, d: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d))
    spawn = or_default(F.when(k % 4 == 0, 0.0).otherwise(k / 100.0), 0.55)
    return events(spark, sf_dir).select("event_id", spawn.alias("spawn"), F.least(or_default(F.when(k % 5 == 0, 0.0).otherwise(k / 50.0), 0.2), spawn).alias("floor"), F.least(k / 80.0, F.lit(0.95)).alias("iou"))


@plan("fn_24_coercion", f"WITH {EVENTS} SELECT event_id, CASE k % 4 WHEN 0 THEN k ELSE -1 END AS number, CASE k % 4 WHEN 1 THEN 'true' WHEN 2 THEN 'false' ELSE 'bad' END AS flag FROM e")
def _(spark, sf_dir):
    k = F.col("k")
    text = F.when(k % 4 == 0, F.concat(F.lit(" "), k)).when(k % 4 == 1, "Yes").when(k % 4 == 2, "off").otherwise("?")
    flag = F.coalesce(rules.to_bool(F.when(k % 4 > 0, text)).cast("string"), F.lit("bad"))
    return events(spark, sf_dir).select("event_id", F.coalesce(F.trim(text).try_cast("int"), F.lit(-1)).alias("number"), flag.alias("flag"))


@plan(
    "fn_28_text_jitter",
    f"""WITH {EVENTS} SELECT event_id, abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(event_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda h, x: (((h * 31 + x + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648)) AS h FROM e""",
)
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rules.string_hash(F.col("event_id").cast("string")).alias("h"))


@plan("fn_32_flatten_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


@plan("jn_04_dossier_events", f"WITH {EVENTS} SELECT event_id FROM e WHERE bird_species IN ('species_1', 'species_2')")
def _(spark, sf_dir):
    found = F.array(F.struct(F.col("label"), F.concat(F.lit(" "), "bird_species").alias("species_latin")))
    rows = events(spark, sf_dir).select("event_id", found.alias("detections"))
    return rows.where(F.exists("detections", lambda d: F.trim(d["species_latin"]).isin("species_1", "species_2"))).select("event_id")


@plan("jn_16_field_thresholds", f"WITH {WEATHER} SELECT ts, coalesce(gust >= 100, false) AS gust_on, coalesce(rain >= 80, false) AS rain_on FROM w")
def _(spark, sf_dir):
    limits = F.create_map(*map(F.lit, ("gust", 100.0, "rain", 80.0)))
    return weather(spark, sf_dir).select("ts", F.coalesce(F.col("gust") >= limits[F.lit("gust")], F.lit(False)).alias("gust_on"), F.coalesce(F.col("rain") >= limits[F.lit("rain")], F.lit(False)).alias("rain_on"))


@plan("jn_18_stem_states", f"WITH {EVENTS} SELECT event_id % 2 = 0 AS clip, event_id % 3 = 0 AS manifest, count(*) AS n FROM e WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY 1, 2")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id")
    clips, manifests = rows.where("event_id % 2 = 0").withColumn("c", F.lit(True)), rows.where("event_id % 3 = 0").withColumn("m", F.lit(True))
    both = clips.join(manifests, "event_id", "full")
    return both.groupBy(F.col("c").isNotNull().alias("clip"), F.col("m").isNotNull().alias("manifest")).agg(F.count("*").alias("n"))


@plan("geo_10_zones", f"WITH {EVENTS} SELECT event_id, label IN ('cat', 'bird') AS zoned FROM e WHERE label NOT IN ('cat', 'bird') OR abs((x1 + x2) // 2 - 600) + abs(y2 - 400) <= 300")
def _(spark, sf_dir):
    scoped = F.col("label").isin("cat", "bird")  # labels that no zone names pass
    inside = geo.in_polygon(F.floor((F.col("x1") + F.col("x2")) / 2), F.col("y2"), _diamond())
    return events(spark, sf_dir).where(~scoped | inside).select("event_id", scoped.alias("zoned"))


@plan("top_03_clamped_page", f"WITH {EVENTS}, x AS (SELECT event_id, time, row_number() OVER (ORDER BY time DESC, event_id DESC) - 1 AS r, count(*) OVER () AS n FROM e WHERE label = 'cat') SELECT event_id, time FROM x WHERE r // 10 = least(100000, ceil(n / 10.0) - 1)")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).where("label = 'cat'")
    last = max(0, -(-rows.count() // 10) - 1)
    return store.page(rows, 10, 10 * min(100_000, last)).select("event_id", "time")


@plan("top_06_newest", f"WITH {EVENTS} SELECT event_id, score FROM e ORDER BY ts DESC LIMIT 2000")
def _(spark, sf_dir):
    return store.page(events(spark, sf_dir), 2000, 0, "ts").select("event_id", "score")


@plan("top_08_reject_reasons", f"WITH {EVENTS} SELECT bird_species AS value, count(*) AS n FROM e WHERE bird_species IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 3")
def _(spark, sf_dir):
    return store.top_counts(events(spark, sf_dir), "bird_species", 3)


@plan("top_10_pinboard", f"WITH {EVENTS}, x AS (SELECT label, count(*) AS n, avg(score) AS ratio, max(ts) AS done FROM e GROUP BY 1) SELECT label, row_number() OVER (ORDER BY CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END, CASE WHEN n % 2 = 0 THEN ratio END, done DESC) AS place FROM x")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("ratio"), F.max("ts").alias("done"))
    active = F.col("n") % 2 == 0
    w = Window.orderBy(F.when(active, 0).otherwise(1), F.when(active, F.col("ratio")).asc_nulls_last(), F.col("done").desc())  # a handful of goals
    return rows.select("label", F.row_number().over(w).cast("long").alias("place"))


@plan("set_01_camera_union", f"WITH {EVENTS} SELECT event_id, camera_id, time FROM e WHERE camera_id IN ('cam_0', 'cam_4') ORDER BY time DESC, event_id DESC LIMIT 100")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    both = rows.where("camera_id = 'cam_0'").unionByName(rows.where("camera_id = 'cam_4'"))
    return store.page(both, 100).select("event_id", "camera_id", "time")


@plan("set_04_overlap", f"WITH {EVENTS} SELECT event_id FROM e WHERE list_has_any(labels, ['person', 'squirrel'])")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(F.arrays_overlap("labels", F.array(F.lit("person"), F.lit("squirrel")))).select("event_id")


@plan("set_07_last_wins", f"WITH {EVENTS} SELECT camera_id, k, max(event_id) AS event_id FROM e GROUP BY 1, 2")
def _(spark, sf_dir):
    return events(spark, sf_dir).groupBy("camera_id", "k").agg(F.max_by("event_id", "ts").alias("event_id"))


@plan("src_09_row_ify", f"WITH {EVENTS} SELECT time, value FROM e")
def _(spark, sf_dir):
    """Payloads of a quarter hour and camera, as parallel arrays, become rows; a payload stays small however long the history is."""
    rows = events(spark, sf_dir).withColumn("slot", F.floor(temporal.micros(F.col("ts")) / 900_000_000))
    sent = rows.groupBy("camera_id", "slot").agg(F.array_sort(F.collect_list(F.struct("event_id", "time", "value"))).alias("all"))
    return row_ify(sent.select(F.col("all.time").alias("times"), F.col("all.value").alias("value")), "times", "value")


CAPPED_SQL = walk(
    "SELECT camera_id, event_id, epoch_us(ts) AS us, substr(time, 1, 10) AS day FROM e",
    "us AS last, day AS today, 1 AS n, true AS ok",
    """CASE WHEN r.us - w.last >= 14400000000 AND (r.day <> w.today OR w.n < 2) THEN r.us ELSE w.last END AS last, r.day AS today,
    CASE WHEN r.day = w.today THEN w.n ELSE 0 END + CASE WHEN r.us - w.last >= 14400000000 AND (r.day <> w.today OR w.n < 2) THEN 1 ELSE 0 END AS n,
    r.us - w.last >= 14400000000 AND (r.day <> w.today OR w.n < 2) AS ok""",
    "camera_id, event_id, us, day",
    "ok",
)


@plan("str_07_capped_triggers", CAPPED_SQL)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("camera_id", "event_id", temporal.micros(F.col("ts")).alias("us"), F.substring("time", 1, 10).alias("day"))
    return folds.capped_cooldown(rows, ["camera_id"], "us", "day", 4 * 3600.0, 2)


@plan(
    "str_09_recordings",
    walk(
        "SELECT camera_id, event_id, epoch_us(ts) AS us FROM e",
        "1 AS recording, us AS begun",
        "CASE WHEN r.us - w.us > 900000000 OR r.us - w.begun > 7200000000 THEN w.recording + 1 ELSE w.recording END AS recording, CASE WHEN r.us - w.us > 900000000 OR r.us - w.begun > 7200000000 THEN r.us ELSE w.begun END AS begun",
        "camera_id, event_id, us, CAST(recording AS INT) AS recording",
    ),
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("camera_id", "event_id", temporal.micros(F.col("ts")).alias("us"))
    return folds.recordings(rows, ["camera_id"], "us", 900.0, 7200.0)


@plan("str_18_first_unlock", f"WITH {EVENTS} SELECT bird_species, arg_min(event_id, (ts, event_id)) AS event_id FROM e WHERE bird_species IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return store.first_seen(events(spark, sf_dir), "bird_species").select("bird_species", "event_id")


@plan("fn_12_category_rules", f"WITH {EVENTS} SELECT event_id, CASE k % 4 WHEN 0 THEN 'squirrel' WHEN 1 THEN 'fox' WHEN 2 THEN 'hedgehog' ELSE 'none' END AS category FROM e")
def _(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("Sciurus vulgaris", "a Vulpes vulpes", "ERINACEUS europaeus", "Parus major"))), F.col("k") % 4 + 1)
    return events(spark, sf_dir).select("event_id", F.coalesce(rules.first_containing(name, rules.GENUS_RULES), F.lit("none")).alias("category"))


@plan("fn_13_model_vote", f"WITH {EVENTS} SELECT event_id, round((score + (k % 10) / 10.0) / 2, 6) AS score FROM e WHERE k % 3 = 0 AND k % 4 = 0")
def _(spark, sf_dir):
    k = F.col("k")
    likely, genus = F.when(k % 3 == 0, "weasel, x").otherwise("plate"), F.when(k % 4 == 0, "Sciurus").otherwise("Parus")
    both = likely.rlike("hare|mongoose|mink|weasel") & (rules.first_containing(genus, rules.GENUS_RULES) == "squirrel")
    return events(spark, sf_dir).where(both).select("event_id", F.round((F.col("score") + (k % 10) / 10.0) / 2, 6).alias("score"))


@plan("fn_19_severity_notify", f"WITH {EVENTS}, x AS (SELECT event_id, k % 17 = 0 AS ok, k % 5 > 0 AS armed, list_contains(labels, 'person') AS p, list_contains(labels, 'cat') AS c FROM e) SELECT event_id, CASE WHEN ok THEN 'off' WHEN p THEN 'alarm' WHEN c THEN 'info' ELSE 'off' END AS severity, NOT ok AND (p OR c) AND armed AS notify FROM x")
def _(spark, sf_dir):
    ok = F.col("k") % 17 == 0
    legacy = rules.alarm_level(F.lit("soft"), F.col("labels"), F.lit(False), ok)
    out = rules.composed_severity(legacy["level"], legacy["notify"], F.create_map(*map(F.lit, ("person", "alarm", "cat", "info"))), F.col("labels"), ok, F.col("k") % 5 > 0)
    return events(spark, sf_dir).select("event_id", out["severity"].alias("severity"), out["notify"].alias("notify"))


@plan("fn_29_nice_ticks", f"WITH {EVENTS}, x AS (SELECT event_id, k + 1 AS v, CASE WHEN k + 1 >= 100 THEN 100 WHEN k + 1 >= 10 THEN 10 ELSE 1 END AS p FROM e) SELECT event_id, CAST(p * CASE WHEN v / p < 1.5 THEN 1 WHEN v / p < 3 THEN 2 WHEN v / p < 7 THEN 5 ELSE 10 END AS DOUBLE) AS nice FROM x")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rules.nice_number((F.col("k") + 1).cast("double"), True).alias("nice"))


@plan("flt_19_known_fields", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'a' ELSE '' END AS keys FROM e")
def _(spark, sf_dir):
    values = F.map_from_arrays(F.array(F.when(F.col("k") % 2 == 0, "a").otherwise("b"), F.lit("c")), F.array(F.col("k"), F.col("k")))
    return events(spark, sf_dir).select("event_id", F.array_join(F.map_keys(store.known_fields(values, ["a", "z"])), ",").alias("keys"))


@plan("set_06_camera_config", f"WITH {EVENTS} SELECT camera_id AS id, count(*) > 0 AS there FROM e GROUP BY 1")
def _(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("camera_id").alias("id")).dropDuplicates(["id"]).withColumn("there", F.lit(True))


@plan("set_08_merged_page", f"WITH {EVENTS} SELECT event_id, camera_id, time FROM e WHERE list_has_any(labels, ['bird', 'cat']) AND camera_id IN ('cam_1', 'cam_2', 'cam_3') ORDER BY time DESC, event_id DESC LIMIT 24 OFFSET 24")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.col("camera_id").isin("cam_1", "cam_2", "cam_3") & F.arrays_overlap("labels", F.array(F.lit("bird"), F.lit("cat"))))
    return store.page(rows, 24, 24).select("event_id", "camera_id", "time")


@plan("win_25_window_ends", f"WITH {EVENTS} SELECT event_id, TIMESTAMP '2024-12-31 23:59:59' AS december, TIMESTAMP '2024-04-30 23:59:59' AS april, CAST(last_day(ts) AS TIMESTAMP) + INTERVAL 86399 SECOND AS month FROM e")
def _(spark, sf_dir):
    end = lambda name: rules.window_end(name, F.col("ts"))
    return events(spark, sf_dir).select("event_id", end("december").alias("december"), end("april_rolling_week").alias("april"), end("current_calendar_month").alias("month"))


@plan(
    "win_26_recap_periods",
    """SELECT * FROM (VALUES ('q1_2024', '2024-03-31', '2024-01-01', '2024-03-31'), ('q2_2024', '2024-06-30', '2024-04-01', '2024-06-30'), ('q3_2024', '2024-09-29', '2024-07-01', '2024-09-30'), ('year_2024', '2024-12-29', '2024-01-01', '2024-12-31')) t(period_id, run_on, start, "end")""",
)
def _(spark, sf_dir):
    out = temporal.recap_periods(spark.createDataFrame([(2024,)], "year int"))
    return out.select("period_id", *[F.col(c).cast("string").alias(c) for c in ("run_on", "start", "end")])


@plan(
    "str_11_disk_warnings",
    walk(
        "SELECT camera_id, event_id, epoch_us(ts) AS us FROM e WHERE value < 2.0",
        "us AS last, true AS ok",
        "CASE WHEN r.us - w.last > 86400000000 THEN r.us ELSE w.last END AS last, r.us - w.last > 86400000000 AS ok",
        "camera_id, event_id, us",
        "ok",
    ),
)
def _(spark, sf_dir):
    """Values are taken for free gigabytes."""
    rows = events(spark, sf_dir).select("camera_id", "event_id", temporal.micros(F.col("ts")).alias("us"), "value")
    return folds.disk_warnings(rows, ["camera_id"], "us", "value").select("camera_id", "event_id", "us")


@plan("str_12_pre_roll", f"WITH {EVENTS}, f AS (SELECT event_id, camera_id, epoch_us(ts) AS us, label FROM e), t AS (SELECT * FROM f WHERE label = 'person' AND event_id % 10 = 0) SELECT f.event_id, t.event_id AS trigger FROM f JOIN t ON f.camera_id = t.camera_id AND f.us BETWEEN t.us - 600000000 AND t.us + 300000000")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "camera_id", "label", temporal.micros(F.col("ts")).alias("us"))
    return temporal.around(rows.select("event_id", "camera_id", "us"), rows.where("label = 'person' and event_id % 10 = 0"), "camera_id", "us", 600, 300).select("event_id", "trigger")


@plan(
    "str_10_event_gate",
    walk(
        "SELECT camera_id, event_id, label, epoch_us(ts) AS us FROM e",
        "us AS last, true AS ok",
        "CASE WHEN r.label = 'person' OR r.us - w.last >= 1800000000 THEN r.us ELSE w.last END AS last, r.label = 'person' OR r.us - w.last >= 1800000000 AS ok",
        "camera_id, event_id, label, us",
        "ok",
    ),
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("camera_id", "event_id", "label", temporal.micros(F.col("ts")).alias("us"))
    return folds.event_gate(rows, ["camera_id"], "us", "label", 1800.0)


def watchdog_sql(online: str) -> str:
    return walk(
        f"SELECT camera_id, event_id, {online} AS online, epoch_us(ts) AS us FROM e",
        "CASE WHEN NOT online THEN us END AS since, false AS told, CASE WHEN NOT online THEN 'down' END AS change",
        """CASE WHEN NOT r.online THEN coalesce(w.since, r.us) END AS since, NOT r.online AND w.since IS NOT NULL AND (w.told OR r.us - w.since >= 1800000000) AS told,
        CASE WHEN r.online THEN CASE WHEN w.told THEN 'recovered' END WHEN w.since IS NULL THEN 'down' WHEN NOT w.told AND r.us - w.since >= 1800000000 THEN 'alert' END AS change""",
        "camera_id, event_id, online, us, change",
        "change IS NOT NULL",
    )


@plan("str_11_watchdog", watchdog_sql("k < 70"))
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("camera_id", "event_id", (F.col("k") < 70).alias("online"), temporal.micros(F.col("ts")).alias("us"))
    return folds.watchdog(rows, ["camera_id"], "us", "online", 1800.0).where("change is not null")


@plan("snk_15_timelapse_events", f"WITH {EVENTS} SELECT 'tl_' || event_id AS event_id, camera_id, 'timelapse' AS type FROM e WHERE type = 'timelapse' AND event_id % 100 <> 0")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).where("type = 'timelapse'").select(F.concat(F.lit("tl_"), "event_id").alias("event_id"), "camera_id", F.lit("timelapse").alias("type"), (F.col("event_id") % 100 == 0).alias("old"))
    return rows.select("event_id", "camera_id", "type").join(rows.where("old").select("event_id"), "event_id", "left_anti")


@plan(
    "str_15_sunset",
    walk(
        "SELECT camera_id, event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%d') AS day, (k - 50) / 5.0::DOUBLE AS altitude FROM e",
        "CASE WHEN altitude BETWEEN -2 AND 5 THEN us END AS since, '' AS done, false AS fired",
        """CASE WHEN w.done = r.day THEN w.since WHEN r.altitude NOT BETWEEN -2 AND 5 THEN NULL WHEN w.since IS NULL THEN r.us WHEN r.us - w.since < 720000000 THEN w.since END AS since,
        CASE WHEN w.done <> r.day AND r.altitude BETWEEN -2 AND 5 AND r.us - w.since >= 720000000 THEN r.day ELSE w.done END AS done,
        coalesce(w.done <> r.day AND r.altitude BETWEEN -2 AND 5 AND r.us - w.since >= 720000000, false) AS fired""",
        "camera_id, event_id, day",
        "fired",
    ),
)
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("camera_id", "event_id", temporal.micros(F.col("ts")).alias("us"), F.date_format("ts", "yyyy-MM-dd").alias("day"), ((F.col("k") - 50) / 5.0).alias("altitude"))
    return folds.sunset_once(rows, ["camera_id"], "us", "altitude", "day").select("camera_id", "event_id", "day")


_SUN = """s0 AS (SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000000 AS u FROM e),
    s1 AS (SELECT *, (u / 86400 - 10957.5::DOUBLE) / 36525 AS c FROM s0),
    s2 AS (SELECT *, ((280.46646::DOUBLE + c * (36000.76983::DOUBLE + c * 0.0003032::DOUBLE)) % 360 + 360) % 360 AS l, radians(357.52911::DOUBLE + c * (35999.05029::DOUBLE - 0.0001537::DOUBLE * c)) AS m, 0.016708634::DOUBLE - c * (0.000042037::DOUBLE + 0.0000001267::DOUBLE * c) AS o, radians(125.04::DOUBLE - 1934.136::DOUBLE * c) AS n FROM s1),
    s3 AS (SELECT *, radians(l + sin(m) * (1.914602::DOUBLE - c * (0.004817::DOUBLE + 0.000014::DOUBLE * c)) + sin(2 * m) * (0.019993::DOUBLE - 0.000101::DOUBLE * c) + sin(3 * m) * 0.000289::DOUBLE - 0.00569::DOUBLE - 0.00478::DOUBLE * sin(n)) AS a,
           radians(23 + (26 + (21.448::DOUBLE - c * (46.815::DOUBLE + c * (0.00059::DOUBLE - c * 0.001813::DOUBLE))) / 60) / 60 + 0.00256::DOUBLE * cos(n)) AS t FROM s2),
    s4 AS (SELECT *, asin(sin(t) * sin(a)) AS d, tan(t / 2) ** 2 AS y, radians(l) AS lr FROM s3),
    s5 AS (SELECT *, 4 * degrees(y * sin(2 * lr) - 2 * o * sin(m) + 4 * o * y * sin(m) * cos(2 * lr) - 0.5::DOUBLE * y * y * sin(4 * lr) - 1.25::DOUBLE * o * o * sin(2 * m)) AS q FROM s4),
    s6 AS (SELECT *, radians(((u % 86400) / 60 + q + 4 * 11.6::DOUBLE + 1440) % 1440 / 4 - 180) AS h, radians(48.1::DOUBLE) AS p FROM s5),
    s7 AS (SELECT *, degrees(asin(sin(p) * sin(d) + cos(p) * cos(d) * cos(h))) AS e0, degrees(atan2(sin(h), cos(h) * sin(p) - tan(d) * cos(p))) AS z FROM s6),
    s8 AS (SELECT *, tan(radians(e0)) AS k FROM s7),
    sun AS (SELECT event_id, e0 + CASE WHEN e0 > 85 THEN 0 WHEN e0 > 5 THEN 58.1::DOUBLE / k - 0.07::DOUBLE / k ** 3 + 0.000086::DOUBLE / k ** 5 WHEN e0 > -0.575 THEN 1735 + e0 * (-518.2::DOUBLE + e0 * (103.4::DOUBLE + e0 * (-12.79::DOUBLE + e0 * 0.711::DOUBLE))) ELSE -20.774::DOUBLE / k END / 3600 AS altitude, (z + 540) % 360 AS azimuth FROM s8)"""


@plan("geo_17_sun_position", f"WITH {EVENTS}, {_SUN} SELECT event_id, round(altitude, 4) AS altitude, round(azimuth, 4) AS azimuth FROM sun")
def _(spark, sf_dir):
    at = temporal.micros(F.col("ts")).cast("double") / 1000000
    rows = events(spark, sf_dir).select("event_id", rules.sun_position(at, 48.1, 11.6).alias("sun"))
    return rows.select("event_id", F.round("sun.altitude", 4).alias("altitude"), F.round("sun.azimuth", 4).alias("azimuth"))


GOALS = (
    goals.Goal("birds", "year_to_date", 60, label="bird"),
    goals.Goal("species", "current_calendar_month", 9, "species", labels=("bird", "cat")),
    goals.Goal("early_days", "year_to_date", 25, "days", hours=(5, 6, 7)),
    goals.Goal("winter", "december", 3),
)
_FIRST, _LATER = "2024-01-05 12:00:00", "2024-01-28 12:00:00"


def _goal_sql() -> str:
    count = {
        "birds": "least(count(*) FILTER (list_contains(labels, 'bird')), 60)",
        "species": "least(count(DISTINCT lower(trim(bird_species))) FILTER (list_has_any(labels, ['bird', 'cat'])), 9)",
        "early_days": "least(count(DISTINCT CASE WHEN time <> '' THEN substr(time, 1, 10) END) FILTER (TRY_CAST(substr(time, 12, 2) AS INT) IN (5, 6, 7)), 25)",
    }
    parts = [f"SELECT '{k}_2024' AS goal_id, {g.target} AS target, (SELECT {count[k]} FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '{_FIRST}') AS p1, (SELECT {count[k]} FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '{_LATER}') AS p2" for k, g in zip(count, GOALS[:3], strict=True)]
    parts.append("SELECT 'winter_2024', 3, 0, 0")
    return f"""WITH {EVENTS}, g AS ({' UNION ALL '.join(parts)})
    SELECT goal_id, p2 AS progress, CAST(target AS BIGINT) AS target, CASE WHEN p1 >= target THEN TIMESTAMP '{_FIRST}' WHEN p2 >= target THEN TIMESTAMP '{_LATER}' END AS completed_at, p1 < target AND p2 >= target AS notify FROM g"""


@plan("str_14_goals", _goal_sql())
def _(spark, sf_dir):
    """The second evaluation of four goals: what was complete at the first isn't told again."""
    rows = events(spark, sf_dir)
    before = goals.evaluate(rows, GOALS, spark.createDataFrame([], goals.STATE), _FIRST)
    return goals.evaluate(rows, GOALS, before.drop("notify"), _LATER).drop("notified_at")
