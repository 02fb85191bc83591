"""Queries of the event store: filters, paging, statistics, joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import rules
from larkspur.operators import store
from larkspur.plans import plan
from larkspur.plans.sql import EVENTS, FIRST_OBJECT, MOST_SPECIFIC
from larkspur.sources.events import events_view

NOW = "2024-01-31 00:00:00"
BRIEF = ("event_id", "camera_id", "label", "time")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_view(spark, sf_dir)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A media listing: clips of the events whose id is no multiple of 7."""
    rows = events(spark, sf_dir).where(F.col("event_id") % 7 != 0)
    return rows.select("camera_id", F.concat(F.lit("clip/"), "event_id", F.lit(".mp4")).alias("path"), (F.col("event_id") % 1000 + 1).alias("length"))


FILES = "f AS (SELECT camera_id, 'clip/' || event_id || '.mp4' AS path, event_id % 1000 + 1 AS length FROM e WHERE event_id % 7 <> 0)"


@plan("flt_01_time_range", f"WITH {EVENTS} SELECT event_id, camera_id, label, time FROM e WHERE time = '' OR (time >= '2024-01-05' AND time <= '2024-01-07')")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(store.time_range("2024-01-05", "2024-01-07")).select(*BRIEF)


@plan("flt_02_any_label", f"WITH {EVENTS} SELECT event_id, camera_id, label, time FROM e WHERE list_has_any(labels, ['cat', 'species_3']) OR bird_species IN ('cat', 'species_3') OR cat_name IN ('cat', 'species_3')")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(store.any_label(["cat", "species_3"])).select(*BRIEF)


@plan("flt_03_media_only", f"WITH {EVENTS} SELECT event_id, camera_id, label, time FROM e WHERE snapshot_relpath IS NOT NULL OR video_relpath IS NOT NULL")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(store.has_media("snapshot_relpath", "video_relpath")).select(*BRIEF)


@plan("flt_04_type", f"WITH {EVENTS} SELECT event_id, camera_id, label, time FROM e WHERE type = 'timelapse'")
def _(spark, sf_dir):
    return events(spark, sf_dir).where("type = 'timelapse'").select(*BRIEF)


@plan("flt_05_species", f"WITH {EVENTS} SELECT event_id, camera_id, label, time FROM e WHERE lower(trim(bird_species)) = 'species_4'")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(store.of_species(" Species_4 ")).select(*BRIEF)


@plan("flt_06_score_floor", f"WITH {EVENTS} SELECT event_id, label, CASE WHEN score < 0.2 THEN 'below_floor' WHEN score < CASE label WHEN 'person' THEN 0.6 WHEN 'bird' THEN 0.45 ELSE 0.2 END THEN 'below_label' END AS drop_reason FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "label", store.drop_reason(F.col("score"), F.col("label"), {"person": 0.6, "bird": 0.45}, 0.2).alias("drop_reason"))


@plan("flt_07_size_floor", f"WITH {EVENTS} SELECT event_id, label FROM e WHERE label <> 'person' OR ((y2 - y1) >= 0.15 * 480 AND (y2 - y1) * (x2 - x1) >= 0.02 * 640 * 480)")
def _(spark, sf_dir):
    box = F.struct("x1", "y1", "x2", "y2")
    return events(spark, sf_dir).where(store.large_enough(F.col("label"), box, F.lit(640), F.lit(480))).select("event_id", "label")


@plan("flt_08_allow_list", f"WITH {EVENTS} SELECT event_id, label FROM e WHERE label IN ('cat', 'bird')")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(store.allowed(F.col("label"), ["cat", "bird"])).select("event_id", "label")


@plan("flt_09_impossible", f"WITH {EVENTS}, x AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN 'zebra' WHEN k % 10 = 1 THEN 'stop_sign' ELSE label END AS seen FROM e) SELECT event_id, seen FROM x WHERE seen NOT IN ('zebra', 'stop_sign')")
def _(spark, sf_dir):
    k = F.col("k") % 10
    rows = events(spark, sf_dir).select("event_id", F.when(k == 0, "zebra").when(k == 1, "stop_sign").otherwise(F.col("label")).alias("seen"))
    return rows.where(store.possible(F.col("seen")))


@plan("flt_10_goal_match", f"WITH {EVENTS} SELECT event_id, label, time FROM e WHERE list_has_any(labels, ['bird', 'cat']) AND TRY_CAST(substr(time, 12, 2) AS INT) IN (5, 6, 7)")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(store.goal_matches(labels=["bird", "cat"], hours=[5, 6, 7])).select("event_id", "label", "time")


_CLOCK = "(hour(ts) * 60 + minute(ts))"


@plan("flt_11_schedule", f"WITH {EVENTS} SELECT event_id FROM e WHERE {_CLOCK} >= 1260 OR {_CLOCK} < 360")
def _(spark, sf_dir):
    now = F.hour("ts") * 60 + F.minute("ts")
    return events(spark, sf_dir).where(rules.in_window(now, F.lit(1260), F.lit(360), True)).select("event_id")


@plan("flt_12_quiet_hours", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 24 = 7 THEN false WHEN k % 24 < 7 THEN {_CLOCK} >= (k % 24) * 60 AND {_CLOCK} < 420 ELSE {_CLOCK} >= (k % 24) * 60 OR {_CLOCK} < 420 END AS quiet FROM e")
def _(spark, sf_dir):
    now = F.hour("ts") * 60 + F.minute("ts")
    return events(spark, sf_dir).select("event_id", rules.in_window(now, F.col("k") % 24 * 60, F.lit(420), False).alias("quiet"))


@plan("flt_13_action_gate", f"WITH {EVENTS} SELECT event_id, (k % 3 <> 0) OR (k % 2 = 0 AND ({_CLOCK} >= 480 AND {_CLOCK} < 1080)) AS active FROM e")
def _(spark, sf_dir):
    now = F.hour("ts") * 60 + F.minute("ts")
    return events(spark, sf_dir).select("event_id", rules.schedule_active(F.col("k") % 3 == 0, F.col("k") % 2 == 0, now, F.lit(480), F.lit(1080)).alias("active"))


@plan("flt_14_cloud_points", f"WITH {EVENTS} SELECT event_id, camera_id, label, score FROM e WHERE camera_id IN ('cam_1', 'cam_2') AND score >= 0.5")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).where(store.allowed(F.col("camera_id"), ["cam_1", "cam_2"]) & store.allowed(F.col("label"), []) & (F.col("score") >= 0.5))
    return rows.select("event_id", "camera_id", "label", "score")


@plan("flt_15_display_type", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'sun_timelapse_' || CASE WHEN k % 2 = 0 THEN 'set' ELSE 'rise' END WHEN k % 3 = 1 THEN coalesce(CASE WHEN k % 5 > 0 THEN 'thunder_rising' END, 'event_timelapse') ELSE 'fog' END AS shown FROM e")
def _(spark, sf_dir):
    k = F.col("k")
    kind = F.when(k % 3 == 0, "sun_timelapse").when(k % 3 == 1, "event_timelapse").otherwise("fog")
    return events(spark, sf_dir).select("event_id", store.display_type(kind, F.when(k % 2 == 0, "set"), F.when(k % 5 > 0, "thunder_rising")).alias("shown"))


@plan("flt_16_recap_candidates", f"WITH {EVENTS} SELECT event_id, score FROM e WHERE time <> '' AND substr(time, 1, 10) BETWEEN '2024-01-03' AND '2024-01-12' AND score >= 0.4")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).where((F.col("time") != "") & F.substring("time", 1, 10).between("2024-01-03", "2024-01-12") & (F.col("score") >= 0.4))
    return rows.select("event_id", "score")


@plan("flt_17_near_now", f"WITH {EVENTS} SELECT event_id, CAST(k - 5 AS DOUBLE) AS age FROM e WHERE k - 5 BETWEEN 0 AND 10")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", store.near_now((F.col("k") - 5).cast("double")).alias("age")).where("age is not null")


@plan("flt_18_goal_visible", f"WITH {EVENTS} SELECT event_id FROM e WHERE k % 2 = 0 OR ts > TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def _(spark, sf_dir):
    return events(spark, sf_dir).where((F.col("k") % 2 == 0) | (F.col("ts") > F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 10 days"))).select("event_id")


@plan("flt_20_timeline_points", f"WITH {EVENTS}, {FILES} SELECT e.event_id, e.camera_id, e.time, f.path AS video FROM e LEFT JOIN f ON f.path = e.video_relpath")
def _(spark, sf_dir):
    listed = files(spark, sf_dir).select("path")
    rows = events(spark, sf_dir).join(listed, F.col("video_relpath") == F.col("path"), "left")
    return rows.select("event_id", "camera_id", "time", F.col("path").alias("video"))


@plan("top_01_page", f"WITH {EVENTS} SELECT event_id, camera_id, label, time FROM e ORDER BY time DESC, event_id DESC LIMIT 24 OFFSET 48")
def _(spark, sf_dir):
    return store.page(events(spark, sf_dir), 24, 48).select(*BRIEF)


@plan("top_02_page_total", f"WITH {EVENTS}, x AS (SELECT * FROM e WHERE label = 'bird') SELECT event_id, time, (SELECT count(*) FROM x) AS total FROM x ORDER BY time DESC, event_id DESC LIMIT 10 OFFSET 20")
def _(spark, sf_dir):
    return store.page_with_total(events(spark, sf_dir).where("label = 'bird'"), 2, 10, "time", "event_id").select("event_id", "time", "total")


@plan("top_04_recap", f"WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, event_id) AS rn FROM e WHERE score >= 0.4) SELECT event_id, label, score, time FROM r WHERE rn <= 3 ORDER BY time, event_id LIMIT 12")
def _(spark, sf_dir):
    best = store.top_per_group(events(spark, sf_dir).where("score >= 0.4"), "label", "score", "event_id", 3)
    return best.orderBy("time", "event_id").limit(12).select("event_id", "label", "score", "time")


@plan("top_05_highlight", f"WITH {EVENTS}, x AS (SELECT *, {FIRST_OBJECT} AS p FROM e), y AS (SELECT event_id, p AS \"primary\", score * CASE p WHEN 'squirrel' THEN 1.5 WHEN 'fox' THEN 1.5 ELSE 1.0 END AS points FROM x WHERE time >= '2024-01-30T00:00:00' AND p <> 'motion' AND score >= 0.70 AND NOT (p = 'bird' AND coalesce(bird_species LIKE '%species_1', false))) SELECT event_id, \"primary\", points FROM y ORDER BY points DESC, event_id LIMIT 1")
def _(spark, sf_dir):
    return store.highlight(events(spark, sf_dir), "2024-01-30T00:00:00", ["species_1"]).select("event_id", "primary", "points")


@plan("top_07_diversity", f"WITH {EVENTS}, x AS (SELECT event_id, label, row_number() OVER (PARTITION BY label ORDER BY event_id) AS rn FROM e WHERE label <> 'motion') SELECT event_id, label FROM x ORDER BY rn > 1, event_id LIMIT 3")
def _(spark, sf_dir):
    first = events(spark, sf_dir).where("label <> 'motion'").withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy("event_id")))
    return first.orderBy(F.col("rn") > 1, "event_id").limit(3).select("event_id", "label")


@plan("top_09_last_of_species", f"WITH {EVENTS} SELECT event_id, bird_species, time FROM e WHERE bird_species = 'species_5' ORDER BY time DESC, event_id DESC LIMIT 10")
def _(spark, sf_dir):
    return store.page(events(spark, sf_dir).where(store.of_species("species_5")), 10).select("event_id", "bird_species", "time")


@plan("agg_01_count", f"WITH {EVENTS} SELECT count(*) AS n FROM e WHERE list_contains(labels, 'bird') AND (time = '' OR time >= '2024-01-10')")
def _(spark, sf_dir):
    return events(spark, sf_dir).where(store.any_label(["bird"]) & store.time_range("2024-01-10")).agg(F.count("*").alias("n"))


@plan("agg_02_totals", f"WITH {EVENTS} SELECT count(*) AS total, count(snapshot_relpath) AS photos, count(video_relpath) AS videos FROM e")
def _(spark, sf_dir):
    return store.totals(events(spark, sf_dir))


_DAY = "CASE WHEN length(time) >= 10 THEN substr(time, 1, 10) ELSE 'unbekannt' END"


@plan("agg_03_by_day", f"WITH {EVENTS}, d AS (SELECT {_DAY} AS day, count(*) AS events FROM e GROUP BY 1), c AS (SELECT {_DAY} AS day, lab AS label, count(*) AS n FROM el GROUP BY 1, 2) SELECT c.day, label, n, events FROM c JOIN d ON c.day = d.day")
def _(spark, sf_dir):
    return store.by_day(events(spark, sf_dir))


@plan("agg_04_by_hour", f"WITH {EVENTS} SELECT CASE WHEN length(time) >= 13 THEN substr(time, 12, 2) ELSE '??' END AS hour, count(*) AS n FROM e GROUP BY 1")
def _(spark, sf_dir):
    return store.by_hour(events(spark, sf_dir))


@plan("agg_05_top_species", f"WITH {EVENTS} SELECT bird_species AS value, count(*) AS n FROM e WHERE bird_species IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def _(spark, sf_dir):
    return store.top_counts(events(spark, sf_dir), "bird_species")


@plan("agg_05_top_labels", f"WITH {EVENTS} SELECT lab AS value, count(*) AS n FROM el GROUP BY 1 ORDER BY n DESC, value LIMIT 8")
def _(spark, sf_dir):
    return store.top_counts(store.each_label(events(spark, sf_dir)), "label")


@plan("agg_06_summary", f"WITH {EVENTS} SELECT camera_id, count(*) AS n FROM e WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY ROLLUP (camera_id)")
def _(spark, sf_dir):
    return store.per_camera(events(spark, sf_dir).where(F.col("ts") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 14 days")))


@plan("agg_07_storage", f"""WITH {EVENTS}, {FILES}, x AS (SELECT *, {FIRST_OBJECT} AS p FROM e),
    a AS (SELECT camera_id, count(*) AS events, count(*) FILTER (type = 'timelapse') AS timelapses,
                 arg_max(snapshot_relpath, (time, event_id)) FILTER (snapshot_relpath IS NOT NULL) AS latest,
                 arg_max(snapshot_relpath, (time, event_id)) FILTER (snapshot_relpath IS NOT NULL AND p <> 'motion') AS latest_object FROM x GROUP BY 1),
    b AS (SELECT camera_id, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS files FROM f GROUP BY 1)
    SELECT a.*, bytes, files FROM a LEFT JOIN b ON a.camera_id = b.camera_id""")  # fmt: skip
def _(spark, sf_dir):
    return store.storage_statistics(events(spark, sf_dir), files(spark, sf_dir))


@plan("agg_07_primary_histogram", f"WITH {EVENTS}, x AS (SELECT camera_id, {FIRST_OBJECT} AS label FROM e) SELECT camera_id, label, count(*) AS n FROM x WHERE label IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    return store.primary_histogram(events(spark, sf_dir))


@plan("agg_08_zero_filled", f"WITH {EVENTS}, c AS (SELECT label, count(*) AS n FROM e GROUP BY 1 UNION ALL VALUES ('fog', 0), ('bird', 0)) SELECT label, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def _(spark, sf_dir):
    return store.zero_filled(events(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n")), "label", ["fog", "bird"])


@plan("agg_09_goal_progress", f"WITH {EVENTS}, x AS (SELECT * FROM e WHERE list_contains(labels, 'bird') AND ts >= TIMESTAMP '2024-01-24') SELECT least(count(*), 25) AS events, least(count(DISTINCT lower(trim(bird_species))), 25) AS species, least(count(DISTINCT substr(time, 1, 10)), 25) AS days FROM x")
def _(spark, sf_dir):
    return store.goal_progress(events(spark, sf_dir).where(store.goal_matches(label="bird") & (F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"))), 25)


@plan("agg_10_daily_report", f"WITH {EVENTS}, c AS (SELECT camera_id, {MOST_SPECIFIC} AS label, count(*) AS n FROM e WHERE substr(time, 1, 10) = '2024-01-15' GROUP BY 1, 2) SELECT *, CAST(sum(n) OVER (PARTITION BY camera_id) AS BIGINT) AS total FROM c")
def _(spark, sf_dir):
    return store.daily_report(events(spark, sf_dir).where(F.substring("time", 1, 10) == "2024-01-15"))


@plan("agg_11_period_counts", f"WITH {EVENTS} SELECT count(*) FILTER (list_contains(labels, 'person')) AS persons, count(*) FILTER (list_has_any(labels, ['cat', 'bird', 'squirrel', 'fox', 'hedgehog', 'dog'])) AS wildlife, count(*) FILTER (k % 13 = 0) AS wrong FROM e WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.col("ts") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 7 days"))
    animals = F.array(*map(F.lit, ("cat", "bird", "squirrel", "fox", "hedgehog", "dog")))
    return rows.agg(F.count_if(F.array_contains("labels", "person")).alias("persons"), F.count_if(F.arrays_overlap("labels", animals)).alias("wildlife"), F.count_if(F.col("k") % 13 == 0).alias("wrong"))


@plan("agg_12_cat_roster", f"WITH {EVENTS}, c AS (SELECT cat_name AS name, count(*) AS n, max(time) AS last_seen FROM e WHERE cat_name IS NOT NULL AND substr(time, 1, 10) = '2024-01-20' GROUP BY 1), r(name) AS (VALUES ('cat_0'), ('cat_6'), ('mimi')) SELECT coalesce(c.name, r.name) AS name, coalesce(n, 0) AS n, last_seen FROM c FULL JOIN r ON c.name = r.name")
def _(spark, sf_dir):
    seen = events(spark, sf_dir).where("cat_name is not null and substring(time, 1, 10) = '2024-01-20'").groupBy(F.col("cat_name").alias("name")).agg(F.count("*").alias("n"), F.max("time").alias("last_seen"))
    known = F.broadcast(spark.createDataFrame([("cat_0",), ("cat_6",), ("mimi",)], "name string"))  # a fixed table
    return seen.join(known, "name", "full").select("name", F.coalesce("n", F.lit(0)).alias("n"), "last_seen")


@plan("agg_15_camera_share", f"WITH {EVENTS}, c AS (SELECT camera_id, count(*) AS n FROM e GROUP BY 1) SELECT camera_id, n, round(100.0 * n / sum(n) OVER (), 4) AS share FROM c")
def _(spark, sf_dir):
    counts = events(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("camera_id", "n", F.round(100.0 * F.col("n") / F.col("all"), 4).alias("share"))  # one row


@plan("agg_16_heat_map", "WITH " + EVENTS + ", x AS (SELECT camera_id, CAST(floor((epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(ts))) / 3600) AS INT) AS ago FROM e) SELECT camera_id, " + ", ".join(f"count(*) FILTER (ago = {h}) AS h{h}" for h in range(24)) + " FROM x WHERE ago BETWEEN 0 AND 23 GROUP BY 1")
def _(spark, sf_dir):
    return store.heat_map(events(spark, sf_dir), "2024-01-30 12:00:00")


@plan("agg_17_media_counts", f"WITH {EVENTS}, x AS (SELECT {FIRST_OBJECT} AS label FROM e UNION ALL SELECT 'timelapse' FROM e WHERE type = 'timelapse') SELECT label, count(*) AS n FROM x WHERE label IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    per = store.primary_histogram(rows).groupBy("label").agg(F.sum("n").alias("n"))
    return per.unionByName(rows.where("type = 'timelapse'").groupBy(F.lit("timelapse").alias("label")).agg(F.count("*").alias("n")))


@plan("agg_19_index_drift", f"WITH {EVENTS}, {FILES}, x AS (SELECT e.camera_id, CASE WHEN video_relpath IS NULL THEN 'malformed' WHEN f.path IS NOT NULL THEN 'matched' ELSE 'orphan' END AS state FROM e LEFT JOIN f ON f.path = e.video_relpath) SELECT camera_id, state, count(*) AS n FROM x GROUP BY GROUPING SETS ((camera_id, state), (state))")
def _(spark, sf_dir):
    listed = files(spark, sf_dir).select("path")
    rows = events(spark, sf_dir).join(listed, F.col("video_relpath") == F.col("path"), "left")
    state = F.when(F.col("video_relpath").isNull(), "malformed").when(F.col("path").isNotNull(), "matched").otherwise("orphan")
    rows = rows.select("camera_id", state.alias("state"))
    return rows.groupingSets([["camera_id", "state"], ["state"]], "camera_id", "state").agg(F.count("*").alias("n"))


@plan("agg_20_schema_versions", f"WITH {EVENTS} SELECT CAST(k % 5 AS INT) AS schema, count(*) AS n FROM e GROUP BY 1")
def _(spark, sf_dir):
    return events(spark, sf_dir).groupBy((F.col("k") % 5).alias("schema")).agg(F.count("*").alias("n"))


@plan("agg_21_separation", f"WITH {EVENTS}, s AS (SELECT count(*) AS n, quantile_cont(value, 0.5) FILTER (label = 'motion') AS m_pos, quantile_cont(value, 0.5) FILTER (label <> 'motion') AS m_neg FROM e), t AS (SELECT *, (m_pos + m_neg) / 2 AS threshold FROM s) SELECT n, m_pos, m_neg, threshold, avg(CAST(value >= threshold AS INT)) FILTER (label = 'motion') AS recall, avg(CAST(value < threshold AS INT)) FILTER (label <> 'motion') AS rejection FROM e, t GROUP BY ALL")
def _(spark, sf_dir):
    return store.separation(events(spark, sf_dir), "value", F.col("label") == "motion")


@plan("agg_22_grade", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 20 <= 0 THEN 'red' WHEN score < 0.1 AND value >= 0.8 * (k % 20) THEN 'green' WHEN score < 0.25 THEN 'yellow' ELSE 'red' END AS grade FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", store.grade(F.col("score"), F.col("value"), F.col("k") % 20).alias("grade"))


@plan("agg_25_first_seen", f"WITH {EVENTS} SELECT bird_species, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(camera_id, (ts, event_id)) AS camera_id, min(ts) AS ts, count(DISTINCT event_id) AS n FROM e WHERE bird_species IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return store.first_seen(events(spark, sf_dir), "bird_species")


@plan("agg_26_zone_flags", f"WITH {EVENTS} SELECT camera_id, time, bool_or(coalesce(CASE WHEN k % 3 = 0 THEN k % 2 = 0 END, true)) AS flag FROM e GROUP BY 1, 2")
def _(spark, sf_dir):
    flag = F.when(F.col("k") % 3 == 0, F.col("k") % 2 == 0)
    return events(spark, sf_dir).groupBy("camera_id", "time").agg(F.bool_or(F.coalesce(flag, F.lit(True))).alias("flag"))


@plan("agg_28_quality_report", f"WITH {EVENTS} SELECT CASE WHEN score < 0.25 THEN 'yellow' ELSE 'red' END AS grade, count(*) AS n, round(avg(score), 6) AS mean FROM e WHERE time LIKE '2024-01-1%' GROUP BY 1")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.col("time").startswith("2024-01-1"))
    return rows.groupBy(F.when(F.col("score") < 0.25, "yellow").otherwise("red").alias("grade")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@plan("agg_30_cleanup_summary", f"WITH {EVENTS}, x AS (SELECT camera_id, event_id, k % 9 = 0 AS gone, row_number() OVER (PARTITION BY camera_id, k % 9 = 0 ORDER BY event_id) AS rn FROM e) SELECT camera_id, count(*) AS scanned, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS deleted, string_agg(event_id, ',' ORDER BY event_id) FILTER (gone AND rn <= 5) AS first_deleted FROM x GROUP BY 1")
def _(spark, sf_dir):
    gone = F.col("k") % 9 == 0
    rows = events(spark, sf_dir).select("camera_id", "event_id", gone.alias("gone")).withColumn("rn", F.row_number().over(Window.partitionBy("camera_id", "gone").orderBy("event_id")))
    first = F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("gone") & (F.col("rn") <= 5), F.col("event_id")))).cast("array<string>"))
    return rows.groupBy("camera_id").agg(F.count("*").alias("scanned"), F.count_if(~F.col("gone")).alias("kept"), F.count_if("gone").alias("deleted"), first.alias("first_deleted"))


@plan("jn_01_sidecar_coverage", f"WITH {EVENTS} SELECT count(*) AS events_total, count(*) FILTER (event_id % 3 = 0) AS with_sidecar FROM e")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    sidecars = rows.where(F.col("event_id") % 3 == 0).select("event_id", F.lit(4).alias("schema"))
    return rows.join(sidecars, "event_id", "left").agg(F.count("*").alias("events_total"), F.count("schema").alias("with_sidecar"))


@plan("jn_02_reviews", f"WITH {EVENTS}, r AS (SELECT camera_id || ':' || event_id AS key, 'ok_' || (k % 3) AS review FROM e WHERE event_id % 11 = 0) SELECT event_id, review FROM e LEFT JOIN r ON r.key = e.camera_id || ':' || e.event_id")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    reviews = rows.where(F.col("event_id") % 11 == 0).select(F.concat_ws(":", "camera_id", "event_id").alias("review_key"), F.concat(F.lit("ok_"), F.col("k") % 3).alias("review"))
    return store.with_review(rows, reviews).select("event_id", "review")


@plan("jn_03_camera_names", f"WITH {EVENTS}, c(id, name) AS (VALUES ('cam_0', 'Garden'), ('cam_1', 'Door'), ('cam_3', 'Roof')) SELECT event_id, coalesce(c.name, camera_id) AS camera_name FROM e LEFT JOIN c ON c.id = e.camera_id")
def _(spark, sf_dir):
    cameras = F.broadcast(spark.createDataFrame([("cam_0", "Garden"), ("cam_1", "Door"), ("cam_3", "Roof")], "id string, name string"))  # a fixed table
    return store.with_camera_name(events(spark, sf_dir), cameras).select("event_id", "camera_name")


@plan("jn_05_species_variants", f"WITH {EVENTS}, m(species, achievement) AS (VALUES ('species_1', 'a'), ('species_2', 'a'), ('species_3', 'b')) SELECT DISTINCT event_id, achievement FROM e JOIN m ON lower(trim(bird_species)) = m.species")
def _(spark, sf_dir):
    # A few fixed variants: a literal map, so events aren't joined with anything.
    names = {"species_1": ["a"], "species_2": ["a"], "species_3": ["b"]}
    of = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = events(spark, sf_dir).where(F.lower(F.trim("bird_species")).isin(*names))
    return rows.select("event_id", F.explode(of[F.lower(F.trim("bird_species"))]).alias("achievement")).distinct()


@plan("jn_06_unregistered_media", f"WITH {EVENTS}, {FILES} SELECT path FROM f WHERE path NOT IN (SELECT video_relpath FROM e WHERE video_relpath IS NOT NULL)")
def _(spark, sf_dir):
    return files(spark, sf_dir).join(events(spark, sf_dir).select(F.col("video_relpath").alias("path")), "path", "left_anti").select("path")


@plan("jn_07_orphans", f"WITH {EVENTS}, {FILES} SELECT event_id FROM e WHERE video_relpath IS NULL OR video_relpath NOT IN (SELECT path FROM f)")
def _(spark, sf_dir):
    return events(spark, sf_dir).join(files(spark, sf_dir).select(F.col("path").alias("video_relpath")), "video_relpath", "left_anti").select("event_id")


@plan("jn_08_archived_cameras", f"WITH {EVENTS} SELECT DISTINCT camera_id FROM e WHERE camera_id NOT IN ('cam_0', 'cam_2')")
def _(spark, sf_dir):
    active = F.broadcast(spark.createDataFrame([("cam_0",), ("cam_2",)], "camera_id string"))  # a fixed table
    return events(spark, sf_dir).select("camera_id").distinct().join(active, "camera_id", "left_anti")


@plan("set_02_distinct_events", f"WITH {EVENTS} SELECT event_id, camera_id FROM e WHERE k < 60 UNION SELECT event_id, camera_id FROM e WHERE k > 40")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "camera_id", "time", "k")
    return store.distinct_events(rows.where("k < 60"), rows.where("k > 40")).select("event_id", "camera_id")


@plan("set_03_stem_difference", f"WITH {EVENTS} SELECT event_id, CASE WHEN k < 60 THEN 'left' ELSE 'right' END AS side FROM e WHERE NOT (k < 60 AND k > 40)")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    a, b = rows.where("k < 60").select("event_id"), rows.where("k > 40").select("event_id")
    return a.join(b, "event_id", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "event_id", "left_anti").withColumn("side", F.lit("right")))


@plan("set_05_sorted_labels", f"WITH {EVENTS} SELECT event_id, array_to_string(labels, '|') AS labels FROM e")
def _(spark, sf_dir):
    twice = F.concat("labels", "labels")
    return events(spark, sf_dir).select("event_id", F.array_join(F.array_sort(F.array_distinct(twice)), "|").alias("labels"))
