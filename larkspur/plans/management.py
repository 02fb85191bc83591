"""Data management over the event view."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import manage
from larkspur.plans import plan
from larkspur.plans.sql import EVENTS
from larkspur.plans.store import FILES, files
from larkspur.sources.events import events_view as events

NOW = "2024-01-31 00:00:00"


@plan("snk_02_upsert", f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'seen' ELSE label END AS label FROM e")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "label")
    return manage.upsert(rows, rows.where("event_id % 9 = 0").withColumn("label", F.lit("seen")), "event_id")


@plan("snk_03_label_edit", f"WITH {EVENTS} SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'motion' WHEN event_id % 6 = 3 THEN CASE WHEN label IN ('cat', 'fox') THEN label ELSE 'cat' END ELSE label END AS top_label FROM e")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "labels", "top_label")
    none, new = F.array().cast("array<string>"), F.array(F.lit("cat"), F.lit("fox"))
    edits = rows.where("event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 6 == 0, none).otherwise(new).alias("labels"))
    return manage.edit_labels(rows, edits).select("event_id", "top_label")


@plan("snk_05_delete", f"WITH {EVENTS} SELECT event_id, label FROM e WHERE event_id % 13 <> 0")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "label")
    return manage.delete(rows, rows.where("event_id % 13 = 0"))


@plan("snk_06_trash", f"WITH {EVENTS}, t AS (SELECT event_id, CASE WHEN k = 3 THEN NULL ELSE date_trunc('second', ts) END AS t0 FROM e), d AS (SELECT event_id, t0, epoch(t0) + 7 * 86400 - epoch(TIMESTAMP '{NOW}') AS l FROM t) SELECT event_id, CAST(greatest(coalesce(floor(l / 86400), 0), 0) AS INT) AS days_left, t0 IS NULL OR l < 0 AS expired FROM d")
def _(spark, sf_dir):
    trash = events(spark, sf_dir).select("event_id", F.when(F.col("k") == 3, "?").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("trashed_at"))
    return manage.expire_trash(trash, NOW).select("event_id", "days_left", "expired")


@plan("snk_07_retention", f"WITH {EVENTS} SELECT event_id FROM e WHERE type = 'timelapse' OR ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "type", F.col("ts").alias("modified"))
    return manage.retain(rows, NOW, 10, F.col("type") == "timelapse").select("event_id")


@plan("snk_08_orphans", f"WITH {EVENTS}, {FILES}, r AS (SELECT event_id, snapshot_relpath AS path FROM e UNION ALL SELECT event_id, video_relpath FROM e), p AS (SELECT path FROM f UNION SELECT snapshot_relpath FROM e WHERE event_id % 17 <> 0 AND snapshot_relpath IS NOT NULL) SELECT DISTINCT event_id FROM r WHERE path IS NOT NULL AND path NOT IN (SELECT path FROM p)")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    snaps = rows.where("event_id % 17 <> 0").select(F.col("snapshot_relpath").alias("path"))
    return manage.orphans(rows, files(spark, sf_dir).select("path").unionByName(snaps))


@plan(
    "snk_08_purge",
    f"""WITH {EVENTS}, {FILES}, m AS (SELECT *, camera_id || '/' || event_id || '.json' AS path FROM e WHERE event_id % 11 <> 0),
    p AS (SELECT path FROM f UNION SELECT snapshot_relpath FROM e WHERE event_id % 17 <> 0 AND snapshot_relpath IS NOT NULL),
    gone AS (SELECT path, CASE WHEN k = 7 THEN 'malformed' ELSE 'media' END AS why FROM m WHERE k = 7 OR (snapshot_relpath IS NOT NULL AND snapshot_relpath NOT IN (SELECT path FROM p)) OR (video_relpath IS NOT NULL AND video_relpath NOT IN (SELECT path FROM p))),
    side AS (SELECT event_id, camera_id || '/' || event_id || '.tracks.json' AS path FROM e WHERE event_id % 2 = 0 UNION ALL SELECT event_id, camera_id || '/' || event_id || '.best.jpg' FROM e WHERE event_id % 3 = 0)
    SELECT path, why FROM gone UNION ALL SELECT path, 'sidecar' FROM side WHERE event_id NOT IN (SELECT event_id FROM m WHERE path NOT IN (SELECT path FROM gone))""",
)
def _(spark, sf_dir):
    """A listing in which some manifests are gone, some can't be read and some media is missing."""
    rows = events(spark, sf_dir)
    name = lambda ending: F.concat("camera_id", F.lit("/"), "event_id", F.lit(ending)).alias("path")
    manifests = rows.where("event_id % 11 <> 0").select("camera_id", name(".json"), "k", "snapshot_relpath", "video_relpath")
    listing = files(spark, sf_dir).select("camera_id", "path")
    for more in (
        manifests.select("camera_id", "path"),
        rows.where("event_id % 17 <> 0 and snapshot_relpath is not null").select("camera_id", F.col("snapshot_relpath").alias("path")),
        rows.where("event_id % 2 = 0").select("camera_id", name(".tracks.json")),
        rows.where("event_id % 3 = 0").select("camera_id", name(".best.jpg")),
    ):
        listing = listing.unionByName(more)
    return manage.purge(listing, manifests.where("k <> 7"))


@plan("snk_09_register_media", f"WITH {EVENTS}, {FILES} SELECT regexp_extract(path, '([^/]+)\\.[^.]+$', 1) AS event_id, camera_id, 'motion' AS top_label FROM f WHERE path NOT IN (SELECT video_relpath FROM e WHERE video_relpath IS NOT NULL)")
def _(spark, sf_dir):
    return manage.register_media(files(spark, sf_dir), events(spark, sf_dir)).select("event_id", "camera_id", "top_label")


@plan("snk_10_reconcile", f"WITH {EVENTS} SELECT event_id AS stem, CASE WHEN event_id % 4 = 0 AND event_id % 6 = 0 THEN 'matched' WHEN event_id % 4 = 0 THEN 'orphan_clip' ELSE 'missing_clip' END AS state FROM e WHERE event_id % 4 = 0 OR event_id % 6 = 0")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id").alias("stem"))
    return manage.reconcile(rows.where("stem % 4 = 0"), rows.where("stem % 6 = 0"))


@plan("snk_11_ring_buffer", f"WITH {EVENTS}, r AS (SELECT camera_id, event_id, row_number() OVER (PARTITION BY camera_id ORDER BY ts DESC, event_id DESC) AS rn FROM e) SELECT camera_id, event_id FROM r WHERE rn <= 80")
def _(spark, sf_dir):
    return manage.newest(events(spark, sf_dir).select("camera_id", "event_id", "ts"), ["camera_id"], "ts", "event_id", 80).select("camera_id", "event_id")


@plan("snk_12_camera_merge", f"WITH {EVENTS}, {FILES}, x AS (SELECT CAST(event_id // 5 AS VARCHAR) AS id, camera_id, video_relpath FROM e WHERE camera_id IN ('cam_1', 'cam_2', 'cam_3')) SELECT DISTINCT CASE WHEN camera_id = 'cam_1' AND id IN (SELECT id FROM x WHERE camera_id = 'cam_2') THEN id || '_m1' ELSE id END AS event_id, CASE WHEN camera_id = 'cam_1' THEN 'cam_2' ELSE camera_id END AS camera_id, CASE WHEN camera_id <> 'cam_1' OR video_relpath IN (SELECT path FROM f) THEN video_relpath END AS video FROM x")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).where(F.col("camera_id").isin("cam_1", "cam_2", "cam_3"))
    rows = rows.select(F.expr("cast(event_id div 5 as string)").alias("event_id"), "camera_id", "video_relpath", F.lit(None).cast("string").alias("camera_name"))
    taken = manage.merge_camera(rows.dropDuplicates(["event_id", "camera_id", "video_relpath"]), files(spark, sf_dir), "cam_1", "cam_2", "Door")
    return taken.select("event_id", "camera_id", F.col("video_relpath").alias("video")).distinct()


@plan("snk_13_migrate_paths", f"WITH {EVENTS}, m AS (SELECT CASE camera_id WHEN 'cam_1' THEN 'door' WHEN 'cam_2' THEN 'door' ELSE camera_id END || '/' || (k % 50) || '.mp4' AS new_path, ts FROM e) SELECT new_path, count(*) AS met FROM m GROUP BY 1")
def _(spark, sf_dir):
    mapping = F.broadcast(spark.createDataFrame([("cam_1", "door"), ("cam_2", "door")], "camera_id string, new_id string"))  # a fixed table
    listed = events(spark, sf_dir).select("camera_id", F.concat("camera_id", F.lit("/"), F.col("k") % 50, F.lit(".mp4")).alias("path"), F.col("ts").alias("modified"))
    return manage.migrate_paths(listed, mapping).select("new_path", "met")


_MOVED = "CASE camera_id WHEN 'cam_1' THEN 'door' WHEN 'cam_2' THEN 'yard' ELSE camera_id END"


@plan(
    "snk_13_rewrite_paths",
    f"""WITH {EVENTS}, n AS (SELECT *, {_MOVED} AS now FROM e) SELECT event_id, now AS camera_id, 'media/' || now || '/' || event_id || '.mp4' AS video_relpath, now || '/cam_1x/' || event_id || '.jpg' AS snapshot, camera_id || '/as it was' AS note,
    CASE WHEN k % 5 > 0 THEN now || '/a,' || now || '/b' ELSE '' END AS clips, '/' || now AS thumb FROM n""",
)
def _(spark, sf_dir):
    """Paths in a column, a structure, an array of structures and a map; other fields hold the old id and keep it."""
    cam, at = F.col("camera_id"), lambda *parts: F.concat_ws("/", *parts)
    clip = lambda name: F.struct(at("camera_id", F.lit(name)).alias("clip_path"), cam.alias("label"))
    rows = events(spark, sf_dir).select(
        "event_id", "camera_id", F.concat(F.lit("media/"), cam, F.lit("/"), "event_id", F.lit(".mp4")).alias("video_relpath"),
        F.struct(F.struct(F.concat(cam, F.lit("/cam_1x/"), "event_id", F.lit(".jpg")).alias("url"), at("camera_id", F.lit("as it was")).alias("note")).alias("snapshot"), F.when(F.col("k") % 5 > 0, F.array(clip("a"), clip("b"))).alias("clips")).alias("media"),
        F.create_map(F.lit("thumb"), F.concat(F.lit("/"), cam)).alias("other_path"),
    )
    renamed = F.broadcast(spark.createDataFrame([("cam_1", "door"), ("cam_2", "yard")], "camera_id string, new_id string"))  # a fixed table
    out = manage.rewrite_paths(rows, renamed)
    clips = F.coalesce(F.array_join(F.transform("media.clips", lambda c: c["clip_path"]), ","), F.lit(""))
    return out.select("event_id", "camera_id", "video_relpath", F.col("media.snapshot.url").alias("snapshot"), F.col("media.snapshot.note").alias("note"), clips.alias("clips"), F.col("other_path")["thumb"].alias("thumb"))


@plan("snk_16_prune_backups", f"WITH {EVENTS}, r AS (SELECT event_id, row_number() OVER (PARTITION BY label ORDER BY ts DESC, event_id DESC) AS rn FROM e) SELECT event_id FROM r WHERE rn <= 100")
def _(spark, sf_dir):
    return manage.newest(events(spark, sf_dir), ["label"], "ts", "event_id", max(1, min(100, 250))).select("event_id")


@plan("jn_17_tolerant_paths", f"WITH {EVENTS} SELECT 'w/a_' || event_id || '.mp4' AS stored, CASE WHEN k % 3 = 0 THEN 'v/a_' || event_id || '.mkv' WHEN k % 3 = 1 THEN 'v/a_' || event_id || '_2.mkv' END AS path FROM e")
def _(spark, sf_dir):
    rows, k = events(spark, sf_dir), F.col("k") % 3
    stem = F.concat(F.lit("a_"), "event_id")
    listed = rows.where(k < 2).select(F.explode(F.when(k == 0, F.array(F.concat(F.lit("v/"), stem, F.lit(".mkv")), F.concat(F.lit("v/"), stem, F.lit("_x.mkv")))).otherwise(F.array(F.concat(F.lit("v/"), stem, F.lit("_2.mkv")), F.concat(F.lit("v/"), stem, F.lit("_long.mkv"))))).alias("path"))
    return manage.tolerant_match(rows.select(F.concat(F.lit("w/"), stem, F.lit(".mp4")).alias("stored")), listed)


@plan("snk_17_publish_payload", f"WITH {EVENTS} SELECT 'home/events/' || camera_id AS topic, '{{\"event_id\":' || event_id || ',\"label\":\"' || label || '\"}}' AS payload FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select(F.concat(F.lit("home/events/"), "camera_id").alias("topic"), F.to_json(F.struct("event_id", "label")).alias("payload"))


@plan("jn_19_settings_merge", f"WITH {EVENTS} SELECT event_id, CAST(k AS VARCHAR) || ',' || CASE WHEN k % 2 = 0 THEN 'x' ELSE 'b' END AS merged FROM e")
def _(spark, sf_dir):
    base = F.create_map(F.lit("a"), F.lit("a"), F.lit("b"), F.lit("b"))
    over = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("a"), F.col("k").cast("string"), F.lit("b"), F.lit("x"))).otherwise(F.create_map(F.lit("a"), F.col("k").cast("string")))
    m = manage.merge_settings(base, over)
    return events(spark, sf_dir).select("event_id", F.concat_ws(",", m["a"], m["b"]).alias("merged"))
