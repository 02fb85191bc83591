"""Sources and sinks as round trips through the shared folder, and the functions that the other modules only use inside others."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import geo, rules
from larkspur.operators import manage, store, temporal
from larkspur.plans import plan
from larkspur.plans.sql import EVENTS, WEATHER
from larkspur.plans.temporal import _STEPS, clips
from larkspur.session import shared_folder
from larkspur.sources import events as source
from larkspur.sources.events import events_view as events
from larkspur.sources.events import weather_view as weather


def _written(spark, sf_dir):
    """Events with ids of their time, written as the store and read back."""
    folder = shared_folder(spark, "store")
    ident = F.when(F.col("k") % 10 == 0, F.concat(F.lit("tl_"), "event_id")).when(F.col("k") != 3, F.concat(F.date_format("ts", "yyyyMMdd-HHmmss-"), "event_id"))
    manage.write_events(events(spark, sf_dir).select(ident.alias("event_id"), "camera_id", "ts", "label", F.col("event_id").alias("n")), folder)
    return spark.read.option("inferSchema", False).parquet(folder).withColumn("event_date", F.col("event_date").cast("string"))


_DATED = "CASE WHEN k % 10 = 0 THEN 'undated' ELSE strftime(ts, '%Y-%m-%d') END"


@plan("snk_01_insert", f"WITH {EVENTS} SELECT camera_id, {_DATED} AS event_date, count(*) AS n FROM e GROUP BY 1, 2")
def _(spark, sf_dir):
    """SNK-18 too: Spark's commit protocol makes the write atomic."""
    return _written(spark, sf_dir).groupBy("camera_id", "event_date").agg(F.count("*").alias("n"))


@plan("snk_14_relocate", f"WITH {EVENTS} SELECT event_id, camera_id, {_DATED} AS event_date FROM e")
def _(spark, sf_dir):
    """Events go to the folder of their id's date; those already there stay."""
    rows = _written(spark, sf_dir).select(F.col("n").alias("event_id"), "camera_id", "event_date")
    there = rows.where("event_id % 3 = 1")
    return there.unionByName(manage.delete(rows, there))


@plan("src_03_point_lookup", f"WITH {EVENTS} SELECT event_id AS n, camera_id FROM e WHERE event_id = (SELECT min(event_id) FROM e WHERE k % 10 <> 0 AND k <> 3)")
def _(spark, sf_dir):
    rows = _written(spark, sf_dir)
    wanted = rows.where("event_id like '2%' and event_id rlike '-[0-9]+$' and n = cast(element_at(split(event_id, '-'), -1) as long)").agg(F.min_by("event_id", "n")).first()[0]
    return source.event_by_id(rows, wanted).select("n", "camera_id")


@plan("src_01_scan", f"WITH {EVENTS} SELECT 'id' || event_id AS event_id, camera_id, top_label FROM e WHERE k <> 7")
def _(spark, sf_dir):
    """SRC-2 too: all cameras' folders; the camera comes from the path where a row has none, and broken rows are skipped."""
    root = shared_folder(spark, "scan")
    fields = F.struct(F.concat(F.lit("id"), "event_id").alias("event_id"), F.when(F.col("k") % 2 == 0, F.col("camera_id")).alias("camera_id"), "time", "labels", "top_label")
    line = F.when(F.col("k") == 7, "{broken").otherwise(F.to_json(fields))
    events(spark, sf_dir).select(F.col("camera_id").alias("cam"), line.alias("value")).write.partitionBy("cam").text(f"{root}/motion_detection")
    return source.read_events(spark, root, multi_line=False, glob="*.txt").select("event_id", "camera_id", "top_label")


def _lines(rows, fields, folder: str, broken) -> None:
    """A JSON object a line; broken ones where ``broken``."""
    rows.select(F.when(broken, "{broken").otherwise(F.to_json(F.struct(*fields))).alias("value")).write.text(folder)


@plan("src_04_track_sidecars", f"WITH {EVENTS} SELECT 'id' || event_id AS event_id, camera_id, CAST(k % 5 AS INT) AS schema, label, k / 100.0::DOUBLE AS best FROM e WHERE k <> 7")
def _(spark, sf_dir):
    root = shared_folder(spark, "tracks")
    one = F.array(F.struct(F.lit("t").alias("track_id"), "label", (F.col("k") / 100.0).alias("best_score")))
    _lines(events(spark, sf_dir), [F.concat(F.lit("id"), "event_id").alias("event_id"), "camera_id", (F.col("k") % 5).alias("schema"), one.alias("tracks")], root, F.col("k") == 7)
    rows = source.read_tracks(spark, root, multi_line=False, glob="*.txt")
    return rows.select("event_id", "camera_id", "schema", F.inline(F.transform("tracks", lambda t: F.struct(t["label"].alias("label"), t["best_score"].alias("best")))))


@plan("src_05_weather_history", f"WITH {WEATHER}, n AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS rn FROM w) SELECT ts, gust AS wind_gusts_10m, rain AS precipitation FROM n WHERE rn <= 100 AND hour(ts) <> 3")
def _(spark, sf_dir):
    """The last hundred samples of one history file, without those that hold no values."""
    root = shared_folder(spark, "history")
    values = F.when(F.hour("ts") != 3, F.struct(F.col("gust").alias("wind_gusts_10m"), F.col("rain").alias("precipitation"), F.lit(1).alias("unknown")))
    sample = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), values.alias("values"))
    all_of_it = weather(spark, sf_dir).agg(F.array_sort(F.collect_list(sample)).alias("samples"))  # an hourly history of a month: one small file
    all_of_it.select(F.to_json(F.struct("samples")).alias("value")).coalesce(1).write.text(root)
    kept = weather(spark, sf_dir).orderBy(F.desc("ts")).limit(100).where(F.hour("ts") != 3).count()
    return source.read_weather_history(spark, root, kept).select("ts", "wind_gusts_10m", "precipitation")


@plan("src_06_sightings", f"WITH {EVENTS} SELECT 'id' || event_id AS id, camera_id AS cam_id, label AS event_type, score FROM e WHERE k % 3 = 0 AND k <> 9")
def _(spark, sf_dir):
    """Manifests of sightings; those in the folders of recaps and scratch files don't count."""
    root, rows = shared_folder(spark, "sightings"), events(spark, sf_dir)
    fields = [F.concat(F.lit("id"), "event_id").alias("id"), F.col("camera_id").alias("cam_id"), F.col("label").alias("event_type"), "score"]
    for rest, folder in ((0, "cam"), (1, "recaps"), (2, "x/.scratch_1")):
        _lines(rows.where(F.col("k") % 3 == rest), fields, f"{root}/{folder}", F.col("k") == 9)
    return source.read_sightings(spark, root, multi_line=False, glob="*.txt").select("id", "cam_id", "event_type", "score")


@plan("src_07_recaps", f"WITH {EVENTS} SELECT 'p' || event_id AS period_id, CASE WHEN k % 2 = 0 THEN time END AS period_end, CAST(rank() OVER (ORDER BY coalesce(CASE WHEN k % 2 = 0 THEN time END, '2023' || event_id) DESC, 'p' || event_id) AS INT) AS place FROM e")
def _(spark, sf_dir):
    root = shared_folder(spark, "recaps")
    period = F.when(F.col("k") % 2 == 0, F.col("time"))
    _lines(events(spark, sf_dir), [F.concat(F.lit("p"), "event_id").alias("period_id"), period.alias("period_end"), F.concat(F.lit("2023"), "event_id").alias("built_at")], root, F.lit(False))
    rows = source.read_recaps(spark, root, multi_line=False, glob="*.txt").select("period_id", "period_end", "built_at")
    order = [F.coalesce("period_end", "built_at").desc_nulls_last(), F.asc("period_id")]
    return store.placed(rows, order).select("period_id", "period_end", F.col("place").cast("int").alias("place"))


@plan("src_10_config", """SELECT * FROM (VALUES ('server', '{"lat":48.1,"name":"Wien"}'), ('cameras', '[{"id":"cam_1"}]')) t(section, value)""")
def _(spark, sf_dir):
    path = shared_folder(spark, "config")
    text = '{"server": {"name": "Wien", "lat": 48.1},\n "secrets": {"key": 1},\n "cameras": [{"id": "cam_1"}]}'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return source.read_config(spark, path)


@plan("src_12_media_listing", f"WITH {EVENTS} SELECT camera_id, CAST(sum(strlen(video_relpath) + 1) AS BIGINT) AS bytes FROM e WHERE video_relpath IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    root = shared_folder(spark, "media")
    events(spark, sf_dir).where("video_relpath is not null").select(F.col("camera_id").alias("cam"), F.col("video_relpath").alias("value")).write.partitionBy("cam").text(root)
    files = source.list_media(spark, root, "*.txt")
    return files.groupBy(F.regexp_extract("path", "/cam=([^/]+)/", 1).alias("camera_id")).agg(F.sum("length").alias("bytes"))


@plan("src_08_json_lines", f"WITH {EVENTS} SELECT event_id, label FROM e WHERE k <> 5")
def _(spark, sf_dir):
    path = shared_folder(spark, "lines")
    events(spark, sf_dir).select(F.when(F.col("k") == 5, "{bad").when(F.col("k") == 6, F.concat(F.to_json(F.struct("event_id", "label")), F.lit("\n"))).otherwise(F.to_json(F.struct("event_id", "label"))).alias("value")).write.text(path)
    return source.read_jsonl(spark, path, "event_id long, label string")


@plan("src_11_label_map", "SELECT n_nationkey AS idx, n_name AS label FROM nation")
def _(spark, sf_dir):
    path = shared_folder(spark, "labels")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows.select(F.concat("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, ": ").otherwise(" "), "n_name").alias("value")).coalesce(1).write.text(path)
    return source.read_label_map(spark, path)


@plan("snk_04_confirm", f"WITH {EVENTS} SELECT event_id, event_id % 8 = 0 AS confirmed FROM e")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.lit(False).alias("confirmed"))
    return manage.upsert(rows, rows.where("event_id % 8 = 0").withColumn("confirmed", F.lit(True)), "event_id")


@plan("snk_19_config_export", f"""WITH {EVENTS} SELECT camera_id, '{{"id":"' || camera_id || '","events":' || count(*) || ',"last":' || max(event_id) || '}}' AS config FROM e GROUP BY 1""")
def _(spark, sf_dir):
    rows = events(spark, sf_dir).groupBy("camera_id").agg(F.count("*").alias("events"), F.max("event_id").alias("last"))
    return rows.select("camera_id", F.to_json(F.struct(F.col("camera_id").alias("id"), "events", "last")).alias("config"))


@plan("fn_05_window_minutes", f"WITH {EVENTS}, x AS (SELECT event_id, k * 14 AS s, CASE WHEN k % 5 = 0 THEN k * 14 ELSE (k * 31) % 1440 END AS t FROM e) SELECT event_id, CASE WHEN s = t THEN 1440 ELSE (t - s + 1440) % 1440 END AS minutes FROM x")
def _(spark, sf_dir):
    k = F.col("k")
    end = F.when(k % 5 == 0, k * 14).otherwise(k * 31 % 1440)
    return events(spark, sf_dir).select("event_id", rules.window_minutes(k * 14, end).cast("int").alias("minutes"))


@plan("fn_07_last_ip_segment", f"WITH {EVENTS} SELECT event_id, CASE k % 4 WHEN 3 THEN '' ELSE CAST(k AS VARCHAR) END AS segment FROM e")
def _(spark, sf_dir):
    k = F.col("k")
    ip = F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), k)).when(k % 4 == 1, F.concat(F.lit("2001:db8::"), k, F.lit("%eth0"))).when(k % 4 == 2, F.concat(F.lit("::ffff:10.1.2."), k))
    return events(spark, sf_dir).select("event_id", rules.last_ip_segment(ip).alias("segment"))


@plan("geo_05_nms_merge", f"WITH {EVENTS} SELECT event_id, CASE WHEN (100.0 - k) / (100.0 + k) >= 0.45 THEN 1 ELSE 2 END AS kept FROM e")
def _(spark, sf_dir):
    """Two equal boxes, the second moved by k."""
    box = lambda score, dx: F.struct(F.lit("cat").alias("label"), F.lit(score).alias("score"), dx.cast("double").alias("x1"), F.lit(0.0).alias("y1"), (dx + 100).cast("double").alias("x2"), F.lit(100.0).alias("y2"))
    return events(spark, sf_dir).select("event_id", F.size(geo.nms(F.array(box(0.9, F.lit(0)), box(0.8, F.col("k"))), 0.45, inclusive=True)).alias("kept"))


@plan("geo_09_flatten_curve", f"WITH {EVENTS}, s AS (SELECT event_id, x1, y1, x2, y2, unnest(range(1, 13)) / 12.0::DOUBLE AS t FROM e) SELECT event_id, CAST(trunc((1 - t) * (1 - t) * x1 + 2 * (1 - t) * t * x2 + t * t * x2) AS INT) AS x, CAST(trunc((1 - t) * (1 - t) * y1 + 2 * (1 - t) * t * y1 + t * t * y2) AS INT) AS y FROM s")
def _(spark, sf_dir):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return events(spark, sf_dir).select("event_id", F.inline(geo.flatten_curve(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"))))


@plan("geo_11_mask_filter", f"WITH {EVENTS}, g AS (SELECT event_id, label, (x1 + x2) // 2 AS gx, y2 AS gy FROM e) SELECT event_id FROM g WHERE NOT (gx BETWEEN 100 AND 400 AND gy BETWEEN 50 AND 300) AND NOT (label IN ('cat', 'bird') AND gx BETWEEN 500 AND 900 AND gy BETWEEN 200 AND 600)")
def _(spark, sf_dir):
    """A mask for all labels and one for two of them, tested at the ground point."""
    square = lambda x1, y1, x2, y2: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])
    at = F.floor((F.col("x1") + F.col("x2")) / 2), F.col("y2")
    masked = geo.in_polygon(*at, square(100, 50, 400, 300)) | (F.col("label").isin("cat", "bird") & geo.in_polygon(*at, square(500, 200, 900, 600)))
    return events(spark, sf_dir).where(~masked).select("event_id")


@plan("jn_14_previous_event", f"WITH {EVENTS}, p AS (SELECT event_id, lab, max(CAST(floor(epoch(ts)) AS BIGINT) * 1000000000 + event_id) OVER (PARTITION BY camera_id, lab ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM el) SELECT event_id, lab AS label, m % 1000000000 AS previous FROM p WHERE m IS NOT NULL")
def _(spark, sf_dir):
    rows = store.each_label(events(spark, sf_dir), "event_id", "camera_id", temporal.seconds(F.col("ts")).alias("s"))
    return temporal.previous_in_group(rows, ["camera_id", "label"], "s").where("prev is not null").select("event_id", "label", F.col("prev.event_id").alias("previous"))


@plan("win_22_mean_speed", f"WITH {EVENTS}, {_STEPS}, s AS (SELECT clip, step, row_number() OVER (PARTITION BY clip ORDER BY event_id DESC) AS rn FROM c1), l AS (SELECT clip, step FROM s WHERE rn <= 5 AND step IS NOT NULL) SELECT clip, round(avg(step), 4) AS mean_step, round(list_sort(list(step))[count(*) // 2 + 1], 4) AS median_step FROM l GROUP BY 1")
def _(spark, sf_dir):
    return temporal.recent_speed(clips(spark, sf_dir), ["clip"], "event_id").select("clip", *[F.round(c, 4).alias(c) for c in ("mean_step", "median_step")])


@plan("top_11_most_displaced", f"WITH {EVENTS}, {_STEPS} SELECT split_part(clip, '/', 1) AS camera_id, arg_max(clip, (net, clip)) AS clip, max(net) AS net FROM c2 GROUP BY 1")
def _(spark, sf_dir):
    moved = temporal.track_motion(clips(spark, sf_dir), ["clip"], "event_id").withColumn("net", F.round("net", 4))
    best = moved.groupBy(F.split("clip", "/")[0].alias("camera_id")).agg(F.max(F.struct("net", "clip")).alias("b"))
    return best.select("camera_id", "b.clip", "b.net")


@plan("trk_02_tier_split", f"WITH {EVENTS} SELECT event_id, CASE WHEN score >= CASE label WHEN 'person' THEN 0.7 WHEN 'cat' THEN 0.5 ELSE 0.55 END THEN 'confirmed' ELSE 'tentative' END AS tier FROM e")
def _(spark, sf_dir):
    spawn = F.when(F.col("label") == "person", 0.7).when(F.col("label") == "cat", 0.5).otherwise(0.55)
    return events(spark, sf_dir).select("event_id", rules.tier(F.col("score"), spawn).alias("tier"))
