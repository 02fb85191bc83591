"""Readers of the event store's files, and the event view over the driver's tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BBOX = "struct<x1:int,y1:int,x2:int,y2:int>"
DETECTION = f"struct<label:string,score:double,bbox:{BBOX},species:string,species_latin:string,species_score:double,identity:string,raw_cls_id:int,via_roi:boolean>"
#: The superset of all event variants (motion, snapshot, scanned media, timelapse).
EVENT_SCHEMA = (
    "event_id string, camera_id string, camera_name string, type string, time string, labels array<string>, top_label string, bird_species string, cat_name string, person_name string, "
    "whitelisted boolean, armed boolean, after_hours boolean, alarm_level string, severity string, confirmed boolean, scanned boolean, "
    f"detections array<{DETECTION}>, snapshot_relpath string, snapshot_url string, thumb_url string, video_relpath string, video_url string, duration_s double, file_size_bytes long, "
    "first_since struct<label:string,previous_event_id:string,previous_event_ts:string,gap_hours:double,threshold_hours:double,is_new_record:boolean>, "
    "profile string, window_key string, period_s double, target_s double, frame_count long, size_mb double"
)
SAMPLE = f"struct<f:int,t:double,bbox:{BBOX},score:double,source:string,label:string>"
TRACKS_SCHEMA = (
    "event_id string, camera_id string, schema int, video_path string, fps double, frame_count long, duration_s double, best_frame struct<f:int,t:double,score:double,label:string>, "
    f"tracks array<struct<track_id:string,label:string,color:string,first_frame:int,last_frame:int,best_score:double,best_frame:int,end_reason:string,samples:array<{SAMPLE}>>>"
)
WEATHER_FIELDS = ("precipitation", "snowfall", "lightning_potential", "visibility", "wind_gusts_10m", "cloud_cover", "sun_altitude")
HISTORY_CAP = 8640
SIGHTING_SCHEMA = "id string, cam_id string, event_type string, sun_phase string, trigger string, started_at string, severity double, score double, clip_path string, thumb_path string, duration_s double, missing_clip boolean"
RECAP_SCHEMA = "period_id string, period_label string, period_start string, period_end string, built_at string, clip_path string"


def event_date(event_id: Column) -> Column:
    """FN-1: yyyy-MM-dd of an id's first eight digits, else null."""
    return F.when(event_id.rlike(r"^\d{8}"), F.regexp_replace(F.substring(event_id, 1, 8), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))


def _json(spark: SparkSession, schema: str, root: str, glob: str, multi_line: bool = True) -> DataFrame:
    reader = spark.read.schema(f"{schema}, _corrupt_record string").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", multi_line)
    rows = reader.json(root).withColumn("_path", F.col("_metadata.file_path"))
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_events(spark: SparkSession, root: str, multi_line: bool = True, glob: str = "*.json") -> DataFrame:
    """SRC-1/2: every event of every camera; malformed files are skipped, track sidecars are another table.

    A file is one event, or with ``multi_line`` off an event a line.
    """
    rows = _json(spark, EVENT_SCHEMA, root, glob, multi_line).where(~F.col("_path").endswith(".tracks.json"))
    camera = F.regexp_extract("_path", r"/motion_detection/(?:[^/=]+=)?([^/]+)/", 1)
    rows = rows.withColumn("camera_id", F.coalesce("camera_id", F.nullif(camera, F.lit(""))))
    return rows.withColumns({"ts": F.try_to_timestamp("time").cast("timestamp_ntz"), "event_date": event_date(F.col("event_id"))})


def event_by_id(events: DataFrame, event_id: str, camera_id: str | None = None) -> DataFrame:
    """SRC-3: point lookup; the id's date prunes partitions where the store is partitioned by it."""
    rows = events.where(F.col("event_id") == event_id)
    if "event_date" in events.columns and event_id[:8].isdigit() and len(event_id) >= 8:
        rows = rows.where(F.col("event_date") == f"{event_id[:4]}-{event_id[4:6]}-{event_id[6:8]}")
    return (rows.where(F.col("camera_id") == camera_id) if camera_id else rows).limit(1)


def read_tracks(spark: SparkSession, root: str, multi_line: bool = True, glob: str = "*.tracks.json") -> DataFrame:
    """SRC-4: track sidecars, with the event id from the file's stem where missing; corrupt ones are skipped."""
    rows = _json(spark, TRACKS_SCHEMA, root, glob, multi_line)
    return rows.withColumn("event_id", F.coalesce("event_id", F.regexp_extract("_path", r"([^/]+)\.tracks\.json$", 1)))


def read_weather_history(spark: SparkSession, path: str, cap: int = HISTORY_CAP) -> DataFrame:
    """SRC-5: the last ``cap`` samples, known fields only, missing ones null."""
    values = ",".join(f"{f}:double" for f in WEATHER_FIELDS)
    rows = spark.read.schema(f"samples array<struct<ts:string,values:struct<{values}>>>").option("multiLine", True).json(path)
    rows = rows.select(F.posexplode("samples").alias("pos", "s")).where("s.ts is not null and s.values is not null")
    last = rows.select("pos", F.try_to_timestamp("s.ts").cast("timestamp_ntz").alias("ts"), *[F.col(f"s.values.{f}").alias(f) for f in WEATHER_FIELDS])
    return last.where("ts is not null").orderBy(F.desc("pos")).limit(cap).drop("pos")


def read_sightings(spark: SparkSession, root: str, multi_line: bool = True, glob: str = "*.json") -> DataFrame:
    """SRC-6: sighting manifests; recaps and scratch folders are left out."""
    rows = _json(spark, SIGHTING_SCHEMA, root, glob, multi_line)
    return rows.where(~F.col("_path").rlike(r"/recaps/|/\.scratch_"))


def read_recaps(spark: SparkSession, root: str, multi_line: bool = True, glob: str = "*.json") -> DataFrame:
    """SRC-7: recap manifests, newest period first."""
    return _json(spark, RECAP_SCHEMA, root, glob, multi_line).orderBy(F.coalesce("period_end", "built_at").desc_nulls_last(), "period_id")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-8: JSON lines; blank and bad lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: (idx, label) of "id label" or "id: label" lines; other lines take their line number."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    lines = lines.where(F.trim("text") != "")
    index = F.regexp_extract("text", r"^\s*(\d+)\s*[:\s]\s*(\S.*?)\s*$", 1)
    label = F.regexp_extract("text", r"^\s*(\d+)\s*[:\s]\s*(\S.*?)\s*$", 2)
    return lines.select(F.when(index != "", index.cast("int")).otherwise(F.col("line")).alias("idx"), F.when(index != "", label).otherwise(F.trim("text")).alias("label"))


def list_media(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """SRC-12: path, length and modification time of files; their contents are never read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return rows.select("path", "length", "modificationTime")


# The sections that an imported configuration may have.
CONFIG_SECTIONS = "app server telegram mqtt cameras ui review telegram_actions timelapse_settings weather".split()


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: (section, value as JSON) of the allowed sections of a configuration file; other sections are left out.

    The file is JSON, or YAML where a YAML reader is installed. What isn't one object is an error. A configuration is one small document.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        loaded = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError(f"{path} isn't JSON, and no YAML reader is installed") from None
        loaded = yaml.safe_load(text)
    if not isinstance(loaded, dict):
        raise ValueError(f"{path} must hold one object")
    rows = [(k, json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)) for k, v in loaded.items() if k in CONFIG_SECTIONS]
    return spark.createDataFrame(rows, "section string, value string")


def row_ify(payload: DataFrame, times: str, *fields: str) -> DataFrame:
    """D5: parallel arrays to rows."""
    zipped = F.arrays_zip(F.col(times).alias("time"), *[F.col(f) for f in fields])
    return payload.select(F.inline(zipped))


# --- The event view over the driver's ``events`` table -------------------------------------------------------------------

LABEL_OF = {"view": "motion", "click": "bird", "purchase": "squirrel", "signup": "cat", "error": "person"}


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the store's shape; every expression has its twin in ``plans.sql.EVENTS``."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.create_map(*[F.lit(x) for kv in LABEL_OF.items() for x in kv])[F.col("event_type")]
    rows = rows.select("event_id", "ts", "user_id", "value", k.alias("k"), label.alias("label"), F.concat(F.lit("cam_"), F.col("user_id") % 5).alias("camera_id"))
    labels = F.when(F.col("k") == 99, F.array().cast("array<string>")).when((F.col("k") % 4 == 0) & (F.col("label") != "motion"), F.array_sort(F.array(F.col("label"), F.lit("motion")))).otherwise(F.array("label"))
    x1, y1 = (F.col("event_id") * 37 % 1200).cast("int"), (F.col("event_id") * 53 % 600).cast("int")
    return rows.withColumns(
        {
            "time": F.when(F.col("event_id") % 997 == 0, F.lit("")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")),
            "labels": labels,
            "top_label": F.col("label"),
            "score": F.col("k") / 100.0,
            "type": F.when(F.col("event_id") % 50 == 0, "timelapse").otherwise("motion"),
            "bird_species": F.when(F.col("label") == "bird", F.concat(F.lit("species_"), F.col("k") % 12)),
            "cat_name": F.when(F.col("label") == "cat", F.concat(F.lit("cat_"), F.col("k") % 7)),
            "snapshot_relpath": F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("snap/"), "event_id", F.lit(".jpg"))),
            "video_relpath": F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("clip/"), "event_id", F.lit(".mp4"))),
            "x1": x1, "y1": y1, "x2": x1 + 40 + F.col("k"), "y2": y1 + 40 + (F.col("user_id") % 60).cast("int"),
        }
    )


def weather_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly measurements: gusts and rain from two event types."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_type").isin("view", "click"))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    return rows.groupBy(hour).agg(F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("gust"), F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("rain"))


