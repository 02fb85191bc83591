"""Data management: writes, edits, deletions, trash, retention, orphans, merges and migrations as table rewrites."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from larkspur.sources.events import event_date


def with_ids(events: DataFrame) -> DataFrame:
    """SNK-1: ids made of the time where they are missing; further events of a camera and microsecond are numbered."""
    made = F.date_format("ts", "yyyyMMdd-HHmmss-SSSSSS")
    nth = F.row_number().over(Window.partitionBy("camera_id", "_made").orderBy(F.xxhash64(*[F.to_json(F.struct(*events.columns))])))
    new = events.where("event_id is null").withColumn("_made", made).withColumn("_nth", nth)
    new = new.withColumn("event_id", F.when(F.col("_nth") == 1, F.col("_made")).otherwise(F.concat_ws("-", "_made", F.col("_nth") - 1)))
    return events.where("event_id is not null").unionByName(new.select(*events.columns))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """SNK-1/14/18: append by camera and the date in the id, by Spark's commit protocol; ids are made where missing."""
    rows = with_ids(events)
    rows = rows.withColumn("event_date", F.coalesce(event_date(F.col("event_id")), F.lit("undated")))
    rows.write.mode(mode).partitionBy("camera_id", "event_date").parquet(path)


def upsert(table: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """SNK-2/4: rows of ``changed`` replace those of the same key (null is a key too) and are added where there are none."""
    keys = changed.select(F.col(key).alias("_changed")).distinct()
    return table.join(keys, F.col(key).eqNullSafe(F.col("_changed")), "left_anti").unionByName(changed, allowMissingColumns=True)


def edit_labels(events: DataFrame, edits: DataFrame) -> DataFrame:
    """SNK-3: new labels by event_id; the top label stays if it is among them, else it is the first, or motion.

    Of several edits of an event the last counts, by ``edited_at`` if there is such a column, else the greatest list.
    """
    order = [F.col("edited_at")] if "edited_at" in edits.columns else []
    last = edits.where("event_id is not null").groupBy("event_id").agg(F.max(F.struct(*order, F.col("labels").alias("new")))["new"].alias("new"))
    rows = events.join(last, "event_id", "left")
    labels = F.coalesce("new", "labels")
    top = F.when(F.col("new").isNull(), F.col("top_label")).when(F.size("new") == 0, "motion").when(~F.array_contains("new", F.col("top_label")), F.get("new", F.lit(0))).otherwise(F.col("top_label"))
    return rows.withColumns({"labels": labels, "top_label": top}).drop("new")


def delete(table: DataFrame, ids: DataFrame, key: str = "event_id") -> DataFrame:
    """SNK-5: without the rows of these keys; null keys match nothing."""
    return table.join(ids.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def expire_trash(trash: DataFrame, now: str, grace_days: int = 7) -> DataFrame:
    """SNK-6: days left of each entry and whether it is expired; unreadable times are expired."""
    at = F.try_to_timestamp("trashed_at")
    left = F.unix_timestamp(at) + grace_days * 86400 - F.unix_timestamp(F.lit(now).cast("timestamp"))
    days = F.greatest(F.coalesce(F.floor(left / 86400), F.lit(0)), F.lit(0))
    return trash.withColumns({"days_left": days.cast("int"), "expired": at.isNull() | (left < 0)})


def retain(files: DataFrame, now: str, days: int, protected: Column) -> DataFrame:
    """SNK-7: files that stay: newer than the retention, or protected."""
    return files.where(protected | (F.col("modified") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")))


def orphans(events: DataFrame, files: DataFrame) -> DataFrame:
    """SNK-8: events any of whose referenced media is missing."""
    paths = files.select("path").distinct()
    refs = events.select("event_id", F.explode(F.array_compact(F.array("snapshot_relpath", "video_relpath"))).alias("path"))
    return refs.join(paths, "path", "left_anti").select("event_id").distinct()


def purge(listing: DataFrame, events: DataFrame) -> DataFrame:
    """SNK-8: ``(path, why)`` of all that goes: manifests that couldn't be read, manifests whose media is missing, and then track sidecars and best
    pictures without a manifest that stays in their camera.

    ``listing`` has (camera_id, path) of every file, ``events`` the manifests that could be read: their path, snapshot_relpath and video_relpath.
    """
    named = listing.select("camera_id", "path", F.regexp_extract("path", r"([^/]+?)(\.tracks\.json|\.best\.jpg|\.json)$", 1).alias("stem"), F.regexp_extract("path", r"(\.tracks\.json|\.best\.jpg|\.json)$", 1).alias("kind"))
    manifests, sidecars = named.where("kind = '.json'"), named.where("kind in ('.tracks.json', '.best.jpg')")
    broken = manifests.join(events.select("path"), "path", "left_anti").select("path", F.lit("malformed").alias("why"))
    lost = orphans(events.withColumn("event_id", F.col("path")), listing).select(F.col("event_id").alias("path"), F.lit("media").alias("why"))
    gone = broken.unionByName(lost)
    stay = manifests.join(gone, "path", "left_anti").select("camera_id", "stem")
    alone = sidecars.join(stay, ["camera_id", "stem"], "left_anti").select("path", F.lit("sidecar").alias("why"))
    return gone.unionByName(alone)


def register_media(files: DataFrame, events: DataFrame) -> DataFrame:
    """SNK-9: stub events for media without one; the time is in the stem where it can be read."""
    new = files.join(events.select(F.col("video_relpath").alias("path")), "path", "left_anti")
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    ts = F.try_to_timestamp(F.substring(stem, 1, 15), F.lit("yyyyMMdd-HHmmss"))
    return new.select(stem.alias("event_id"), "camera_id", ts.cast("timestamp_ntz").alias("ts"), F.array(F.lit("motion")).alias("labels"), F.lit("motion").alias("top_label"), F.lit("info").alias("alarm_level"), F.lit(True).alias("scanned"), F.col("path").alias("video_relpath"))


def reconcile(clips: DataFrame, manifests: DataFrame, stem: str = "stem") -> DataFrame:
    """SNK-10/JN-18: matched, clip without manifest (to be made), manifest without clip (to be marked)."""
    both = clips.select(stem, F.lit(True).alias("clip")).join(manifests.select(stem, F.lit(True).alias("manifest")), stem, "full")
    state = F.when(F.col("clip").isNull(), "missing_clip").when(F.col("manifest").isNull(), "orphan_clip").otherwise("matched")
    return both.select(stem, state.alias("state"))


def newest(rows: DataFrame, keys: list[str], order: str, tie: str, n: int) -> DataFrame:
    """SNK-11/16: the n newest rows of each key. Spark keeps n rows per key and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(tie).desc())
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).drop("nth")


def merge_camera(events: DataFrame, files: DataFrame, source: str, target: str, name: str) -> DataFrame:
    """SNK-12: a camera's events move to another; ids already taken there get the first free of _m1, _m2, …, and media that is gone is unlinked."""
    moved = events.where(F.col("camera_id") == source)
    base, number = F.regexp_extract("event_id", r"^(.*)_m\d+$", 1), F.regexp_extract("event_id", r"_m(\d+)$", 1)
    there = events.where(F.col("camera_id") == target).select("event_id")
    taken = there.select("event_id", F.lit(True).alias("taken")).distinct()
    used = events.where(F.col("camera_id").isin(source, target) & (base != "")).groupBy(base.alias("event_id")).agg(F.collect_set(number.cast("int")).alias("used"))
    paths = files.select(F.col("path").alias("video_relpath"), F.lit(True).alias("there")).distinct()
    moved = moved.join(taken, "event_id", "left").join(used, "event_id", "left").join(paths, "video_relpath", "left")
    have = F.coalesce("used", F.array().cast("array<int>"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size(have) + 1), have))
    moved = moved.withColumns({"event_id": F.when(F.col("taken"), F.concat("event_id", F.lit("_m"), free)).otherwise(F.col("event_id")), "video_relpath": F.when(F.col("there"), F.col("video_relpath")), "camera_id": F.lit(target), "camera_name": F.lit(name)})
    rest = events.where(~F.col("camera_id").eqNullSafe(source)).withColumn("camera_name", F.when(F.col("camera_id") == target, name).otherwise(F.col("camera_name")))
    return rest.unionByName(moved.select(*rest.columns))


def migrate_paths(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """SNK-13: files under their camera's new id; of two that meet the newer stays."""
    rows = files.join(mapping, "camera_id", "left").withColumn("new_id", F.coalesce("new_id", "camera_id"))
    path = F.concat_ws("/", "new_id", F.regexp_replace("path", r"^[^/]+/", ""))
    return rows.withColumn("new_path", path).groupBy("new_path").agg(F.max_by(F.struct("path", "modified"), F.struct("modified", "path")).alias("kept"), F.count("*").alias("met")).select("new_path", "kept.path", "met")


def tolerant_match(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """JN-17: a stored path's file: the same stem, else the shortest name that begins with it.

    Names begin with the stem up to its first dot or underscore after the time, so ``head`` joins by equality.
    """
    head = lambda c: F.substring_index(c, "_", 2)
    a = wanted.select("stored", F.regexp_extract("stored", r"([^/]+?)(?:\.[^.]*)?$", 1).alias("stem"))
    b = files.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^.]*)?$", 1).alias("name"))
    pairs = a.withColumn("head", head(F.col("stem"))).join(b.withColumn("head", head(F.col("name"))), "head").where(F.col("name").startswith(F.col("stem")))
    best = pairs.groupBy("stored").agg(F.min(F.struct((F.col("name") != F.col("stem")).alias("far"), F.length("name").alias("size"), "path")).alias("b"))
    return a.join(best, "stored", "left").select("stored", "b.path")


def merge_settings(base: Column, override: Column) -> Column:
    """JN-19: a map with another's entries over it."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(base, lambda k, v: ~F.map_contains_key(override, k))), F.map_entries(override)))


def _leaves(value: Column, kind: DataType, name: str, is_path: Callable[[str], bool], change: Callable[[Column], Column]) -> Column | None:
    """``value`` with ``change`` applied to every string in it whose field's name is a path's; None if there is none."""
    if isinstance(kind, StringType):
        return change(value) if is_path(name) else None
    if isinstance(kind, StructType):
        parts = [(f.name, _leaves(value[f.name], f.dataType, f.name, is_path, change)) for f in kind.fields]
        if all(c is None for _, c in parts):
            return None
        return F.when(value.isNotNull(), F.struct(*[(value[n] if c is None else c).alias(n) for n, c in parts]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _leaves(x, kind.elementType, name, is_path, change)) if _leaves(value[0], kind.elementType, name, is_path, change) is not None else None
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: _leaves(x, kind.valueType, name, is_path, change)) if _leaves(F.lit(None).cast(kind.valueType), kind.valueType, name, is_path, change) is not None else None
    return None


def rewrite_paths(events: DataFrame, renamed: DataFrame, suffixes: tuple[str, ...] = ("path", "paths", "url", "urls")) -> DataFrame:
    """SNK-13: events of renamed cameras, with the folder of the old id replaced in every path they hold, however deeply nested.

    ``renamed`` has (camera_id, new_id), each camera_id once. Which fields are paths is told by their names' ends, in columns, structs, arrays and maps alike; a folder is changed where a whole part of the path is
    the old id, so other ids that begin like it stay, and so do all other fields. The camera_id changes too.
    """
    rows = events.join(renamed.select("camera_id", F.col("new_id").alias("__new_id")), "camera_id", "left")
    change = lambda path: F.when(F.col("__new_id").isNull(), path).otherwise(F.array_join(F.transform(F.split(path, "/"), lambda part: F.when(part == F.col("camera_id"), F.col("__new_id")).otherwise(part)), "/"))
    out = {f.name: _leaves(F.col(f"`{f.name}`"), f.dataType, f.name, lambda n: n.lower().endswith(suffixes), change) for f in events.schema.fields}
    columns = [F.col(f"`{n}`") if c is None else c.alias(n) for n, c in out.items() if n != "camera_id"]
    return rows.select(*columns, F.coalesce("__new_id", "camera_id").alias("camera_id")).select(*[F.col(f"`{c}`") for c in events.columns])
