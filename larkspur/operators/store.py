"""The event store's queries: filters, paging, statistics, top lists and sets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import rules
from larkspur.session import shared_folder

NO_DAY, NO_HOUR = "unbekannt", "??"


# --- Filters (FLT) ----------------------------------------------------------------------------------------------------------


def time_range(start: str | None = None, end: str | None = None) -> Column:
    """FLT-1: inclusive comparison of ISO strings; rows without a time pass."""
    out = F.lit(True)
    if start:
        out = out & (F.col("time") >= start)
    if end:
        out = out & (F.col("time") <= end)
    return F.col("time").isNull() | (F.col("time") == "") | out


def any_label(wanted: Iterable[str]) -> Column:
    """FLT-2: any of the labels, the cat's name or the bird's species."""
    have = F.array_compact(F.concat(F.coalesce("labels", F.array().cast("array<string>")), F.array("cat_name", "bird_species")))
    return F.arrays_overlap(have, F.array(*map(F.lit, wanted)))


def has_media(*columns: str) -> Column:
    """FLT-3: any of the media columns is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]).isNotNull()


def of_species(name: str) -> Column:
    """FLT-5."""
    return F.lower(F.trim("bird_species")) == name.strip().lower()


def drop_reason(score: Column, label: Column, thresholds: dict[str, float], floor: float) -> Column:
    """FLT-6: why a detection is dropped, null if it is kept."""
    own = F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv])[label] if thresholds else F.lit(None).cast("double")
    return F.when(score < floor, "below_floor").when(score < F.coalesce(own, F.lit(floor)), "below_label")


def large_enough(label: Column, box: Column, width: Column, height: Column) -> Column:
    """FLT-7: persons need 15 % of the frame's height and 2 % of its area."""
    h, w = box["y2"] - box["y1"], box["x2"] - box["x1"]
    return (label != "person") | ((h >= 0.15 * height) & (h * w >= 0.02 * width * height))


def allowed(label: Column, names: Iterable[str]) -> Column:
    """FLT-8: an empty list allows all."""
    names = list(names)
    return label.isin(*names) if names else F.lit(True)


def possible(label: Column) -> Column:
    """FLT-9."""
    return ~label.isin(*rules.IMPOSSIBLE)


def goal_matches(label: str | None = None, labels: Iterable[str] | None = None, hours: Iterable[int] | None = None) -> Column:
    """FLT-10: a goal's criteria; a time without an hour matches no hour."""
    out = F.lit(True)
    if label:
        out = out & F.array_contains("labels", label)
    if labels is not None:
        out = out & F.arrays_overlap(F.col("labels"), F.array(*map(F.lit, labels)))
    if hours is not None:
        out = out & F.coalesce(F.substring("time", 12, 2).try_cast("int").isin(*hours), F.lit(False))
    return out


def display_type(event_type: Column, sun_phase: Column, trigger: Column) -> Column:
    """FLT-15: sun timelapses show as rise or set, event timelapses as their trigger."""
    return F.when(event_type == "sun_timelapse", F.concat(F.lit("sun_timelapse_"), F.coalesce(sun_phase, F.lit("rise")))).when(event_type == "event_timelapse", F.coalesce(trigger, event_type)).otherwise(event_type)


def near_now(age: Column, most: float = 10.0) -> Column:
    """FLT-17: the age to two digits where it lies within [0, most], else null."""
    return F.when(age.between(0, most), F.round(age, 2))


def known_fields(values: Column, keys: Iterable[str]) -> Column:
    """FLT-19: a map's entries of these keys."""
    keys = list(keys)
    return F.map_filter(values, lambda k, v: k.isin(*keys))


# --- Sort, page, top (TOP) -----------------------------------------------------------------------------------------------


def page(rows: DataFrame, limit: int = 24, offset: int = 0, order: str = "time", tie: str = "event_id") -> DataFrame:
    """TOP-1: newest first; a global limit is taken as bounded top lists per task, not as a sort of everything."""
    return rows.orderBy(F.col(order).desc(), F.col(tie).desc()).offset(offset).limit(limit)


def page_with_total(rows: DataFrame, number: int, size: int, order: str, tie: str) -> DataFrame:
    """TOP-2: a page and the number of all rows; negative pages are the first."""
    total = rows.agg(F.count("*").alias("total"))
    return page(rows, size, max(0, number) * size, order, tie).crossJoin(F.broadcast(total))  # one row


def top_counts(rows: DataFrame, key: Column | str, n: int = 8) -> DataFrame:
    """AGG-5: the n commonest values, ties by value."""
    of = (F.col(key) if isinstance(key, str) else key).alias("value")
    return rows.select(of).where("value is not null and value <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def top_per_group(rows: DataFrame, group: str, score: str, tie: str, n: int) -> DataFrame:
    """TOP-4/7: the n best of each group. Spark keeps n rows per group and task before it shuffles."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# --- Statistics (AGG) ----------------------------------------------------------------------------------------------------


def day_of(time: Column) -> Column:
    return F.when(F.length(time) >= 10, F.substring(time, 1, 10)).otherwise(NO_DAY)


def hour_of(time: Column) -> Column:
    return F.when(F.length(time) >= 13, F.substring(time, 12, 2)).otherwise(NO_HOUR)


def each_label(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per label; events without labels count as motion."""
    labels = F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit("motion")))
    return rows.select(*keep, F.explode(labels).alias("label"))


def totals(rows: DataFrame) -> DataFrame:
    """AGG-2: events, with photo, with video."""
    return rows.agg(F.count("*").alias("total"), F.count_if(has_media("snapshot_relpath")).alias("photos"), F.count_if(has_media("video_relpath")).alias("videos"))


def by_day(rows: DataFrame) -> DataFrame:
    """AGG-3: events per day and label, with the day's events. Events are read once and counted by day and label set; only those counts are taken apart."""
    sets = rows.groupBy(day_of(F.col("time")).alias("day"), "labels").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("day")).alias("events")
    parts = sets.select("day", "labels", "n", total)
    return each_label(parts, "day", "n", "events").groupBy("day", "label", "events").agg(F.sum("n").alias("n")).select("day", "label", "n", "events")


def by_hour(rows: DataFrame) -> DataFrame:
    """AGG-4: events per hour of the day."""
    return rows.groupBy(hour_of(F.col("time")).alias("hour")).agg(F.count("*").alias("n"))


def per_camera(rows: DataFrame) -> DataFrame:
    """AGG-6: events per camera and in all, in one pass."""
    return rows.rollup("camera_id").agg(F.count("*").alias("n"))


def storage_statistics(rows: DataFrame, files: DataFrame) -> DataFrame:
    """AGG-7: bytes and files per camera; events, timelapses, newest snapshot, newest one with an object."""
    label = rules.first_object_label(F.col("labels"))
    snap = F.col("snapshot_relpath").isNotNull()
    events = rows.groupBy("camera_id").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("type") == "timelapse").alias("timelapses"),
        F.max_by(F.when(snap, F.col("snapshot_relpath")), F.when(snap, F.struct("time", "event_id"))).alias("latest"),
        F.max_by(F.when(snap & (label != "motion"), F.col("snapshot_relpath")), F.when(snap & (label != "motion"), F.struct("time", "event_id"))).alias("latest_object"),
    )
    return events.join(files.groupBy("camera_id").agg(F.sum("length").alias("bytes"), F.count("*").alias("files")), "camera_id", "left")


def primary_histogram(rows: DataFrame) -> DataFrame:
    """AGG-7: every event once, under its first object label."""
    label = rules.first_object_label(F.col("labels")).alias("label")
    return rows.select("camera_id", label).where(F.col("label").isin(*rules.COUNTED_LABELS, "motion")).groupBy("camera_id", "label").agg(F.count("*").alias("n"))


def zero_filled(counts: DataFrame, key: str, names: Iterable[str]) -> DataFrame:
    """AGG-8: counts with a zero for every name that doesn't occur."""
    base = counts.sparkSession.createDataFrame([(n, 0) for n in names], f"{key} string, n long")
    return counts.select(key, "n").unionByName(base).groupBy(key).agg(F.sum("n").alias("n"))


def goal_progress(rows: DataFrame, target: int) -> DataFrame:
    """AGG-9: events, species and days of a goal, capped at its target."""
    species = rules.blank_to_null(F.lower(F.col("bird_species")))
    cap = lambda c: F.least(c, F.lit(target))
    return rows.agg(cap(F.count("*")).alias("events"), cap(F.count_distinct(species)).alias("species"), cap(F.count_distinct(F.substring("time", 1, 10))).alias("days"))


def daily_report(rows: DataFrame) -> DataFrame:
    """AGG-10: labels per camera with the camera's total, largest first."""
    counts = rows.groupBy("camera_id", rules.most_specific_label(F.col("labels")).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("camera_id"))).orderBy(F.desc("total"), "camera_id", F.desc("n"), "label")


def first_seen(rows: DataFrame, key: str) -> DataFrame:
    """AGG-25: first event, camera and time of each value, and the events that show it."""
    seen = rows.where(F.col(key).isNotNull()).groupBy(key, "event_id").agg(F.min("camera_id").alias("camera_id"), F.min("ts").alias("ts"))
    first = F.struct("ts", "event_id", "camera_id")
    return seen.groupBy(key).agg(F.min(first).alias("first"), F.count("*").alias("n")).select(key, "first.event_id", "first.camera_id", F.col("first.ts").alias("ts"), "n")


def heat_map(rows: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """AGG-16: camera by hours ago, every cell filled."""
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600)
    recent = rows.select("camera_id", age.alias("ago")).where(F.col("ago").between(0, hours - 1))
    cells = recent.groupBy("camera_id").pivot("ago", list(range(hours))).count()
    return cells.na.fill(0).withColumnsRenamed({str(h): f"h{h}" for h in range(hours)})


def separation(rows: DataFrame, value: str, positive: Column, least: int = 30, least_each: int = 8) -> DataFrame:
    """AGG-21: a threshold midway between two classes' medians, with recall and rejection."""
    stats = rows.agg(
        F.count("*").alias("n"), F.count_if(positive).alias("n_pos"), F.percentile(F.when(positive, F.col(value)), 0.5).alias("m_pos"), F.percentile(F.when(~positive, F.col(value)), 0.5).alias("m_neg")
    ).where((F.col("n") >= least) & (F.col("n_pos") >= least_each) & (F.col("n") - F.col("n_pos") >= least_each))
    stats = stats.withColumn("threshold", (F.col("m_pos") + F.col("m_neg")) / 2)
    over = F.col(value) >= F.col("threshold")
    both = rows.crossJoin(F.broadcast(stats))  # one row
    return both.groupBy("n", "m_pos", "m_neg", "threshold").agg(F.avg(F.when(positive, over.cast("double"))).alias("recall"), F.avg(F.when(~positive, (~over).cast("double"))).alias("rejection"))


def grade(duplicates: Column, unique_fps: Column, declared: Column) -> Column:
    """AGG-22; four fifths of ``declared`` are divided, as 0.8 * 6 is a little more than 4.8."""
    return F.when(declared <= 0, "red").when((duplicates < 0.10) & (unique_fps >= 4 * declared / 5), "green").when(duplicates < 0.25, "yellow").otherwise("red")


def highlight(rows: DataFrame, since: str, dull: Iterable[str] = ()) -> DataFrame:
    """TOP-5: the day's best detection by weighted score."""
    label = rules.first_object_label(F.col("labels"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in rules.LABEL_WEIGHTS.items() for x in kv])[F.col("primary")], F.lit(1.0))
    out = rows.withColumn("primary", label).where((F.col("time") >= since) & (F.col("primary") != "motion") & (F.col("score") >= 0.70))
    for name in dull:
        out = out.where(~((F.col("primary") == "bird") & F.coalesce(F.lower("bird_species").contains(name), F.lit(False))))
    return out.withColumn("points", F.col("score") * weight).orderBy(F.desc("points"), "event_id").limit(1)


# --- Sets (SET) and dimension joins (JN) ---------------------------------------------------------------------------------


def distinct_events(*parts: DataFrame) -> DataFrame:
    """SET-1/2: union of event lists, one row per id, the newest wins."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    best = rows.groupBy("event_id").agg(F.max_by(F.struct(*rows.columns), "time").alias("r"))
    return best.select("r.*")


def with_review(rows: DataFrame, reviews: DataFrame) -> DataFrame:
    """JN-2: reviews are keyed camera:event."""
    return rows.withColumn("review_key", F.concat_ws(":", "camera_id", "event_id")).join(reviews, "review_key", "left")


def with_camera_name(rows: DataFrame, cameras: DataFrame) -> DataFrame:
    """JN-3: the camera's name, else its id. Spark broadcasts the dimension while it is small."""
    return rows.join(cameras.select(F.col("id").alias("camera_id"), "name"), "camera_id", "left").withColumn("camera_name", F.coalesce("name", "camera_id")).drop("name")


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Every row with its ``place`` from 1 in the order of all rows, which must be a total one.

    Rows are sorted by range and written once, so that no task sees them all: a row's place is the number of rows in the ranges before its own and its place there.
    """
    folder = shared_folder(rows.sparkSession, "placed")
    rows.orderBy(*order).withColumn("_range", F.spark_partition_id()).write.parquet(folder)
    ranges = rows.sparkSession.read.parquet(folder)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    starts = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    within = ranges.withColumn("_nth", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return within.join(starts, "_range").withColumn("place", F.col("_before") + F.col("_nth")).drop("_range", "_before", "_nth")
