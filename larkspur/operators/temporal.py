"""Time-ordered operators as window functions: novelty, confirmation, sessions, hysteresis, runs, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import rules


def seconds(c: Column) -> Column:
    """Whole seconds since the epoch of a TIMESTAMP_NTZ (UTC session)."""
    return F.unix_timestamp(c.cast("timestamp"))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def previous_in_group(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """JN-14: the latest strictly earlier row's id and time, by a range frame that ends one second before."""
    before = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("prev", F.max(F.struct(F.col(at).alias("at"), "event_id")).over(before))


def first_since(events: DataFrame) -> DataFrame:
    """WIN-1/2: the label with the largest gap over its threshold, and whether the gap is a record of its camera and label."""
    label_hours = F.create_map(*[F.lit(x) for kv in rules.NOVELTY_HOURS.items() for x in kv])
    each = events.where("time <> ''").select("event_id", "camera_id", seconds(F.col("ts")).alias("s"), F.posexplode("labels").alias("pos", "label")).where("label <> 'motion'")
    gap = previous_in_group(each, ["camera_id", "label"], "s").where("prev is not null").withColumn("gap_h", (F.col("s") - F.col("prev.at")) / 3600.0)
    fired = gap.where(F.col("gap_h") >= F.coalesce(label_hours[F.col("label")], F.lit(rules.NOVELTY_DEFAULT)))
    best = fired.groupBy("event_id", "camera_id", "s").agg(F.max(F.struct("gap_h", (-F.col("pos")).alias("p"), "label", F.col("prev.event_id").alias("previous"))).alias("b"))
    marks = best.select("event_id", "camera_id", "s", "b.label", "b.previous", F.round("b.gap_h", 1).alias("gap_hours"))
    earlier = Window.partitionBy("camera_id", "label").orderBy("s", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("is_new_record", F.col("gap_hours") > F.coalesce(F.max("gap_hours").over(earlier), F.lit(0.0)))


def confirm_live(hits: DataFrame, keys: list[str], at: str, n: int = 3, window: int = 5) -> DataFrame:
    """WIN-3: the hit that first makes n within the window (seconds, inclusive) since the last silence of twice the window."""
    w = Window.partitionBy(*keys).orderBy(at)
    us = window * 1_000_000
    rows = hits.withColumn("sitting", F.sum(F.when(F.col(at) - F.lag(at).over(w) > 2 * us, 1).otherwise(0)).over(w))
    recent = Window.partitionBy(*keys).orderBy(at).rangeBetween(-us, 0)
    rows = rows.withColumn("hits", F.count("*").over(recent)).where(F.col("hits") >= n)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "sitting").orderBy(at))).where("nth = 1").drop("nth")


def confirm_clip(samples: DataFrame, keys: list[str], at: str, n: int, secs: float) -> DataFrame:
    """WIN-4: whether any n samples in a row lie within ``secs``."""
    w = Window.partitionBy(*keys).orderBy(at)
    return samples.withColumn("span", F.lead(at, n - 1).over(w) - F.col(at)).groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("span") <= secs), F.lit(False)).alias("confirmed"))


def two_of_three(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """WIN-5."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-2, 0)
    return rows.withColumn("motion", F.sum(flag.cast("int")).over(w) >= 2)


def session_lanes(rows: DataFrame, gap: str = "2 minutes") -> DataFrame:
    """WIN-6: points of a camera and label whose gaps stay within two minutes."""
    out = rows.groupBy("camera_id", "label", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n"))
    return out.drop("w")


def swim_lanes(rows: DataFrame, now: str, seconds_back: int = 60) -> DataFrame:
    """WIN-7: the last label of each lane within the look-back."""
    age = seconds(F.lit(now).cast("timestamp_ntz")) - seconds(F.col("ts"))
    return rows.where(age.between(0, seconds_back)).groupBy("lane").agg(F.max_by("label", F.struct("ts", "event_id")).alias("label"), F.count("*").alias("n"))


def hysteresis(rows: DataFrame, keys: list[str], at: str, value: str, on: float, off: float) -> DataFrame:
    """WIN-11: rows where the state turns on (value >= on); it turns off below ``off`` (<= on). Nulls are ignored."""
    w = Window.partitionBy(*keys).orderBy(at)
    state = F.last(F.when(F.col(value) >= on, 1).when(F.col(value) < off, 0), True).over(w)
    rows = rows.withColumn("state", F.coalesce(state, F.lit(0)))
    return rows.withColumn("was", F.coalesce(F.lag("state").over(w), F.lit(0))).where("state = 1 and was = 0").drop("state", "was")


def latest_values(rows: DataFrame, at: str, fields: list[str]) -> DataFrame:
    """WIN-13: the latest non-null value of each field, in one aggregate."""
    return rows.agg(*[F.max_by(F.when(F.col(f).isNotNull(), F.col(f)), F.when(F.col(f).isNotNull(), F.col(at))).alias(f) for f in fields])


def latest_slot(rows: DataFrame, at: str, fields: list[str], as_of: str | None = None) -> DataFrame:
    """WIN-12: the latest row with any measurement (up to ``as_of``, where given)."""
    if as_of:
        rows = rows.where(F.col(at) <= F.lit(as_of).cast("timestamp_ntz"))
    return rows.where(F.coalesce(*[F.col(f) for f in fields]).isNotNull()).orderBy(F.col(at).desc()).limit(1)


def islands(rows: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """WIN-14/21/33: runs of consecutive rows with the same flag: start, end, rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("flag", flag)
    rows = rows.withColumn("run", F.sum(F.when(~F.col("flag").eqNullSafe(F.lag("flag").over(w)), 1).otherwise(0)).over(w))
    return rows.groupBy(*keys, "run", "flag").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("run")


def chart_lines(rows: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """WIN-14: each field of a series as points of a unit square: ``(keys, order, field, run, x, y, smooth)``.

    x is the row's place in the series. y falls from 1 at the field's least value to 0 at its largest; a flat line is at half height. Nulls and values that
    are not finite end a run; runs count from 1, and those of six points or more are smooth. A field with fewer than two values has no line.
    """
    series, line = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, "field").orderBy("_i")
    long = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("v")) for f in fields]))
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    # What is one figure a line comes from an aggregation: a window without an order would hold the whole line.
    whole = rows.select(*keys, long).groupBy(*keys, "field").agg(F.count("*").alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.count(finite).alias("_known")).where("_known >= 2")
    whole = whole.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("field").alias("_of_field"), "_n", "_lo", "_hi", "_known")
    placed = rows.select(*keys, order, *[f for f in fields if f not in (*keys, order)]).withColumn("_i", F.row_number().over(series) - 1)
    # Dealt out anew by field, so that a task has one line, not all of a series.
    long = placed.select(*keys, order, "_i", long).withColumn("v", finite).repartition(*keys, "field")
    long = long.withColumn("_starts", F.col("v").isNotNull() & F.lag("v").over(line).isNull())
    long = long.withColumn("run", F.sum(F.col("_starts").cast("int")).over(line)).where("v is not null")
    long = long.join(whole, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "field"]]).drop(*[f"_of_{k}" for k in [*keys, "field"]])
    long = long.repartition(*keys, "field", "run")
    y = F.when(F.col("_hi") - F.col("_lo") < 1e-9, (F.col("_lo") + 0.5 - F.col("v")).cast("double")).otherwise(1 - (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    x = F.when(F.col("_n") > 1, F.col("_i") / (F.col("_n") - 1)).otherwise(0.0)
    smooth = F.count("*").over(Window.partitionBy(*keys, "field", "run")) >= 6
    return long.select(*keys, order, "field", "run", x.alias("x"), y.alias("y"), smooth.alias("smooth"))


def every_kth(rows: DataFrame, keys: list[str], order: str, k: int) -> DataFrame:
    """WIN-15: rows number int(i * n / k) for i below k."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumns({"nth": F.row_number().over(w.orderBy(order)) - 1, "of": F.count("*").over(w)})
    # Row r is taken if some i has floor(i * n / k) = r.
    i = F.ceil(F.col("nth") * k / F.col("of"))
    return rows.where((F.floor(i * F.col("of") / k) == F.col("nth")) & (i < k)).drop("nth", "of")


def rising(slots: DataFrame, at: str, value: str, now: str, below: float = 500, peak: float = 1500, minutes: int = 90) -> DataFrame:
    """WIN-17: quiet now and a peak ahead; score is the peak's share of 3000."""
    ahead = (seconds(F.col(at)) - seconds(F.lit(now).cast("timestamp_ntz"))) / 60
    out = slots.agg(F.max_by(value, F.when(ahead <= 0, F.col(at))).alias("now"), F.max(F.when(ahead.between(0, minutes), F.col(value))).alias("peak"))
    return out.where((F.col("now").isNull() | (F.col("now") < below)) & (F.col("peak") >= peak)).withColumn("score", F.least(F.lit(1.0), F.col("peak") / 3000))


def front_passing(slots: DataFrame, at: str, cloud: str, gust: str, minutes: int = 60, d_cloud: float = 50, d_gust: float = 20) -> DataFrame:
    """WIN-18/JN-15: the first pair of slots within an hour whose cloud and gusts both jump.

    Slots meet by hour buckets, so the join is an equi-join: a later slot within the hour lies in the same bucket or the next.
    """
    s = seconds(F.col(at))
    rows = slots.select(s.alias("s"), F.floor(s / (minutes * 60)).alias("b"), F.col(cloud).alias("c"), F.col(gust).alias("g"))
    later = rows.select(F.explode(F.array(F.col("b"), F.col("b") - 1)).alias("b"), F.col("s").alias("s2"), F.col("c").alias("c2"), F.col("g").alias("g2"))
    pairs = rows.join(later, "b").where((F.col("s2") > F.col("s")) & (F.col("s2") - F.col("s") <= minutes * 60) & (F.abs(F.col("c2") - F.col("c")) > d_cloud) & (F.abs(F.col("g2") - F.col("g")) > d_gust))
    return pairs.select("s", "s2", (F.col("c2") - F.col("c")).alias("d_cloud"), (F.col("g2") - F.col("g")).alias("d_gust")).orderBy("s", "s2").limit(1)


def track_motion(samples: DataFrame, keys: list[str], at: str) -> DataFrame:
    """WIN-20/22: net displacement, path length, straightness and largest step of box centres."""
    w = Window.partitionBy(*keys).orderBy(at)
    rows = samples.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    rows = rows.withColumn("step", F.sqrt(F.pow(F.col("cx") - F.lag("cx").over(w), 2) + F.pow(F.col("cy") - F.lag("cy").over(w), 2)))
    ends = F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"))
    out = rows.groupBy(*keys).agg(F.min_by(ends, at).alias("a"), F.max_by(ends, at).alias("b"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.coalesce(F.max("step"), F.lit(0.0)).alias("max_step"), F.count("*").alias("age"))
    net = F.sqrt(F.pow(F.col("b.x") - F.col("a.x"), 2) + F.pow(F.col("b.y") - F.col("a.y"), 2))
    return out.withColumn("net", net).withColumn("straightness", F.when(F.col("path") > 0, F.col("net") / F.col("path")).otherwise(0.0)).drop("a", "b")


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted values; for bounded groups (a clip's samples)."""
    return F.get(F.array_sort(F.collect_list(values)), F.floor(F.count(values) / 2).cast("int"))


def recent_speed(samples: DataFrame, keys: list[str], at: str, last: int = 6) -> DataFrame:
    """WIN-22: mean and upper median of the steps between the last six detections of a track."""
    w, back = Window.partitionBy(*keys).orderBy(at), Window.partitionBy(*keys).orderBy(F.desc(at))
    rows = samples.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    rows = rows.withColumn("step", F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))).withColumn("nth", F.row_number().over(back))
    return rows.where((F.col("nth") < last) & F.col("step").isNotNull()).groupBy(*keys).agg(F.avg("step").alias("mean_step"), upper_median(F.col("step")).alias("median_step"))


def static_false_positive(samples: DataFrame, keys: list[str], at: str, spawn: float, share: float = 0.5, least: int = 3) -> DataFrame:
    """WIN-23: faint tracks that hardly move for their size."""
    moved = track_motion(samples, keys, at)
    size = samples.groupBy(*keys).agg(upper_median(F.col("score")).alias("score"), upper_median(F.col("x2") - F.col("x1")).alias("w"), upper_median(F.col("y2") - F.col("y1")).alias("h"))
    both = moved.join(size, keys)
    floor = share * F.least("w", "h")
    drop = (F.col("age") >= least) & (F.col("score") < spawn) & (F.least("w", "h") > 0) & (F.col("net") < floor) & (F.col("max_step") < floor)
    return both.select(*keys, drop.alias("static"))


def goal_window(name: str, now: str) -> tuple[Column, Column]:
    """WIN-24: start and end of a goal's window at ``now``; null while it is closed."""
    at = F.lit(now).cast("timestamp_ntz")
    start = {
        "december": F.when(F.month(at) == 12, F.make_date(F.year(at), F.lit(12), F.lit(1)).cast("timestamp_ntz")),
        "april_rolling_week": F.when(F.month(at) == 4, F.greatest(F.make_date(F.year(at), F.lit(4), F.lit(1)).cast("timestamp_ntz"), at - F.expr("interval 7 days"))),
        "year_to_date": F.make_date(F.year(at), F.lit(1), F.lit(1)).cast("timestamp_ntz"),
        "current_calendar_month": F.make_date(F.year(at), F.month(at), F.lit(1)).cast("timestamp_ntz"),
        "current_rolling_week": at - F.expr("interval 7 days"),
    }[name]
    return start, F.when(start.isNotNull(), at)


def last_sunday(day: Column) -> Column:
    """WIN-26: the last Sunday of the day's month."""
    last = F.last_day(day)
    return F.date_sub(last, F.dayofweek(last) - 1)


def backfill(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """WIN-32: slots without a value take the last one before them, with the number of slots in a row that had to."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = rows.withColumn("filled", F.last(value, True).over(w)).withColumn("since", F.count(value).over(w))
    return rows.withColumn("reused", F.row_number().over(Window.partitionBy(*keys, "since").orderBy(order)) - F.when(F.col("since") > 0, 1).otherwise(0)).drop("since")


def trails(samples: DataFrame, keys: list[str], at: str, n: int = 12) -> DataFrame:
    """WIN-34: the last n centres of tracks with two or more."""
    rows = samples.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(at).desc()))).where(F.col("rank") <= n)
    points = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))))
    return rows.groupBy(*keys).agg(points.alias("trail")).where(F.size("trail") >= 2)


def around(frames: DataFrame, triggers: DataFrame, key: str, at: str, before: float = 5.0, after: float = 5.0) -> DataFrame:
    """STR-12: the frames from ``before`` seconds before each trigger to ``after`` seconds behind it.

    Both sides meet by buckets as wide as the span, so each frame is looked for in two of them.
    """
    span = int((before + after) * 1e6)
    f = frames.withColumn("b", F.floor(F.col(at) / span))
    t = triggers.select(key, F.col("event_id").alias("trigger"), F.col(at).alias("t_us"), F.explode(F.sequence(F.floor((F.col(at) - int(before * 1e6)) / span), F.floor((F.col(at) + int(after * 1e6)) / span))).alias("b"))
    return f.join(t, [key, "b"]).where(F.col(at).between(F.col("t_us") - int(before * 1e6), F.col("t_us") + int(after * 1e6))).drop("b", "t_us")


def recap_periods(years: DataFrame, overshoot: bool = False) -> DataFrame:
    """WIN-26: quarters and the year: run date (last Sunday of March, June and September; of December for the year) and bounds.

    ``overshoot`` reproduces quarter ends that reach one month too far.
    """
    month = lambda m: F.make_date(F.col("year"), m, F.lit(1))
    q = years.select("year", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("q"))
    end = F.last_day(month(F.col("q") * 3))
    end = F.last_day(F.date_add(end, 1)) if overshoot else end
    quarters = q.select(F.concat(F.lit("q"), "q", F.lit("_"), "year").alias("period_id"), last_sunday(month(F.col("q") * 3)).alias("run_on"), month(F.col("q") * 3 - 2).alias("start"), end.alias("end"))
    whole = years.select(F.concat(F.lit("year_"), "year").alias("period_id"), last_sunday(month(F.lit(12))).alias("run_on"), month(F.lit(1)).alias("start"), F.last_day(month(F.lit(12))).alias("end"))
    return quarters.unionByName(whole)
