"""Scalar rules as Column expressions: text, clocks, labels, severities. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in natural order.
OBJECT_LABELS = ("person", "car", "dog", "cat", "squirrel", "fox", "hedgehog", "bird")
COUNTED_LABELS = ("person", "cat", "bird", "car", "dog", "squirrel")
LABEL_WEIGHTS = {"squirrel": 1.5, "fox": 1.5}
IMPOSSIBLE = ("airplane", "baseball bat", "baseball glove", "baseball_bat", "baseball_glove", "bear", "boat", "bus", "cow", "elephant", "fire hydrant", "fire_hydrant", "frisbee", "giraffe", "horse", "kite", "parking meter", "parking_meter", "sheep", "skateboard", "skis", "snowboard", "stop sign", "stop_sign", "surfboard", "traffic light", "traffic_light", "train", "truck", "zebra")
RAIN_BANDS = ((0.0, "Trocken"), (0.5, "Nieselregen"), (2.5, "Leichter Regen"), (7.5, "Mäßiger Regen"), (15.0, "Starker Regen"))
KIND_OF = {"bird": "vogel", "cat": "katze", "person": "person", "dog": "wildtier", "fox": "wildtier", "hedgehog": "wildtier", "squirrel": "wildtier", "deer": "wildtier", "horse": "wildtier"}
NOVELTY_HOURS = {"person": 6.0, "bird": 4.0, "cat": 8.0, "dog": 12.0, "squirrel": 12.0, "fox": 24.0, "hedgehog": 24.0, "marten": 24.0, "deer": 48.0}
NOVELTY_DEFAULT = 8.0
COOLDOWN_SECONDS = {"person": 60, "cat": 120, "bird": 300, "squirrel": 300, "dog": 120, "car": 30, "motion": 30}
SEVERITIES = ("off", "info", "alarm")
UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "ß": "ss"}
PALETTE = ("#22c55e", "#3b82f6", "#f59e0b", "#ef4444", "#a855f7", "#14b8a6", "#ec4899", "#84cc16", "#f97316", "#06b6d4", "#eab308", "#8b5cf6", "#10b981", "#f43f5e", "#0ea5e9")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def parse_hours(c: Column) -> Column:
    """FN-3: '8h', '90m', '3600s' or a number of hours; null if none of these."""
    s = F.lower(F.trim(c))
    body = F.substr(s, F.lit(1), F.length(s) - 1).try_cast("double")
    return F.when(s.endswith("h"), body).when(s.endswith("m"), body / 60).when(s.endswith("s"), body / 3600).otherwise(s.try_cast("double"))


def minutes_of(c: Column) -> Column:
    """FN-4: minutes of the day of 'HH:MM'; garbage is midnight."""
    parts = F.split(F.trim(c), ":")
    h, m = F.get(parts, F.lit(0)).try_cast("int"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0))
    return F.when(h.between(0, 23) & m.between(0, 59), h * 60 + m).otherwise(F.lit(0))


def window_minutes(start: Column, end: Column) -> Column:
    """FN-5: length of a daily window; equal ends are a whole day."""
    return F.when(start == end, 1440).otherwise(F.pmod(end - start, F.lit(1440)))


def in_window(now: Column, start: Column, end: Column, equal: bool) -> Column:
    """FLT-11/12: minutes of the day within [start, end), over midnight where start > end; ``equal`` decides start = end."""
    return F.when(start == end, F.lit(equal)).when(start < end, (now >= start) & (now < end)).otherwise((now >= start) | (now < end))


def schedule_active(enabled: Column, action: Column, now: Column, start: Column, end: Column) -> Column:
    """FLT-13: without an enabled schedule always; else the action's toggle and the window."""
    return ~F.coalesce(enabled, F.lit(False)) | (F.coalesce(action, F.lit(True)) & in_window(now, start, end, True))


def slug(c: Column) -> Column:
    """FN-6: umlauts spelled out, other marks dropped, lower case, a-z and 0-9 only."""
    out = F.coalesce(c, F.lit(""))
    for a, b in UMLAUTS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    # Accented Latin letters and their base letters.
    accented, base = "àáâãåçèéêëìíîïñòóôõùúûýÿ", "aaaaaceeeeiiiinoooouuuyy"
    out = F.translate(F.lower(out), accented, base)
    return F.regexp_replace(out, "[^a-z0-9]+", "")


def last_ip_segment(ip: Column) -> Column:
    """FN-7: the last dotted part, else the last colon part without a zone, else ''."""
    s = F.coalesce(F.trim(ip), F.lit(""))
    dotted = F.when(s.contains("."), slug(F.element_at(F.split(s, r"\."), -1))).otherwise(F.lit(""))
    colon = F.when(s.contains(":"), slug(F.element_at(F.split(F.element_at(F.split(s, "%"), 1), ":"), -1))).otherwise(F.lit(""))
    return F.when(dotted != "", dotted).otherwise(colon)


def camera_key(manufacturer: Column, model: Column, name: Column, ip: Column) -> Column:
    """FN-8: four segments joined by underscores, 'unknown' for empty ones."""
    parts = [*map(slug, (manufacturer, model, name)), last_ip_segment(ip)]
    return F.concat_ws("_", *[F.when(p == "", "unknown").otherwise(p) for p in parts])


def camera_slug(name: Column, camera_id: Column) -> Column:
    """FN-9: the name's slug, the id's slug, or a short hash of both."""
    a, b = slug(name), slug(camera_id)
    seed = F.concat(F.coalesce(name, F.lit("")), F.lit("|"), F.coalesce(camera_id, F.lit("")))
    return F.when(a != "", a).when(b != "", b).otherwise(F.concat(F.lit("cam"), F.substring(F.sha1(seed), 1, 6)))


def url_host(url: Column) -> Column:
    """FN-10: the host of a stream URL, without credentials and port."""
    return F.nullif(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^@/]*@)?([^:/?#]+)", 1), F.lit(""))


def binomial(latin: Column) -> Column:
    """FN-11: 'Genus species' of a longer name."""
    words = F.split(F.trim(latin), r"\s+")
    return F.when(F.size(words) >= 2, F.concat(F.initcap(words[0]), F.lit(" "), F.lower(words[1])))


def rain_band(mm: Column) -> Column:
    """FN-14: intensity band of a rate in mm/h; null is dry."""
    out = F.lit("Starkregen")
    for top, name in reversed(RAIN_BANDS):
        out = F.when(mm <= top, name).otherwise(out)
    return F.when(mm.isNull(), RAIN_BANDS[0][1]).otherwise(out)


def most_specific_label(labels: Column) -> Column:
    """FN-15a: the first object label by priority, else motion, else the first label."""
    ranked = F.filter(F.array(*map(F.lit, (*OBJECT_LABELS, "motion"))), lambda x: F.array_contains(labels, x))
    return F.when(labels.isNull() | (F.size(labels) == 0), "motion").otherwise(F.coalesce(F.get(ranked, F.lit(0)), F.get(labels, F.lit(0))))


def first_object_label(labels: Column) -> Column:
    """FN-15b: the first object label in the list's own order, else motion if there (or no label at all), else null."""
    first = F.get(F.filter(labels, lambda x: x.isin(*COUNTED_LABELS)), F.lit(0))
    return F.when(labels.isNull() | (F.size(labels) == 0), "motion").otherwise(F.coalesce(first, F.when(F.array_contains(labels, "motion"), "motion")))


def named_label(species: Column, cat: Column, top: Column, labels: Column) -> Column:
    """FN-15c: species, else cat name, else top label, else the first label."""
    return F.coalesce(blank_to_null(species), blank_to_null(cat), blank_to_null(top), F.get(labels, F.lit(0)), F.lit(""))


def event_kind(species: Column, cat: Column, top: Column, labels: Column) -> Column:
    """FN-16: vogel, katze, person, wildtier or sonstiges."""
    kinds = F.create_map(*[F.lit(x) for kv in KIND_OF.items() for x in kv])
    found = F.filter(F.transform(F.concat(F.array(top), F.coalesce(labels, F.array().cast("array<string>"))), lambda x: kinds[F.lower(x)]), lambda x: x.isNotNull())
    return F.when(blank_to_null(species).isNotNull(), "vogel").when(blank_to_null(cat).isNotNull(), "katze").otherwise(F.coalesce(F.get(found, F.lit(0)), F.lit("sonstiges")))


def severity(matrix: Column, labels: Column) -> Column:
    """FN-17: the highest severity that a map assigns to the labels; off without any."""
    ranks = F.transform(labels, lambda x: F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(F.coalesce(F.try_element_at(matrix, x), F.lit("off")))))
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.greatest(F.coalesce(F.array_max(ranks), F.lit(1)), F.lit(1)).cast("int"))


def alarm_level(profile: Column, labels: Column, hard: Column, whitelisted: Column) -> Column:
    """FN-18: struct(level, notify) of the profile's decision table."""
    p = F.coalesce(blank_to_null(profile), F.lit("soft"))
    seen = F.when(labels.isNull() | (F.size(labels) == 0), F.array(F.lit("motion"))).otherwise(labels)
    has = lambda *x: F.arrays_overlap(seen, F.array(*map(F.lit, x)))
    out = lambda level, notify: F.struct(F.lit(level).alias("level"), F.lit(notify).alias("notify"))
    animals = ("cat", "bird", "dog", "squirrel")
    return (
        F.when(whitelisted, out("logged", False))
        .when(hard & has("person"), out("alarm", True))
        .when(has("person", "car") & (p == "hard"), out("alarm", True))
        .when((has("person", "car", *animals) & (p == "medium")) | (has(*animals) & (p == "info")) | (p == "soft"), out("info", True))
        .when(has("motion") & p.isin("hard", "medium"), out("info", True))
        .otherwise(out("logged", False))
    )


def colour_of(track: Column) -> Column:
    """FN-25: a colour by the sum of code points."""
    codes = F.transform(F.filter(F.split(track, ""), lambda c: c != ""), lambda c: F.ascii(c))
    total = F.aggregate(codes, F.lit(0), lambda a, c: a + c)
    return F.element_at(F.array(*map(F.lit, PALETTE)), (total % len(PALETTE) + 1).cast("int"))


def achievement_tier(n: Column) -> Column:
    """FN-26."""
    return F.when(n >= 20, "gold").when(n >= 5, "silver").when(n >= 1, "bronze").otherwise("locked")


def relative_age(seconds: Column) -> Column:
    """FN-27: minutes, hours or days."""
    m = F.floor(seconds / 60)
    return F.when(m < 60, F.concat(m, F.lit(" min"))).when(m < 1440, F.concat(F.floor(m / 60), F.lit(" h"))).otherwise(F.concat(F.floor(m / 1440), F.lit(" d")))


def csv_list(c: Column) -> Column:
    """FN-30: comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def clamp(c: Column, low: float, high: float) -> Column:
    """FN-31."""
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def tier(score: Column, spawn: Column) -> Column:
    """FN-22: confirmed from the spawn score on."""
    return F.when(score >= spawn, "confirmed").otherwise("tentative")


def grace_samples(seconds: Column, rate: Column, default: int = 8) -> Column:
    """FN-22: seconds as samples, rounded half to even, at least one."""
    return F.when((seconds > 0) & (rate > 0), F.greatest(F.rint(seconds * rate).cast("int"), F.lit(1))).otherwise(F.lit(default))


def reason_head(reason: Column) -> Column:
    """FN-23: a rejection reason without its position suffix and arguments."""
    return F.regexp_extract(F.regexp_replace(reason, r"_y\d+_h\d+$", ""), r"^([^(:=\s]*)", 1)


def caption(c: Column, size: int = 1024) -> Column:
    """FN-34: cut to ``size`` characters, the last one an ellipsis."""
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - 1), F.lit("…"))).otherwise(c)


def summary_line(*parts: Column) -> Column:
    """FN-33: the first three parts that are there."""
    return F.concat_ws(" · ", F.slice(F.array_compact(F.array(*parts)), 1, 3))


def string_hash(c: Column) -> Column:
    """FN-28: h = 31 h + code point in 32 bits with sign, then its absolute value."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    wrap = lambda v: F.pmod(v + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, x: wrap(h * 31 + x)))


def to_bool(c: Column) -> Column:
    """FN-24: the words for true and false; null for others."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off", ""), False)


# Genera and the category they stand for, first match wins.
GENUS_RULES = (("sciurus", "squirrel"), ("tamias", "squirrel"), ("vulpes", "fox"), ("erinaceus", "hedgehog"), ("meles", "hedgehog"))


def first_containing(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """FN-12: the category of the first needle that the lower-cased text holds, else null."""
    return F.coalesce(*[F.when(F.lower(c).contains(needle), category) for needle, category in table])


def composed_severity(level: Column, notify: Column, matrix: Column, labels: Column, whitelisted: Column, armed: Column) -> Column:
    """FN-19: struct(severity, notify): a severity map overrides the profile unless whitelisted; disarmed never notifies."""
    mapped = (F.size(matrix) > 0) & ~whitelisted
    own = severity(matrix, labels)
    out = F.when(mapped, own).otherwise(F.when(level == "alarm", "alarm").when(notify, "info").otherwise("off"))
    tell = F.when(mapped, own != "off").otherwise(notify) & F.coalesce(armed, F.lit(True))
    return F.struct(out.alias("severity"), tell.alias("notify"))


def nice_number(v: Column, rounded: bool) -> Column:
    """FN-29: 1, 2, 5 or 10 times a power of ten, at or near the value."""
    exp = F.floor(F.log10(v))
    f = v / F.pow(F.lit(10.0), exp)
    steps = ((1.5, 1.0), (3.0, 2.0), (7.0, 5.0)) if rounded else ((1.0, 1.0), (2.0, 2.0), (5.0, 5.0))
    nice = F.lit(10.0)
    for top, n in reversed(steps):
        nice = F.when((f < top) if rounded else (f <= top), n).otherwise(nice)
    return F.when(v > 0, nice * F.pow(F.lit(10.0), exp)).otherwise(1.0)


def window_end(name: str, start: Column) -> Column:
    """WIN-25: the last second of a goal window's period; null where it never closes."""
    year = F.year(start)
    last = {
        "december": F.make_date(year, F.lit(12), F.lit(31)),
        "april_rolling_week": F.make_date(year, F.lit(4), F.lit(30)),
        "year_to_date": F.make_date(year, F.lit(12), F.lit(31)),
        "current_calendar_month": F.last_day(start),
        "current_rolling_week": F.lit(None).cast("date"),
    }[name]
    return last.cast("timestamp_ntz") + F.expr("interval 86399 seconds")


def sun_position(at: Column, latitude: float, longitude: float) -> Column:
    """GEO-17: struct(altitude, azimuth) of the sun in degrees, with refraction; ``at`` is seconds since 1970 in UTC.

    The published low-precision solar equations; azimuth counts from north to east.
    """
    sin, cos = (lambda x, f=f: f(F.radians(x)) for f in (F.sin, F.cos))
    c = (at / 86400 + F.lit(2440587.5 - 2451545.0)) / 36525
    mean_long = F.pmod(280.46646 + c * (36000.76983 + c * 0.0003032), F.lit(360.0))
    anomaly = 357.52911 + c * (35999.05029 - 0.0001537 * c)
    orbit = 0.016708634 - c * (0.000042037 + 0.0000001267 * c)
    centre = sin(anomaly) * (1.914602 - c * (0.004817 + 0.000014 * c)) + sin(2 * anomaly) * (0.019993 - 0.000101 * c) + sin(3 * anomaly) * 0.000289
    node = 125.04 - 1934.136 * c
    apparent = mean_long + centre - 0.00569 - 0.00478 * sin(node)
    tilt = 23 + (26 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60) / 60 + 0.00256 * cos(node)
    declination = F.degrees(F.asin(sin(tilt) * sin(apparent)))
    y = F.pow(F.tan(F.radians(tilt / 2)), F.lit(2.0))
    equation = 4 * F.degrees(y * sin(2 * mean_long) - 2 * orbit * sin(anomaly) + 4 * orbit * y * sin(anomaly) * cos(2 * mean_long) - 0.5 * y * y * sin(4 * mean_long) - 1.25 * orbit * orbit * sin(2 * anomaly))
    hour = F.pmod(F.pmod(at, F.lit(86400.0)) / 60 + equation + 4 * longitude, F.lit(1440.0)) / 4 - 180
    place = F.lit(float(latitude))
    high = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sin(place) * sin(declination) + cos(place) * cos(declination) * cos(hour)))))
    turn = F.degrees(F.atan2(sin(hour), cos(hour) * sin(place) - F.tan(F.radians(declination)) * cos(place)))
    slope = F.tan(F.radians(high))
    bend = (
        F.when(high > 85, 0.0)
        .when(high > 5, 58.1 / slope - 0.07 / F.pow(slope, F.lit(3.0)) + 0.000086 / F.pow(slope, F.lit(5.0)))
        .when(high > -0.575, 1735 + high * (-518.2 + high * (103.4 + high * (-12.79 + high * 0.711))))
        .otherwise(-20.774 / slope)
    )
    return F.struct((high + bend / 3600).alias("altitude"), F.pmod(turn + 180, F.lit(360.0)).alias("azimuth"))
