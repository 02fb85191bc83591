"""Scalar, spatial and hash functions over the event view and the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import geo, rules
from larkspur.operators import neighbours
from larkspur.plans import plan
from larkspur.plans.sql import EVENTS, FIRST_OBJECT, MOST_SPECIFIC, walk
from larkspur.sources import events as source
from larkspur.sources.events import events_view as events


@plan("fn_01_event_date", f"WITH {EVENTS}, x AS (SELECT event_id, CASE WHEN k % 10 = 0 THEN 'tl_x' ELSE strftime(ts, '%Y%m%d-%H%M%S') END AS id FROM e) SELECT event_id, CASE WHEN id LIKE '2%' THEN substr(id, 1, 4) || '-' || substr(id, 5, 2) || '-' || substr(id, 7, 2) END AS day FROM x")
def _(spark, sf_dir):
    ident = F.when(F.col("k") % 10 == 0, "tl_x").otherwise(F.date_format("ts", "yyyyMMdd-HHmmss"))
    return events(spark, sf_dir).select("event_id", source.event_date(ident).alias("day"))


@plan("fn_02_lenient_time", f"WITH {EVENTS} SELECT event_id, TRY_CAST(nullif(time, '') AS TIMESTAMP) IS NULL AS bad FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.try_to_timestamp("time").isNull().alias("bad"))


@plan("fn_03_parse_hours", f"WITH {EVENTS} SELECT event_id, CASE k % 5 WHEN 0 THEN CAST(k AS DOUBLE) WHEN 1 THEN k / 60.0 WHEN 2 THEN k / 3600.0 WHEN 3 THEN CAST(k AS DOUBLE) END AS hours FROM e")
def _(spark, sf_dir):
    k = F.col("k")
    text = F.when(k % 5 == 0, F.concat(k, F.lit("h"))).when(k % 5 == 1, F.concat(F.lit(" "), k, F.lit("M"))).when(k % 5 == 2, F.concat(k, F.lit("s"))).when(k % 5 == 3, k.cast("string")).otherwise("soon")
    return events(spark, sf_dir).select("event_id", rules.parse_hours(text).alias("hours"))


@plan("fn_04_clock_minutes", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 7 = 0 THEN 0 ELSE (k % 24) * 60 + k % 60 END AS minutes, CASE WHEN k % 7 = 0 OR (k % 24) * 60 + k % 60 = 0 THEN 1440 ELSE 1440 - ((k % 24) * 60 + k % 60) END AS span FROM e")
def _(spark, sf_dir):
    k = F.col("k")
    at = rules.minutes_of(F.when(k % 7 == 0, "noon").otherwise(F.concat(k % 24, F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))))
    return events(spark, sf_dir).select("event_id", at.cast("int").alias("minutes"), rules.window_minutes(at, F.lit(0)).cast("int").alias("span"))


@plan("fn_06_slug", "SELECT doc_id, regexp_replace(strip_accents(lower(replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss'))), '[^a-z0-9]+', '', 'g') AS slug FROM documents")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", rules.slug(F.col("text")).alias("slug"))


@plan("fn_08_camera_key", f"WITH {EVENTS} SELECT event_id, 'acme_' || CASE WHEN k % 4 = 0 THEN 'unknown' ELSE 'x' || k END || '_gaertchen_' || CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) WHEN k % 3 = 1 THEN '42' ELSE 'unknown' END AS key FROM e")
def _(spark, sf_dir):
    k = F.col("k")
    ip = F.when(k % 3 == 0, F.concat(F.lit("192.168.0."), k)).when(k % 3 == 1, "2001:db8::42%eth0")
    return events(spark, sf_dir).select("event_id", rules.camera_key(F.lit("ACME!"), F.when(k % 4 != 0, F.concat(F.lit("X-"), k)), F.lit("Gärtchen"), ip).alias("key"))


@plan("fn_09_camera_slug", f"WITH {EVENTS} SELECT event_id, CASE k % 3 WHEN 0 THEN 'nutbar' WHEN 1 THEN replace(camera_id, '_', '') ELSE 'cam' || substr(sha1('?!|'), 1, 6) END AS slug FROM e")
def _(spark, sf_dir):
    k = F.col("k") % 3
    name = F.when(k == 0, "Nut 'Bar'").when(k == 2, "?!")
    return events(spark, sf_dir).select("event_id", rules.camera_slug(name, F.when(k != 2, F.col("camera_id")).otherwise("")).alias("slug"))


@plan("fn_10_url_host", "SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^:/?#]+)', 1) AS host FROM pages")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", rules.url_host(F.col("url")).alias("host"))


@plan("fn_11_binomial", "SELECT p_partkey, upper(substr(a, 1, 1)) || lower(substr(a, 2)) || ' ' || lower(b) AS latin FROM (SELECT p_partkey, string_split(p_type, ' ')[1] AS a, string_split(p_type, ' ')[2] AS b FROM part WHERE contains(p_type, ' '))")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").where(F.col("p_type").contains(" ")).select("p_partkey", rules.binomial(F.concat(F.lit(" "), "p_type", F.lit(" sub"))).alias("latin"))


@plan("fn_14_rain_band", f"WITH {EVENTS} SELECT event_id, CASE WHEN k = 7 OR k / 5.0 <= 0 THEN 'Trocken' WHEN k / 5.0 <= 0.5 THEN 'Nieselregen' WHEN k / 5.0 <= 2.5 THEN 'Leichter Regen' WHEN k / 5.0 <= 7.5 THEN 'Mäßiger Regen' WHEN k / 5.0 <= 15 THEN 'Starker Regen' ELSE 'Starkregen' END AS band FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rules.rain_band(F.when(F.col("k") != 7, F.col("k") / 5.0)).alias("band"))


@plan("fn_15_primary_labels", f"WITH {EVENTS} SELECT event_id, {MOST_SPECIFIC} AS specific, {FIRST_OBJECT} AS first_object, coalesce(bird_species, cat_name, top_label) AS named FROM e")
def _(spark, sf_dir):
    labels = F.col("labels")
    return events(spark, sf_dir).select("event_id", rules.most_specific_label(labels).alias("specific"), rules.first_object_label(labels).alias("first_object"), rules.named_label(F.col("bird_species"), F.col("cat_name"), F.col("top_label"), labels).alias("named"))


@plan("fn_16_event_kind", f"WITH {EVENTS} SELECT event_id, CASE label WHEN 'bird' THEN 'vogel' WHEN 'cat' THEN 'katze' WHEN 'person' THEN 'person' WHEN 'squirrel' THEN 'wildtier' ELSE 'sonstiges' END AS kind FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rules.event_kind(F.col("bird_species"), F.col("cat_name"), F.col("top_label"), F.col("labels")).alias("kind"))


@plan("fn_17_severity", f"WITH {EVENTS} SELECT event_id, CASE WHEN list_contains(labels, 'person') THEN 'alarm' WHEN list_has_any(labels, ['cat', 'motion']) THEN 'info' ELSE 'off' END AS severity FROM e")
def _(spark, sf_dir):
    matrix = F.create_map(*map(F.lit, ("person", "ALARM", "cat", "info", "motion", "info", "bird", "off")))
    return events(spark, sf_dir).select("event_id", rules.severity(matrix, F.col("labels")).alias("severity"))


@plan(
    "fn_18_alarm_level",
    f"""WITH {EVENTS}, x AS (SELECT event_id, CASE WHEN len(labels) = 0 THEN ['motion'] ELSE labels END AS l, CASE k % 5 WHEN 0 THEN 'hard' WHEN 1 THEN 'medium' WHEN 2 THEN 'info' WHEN 3 THEN 'soft' ELSE 'other' END AS p, k % 11 = 0 AS hard, k % 17 = 0 AS ok FROM e)
    SELECT event_id, CASE WHEN ok THEN 'logged' WHEN hard AND list_contains(l, 'person') THEN 'alarm' WHEN p = 'hard' AND list_has_any(l, ['person', 'car']) THEN 'alarm'
      WHEN (p = 'medium' AND list_has_any(l, ['person', 'car', 'cat', 'bird', 'dog', 'squirrel'])) OR (p = 'info' AND list_has_any(l, ['cat', 'bird', 'dog', 'squirrel'])) OR p = 'soft' THEN 'info'
      WHEN list_contains(l, 'motion') AND p IN ('hard', 'medium') THEN 'info' ELSE 'logged' END AS level FROM x""",
)
def _(spark, sf_dir):
    profile = F.element_at(F.array(*map(F.lit, ("hard", "medium", "info", "soft", "other"))), F.col("k") % 5 + 1)
    level = rules.alarm_level(profile, F.col("labels"), F.col("k") % 11 == 0, F.col("k") % 17 == 0)
    return events(spark, sf_dir).select("event_id", level["level"].alias("level"))


@plan("fn_22_tier_and_grace", f"WITH {EVENTS} SELECT event_id, CASE WHEN score >= 0.55 THEN 'confirmed' ELSE 'tentative' END AS tier, CASE WHEN k % 10 > 0 THEN greatest(CAST(round_even((k % 10) * 0.5, 0) AS INT), 1) ELSE 8 END AS grace FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rules.tier(F.col("score"), F.lit(0.55)).alias("tier"), rules.grace_samples((F.col("k") % 10).cast("double"), F.lit(0.5)).alias("grace"))


@plan("fn_23_reason_head", f"WITH {EVENTS} SELECT event_id, CASE WHEN k % 2 = 0 THEN 'anomaly_band' ELSE 'too_dark' END AS reason FROM e")
def _(spark, sf_dir):
    reason = F.when(F.col("k") % 2 == 0, F.concat(F.lit("anomaly_band_y"), "k", F.lit("_h4"))).otherwise("too_dark(1.2)")
    return events(spark, sf_dir).select("event_id", rules.reason_head(reason).alias("reason"))


@plan("fn_25_track_colour", f"WITH {EVENTS}, x AS (SELECT event_id, list_sum(list_transform(string_split(CAST(event_id AS VARCHAR), ''), lambda c: ascii(c))) % 15 AS i FROM e) SELECT event_id, ['{chr(39) + (chr(39) + ', ' + chr(39)).join(rules.PALETTE) + chr(39)}'][CAST(i AS INT) + 1] AS colour FROM x".replace("[''", "['").replace("'']", "']"))
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rules.colour_of(F.col("event_id").cast("string")).alias("colour"))


@plan("fn_26_achievement_tier", f"WITH {EVENTS}, c AS (SELECT bird_species, count(*) AS n FROM e WHERE bird_species IS NOT NULL GROUP BY 1) SELECT bird_species, CASE WHEN n >= 20 THEN 'gold' WHEN n >= 5 THEN 'silver' ELSE 'bronze' END AS tier FROM c")
def _(spark, sf_dir):
    counts = events(spark, sf_dir).where("bird_species is not null").groupBy("bird_species").agg(F.count("*").alias("n"))
    return counts.select("bird_species", rules.achievement_tier(F.col("n")).alias("tier"))


@plan("fn_27_relative_age", f"WITH {EVENTS}, x AS (SELECT event_id, (event_id * 37) % 400000 AS s FROM e) SELECT event_id, CASE WHEN s // 60 < 60 THEN (s // 60) || ' min' WHEN s // 60 < 1440 THEN (s // 3600) || ' h' ELSE (s // 86400) || ' d' END AS age FROM x")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rules.relative_age(F.col("event_id") * 37 % 400000).alias("age"))


@plan("fn_30_csv_list", f"WITH {EVENTS} SELECT event_id, camera_id || '|' || label AS parts FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.array_join(rules.csv_list(F.concat(F.lit(" ,"), "camera_id", F.lit(" ,, "), "label", F.lit(","))), "|").alias("parts"))


@plan("fn_31_clamps", f"WITH {EVENTS} SELECT event_id, CAST(least(greatest(k - 20, 1), 60) AS INT) AS hours FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rules.clamp(F.col("k") - 20, 1, 60).cast("int").alias("hours"))


@plan("fn_33_summary_line", f"WITH {EVENTS} SELECT event_id, CASE WHEN bird_species IS NOT NULL THEN bird_species || ' · ' || camera_id || ' · ' || label WHEN cat_name IS NOT NULL THEN cat_name || ' · ' || camera_id || ' · ' || label ELSE camera_id || ' · ' || label || ' · ' || type END AS line FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", rules.summary_line(F.col("bird_species"), F.col("cat_name"), F.col("camera_id"), F.col("label"), F.col("type")).alias("line"))


@plan("fn_34_caption", "SELECT doc_id, CASE WHEN length(text) > 1024 THEN substr(text, 1, 1023) || '…' ELSE text END AS caption FROM documents")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", rules.caption(F.col("text")).alias("caption"))


_PAIR = """p AS (SELECT event_id, x1, y1, x2, y2, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM e WINDOW w AS (PARTITION BY camera_id ORDER BY x1, y1, event_id)),
    q AS (SELECT *, greatest(least(x2, px2) - greatest(x1, px1), 0) * greatest(least(y2, py2) - greatest(y1, py1), 0) AS inter FROM p WHERE px1 IS NOT NULL)"""


def _pairs(spark, sf_dir):
    """Each box with its left neighbour on the camera."""
    from pyspark.sql import Window

    w = Window.partitionBy("camera_id").orderBy("x1", "y1", "event_id")
    rows = events(spark, sf_dir).select("event_id", "camera_id", "x1", "y1", F.struct("x1", "y1", "x2", "y2").alias("box"))
    return rows.withColumn("prev", F.lag("box").over(w)).where("prev is not null")


@plan("geo_01_iou", f"WITH {EVENTS}, {_PAIR} SELECT event_id, round(CAST(inter AS DOUBLE) / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - inter), 6) AS iou FROM q")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("event_id", F.round(geo.iou(F.col("box"), F.col("prev")), 6).alias("iou"))


@plan("geo_02_distance", f"WITH {EVENTS}, {_PAIR} SELECT event_id, round(sqrt(((x1 + x2 - px1 - px2) / 2.0) ** 2 + ((y1 + y2 - py1 - py2) / 2.0) ** 2), 4) AS distance FROM q")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir).select("event_id", F.round(geo.centroid_distance(F.col("box"), F.col("prev")), 4).alias("distance"))


@plan("geo_03_area_share", f"WITH {EVENTS} SELECT event_id, round(((x2 - x1) * (y2 - y1)) / (max(x2) OVER (PARTITION BY camera_id) * CAST(max(y2) OVER (PARTITION BY camera_id) AS DOUBLE)), 5) AS share FROM e")
def _(spark, sf_dir):
    rows = events(spark, sf_dir)
    frame = rows.groupBy("camera_id").agg(F.max("x2").alias("w"), F.max("y2").alias("h"))
    return rows.join(frame, "camera_id").select("event_id", geo.area_share(F.struct("x1", "y1", "x2", "y2"), F.col("w"), F.col("h")).alias("share"))


_KEPT = """len(list_filter(w.kept, lambda q: q.label = r.label AND greatest(least(q.x2, r.x2) - greatest(q.x1, r.x1), 0) * greatest(least(q.y2, r.y2) - greatest(q.y1, r.y1), 0)
    > 0.5 * ((q.x2 - q.x1) * (q.y2 - q.y1) + (r.x2 - r.x1) * (r.y2 - r.y1) - greatest(least(q.x2, r.x2) - greatest(q.x1, r.x1), 0) * greatest(least(q.y2, r.y2) - greatest(q.y1, r.y1), 0)))) = 0"""
_BOX = "{'label': %s.label, 'x1': %s.x1, 'y1': %s.y1, 'x2': %s.x2, 'y2': %s.y2}"


@plan(
    "geo_04_nms",
    walk(
        "SELECT camera_id || '/' || strftime(date_trunc('minute', ts), '%Y%m%d%H%M') AS frame, event_id, score, label, x1, y1, x2, y2 FROM e",
        f"[{_BOX % (('r',) * 5)}] AS kept, true AS ok",
        f"CASE WHEN {_KEPT} THEN list_append(w.kept, {_BOX % (('r',) * 5)}) ELSE w.kept END AS kept, {_KEPT} AS ok",
        "frame, event_id, score, label, x1, y1, x2, y2",
        "ok",
        "score DESC, event_id DESC",
        "frame",
    ),
)
def _(spark, sf_dir):
    """Boxes that survive suppression within each frame: a camera's minute, whose detections are few."""
    rows = events(spark, sf_dir).withColumn("frame", F.concat_ws("/", "camera_id", F.date_format("ts", "yyyyMMddHHmm")))
    boxes = F.reverse(F.array_sort(F.collect_list(F.struct("score", "event_id", "label", "x1", "y1", "x2", "y2"))))
    kept = rows.groupBy("frame").agg(geo.nms(boxes, 0.5).alias("kept"))
    return kept.select("frame", F.inline("kept"))


@plan("geo_06_drop_overlapped", f"WITH {EVENTS}, x AS (SELECT event_id, greatest(least(x2, 700) - greatest(x1, 200), 0) * greatest(least(y2, 500) - greatest(y1, 100), 0) AS i, (x2 - x1) * (y2 - y1) AS a FROM e) SELECT event_id FROM x WHERE CAST(i AS DOUBLE) / (a + 200000 - i) < 0.05")
def _(spark, sf_dir):
    ref = F.struct(F.lit(200).alias("x1"), F.lit(100).alias("y1"), F.lit(700).alias("x2"), F.lit(500).alias("y2"))
    one = F.array(F.struct("x1", "y1", "x2", "y2"))
    return events(spark, sf_dir).where(F.size(geo.drop_overlapped(one, ref, 0.05)) > 0).select("event_id")


@plan("geo_07_tiles", "SELECT * FROM (VALUES (0, 0, 736, 414), (544, 0, 1280, 414), (0, 306, 736, 720), (544, 306, 1280, 720)) t(x1, y1, x2, y2)")
def _(spark, sf_dir):
    return spark.createDataFrame(geo.tiles(1280, 720, 2, 2), "x1 int, y1 int, x2 int, y2 int")


def _diamond():
    """A zone: |x - 600| + |y - 400| <= 300."""
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((600, 100), (900, 400), (600, 700), (300, 400))])


@plan("geo_08_in_polygon", f"WITH {EVENTS} SELECT event_id, abs(x1 - 600) + abs(y1 - 400) <= 300 AS inside FROM e")
def _(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", geo.in_polygon(F.col("x1"), F.col("y1"), _diamond()).alias("inside"))


@plan("jn_09_masked", f"WITH {EVENTS} SELECT event_id FROM e WHERE NOT (label IN ('cat', 'bird') AND abs((x1 + x2) // 2 - 600) + abs(y2 - 400) <= 300)")
def _(spark, sf_dir):
    ground = geo.in_polygon(F.floor((F.col("x1") + F.col("x2")) / 2), F.col("y2"), _diamond())
    return events(spark, sf_dir).where(~(F.col("label").isin("cat", "bird") & ground)).select("event_id")


def _bits(spark, sf_dir):
    """Signs of the 64 dimensions as a 64-bit hash."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return rows.select("vec_id", "label", bits.alias("hash"), F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "").alias("text"))


@plan(
    "jn_13_nearest_identity",
    """WITH h AS (SELECT vec_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS t FROM embeddings),
    r AS (SELECT label AS profile, arg_min(t, vec_id) AS t FROM h GROUP BY 1),
    d AS (SELECT h.vec_id, profile, hamming(h.t, r.t) AS distance FROM h, r),
    b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, profile) AS rn FROM d)
    SELECT vec_id, profile, CAST(distance AS INT) AS distance FROM b WHERE rn = 1 AND distance <= 24""",
)
def _(spark, sf_dir):
    rows = _bits(spark, sf_dir)
    registry = rows.groupBy(F.col("label").alias("profile")).agg(F.min_by("hash", "vec_id").alias("of"))
    # The registry holds named individuals, one each; it goes into one array, so each row meets it without a shuffle.
    known = registry.agg(F.array_sort(F.collect_list(F.struct("profile", "of"))).alias("known"))
    best = F.array_min(F.transform("known", lambda r: F.struct(geo.hamming(F.col("hash"), r["of"]).alias("distance"), r["profile"].alias("profile"))))
    out = rows.crossJoin(F.broadcast(known)).select("vec_id", best.alias("b"))  # one row
    return out.where("b.distance <= 24").select("vec_id", "b.profile", "b.distance")


@plan(
    "jn_13_registry_index",
    """WITH h AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS t FROM embeddings),
    r AS (SELECT vec_id AS profile, translate(substr(t, 1, CAST(vec_id % 15 AS INT)), '01', '10') || substr(t, CAST(vec_id % 15 AS INT) + 1) AS t FROM h WHERE vec_id % 3 = 0),
    d AS (SELECT h.vec_id, profile, hamming(h.t, r.t) AS distance FROM h, r WHERE hamming(h.t, r.t) <= 10)
    SELECT vec_id, profile, CAST(distance AS INT) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, profile) = 1""",
)
def _(spark, sf_dir):
    """A registry that grows with the table: the hashes of a third of the rows, with up to fourteen of their first bits changed."""
    rows = _bits(spark, sf_dir).select("vec_id", "hash")
    changed = F.array(*[F.lit((1 << 64) - (1 << (64 - n)) - (1 << 64) if n else 0).cast("long") for n in range(15)])
    registry = rows.where("vec_id % 3 = 0").select(F.col("vec_id").alias("profile"), F.col("hash").bitwiseXOR(F.get(changed, F.col("vec_id") % 15)).alias("of"))
    return neighbours.nearest_hash(rows, registry, 10).select("vec_id", "profile", "distance")


@plan("geo_15_hamming", "WITH h AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS t FROM embeddings) SELECT a.vec_id, CAST(hamming(a.t, b.t) AS INT) AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1")
def _(spark, sf_dir):
    rows = _bits(spark, sf_dir)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", geo.hamming(F.col("hash"), F.col("other")).alias("distance"))
