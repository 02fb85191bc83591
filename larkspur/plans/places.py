"""Zones and masks as tables: a diamond for every part of the driver's tables, hundreds to a camera."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import zones
from larkspur.plans import plan
from larkspur.plans.sql import EVENTS
from larkspur.sources.events import events_view as events

#: |x - cx| + |y - cy| <= r around a part's place. Camera 3 has no zones, camera 4 none for all labels.
ZONES_SQL = f"""{EVENTS}, d AS (SELECT *, greatest(0, least(1279, (x1 + x2) // 2)) AS gx, greatest(0, least(719, (y1 + y2) // 2)) AS gy FROM e),
    z AS (SELECT p_partkey AS zone_id, 'cam_' || (p_partkey % 5) AS camera_id, p_partkey * 37 % 1280 AS cx, p_partkey * 53 % 720 AS cy, 10 + p_partkey % 40 AS r,
                 CASE p_partkey % 3 WHEN 1 THEN ['cat'] WHEN 2 THEN ['bird', 'person'] ELSE CASE WHEN p_partkey % 5 = 4 THEN ['cat'] ELSE [] END END AS labels,
                 CASE WHEN p_partkey % 7 = 0 THEN true ELSE p_partkey % 2 = 0 END AS save_photo, p_partkey % 4 <> 0 AS send_message FROM part WHERE p_partkey % 5 <> 3),
    m AS (SELECT event_id, z.*, len(z.labels) > 0 AS named FROM d JOIN (SELECT camera_id AS zc, * EXCLUDE (camera_id) FROM z) z ON zc = d.camera_id AND abs(gx - cx) + abs(gy - cy) <= r AND (len(z.labels) = 0 OR list_contains(z.labels, d.label)))"""


def polygons(spark, sf_dir):
    k = F.col("p_partkey")
    cx, cy, r = k * 37 % 1280, k * 53 % 720, 10 + k % 40
    corners = F.array(*[F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")) for x, y in ((cx, cy - r), (cx + r, cy), (cx, cy + r), (cx - r, cy))])
    labels = F.when(k % 3 == 1, F.array(F.lit("cat"))).when(k % 3 == 2, F.array(F.lit("bird"), F.lit("person"))).when(k % 5 == 4, F.array(F.lit("cat")))
    photo, none = F.when(k % 7 != 0, k % 2 == 0), F.lit(None)
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 5 <> 3")
    return parts.select(
        k.alias("zone_id"), F.concat(F.lit("cam_"), k % 5).alias("camera_id"), labels.alias("labels"), corners.alias("points"), none.cast("int").alias("source_w"), none.cast("int").alias("source_h"),
        photo.alias("save_photo"), none.cast("boolean").alias("save_video"), (k % 4 != 0).alias("send_message"),
    )


@plan(
    "geo_10_zone_table",
    f"""WITH {ZONES_SQL}, best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY named DESC, zone_id) = 1)
    SELECT d.event_id, coalesce(zone_id, -1) AS zone_id, coalesce(save_photo, false) AS save_photo, zone_id IS NOT NULL AS save_video, coalesce(send_message, false) AS send_message FROM d LEFT JOIN best USING (event_id)
    WHERE zone_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM z WHERE z.camera_id = d.camera_id AND (len(z.labels) = 0 OR list_contains(z.labels, d.label)))""",
)
def _(spark, sf_dir):
    """Detections that no zone applies to have zone -1 and no flags."""
    found = zones.zoned(events(spark, sf_dir), polygons(spark, sf_dir))
    return found.select("event_id", F.coalesce("zone_id", F.lit(-1)).alias("zone_id"), *[F.coalesce(f, F.lit(False)).alias(f) for f in zones.FLAGS])


@plan("geo_11_mask_table", f"WITH {ZONES_SQL} SELECT event_id FROM d WHERE event_id NOT IN (SELECT event_id FROM m)")
def _(spark, sf_dir):
    return zones.unmasked(events(spark, sf_dir), polygons(spark, sf_dir)).select("event_id")
