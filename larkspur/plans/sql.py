"""SQL twins of the views that the queries run on."""

#: CTEs: e has the events in the store's shape (see ``sources.events.events_view``), el one row per event and label.
EVENTS = """e0 AS (
  SELECT event_id, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, 'cam_' || (user_id % 5) AS camera_id,
         CASE event_type WHEN 'view' THEN 'motion' WHEN 'click' THEN 'bird' WHEN 'purchase' THEN 'squirrel' WHEN 'signup' THEN 'cat' WHEN 'error' THEN 'person' END AS label
  FROM events),
e AS (
  SELECT *, CASE WHEN event_id % 997 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS time,
         CASE WHEN k = 99 THEN []::VARCHAR[] WHEN k % 4 = 0 AND label <> 'motion' THEN list_sort([label, 'motion']) ELSE [label] END AS labels,
         label AS top_label, k / 100.0 AS score, CASE WHEN event_id % 50 = 0 THEN 'timelapse' ELSE 'motion' END AS type,
         CASE WHEN label = 'bird' THEN 'species_' || (k % 12) END AS bird_species, CASE WHEN label = 'cat' THEN 'cat_' || (k % 7) END AS cat_name,
         CASE WHEN event_id % 7 <> 0 THEN 'snap/' || event_id || '.jpg' END AS snapshot_relpath, CASE WHEN event_id % 5 <> 0 THEN 'clip/' || event_id || '.mp4' END AS video_relpath,
         CAST(event_id * 37 % 1200 AS INT) AS x1, CAST(event_id * 53 % 600 AS INT) AS y1,
         CAST(event_id * 37 % 1200 AS INT) + 40 + k AS x2, CAST(event_id * 53 % 600 AS INT) + 40 + CAST(user_id % 60 AS INT) AS y2
  FROM e0),
el AS (SELECT * EXCLUDE (labels), unnest(CASE WHEN len(labels) > 0 THEN labels ELSE ['motion'] END) AS lab FROM e)"""

WEATHER = """w AS (
  SELECT date_trunc('hour', ts) AS ts, max(CASE WHEN event_type = 'view' THEN value END) AS gust, max(CASE WHEN event_type = 'click' THEN value END) AS rain
  FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)"""

#: The first object label in the list's order, else motion.
FIRST_OBJECT = "CASE WHEN len(labels) = 0 THEN 'motion' ELSE coalesce(list_filter(labels, lambda x: x IN ('person','cat','bird','car','dog','squirrel'))[1], CASE WHEN list_contains(labels, 'motion') THEN 'motion' END) END"
#: The first object label by priority, else motion, else the first.
MOST_SPECIFIC = "CASE WHEN len(labels) = 0 THEN 'motion' ELSE coalesce(list_filter(['person','car','dog','cat','squirrel','fox','hedgehog','bird','motion'], lambda x: list_contains(labels, x))[1], labels[1]) END"


def walk(rows: str, first: str, after: str, out: str, where: str = "true", order: str = "us, event_id", key: str = "camera_id") -> str:
    """A fold in SQL: a recursion from a key's first row to its last. ``after`` sees the last row and state as w, the row as r."""
    return f"""WITH RECURSIVE {EVENTS}, r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({rows})),
    w AS (SELECT r.*, {first} FROM r WHERE rn = 1 UNION ALL SELECT r.*, {after} FROM w JOIN r ON r.{key} = w.{key} AND r.rn = w.rn + 1)
    SELECT {out} FROM w WHERE {where}"""
