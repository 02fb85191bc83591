"""Every registered query against its SQL on the smallest tables."""

import collections
import os

import duckdb
import pandas as pd
import pytest

from larkspur import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


def bag(frame):
    columns = sorted(frame.columns)
    return columns, collections.Counter(repr(tuple(map(cell, r))) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, db, name):
    got, want = bag(plans.queries()[name](spark, SF).toPandas()), bag(db.execute(plans.oracle_sql()[name]).fetchdf())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]))[:3], list((want[1] - got[1]))[:3])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark):
    q = plans.queries()
    ids = lambda name: {r.event_id for r in q[name](spark, SF).collect()}
    assert ids("str_03_live_cooldown") == ids("str_03_cooldown")
    assert ids("str_01_live_confirm") == ids("win_03_confirm_live")
    assert ids("str_07_live_capped_triggers") == ids("str_07_capped_triggers")


def test_tracks_equal_a_walk(spark):
    """Every clip tracked by itself, and the finished clips of the same walk."""
    from larkspur.operators import tracking
    from larkspur.plans.tracking import detections

    rows = sorted((r.clip, r.f, r.label, -r.score, r.x1, r.y1, r.x2, r.y2, r.t) for r in detections(spark, SF).collect())
    for whole in (False, True):
        want = collections.Counter()
        for clip in dict.fromkeys(r[0] for r in rows):
            mine = [(f, t, label, -less, *box) for c, f, label, less, *box, t in rows if c == clip]
            want.update((clip, *x) for x in tracking.track_clip(mine, whole))
        assert collections.Counter(map(tuple, tracking.track(detections(spark, SF), whole).collect())) == want


def test_live_tracks_equal_a_walk(spark):
    from larkspur.operators import tracking

    events = pd.read_parquet(f"{SF}/events.parquet")
    events["us"] = events["ts"].astype("datetime64[us]").astype("int64")
    names = {"view": "motion", "click": "bird", "purchase": "squirrel", "signup": "cat", "error": "person"}
    want = collections.Counter()
    for cam in range(5):
        tracker, mine = tracking.Tracker(), events[events["user_id"] % 5 == cam]
        for us, frame in mine.groupby("us"):
            dets = sorted((names[r.event_type], r.event_id % 100 / 100.0, float(r.event_id * 37 % 300), float(r.event_id * 53 % 200)) for r in frame.itertuples())
            tracker.frames += 1
            tracking.associate(tracker, [(label, score, (x, y, x + 80, y + 80)) for label, score, x, y in dets], tracker.frames, us / 1e6)
            want.update((f"cam_{cam}", x.number, us, *s[2], s[5]) for x in tracker.tracks() for s in x.samples[-1:] if s[0] == tracker.frames)
    got = plans.queries()["str_02_live_tracks"](spark, SF).collect()
    assert collections.Counter((r.camera_id, r.track_id, r.us, r.x1, r.y1, r.x2, r.y2, r.source) for r in got) == want


def test_live_blobs_equal_the_batch(spark):
    """Both have SQL twins of their own; a stream in one batch and a sorted table must agree too."""
    from pyspark.sql import functions as F

    from larkspur.operators import folds
    from larkspur.plans.streams import _blobs
    from larkspur.sources.events import events_view

    rows = events_view(spark, SF).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    tracked = folds.blob_tracks(_blobs(rows), ["camera_id"], "us", "boxes")
    want = collections.Counter((r.camera_id, r.event_id, i, n) for r in tracked.collect() for i, n in enumerate(r.tracks))
    got = plans.queries()["str_13_live_blob_tracks"](spark, SF).collect()
    assert want == collections.Counter((r.camera_id, r.event_id, r.place, r.track) for r in got)


def test_testdata_there():
    assert os.path.isdir(SF)
