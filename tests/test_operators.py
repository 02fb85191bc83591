"""Invariants and edge cases that the tables don't hold."""

import random
from datetime import datetime, timedelta

import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.functions import geo, rules
from larkspur.operators import folds, goals, manage, store, temporal, tracking
from larkspur.sources import events as source


def one(spark, **columns):
    return {k: v for k, v in spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first().asDict().items()}


def test_text_rules(spark):
    got = one(
        spark,
        a=rules.slug(F.lit("Größe Ñandú 7!")), b=rules.slug(F.lit(None).cast("string")), c=rules.last_ip_segment(F.lit("::ffff:192.0.2.1")), d=rules.last_ip_segment(F.lit("2001:db8::42%eth0")), e=rules.last_ip_segment(F.lit("")),
        f=rules.camera_key(F.lit("Reolink"), F.lit("RLC-811A"), F.lit("Squirrel Town 'Nut Bar'"), F.lit("192.168.178.183")), g=rules.parse_hours(F.lit(" 90M ")), h=rules.parse_hours(F.lit("x")), i=rules.minutes_of(F.lit("25:00")),
        j=rules.url_host(F.lit("rtsp://user:pw@10.0.0.7:554/a")), k=rules.rain_band(F.lit(None).cast("double")), m=rules.binomial(F.lit("PARUS Major major")),
    )
    assert got == {"a": "groessenandu7", "b": "", "c": "1", "d": "42", "e": "", "f": "reolink_rlc811a_squirreltownnutbar_183", "g": 1.5, "h": None, "i": 0, "j": "10.0.0.7", "k": "Trocken", "m": "Parus major"}


def test_windows_at_their_ends(spark):
    got = one(spark, always=rules.in_window(F.lit(5), F.lit(60), F.lit(60), True), never=rules.in_window(F.lit(5), F.lit(60), F.lit(60), False), night=rules.in_window(F.lit(0), F.lit(1260), F.lit(360), True), end=rules.in_window(F.lit(360), F.lit(1260), F.lit(360), True))
    assert got == {"always": True, "never": False, "night": True, "end": False}


def test_gap_equal_to_the_session_gap_merges(spark):
    rows = spark.sql("select 'a' camera_id, 'x' label, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, m, s) ts from values (0, 0.0), (2, 0.0), (4, 0.001) t(m, s)")
    assert sorted(r.n for r in temporal.session_lanes(rows).collect()) == [1, 2]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=30))
def test_confirmation_equals_a_walk(spark, gaps):
    at, times = 0, []
    for g in gaps:
        at += g + 1
        times.append(at)
    hits, done, want = [], False, []
    for t in times:
        if hits and done and t - hits[-1] > 10:
            hits, done = [], False
        hits = [h for h in [*hits, t] if t - h <= 5]
        if len(hits) >= 3 and not done:
            done = True
            want.append(t)
    rows = spark.createDataFrame([(1, t * 1_000_000) for t in times], "k int, us long")
    assert sorted(r.us // 1_000_000 for r in temporal.confirm_live(rows, ["k"], "us", 3, 5).collect()) == want


def test_cooldown_anchor_moves_only_on_acceptance(spark):
    rows = spark.createDataFrame([(1, t * 1_000_000) for t in (0, 6, 11, 13, 21)], "k int, us long")
    assert sorted(r.us // 1_000_000 for r in folds.cooldown(rows, ["k"], "us", 10).collect()) == [0, 11, 21]
    days = rows.withColumn("day", F.lit("d"))
    assert folds.capped_cooldown(days, ["k"], "us", "day", 1, 2).count() == 2
    assert [r.recording for r in folds.recordings(rows, ["k"], "us", 5, 10).orderBy("us").collect()] == [1, 2, 2, 2, 3]


def test_blobs_keep_their_tracks(spark):
    """One blob crosses, one shimmers in place; after five frames without it a third one is new."""
    crossing, still = lambda i: [60.0 * i, 10.0, 50.0, 40.0], [900.0, 600.0, 30.0, 30.0]
    rows = [(1, i, crossing(i) + still) for i in range(4)] + [(1, i, []) for i in range(4, 9)] + [(1, 9, still), (2, 0, None), (2, 1, still)]
    frames = spark.createDataFrame(rows, "k int, us long, boxes array<double>")
    tracked = folds.blob_tracks(frames, ["k"], "us", "boxes")
    got = {(r.k, r.us): r.tracks for r in tracked.collect()}
    assert [got[1, i] for i in range(10)] == [[0, 1]] * 4 + [[]] * 5 + [[2]] and got[2, 0] == [] and got[2, 1] == [0]
    found = {(r.k, r.track): (r.age, r.net, r.coherent) for r in folds.coherent_tracks(tracked, ["k"], "us", "boxes", 1280).collect()}
    assert found == {(1, 0): (4, 180.0, True), (1, 1): (4, 0.0, False), (1, 2): (1, 0.0, False), (2, 0): (1, 0.0, False)}


def test_latch_with_a_high_off(spark):
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate((1.0, 5.0, None, 6.0, 2.0, 5.0))], "k int, i int, v double")
    assert [r.i for r in folds.latch(rows, ["k"], "i", "v", 5.0, 3.0).orderBy("i").collect()] == [1, 5]


def test_polygon_has_its_boundary(spark):
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))])
    got = one(spark, inside=geo.in_polygon(F.lit(5), F.lit(5), square), edge=geo.in_polygon(F.lit(10), F.lit(3), square), corner=geo.in_polygon(F.lit(0), F.lit(0), square), out=geo.in_polygon(F.lit(11), F.lit(5), square))
    assert got == {"inside": True, "edge": True, "corner": True, "out": False}


def test_suppression_is_greedy(spark):
    boxes = [("a", 0.9, 0, 0, 10, 10), ("a", 0.8, 0, 3, 10, 13), ("a", 0.7, 0, 6, 10, 16), ("b", 0.6, 0, 0, 10, 10)]
    rows = spark.createDataFrame([(boxes,)], "boxes array<struct<label:string,score:double,x1:int,y1:int,x2:int,y2:int>>")
    assert [b.score for b in rows.select(geo.nms(F.col("boxes"), 0.5).alias("k")).first().k] == [0.9, 0.7, 0.6]


def box(x, y=0, size=100):
    return (float(x), float(y), float(x + size), float(y + size))


def run(frames):
    state = tracking.Tracker()
    for f, dets in enumerate(frames):
        tracking.associate(state, dets, f, float(f))
    return state.tracks()


def test_tracks_follow_and_split():
    assert len(run([[("cat", 0.9, box(10 * i))] for i in range(8)])) == 1
    assert len(run([[("cat", 0.9, box(0)), ("cat", 0.9, box(500))] for _ in range(4)])) == 2
    assert len(run([[("cat", 0.3, box(0))] for _ in range(4)])) == 0  # faint ones never begin a track
    assert len(run([[("cat", 0.9, box(0))], [("cat", 0.3, box(5))], [("cat", 0.9, box(10))]])) == 1  # but go on with one


def test_a_label_that_changes_stays_one_track():
    tracks = run([[("cat", 0.9, box(0))]] * 2 + [[("dog", 0.9, box(0))]] * 4)
    assert len(tracks) == 1 and tracks[0].label == "dog"


def test_tracks_close_and_come_back():
    frames = [[("cat", 0.9, box(0))]] * 3 + [[]] * 10 + [[("cat", 0.9, box(20))]] * 2
    assert len(run(frames)) == 1
    far = [[("cat", 0.9, box(0))]] * 3 + [[]] * 10 + [[("cat", 0.9, box(900))]] * 2
    assert len(run(far)) == 2


def test_ghosts_go_and_times_interpolate(spark):
    rows = [("c", 0, f, float(f), 10.0 * f, 0.0, 10.0 * f + 50, 50.0, 0.9, "cat", "detect") for f in range(3)] + [("c", 1, 0, 0.0, 0.0, 0.0, 9.0, 9.0, 0.2, "cat", "detect")]
    samples = spark.createDataFrame(rows, tracking.SCHEMA)
    assert {r.track_id for r in tracking.keep_real(samples).collect()} == {0}
    assert tracking.at_time(samples, 0.5).collect()[0].x1 == 5.0
    assert tracking.at_time(samples, 2.2).count() == 0


def test_files_round_trip(spark, tmp_path):
    day = tmp_path / "motion_detection" / "cam" / "2024-01-02"
    day.mkdir(parents=True)
    ident = "20240102-030405-000006"
    (day / f"{ident}.json").write_text(json.dumps({"event_id": ident, "time": "2024-01-02T03:04:05", "labels": ["cat"]}))
    (day / f"{ident}.tracks.json").write_text(json.dumps({"schema": 4, "tracks": []}))
    (day / "bad.json").write_text("{nope")
    rows = source.read_events(spark, str(tmp_path))
    got = rows.collect()
    assert [(r.event_id, r.camera_id, r.event_date) for r in got] == [(ident, "cam", "2024-01-02")]
    assert source.event_by_id(rows, ident).count() == 1 and source.event_by_id(rows, "20240103-x").count() == 0
    assert [(r.event_id, r.schema) for r in source.read_tracks(spark, str(tmp_path)).collect()] == [(ident, 4)]
    manage.write_events(rows.drop("event_date", "_path"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).where("camera_id = 'cam' and event_date = date'2024-01-02'").count() == 1
    (tmp_path / "labels.txt").write_text("0 person\n5: cat\nbird\n\n")
    assert sorted((r.idx, r.label) for r in source.read_label_map(spark, str(tmp_path / "labels.txt")).collect()) == [(0, "person"), (2, "bird"), (5, "cat")]
    (tmp_path / "h.json").write_text(json.dumps({"samples": [{"ts": "2024-01-01T00:00:00", "values": {"snowfall": 1.5, "x": 2}}, {"ts": None}, {"ts": "2024-01-01T00:05:00", "values": {}}]}))
    history = source.read_weather_history(spark, str(tmp_path / "h.json")).collect()
    assert len(history) == 2 and sorted(str(r.snowfall) for r in history) == ["1.5", "None"]


def test_filters_with_missing_values(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "", []), (3, "2024-01-05T10:00:00", ["cat"])], "event_id int, time string, labels array<string>").withColumns({"cat_name": F.lit(None).cast("string"), "bird_species": F.lit(None).cast("string")})
    assert {r.event_id for r in rows.where(store.time_range("2024-01-06")).collect()} == {1, 2}
    assert {r.event_id for r in rows.where(store.any_label(["cat"])).collect()} == {3}
    assert {(r.day, r.label) for r in store.by_day(rows).collect()} == {("unbekannt", "motion"), ("2024-01-05", "cat")}


def test_forgetting_changes_nothing_ahead():
    """The live tracker's shortened state goes on as the whole one."""
    frames = [[("cat", 0.9, box(12 * i))] if i % 5 else [] for i in range(40)] + [[]] * 12 + [[("cat", 0.9, box(470)), ("dog", 0.8, box(900))]] * 4
    whole, short, a, b = tracking.Tracker(), tracking.Tracker(), [], []
    for f, dets in enumerate(frames):
        for state, out in ((whole, a), (short, b)):
            tracking.associate(state, dets, f, float(f))
            out.append([(x.number, x.samples[-1]) for x in state.tracks() if x.samples[-1][0] == f])
        tracking.forget(short)
    assert a == b and all(len(x.samples) == 1 for x in short.tracks())


def test_missed_frames_fade_once_and_end_in_time():
    found = run([[("cat", 0.9, box(0))], [], []])[0]
    assert [(s[3], s[5]) for s in found.samples] == [(0.9, "detect"), (0.63, "predicted"), (0.63, "predicted")]
    tracks = run([[("cat", 0.9, box(0))]] + [[]] * 12)
    assert len(tracks[0].samples) == 1 + tracking.GRACE
    state = tracking.Tracker()
    for f in range(6):  # at the frame's edge a subject has left soon
        tracking.associate(state, [("cat", 0.9, box(895))] if f == 0 else [], f, float(f), frame=(1000, 1000))
    assert not state.active and len(state.closed[0].samples) == 1 + tracking.EDGE_GRACE


def test_predictions():
    two = run([[("cat", 0.9, box(0))], [("cat", 0.9, box(20))], [], []])[0]
    assert [s[2][0] for s in two.samples] == [0.0, 20.0, 20 + int(20 * 5 / 6), 20 + int(20 * 2 * 4 / 6)]
    still = run([[("cat", 0.9, box(0))], [("cat", 0.9, box(3))], []])[0]
    assert still.samples[-1][2] == box(3)  # hardly moves for its size
    fast = tracking.Track(0, "cat")
    for f, x in ((0, 0), (1, 90)):
        fast.add(f, float(f), ("cat", 0.9, box(x)))
    assert fast.predicted(2)[0] == 90 + 40  # at most 0.4 of the side
    assert run([[("cat", 0.9, box(0))], []])[0].samples[-1][2] == box(0)


def test_numbers_are_never_given_out_again():
    """Two parallel tracks merge; a far subject after that has a number of its own, also if the state is shortened."""
    state = tracking.Tracker()
    a, b = tracking.Track(0, "cat"), tracking.Track(1, "cat")
    for f in range(3):
        a.add(f, float(f), ("cat", 0.9, box(0)))
        b.add(f, float(f), ("cat", 0.8, box(5)))
    state.active, state.following = [a, b], 2
    tracking.associate(state, [], 3, 3.0)
    assert [x.number for x in state.active] == [0] and [x.number for x in state.closed] == [1]
    tracking.forget(state)
    tracking.associate(state, [("cat", 0.9, box(2000))], 4, 4.0)
    assert [x.number for x in state.active] == [0, 2]
    better = tracking.Tracker([tracking.Track(0, "cat"), tracking.Track(1, "cat")], [], 2)
    for x, score in zip(better.active, (0.6, 0.9), strict=True):
        for f in range(3):
            x.add(f, float(f), ("cat", score, box(0)))
    tracking.associate(better, [], 3, 3.0)
    assert [x.number for x in better.active] == [1]  # as many detections, and surer ones


def test_a_blocked_detection_joins_even_a_track_that_has_one():
    tracks = run([[("cat", 0.9, box(0))], [("cat", 0.9, box(0)), ("dog", 0.8, box(10))]])
    assert len(tracks) == 1 and [s[4] for s in tracks[0].samples] == ["cat", "cat", "dog"]


def test_who_comes_back_has_the_same_shape():
    gone = [[("cat", 0.9, (0.0, 0.0, 100.0, 100.0))]] * 3 + [[]] * 9
    assert len(run([*gone, [("cat", 0.9, (300.0, 0.0, 400.0, 100.0))]])) == 2  # too far
    assert len(run([*gone, [("cat", 0.9, (90.0, 0.0, 190.0, 100.0))]])) == 1
    assert len(run([*gone, [("cat", 0.9, (90.0, 0.0, 150.0, 170.0))]])) == 1
    assert len(run([*gone, [("cat", 0.9, (90.0, 0.0, 145.0, 181.0))]])) == 2  # the same area, another shape
    assert len(run([*gone[:3], *[[]] * 25, [("cat", 0.9, box(0))]])) == 2  # too late


def test_finished_clips_are_stitched(spark):
    ends = [(f, float(f), "cat", 0.9, 10.0 * f, 0.0, 10.0 * f + 60, 60.0) for f in range(4)]
    goes_on = [(f, float(f), "cat", 0.9, 10.0 * f + 20, 0.0, 10.0 * f + 80, 60.0) for f in range(8, 11)]
    dog = [(f, float(f), "dog", 0.9, 10.0 * f + 100, 400.0, 10.0 * f + 160, 460.0) for f in range(8, 11)]
    rows = spark.createDataFrame([("c", *r) for r in sorted([*ends, *goes_on, *dog])], "clip string, f int, t double, label string, score double, x1 double, y1 double, x2 double, y2 double")
    apart = {r.track_id for r in tracking.track(rows).collect()}
    whole = tracking.track(rows, whole=True).where("source = 'detect'").collect()
    assert apart == {0, 1, 2} and {r.track_id: r.label for r in whole} == {0: "cat", 2: "dog"}
    tracks = [tracking.Track(n, "cat", first=f) for n, f in ((0, 0), (1, 8), (2, 12), (3, 9))]
    for x, frames in zip(tracks, (ends, goes_on, [(12, 12.0, "cat", 0.9, 110.0, 0.0, 170.0, 60.0)], goes_on[1:]), strict=True):
        for f, t, label, score, *b in frames:
            x.add(f, t, (label, score, tuple(b)))
    (only,) = tracking.stitched(tracks)  # a chain of three, and one that was in the same place as its middle
    assert only.number == 0 and [s[0] for s in only.seen] == [0, 1, 2, 3, 8, 9, 10, 12]
    found = tracking.stitch_candidates(tracking.track(rows)).collect()
    assert [(r.before, r.wait) for r in found] == [(0, 5.0)]


def test_overlapping_tracks_merge(spark):
    rows = [("c", n, f, float(f), 10.0 * f + n, 0.0, 10.0 * f + 100 + n, 100.0, 0.9 - n / 10, "cat", "detect") for n in (0, 1, 2) for f in range(4)] + [("c", 3, 0, 0.0, 500.0, 0.0, 600.0, 100.0, 0.9, "cat", "detect")]
    out = tracking.merge_overlapping(spark.createDataFrame(rows, tracking.SCHEMA)).collect()
    assert sorted((r.track_id, r.f) for r in out) == [(0, 0), (0, 1), (0, 2), (0, 3), (3, 0)]
    assert all(r.score == 0.9 for r in out)


def test_new_ids_never_meet(spark):
    rows = spark.sql("select cast(null as string) event_id, 'a' camera_id, timestamp_ntz'2024-01-02 03:04:05' ts, id n from range(3) union all select 'x', 'a', timestamp_ntz'2024-01-02 03:04:05', 9L")
    assert sorted(r.event_id for r in manage.with_ids(rows).collect()) == ["20240102-030405-000000", "20240102-030405-000000-1", "20240102-030405-000000-2", "x"]


def test_edits_and_upserts_keep_one_row(spark):
    table = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "event_id string, v int")
    changed = spark.createDataFrame([(None, 20), ("b", 30), ("c", 40)], "event_id string, v int")
    assert sorted((r.event_id or "", r.v) for r in manage.upsert(table, changed, "event_id").collect()) == [("", 20), ("a", 1), ("b", 30), ("c", 40)]
    events = spark.createDataFrame([("a", ["cat"], "cat")], "event_id string, labels array<string>, top_label string")
    edits = spark.createDataFrame([("a", ["dog"], 2), ("a", ["fox"], 1), ("a", ["dog"], 2)], "event_id string, labels array<string>, edited_at int")
    assert [(r.labels, r.top_label) for r in manage.edit_labels(events, edits).collect()] == [(["dog"], "dog")]


def test_merged_ids_take_the_first_free_number(spark):
    rows = [("e", "new", "N", "p"), ("e_m1", "new", "N", "p"), ("e", "old", "O", "p"), ("f", "old", "O", "gone"), ("g", "old", "O", None), ("g", "new", "N", "p")]
    events = spark.createDataFrame(rows, "event_id string, camera_id string, camera_name string, video_relpath string")
    got = manage.merge_camera(events, spark.createDataFrame([("p",)], "path string"), "old", "new", "Door").collect()
    assert sorted(r.event_id for r in got) == ["e", "e_m1", "e_m2", "f", "g", "g_m1"] and {r.camera_id for r in got} == {"new"} and {r.camera_name for r in got} == {"Door"}


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"server": {"b": 1, "a": "ü"}, "secrets": {}, "ui": []}')
    assert sorted(map(tuple, source.read_config(spark, str(tmp_path / "c.json")).collect())) == [("server", '{"a":"ü","b":1}'), ("ui", "[]")]
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError, match="one object"):
        source.read_config(spark, str(tmp_path / "l.json"))


def test_goals_are_told_once(spark):
    rows = spark.sql("select timestamp_ntz'2024-03-01 06:00:00' + make_dt_interval(cast(id as int)) ts, date_format(timestamp'2024-03-01 06:00:00' + make_dt_interval(cast(id as int)), \"yyyy-MM-dd'T'HH:mm:ss\") time, array('bird') labels, concat(' Parus ', id % 2) bird_species from range(10)")
    wanted = [goals.Goal("all", "year_to_date", 5, label="bird"), goals.Goal("kinds", "year_to_date", 9, "species", labels=("bird", "cat")), goals.Goal("december", "december", 1)]
    state = spark.createDataFrame([], goals.STATE)
    told = []
    for now in ("2024-03-03 12:00:00", "2024-03-09 12:00:00", "2024-03-09 12:00:00", "2024-03-20 12:00:00"):
        found = goals.evaluate(rows, wanted, state, now)
        told.append([r.goal_id for r in found.where("notify").collect()])
        state = spark.createDataFrame(found.drop("notify").collect(), goals.STATE)
    assert told == [[], ["all_2024"], [], []]
    got = {r.goal_id: r for r in state.collect()}
    assert got["all_2024"].progress == 5 and got["kinds_2024"].progress == 2 and got["december_2024"].progress == 0 and str(got["all_2024"].completed_at) == "2024-03-09 12:00:00"


def test_goals_follow_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-03-01 06:00:00' + make_dt_interval(cast(id as int)) ts, '2024-03-01T06:00:00' time, array('bird') labels, 'x' bird_species from range(8)")
    for half in range(2):
        rows.where(F.dayofmonth("ts") % 2 == half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    goals.follow(stream, [goals.Goal("all", "year_to_date", 6, label="bird")], str(tmp_path / "out"), "2024-03-20 12:00:00").trigger(availableNow=True).start().awaitTermination()
    states = [spark.read.parquet(str(tmp_path / f"out/state/batch={n}")).first() for n in range(2)]
    assert [(s.progress, s.notify) for s in states] == [(4, False), (6, True)]


def test_goals_of_a_stream_equal_those_of_all_events(spark, tmp_path):
    rng = random.Random(3)
    start = datetime(2023, 11, 20)
    rows = []
    for i in range(240):
        ts = start + timedelta(hours=rng.uniform(0, 24 * 170))
        rows.append((ts, ts.strftime("%Y-%m-%dT%H:%M:%S") if i % 9 else "", rng.choice([["bird"], ["cat", "motion"], []]), rng.choice([None, " ", "Parus", "parus ", "Strix"])))
    rows.sort(key=lambda r: r[0] + timedelta(days=rng.uniform(0, 20)))  # some come late
    schema = "ts timestamp_ntz, time string, labels array<string>, bird_species string"
    windows = ("december", "april_rolling_week", "year_to_date", "current_calendar_month", "current_rolling_week")
    wanted = [goals.Goal(f"{w}_{c}", w, 12, c, label="bird" if c == "days" else None) for w in windows for c in ("events", "species", "days")]
    clock = ["2023-12-10 03:00:00", "2024-01-03 12:00:00", "2024-02-01 00:00:00", "2024-04-03 06:30:00", "2024-04-20 06:30:00", "2024-05-09 00:00:00"]
    state = spark.createDataFrame([], goals.STATE)
    for n, now in enumerate(clock):
        spark.createDataFrame(rows[40 * n : 40 * n + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        goals.follow(stream, wanted, f"{tmp_path}/out", clock.__getitem__).trigger(availableNow=True).start().awaitTermination()
        found = goals.evaluate(spark.createDataFrame(rows[: 40 * n + 40], schema), wanted, state, now)
        want = sorted(map(tuple, found.collect()))
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/state/batch={n}").select(*found.columns).collect())) == want
        state = spark.createDataFrame([r[:-1] for r in want], goals.STATE)
    assert state.where("notified_at is not null").count() >= 3


def test_sunset_fires_once_a_day(spark):
    rows = [(1, m * 60_000_000, a, d) for m, a, d in ((0, 6.0, "a"), (1, 5.0, "a"), (9, 4.0, "a"), (13, 3.0, "a"), (30, 2.0, "a"), (60, 1.0, "b"), (61, 9.0, "b"), (62, 1.0, "b"), (74, None, "b"), (75, 0.0, "b"))]
    got = folds.sunset_once(spark.createDataFrame(rows, "k int, us long, alt double, day string"), ["k"], "us", "alt", "day")
    assert sorted(r.us // 60_000_000 for r in got.collect()) == [13, 75]


def test_sun_stands_where_it_does(spark):
    """Known positions: noon at the equinox on the equator, midnight sun, and a winter noon in Munich."""
    at = lambda text, lat, lon: one(spark, s=rules.sun_position(F.lit(pd.Timestamp(text).timestamp()), lat, lon))["s"]
    assert at("2024-03-20 12:07:30", 0.0, 0.0).altitude > 89.5
    assert 1 < at("2024-06-20 22:40:00", 71.2, 25.8).altitude < 6
    noon = at("2024-12-21 11:12:00", 48.1, 11.6)
    assert abs(noon.altitude - 18.5) < 0.3 and abs(noon.azimuth - 180) < 1
    assert 85 < at("2024-03-20 06:00:00", 48.1, 0.0).azimuth < 95


def test_purge(spark):
    names = ["a/1.json", "a/1.tracks.json", "a/2.json", "a/2.tracks.json", "a/3.json", "a/3.best.jpg", "a/3.5.tracks.json", "a/4.best.jpg", "a/3.5.json", "s/1.jpg", "b/1.tracks.json", "a/notes.txt"]
    listing = spark.createDataFrame([(n[0], n) for n in names], "camera_id string, path string")
    read = spark.createDataFrame([("a/1.json", "s/1.jpg", None), ("a/2.json", "s/1.jpg", "v/2.mp4"), ("a/3.5.json", None, None)], "path string, snapshot_relpath string, video_relpath string")
    got = {(r.path, r.why) for r in manage.purge(listing, read).collect()}
    # 2 lost its clip and takes its track along, 3 can't be read, 4 and camera b's track have no manifest.
    assert got == {("a/2.json", "media"), ("a/2.tracks.json", "sidecar"), ("a/3.json", "malformed"), ("a/3.best.jpg", "sidecar"), ("a/4.best.jpg", "sidecar"), ("b/1.tracks.json", "sidecar")}
    assert manage.purge(listing.limit(0), read.limit(0)).count() == 0


def test_chart_lines(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("s", i, v, 3.0 if i in (1, 4) else None, 1.0 if i == 2 else None) for i, v in enumerate([0.0, 5.0, nan, 10.0, None, 5.0, inf])]
    rows += [("t", i, float(i), None, None) for i in range(6)] + [("one", 0, 1.0, 1.0, 1.0)]
    got = temporal.chart_lines(spark.createDataFrame(rows, "cam string, at int, a double, b double, c double"), ["cam"], "at", ["a", "b", "c"]).collect()
    lines = {(r.cam, r.field, r.at): (r.run, round(r.x * 6, 6), r.y, r.smooth) for r in got if r.cam == "s"}
    assert lines == {
        ("s", "a", 0): (1, 0, 1.0, False), ("s", "a", 1): (1, 1, 0.5, False), ("s", "a", 3): (2, 3, 0.0, False), ("s", "a", 5): (3, 5, 0.5, False),
        ("s", "b", 1): (1, 1, 0.5, False), ("s", "b", 4): (2, 4, 0.5, False),
    }
    assert {(r.field, r.run, r.smooth) for r in got if r.cam == "t"} == {("a", 1, True)} and not [r for r in got if r.cam == "one"]


def test_static_tracks_go(spark):
    box = lambda track, f, x, score, source="detect", size=40.0: ("c", track, f, float(f), x, 0.0, x + size, size, score, "cat", source)
    rows = [box(1, f, 0.0 + f, 0.3) for f in range(4)] + [box(1, 9, 500.0, 0.9, "predicted")]  # hardly moves; predictions don't count
    rows += [box(2, f, 0.0 + f, 0.8) for f in range(4)]  # as still, but sure
    rows += [box(3, f, 15.0 * f, 0.3) for f in range(4)]  # walks
    rows += [box(4, f, x, 0.3) for f, x in enumerate((0.0, 30.0, 0.0))]  # a step in the middle
    rows += [box(5, f, 0.0, 0.3) for f in range(2)]  # too short to tell
    rows += [box(6, f, 0.0, s) for f, s in enumerate((0.3, 0.3, 0.5, 0.9))]  # the upper median is at the threshold
    rows += [box(7, f, 0.0, 0.3, size=0.0) for f in range(4)]  # no size
    table = spark.createDataFrame(rows, "clip string, track_id int, f int, t double, x1 double, y1 double, x2 double, y2 double, score double, label string, source string")
    assert {r.track_id for r in tracking.without_static(table, 0.5).collect()} == {2, 3, 4, 5, 6, 7}


def test_places(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"), (F.col("id") % 3).alias("tie")).repartition(7)
    got = store.placed(rows, [F.desc("tie"), F.asc("id")]).collect()
    assert [(r.tie, r.id) for r in sorted(got, key=lambda r: r.place)] == sorted(((r.tie, r.id) for r in got), key=lambda p: (-p[0], p[1]))
    assert sorted(r.place for r in got) == list(range(1, 5001))
    assert store.placed(rows.limit(0), [F.asc("id")]).count() == 0
