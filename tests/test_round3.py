"""Findings of the third review."""

import copy
import itertools
import random

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from larkspur import plans
from larkspur.operators import folds, store, temporal, tracking, zones
from larkspur.session import in_order, stream_session
from larkspur.streaming import events as live


def test_grade_at_four_fifths(spark):
    rows = spark.createDataFrame([(d, 4 * d / 5) for d in range(1, 200)], "declared int, unique double")
    assert {r.g for r in rows.select(store.grade(F.lit(0.05), F.col("unique"), F.col("declared")).alias("g")).collect()} == {"green"}
    assert {r.g for r in rows.select(store.grade(F.lit(0.05), F.col("unique") - 0.001, F.col("declared")).alias("g")).collect()} == {"yellow"}


def test_layers_of_zones_keep_the_rows_of_cells_short(spark):
    """Two thousand diamonds over each other: a cell keeps those up to the first that covers it, and results are those of all."""
    k = F.col("id")
    corner = lambda x, y: F.struct((k * 7 % 40 + x).cast("int").alias("x"), (k * 11 % 40 + y).cast("int").alias("y"))
    labels = F.when(k % 3 == 1, F.array(F.lit("cat"))).when(k % 3 == 2, F.array(F.lit("bird"), F.lit("cat")))
    none = F.lit(None)
    table = spark.range(2000).select(k.alias("zone_id"), F.lit("a").alias("camera_id"), labels.alias("labels"), F.array(corner(30, 0), corner(60, 30), corner(30, 60), corner(0, 30)).alias("points"), F.lit(100).alias("source_w"), F.lit(100).alias("source_h"), *[none.cast("boolean").alias(f) for f in zones.FLAGS])
    near = {(r.cx, r.cy): r.n for r in zones.cells(table, 100, 100).select("cx", "cy", F.size("near").alias("n")).collect()}
    assert near[6, 6] < 10 and len(near) > 100
    rows = spark.range(100 * 100).select(k.alias("event_id"), F.lit("a").alias("camera_id"), F.element_at(F.array(F.lit("cat"), F.lit("bird"), F.lit("dog")), (k % 3 + 1).cast("int")).alias("label"), *[(v.cast("int")).alias(n) for n, v in (("x1", k % 100), ("y1", k / 100), ("x2", k % 100), ("y2", k / 100))])
    got = {r.event_id: r.zone_id for r in zones.zoned(rows, table, 100, 100).collect()}
    free = {r.event_id for r in zones.unmasked(rows, table, 100, 100).collect()}
    want = {}
    for i in range(100 * 100):
        x, y, label = i % 100, i // 100, ("cat", "bird", "dog")[i % 3]
        held = [z for z in range(2000) if abs(x - (z * 7 % 40 + 30)) + abs(y - (z * 11 % 40 + 30)) <= 30]
        named = [z for z in held if label in ((), ("cat",), ("bird", "cat"))[z % 3]]
        general = [z for z in held if z % 3 == 0]
        if named or general:
            want[i] = (named or general)[0]
    assert got == want and free == set(range(100 * 100)) - set(want)


def test_live_folds_hold_one_part_of_a_key_at_a_time(spark, tmp_path):
    rows = spark.range(500).selectExpr("id % 2 as k", "(id * 7919) % 500 as us", "id as event_id", "cast((id * 31) % 100 as double) as v")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    own = stream_session(spark)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    stream = lambda: own.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def ended(frame, name):
        frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return own.table(name).collect()

    given, ordered = in_order(stream(), ["k"], ["us", "event_id"])

    def step(key, parts, state):
        found = [(len(p), p["us"].tolist()) for p in ordered(parts)]
        every = [us for _, part in found for us in part]
        yield pd.DataFrame({"k": [key[0]], "rows": [len(every)], "most": [max(n for n, _ in found)], "sorted": [every == sorted(every)]})

    seen = ended(given.groupBy("k").applyInPandasWithState(step, "k long, rows long, most long, sorted boolean", "n long", "append", GroupStateTimeout.NoTimeout), "parts_seen")
    assert [(r.rows, r.sorted) for r in seen] == [(250, True)] * 2 and max(r.most for r in seen) <= 20
    streamed = ended(folds.latch(stream(), ["k"], "us", "v", 90.0, 30.0), "latched")
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, folds.latch(rows, ["k"], "us", "v", 90.0, 30.0).collect()))


def plainly_stitched(tracks):
    """Every pair, again after each merge."""
    live = [x for x in tracks if x.seen]
    while True:
        live.sort(key=lambda x: x.seen[0][1])
        gone = []
        for j, b in enumerate(live):
            before = [(gap, i) for i, a in enumerate(live[:j]) if a not in gone and (gap := tracking._gap(a, b)) is not None]
            if before:
                live[min(before)[1]].absorb(b)
                gone.append(b)
        live = [x for x in live if x not in gone]
        if not gone:
            break
    while pair := next((p for p in itertools.combinations(live, 2) if p[0].label == p[1].label and tracking._shared_overlap(*p) >= tracking.STITCH_OVERLAP), None):
        into, other = sorted(pair, key=lambda x: (-x.hits, -x.best))
        into.absorb(other)
        live.remove(other)
    return live


def made_tracks(rng, n, frames):
    out = []
    for i in range(n):
        x = tracking.Track(i, rng.choice(["cat", "bird"]))
        start, cx, cy = rng.randrange(frames), rng.choice([0, 40, 200]) + rng.randrange(25), rng.randrange(25)
        for f in range(start, start + rng.randrange(1, 12)):
            x.add(f, f / 2, (x.label, rng.random(), (cx, cy, cx + 80.0, cy + 80.0)))
        out.append(x)
    return out


def test_stitching_equals_all_pairs(spark):
    rng = random.Random(3)
    merged = 0
    for n, frames in [(0, 5), (1, 5), *[(rng.randrange(5, 50), rng.choice([20, 100, 400])) for _ in range(60)]]:
        made = made_tracks(rng, n, frames)
        want = [(x.number, x.label, x.hits, x.best, x.samples, x.seen) for x in plainly_stitched(copy.deepcopy(made))]
        got = [(x.number, x.label, x.hits, x.best, x.samples, x.seen) for x in tracking.stitched(copy.deepcopy(made))]
        assert got == want
        merged += n - len(got)
    assert merged > 200


def test_stitching_a_long_clip_looks_at_few_pairs(monkeypatch):
    calls = []
    for name in ("_gap", "_shared_overlap"):
        plain = getattr(tracking, name)
        monkeypatch.setattr(tracking, name, lambda a, b, plain=plain: (calls.append(1), plain(a, b))[1])
    made = made_tracks(random.Random(5), 2000, 40_000)
    tracking.stitched(made)
    assert len(calls) < 40 * 2000  # of two million pairs


def test_pre_roll_joins_by_slots_of_time(spark, tmp_path):
    rows = spark.range(400).selectExpr("id as event_id", "concat('c', id % 2) as camera_id", "timestamp_seconds(1704067200 + id * 37) as ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    own = stream_session(spark)
    stream = own.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    met = live.around_live(stream, stream.where("event_id % 7 = 0"), "74 seconds", "5 minutes")
    met.writeStream.format("memory").queryName("pre_rolled").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert "slot" in met._jdf.queryExecution().analyzed().toString()  # not by the camera alone
    want = sorted((f, t) for t in range(0, 400, 7) for f in range(t % 2, 400, 2) if -74 <= 37 * (f - t) <= 300)
    assert sorted(map(tuple, own.table("pre_rolled").collect())) == want


def test_lanes_by_heaps_equal_a_search(monkeypatch):
    taken = {}
    monkeypatch.setattr(folds, "ordered_fold", lambda rows, keys, order, used, step, out: taken.update(step=step))
    folds.interval_lanes(None, ["k"], "s", "e")
    rng, state, ends = random.Random(8), None, []
    rows = sorted((rng.randrange(3000), rng.randrange(0, 400)) for _ in range(3000)) + [(rng.randrange(3000), rng.randrange(0, 400)) for _ in range(500)]
    for s, length in rows:
        state, lane = taken["step"](state, {"s": s, "e": s + length})
        want = next((i for i, e in enumerate(ends) if e <= s), len(ends))
        ends[want : want + 1] = [s + length]
        assert lane == want
    assert len(ends) > 100


def test_many_lanes_cost_little(monkeypatch):
    class End(int):
        compared = 0

        def __le__(self, other):
            End.compared += 1
            return int(self) <= other

    taken = {}
    monkeypatch.setattr(folds, "ordered_fold", lambda rows, keys, order, used, step, out: taken.update(step=step))
    folds.interval_lanes(None, ["k"], "s", "e")
    state = None
    for s in range(3000):
        state, lane = taken["step"](state, {"s": s, "e": End(s + 5000)})
    assert lane == 2999 and End.compared < 40 * 3000  # of four million


def test_tracks_are_made_once(spark):
    for name in ("trk_10_merge_overlaps", "trk_10_whole_clips"):
        assert "MapInArrow" not in plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_chart_lines_have_no_window_over_a_whole_line(spark):
    rows = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 1, 1.0), ("a", 2, None), ("a", 3, 5.0)], "k string, i int, v double")
    got = temporal.chart_lines(rows, ["k"], "i", ["v"])
    windows = [line for line in got._jdf.queryExecution().analyzed().toString().splitlines() if "windowspecdefinition" in line]
    assert windows and not any("min(" in w or "max(" in w for w in windows)
    assert sorted(map(tuple, got.select("k", "i", "run", "x", "y").collect()), key=repr) == sorted([(None, 1, 1, 0.0, 1.0), (None, 2, 1, 1.0, 0.0), ("a", 1, 1, 0.0, 1.0), ("a", 3, 2, 1.0, 0.0)], key=repr)


def test_a_velocity_is_worked_out_once_a_detection(monkeypatch):
    calls = []
    monkeypatch.setattr(tracking, "centre", lambda b, of=tracking.centre: calls.append(b) or of(b))
    track = tracking.Track(0, "cat")
    for f in range(6):
        track.add(f, float(f), ("cat", 0.9, (10.0 * f, 0.0, 10.0 * f + 80, 80.0)))
    boxes = [track.predicted(f) for f in range(6, 14)]
    assert boxes[0] == (58.0, 0.0, 138.0, 80.0) and boxes[6] == (50.0, 0.0, 130.0, 80.0)
    assert len(calls) == 2 * 5 + 8  # not 8 times both
    track.add(6, 6.0, ("cat", 0.9, (200.0, 0.0, 280.0, 80.0)))
    assert track.predicted(7) == (208.0, 0.0, 288.0, 80.0)
