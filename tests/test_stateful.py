"""Stateful streams with timers, polled sources and published messages: against plain walks, in one batch and in many."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators import folds, manage
from larkspur.session import stream_session
from larkspur.sources import polling
from larkspur.streaming import events as live
from larkspur.streaming import publish, stateful

START = datetime(2024, 1, 1)
ROWS = "camera_id string, label string, event_id long, at long, online boolean"


def at(seconds):
    return int(START.timestamp() * 1e6 + seconds * 1e6)


def streamed(spark, tmp_path, rows, build, cuts):
    """build(stream)'s output over the rows (camera_id, label, event_id, seconds, online), given as one file for each cut; and the states left."""
    own, folder = stream_session(spark), f"{tmp_path}/{random.getrandbits(60)}"
    rows = sorted(rows, key=lambda r: (r[3], r[2]))
    query = None
    for k, n in enumerate(cuts):
        own.createDataFrame(rows[n : (*cuts, len(rows))[k + 1]], ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        us = F.lit(at(0)) + F.col("at") * 1_000_000
        stream = own.readStream.schema(ROWS).parquet(f"{folder}/in").select("camera_id", "label", "event_id", F.timestamp_micros(us).alias("ts"), us.alias("us"), "online")
        out = build(stream)
        query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()), left


@pytest.mark.parametrize("cuts", [(0,), (0, 3, 5, 9)])
def test_watchdog_tells_of_silent_cameras(spark, tmp_path, cuts):
    rows = [("a", "", 1, 0, True), ("a", "", 2, 30, True), ("b", "", 3, 40, False), ("c", "", 4, 45, False), ("c", "", 5, 100, True), ("d", "", 6, 50, False), ("d", "", 7, 400, False), ("d", "", 8, 500, True), ("a", "", 9, 5000, True), ("e", "", 10, 9000, True)]
    got, _ = streamed(spark, tmp_path, rows, lambda s: stateful.watchdog(s, 600.0, 300.0), cuts)
    want = [
        ("a", 630, "down"), ("a", 930, "alert"), ("a", 5000, "recovered"), ("a", 5600, "down"), ("a", 5900, "alert"),  # silent after 30 and after 5000
        ("b", 40, "down"), ("b", 340, "alert"),  # no row after the first
        ("c", 45, "down"),  # back before the alert: nothing to recover from
        ("c", 700, "down"), ("c", 1000, "alert"), ("d", 50, "down"), ("d", 350, "alert"), ("d", 500, "recovered"), ("d", 1100, "down"), ("d", 1400, "alert"),
    ]
    assert got == sorted((c, at(s), what) for c, s, what in want)


def confirmed(rows, n, window):
    out, states = [], {}
    for cam, label, event_id, s, _ in sorted(rows, key=lambda r: (r[3], r[2])):
        hits, done = states.get((cam, label), ([], False))
        if hits and done and s - hits[-1] > 2 * window:
            hits, done = [], False
        hits = [h for h in [*hits, s] if s - h <= window]
        if len(hits) >= n and not done:
            done = True
            out.append((cam, label, event_id))
        states[cam, label] = (hits, done)
    return sorted(out)


@pytest.mark.parametrize("cuts", [(0,), (0, 40, 41, 120, 180)])
def test_confirmation_forgets_dead_keys(spark, tmp_path, cuts):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice(["cat", "bird"]), i, rng.randrange(4_000), True) for i in range(200)] + [("z", "cat", 900, 20_000, True)]
    got, left = streamed(spark, tmp_path, rows, lambda s: stateful.confirm(s, 3, 60.0), cuts)
    assert got == confirmed(rows, 3, 60)
    assert left[-1] < max(left)  # the four keys of the first hour are gone; that of the last row is not


def test_gates_count_from_events_that_pass_all(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice(["cat", "bird", "person"]), i, rng.randrange(6_000), True) for i in range(300)]
    cooldowns = {"cat": 200.0, "bird": 90.0}
    gate = lambda stream: stateful.gate_chain(stream.select("*", F.when(F.col("event_id") % 5 == 0, "muted").alias("early"), F.when(F.col("event_id") % 4 == 0, "silent").alias("late")), 30.0, cooldowns)
    want, camera, last = [], {}, {}
    for cam, label, i, s, _ in sorted(rows, key=lambda r: (r[3], r[2])):
        reason = "muted" if i % 5 == 0 else "rate_limited" if s - camera.get(cam, -1e9) < 30 else "cooling_down" if s - last.get((cam, label), -1e9) < cooldowns.get(label, 0) else "silent" if i % 4 == 0 else None
        if not reason:
            camera[cam] = last[cam, label] = s
        want.append((i, reason))
    assert len({r for _, r in want}) == 5
    for cuts in ((0,), (0, 50, 200)):
        assert streamed(spark, tmp_path, rows, gate, cuts)[0] == sorted(want)


def test_polled_documents_of_any_shape(tmp_path):
    good = {"time": [0, 900, 1800, 2700], "v": [1, None, 2.5]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0").write_text(json.dumps(good) + "\n[]\n{\n" + json.dumps({"time": 3}) + "\n")
    (tmp_path / "a" / "_SUCCESS").write_text("{")
    found = list(polling.documents(f"file://{tmp_path}/a"))
    assert found == [good, {"time": 3}] and list(polling.documents(f"{tmp_path}/none")) == []
    assert [r for d in found for r in polling.slots(d, ["v", "w"], 1, 4)] == [(900, None, None), (1800, 2.5, None), (2700, None, None)]


def test_polling_restarts_where_it_stopped(spark, tmp_path):
    day = {"time": list(range(0, 86_400, 900)), "v": list(range(96))}
    for station in "xy":
        for date, first in (("1970-01-01", 0), ("1970-01-02", 86_400)):
            (tmp_path / f"{station}-{date}.json").write_text(json.dumps(day | {"time": [t + first for t in day["time"]]}))
    for until in (10_000, 10_000, 100_000, 170_000):
        stream = polling.polled(spark, f"{tmp_path}/{{station}}-{{day}}.json", ["x", "y", "gone"], ["v"], 1_800, until)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        assert got == [(s, t, float(t // 900 % 96)) for s in "xy" for t in range(1_800, until + 1, 900)]


def test_a_batch_is_published_once(spark, tmp_path):
    class Logged:
        """Sends to a file, and refuses some."""

        def __init__(self, path):
            self.path = path

        def __call__(self):
            return self

        def send(self, topic, payload):
            with open(self.path, "a") as log:
                log.write(f"{topic} {payload}\n")
            if payload == "5":
                raise OSError
            return int(payload) % 3

    own, schema = stream_session(spark), "event_id long, us long, topic string, payload string"
    rows = [(i, i * 100_000_000, "t" if i % 2 else "u", str(i)) for i in range(12)]
    log = tmp_path / "log.txt"

    def run():
        stream = own.readStream.schema(schema).parquet(f"{tmp_path}/in")
        publish.publish(stream, f"{tmp_path}/out", Logged(str(log)), "home").trigger(availableNow=True).start().awaitTermination()

    for part in (rows[:6], rows[6:]):
        own.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    commit = tmp_path / "out" / "log" / "commits"
    for name in ("1", ".1.crc"):  # as if the driver was lost before the second batch was committed
        (commit / name).unlink()
    run()
    assert sorted(log.read_text().splitlines()) == sorted(f"home/{t} {p}" for _, _, t, p in rows)
    sent = spark.read.schema(publish.MESSAGES).parquet(f"{tmp_path}/out/messages/batch=*").collect()
    assert sorted((r.event_id, r.code) for r in sent) == [(i, -1 if i == 5 else i % 3) for i in range(12)]
    told = sorted(tuple(r) for r in spark.read.schema(publish.WARNINGS).parquet(f"{tmp_path}/out/warnings/batch=*").select("event_id", "topic", "code").collect())
    # Each topic and code has failures six events, 600 seconds, apart, but for that of event 5, which is another code.
    assert told == [(i, f"home/{'t' if i % 2 else 'u'}", -1 if i == 5 else i % 3) for i in range(12) if i % 3]
    close = spark.createDataFrame([(1, 0, "t", 1), (2, 299_000_000, "t", 1), (3, 300_000_000, "t", 1), (4, 10, "t", 2)], publish.WARNINGS)
    assert sorted(r.event_id for r in publish.warnings(close, close.limit(0)).collect()) == [1, 3, 4]
    assert sorted(r.event_id for r in publish.warnings(close, close.where("event_id = 1")).collect()) == [3, 4]


def guarded(slots, recheck, least, share, most):
    """The outcomes of (value, strict) slots."""
    out, held, run, filled, ended = [], None, 0, 0, None
    for n, (value, strict) in enumerate(slots, 1):
        if ended:
            out.append(ended)
            continue
        if value is not None:
            held, run = bool(strict), 0
            out.append("fresh")
        else:
            if held is False and run >= recheck:
                held, run = None, 0
            if held is None:
                out.append("missing")
            else:
                run, filled = run + 1, filled + 1
                out.append("backfilled")
        if n >= least and filled / n > share:
            ended = "too_many_backfills"
        elif run > most:
            ended = "too_many_in_a_row"
    return out


def test_guarded_backfill(spark, tmp_path):
    rng = random.Random(7)
    captures = {f"c{i}": [(rng.choice([1, None, None, None]) if rng.random() < 0.2 + i / 20 else 1, rng.random() < 0.5) for _ in range(60)] for i in range(12)}
    captures |= {"long": [(1, True)] + [(None, None)] * 40, "never": [(None, True)] * 30, "empty": []}

    want = sorted((c, n, o) for c, slots in captures.items() for n, o in enumerate(guarded(slots, 3, 30, 0.4, 20)))
    assert len({o for *_, o in want}) == 5
    values = spark.createDataFrame([(c, n, v, s) for c, slots in captures.items() for n, (v, s) in enumerate(slots)], "c string, n long, value int, strict boolean")
    fold = lambda f, order: folds.guarded_backfill(f, ["camera_id"], order, "value", "strict", 3, 30, 0.4, 20)
    batch = fold(values.withColumnRenamed("c", "camera_id"), "n").select("camera_id", "n", "outcome")
    assert sorted(map(tuple, batch.collect())) == want

    folder = f"{tmp_path}/slots"
    for half in ("n < 25", "n >= 25"):
        values.where(half).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(values.schema).parquet(folder).withColumnRenamed("c", "camera_id")
        fold(stream, "n").select("camera_id", "n", "outcome").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want



def test_live_pre_roll_and_its_state(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice(["person", "cat"]), i, rng.randrange(20_000), True) for i in range(200)] + [("z", "person", 1_000, 90_000, True)]
    live_join = lambda s: live.around_live(s, s.where("label = 'person' and event_id % 4 = 0"), "120 seconds", "60 seconds")
    triggers = [r for r in rows if r[1] == "person" and r[2] % 4 == 0]
    want = sorted((f[2], t[2]) for f in rows for t in triggers if f[0] == t[0] and t[3] - 120 <= f[3] <= t[3] + 60)
    for cuts in ((0,), (0, 30, 90, 150)):
        got, left = streamed(spark, tmp_path, rows, live_join, cuts)
        assert got == want and left[-1] <= 4 < max(left)  # nothing of the first hours can meet anything any more


def test_unlocks_are_written_once(spark, tmp_path):
    schema = "event_id long, ts timestamp, name string"
    parts = [[(1, 50, "owl"), (2, 40, "owl"), (3, 10, None), (4, 40, "owl")], [(5, 1, "owl"), (6, 70, "jay"), (7, 60, "jay")], [(8, 0, "jay"), (9, 99, "tit")]]
    for k, part in enumerate(parts):
        spark.createDataFrame([(i, START + timedelta(seconds=s), n) for i, s, n in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k == 2:  # as if the driver was lost before the second batch was committed
            for name in ("1", ".1.crc"):
                (tmp_path / "out" / "log" / "commits" / name).unlink()
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        live.first_unlocks(stream, "name", f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.name, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out/unlocks").collect())
    assert got == [("jay", 7), ("owl", 2), ("tit", 9)]  # what came first was written, though earlier events came later


def test_paths_are_rewritten_wherever_they_are(spark):
    schema = "camera_id string, video_relpath string, note string, media struct<deep:array<struct<url:string,at:int>>,by:map<string,string>>, all_paths array<array<string>>, file_path map<string,struct<x_path:string>>, n int"
    rows = [
        ("old", "old/a.mp4", "old/x", ([("/old/b", 1), (None, 2)], {"url": "old"}), [["old/c", "older/c"], []], {"k": ("x/old",)}, 1),
        ("old", None, None, None, None, None, None),
        ("other", "old/a.mp4", "", ([], {}), [["other/old"]], {}, 2),
        (None, "old", None, None, None, None, 3),
    ]
    out = manage.rewrite_paths(spark.createDataFrame(rows, schema), spark.createDataFrame([("old", "new"), ("unused", "x")], "camera_id string, new_id string"))
    assert out.columns == ["camera_id", "video_relpath", "note", "media", "all_paths", "file_path", "n"]
    plain = lambda x: tuple(map(plain, x)) if isinstance(x, tuple) else [plain(y) for y in x] if isinstance(x, list) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else x
    want = [("new", "new/a.mp4", "old/x", ([("/new/b", 1), (None, 2)], {"url": "old"}), [["new/c", "older/c"], []], {"k": ("x/new",)}, 1), ("new", *rows[1][1:]), *rows[2:]]
    assert sorted((plain(tuple(r)) for r in out.collect()), key=repr) == sorted(want, key=repr)
