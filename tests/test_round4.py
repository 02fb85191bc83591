"""Findings of the fourth review."""

import itertools
import random

from pyspark.sql import functions as F

from larkspur.operators import tracking, zones

POLYGON = "zone_id long, camera_id string, labels array<string>, points array<struct<x:int,y:int>>, source_w int, source_h int, save_photo boolean, save_video boolean, send_message boolean"
WIDTH, HEIGHT, LABELS = 44, 30, ("cat", "bird", "dog")


def inside(x, y, points):
    """Ray casting by edges with two known ends; the boundary belongs to the polygon."""
    odd = False
    for (ax, ay), (bx, by) in ((a, b) for a, b in zip(points, points[1:] + points[:1], strict=True) if None not in (*a, *b)):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and (cross > 0 if by > ay else cross < 0):
            odd = not odd
    return odd


def layers(rng, n):
    """Many small polygons over each other, of which hardly one covers a cell; some as they were before, some far out of the frame, some with an unknown corner."""
    made = []
    for i in range(n):
        cx, cy = rng.randrange(WIDTH), rng.randrange(HEIGHT // 2)
        points = [(cx + rng.randrange(-4, 5), cy + rng.randrange(-4, 5)) for _ in range(rng.choice([3, 4, 5]))]
        if i % 3 == 0 and made:
            points = rng.choice(made)[3]
        if i == 7:
            points = [(5, 20), (9, 26), (None, 28)]
        if i == 8:
            points = [(-10_000, 29), (10_000, 28), (10_000, 10_000)]
        made.append((n - i, "a", (None, ["cat"], ["bird", "cat"], ["cat", "bird", None])[rng.randrange(4)], points, WIDTH, HEIGHT, rng.choice([None, True, False]), None, rng.random() < 0.5))
    return made


def pixels(spark):
    k = F.col("id")
    x, y = (k % WIDTH).cast("int"), (k / WIDTH % HEIGHT).cast("int")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (k / (WIDTH * HEIGHT) + 1).cast("int"))
    return spark.range(WIDTH * HEIGHT * len(LABELS)).select(k.alias("event_id"), F.lit("a").alias("camera_id"), label.alias("label"), x.alias("x1"), y.alias("y1"), x.alias("x2"), y.alias("y2"))


def holders(made):
    """For each pixel and label the zones that hold it, in order."""
    of = {tuple(z[3]): [(x, y) for y in range(HEIGHT) for x in range(WIDTH) if inside(x, y, z[3])] for z in made}
    found = {}
    for z in sorted(made):
        for x, y in of[tuple(z[3])]:
            for n, label in enumerate(LABELS):
                if not z[2] or label in z[2]:
                    found.setdefault(n * WIDTH * HEIGHT + y * WIDTH + x, []).append(z)
    return found


def test_masks_in_layers_are_one_word_a_cell_and_label(spark):
    made = layers(random.Random(6), 1500)
    table, held = spark.createDataFrame(made, POLYGON), holders(made)
    free = {r.event_id for r in zones.unmasked(pixels(spark), table, WIDTH, HEIGHT).collect()}
    assert free == set(range(WIDTH * HEIGHT * len(LABELS))) - set(held) and 100 < len(free) < 3500
    assert "points" not in zones.unmasked(pixels(spark), table, WIDTH, HEIGHT)._jdf.queryExecution().optimizedPlan().toString()
    assert zones.mask_cells(table, WIDTH, HEIGHT).agg(F.max(F.size("near"))).first()[0] == 3


def test_zones_in_layers_keep_the_rows_of_cells_short(spark):
    """None of them covers a cell, so that no cell is answered for by one: each still has a pixel's first zone for a label once."""
    made = layers(random.Random(7), 1500)
    table, held = spark.createDataFrame(made, POLYGON), holders(made)
    got = {r.event_id: (r.zone_id, r.save_photo, r.save_video, r.send_message) for r in zones.zoned(pixels(spark), table, WIDTH, HEIGHT).collect()}
    best = {i: min(zs, key=lambda z: (not z[2], z[0])) for i, zs in held.items()}
    assert got == {i: (z[0], z[6] is not False, True, z[8]) for i, z in best.items()}
    near = zones.cells(table, WIDTH, HEIGHT)
    assert near.agg(F.max(F.size("near"))).first()[0] < 64 and near.count() > 15
    bits = near.select("camera_id", "cx", "cy", F.inline("near")).groupBy("camera_id", "cx", "cy", "scope").agg(F.sum(F.bit_count("bits")).alias("n"), F.bit_count(F.bit_or("bits")).alias("of"))
    assert bits.where("n <> of").count() == 0


def plainly_merged(tracks, least=0.55):
    """The reference's second pass: the first pair in the list that overlaps becomes one, and then from the start again. Samples are (f, box, score, source)."""

    def overlap(a, b):
        a, b = ({s[0]: s[1] for s in x["samples"] if s[3] == "detect"} for x in (a, b))
        shared = sorted(a.keys() & b.keys())
        return sum(tracking.box_iou(a[f], b[f]) for f in shared) / len(shared) if shared else 0.0

    tracks = [dict(x, samples=list(x["samples"])) for x in tracks]
    while True:
        live = [x for x in tracks if x["samples"]]
        pair = next(((a, b) for a, b in itertools.combinations(live, 2) if a["label"] == b["label"] and overlap(a, b) >= least), None)
        if not pair:
            return live
        a, b = pair
        rank = [(sum(s[3] == "detect" for s in x["samples"]), x["best"]) for x in pair]
        into, donor = (b, a) if rank[1] > rank[0] else (a, b)
        frames = {s[0] for s in into["samples"]}
        into["samples"] = sorted(into["samples"] + [s for s in donor["samples"] if s[0] not in frames], key=lambda s: s[0])
        into["best"], donor["samples"] = max([into["best"], *(s[2] for s in into["samples"])]), []


def sampled(tracks, clip):
    rows = []
    for place, x in enumerate(tracks):
        rows += [(clip, x["id"], f, float(f), *box, score, label, source, x["label"], place, nth) for nth, (f, box, score, source, label) in enumerate((*s, x["label"]) for s in x["samples"])]
    return rows


def crossing(rng, n):
    """Tracks side by side in a few places, so that chains of them overlap; with predicted samples and frames that have two detections."""
    out = []
    for i in rng.sample(range(100), n):
        start, cx, samples = rng.randrange(12), rng.randrange(0, 260, 13), []
        for f in range(start, start + rng.randrange(1, 9)):
            x = float(cx + rng.randrange(-6, 7))
            source = "detect" if f == start or rng.random() < 0.8 else "predicted"
            samples += [(f, (x + d, 0.0, x + d + 80, 80.0), rng.randrange(20) / 20, source) for d in range(2 if source == "detect" and rng.random() < 0.15 else 1)]
        out.append({"id": i, "label": rng.choice(["cat", "cat", "dog"]), "samples": samples, "best": max(s[2] for s in samples)})
    return out


def test_overlaps_merge_until_none_are_left(spark):
    rng = random.Random(11)
    clips = {f"c{k}": crossing(rng, rng.randrange(2, 22)) for k in range(60)} | {None: crossing(rng, 20)}
    # Each overlaps the next alone; the third has the most detections.
    row = lambda i, x, n: {"id": i, "label": "cat", "samples": [(f, (x, 0.0, x + 100.0, 100.0), 0.5, "detect") for f in range(n)], "best": 0.5}
    clips["chain"] = [row(i, 25.0 * i, 6 if i == 2 else 4) for i in range(6)]
    rows = spark.createDataFrame([r for clip, tracks in clips.items() for r in sampled(tracks, clip)], f"{tracking.SCHEMA}, {tracking.LISTED}")
    got = {}
    out = tracking.merge_overlapping(rows)
    for r in out.collect():
        got.setdefault((r.clip, r.track_id), []).append((r.f, (r.x1, r.y1, r.x2, r.y2), r.score, r.source))
    want = {(clip, x["id"]): sorted(x["samples"]) for clip, tracks in clips.items() for x in plainly_merged(tracks)}
    assert {k: sorted(v) for k, v in got.items()} == want and out.columns == tracking.SCHEMA.replace(",", "").split()[::2]
    assert sum(len(t) for t in clips.values()) - len(want) > 150


def test_a_clip_is_merged_as_its_tracks_ended(spark):
    rows, want, before = [], [], 0
    for seed in range(4):
        rng, state = random.Random(seed), tracking.Tracker()
        mine = [(f"c{seed}", f, float(f), rng.choice(["cat", "dog"]), round(rng.random(), 2), *(float(v) for v in (x, y, x + 80, y + 80))) for f in range(150) for x, y in [(rng.randrange(60), rng.randrange(20)) for _ in range(rng.randrange(8))]]
        for f, seen in itertools.groupby(sorted(mine, key=lambda r: (r[1], r[3], -r[4], *r[5:])), key=lambda r: r[1]):
            tracking.associate(state, [(r[3], r[4], r[5:]) for r in seen], f, float(f))
        ended = [{"id": x.number, "label": x.label, "best": x.best, "samples": [(s[0], s[2], s[3], s[5]) for s in x.samples]} for x in [*state.closed, *state.active]]
        want += [(f"c{seed}", x["id"], *s) for x in plainly_merged(ended) for s in x["samples"]]
        rows, before = rows + mine, before + len(ended)
    table = spark.createDataFrame(rows, "clip string, f int, t double, label string, score double, x1 double, y1 double, x2 double, y2 double")
    got = tracking.merge_overlapping(tracking.once(tracking.track(table, listed=True))).collect()
    assert sorted((r.clip, r.track_id, r.f, (r.x1, r.y1, r.x2, r.y2), r.score, r.source) for r in got) == sorted(want)
    assert len({r[:2] for r in want}) < before
