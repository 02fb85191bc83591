"""Zones and hash registries by index, against plain loops."""

import random


from larkspur.operators import neighbours, zones

POLYGON = "zone_id long, camera_id string, labels array<string>, points array<struct<x:int,y:int>>, source_w int, source_h int, save_photo boolean, save_video boolean, send_message boolean"


def inside(x, y, points):
    """Ray casting; the boundary belongs to the polygon."""
    odd = False
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        if cross == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and (cross > 0) == (by > ay):
            odd = not odd
    return odd


def test_zones_and_masks_equal_a_loop(spark):
    rng = random.Random(4)
    width, height = 640, 360
    made = []
    for i in range(80):
        cx, cy, r = rng.randrange(-50, 1330), rng.randrange(-50, 770), rng.randrange(5, 160)
        points = [(cx + rng.randrange(-r, r + 1), cy + rng.randrange(-r, r + 1)) for _ in range(rng.choice([2, 3, 4, 6]))]
        made.append((i, rng.choice(["a", "b"]), rng.choice([None, [], ["cat"], ["cat", "bird"]]), points, *rng.choice([(None, None), (1280, 720), (640, 360)]), rng.choice([None, True, False]), None, False))
    made = [z if z[1] == "a" else (*z[:2], ["cat"], *z[3:]) for z in made] + [(200, "a", ["cat"], None, None, None, None, None, None)]
    boxes = [(i, rng.choice(["a", "a", "b", "c"]), rng.choice(["cat", "bird", "dog", None]), *(rng.randrange(-20, 700) for _ in range(4))) for i in range(400)]
    boxes += [(i, c, label, x - 3, y - 2, x + 3, y + 2) for i, (x, y, c, label) in enumerate([(p[0] * width // (z[4] or 1280), p[1] * height // (z[5] or 720), z[1], "cat") for z in made[:20] for p in z[3][:2]], 1000)]  # corners
    table = spark.createDataFrame(made, POLYGON)
    rows = spark.createDataFrame([(*b, "x", True) for b in boxes], "event_id long, camera_id string, label string, x1 int, y1 int, x2 int, y2 int, near string, for_all boolean")
    keep, free = [], []
    for i, camera, label, x1, y1, x2, y2 in boxes:
        x, y = max(0, min(width - 1, (x1 + x2) // 2)), max(0, min(height - 1, (y1 + y2) // 2))
        own = [z for z in made if z[1] == camera and z[3] and len(z[3]) >= 3 and (not z[2] or label in z[2])]
        held = [z for z in own if inside(x, y, [(int(px * width / (z[4] or 1280)), int(py * height / (z[5] or 720))) for px, py in z[3]])]
        best = min(held, key=lambda z: (not z[2], z[0]), default=None)
        if best or not own:
            keep.append((i, best[0] if best else None, (best[6] is not False) if best else None, True if best else None, False if best else None))
        if not held:
            free.append(i)
    got = zones.zoned(rows, table, width, height, 50)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, got.select("event_id", "zone_id", *zones.FLAGS).collect()), key=repr) == sorted(keep, key=repr)
    assert sorted(r.event_id for r in zones.unmasked(rows, table, width, height, 50).collect()) == sorted(free)
    assert len({k[1] for k in keep}) > 15 and got.columns[:9] == rows.columns
    assert zones.unmasked(rows, table.limit(0)).count() == len(boxes) and zones.zoned(rows.limit(0), table).count() == 0


def test_registry_index_is_exact(spark):
    rng = random.Random(9)
    hashes = [rng.getrandbits(64) for _ in range(40)]
    near = lambda h, n: h ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    registry = [(i, signed(near(h, rng.randrange(6)))) for i, h in enumerate(hashes)] + [(100 + i, signed(hashes[0])) for i in range(5)] + [(7, None), (-1, 0), (-2, -1)]
    rows = [(i, signed(near(rng.choice(hashes), rng.randrange(14)))) for i in range(300)] + [(500 + i, signed(hashes[1])) for i in range(50)] + [(900, None), (901, 0), (902, -1), (903, signed(1 << 63))]
    for most, bands in ((10, 4), (3, 4), (5, 8)):
        want = []
        for i, h in rows:
            found = [((h ^ of) & (2**64 - 1)).bit_count() for _, of in registry if of is not None] if h is not None else []
            best = min(((d, p) for d, (p, _) in zip(found, [r for r in registry if r[1] is not None], strict=True) if d <= most), default=None) if h is not None else None
            if best:
                want.append((i, best[1], best[0]))
        got = neighbours.nearest_hash(spark.createDataFrame(rows, "id long, hash long"), spark.createDataFrame(registry, "profile long, of long"), most, bands)
        assert sorted(map(tuple, got.select("id", "profile", "distance").collect())) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert neighbours.near_masks(16, 2)[0] == 0 and len(neighbours.near_masks(16, 2)) == 137
