import numpy as np
from pyspark.sql import functions as F

from larkspur.operators import frames

W, H = 320, 200


def scene(seed=0):
    """A daylight scene: gradients, blocks and grain."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:H, 0:W]
    base = np.stack([60 + 80 * x / W, 70 + 90 * y / H, 50 + 60 * np.sin(x / 9) ** 2 + 40 * np.cos(y / 7) ** 2], axis=2)
    base[40:90, 60:150] += 70
    return np.clip(base + rng.normal(0, 12, (H, W, 3)), 0, 255).astype(np.uint8)


def solid(b, g, r):
    return np.full((H, W, 3), (b, g, r), np.uint8)


def test_gates(spark):
    half = scene()
    half[:, : W // 2] = half[:, : W // 2].mean(2, keepdims=True).astype(np.uint8)
    quarter = scene()
    quarter[: H // 2, : W // 2] = (30, 30, 250)
    dead = scene()
    dead[:, : W // 2 + 10] = 130
    grey = np.repeat(np.repeat(np.linspace(20, 230, H).astype(np.uint8)[:, None, None], W, 1), 3, 2).copy()
    bars = np.repeat(np.repeat(np.linspace(0, 170, H).astype(np.uint8)[:, None, None], W, 1), 3, 2).copy()
    cases = {
        None: scene(), "too_dark": solid(0, 1, 1), "too_bright": solid(255, 254, 255), "pink_artifact": solid(20, 30, 200), "partial_pink_q0": quarter, "patterned_magenta": solid(150, 20, 150),
        "flat_gray": solid(128, 128, 128), "no_detail": solid(40, 60, 50), "dead_area": dead, "split": half, "grey_toned": grey, "colorbar": bars, "too_small": np.zeros((10, 10, 3), np.uint8),
    }
    rows = [(i, a.shape[1], a.shape[0], a.tobytes()) for i, a in enumerate(cases.values())] + [(90, W, H, None), (91, W, H, b"xx")]
    got = {r.frame_id: (r.ok, r.reason) for r in frames.judge(spark.createDataFrame(rows, "frame_id long, width int, height int, pixels binary")).collect()}
    for i, reason in enumerate(cases):
        assert got[i] == (reason is None, reason), (reason, got[i])
    assert got[90][1] == got[91][1] == "null/empty"


def test_bright_patches_are_faults_in_the_dark_only(spark):
    night = (scene() // 4).astype(np.uint8)
    patch, lamp = night.copy(), night.copy()
    patch[0:40, 0:80] = 255  # two tiles
    lamp[0:40, 0:40] = 255
    rows = spark.createDataFrame([(i, W, H, x.tobytes()) for i, x in enumerate((night, patch, lamp))], "frame_id long, width int, height int, pixels binary")
    assert [r.reason for r in frames.judge(rows, "night").orderBy("frame_id").collect()] == [None, "bright_outlier_dark_scene", None]
    assert "bright_outlier_dark_scene" not in {r.reason for r in frames.judge(rows).collect()}


def test_corrupt_strips(spark):
    rng = np.random.default_rng(3)
    strip = scene()
    strip[-60:] = np.where(rng.random((60, W, 1)) < 0.3, 128, np.array([10, 20, 250])).astype(np.uint8)
    rows = spark.createDataFrame([(i, W, H, x.tobytes()) for i, x in enumerate((scene(), strip))], "frame_id long, width int, height int, pixels binary")
    got = frames.measures(rows).orderBy("frame_id").select(frames.corrupt_strip().alias("c")).collect()
    assert [r.c for r in got] == [False, True]


def test_profiles_take_the_upper_median(spark):
    rows = [("a", 40.0, False), ("a", 60.0, False), ("b", 10.0, True), ("c", 200.0, False), ("c", 1.0, True), ("d", 20.0, False)]
    got = {r.k: r.profile for r in frames.pick_profile(spark.createDataFrame(rows, "k string, brightness double, corrupt boolean"), ["k"]).collect()}
    assert got == {"a": "twilight", "b": "night", "c": "day", "d": "night"}


def test_hashes_are_close_for_near_frames(spark):
    a, b, c = scene(1), np.clip(scene(1).astype(int) + 3, 0, 255).astype(np.uint8), scene(1)[::-1, ::-1].copy()
    rows = spark.createDataFrame([(i, W, H, x.tobytes()) for i, x in enumerate((a, b, c))], "frame_id long, width int, height int, pixels binary")
    h = frames.hashes(rows)
    pairs = h.alias("x").join(h.alias("y"), F.col("x.frame_id") < F.col("y.frame_id"))
    d = {(r[0], r[1]): r[2] for r in pairs.select("x.frame_id", "y.frame_id", frames.hamming256(F.col("x.phash"), F.col("y.phash"))).collect()}
    assert d[0, 1] <= 4 < d[0, 2]


def test_retries_stop(spark):
    rows = [("good", i, i == 2, False, 0.1 * i) for i in range(5)] + [("scene", i, False, True, 0.1 * i) for i in range(5)] + [("bad", i, False, False, 0.1 * i) for i in range(9)] + [("slow", i, False, False, 3.0 * i) for i in range(4)]
    table = spark.createDataFrame(rows, "k string, i int, ok boolean, scene boolean, t double")
    assert {r.k: r["count"] for r in frames.retries(table, ["k"], "i").groupBy("k").count().collect()} == {"good": 3, "scene": 2, "bad": 6, "slow": 2}


def smooth_scene():
    y, x = np.mgrid[0:480, 0:640]
    return np.repeat((80 + 40 * x / 640 + 30 * y / 480)[..., None], 3, 2).astype(np.uint8)


def table(spark, images, **more):
    return spark.createDataFrame([(i, a.shape[1], a.shape[0], a.tobytes()) for i, a in enumerate(images)], "frame_id long, width int, height int, pixels binary")


def test_bands_and_macroblocks(spark):
    rng = np.random.default_rng(4)
    band, clock, chroma, blocks, lamp, spots = (smooth_scene() for _ in range(6))
    band[100:140] = rng.integers(0, 255, (40, 640, 1))
    clock[330:350, 200:500] = rng.integers(0, 2, (20, 300, 1)) * 255
    chroma[400:440] = (160, 40, 160)
    blocks[160:224, 160:224] = np.where(rng.random((64, 64, 1)) < 0.5, np.array([250, 0, 250]), np.array([120, 0, 200])).astype(np.uint8)
    lamp[160:224, 160:224] = (20, 160, 220)
    spots[160:176, 160:176] = blocks[160:176, 160:176]
    got = frames.local_faults(table(spark, [smooth_scene(), band, clock, chroma, blocks, lamp, spots, np.zeros((8, 8, 3), np.uint8)])).orderBy("frame_id").collect()
    assert [(r.band or "").split("(")[0] for r in got][:4] == ["", "horizontal_anomaly_band", "", "bottom_strip_white"]
    assert got[1].band.startswith("horizontal_anomaly_band(y=19%,h=11%") and [r.macroblocks for r in got] == [0, 0, 0, 0, 12, 0, 0, 0]


def test_motion(spark):
    def at(x, size=60, base=0):
        a = (smooth_scene() * 0.6 + base).astype(np.uint8)
        if x is not None:
            a[200 : 200 + size, x : x + size] = 255
        return a

    # Still, a big subject appears, moves, only the light changes, and a small one.
    images = [at(None), at(None), at(100), at(180), at(180, base=4), at(None), at(300, 36), np.zeros((8, 8, 3), np.uint8)]
    rows = table(spark, images).withColumn("camera_id", F.lit("a")).withColumnRenamed("frame_id", "t")
    got = frames.motion(rows, sensitivity=0.5).orderBy("t").collect()
    assert [r.motion for r in got] == [False, False, True, True, False, True, False, False]
    x, y, w, h = got[2].box
    assert abs(x - 100) < 12 and abs(y - 200) < 12 and 50 < w < 85 and 50 < h < 85
    assert got[6].wildlife_low and len(got[6].boxes) == 4 and not got[1].boxes


def test_outlines():
    assert frames._outline_area(np.argwhere(np.ones((5, 7), bool))) == 24.0
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert frames._outline_area(np.argwhere(ring)) == 16.0
    assert len(frames._components(np.eye(3, dtype=bool), True)) == 1 and len(frames._components(np.eye(3, dtype=bool), False)) == 3
    assert frames._longest_run(np.array([0, 1, 1, 0, 1, 1, 1, 0], bool)) == (4, 3) and frames._longest_run(np.zeros(3, bool)) == (0, 0)
