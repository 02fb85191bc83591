"""Frame quality: numpy measures each frame once inside a task, the verdict is a Column over the measures.

A frame is (frame_id, width, height, pixels): BGR bytes, rows first. The first gate that fails gives the reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the gates.
LEAST_WIDTH, LEAST_HEIGHT = 32, 24
DARK, BRIGHT = 2.0, 253.0
PINK_FULL, PINK_FULL_RATIO = 160.0, 2.5
PINK_QUARTER, PINK_QUARTER_RATIO = 180.0, 3.0
MAGENTA_RED, MAGENTA_BLUE, MAGENTA_GREEN, MAGENTA_LEAD, MAGENTA_SHARE, MAGENTA_WIDTH = 130, 130, 110, 25, 0.20, 256
FLAT_LOW, FLAT_HIGH, FLAT_STD = 115.0, 145.0, 10.0
NO_DETAIL = 2.0
GREY_SUM, GREY_LOW, GREY_HIGH, GREY_STD = 8.0, 115.0, 140.0, 12.0
TILES_X, TILES_Y, TILE_STD, TILE_LOW, TILE_HIGH, TILE_BAND_STD, TILE_DEAD = 8, 5, 3.0, 100.0, 160.0, 6.0, 0.35
SPLIT_LOW, SPLIT_HIGH = 3.0, 12.0
BAR_ROWS, BAR_ROW_STD, BAR_BETWEEN_STD = 9, 6.0, 35.0
TONED_LOW, TONED_HIGH, TONED_STD, TONED_KEEP = 100.0, 160.0, 8.0, 0.90
OUTLIER_TILE, OUTLIER_TILES, OUTLIER_LEAD, OUTLIER_SCENE = 240.0, 2, 100.0, 100.0
STRIP_ROWS, STRIP_MEAN, STRIP_STD = 60, 120.0, 60.0
NIGHT, TWILIGHT = 50.0, 110.0
#: By profile: standard deviation without detail, channel deviations of the grey midband, share of dead tiles.
PROFILES = {"day": (NO_DETAIL, GREY_STD, TILE_DEAD), "twilight": (1.2, 8.0, 0.55), "night": (0.8, 5.0, 0.85)}
HASH_SIZE = 16
BAND_WINDOW, BAND_PERCENT, BAND_TIMES, BAND_FLOOR, BAND_ROWS, BAND_MOST, BAND_Z, BAND_Z_TWILIGHT = 16, 30, 3.0, 5.0, 30, 0.60, 2.5, 4.0
HUE_LOW, HUE_HIGH, HUE_SATURATION, HUE_SHARE, HUE_ROWS, HUE_PEAK = 10, 40, 60, 0.01, 20, 1.0
CLOCK_Y, CLOCK_H, CLOCK_SLACK = 68, 6, 2
BLOCK, BLOCK_CHROMA, BLOCK_ENERGY, BLOCK_WINDOW, BLOCK_CLUSTER, BLOCK_FILL = 16, 85.0, 4.0, 5, 3, 0.5
MOTION_BLUR, MOTION_DIFFERENCE, MOTION_SCALE, MOTION_LEAST_SHARE, MOTION_AREA, WILDLIFE_AREA, MOTION_SENSITIVITY = 15, 28, (0.5, 2.0), 0.005, 0.005, 0.001, 0.5

MEASURES = ("blue", "green", "red", "grey_mean", "grey_std", "channel_std_sum", "pink_quarter", "magenta", "dead_tiles", "chroma_left", "chroma_right", "bar_row_std", "bar_between_std", "toned_std", "tile_max", "tile_base", "tiles_saturated", "strip_mean", "strip_std")


def _longest_run(flags: np.ndarray) -> tuple[int, int]:
    """(start, length) of the first longest run of true values."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return 0, 0
    k = int((ends - starts).argmax())
    return int(starts[k]), int(ends[k] - starts[k])


def _smooth(values: np.ndarray, width: int = BAND_WINDOW) -> np.ndarray:
    """Moving mean over rows; the ends are mirrored without the edge row."""
    before = width // 2
    padded = np.pad(values.astype(np.float64), (before, width - 1 - before), mode="reflect")
    return np.convolve(padded, np.full(width, 1 / width), "valid")


def anomaly_band(image: np.ndarray, min_z: float = BAND_Z, clock: tuple[int, int] | None = (CLOCK_Y, CLOCK_H)) -> str | None:
    """IMG-6: a band of rows that differ from their neighbours, or of wrong colours: 'name(y,h,score)', or none.

    A band of the first kind alone that lies within the camera's clock is none; in the lowest quarter it has the name of a strip.
    """
    h, w = image.shape[:2]
    if h < 40:
        return None
    grey = image @ np.array([0.114, 0.587, 0.299], np.float32)
    rows = _smooth(np.abs(np.diff(grey, axis=0)).mean(1))
    base = float(np.percentile(rows, BAND_PERCENT))
    start, length = _longest_run(rows > max(base * BAND_TIMES, BAND_FLOOR))
    z = (float(rows[start : start + length].mean()) - base) / max(float(rows.std()), 0.5) if length else 0.0
    delta = (start, length, z) if BAND_ROWS <= length <= BAND_MOST * h and z >= min_z else None

    top, low = image.max(2), image.min(2)
    spread = np.maximum(top - low, 1e-6)
    b, g, r = np.moveaxis(image, 2, 0)
    sector = np.where(top == r, (g - b) / spread, np.where(top == g, 2 + (b - r) / spread, 4 + (r - g) / spread))
    hue = np.rint(np.where(top > low, sector * 30 % 180, 0))
    wrong = ((hue < HUE_LOW) | (hue > HUE_HIGH)) & (np.rint(255 * (top - low) / np.maximum(top, 1)) > HUE_SATURATION)
    share = _smooth(wrong.sum(1))
    start, length = _longest_run(share > w * HUE_SHARE)
    peak = 100 * float(share.max()) / w
    chroma = (start, length, peak) if w >= 32 and HUE_ROWS <= length <= BAND_MOST * h and peak >= HUE_PEAK else None

    found = delta or chroma
    if not found:
        return None
    y, tall = (round(100 * v / h) for v in found[:2])
    if clock and not chroma and clock[0] - CLOCK_SLACK <= y and y + tall <= sum(clock) + CLOCK_SLACK:
        return None
    name = "horizontal_anomaly_band" if y < 75 else "bottom_strip_white" if not delta else "bottom_strip_bright"
    return f"{name}(y={y}%,h={tall}%,score={found[2]:.1f})"


def _components(flags: np.ndarray, diagonal: bool) -> list[np.ndarray]:
    """Connected cells of a grid, each as rows of (y, x); corners connect only if ``diagonal``."""
    left, out = set(map(tuple, np.argwhere(flags).tolist())), []
    near = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y, x) != (0, 0) and (diagonal or not (y and x))]
    while left:
        queue, mine = [left.pop()], []
        while queue:
            y, x = queue.pop()
            mine.append((y, x))
            for cell in [(y + dy, x + dx) for dy, dx in near]:
                if cell in left:
                    left.remove(cell)
                    queue.append(cell)
        out.append(np.array(mine))
    return out


def macroblock_cluster(image: np.ndarray) -> int:
    """IMG-10: the tiles of the largest cluster of false colour and local texture, if it is a fault; else 0."""
    h, w = (n // BLOCK for n in image.shape[:2])
    if min(h, w) < 4:
        return 0
    tiled = lambda a: a[: h * BLOCK, : w * BLOCK].reshape(h, BLOCK, w, BLOCK, -1).mean((1, 3))
    colour = tiled(image)
    wrong = colour.max(2) - colour.min(2) > BLOCK_CHROMA
    if not wrong.any():
        return 0
    p = np.pad(np.rint(image @ np.array([0.114, 0.587, 0.299], np.float32)), 1, mode="reflect")
    texture = np.abs(2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * p[1:-1, 1:-1])
    energy = tiled(texture[..., None])[..., 0]
    around = np.lib.stride_tricks.sliding_window_view(np.pad(energy, BLOCK_WINDOW // 2, mode="edge"), (BLOCK_WINDOW, BLOCK_WINDOW))
    clusters = _components(wrong & (energy > BLOCK_ENERGY * np.maximum(np.median(around, (2, 3)), 1.0)), False)
    if not clusters:
        return 0
    cells = max(clusters, key=len)
    box = int(np.prod(cells.max(0) - cells.min(0) + 1))
    return len(cells) if len(cells) >= BLOCK_CLUSTER and len(cells) >= BLOCK_FILL * box else 0


def _blurred(grey: np.ndarray, size: int = MOTION_BLUR) -> np.ndarray:
    """Gaussian blur to whole numbers, with mirrored borders."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    kernel = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    for axis in (0, 1):
        padded = np.pad(grey, [(size // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        grey = sum(k * np.take(padded, range(i, i + grey.shape[axis]), axis) for i, k in enumerate(kernel))
    return np.rint(grey)


def _outline_area(cells: np.ndarray) -> float:
    """The area within the outline through a blob's border pixels; holes count as filled."""
    y0, x0 = cells.min(0)
    inside = np.zeros(cells.max(0) - (y0, x0) + 3, bool)
    inside[cells[:, 0] - y0 + 1, cells[:, 1] - x0 + 1] = True
    outer = next(c for c in _components(~inside, False) if (c == 0).all(1).any())
    filled = np.ones_like(inside)
    filled[outer[:, 0], outer[:, 1]] = False
    p = np.pad(filled, 1)
    border = filled & ~(p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:])
    return float(max(0.0, filled.sum() - border.sum() / 2 - 1))


def changed_blobs(before: np.ndarray, now: np.ndarray, masked: np.ndarray | None = None, sensitivity: float | None = None, wildlife: float | None = None) -> tuple[np.ndarray, list[int] | None, bool, list[int]]:
    """IMG-17: from two blurred grey frames: (the later one at the earlier one's brightness, box of motion, only the low floor met, boxes over the low floor).

    Boxes are x, y, w, h one after the other; ``masked`` pixels don't count.
    """
    mean = float(now.mean())
    if mean > 1 and MOTION_SCALE[0] < (scale := float(before.mean()) / mean) < MOTION_SCALE[1]:
        now = np.floor(np.clip(now * scale, 0, 255))
    hot = np.abs(before - now) > MOTION_DIFFERENCE
    wide = np.pad(hot, 2)
    hot = np.lib.stride_tricks.sliding_window_view(wide, (5, 5)).any((2, 3))
    if masked is not None:
        hot &= ~masked
    size = hot.size
    if hot.sum() < int(size * MOTION_LEAST_SHARE):
        return now, None, False, []
    usual = int(size * MOTION_AREA / max(0.1, MOTION_SENSITIVITY if sensitivity is None else sensitivity))
    low = min(3.0, 1.4 * (MOTION_SENSITIVITY if sensitivity is None else sensitivity)) if not wildlife or wildlife <= 0 else min(3.0, max(0.1, wildlife))
    blobs = [(c, _outline_area(c)) for c in _components(hot, True)]
    box = lambda c: [int(c[:, 1].min()), int(c[:, 0].min()), int(np.ptp(c[:, 1])) + 1, int(np.ptp(c[:, 0])) + 1]
    small = [box(c) for c, a in blobs if a >= int(size * WILDLIFE_AREA / max(0.1, low))]
    big = [c for c, a in blobs if a >= usual]
    return now, box(np.concatenate(big)) if big else None, bool(small) and not big, [v for b in sorted(small) for v in b]


def motion(frames: DataFrame, key: str = "camera_id", order: str = "t", sensitivity: float | None = None, wildlife: float | None = None) -> DataFrame:
    """IMG-17 for every frame (key, order, width, height, pixels): motion, box, wildlife_low, boxes (as STR-13 takes them).

    Frames of a camera stream by in their order and only the last one is held; the first, and one of another size, has no motion.
    """
    columns = [key, order, "width", "height", "pixels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        camera, before = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part, out = batch.slice(at, 16), []
                for who, _, w, h, pixels in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if who != camera:
                        camera, before = who, None
                    if not w or not h or pixels is None or len(pixels) != 3 * w * h:
                        out.append((False, None, False, []))
                        continue
                    now = _blurred(np.rint(np.frombuffer(pixels, np.uint8).reshape(h, w, 3) @ np.array([0.114, 0.587, 0.299])))
                    if before is None or before.shape != now.shape:
                        before = now
                        out.append((False, None, False, []))
                        continue
                    before, box, low, boxes = changed_blobs(before, now, None, sensitivity, wildlife)
                    out.append((box is not None, box, low, boxes))
                found = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.bool_(), pa.list_(pa.int32()), pa.bool_(), pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *found], names=[key, order, "motion", "box", "wildlife_low", "boxes"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in frames.select(key, order).schema.fields]
    cut = frames.select(*columns).repartition(key).sortWithinPartitions(key, order)
    return cut.mapInArrow(run, f"{', '.join(kinds)}, motion boolean, box array<int>, wildlife_low boolean, boxes array<double>")


def local_faults(frames: DataFrame, profile: str = "day") -> DataFrame:
    """IMG-6 and IMG-10: frame_id, band (reason or null) and macroblocks (tiles of a faulty cluster) of every frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part, bands, blocks = batch.slice(at, 16), [], []
                for w, h, pixels in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    sound = w and h and pixels is not None and len(pixels) == 3 * w * h
                    image = np.frombuffer(pixels, np.uint8).reshape(h, w, 3).astype(np.float32) if sound else None
                    bands.append(anomaly_band(image, BAND_Z_TWILIGHT if profile == "twilight" else BAND_Z) if sound else None)
                    blocks.append(macroblock_cluster(image) if sound else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bands, pa.string()), pa.array(blocks, pa.int32())], names=["frame_id", "band", "macroblocks"])

    rows = frames.select(F.col("frame_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels")
    return rows.mapInArrow(run, "frame_id long, band string, macroblocks int")


def _trimmed_std(values: np.ndarray) -> float:
    """Standard deviation of the smallest nine tenths."""
    keep = max(1, int(len(values) * TONED_KEEP))
    return float(np.partition(values, keep - 1)[:keep].std())


def measure(width: int | None, height: int | None, pixels: bytes | None) -> tuple[float, ...] | None:
    """The MEASURES of a frame, or null where it can't be decoded."""
    if not width or not height or pixels is None or len(pixels) != 3 * width * height or width < LEAST_WIDTH or height < LEAST_HEIGHT:
        return None
    image = np.frombuffer(pixels, np.uint8).reshape(height, width, 3).astype(np.float32)
    b, g, r = (float(image[..., i].mean()) for i in range(3))
    grey = image @ np.array([0.114, 0.587, 0.299], np.float32)
    pink = -1.0
    for i, (rows, cols) in enumerate((y, x) for y in (slice(0, height // 2), slice(height // 2, None)) for x in (slice(0, width // 2), slice(width // 2, None))):
        qb, qg, qr = image[rows, cols].reshape(-1, 3).mean(0)
        if pink < 0 and qr > PINK_QUARTER and qr > qg * PINK_QUARTER_RATIO and qr > qb * PINK_QUARTER_RATIO:
            pink = float(i)
    step = max(1, width // MAGENTA_WIDTH)
    small = image[: height // step * step, : width // step * step].reshape(height // step, step, width // step, step, 3).mean((1, 3))
    sb, sg, sr = np.moveaxis(small, 2, 0)
    magenta = float(((sr >= MAGENTA_RED) & (sb >= MAGENTA_BLUE) & (sg <= MAGENTA_GREEN) & (np.minimum(sr, sb) - sg >= MAGENTA_LEAD)).mean())
    th, tw = height // TILES_Y, width // TILES_X
    tiles = grey[: th * TILES_Y, : tw * TILES_X].reshape(TILES_Y, th, TILES_X, tw)
    std, mean = tiles.std((1, 3)), tiles.mean((1, 3))
    dead = float(((std < TILE_STD) | ((mean >= TILE_LOW) & (mean <= TILE_HIGH) & (std < TILE_BAND_STD))).mean())
    chroma = image.max(2) - image.min(2)
    rows = grey[np.linspace(0, height - 1, BAR_ROWS + 2).astype(int)[1:-1]]
    toned = float(np.mean([_trimmed_std(np.abs(image[..., 0] - image[..., i]).ravel()) for i in (1, 2)]))
    flat = np.sort(mean, axis=None)
    strip = image[-STRIP_ROWS:] if height >= 2 * STRIP_ROWS else np.zeros((1, 1, 3), np.float32)
    top = strip.max(2)
    sat = np.rint(255 * (top - strip.min(2)) / np.maximum(top, 1))
    more = toned, float(flat[-1]), float(np.median(flat[: len(flat) // 3])), float((flat > OUTLIER_TILE).sum()), float(sat.mean()), float(sat.std())
    return (b, g, r, float(grey.mean()), float(grey.std()), float(sum(image[..., i].std() for i in range(3))), pink, magenta, dead, float(chroma[:, : width // 2].mean()), float(chroma[:, width // 2 :].mean()), float(rows.std(1).max()), float(rows.mean(1).std()), *more)


def measures(frames: DataFrame) -> DataFrame:
    """frame_id, width, height, decoded and the MEASURES of every frame; a task holds few frames at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                found = [measure(*x) for x in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                values = [pa.array([None if f is None else f[i] for f in found], pa.float64()) for i in range(len(MEASURES))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *values], names=["frame_id", "width", "height", *MEASURES])

    rows = frames.select(F.col("frame_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels")
    return rows.mapInArrow(run, "frame_id long, width int, height int, " + ", ".join(f"{m} double" for m in MEASURES))


def verdict(profile: str = "day") -> Column:
    """IMG-1..5, 7..9, 11..14: the first failing gate's name, null for a good frame. By day bright spots are no fault."""
    c = {m: F.col(m) for m in MEASURES}
    no_detail, midband, dead = PROFILES[profile]
    outlier = F.lit(profile != "day") & (c["grey_mean"] < OUTLIER_SCENE) & (c["tiles_saturated"] >= OUTLIER_TILES) & (c["tile_max"] - c["tile_base"] > OUTLIER_LEAD)
    bright = (c["blue"] + c["green"] + c["red"]) / 3
    low, high = F.least(c["chroma_left"], c["chroma_right"]), F.greatest(c["chroma_left"], c["chroma_right"])
    return (
        F.when((F.col("width") < LEAST_WIDTH) | (F.col("height") < LEAST_HEIGHT), "too_small")
        .when(c["grey_mean"].isNull(), "null/empty")
        .when(bright < DARK, "too_dark")
        .when(bright > BRIGHT, "too_bright")
        .when((c["red"] > PINK_FULL) & (c["red"] > c["green"] * PINK_FULL_RATIO) & (c["red"] > c["blue"] * PINK_FULL_RATIO), "pink_artifact")
        .when(c["pink_quarter"] >= 0, F.concat(F.lit("partial_pink_q"), c["pink_quarter"].cast("int")))
        .when(c["magenta"] >= MAGENTA_SHARE, "patterned_magenta")
        .when(c["grey_mean"].between(FLAT_LOW, FLAT_HIGH) & (c["grey_std"] < FLAT_STD), "flat_gray")
        .when(c["grey_std"] < no_detail, "no_detail")
        .when(c["channel_std_sum"] < GREY_SUM, "gray_uniform")
        .when(c["grey_mean"].between(GREY_LOW, GREY_HIGH) & (c["channel_std_sum"] < midband), "gray_midband")
        .when(c["dead_tiles"] > dead, "dead_area")
        .when(outlier, "bright_outlier_dark_scene")
        .when((low < SPLIT_LOW) & (high > SPLIT_HIGH), "split")
        .when(bright.between(TONED_LOW, TONED_HIGH) & (c["toned_std"] < TONED_STD), "grey_toned")
        .when((c["bar_row_std"] < BAR_ROW_STD) & (c["bar_between_std"] > BAR_BETWEEN_STD), "colorbar")
    )


def judge(frames: DataFrame, profile: str = "day") -> DataFrame:
    """frame_id, ok, reason of every frame; the profile is that of the time of day (see ``pick_profile``)."""
    found = verdict(profile)
    return measures(frames).select("frame_id", found.isNull().alias("ok"), found.alias("reason"))


def corrupt_strip() -> Column:
    """IMG-16: whether the bottom rows, in the measures of a frame, are a saturated and uneven strip."""
    return (F.col("strip_mean") > STRIP_MEAN) & (F.col("strip_std") > STRIP_STD)


def pick_profile(samples: DataFrame, keys: list[str]) -> DataFrame:
    """IMG-15: night, twilight or day by the upper median of sound samples' brightness; all corrupt: night; none: day."""
    sound = F.sort_array(F.collect_list(F.when(~F.col("corrupt"), F.col("brightness"))))
    rows = samples.groupBy(*keys).agg(sound.alias("b"), F.count("*").alias("n"))
    mid = F.get("b", F.floor(F.size("b") / 2).cast("int"))
    return rows.select(*keys, F.when((F.size("b") == 0) & (F.col("n") > 0), "night").when(mid < NIGHT, "night").when(mid < TWILIGHT, "twilight").otherwise("day").alias("profile"))


def perceptual_bits(grey: np.ndarray, size: int = HASH_SIZE) -> np.ndarray:
    """GEO-14: whether each cell of a size x size grid is brighter than the mean of all."""
    h, w = grey.shape
    ys, xs = (np.linspace(0, n, size + 1).astype(int) for n in (h, w))
    cells = np.array([[grey[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])].mean() for j in range(size)] for i in range(size)])
    return cells > cells.mean()


def difference_hash(grey: np.ndarray) -> int:
    """GEO-13: 64 bits, each whether a cell of a 9 x 8 grid is darker than its right neighbour, as a signed long."""
    h, w = grey.shape
    ys, xs = np.linspace(0, h, 9).astype(int), np.linspace(0, w, 10).astype(int)
    cells = np.array([[grey[ys[i] : max(ys[i] + 1, ys[i + 1]), xs[j] : max(xs[j] + 1, xs[j + 1])].mean() for j in range(9)] for i in range(8)])
    value = 0
    for bit in (cells[:, 1:] > cells[:, :-1]).ravel():
        value = value << 1 | int(bit)
    return value - 2**64 if value >= 2**63 else value


def hashes(frames: DataFrame) -> DataFrame:
    """frame_id, dhash (long) and phash (four longs) of every frame that can be decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, d, p = [], [], []
            for ident, w, h, pixels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if w and h and pixels is not None and len(pixels) == 3 * w * h:
                    grey = np.frombuffer(pixels, np.uint8).reshape(h, w, 3) @ np.array([0.114, 0.587, 0.299])
                    ids.append(ident)
                    d.append(difference_hash(grey))
                    p.append(np.packbits(perceptual_bits(grey)).view(">i8").tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(d, pa.int64()), pa.array(p, pa.list_(pa.int64()))], names=["frame_id", "dhash", "phash"])

    return frames.select(F.col("frame_id").cast("long"), F.col("width").cast("int"), F.col("height").cast("int"), "pixels").mapInArrow(run, "frame_id long, dhash long, phash array<long>")


def hamming256(a: Column, b: Column) -> Column:
    """GEO-15: differing bits of two hashes of four longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)


def retries(attempts: DataFrame, keys: list[str], order: str, most: int = 6, scene_most: int = 2, budget_s: float = 5.0) -> DataFrame:
    """IMG-18: the attempts that a slot makes: until one is good, at most six, at most two scene rejections, within five seconds.

    Attempts have ok, scene (the rejection is the scene's own) and t, seconds since the slot began.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max(F.col("ok").cast("int")).over(before), F.lit(0)) > 0
    stopped = stopped | (F.coalesce(F.sum(F.col("scene").cast("int")).over(before), F.lit(0)) >= scene_most)
    rows = attempts.withColumn("made", ~stopped & (F.row_number().over(w) <= most) & (F.col("t") <= budget_s))
    return rows.where("made").drop("made")
