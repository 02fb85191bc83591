"""JN-9, GEO-10, GEO-11: detections against tables of zones and masks, by a spatial index.

A frame is a grid of small cells. A polygon is laid over the cells of its camera's frame once: for each it is a mask, a bit for every pixel that it holds. A detection has one centre,
so one cell and one bit, and meets that cell's row by an equality join. Detections are neither multiplied nor grouped, and no polygon is tried against a detection.

Of the polygons over a cell that count for a label, each keeps only the pixels that no earlier one has. So a cell holds at most one polygon for every pixel and label, however many
polygons a camera has and however they lie over each other, and what is past that is left out before it is shuffled. Polygons of one shape, camera and labels are laid once, for the first of them.

Polygons (zone_id, camera_id, labels, points, source_w, source_h, save_photo, save_video, send_message) are tried by zone_id, then by their flags. Without labels, or with an empty list, one is for all. Those of fewer than three points
don't count. Points are in a picture of source_w by source_h (1280 by 720 if null) and scaled to the frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.tracking import once

SOURCE_W, SOURCE_H = 1280, 720
CELL = 8
FLAGS = ("save_photo", "save_video", "send_message")
CELLS = ("camera_id", "cx", "cy", "word")
HELD = "_zones_held"
SCOPES_HELD, ROWS_HELD = 64, 1 << 16


def _valid(polygons: DataFrame) -> DataFrame:
    return polygons.where(F.size("points") >= 3)


def _for_all(labels: Column) -> Column:
    return labels.isNull() | (F.size(labels) == 0)


def _masks(points: list[dict], width: int, height: int, cell: int) -> tuple[int, int, np.ndarray] | None:
    """``(cy, cx, masks)``: the first cell that a polygon can have part in, and from there on, by rows and columns of cells, the pixels that it holds, in words of 64 bits.

    The boundary belongs to a polygon, and edges with an unknown end don't count, as in ``geo.in_polygon``. All is in whole numbers: in a row of pixels an edge is crossed by those
    to the left of one column, so the work is that of edges by rows and of the pixels.
    """
    corners = [(p["x"], p["y"]) for p in points]
    edges = [(*a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True) if None not in (*a, *b)]
    if not edges:
        return None
    wide = max(abs(v) for e in edges for v in e) >= 1 << 30  # products that might not fit 64 bits
    ax, ay, bx, by = (v[:, None] for v in np.array(edges, object if wide else np.int64).T)
    left, top = (0 if len(edges) < len(points) else max(min(ax.min(), bx.min()), 0) // cell), max(min(ay.min(), by.min()), 0) // cell
    across, down = min(max(ax.max(), bx.max()), width - 1) // cell + 1 - left, min(max(ay.max(), by.max()), height - 1) // cell + 1 - top
    if across <= 0 or down <= 0:
        return None
    x0, y0 = left * cell, top * cell
    columns, y = min(across * cell, width - x0), np.arange(y0, min(y0 + down * cell, height))[None, :]
    steep = (by - ay) + (by == ay)  # 1 where it isn't used
    run = (bx - ax) * (y - ay)
    column = ax - -run // steep - x0  # crossed by pixels to the left of it
    crossed = np.nonzero((ay > y) != (by > y))
    ends = np.minimum(np.maximum(column[crossed], 0), columns).astype(np.int64) + crossed[1] * (columns + 1)
    ends = np.bincount(ends, minlength=y.size * (columns + 1)).reshape(y.size, columns + 1)
    held = np.zeros((down * cell, across * cell), bool)
    held[: y.size, :columns] = ends[:, :0:-1].cumsum(axis=1)[:, ::-1] & 1
    on = np.nonzero((ay != by) & (np.minimum(ay, by) <= y) & (y <= np.maximum(ay, by)) & (run % steep == 0) & (column >= 0) & (column < columns))
    held[on[1], column[on].astype(np.int64)] = True
    for x, level, to, _ in (e for e in edges if e[1] == e[3] and y0 <= e[1] < y0 + y.size):
        held[level - y0, max(min(x, to) - x0, 0) : max(min(max(x, to) + 1 - x0, columns), 0)] = True
    by_cell = held.reshape(down, cell, across, cell).transpose(0, 2, 1, 3).reshape(down, across, cell * cell)
    packed = np.packbits(by_cell, axis=2, bitorder="little")
    if packed.shape[2] % 8:
        packed = np.pad(packed, ((0, 0), (0, 0), (0, -packed.shape[2] % 8)))
    return int(top), int(left), packed.view("<i8")


def _shapes(polygons: DataFrame, width: int, height: int, flags: bool) -> DataFrame:
    """``(camera_id, scopes, points, zone)``: the polygons with points on the frame, those alike but for their ids once, by the first. ``scopes`` are the labels one counts for, null for all."""
    scale = lambda p: F.struct((p["x"] * width / F.coalesce("source_w", F.lit(SOURCE_W))).cast("int").alias("x"), (p["y"] * height / F.coalesce("source_h", F.lit(SOURCE_H))).cast("int").alias("y"))
    scopes = F.when(_for_all(F.col("labels")), F.array(F.lit(None).cast("string"))).otherwise(F.array_sort(F.array_distinct(F.filter("labels", lambda x: x.isNotNull()))))
    shape = [F.col("camera_id"), scopes.alias("scopes"), F.transform("points", scale).alias("points")]
    if not flags:
        return _valid(polygons).select(*shape).distinct().withColumn("zone", F.lit(True))
    set_flags = [F.coalesce(F.col(f), F.lit(True)).alias(f) for f in FLAGS]
    first = _valid(polygons).groupBy(*shape, *set_flags, F.isnull("zone_id").alias("unnamed")).agg(F.min("zone_id").alias("zone_id"))
    return first.groupBy("camera_id", "scopes", "points").agg(F.min(F.struct("zone_id", *FLAGS)).alias("zone"))


def _laid(shapes: DataFrame, width: int, height: int, cell: int) -> DataFrame:
    """``(camera_id, zone, scope, cx, cy, word, bits)``: the pixels of each word of a cell that a polygon holds for one of its labels.

    Shapes are dealt out, as a small table is one file. A task lays a camera's polygons in their order and leaves out the pixels that an earlier one of its own has for the label,
    so it gives a word at most 64 times for each label.
    """
    spark, size = shapes.sparkSession, (-(-height // cell), -(-width // cell), -(-cell * cell // 64))
    dealt = shapes.repartition(max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))), *shapes.columns).sortWithinPartitions("camera_id", "zone")

    def flat(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
        counts = [len(f[-1]) for f in found]
        rows = pa.array(np.repeat([f[0] for f in found], counts))
        scopes = pa.array([f[1] for f in found], pa.string()).take(pa.array(np.repeat(np.arange(len(found)), counts)))
        cy, cx, word = (pa.array(np.concatenate([f[i] for f in found]), pa.int32()) for i in (2, 3, 4))
        return pa.RecordBatch.from_arrays([batch.column("camera_id").take(rows), batch.column("zone").take(rows), scopes, cx, cy, word, pa.array(np.concatenate([f[5] for f in found]), pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        camera, seen = None, {}
        for batch in batches:
            found, n = [], 0
            for i, (of, scopes, points) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("camera_id", "scopes", "points")), strict=True)):
                if (laid := _masks(points, width, height, cell)) is None:
                    continue
                if of != camera or len(seen) > SCOPES_HELD:
                    camera, seen = of, {}
                top, left, masks = laid
                for scope in scopes:
                    if scope not in seen:
                        seen[scope] = np.zeros(size, np.int64)
                    had = seen[scope][top : top + masks.shape[0], left : left + masks.shape[1]]
                    fresh = masks & ~had
                    had |= masks
                    at = np.nonzero(fresh)
                    if len(at[0]):
                        found.append((i, scope, at[0] + top, at[1] + left, at[2], fresh[at]))
                        n += len(at[0])
                if n > ROWS_HELD:
                    yield flat(batch, found)
                    found, n = [], 0
            if found:
                yield flat(batch, found)

    types = dict(shapes.dtypes)
    names = ["camera_id", "zone", "scope", "cx", "cy", "word", "bits"]
    return dealt.mapInArrow(run, f"camera_id {types['camera_id']}, zone {types['zone']}, scope string, cx int, cy int, word int, bits long")


def cells(polygons: DataFrame, width: int, height: int, cell: int = CELL) -> DataFrame:
    """``(camera_id, cx, cy, word, near)``: the zones of each word of 64 pixels of a cell of a camera's frame, each with the pixels where it is the first for a label."""
    return _cells(_shapes(polygons, width, height, True), width, height, cell)


def _cells(shapes: DataFrame, width: int, height: int, cell: int) -> DataFrame:
    laid = _laid(shapes, width, height, cell)
    earlier = F.bit_or("bits").over(Window.partitionBy(*CELLS, "scope").orderBy("zone").rowsBetween(Window.unboundedPreceding, -1))
    first = laid.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce(earlier, F.lit(0).cast("long"))))).where("bits <> 0")
    return once(first.groupBy(*CELLS).agg(F.collect_list(F.struct("scope", "bits", "zone")).alias("near")), "cells")


def mask_cells(masks: DataFrame, width: int, height: int, cell: int = CELL) -> DataFrame:
    """``(camera_id, cx, cy, word, near)``: for each word of 64 pixels of a cell of a camera's frame and each label the pixels that some mask holds."""
    laid = _laid(_shapes(masks, width, height, False), width, height, cell)
    held = laid.groupBy(*CELLS, "scope").agg(F.bit_or("bits").alias("bits"))
    return once(held.groupBy(*CELLS).agg(F.collect_list(F.struct("scope", "bits")).alias("near")), "masks")


def centre(width: int, height: int) -> tuple[Column, Column]:
    """The centre of a box x1, y1, x2, y2 within the frame, in whole pixels."""
    mid = lambda a, b, most: F.greatest(F.lit(0), F.least(F.lit(most - 1), F.floor((F.col(a) + F.col(b)) / 2))).cast("int")
    return mid("x1", "x2", width), mid("y1", "y2", height)


def _located(detections: DataFrame, index: DataFrame, width: int, height: int, cell: int) -> DataFrame:
    """The detections with ``HELD``: what the index has at a detection's centre for its label or for all; null where there is nothing near.

    Names of its own keep clear of the detections' columns, so those that nobody asks for aren't worked out.
    """
    x, y = centre(width, height)
    down = lambda v, by: F.floor(v / by).cast("int")
    place = y % cell * cell + x % cell
    own = {n: f"_zones_{n}" for n in ("cx", "cy", "word", "near", "bit")}
    asked = detections.select(*_all(detections), *[v.alias(own[n]) for n, v in (("cx", down(x, cell)), ("cy", down(y, cell)), ("word", down(place, 64)), ("bit", place % 64))])
    met = asked.join(index.withColumnsRenamed(own), ["camera_id", *[own[n] for n in CELLS[1:]]], "left")
    holds = F.filter(own["near"], lambda e: (e["scope"].isNull() | (e["scope"] == F.col("label"))) & (F.getbit(e["bits"], F.col(own["bit"])) == 1))
    return met.select(*_all(detections), holds.alias(HELD))


def _all(rows: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in rows.columns]


def zoned(detections: DataFrame, polygons: DataFrame, width: int = SOURCE_W, height: int = SOURCE_H, cell: int = CELL) -> DataFrame:
    """GEO-10: detections within a zone for their label, with its ``zone_id`` and flags; one that names the label goes before one for all, then the order of the zones.

    Detections to which no zone of their camera applies pass, with nulls. Flags that a zone doesn't set are true.
    """
    shapes = once(_shapes(polygons, width, height, True), "zones")
    scopes = shapes.select("camera_id", F.explode("scopes").alias("scope")).groupBy("camera_id").agg(F.collect_set("scope").alias("_zones_named"), F.bool_or(F.isnull("scope")).alias("_zones_general"))
    met = _located(detections, _cells(shapes, width, height, cell), width, height, cell).join(once(scopes, "scopes"), "camera_id", "left")
    best = F.coalesce(F.get(F.filter(HELD, lambda e: e["scope"].isNotNull()), F.lit(0)), F.get(HELD, F.lit(0)))
    applies = F.coalesce(F.col("_zones_general") | F.array_contains("_zones_named", F.col("label")), "_zones_general", F.lit(False))
    met = met.withColumn("_zones_best", best).where(F.col("_zones_best").isNotNull() | ~applies)
    return met.select(*_all(detections), *[F.col("_zones_best")["zone"][f].alias(f) for f in ("zone_id", *FLAGS)])


def unmasked(detections: DataFrame, masks: DataFrame, width: int = SOURCE_W, height: int = SOURCE_H, cell: int = CELL) -> DataFrame:
    """JN-9, GEO-11: detections whose centre lies in no mask for all labels and in none that names theirs."""
    return _located(detections, mask_cells(masks, width, height, cell), width, height, cell).where(F.coalesce(F.size(HELD), F.lit(0)) == 0).drop(HELD)
