"""Boxes, polygons and hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURVE_SAMPLES = 12


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """GEO-1: overlap over union; 0 without overlap."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = F.when((w > 0) & (h > 0), (w * h).cast("double")).otherwise(0.0)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def centroid_distance(a: Column, b: Column) -> Column:
    """GEO-2."""
    dx = (a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2
    dy = (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2
    return F.sqrt(dx * dx + dy * dy)


def area_share(b: Column, width: Column, height: Column) -> Column:
    """GEO-3: share of the frame, 5 digits; null if not positive."""
    share = area(b) / (width * height)
    return F.when(share > 0, F.round(share, 5))


def tiles(width: int, height: int, nx: int, ny: int, overlap: float = 0.15) -> list[tuple[int, int, int, int]]:
    """GEO-7: a grid of tiles, each widened by the overlap and clipped to the frame."""
    w, h = width / nx, height / ny
    ox, oy = int(w * overlap), int(h * overlap)
    return [(max(0, int(i * w) - ox), max(0, int(j * h) - oy), min(width, int((i + 1) * w) + ox), min(height, int((j + 1) * h) + oy)) for j in range(ny) for i in range(nx)]


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """GEO-8: point in polygon, the boundary included; ``points`` is an array of (x, y) structs of three or more."""
    n = F.size(points)
    edges = F.transform(points, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.get(points, (i + 1) % n)["x"].alias("bx"), F.get(points, (i + 1) % n)["y"].alias("by")))
    cross = lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    on_edge = F.exists(edges, lambda e: (cross(e) == 0) & x.between(F.least(e["ax"], e["bx"]), F.greatest(e["ax"], e["bx"])) & y.between(F.least(e["ay"], e["by"]), F.greatest(e["ay"], e["by"])))
    crossed = F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (F.when(e["by"] > e["ay"], cross(e) > 0).otherwise(cross(e) < 0)))
    return (n >= 3) & (on_edge | (F.size(crossed) % 2 == 1))


def flatten_curve(a: Column, control: Column, b: Column, samples: int = CURVE_SAMPLES) -> Column:
    """GEO-9: points of a quadratic curve after ``a`` up to and with ``b``, truncated to whole numbers."""
    steps = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: i / samples)
    at = lambda t, k: ((1 - t) * (1 - t) * a[k] + 2 * (1 - t) * t * control[k] + t * t * b[k]).cast("int")
    return F.transform(steps, lambda t: F.struct(at(t, "x").alias("x"), at(t, "y").alias("y")))


def hamming(a: Column, b: Column) -> Column:
    """GEO-15: differing bits of two 64-bit hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """GEO-15: differing bits of two hashes in 16 hex digits."""
    halves = [(F.conv(F.substring(a, at, 8), 16, 10).cast("long"), F.conv(F.substring(b, at, 8), 16, 10).cast("long")) for at in (1, 9)]
    return F.bit_count(halves[0][0].bitwiseXOR(halves[0][1])) + F.bit_count(halves[1][0].bitwiseXOR(halves[1][1]))


def nms(boxes: Column, threshold: float, inclusive: bool = False) -> Column:
    """GEO-4/5: greedy suppression per label over an array of (label, score, x1, y1, x2, y2) sorted by falling score."""
    hit = (lambda v: v >= threshold) if inclusive else (lambda v: v > threshold)
    empty = F.slice(boxes, 1, 0)
    return F.aggregate(boxes, empty, lambda kept, b: F.when(F.exists(kept, lambda k: (k["label"] == b["label"]) & hit(iou(k, b))), kept).otherwise(F.concat(kept, F.array(b))))


def drop_overlapped(boxes: Column, reference: Column, threshold: float = 0.3) -> Column:
    """GEO-6: without the boxes that overlap the reference box by the threshold or more."""
    return F.filter(boxes, lambda b: iou(b, reference) < threshold)
