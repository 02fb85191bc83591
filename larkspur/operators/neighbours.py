"""JN-13, GEO-16: nearest hashes within a threshold, for registries of any size.

Multi-index hashing: a 64-bit hash is cut into equal bands. Two hashes that differ in at most ``most`` bits differ in at most ``most // bands`` of some band (pigeonhole), so
a registry hash is filed under every value within that radius of each of its bands, and a row looks up its bands by equality. Candidates are verified on the whole hashes; nothing within the threshold is lost.
Only distinct hashes meet, so many equal rows, or many profiles of one hash, cost what one does.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import geo

BITS = 64


def _band(value: Column, i: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", value, F.lit(i * width)).bitwiseAND(F.lit((1 << width) - 1))


def near_masks(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits with at most ``radius`` of them set."""
    return [sum(1 << b for b in some) for r in range(radius + 1) for some in itertools.combinations(range(width), r)]


def nearest_hash(rows: DataFrame, registry: DataFrame, most: int = 10, bands: int = 4) -> DataFrame:
    """Rows with a column ``hash`` that have a registry hash (profile, of) within ``most`` bits, with the nearest one's profile and distance; of equally near ones the least profile.

    Rows and entries without hash have none near.
    """
    width = BITS // bands
    profiles = registry.where("of is not null").groupBy("of").agg(F.min("profile").alias("profile"))
    masks = F.array(*[F.lit(m).cast("long") for m in near_masks(width, most // bands)])
    filed = profiles.select("of", "profile", F.posexplode(F.array(*[_band(F.col("of"), i, width) for i in range(bands)])).alias("band", "value"))
    filed = filed.select("of", "profile", "band", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    asked = rows.where("hash is not null").select("hash").distinct().select("hash", F.posexplode(F.array(*[_band(F.col("hash"), i, width) for i in range(bands)])).alias("band", "value"))
    distance = geo.hamming(F.col("hash"), F.col("of"))
    met = asked.join(filed, ["band", "value"]).withColumn("distance", distance).where(F.col("distance") <= most)
    best = met.groupBy("hash").agg(F.min(F.struct("distance", "profile")).alias("best"))
    return rows.join(best, "hash").select(*rows.columns, "best.profile", "best.distance")
