"""Bloom filters as arrays of longs, built and read by DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Bits a key, hashes and most bits (1 MB) of a filter that only spares a shuffle.
BITS_PER_KEY, HASHES, MAX_BITS = 10, 4, 1 << 23


def positions(key: Column, nth: int, bits: int, hashes: int) -> list[Column]:
    """The bits of a key in the nth filter."""
    return [F.pmod(F.xxhash64(key, F.lit(nth), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def words(keys: DataFrame, nth: int, bits: int, hashes: int, shards: int = 1) -> DataFrame:
    """The filters (shard, words) of rows (shard, key): for each shard an array of longs of 64 bits each."""
    at = keys.select("shard", F.explode(F.array(*positions(F.col("key"), nth, bits, hashes))).alias("p"))
    cells = at.groupBy("shard", F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    place = F.col("shard") * (bits // 64) + F.col("word")
    every = keys.sparkSession.range(shards * (bits // 64)).join(cells.select(place.alias("id"), "bits"), "id", "left")
    shard, word = F.floor(F.col("id") / (bits // 64)).alias("shard"), (F.col("id") % (bits // 64)).alias("word")
    cells = every.select(shard, F.struct(word, F.coalesce("bits", F.lit(0)).alias("bits")).alias("cell")).groupBy("shard").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    return cells.select("shard", F.transform("cells", lambda x: x["bits"]).alias("words"))


def passes(key: Column, words: Column, nth: int, bits: int, hashes: int) -> Column:
    """Whether all bits of a key are set."""
    hit = F.lit(True)
    for p in positions(key, nth, bits, hashes):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        hit = hit & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63).cast("long")).cast("int"))) != 0)
    return hit


def prefilter(keys: DataFrame, tag: str) -> Callable[[Column], Column]:
    """A condition that all ``keys`` (one column) meet and few others: it spares rows the shuffle of the join that decides.

    The filter has ``MAX_BITS`` at most. With more keys than that serves it lets more through, up to everything, and the join still decides.
    """
    bits = max(64, min(MAX_BITS, 1 << (keys.count() * BITS_PER_KEY).bit_length()))
    found = materialise(words(keys.toDF("key").withColumn("shard", F.lit(0)), 0, bits, HASHES), tag)
    return lambda key: passes(key, found.select("words").scalar(), 0, bits, HASHES)
