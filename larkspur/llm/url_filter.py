"""URL filters: host and path rules, then exact list membership by a Bloom filter cascade.

The cascade is built over the corpus's complete key universe (every host that occurs, without user info, port and trailing dot; it is listed if
it or a parent domain is in the list). Level 1 encodes the listed keys; the unlisted keys it lets through are level 2's; the listed keys that pass
level 2 are level 3's; and so on until a level lets nothing through. A key of the universe is then judged exactly by the first level that it misses,
with no join on keys. Level 1 is sized by both counts, so that it lets through about as many unlisted keys as are listed; the levels
after it, with ``BITS_PER_KEY``, shrink from there. So all levels together grow with the listed keys, and with the logarithm of the universe.

Keys are dealt into shards by a hash, so that no shard's level has more than ``SHARD_BITS``: one shard serves some million listed hosts, and its
filters are read through scalar subqueries. Beyond, rows look their shard's filters up by the shard's number; the cascade stays the same.
A level that would still be larger raises an error. Everything is DataFrame functions.

Null URLs and URLs without ``://`` have empty host and path; they fit no rule and no list. Repeated rows and null page_ids keep
their own rows, empty tables give an empty result, an empty list blocks nothing, other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import materialise

BITS_PER_KEY = 10
#: Bits of a level in one shard: 8 MB.
SHARD_BITS = 1 << 26
MAX_LEVELS = 64
Rule = tuple[str, str, str]  # verdict, host, path

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.substr(url, F.instr(url, "://") + F.lit(3)), "^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, _UPPER, _UPPER.lower())).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(F.substr(url, F.instr(url, "://") + F.lit(3)), "^[^/?#]*([^?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, path).otherwise(F.lit(""))


def key_of(host: Column) -> Column:
    """The host as lists name it: without user info, port and trailing dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")


def domains(host: Column) -> Column:
    """The host and its parent domains of two labels or more (the host itself also if it is one label)."""
    labels = F.split(host, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


@dataclass(frozen=True)
class Level:
    """One filter: a row (shard, words) for each shard, of so many bits and hashes."""

    words: DataFrame
    bits: int
    hashes: int


@dataclass(frozen=True)
class Cascade:
    levels: list[Level]
    shards: int


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards).cast("long"))


def _with_words(rows: DataFrame, level: Level, name: str, shards: int) -> tuple[DataFrame, Column]:
    """The rows, and the column that holds their shard's filter of a level."""
    if shards == 1:
        return rows, level.words.select("words").scalar()
    return rows.join(level.words.withColumnRenamed("words", name), "shard"), F.col(name)


def cascade(universe: DataFrame, shard_bits: int = SHARD_BITS) -> Cascade:
    """The levels for a universe of distinct (key, listed) rows."""
    sizes = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    n, others = sizes.get(True, 0), sizes.get(False, 0)
    if not n:
        return Cascade([], 1)
    # 1.44 bits a key for each halving of the false positives, down to about n of them.
    first = math.ceil(math.log2(max(2, others / n)) / math.log(2))
    shards = -(-2 * n * first // shard_bits)
    universe = universe.select("key", "listed", _shard(F.col("key"), shards).alias("shard"))
    inside, outside = (universe.where(F.col("listed") == x).select("key", "shard") for x in (True, False))
    levels: list[Level] = []
    while most := inside.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade doesn't end; the universe's keys aren't distinct")
        per_key = BITS_PER_KEY if levels else first
        bits = max(64, 1 << (most * per_key - 1).bit_length())
        if bits > max(64, 2 * shard_bits):
            raise RuntimeError(f"level {len(levels) + 1} would need {bits} bits in one shard")
        hashes = max(1, round(per_key * math.log(2)))
        words = materialise(bloom.words(inside, len(levels), bits, hashes, shards), "cascade-filter")
        level = Level(words, bits, hashes)
        rows, column = _with_words(outside, level, "words", shards)
        through = materialise(rows.where(bloom.passes(F.col("key"), column, len(levels), bits, hashes)).select("key", "shard"), "cascade-through")
        levels.append(level)
        inside, outside = through, inside
    return Cascade(levels, shards)


def with_membership(rows: DataFrame, key: str, found: Cascade, name: str) -> DataFrame:
    """The rows and a column ``name``: whether their key, one of the universe, is listed; decided by the first level that it misses."""
    columns, verdict = rows.columns, F.lit(len(found.levels) % 2 == 1)
    rows = rows.withColumn("shard", _shard(F.col(key), found.shards))
    words = []
    for k, level in enumerate(found.levels):
        rows, column = _with_words(rows, level, f"words_{k}", found.shards)
        words.append(column)
    for k in reversed(range(len(found.levels))):
        verdict = F.when(~bloom.passes(F.col(key), words[k], k, found.levels[k].bits, found.levels[k].hashes), F.lit(k % 2 == 1)).otherwise(verdict)
    return rows.select(*columns, verdict.alias(name))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(of + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, shard_bits: int = SHARD_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict of every row; ``listed`` has a column key of hosts and domains to block."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).withColumn("key", key_of(F.col("host")))
    # A key of the universe is a whole host; it is listed if it or a parent domain is.
    hosts = rows.select("key").distinct()
    names = hosts.select("key", F.explode(domains(F.col("key"))).alias("domain"))
    bad = names.join(listed.select(key_of(F.translate(F.col("key").cast("string"), _UPPER, _UPPER.lower())).alias("domain")), "domain", "left_semi").select("key")
    flagged = hosts.withColumn("listed", F.lit(False)).unionByName(bad.withColumn("listed", F.lit(True)))
    universe = materialise(flagged.groupBy("key").agg(F.bool_or("listed").alias("listed")), "url-universe")
    rows = with_membership(rows, "key", cascade(universe, shard_bits), "hit")
    method = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), method).alias("verdict"))
