"""Pairs of texts whose sets of word shingles have a Jaccard similarity of at least 4/5, found exactly.

In any one order of all shingles, two such sets share one among the first ``n - ceil(4n/5) + 1`` of each. The order puts frequent
shingles last (as far as a sample knows them; any order is exact), so few sets meet. Sets that meet at a shingle are not paired up. First every one
of them is compared with one of them, the *hub*, that with the least id, so that a group of near copies has the same hub at most of its shingles.
Then only sets that share a shingle but are in different components so far are compared, those outside of the shingle's largest
component with all others. A group of near copies so costs one comparison a member; sets of one component need no further links. Where many sets
of a shingle are outside of its largest component, as heavily changed copies of one text are, only those are compared whose *changes* have
something in common (see ``_by_changes``), unless their sizes leave fewer pairs than the sets hold shingles, as with texts that quote one passage (see ``_families``). A
sample knows the fewer of the shingles that many sets share the larger the input is; those that crowd the prefixes for that reason are put last too (see ``_settled``). All steps drop pairs whose sizes and places in the order, or whose first shingles as a whole, exclude the similarity. Survivors are compared on their whole texts.

Texts are split as for fingerprints; a text of fewer words than a shingle is one shingle, and wordless texts link nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloom import prefilter
from .common import SLICE_ROWS, batch_of, map_rows, materialise
from .components import connected_components

SHINGLE_WORDS = 5
#: Documents that are sampled for frequent shingles, how often those occur there, and how many are kept.
SAMPLE_DOCS, SAMPLE_COUNT, SAMPLE_KEPT = 20_000, 3, 200_000
#: Sets of a shingle that all its others are compared with first.
HUBS = 16
#: Sets outside of a shingle's largest component that are all compared with its others; more go by their changes,
OUTSIDERS = 32
#: if their family has more pairs of about one size than so many for every ``UNFOLDED`` shingles that its sets hold: to unfold those costs about as much.
PAIRS_EACH, UNFOLDED = 8, 8
#: Prefixes that may hold a shingle the sample doesn't know, the sets of which one is counted for it, and how often the order is mended.
CROWD, COUNTED, ROUNDS = 128, 4, 3
#: Documents of a block, when pairs are verified.
BLOCK = 256
#: Words remembered by a Python worker before it forgets them all.
VOCABULARY = 100_000
_MIX = [np.uint64(xxhash.xxh64_intdigest(b"shingle word %d" % i) | 1) for i in range(64)]


class _Hashes(dict):
    """word -> its hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = _Hashes()


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct shingle hashes of a whole text, ascending (signed 64-bit)."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not found:
        return np.zeros(0, np.int64)
    of = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    wide = min(words, len(found))
    total = np.full(len(of) - wide + 1, wide, np.uint64)
    for j in range(wide):
        total += of[j : j + len(total)] * _MIX[j]
    total ^= total >> np.uint64(29)
    return np.unique((total * _MIX[-1]).view(np.int64))


def alike(common, n, m):
    """Whether sets of n and m shingles, of them ``common`` shared, have a similarity of at least 4/5."""
    return 9 * common >= 4 * (n + m)


def _frequent(rows: DataFrame, words: int) -> np.ndarray:
    """Rows (shingle, count) of a sample's frequent shingles, by shingle; counts are carried on to all texts."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(shingles=([shingle_set(t, words) for t in batch.column(0).to_pylist()], pa.list_(pa.int64())))

    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20))).select("text")
    seen = map_rows(some, one, "shingles array<long>").select(F.explode("shingles").alias("s"))
    often = seen.groupBy("s").count().where(F.col("count") >= SAMPLE_COUNT).orderBy(F.desc("count"), "s").limit(SAMPLE_KEPT).collect()
    return np.array(sorted((r["s"], int(r["count"] / share)) for r in often), np.int64).reshape(-1, 2)


def _prefixes(rows: DataFrame, words: int, known: np.ndarray) -> DataFrame:
    """``(id, digest, n, prefix)`` of the texts with words: a digest of the whole set, its size, its first shingles in the common order, that with ``known`` ones (shingle, count) last."""

    def first(s: np.ndarray) -> np.ndarray:
        many = len(s) - -(-4 * len(s) // 5) + 1 if len(s) else 0
        if not len(known):
            return s[:many]
        at = np.minimum(np.searchsorted(known[:, 0], s), len(known) - 1)
        return s[np.argsort(np.where(known[at, 0] == s, known[at, 1], 0), kind="stable")[:many]]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(t, words) for t in batch.column(1).to_pylist()]
        digest = [xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63 for x in found]
        return batch_of(id=(batch.column(0), pa.int64()), digest=(digest, pa.int64()), n=(list(map(len, found)), pa.int32()), prefix=(list(map(first, found)), pa.list_(pa.int64())))

    return map_rows(rows, one, "id long, digest long, n int, prefix array<long>").where("n > 0")


def _settled(each: DataFrame, copies: DataFrame, rows: DataFrame, words: int, known: np.ndarray) -> DataFrame:
    """The prefixes ``each`` in an order that has also those shingles last that more than about ``CROWD`` prefixes hold and ``known`` lacks.

    A shingle only moves back, so the prefixes that don't hold one stay as they are; the others are made anew, from as many texts. What still crowds prefixes after the last round,
    or is more than ``SAMPLE_KEPT`` shingles, is compared like all else.
    """
    for _ in range(ROUNDS):
        keys = each.join(copies.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.explode("prefix").alias("shingle"))
        some = keys.where(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0)
        counts = some.groupBy("shingle").agg((F.count("*") * COUNTED).alias("sets")).where(F.col("sets") > CROWD)
        unknown = lambda batch, known=known[:, 0]: batch.filter(pa.array(~np.isin(batch.column(0).to_numpy(), known)))
        crowding = materialise(map_rows(counts, unknown, "shingle long, sets long").orderBy(F.desc("sets"), "shingle").limit(SAMPLE_KEPT), "similar-crowding")
        late = np.array([(r["shingle"], r["sets"]) for r in crowding.collect()], np.int64).reshape(-1, 2)
        if not len(late):
            break
        known = np.concatenate([known, late])
        known = known[np.argsort(known[:, 0])]
        crowding = crowding.select("shingle")
        ids = keys.where(prefilter(crowding, "similar-crowding-filter")(F.col("shingle"))).join(crowding, "shingle", "left_semi").select("id").distinct()
        anew = prefilter(materialise(ids, "similar-anew-ids"), "similar-anew-filter")(F.col("id"))  # what else it lets through gets the prefix it has
        each = materialise(each.where(~anew).unionByName(_prefixes(rows.where(anew), words, known)), "similar-settled")
    return each


def _compared(words: int):
    """Pairs that are alike, from rows (one, two, a, b, text) sorted by cell, texts (id in a) before the pairs of their cell; holds one cell's sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets = None, {}
        for rows in (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS)):
            found = []
            for one, two, a, b, text in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if cell != (one, two):
                    cell, sets = (one, two), {}
                if b is None:
                    sets[a] = shingle_set(text, words)
                elif alike(len(np.intersect1d(sets[a], sets[b], assume_unique=True)), len(sets[a]), len(sets[b])):
                    found.append((a, b))
            if found:
                yield batch_of(a=([x for x, _ in found], pa.int64()), b=([x for _, x in found], pa.int64()))

    return run


def _of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose id is in a pair."""
    ids = materialise(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "similar-ids")
    return rows.where(prefilter(ids, "similar-ids-filter")(F.col("id"))).join(ids, "id", "left_semi")


def _verified(pairs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts are alike.

    Documents are dealt into blocks by a hash, and the pairs of two blocks are compared in one place. So a text goes there once for
    all its pairs there: a document with many pairs travels to as many places as there are blocks, not pairs.
    """
    texts = materialise(_of_pairs(rows, pairs), "similar-texts")
    blocks = max(1, -(-texts.count() // BLOCK))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    cells = pairs.select(F.least(block("a"), block("b")).alias("one"), F.greatest(block("a"), block("b")).alias("two"), "a", "b")
    need = cells.select("one", "two", F.explode(F.array("a", "b")).alias("a")).distinct().join(texts.withColumnRenamed("id", "a"), "a")
    every = need.select("one", "two", "a", F.lit(None).cast("long").alias("b"), "text").unionByName(cells.withColumn("text", F.lit(None).cast("string")))
    return every.repartition("one", "two").sortWithinPartitions("one", "two", F.col("b").asc_nulls_first()).mapInArrow(_compared(words), "a long, b long")


def _possible(x: str, y: str):
    """Whether a shingle at places x.at and y.at can be the first that the sets share in the order, and they be alike."""
    return alike(F.least(F.col(f"{x}.n") - F.col(f"{x}.at"), F.col(f"{y}.n") - F.col(f"{y}.at")), F.col(f"{x}.n"), F.col(f"{y}.n"))


def _promising(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """The pairs (a, b) whose first shingles agree well enough: what lies behind both prefixes can add no more than the longer rest."""
    each = _of_pairs(each.select("id", "n", "prefix"), pairs)
    for k in "ab":
        pairs = pairs.join(each.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("prefix").alias(f"prefix_{k}")), k)
    rest = F.greatest(F.col("n_a") - F.size("prefix_a"), F.col("n_b") - F.size("prefix_b"))
    return pairs.where(alike(F.size(F.array_intersect("prefix_a", "prefix_b")) + rest, F.col("n_a"), F.col("n_b"))).select("a", "b")


def _families(crowd: DataFrame) -> DataFrame:
    """The families (largest) of the sets (shingle, id, n, component, largest) of crowded shingles that leave more pairs by their sizes than shingles to unfold.

    So the rows that a family makes, of pairs or of shingles, are no more than its sets hold shingles.
    """
    size = F.floor(F.log("n") / F.lit(math.log(1.25))).alias("size")
    sizes = crowd.groupBy("largest", "shingle", size).agg(F.count("*").alias("k"), F.count_if(F.col("component") != F.col("largest")).alias("outside"))
    pairs = sizes.groupBy("largest").agg(F.sum(F.col("k") * F.col("outside")).alias("pairs"))
    held = crowd.select("largest", "id", "n").distinct().groupBy("largest").agg(F.sum("n").alias("held"))
    return pairs.join(held, "largest").where(F.lit(UNFOLDED) * F.col("pairs") > F.lit(PAIRS_EACH) * F.col("held")).select("largest")


def _by_changes(crowd: DataFrame, rows: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """Links (src, dst), and all other pairs (a, b) that can be alike, of the sets (shingle, id, component, largest) of crowded shingles.

    Shingles with the same largest component are one family. Its *centre* is what more than half of its sets hold, and a set's changes are the shingles
    that only it or only the centre holds. Sets of n and m shingles with d and e changes, o of them in common, differ in ``d + e - 2o``, so they are alike if
    ``18 o >= (9d - n) + (9e - m)``. With the family's best set, the largest ``n - 9d``, all sets are linked that need nothing in common for it; so
    are any two such sets then. Other pairs share a change, in an order with frequent changes last at places that leave enough behind them: of two sets the one with fewer changes has it among its first
    ``n / 8``. The changes that copies of a text share by chance are the frequent ones, what they lack of it, so few copies meet. All counts come from one count of the
    shingles that two sets of a family hold; changes of one set alone, most of all where sets have little more than a passage in common, come first in the order and go nowhere.
    """
    members = materialise(crowd.select(F.col("largest").alias("family"), "id", "component").distinct(), "similar-members")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(id=(batch.column(0), pa.int64()), shingles=([shingle_set(t, words) for t in batch.column(1).to_pylist()], pa.list_(pa.int64())))

    ids = materialise(members.select("id").distinct(), "similar-member-ids")
    texts = rows.where(prefilter(ids, "similar-members-filter")(F.col("id"))).join(ids, "id", "left_semi")
    sets = materialise(members.join(map_rows(texts.select("id", "text"), one, "id long, shingles array<long>"), "id"), "similar-sets")
    many = sets.groupBy("family").agg(F.count("*").alias("many"))
    held = sets.select("family", F.explode("shingles").alias("s")).groupBy("family", "s").agg(F.count("*").alias("k")).where("k > 1")
    held = materialise(held.join(many, "family").withColumn("central", F.expr("2 * k > many")), "similar-held")
    centre = materialise(held.where("central").groupBy("family").agg(F.collect_list("s").alias("centre")), "similar-centre")
    of = sets.join(centre, "family", "left").withColumn("centre", F.coalesce("centre", F.array().cast("array<long>")))
    changes = F.concat(F.array_except("shingles", "centre"), F.array_except("centre", "shingles"))
    changed = of.select("family", "id", "component", F.size("shingles").alias("n"), changes.alias("changes")).withColumn("d", F.size("changes")).withColumn("slack", F.expr("n - 9 * d"))
    changed = materialise(changed, "similar-changed")

    best = changed.groupBy("family").agg(F.max(F.struct("slack", "id")).alias("best"))
    changed = changed.join(best, "family").withColumn("near", F.expr("slack + best.slack >= 0"))
    links = changed.where("near and id <> best.id").select(F.col("best.id").alias("src"), F.col("id").alias("dst"))
    common = materialise(held.select("family", F.col("s").alias("change"), F.expr("case when central then many - k else k end").alias("often")).where("often > 1"), "similar-common")
    each = changed.withColumn("change", F.explode("changes")).drop("changes")
    each = each.where(prefilter(common.select("change"), "similar-common-filter")(F.col("change"))).join(common, ["family", "change"])
    of_set = Window.partitionBy("family", "id")
    each = each.withColumn("at", F.col("d") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("often", "change")) - 1)
    # What a set has in common with any that it isn't linked with: at least one, no less than its changes beyond n / 4, and for a set near the best more than what tells the two apart.
    least = F.greatest(F.lit(1), F.expr("d - floor(n / 4)"), F.expr("case when near then floor((best.slack - slack) / 18) + 1 end"))
    each = materialise(each.where(F.col("at") <= F.col("d") - least).drop("best"), "similar-changes")
    x, y = each.alias("x"), each.where("8 * at <= n").alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ~(F.col("x.near") & F.col("y.near")) & (F.struct("y.d", "y.id") < F.struct("x.d", "x.id"))
    enough = F.lit(18) * F.least(F.col("x.d") - F.col("x.at"), F.col("y.d") - F.col("y.at")) >= -F.col("x.slack") - F.col("y.slack")
    pairs = x.join(y, (F.col("x.family") == F.col("y.family")) & (F.col("x.change") == F.col("y.change"))).where(apart & enough)
    return links, pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def components(rows: DataFrame, known: DataFrame | None = None, words: int = SHINGLE_WORDS) -> DataFrame:
    """``(id, component)`` of rows (id, text), one row an id, that are linked to others: by a similarity of 4/5 or more, or by ``known`` links (src, dst)."""
    frequent = _frequent(rows, words)
    each = materialise(_prefixes(rows, words, frequent), "similar-prefixes")
    copied = each.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    copies = materialise(each.select("id", "digest").join(copied, "digest").where("id <> least").select(F.col("least").alias("src"), F.col("id").alias("dst")), "similar-copies")
    each = _settled(each, copies, rows, words, frequent)
    keys = each.join(copies.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "n", F.posexplode("prefix").alias("at", "shingle"))

    met = materialise(keys.groupBy("shingle").count().where("count > 1").select("shingle"), "similar-met")
    known_shared = prefilter(met, "similar-met-filter")
    shared = materialise(keys.where(known_shared(F.col("shingle"))).join(met, "shingle", "left_semi"), "similar-shared")
    hubs = shared.withColumn("nth", F.row_number().over(Window.partitionBy("shingle").orderBy("id"))).where(F.col("nth") <= HUBS)
    star = hubs.alias("x").join(shared.alias("y"), "shingle").where(F.col("x.id") < F.col("y.id")).where(_possible("x", "y"))
    star = materialise(star.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "similar-star")
    near = materialise(_verified(materialise(_promising(star, each), "similar-promising"), rows, words).select(F.col("a").alias("src"), F.col("b").alias("dst")), "similar-near")

    links = near.unionByName(copies)
    found = connected_components(links.unionByName(known) if known is not None else links)
    placed = shared.join(found, "id", "left").select("shingle", "id", "n", "at", F.coalesce("component", "id").alias("component"))
    parts = placed.groupBy("shingle", "component").agg(F.count("*").alias("k"))
    largest = parts.groupBy("shingle").agg(F.count("*").alias("parts"), F.sum("k").alias("k"), F.max(F.struct("k", "component")).alias("largest")).where("parts > 1")
    largest = largest.select("shingle", F.col("largest.component").alias("largest"), (F.col("k") - F.col("largest.k") > OUTSIDERS).alias("crowded"))
    open_ = materialise(placed.join(largest, "shingle"), "similar-open")
    crowd = open_.where("crowded")
    families = materialise(_families(crowd), "similar-families")
    direct = open_.where("not crowded").unionByName(crowd.join(families, "largest", "left_anti").select(*open_.columns))
    x, y = direct.where("component <> largest").alias("x"), direct.alias("y")
    apart = (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id")))
    pairs = x.join(y, F.col("x.shingle") == F.col("y.shingle")).where(apart).where(_possible("x", "y"))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    close = None
    if not families.isEmpty():
        close, others = _by_changes(crowd.join(families, "largest", "left_semi"), rows, words)
        pairs = pairs.unionByName(others)
    pairs = materialise(_promising(materialise(pairs.distinct().join(star, ["a", "b"], "left_anti"), "similar-untried"), each), "similar-pairs")
    if pairs.isEmpty() and close is None:
        return found
    more = _verified(pairs, rows, words).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    more = more if close is None else more.unionByName(close)
    return connected_components(more.unionByName(found.select(F.col("component").alias("src"), F.col("id").alias("dst"))))
