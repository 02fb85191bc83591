"""SimHash near-duplicates by pivot distance tables.

Whole texts become 64-bit fingerprints. Every *distinct* fingerprint carries its Hamming distances to ``N_PIVOTS`` reference
fingerprints. Two fingerprints at most two bits apart agree on two of four blocks of 16 bits, so fingerprints that share
two blocks form groups. A group is split by its pivot table: a distance is cut into steps of three, and a fingerprint goes to its own step and the
next one, of as many pivots as the group's size asks for; near fingerprints differ by two at most in every distance (the triangle inequality),
so they meet in some cell. Within a cell, fingerprints sorted by their distance to the first pivot are only compared while that differs by two or less;
a pair whose table entries differ by more than two anywhere is discarded, and survivors are verified on the fingerprints themselves.
All groups, of any size, go this way. A pair can meet in several groups and in several cells of each: it is a link only in the first group that both share and, there, in
the cell where neither or only one of the two stands a step above its own in every distance, so each link comes out once.

Nulls, empty and one- or two-word texts: null and wordless texts have fingerprint 0, shorter texts than three words hash
their whole word sequence. Rows without doc_id get a fingerprint, no component, and link nothing. Repeated rows share
a component. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_rows, materialise
from .components import connected_components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
HASH_SEED = 42
N_PIVOTS = 16
#: Bits in each pair of 16-bit blocks that a group shares: two differing bits leave at least two of four blocks alone.
GROUP_MASKS = tuple(sum(0xFFFF << 16 * i for i in pair) for pair in itertools.combinations(range(4), 2))
#: Fingerprints that a cell should hold; a group of more is split by its pivot distances, by more pivots the larger it is.
CELL_ROWS = 64
#: Pivots that split at most; each doubles the rows and leaves about ``_PIVOT_SHARE`` of unrelated pairs together.
SPLIT_PIVOTS, _PIVOT_SHARE = 8, 0.4
#: Hashes turned into bits at a time.
_CHUNK = 65536


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints, spread over the space by a hash of their number (signed 64-bit)."""
    return [int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % i)).astype(np.int64)) for i in range(n)]


def shingles(text: str | None, words: int) -> tuple[bytes, list[int], list[int]]:
    """The normalised text, and where its shingles start and end; a shorter text is one shingle, a wordless one has none."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    buf = b" ".join(found)
    if len(found) < words:
        return buf, [0] if found else [], [len(buf)] if found else []
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    return buf, (end - size)[: len(found) - words + 1].tolist(), end[words - 1 :].tolist()


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a whole text."""
    buf, starts, ends = shingles(text, SHINGLE_WORDS)
    if not starts:
        return 0
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        found = np.array([digest(buf[a:b], HASH_SEED) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)`` of every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(doc_id=(batch.column(0), pa.int64()), fp=([fingerprint(t) for t in batch.column(1).to_pylist()], pa.int64()))

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), one, "doc_id long, fp long")


def _links_of_cells(batches):
    """Links within each cell of rows sorted by cell and first pivot distance; holds no more than the rows whose distance is still within reach.

    A bit of ``up`` is set where the row's cell is a step above its own distance. Of the cells in which two rows meet, the one that counts has no bit set in both.
    """
    masks = np.array(GROUP_MASKS, np.uint64)
    left = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        fresh = 0 if left is None else left.num_rows  # rows before it have been compared with each other
        rows = rows if left is None else pa.concat_tables([left, rows])
        group, cell, fp, ident, block, up = (rows.column(k).to_numpy() for k in ("grp", "cell", "fp", "id", "block", "up"))
        table = np.asarray(rows.column("pivots").combine_chunks().flatten()).reshape(len(fp), -1).astype(np.int8)
        part = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])])
        first = table[:, 0]
        for k in range(1, len(fp)):
            a = np.arange(max(0, fresh - k), len(fp) - k)
            a = a[(part[a + k] == part[a]) & (first[a + k] - first[a] <= MAX_DISTANCE)]
            if not len(a):
                break
            a = a[up[a] & up[a + k] == 0]
            b = a + k
            near = np.abs(table[a] - table[b]).max(axis=1) <= MAX_DISTANCE
            a, b = a[near], b[near]
            differ = (fp[a] ^ fp[b]).view(np.uint64)
            near = np.bitwise_count(differ) <= MAX_DISTANCE
            a, b, differ = a[near], b[near], differ[near]
            here = (differ[:, None] & masks == 0).argmax(axis=1) == block[a]
            if here.any():
                yield batch_of(src=(ident[a[here]], pa.int64()), dst=(ident[b[here]], pa.int64()))
        left = rows.slice(int(np.argmax((part == part[-1]) & (first >= first[-1] - MAX_DISTANCE))))


def links(fps: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(src, dst)`` links between the ids of distinct fingerprints ``(fp, id)``, each once."""
    group = F.array(*[F.struct(F.lit(i).cast("byte").alias("block"), F.col("fp").bitwiseAND(F.lit(np.int64(np.uint64(m)).item())).alias("value")) for i, m in enumerate(GROUP_MASKS)])
    keys = fps.select("fp", "id", F.inline(group)).select("fp", "id", "block", F.xxhash64("block", "value").alias("grp"))  # groups whose hashes meet are only compared in vain
    shared = materialise(keys.join(keys.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "grp"), "simhash-shared")

    table = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()])
    splits = F.least(F.lit(SPLIT_PIVOTS), F.ceil(F.log(F.col("n") / F.lit(cell_rows)) / F.lit(-math.log(_PIVOT_SHARE)))).cast("int")
    steps = F.transform(F.slice("pivots", 2, F.greatest("splits", F.lit(0))), lambda d: F.floor(d / 3).cast("int"))
    placed = shared.withColumn("pivots", table).withColumn("splits", splits).withColumn("steps", steps)
    placed = placed.withColumn("c", F.explode(F.expr("sequence(0, shiftleft(1, size(steps)) - 1)")))
    cell = F.xxhash64(F.transform("steps", lambda q, i: q + F.call_function("shiftright", F.col("c"), i).bitwiseAND(F.lit(1))))
    placed = placed.select("grp", "block", cell.alias("cell"), F.col("c").cast("short").alias("up"), "fp", "id", "pivots")
    sorted_cells = placed.repartition("grp", "cell").sortWithinPartitions("grp", "cell", F.col("pivots")[0])
    return sorted_cells.mapInArrow(_links_of_cells, "src long, dst long")


def row_links(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(src, dst)`` links of the doc_ids of near-duplicates: each to the least of its fingerprint, and those to each other."""
    each = materialise(fingerprints(docs).where("doc_id is not null"), "simhash-docs")
    fps = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    same = each.join(fps, "fp").where("doc_id <> id").select(F.col("id").alias("src"), F.col("doc_id").alias("dst"))
    return same.unionByName(links(fps, cell_rows))


def near_duplicates(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row; component_id is the smallest doc_id reachable by links."""
    each = materialise(fingerprints(docs), "simhash-docs")
    fps = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-distinct")
    found = connected_components(links(fps.where("id is not null"), cell_rows))
    of = fps.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    return each.join(of, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
