"""Best-fit packing of token pieces into sequences of a fixed capacity, with large-item matching.

Lengths are whole numbers up to the capacity, so the packing is planned on their *histogram* (at most ``capacity``
counters, whatever the corpus): lengths above a third of the capacity are paired greedily, longest first, each with the
longest partner that still fits (three never fit); shorter ones then go, longest first, into the tightest gap left, and
new sequences open only when no gap is wide enough. The plan says where the r-th piece of each length goes; Spark ranks the
pieces within their length (counts per task, then a sum over tasks) and looks each up. No sequence, bin or document ever
meets others in one task.

Null and empty texts are one piece holding the end id alone. Texts of any length are cut, never truncated. Repeated rows are
packed as often as they come, and equal lengths in the order of tasks and rows. Null doc_ids stay null. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, batch_of, materialise

CAPACITY = 2048
END_ID = 0
#: Runs of this many characters without (or of) space go to the tokenizer whose merging isn't quadratic in a run.
LONG_RUN = 500
_RANK_BITS = 44


@functools.lru_cache(maxsize=1)
def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """text -> ids of the byte-level BPE in ``json_path``.

    With ``ranks_path`` (the same vocabulary as merge ranks) ordinary texts take tiktoken, which gives the same
    ids in a third of the time. Texts that hold an added token of the vocabulary, which tiktoken would spell out, take
    ``tokenizers``, and so do texts with very long runs, on which tiktoken's merging takes quadratic time.
    """
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(json_path)
    added = [t.content for t in exact.get_added_tokens_decoder().values()]

    def slow(text: str) -> list[int]:
        return exact.encode(text, add_special_tokens=False).ids

    if not ranks_path:
        return slow
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            return slow(text)
        words = text.split()
        size = sum(map(len, words))
        if len(text) - size - len(words) > LONG_RUN or max(map(len, words), default=0) > LONG_RUN:
            return slow(text)
        return fast.encode_ordinary(text)

    return encode


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole if it fits, else full pieces after a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenised pieces, each with its task and its number among the task's pieces of that length."""

    def run(batches):
        encode, seen, part = encoder(json_path, ranks_path, pattern), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "local", "ids")}
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), END_ID], "<u4")
                    for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                        part_ids = ids[start : start + length]
                        for k, v in zip(out, (doc_id, piece, start, length, zlib.crc32(part_ids.tobytes()), int(seen[length]), part_ids if with_ids else None), strict=True):
                            out[k].append(v)
                        seen[length] += 1
                yield batch_of(
                    doc_id=(out["doc_id"], pa.int64()), piece=(out["piece"], pa.int32()), start=(out["start"], pa.int64()), length=(out["length"], pa.int64()),
                    ids_crc32=(out["ids_crc32"], pa.int64()), part=([part] * len(out["piece"]), pa.int32()), local=(out["local"], pa.int64()), **({"ids": (out["ids"], pa.list_(pa.int64()))} if with_ids else {}),
                )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Entries (length, first rank, end rank, first sequence, pieces in each, offset) and the number of sequences.

    The r-th piece of a length in an entry is the i-th (i = r - first rank) of it: sequence first + i // each, offset
    + i % each * length. The entries follow from the lengths that occur; their number is bounded by the capacity.
    """
    left, used = dict(counts), dict.fromkeys(counts, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    entries, total = [], 0

    def take(length: int, n: int, sequence: int, each: int, offset: int) -> None:
        entries.append((length, used[length], used[length] + n, sequence, each, offset))
        used[length] += n
        left[length] -= n

    large = sorted((x for x in counts if 3 * x > capacity), reverse=True)
    for length in large:
        while left[length]:
            mate = next((x for x in large if x <= capacity - length and x <= length and left[x] and (x < length or left[x] > 1)), None)
            if mate == length:
                n = left[length] // 2
                take(length, 2 * n, total, 2, 0)
            elif mate:
                n = min(left[length], left[mate])
                take(length, n, total, 1, 0)
                take(mate, n, total, 1, length)
            else:
                n = left[length]
                take(length, n, total, 1, 0)
            gaps.setdefault(capacity - length - (mate or 0), []).append((total, n))
            total += n

    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[length]:
            gap = min((g for g, bins in gaps.items() if bins and g >= length), default=0)
            if not gap:
                gap, opened = capacity, -(-left[length] // (capacity // length))
                gaps.setdefault(capacity, []).append((total, opened))
                total += opened
            first, n = gaps[gap].pop()
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                take(length, full * each, first, each, capacity - gap)
                gaps.setdefault(gap - each * length, []).append((first, full))
            if full < n and (rest := left[length]):
                some = min(rest, each)
                take(length, some, first + full, some, capacity - gap)
                gaps.setdefault(gap - some * length, []).append((first + full, 1))
                full += 1
            if full < n:
                gaps[gap].append((first + full, n - full))
    return entries, total


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    cut = materialise(pieces(docs, json_path, ranks_path, pattern, capacity, with_ids), "packing-pieces")
    each = materialise(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    entries, _ = plan({r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    entries.sort()
    table = np.array(entries, np.int64).reshape(-1, 6)
    keys = (table[:, 0] << _RANK_BITS) + table[:, 1]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "rank"))
            _, first, _, sequence, per, offset = table[np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1].T
            found = {"sequence_id": sequence + (rank - first) // per, "offset": offset + (rank - first) % per * length}
            keep = [k for k in batch.schema.names if k != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keep), *(pa.array(v, pa.int64()) for v in found.values())], names=[*keep, *found])

    # One row a task: where its counting of each length begins.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = materialise(base.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("base")), "packing-bases")
    ranked = cut.join(base, "part").withColumn("rank", F.col("base")[F.col("length")] + F.col("local"))
    more = ", ids array<long>" * with_ids
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * with_ids).mapInArrow(
        place, f"doc_id long, piece int, start long, length long, ids_crc32 long{more}, sequence_id long, offset long"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from ``pack(..., with_ids=True)``: at most ``capacity`` ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
