"""Hierarchical packing into several context sizes, without padding.

A document's tokens go to the tier of the smallest context that holds them (those longer than the largest are cut into full windows and a rest).
The tiers are packed from the longest down. Each piece of a tier opens a window of that size, and its gap is filled from shorter tiers: the longest
piece that still fits, again and again; when none fits, a piece is cut to the gap's size and the rest of it goes back to its own tier. No more windows are
opened than the tokens left can fill, so every window is full and its length is the tier's, a power of two. Only what is left in the end, fewer tokens than the smallest
context, makes one sequence that is padded. Every tier's sequences are then dealt out evenly to the step groups: two steps differ by
one sequence of each context size at most, in tokens as in attention.

All of this is planned on the *histogram* of piece lengths (at most ``capacity`` counters, whatever the corpus): an entry of the plan says where a
range of the pieces of one length goes. Spark ranks the pieces within their length (counts per task, then a sum over
tasks), and each piece looks up its own places. No sequence or document ever meets others in one task.

Token ids are exactly those of ``tokenizers``. The vocabulary drops white space, lowers case and never merges across either white space or the end of a run of letters.
So what stands between white space is encoded once and remembered, plain words without regard to case and to the signs behind them. Unknown plain words go to ``tokenizers`` many at a
time; everything else that is unknown, and very long words, go there one by one.

Null and empty texts are the end id alone. Texts of any length are cut, never truncated. Repeated rows are packed as often as they come, and
equal lengths in the order of tasks and rows. Null doc_ids stay null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, batch_of, materialise

#: Context sizes, the longest first: powers of two, each half of the one before.
TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens of a training step.
STEP_TOKENS = 1 << 18
#: Words remembered by a Python worker before it forgets them all, and the longest that is remembered (in characters).
WORDS, LONGEST_WORD = 1_000_000, 64
#: Unknown words that are encoded at a time.
_AT_ONCE = 1000
#: Letters that no normal form changes but for their case, with ASCII signs behind them; an apostrophe can belong to the letters after it.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Separators that Python takes for white space and the vocabulary for symbols.
_SYMBOLS = re.compile("[\x1c-\x1f]")
_RANK_BITS = 44


class _Words:
    """Ids of words, as bytes."""

    def __init__(self, json_path: str) -> None:
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        vocabulary = self.exact.get_vocab()
        self.kind = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, self.kind)

    def learn(self, words: set[str]) -> None:
        """Encode those of these that are unknown: runs of letters together, as each run's last id says so, and others one by one."""
        known, unknown = self.known, words.difference(self.known)
        if len(known) + 2 * len(unknown) > WORDS:
            known.clear()
            unknown = words
        plain, runs, others = [], set(), {""}
        for word in unknown:
            if len(word) > LONGEST_WORD:
                continue
            if m := _PLAIN.fullmatch(word):
                run, signs = m.groups()
                run = run.lower()
                plain.append((word, run, signs))
                runs.add(run)
                others.add(signs)
            else:
                others.add(word)
        for some in itertools.batched(runs.difference(known), _AT_ONCE):
            ids = self._ids(" ".join(some))
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.kind.itemsize
            if len(ends) == len(some):
                raw = ids.tobytes()
                known.update(zip(some, (raw[a:b] for a, b in itertools.pairwise([0, *ends.tolist()])), strict=True))
        for word in others.difference(known):
            known[word] = self._ids(word).tobytes()
        for word, run, signs in plain:
            if run in known:
                known[word] = known[run] + known[signs]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, as bytes of ``kind``."""
        parts = [[x] if _SYMBOLS.search(x) else x.split() for x in texts]
        self.learn(set(itertools.chain.from_iterable(parts)))
        known = self.known
        out = []
        for words in parts:
            try:
                out.append(b"".join(map(known.__getitem__, words)))
            except KeyError:  # very long words aren't remembered
                out.append(b"".join(known[w] if w in known else self._ids(w).tobytes() for w in words))
        return out


@functools.lru_cache(maxsize=1)
def _words(json_path: str) -> _Words:
    return _Words(json_path)


def pieces(docs: DataFrame, json_path: str, capacity: int = TIERS[0]) -> DataFrame:
    """Documents cut at every ``capacity`` tokens: each piece with its ids, its task and its number among the task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = _words(json_path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        size = words.kind.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                out = []
                texts = words.encode([x or "" for x in rows.column(1).to_pylist()])
                for doc_id, ids in zip(rows.column(0).to_pylist(), texts, strict=True):
                    ids += END_ID.to_bytes(size, "little")
                    n = len(ids) // size
                    for start in range(0, n, capacity):
                        own = ids[start * size : (start + capacity) * size]
                        length = len(own) // size
                        out.append((doc_id, n, start, length, own, int(seen[length])))
                        seen[length] += 1
                doc, total, start, length, ids, local = zip(*out, strict=True)
                yield batch_of(doc_id=(doc, pa.int64()), doc_tokens=(total, pa.int64()), start=(start, pa.int64()), length=(length, pa.int64()), ids=(ids, pa.binary()), part=([part] * len(out), pa.int32()), local=(local, pa.int64()))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, doc_tokens long, start long, length long, ids binary, part int, local long")


class _Pool:
    """What is still to be placed, by length: groups (length of the whole piece, first rank, pieces, start within the piece)."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.groups: dict[int, list] = defaultdict(list)
        self.lengths: list[int] = []
        self.tokens = 0
        for length, n in counts.items():
            self.put(length, (length, 0, n, 0))

    def put(self, length: int, group: tuple[int, int, int, int]) -> None:
        if not self.groups[length]:
            bisect.insort(self.lengths, length)
        self.groups[length].append(group)
        self.tokens += length * group[2]

    def take(self, length: int, most: int) -> tuple[int, int, int, int]:
        """At most ``most`` pieces of one group."""
        whole, rank, n, start = self.groups[length].pop()
        k = min(n, most)
        if k < n:
            self.groups[length].append((whole, rank + k, n - k, start))
        elif not self.groups[length]:
            self.lengths.remove(length)
        self.tokens -= k * length
        return whole, rank, k, start

    def longest(self, most: int) -> int:
        """The longest length that is at most ``most``; 0 if there is none."""
        at = bisect.bisect_right(self.lengths, most)
        return self.lengths[at - 1] if at else 0


def plan(counts: dict[int, int], tiers: Sequence[int] = TIERS) -> tuple[list[tuple[int, ...]], list[tuple[int, int]]]:
    """Where the pieces of each length go, and (context, sequences) of each tier in the order of sequence numbers.

    An entry (whole, first rank, end rank, start, length, first sequence, each, offset) places that part of the pieces of length ``whole``: the i-th of
    them in sequence first + i // each, at offset + i % each * length.
    """
    pool, entries, made, total = _Pool(counts), [], [], 0

    def place(group: tuple[int, int, int, int], length: int, sequence: int, each: int, offset: int) -> None:
        whole, rank, n, start = group
        entries.append((whole, rank, rank + n, start, length, sequence, each, offset))

    def fill(sequence: int, windows: int, gap: int, offset: int, shorter: int) -> None:
        open_ = [(sequence, windows, gap, offset)]
        while open_:
            sequence, windows, gap, offset = open_.pop()
            if not gap:
                continue
            if length := pool.longest(gap):
                group = pool.take(length, windows * (gap // length))
                each = group[2] // windows
                if extra := group[2] - max(each, 1) * windows if each else 0:
                    whole, rank, n, start = group
                    group = (whole, rank, n - extra, start)
                    pool.put(length, (whole, rank + n - extra, extra, start))
                done = windows if each else group[2]
                place(group, length, sequence, each or 1, offset)
                open_.append((sequence, done, gap - (each or 1) * length, offset + (each or 1) * length))
            else:
                longest = pool.longest(shorter)
                longest = longest if longest > gap else pool.lengths[-1]
                whole, rank, done, start = pool.take(longest, windows)
                place((whole, rank, done, start), gap, sequence, 1, offset)
                pool.put(longest - gap, (whole, rank, done, start + gap))
            if done < windows:
                open_.append((sequence + done, windows - done, gap, offset))

    for tier in tiers:
        began, shorter = total, tier // 2
        while pool.lengths and (pool.lengths[-1] > shorter or tier == tiers[-1]):
            length = pool.lengths[-1]
            if not (windows := pool.tokens // tier):
                break
            whole, rank, n, start = pool.take(length, windows)
            place((whole, rank, n, start), min(length, tier), total, 1, 0)
            if length > tier:
                pool.put(length - tier, (whole, rank, n, start + tier))
            else:
                fill(total, n, tier - length, length, shorter)
            total += n
        made.append((tier, total - began))
    offset = 0
    while pool.lengths:
        length = pool.lengths[-1]
        group = pool.take(length, 1 << _RANK_BITS)
        place(group, length, total, group[2], offset)
        offset += length * group[2]
    return entries, [*made, *([(tiers[0], 1)] if offset else [])]


class Places:
    """The plan for looking up: for every range of ranks of a length, the parts it is cut into."""

    def __init__(self, entries: list[tuple[int, ...]]) -> None:
        table = np.array(sorted(entries), np.int64).reshape(-1, 8)
        edges = np.unique(np.concatenate([(table[:, 0] << _RANK_BITS) + table[:, k] for k in (1, 2)]))
        low, high = (np.searchsorted(edges, (table[:, 0] << _RANK_BITS) + table[:, k]) for k in (1, 2))
        entry = np.repeat(np.arange(len(table)), high - low)
        within = np.arange(len(entry)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        interval = low[entry] + within
        order = np.lexsort((table[entry, 3], interval))
        self.table, self.edges, self.entry = table, edges, entry[order]
        self.first = np.searchsorted(interval[order], np.arange(len(edges) + 1))

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each part of the given pieces: its piece's index, start, length, sequence and offset."""
        interval = np.searchsorted(self.edges, (length << _RANK_BITS) + rank, "right") - 1
        parts = self.first[interval + 1] - self.first[interval]
        piece = np.repeat(np.arange(len(length)), parts)
        at = np.repeat(self.first[interval] - (np.cumsum(parts) - parts), parts) + np.arange(len(piece))
        _, low, _, start, size, sequence, each, offset = self.table[self.entry[at]].T
        i = rank[piece] - low
        return piece, start, size, sequence + i // each, offset + i % each * size


def steps(sequence: np.ndarray, tiers: list[tuple[int, int]], step_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Context size and step group of each sequence."""
    sizes, n = np.array(tiers, np.int64).reshape(-1, 2).T
    end = np.cumsum(n)
    many = max(1, -(-int(sizes @ n) // step_tokens))
    tier = np.searchsorted(end, sequence, "right")
    return sizes[tier], (sequence - end[tier] + n[tier]) * many // n[tier]


def pack(docs: DataFrame, json_path: str, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group (and ids)."""
    cut = materialise(pieces(docs, json_path, tiers[0]), "tiers-pieces")
    each = materialise(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "tiers-counts")
    entries, made = plan({r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}, tiers)
    places, kind = Places(entries), _words(json_path).kind

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, total, begin, length, rank = (batch.column(k) for k in range(5))
            piece, start, size, sequence, offset = places.of(length.to_numpy(), rank.to_numpy())
            if not len(piece):
                continue
            context, step = steps(sequence, made, step_tokens)
            ids = [np.frombuffer(x, kind).astype("<u4") for x in batch.column(5).to_pylist()]
            own = [ids[p][a : a + n] for p, a, n in zip(piece.tolist(), start.tolist(), size.tolist(), strict=True)]
            of = pa.array(piece)
            more = {"ids": (own, pa.list_(pa.int64()))} if with_ids else {}
            yield batch_of(
                doc_id=(doc.take(of), pa.int64()), start=(begin.to_numpy()[piece] + start, pa.int64()), length=(size, pa.int64()), ids_crc32=([zlib.crc32(x.tobytes()) for x in own], pa.int64()), doc_tokens=(total.take(of), pa.int64()),
                sequence_id=(sequence, pa.int64()), offset=(offset, pa.int64()), context=(context, pa.int64()), step_group=(step, pa.int64()), **more,
            )

    # One row a task: where its counting of each length begins.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    base = materialise(base.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("base")), "tiers-bases")
    ranked = cut.join(base, "part").withColumn("rank", F.col("base")[F.col("length")] + F.col("local"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step_group long" + ", ids array<long>" * with_ids
    return ranked.select("doc_id", "doc_tokens", "start", "length", "rank", "ids").mapInArrow(place, schema)
