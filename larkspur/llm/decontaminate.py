"""Benchmark decontamination by templates.

Words are canonicalised: numbers, units after numbers and names become typed placeholders, so a question asked again with other
parameters keeps its template. A name is a capitalised word that doesn't begin a sentence; a word's placeholder follows from it and the word before, not
from what else the text says. Windows of ``WINDOW`` template words are hashed and joined with those of the benchmark. A window with
fewer than ``MIN_WORDS`` literal words is too vague as a template and is hashed with its values instead.

A matching window also says which value stands in the document where the item has which. Matches that lie on nearby alignments of
document and item are one occurrence. Along each alignment and over the whole occurrence, an item value must stand for one document value and
a document value for one item value (slot consistency, both ways, in ``MIN_CONSISTENCY`` of the places). A document is contaminated by an item
if an occurrence covers at least ``MIN_COVERAGE`` of the item's windows.

Items are compared by families: those with the same template and the same pattern of equal slots match the same documents. A
result names the family's smallest item_id and how many items it has. An item uses its template windows only, or, if it has none, its
literal ones. An item of fewer than ``WINDOW`` words is found where it stands verbatim as a line or a sentence of its own; an item without words never is.

Document windows first pass two bitmaps of fixed size made from the benchmark's hashes, so only (nearly) matching windows are
shuffled; the join decides. Null or empty texts have no windows: such documents are clean. Rows are told apart by their place: ``clean`` judges every
row by its own text, also rows without doc_id; ``contaminated`` gives one row for each doc_id (null too) and family.
Empty tables give an empty result, and other columns are ignored.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, map_rows, materialise, numbered

WINDOW = 5
MIN_WORDS = 3
MIN_COVERAGE = 0.5
MIN_CONSISTENCY = 0.8
#: Bits of each of the two prefilter bitmaps: 1 MB, whatever the benchmark's size.
FILTER_BITS = 1 << 23
#: Words remembered by a Python worker before it forgets them all.
VOCABULARY = 100_000
#: Characters of the texts whose words are held at a time, unless one text has more.
CHARS = 2_000_000

# Number words and units, in natural order.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
UNITS = "% percent mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur degree degrees mph kmh"

_NUMBERS, _UNITS = frozenset(NUMBER_WORDS.split()), frozenset(UNITS.split())
_EDGE = re.compile(r"^[^\w%]+|[^\w%]+$")
_MARKS = "!\"#$&'()*+,-./:;<=>?@[\\]^`{|}~"
_NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*(?:%|[a-z]{1,3}|st|nd|rd|th)?")
_WORD, _NUM, _UNIT = 0, 1, 2
_TYPES = np.array([xxhash.xxh64_intdigest(x) for x in (b"", b"<num>", b"<unit>", b"<name>")], np.uint64)
_MIX = np.array([xxhash.xxh64_intdigest(b"mix %d" % i) | 1 for i in range(WINDOW)], np.uint64)


class _Words(dict):
    """word -> number of its row in ``table``: hash, kind, capital first (and not capitals only), ends a sentence."""

    def __init__(self) -> None:
        self.hashes, self.flags = np.zeros(1024, np.uint64), np.zeros((1024, 3), np.int8)

    def __missing__(self, word: str) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes, self.flags = np.concatenate([self.hashes, self.hashes]), np.concatenate([self.flags, self.flags])
        bare = word.strip(_MARKS)
        if not bare.isalnum():
            bare = _EDGE.sub("", word)
        low = bare.lower()
        kind = _NUM if low in _NUMBERS or _NUMBER.fullmatch(low) else _UNIT if low in _UNITS else _WORD
        self.hashes[n] = xxhash.xxh64_intdigest(low.encode())
        self.flags[n] = kind, bare[:1].isupper() and not bare[1:].isupper(), word.rstrip("\"')]»”")[-1:] in ".!?:;"
        self[word] = n
        return n


_words = _Words()


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, one after another: (value hash, slot type or 0, text number), and where each text begins."""
    global _words
    if len(_words) > VOCABULARY:
        _words = _Words()
    parts = [t.split() if t else [] for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.fromiter(map(_words.__getitem__, itertools.chain.from_iterable(parts)), np.int64, int(size.sum()))
    of = np.repeat(np.arange(len(parts)), size)
    value, (kind, capital, ends) = _words.hashes[at], _words.flags[at].T
    inside = np.r_[False, of[1:] == of[:-1]][: len(at)]
    unit = (kind == _UNIT) & inside & np.r_[False, kind[:-1] == _NUM][: len(at)]
    name = (kind == _WORD) & (capital == 1) & inside & np.r_[False, ends[:-1] == 0][: len(at)]
    return value, np.where(kind == _NUM, 1, np.where(unit, 2, np.where(name, 3, 0))), of, np.cumsum(size) - size


def _mixed(tokens: np.ndarray, at: np.ndarray | slice, wide: int = WINDOW) -> np.ndarray:
    """Hashes of the runs of ``wide`` tokens that begin at the places ``at``, or at all places."""
    n = len(tokens) - wide + 1
    total = np.zeros(n if isinstance(at, slice) else len(at), np.uint64)
    for j in range(wide):
        total = total + (tokens[j : j + n] if isinstance(at, slice) else tokens[at + j]) * _MIX[j]
    total ^= total >> np.uint64(29)
    return total * _MIX[0]


def templates(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of every window of every text: (hash, whether it is a template, text number, first word); then the value and slot type of every word."""
    value, slot, of, begin = _tokens(texts)
    n = len(value) - WINDOW + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.astype(bool), none, none, value, slot
    h = _mixed(np.where(slot > 0, _TYPES[slot], value), slice(None))
    free = (slot == 0).astype(np.int8)
    clear = sum(free[j : j + n] for j in range(WINDOW)) >= MIN_WORDS
    vague = np.flatnonzero(~clear)
    h[vague] = ~_mixed(value, vague)
    within = np.flatnonzero(of[:n] == of[WINDOW - 1 :])
    return h[within], clear[within], of[within], within, value, slot


def _literal(words: list[str]) -> int:
    """The hash of a short item's, line's or sentence's words."""
    at = [_words[w] for w in words]
    value = _words.hashes[at]
    return int((~_mixed(value, np.zeros(1, np.int64), len(words)) ^ np.uint64(len(words))).view(np.int64)[0])


def _short_units(text: str | None, lengths: frozenset[int]) -> list[tuple[int, int]]:
    """(first word, hash) of the lines and sentences of a text whose number of words is in ``lengths``."""
    out, at = {}, 0
    for line in (text or "").split("\n"):
        words = line.split()
        at_words = [_words[w] for w in words]
        ends = [0, *(i + 1 for i, k in enumerate(at_words) if _words.flags[k, 2]), len(words)]
        for a, b in {(0, len(words)), *itertools.pairwise(ends)}:
            if b - a in lengths:
                out[at + a, b] = (at + a, _literal(words[a:b]))
        at += len(words)
    return list(out.values())


_WINDOW_SCHEMA = "h long, pos int, slots array<long>, literal long"


def _columns(h: np.ndarray, first: np.ndarray, pos: np.ndarray, value: np.ndarray, slot: np.ndarray) -> list[pa.Array]:
    cells = first[:, None] + np.arange(WINDOW)
    slots = np.where(slot[cells] > 0, value[cells], 0).view(np.int64) if len(first) else np.zeros((0, WINDOW), np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1) * WINDOW, pa.int32()), pa.array(slots.ravel()))
    return [pa.array(h.view(np.int64)), pa.array(pos, pa.int32()), lists, pa.array(_mixed(value, first).view(np.int64))]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, family, digest, windows, words, and a window's h, pos, slots, literal) of every item with words."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            h, clear, _, first, value, slot = templates([text])
            if not len(value):
                continue
            if len(value) < WINDOW:
                h = np.array([_literal(text.split())], np.int64)
                first = np.zeros(0, np.int64)
                columns = [pa.array(h), pa.array([0], pa.int32()), pa.array([[0] * WINDOW], pa.list_(pa.int64())), pa.array(h)]
                shape = h.tobytes()
            else:
                use = clear if clear.any() else ~clear
                h, first = h[use], first[use]
                columns = _columns(h, first, first, value, slot)
                names, where, same = np.unique(value[slot > 0], return_index=True, return_inverse=True)
                shape = h.tobytes() + first.tobytes() + where[same].tobytes()
            fixed = (pa.array([ident] * len(h), pa.int64()), *(pa.array([xxhash.xxh3_64_intdigest(x) - 2**63] * len(h), pa.int64()) for x in (shape, value.tobytes())), *(pa.array([n] * len(h), pa.int32()) for n in (len(h), len(value))))
            out.append(pa.RecordBatch.from_arrays([*fixed, *columns], names=["item_id", "family", "digest", "windows", "words", "h", "pos", "slots", "literal"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    return map_rows(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")), one, f"item_id long, family long, digest long, windows int, words int, {_WINDOW_SCHEMA}")


def document_windows(rows: DataFrame, bitmaps: tuple[bytes, bytes], short: frozenset[int]) -> DataFrame:
    """(row, h, pos, slots, literal): the windows of every whole text of (row, text) that pass the bitmaps, and its short lines and sentences."""
    bits = [np.frombuffer(b, np.uint8) for b in bitmaps]
    mask = np.uint64(FILTER_BITS - 1)

    def passing(h: np.ndarray) -> np.ndarray:
        use = np.arange(len(h))
        for b, shift in zip(bits, (np.uint64(0), np.uint64(32)), strict=True):
            low = (h[use] >> shift) & mask
            use = use[(b[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        return use

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """The rows in parts of about CHARS characters, since all words of a part are held at once."""
        ident, texts, out, at = batch.column(0).to_numpy(), batch.column(1).to_pylist(), [], 0
        while at < len(texts):
            end, size = at + 1, len(texts[at] or "")
            while end < len(texts) and (size := size + len(texts[end] or "")) <= CHARS:
                end += 1
            out.append(part(ident[at:end], texts[at:end]))
            at = end
        found = pa.Table.from_batches(out).combine_chunks().to_batches()
        return found[0] if found else None

    def part(ident: np.ndarray, texts: list[str | None]) -> pa.RecordBatch:
        h, _, of, first, value, slot = templates(texts)
        use = passing(h)
        starts = np.zeros(len(texts), np.int64)
        if len(of):
            seen, at = np.unique(of, return_index=True)
            starts[seen] = first[at]  # a text's first window begins at its first word
        columns = _columns(h[use], first[use], first[use] - starts[of[use]], value, slot)
        who = pa.array(ident[of[use]])
        found = pa.RecordBatch.from_arrays([who, *columns], names=["row", "h", "pos", "slots", "literal"])
        if not short:
            return found
        more = [(ident[i], k, p) for i, t in enumerate(texts) for p, k in _short_units(t, short)]
        extra = batch_of(row=([m[0] for m in more], pa.int64()), h=([m[1] for m in more], pa.int64()), pos=([m[2] for m in more], pa.int32()), slots=([[0] * WINDOW] * len(more), pa.list_(pa.int64())), literal=([m[1] for m in more], pa.int64()))
        return pa.Table.from_batches([found, extra]).combine_chunks().to_batches()[0] if found.num_rows + extra.num_rows else found

    return map_rows(rows, one, f"row long, {_WINDOW_SCHEMA}")


def _bitmap(items: DataFrame, shift: int) -> bytes:
    """A bitmap of fixed size of 23 bits of each hash, built by Spark in pages of 32768 bits."""
    low = F.shiftrightunsigned(F.col("h"), shift).bitwiseAND(F.lit(FILTER_BITS - 1))
    pages = items.select(F.shiftright(low, 15).alias("page"), low.bitwiseAND(F.lit(32767)).alias("bit"))
    out = bytearray(FILTER_BITS // 8)
    for page, bitmap in pages.groupBy("page").agg(F.bitmap_construct_agg("bit")).collect():
        out[page * 4096 : page * 4096 + 4096] = bitmap
    return bytes(out)


def _agreement(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, agree) of value pairs (a, b): the lesser share, of the two ways, of places whose value has its commonest partner."""
    counts = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    by_value = counts.select(*keys, "n", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("a").alias("v")), F.struct(F.lit(1).alias("way"), F.col("b").alias("v")))).alias("x"))
    by_value = by_value.groupBy(*keys, "x").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    share = by_value.groupBy(*keys, F.col("x.way").alias("way")).agg((F.sum("most") / F.sum("n")).alias("share"))
    return share.groupBy(*keys).agg(F.min("share").alias("agree"))


def _occurrences(docs: DataFrame, benchmark: DataFrame, min_coverage: float, min_consistency: float) -> tuple[DataFrame, DataFrame]:
    """(row, family, matched, windows, coverage, verbatim) of rows (row, text), and (family, item_id, items)."""
    items = materialise(item_windows(benchmark), "decon-items")
    short = frozenset(r["words"] for r in items.where(F.col("words") < WINDOW).select("words").distinct().collect())
    families = items.groupBy("family").agg(F.min("item_id").alias("item_id"), F.count_distinct(F.xxhash64("item_id", "digest")).alias("items"))
    shape = items.groupBy("family", "h", "pos", "windows").agg(F.min(F.struct("item_id", "digest", "slots"))["slots"].alias("item_slots")).withColumnRenamed("pos", "item_pos")
    literals = items.select("family", F.col("pos").alias("item_pos"), "literal", F.lit(True).alias("same")).distinct()
    found = document_windows(docs, (_bitmap(items, 0), _bitmap(items, 32)), short)
    both = materialise(found.join(materialise(shape, "decon-shapes"), "h").withColumn("line", F.col("pos") - F.col("item_pos")), "decon-matches")

    def consistent(rows: DataFrame, *keys: str) -> DataFrame:
        pairs = rows.select(*keys, F.inline(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")))).where("a <> 0")
        return rows.join(_agreement(pairs, *keys), list(keys), "left").where(F.coalesce("agree", F.lit(1.0)) >= min_consistency).drop("agree")

    lines = consistent(both, "row", "family", "line")
    along = Window.partitionBy("row", "family").orderBy("line")
    far = F.col("line") - F.lag("line", 1).over(along) > F.greatest(F.lit(WINDOW), F.floor(F.col("windows") / 2))
    lines = lines.withColumn("far", far.cast("int")).withColumn("nth", F.coalesce(F.sum("far").over(along.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    kept = consistent(materialise(lines, "decon-lines"), "row", "family", "nth").join(materialise(literals, "decon-literals"), ["family", "item_pos", "literal"], "left")
    each = kept.groupBy("row", "family", "nth").agg(F.count_distinct("item_pos").alias("matched"), F.max("windows").alias("windows"), F.count_distinct(F.when(F.col("same"), F.col("item_pos"))).alias("literally"))
    each = each.withColumn("coverage", F.col("matched") / F.col("windows")).where(F.col("coverage") >= min_coverage)
    best = F.max(F.struct("coverage", F.col("literally") / F.col("matched"), "matched", "windows", (F.col("literally") == F.col("matched")).alias("verbatim"))).alias("best")
    best = each.groupBy("row", "family").agg(best).select("row", "family", "best.matched", "best.windows", "best.coverage", "best.verbatim")
    return best, families


def contaminated(docs: DataFrame, benchmark: DataFrame, min_coverage: float = MIN_COVERAGE, min_consistency: float = MIN_CONSISTENCY) -> DataFrame:
    """(doc_id, item_id, items, matched, windows, coverage, verbatim): documents and the item families they contain; verbatim if no slot was changed."""
    rows = numbered(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "decon-rows")
    best, families = _occurrences(rows.select("row", F.col("doc.text").alias("text")), benchmark, min_coverage, min_consistency)
    best = materialise(best, "decon-found").join(rows.select("row", F.col("doc.doc_id").alias("doc_id")), "row").join(materialise(families, "decon-families"), "family")
    most = F.max(F.struct("coverage", "verbatim", "matched", "windows")).alias("m")
    return best.groupBy("doc_id", "family", "item_id", "items").agg(most).select("doc_id", "item_id", "items", "m.matched", "m.windows", "m.coverage", "m.verbatim")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose text contains no item; all their columns, under any names. An empty table stays empty."""
    rows = numbered(docs, "decon-rows")
    best, _ = _occurrences(rows.select("row", F.col("doc.text").cast("string").alias("text")), benchmark, MIN_COVERAGE, MIN_CONSISTENCY)
    found = materialise(best.select("row").distinct(), "decon-found")
    return rows.join(found, "row", "left_anti").select("doc.*")
