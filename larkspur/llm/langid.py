"""Language identification by compression.

Each language has a zstandard raw-content dictionary: whole texts of a bounded, hash-chosen sample of labelled rows. A whole
text is cut into chunks, each chunk is compressed with every dictionary, and the language with the fewest bytes in sum is chosen. The margin is
the share by which the runner-up needs more bytes; a text whose margin is below ``MIN_MARGIN`` is rejected as undecided. All lengths go the same way.

``lang_pred`` is always a learned language, or ``und`` where the text is null or has no letter; those are rejected with score 0. Ties
go to the language with more labelled rows, then by name. Repeated rows, null doc_ids and extra columns change nothing; without any
labelled row every text is ``und``; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_rows, materialise

#: Expected number of labelled rows sampled for a language's dictionary: the bound of the fit.
SAMPLE_ROWS = 100
#: Shorter matches than zstandard's own choice at this level: syllables tell languages apart.
LEVEL, MIN_MATCH = 5, 3
#: Bytes compressed at a time; shorter than a dictionary, so that long texts also lean on it.
CHUNK = 4096
MIN_MARGIN = 0.002
UNKNOWN = "und"
#: Word characters but for decimal digits; numbers such as halves and Roman numerals are among them.
_MAYBE = re.compile(r"[^\W\d_]")


def dictionaries(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of labelled rows, from rows with doc_id, text and lang."""
    rows = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang is not null and text is not null")
    # The hash also covers the text, so that repeated ids don't come or go together.
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "langid-counts")
    picked = rows.join(counts, "lang").where(F.pmod("h", "n") < sample_rows)
    size: dict[str, int] = {}
    parts: dict[str, list[str]] = {}
    for lang, n, text in picked.select("lang", "n", "text").distinct().orderBy("lang", F.xxhash64("text")).collect():
        size[lang] = n
        parts.setdefault(lang, []).append(text.lower())
    return [(k, "\n".join(parts[k]).encode()) for k in sorted(parts, key=lambda k: (-size[k], k))]


@functools.lru_cache(maxsize=1)
def _compressors(models: tuple[tuple[str, bytes], ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, content in models:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=CHUNK, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        words.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=words))
    return out


def classify(text: str | None, models: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    """(language, margin) of a whole text."""
    if not text or not models or not any(m[0].isalpha() for m in _MAYBE.finditer(text)):
        return UNKNOWN, 0.0
    raw = text.lower().encode()
    chunks = [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]
    sizes = [sum(len(c.compress(x)) for x in chunks) for c in _compressors(models)]
    best = min(range(len(sizes)), key=sizes.__getitem__)  # the first of equals has more labelled rows
    others = [s for i, s in enumerate(sizes) if i != best]
    return models[best][0], (min(others) - sizes[best]) / sizes[best] if others else 1.0


def score_of(margin: float) -> float:
    """0 without a margin, a half at five times the least one, 1 at most."""
    return margin / (margin + 5 * MIN_MARGIN)


def identify(docs: DataFrame, models: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row; only the text is looked at."""
    fixed = tuple(models)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [classify(t, fixed) for t in batch.column(1).to_pylist()]
        return batch_of(doc_id=(batch.column(0), pa.int64()), lang_pred=([k for k, _ in found], pa.string()), score=([score_of(m) for _, m in found], pa.float64()), rejected=([m < MIN_MARGIN for _, m in found], pa.bool_()))

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), one, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, models: list[tuple[str, bytes]]) -> DataFrame:
    """The rows whose language is decided, with all their columns; no shuffle."""
    fixed, at = tuple(models), docs.columns.index("text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([classify(t, fixed)[1] >= MIN_MARGIN for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_rows(docs, one, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows kept from fitting: crc32 of the id as text leaves 1 modulo 3; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))
