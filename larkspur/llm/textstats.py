"""Statistics of whole texts, for the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Counts that the quality rules' contract names, then further counts of the same pass.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_punct", "n_unique", "n_marked", "n_piped", "max_word", "n_ended", "n_short", "n_chars")
_MIX = np.array([xxhash.xxh64_intdigest(b"word %d" % i) | 1 for i in range(WINDOW)], np.uint64)
_SPACE = [0x20, *range(0x09, 0x0E)]
_PUNCT = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_MARKS = tuple("#*$%&|<>!".encode()[i : i + 1] for i in range(9))


def repeated(ids: np.ndarray) -> int:
    """Words in windows of eight that occur twice or more, the first included."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    spread = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(31)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h += spread[j : j + n] * _MIX[j]
    _, which, times = np.unique(h, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[which] > 1)
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The COUNTS and MORE of a whole text; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()  # bytes split at the six ASCII spaces only
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    byte = np.frombuffer(raw, np.uint8)
    of = np.bincount(byte, minlength=256)
    chars = len(raw) - int(of[0x80:0xC0].sum())
    lines = [x for x in raw.split(b"\n") if x.split()]
    times = np.bincount(ids, minlength=len(seen)) if len(words) else np.zeros(0, np.int64)
    marked = np.fromiter((w.endswith(_MARKS) for w in seen), bool, len(seen))
    ended = np.fromiter((w.endswith((b".", b"!", b"?")) for w in seen), bool, len(seen))
    short = np.fromiter((len(w) <= 3 for w in seen), bool, len(seen))
    return (
        len(words), chars - int(of[_SPACE].sum()), int(of[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated(ids),
        len(lines), int(of[0x41:0x5B].sum()), int(of[0x30:0x3A].sum()), int(of[_PUNCT].sum()), len(seen), int(times[marked].sum()), int(of[0x7C]),
        max(map(len, seen), default=0), int(times[ended].sum()), int(times[short].sum()), chars,
    )


def text_statistics(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the columns ``also`` and the counts of every row; no shuffle."""
    names, keys = COUNTS + MORE, ["doc_id", *also]
    rows = docs.select(F.col("doc_id").cast("long"), *also, F.col("text").cast("string").alias("text"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = np.array([statistics(t) for t in batch.column(len(keys)).to_pylist()], np.int64).reshape(-1, len(names))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(c) for c in table.T)], names=[*keys, *names])

    types = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)]]
    return map_rows(rows, one, ", ".join([*types, *(f"{c} long" for c in names)]))
