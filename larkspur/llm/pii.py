"""Personal data in whole texts, also where it is disguised, with spans of the source text.

Plain detection (``detect``) runs on the text as it is. For disguised data, transducers rewrite the text: look-alike letters and digits
become ASCII, invisible characters vanish, spelled digits become digits, and at/dot disguises become ``@`` and ``.``. Every
rewritten character remembers its source span, so what is detected there is mapped back. A disguised find is added only if it contains
something rewritten and lies in no plain find of its kind; plain finds always stay, also inside a wider disguised one.

Spans are (kind, start, end) in code points, end exclusive, kinds in the order email, ip, card, phone. Null and empty texts have none.
Time grows with the text's length (times its logarithm where there are disguises), whatever it holds. Repeated rows and null doc_ids give their own rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, map_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# Look-behinds and possessive repeats only skip starts and splits that cannot succeed: matches are those of the plain patterns.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]++\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def detect(text: str) -> list[Span]:
    """Spans of the plain patterns: leftmost, not overlapping within a kind, by kind and start."""
    out = _emails(text) if "@" in text else []
    if not _DIGITS.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# Look-alikes of ASCII characters (Cyrillic, Greek, symbols), invisible characters, and spelled digits.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "－": "-", "‐": "-", "‑": "-", "–": "-", "﹣": "-", "＿": "_",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS = ("at", "arroba", "arobase")
DOT_WORDS = ("dot", "punkt", "punto", "point")
PLUS_WORDS = ("plus", "más")

TOP_LEVEL = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "eu", "de", "fr", "es", "it", "uk", "us", "ca", "au", "nl", "ch", "at", "be", "jp", "cn", "in", "br", "ru")

#: Full-width letters and digits and the Arabic-Indic digits follow from a rule.
_ONE = {
    **HOMOGLYPHS,
    **{chr(0xFEE0 + c): chr(c) for c in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B))},
    **{chr(base + d): str(d) for base in (0x660, 0x6F0, 0x966) for d in range(10)},
    **dict.fromkeys(INVISIBLE, ""),
}
_ODD = re.compile(f"[{''.join(map(re.escape, _ONE))}]")


def _one_of(words: Iterable[str]) -> str:
    """A pattern of any of the words, by their first letters; longer ones first."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        heads.setdefault(w[0], []).append(re.escape(w[1:]))
    return f"(?:{'|'.join(f'{h}(?:{chr(124).join(rest)})' for h, rest in sorted(heads.items()))})"


_SPELLED, _PLUS, _AT, _DOT = (_one_of(x) for x in (DIGIT_WORDS, PLUS_WORDS, AT_WORDS, DOT_WORDS))
#: Spelled digits count only in a row of at least four digits, of which some may be written as digits.
_ROW = re.compile(rf"(?i)\b(?:{_PLUS}[ -]+)?(?:{_SPELLED}|[0-9])(?:[ ,-]{{1,2}}(?:{_SPELLED}|[0-9])\b){{3,}}+")
_ITEM = re.compile(rf"(?i)({_PLUS})[ -]+|({_SPELLED})|([0-9])|[ ,-]+")
#: Bracketed words are disguises wherever they stand; bare words only as name at name dot (top-level domain).
_BRACKET = re.compile(rf"(?i)[ ]{{0,2}}[(\[{{<][ ]?(?:({_AT})|{_DOT})[ ]?[)\]}}>][ ]{{0,2}}")
_REST = rf"[A-Za-z0-9-]{{1,63}}(?: {_DOT} [A-Za-z0-9-]{{1,63}}){{0,7}} {_DOT} (?:{'|'.join(TOP_LEVEL)})\b"
_BARE = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-])( {_AT} )(?={_REST})")
_BARE_DOT = re.compile(rf"(?i) {_DOT} (?=[A-Za-z0-9-])")
_BARE_REST = re.compile(f"(?i){_REST}")
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])(?: @ ?|@ )(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+)")
#: Any of these pieces must occur for the word transducers to be worth a pass.
_HINTS = re.compile(rf"(?i)[(\[{{<][ ]?(?:{_AT}|{_DOT})[ ]?[)\]}}>]| {_DOT} ")


def _edits(text: str) -> list[tuple[int, int, str]]:
    """Rewrites (start, end, new) of the source, in order and apart from each other."""
    found = [] if text.isascii() else [(m.start(), m.end(), _ONE[m[0]]) for m in _ODD.finditer(text)]
    if _HINTS.search(text):
        for m in _BRACKET.finditer(text):
            found.append((m.start(), m.end(), "@" if m[1] else "."))
        for m in _BARE.finditer(text):
            found.append((m.start(1), m.end(1), "@"))
            end = _BARE_REST.match(text, m.end()).end()
            found += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.end(), end)]
    if " @" in text or "@ " in text:
        found += [(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(text)]
    for m in _ROW.finditer(text):
        row = list(_ITEM.finditer(text, m.start(), m.end()))
        if any(x[2] for x in row):
            found += [(x.start(), x.end(), "+" if x[1] else DIGIT_WORDS[x[2].lower()] if x[2] else x[3] or "") for x in row]
    out: list[tuple[int, int, str]] = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


def deobfuscate(text: str, edits: list[tuple[int, int, str]]) -> tuple[str, list[int], list[int]]:
    """The rewritten text, and segments as (start there, start here): within a copied segment offsets move together."""
    parts, there, here, at, size = [], [], [], 0, 0
    for start, end, new in edits:
        if start > at:
            there.append(size)
            here.append(at)
            parts.append(text[at:start])
            size += start - at
        there.append(size)
        here.append(~start)  # a rewritten segment: one source span for all of it
        parts.append(new)
        size += len(new)
        at = end
    there.append(size)
    here.append(at)
    parts.append(text[at:])
    return "".join(parts), there, here


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Spans found only after rewriting, mapped back to the source."""
    edits = _edits(text)
    if not edits:
        return []
    new, there, here = deobfuscate(text, edits)
    starts = [e[0] for e in edits]
    known = {k: [s for s in plain if s[0] == k] for k in KINDS}  # by start, apart from each other
    begins = {k: [s[1] for s in v] for k, v in known.items()}

    def back(at: int, end: bool) -> int:
        k = bisect.bisect_left(there, at) - 1 if end else bisect.bisect_right(there, at) - 1
        if here[k] >= 0:
            return here[k] + at - there[k]
        return edits[bisect.bisect_left(starts, ~here[k])][1] if end else ~here[k]

    out = []
    for kind, a, b in detect(new):
        start, end = back(a, False), back(b, True)
        k = bisect.bisect_left(starts, start)
        changed = k < len(edits) and edits[k][0] < end
        last = bisect.bisect_right(begins[kind], start) - 1  # only the last plain find that starts no later can hold it
        if changed and not (last >= 0 and end <= known[kind][last][2]):
            out.append((kind, start, end))
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans) of a whole text."""
    plain = detect(text) if text else []
    more = disguised(text, plain) if text else []
    return plain, sorted(plain + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else plain


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def identifiers(docs: DataFrame) -> DataFrame:
    """doc_id, the number of plain finds of each kind, base_sha256 (of the plain spans), spans (all of them)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, spans = [], []
        for text in batch.column(1).to_pylist():
            plain, every = find(text)
            for k in KINDS:
                counts[k].append(sum(s[0] == k for s in plain))
            base = _joined(plain)
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            spans.append(base if every is plain else _joined(every))
        return batch_of(doc_id=(batch.column(0), pa.int64()), **{f"n_{k}": (v, pa.int64()) for k, v in counts.items()}, base_sha256=(digests, pa.string()), spans=(spans, pa.string()))

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), one, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def masked(docs: DataFrame) -> DataFrame:
    """The same rows and columns with all finds masked in ``text``; no shuffle."""
    schema = docs.schema
    at = schema.names.index("text")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.array([mask(t, find(t)[1]) for t in batch.column(at).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return map_rows(docs, one, schema)
