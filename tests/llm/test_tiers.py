import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import tiers

JSON = P.path("word_bpe_49k.json")
EXACT = Tokenizer.from_file(JSON)


def ids_of(text):
    return EXACT.encode(text, add_special_tokens=False).ids


def encoded(text):
    words = tiers._words(JSON)
    return np.frombuffer(words.encode([text])[0], words.kind).tolist()


@settings(max_examples=500, deadline=None)
@given(
    st.text(max_size=60)
    | st.text(alphabet="aBΣσ '’sS\n\t\x1c\x1f\x85\xa0  　́İ1½é日", max_size=60)
    | st.text(alphabet="abcÀéßÿÞ.,'#<|>-_ 1́", max_size=40)
    | st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "hello ", " <|", "endoftext|>", "\n", "é1", "can't", "́"]), max_size=8).map("".join)
)
def test_words_are_encoded_like_whole_texts(text):
    assert encoded(text) == ids_of(text)


def test_long_runs_and_a_full_memory(monkeypatch):
    for text in ("a" * 50_000, " " * 50_000, "日本" * 5_000, "1" * 5_000, "<|endoftext|>" * 50):
        assert encoded(text) == ids_of(text)
    monkeypatch.setattr(tiers, "WORDS", 3)
    text = " ".join(f"word{i % 7} x{i}" for i in range(50))
    assert encoded(text) == ids_of(text) 
    assert encoded("a b") == ids_of("a b") and len(tiers._words(JSON).known) <= 3
    tiers._words.cache_clear()


def checked(counts, sizes=tiers.TIERS):
    """The plan places every token of every piece once, sequences have no holes, and all but the last are full."""
    entries, made = tiers.plan(counts, sizes)
    length = np.array([k for k, n in counts.items() for _ in range(n)], np.int64)
    rank = np.array([i for n in counts.values() for i in range(n)], np.int64)
    piece, start, size, sequence, offset = tiers.Places(entries).of(length, rank)
    assert np.array_equal(np.bincount(piece, size, len(length)), length)
    order = np.lexsort((start, piece))
    same = piece[order][1:] == piece[order][:-1]
    assert ((start[order][1:] == (start + size)[order][:-1]) | ~same).all()
    order = np.lexsort((offset, sequence))
    same = np.r_[False, sequence[order][1:] == sequence[order][:-1]]
    assert (offset[order] == np.where(same, np.r_[0, (offset + size)[order][:-1]], 0)).all()
    full = np.bincount(sequence, size, sum(n for _, n in made))
    short = np.flatnonzero(full != [t for t, n in made for _ in range(n)])
    assert len(short) == 0 or (list(short) == [len(full) - 1] and 0 < full[-1] < sizes[-1])
    return entries, made, len(piece) - len(length)


def test_plans_leave_one_sequence_unfilled_at_most():
    rng = random.Random(3)
    for _ in range(300):
        checked({rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(0, 40))}, (64, 32, 16, 8))
    for counts in ({}, {1500: 1000}, {2048: 5}, {1: 3000}, {1500: 1}, {2000: 7, 100: 1}, {129: 1000}, {300: 10_000}):
        checked(counts)


def test_plans_stay_small_and_cut_few_pieces():
    length = np.clip(np.random.default_rng(2).lognormal(5.5, 1, 20_000).astype(int), 1, 2048)
    counts = dict(zip(*(x.tolist() for x in np.unique(length, return_counts=True)), strict=True))
    entries, _, cut = checked(counts)
    assert cut < 0.1 * len(length)
    assert len(tiers.plan({k: 10_000 * n + k for k, n in counts.items()})[0]) < 3 * len(entries)


def test_steps_have_the_same_share_of_each_context():
    made = [(64, 37), (32, 50), (16, 9), (64, 1)]
    context, step = tiers.steps(np.arange(97), made, 512)
    assert context.tolist() == [t for t, n in made for _ in range(n)]
    assert set(step) == set(range(9))
    for size, n in made[:3]:
        at = np.arange(97)[context == size][:n]
        each = np.bincount(step[at], minlength=9)
        assert each.max() - each.min() <= 1


def test_rows_and_ids(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "gamma ray", "δ"]) for _ in range(rng.randint(0, 90))), 0, "x") for i in range(80)]
    rows += [(5, None, 1, "x"), (None, "", 1, "x"), (6, "word " * 5_000, 1, None), (6, "word " * 5_000, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int, part string").repartition(5)
    got = tiers.pack(docs, JSON, (64, 32, 16), 512, with_ids=True).collect()
    want, found = [[*ids_of(t or ""), 1] for _, t, *_ in rows], {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        found.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for (i, _, *_), ids in zip(rows, want, strict=True):
        parts = found[i, len(ids)]
        if i == 6 and len(ids) > 1_000:  # two equal rows: their pieces together are twice the ids
            tally = np.zeros(len(ids), int)
            for start, own in parts:
                tally[start : start + len(own)] += 1
                assert own == ids[start : start + len(own)]
            assert (tally == 2).all()
        else:
            assert [x for _, own in sorted(parts) for x in own] == ids
    by = {}
    for r in got:
        by.setdefault((r.sequence_id, r.context), []).append((r.offset, r.length))
    short = 0
    for (_, context), parts in by.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        short += at != context
    assert short <= 1 and len(by) == len({s for s, _ in by})
    assert tiers.pack(docs.limit(0), JSON).count() == 0
