import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkspur.llm import packing

FILES = {"json_path": P.path("byte_bpe_50k.json"), "ranks_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}
EXACT = Tokenizer.from_file(FILES["json_path"])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab '\n\t<|endoftext|>1é", max_size=80) | st.lists(st.sampled_from(["<|endoftext|>", "hello ", " <|", "endoftext|>", "\n", "é1"]), max_size=8).map("".join))
def test_both_encoders_agree(text):
    assert packing.encoder(**FILES)(text) == EXACT.encode(text, add_special_tokens=False).ids


def test_added_tokens_are_one_id():
    assert packing.encoder(**FILES)("hello <|endoftext|> world") == EXACT.encode("hello <|endoftext|> world", add_special_tokens=False).ids
    assert 50256 in packing.encoder(**FILES)("hello <|endoftext|> world")


def test_long_runs_are_encoded_fast():
    for text in ("a" * 100_000, " " * 100_000, "日本" * 5_000):
        assert packing.encoder(**FILES)(text) == EXACT.encode(text, add_special_tokens=False).ids


def test_plans_place_everything_once():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 64): rng.randint(1, 30) for _ in range(rng.randint(0, 40))}
        entries, total = packing.plan(counts, 64)
        bins: dict[int, list] = {}
        for length, a, b, first, each, offset in entries:
            for i in range(b - a):
                bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
        assert sorted(bins) == list(range(total))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64 and sum(3 * x > 64 for _, x in parts) <= 2
        assert sum(x for v in bins.values() for _, x in v) == sum(k * n for k, n in counts.items())


def test_rows_and_sequences(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "gamma ray", "δ"]) for _ in range(rng.randint(0, 90))), 0) for i in range(80)] + [(5, None, 1), (None, "", 1), (6, "word " * 300, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(5)
    packed = packing.pack(docs, capacity=64, with_ids=True, **FILES)
    got = packed.collect()
    want = []
    for i, text, _ in rows:
        ids = [*EXACT.encode(text or "", add_special_tokens=False).ids, 0]
        for k, (a, n) in enumerate(packing.cuts(len(ids), 64)):
            assert n == 64 or k == 0
            want.append((i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes()), ids[a : a + n]))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, r.ids) for r in got), key=key) == sorted(want, key=key)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in got:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(r.length for r in got) and max(map(len, whole.values())) <= 64
    assert packing.pack(docs.limit(0), **FILES).count() == 0
