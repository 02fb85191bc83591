import numpy as np
import pytest
import xxhash

import corpus_pipeline
from larkspur.llm import simhash, similar


def brute(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = 0
    for bit in range(64):
        out |= (2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams)) << bit
    return out


def components(fps):
    group = {i: i for i in fps}
    find = lambda x: x if group[x] == x else find(group[x])
    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                group[b] = a
    return {i: find(i) for i in fps}


def test_fingerprints():
    for text in (None, "", "a", "A b", "a b c", "Ä ä  x\ty\nz é" * 9, "one two three four one two three", "x " * 70000):
        assert simhash.fingerprint(text) % 2**64 == (brute(text) if len(text or "") < 999 else simhash.fingerprint("x x x") % 2**64)


def test_links_are_complete_for_any_split(spark):
    rng = np.random.default_rng(5)
    fps = []
    for base in rng.integers(-(2**62), 2**62, 30):
        fps.append(int(base))
        for _ in range(12):  # chains of near ones
            fps.append(int(fps[-1] ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63)))))
    fps = list(dict.fromkeys(fps))
    table = spark.createDataFrame([(f, i * 3) for i, f in enumerate(fps)], "fp long, id long")
    want = components({i * 3: f % 2**64 for i, f in enumerate(fps)})
    for rows in (1000, 3, 0.01):  # whole groups, some pivots, as many as there are
        found = {r.id: r.component for r in simhash.connected_components(simhash.links(table, rows)).collect()}
        assert {i: found.get(i, i) for i in want} == want


def test_each_link_comes_once(spark):
    fps = np.arange(1, 3000)  # consecutive numbers: a dense group, split by as many pivots as there are
    near = np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1)
    table = spark.createDataFrame([(int(f), int(f) * 5) for f in fps], "fp long, id long")
    for rows in (simhash.CELL_ROWS, 1000, 3):
        found = [tuple(sorted((r.src // 5, r.dst // 5))) for r in simhash.links(table, rows).collect()]
        assert len(found) == near.sum() == 103883 and set(found) == {(int(fps[i]), int(fps[j])) for i, j in zip(*near.nonzero(), strict=True)}


def test_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again"
    rows = spark.createDataFrame([(5, text, 1), (3, text.upper(), 2), (3, text, 2), (None, text, 3), (8, None, 4), (9, "", 5), (7, "other words altogether here", 6)], "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()}
    assert got == {(5, 3), (3, 3), (None, None), (8, 8), (9, 8), (7, 7)}
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)]
    found = {r.id: r.component for r in simhash.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert {found[i] for i in range(301)} == {0} and {found[1000 + i] for i in range(200)} == {1000}


def test_similar_texts_link_exactly(spark):
    rng = np.random.default_rng(9)
    texts = {}
    for base in range(12):
        words = [f"w{base}x{k}" for k in range(int(rng.integers(60, 200)))]
        for _ in range(14):  # copies, near copies on both sides of 4/5, and chains of them
            texts[len(texts)] = " ".join(words)
            if rng.random() < 0.9:
                words = list(words)
                for k in rng.integers(0, len(words), int(rng.integers(1, 6))):
                    words[k] = f"new{len(texts)}x{k}"
    texts |= {900: None, 901: " ", 902: "two words", 903: "Two  WORDS", 904: "one two three four five"}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for i, t in texts.items()}
    near = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    group = {i: i for i in texts}
    find = lambda x: x if group[x] == x else find(group[x])
    for i, j in near:
        x, y = sorted((find(i), find(j)))
        group[y] = x
    fps = {i: simhash.fingerprint(t) % 2**64 for i, t in texts.items()}
    assert any((fps[i] ^ fps[j]).bit_count() > 2 for i, j in near) and 20 < len({find(i) for i in texts}) < 100
    rows = spark.createDataFrame([*texts.items()], "id long, text string")
    found = {r.id: r.component for r in similar.components(rows).collect()}
    assert {i: found.get(i, i) for i in texts} == {i: find(i) for i in texts}
    assert similar.components(rows.limit(0)).count() == 0
    joined = similar.components(rows, spark.createDataFrame([(900, 904)], 'src long, dst long'))
    assert joined.where('id = 904').first().component == 900


@pytest.mark.parametrize("outsiders", [similar.OUTSIDERS, 0])
def test_heavily_changed_copies_are_compared_by_their_changes(spark, monkeypatch, outsiders):
    rng = np.random.default_rng(21)
    base = [f"w{k}" for k in range(146)]
    texts, made = [], {}
    for _ in range(500):  # most further than 4/5 from each other, some beside one that is changed as much, some without the base
        words = list(texts[int(rng.integers(0, len(texts)))] if texts and rng.random() < 0.1 else base)
        for k in rng.integers(0, len(words), int(rng.choice([2, 3, 4, 4, 4, 5, 7]))):
            words[k : k + 1] = [f"new{rng.integers(0, 40)}"] * int(rng.integers(0, 3))
        texts.append(words if rng.random() < 0.95 else [f"own{len(texts)}x{k}" for k in range(len(words) // 8)] + words[: len(words) * 4 // 5])
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    group = list(range(len(sets)))
    find = lambda x: x if group[x] == x else find(group[x])
    for j, b in enumerate(sets):
        for i, a in enumerate(sets[:j]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                group[y] = x
    want = [find(i) for i in range(len(sets))]
    monkeypatch.setattr(similar, "OUTSIDERS", outsiders)
    monkeypatch.setattr(similar, "materialise", lambda df, tag, write=similar.materialise: made.setdefault(tag, write(df, tag)) if tag == "similar-untried" else write(df, tag))
    found = {r.id: r.component for r in similar.components(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, text string")).collect()}
    assert [found.get(i, i) for i in range(len(sets))] == want and 100 < len(set(want)) < 400
    assert made["similar-untried"].count() < 5 * len(sets)


@pytest.mark.parametrize("each", [8, 0])
def test_texts_that_quote_one_passage_are_not_unfolded(spark, monkeypatch, each):
    rng = np.random.default_rng(5)
    passage, texts, made = [f"quoted{k}" for k in range(14)], [], {}
    for i, n in enumerate(np.geomspace(60, 5000, 60).astype(int)):
        words = [f"w{rng.integers(0, 10**9)}" for _ in range(n)]
        texts += [words[: n // 2] + passage + words[n // 2 :]] * (1 + (i in (20, 30)))
    for i in (21, 32):  # a word changed, one added
        texts[i] = ["first", *texts[i][:-1], "last"]
    monkeypatch.setattr(similar, "SAMPLE_DOCS", 0)  # as where the sample misses the passage
    monkeypatch.setattr(similar, "PAIRS_EACH", each, raising=False)
    monkeypatch.setattr(similar, "materialise", lambda df, tag, write=similar.materialise: made.setdefault(tag, write(df, tag)) if tag in ("similar-changes", "similar-untried", "similar-open") else write(df, tag))
    found = similar.components(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, text string"))
    assert {(r.id, r.component) for r in found.collect()} == {(20, 20), (21, 20), (31, 31), (32, 31)}
    assert made["similar-open"].where("crowded").count() and made["similar-untried"].count() < 5 * len(texts)
    assert ("similar-changes" in made) == (not each)
    assert each or made["similar-changes"].count() < sum(map(len, texts)) // 50  # a fifth of all shingles when those of one set were written too


def quoting(rng, sizes, near):
    """Texts of random words that quote one passage, and after those numbered ``near`` a near copy."""
    passage, texts = [f"quoted{k}" for k in range(24)], []
    for i, n in enumerate(sizes):
        words = [f"w{rng.integers(0, 10**9)}" for _ in range(n)]
        texts.append(words[: n // 2] + passage + words[n // 2 :])
        if i in near:
            texts.append(["first", *texts[-1][:-1], "last"])
    return texts


def test_families_of_few_pairs_are_not_unfolded(spark, monkeypatch):
    texts, made = quoting(np.random.default_rng(6), np.full(60, 800), (20, 30)), {}
    monkeypatch.setattr(similar, "SAMPLE_DOCS", 0)
    monkeypatch.setattr(similar, "materialise", lambda df, tag, write=similar.materialise: made.setdefault(tag, write(df, tag)))
    found = similar.components(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, text string"))
    assert {(r.id, r.component) for r in found.collect()} == {(20, 20), (21, 20), (31, 31), (32, 31)}
    crowd = made["similar-open"].where("crowded").count()
    assert 8 * 62 < crowd * 30 and crowd < 62 * 20  # more than eight pairs a set, as all are of one size, and far fewer than 62 * 820 shingles
    assert "similar-changes" not in made


def test_shingles_that_the_sample_misses_do_not_crowd_prefixes(spark, monkeypatch):
    texts, made = quoting(np.random.default_rng(7), np.geomspace(150, 900, 60).astype(int), (20, 30)), {}
    monkeypatch.setattr(similar, "SAMPLE_DOCS", 0)
    monkeypatch.setattr(similar, "CROWD", 16, raising=False)
    monkeypatch.setattr(similar, "materialise", lambda df, tag, write=similar.materialise: made.setdefault(tag, write(df, tag)))
    found = similar.components(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "id long, text string"))
    assert {(r.id, r.component) for r in found.collect()} == {(20, 20), (21, 20), (31, 31), (32, 31)}
    assert made["similar-open"].where("crowded").count() == 0
    sets = [similar.shingle_set(" ".join(w)) for w in texts]
    whole = {r.id: (r.n, len(r.prefix), set(r.prefix) <= set(sets[r.id].tolist())) for r in made["similar-settled"].collect()}
    assert whole == {i: (len(s), len(s) - -(-4 * len(s) // 5) + 1, True) for i, s in enumerate(sets)}


def test_pipeline_drops_near_copies(spark):
    words = [f"w{k}" for k in range(100)]
    near = [*words[:50], "other", *words[51:]]
    assert ((simhash.fingerprint(" ".join(words)) ^ simhash.fingerprint(" ".join(near))) % 2**64).bit_count() > 2
    rows = [(7, " ".join(near)), (3, " ".join(words)), (9, " ".join(reversed(words))), (None, " ".join(words)), (3, " ".join(words)), (3, "another text of id three"), (None, None), (None, ""), (None, "no id, once more"), (None, "no id, once more")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.deduplicate(spark, table, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, "no id, once more"), (3, "another text of id three"), (3, " ".join(words)), (9, " ".join(reversed(words)))]
    assert corpus_pipeline.deduplicate(spark, table.limit(0), "").count() == 0
