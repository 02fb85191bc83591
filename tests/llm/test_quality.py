import re
from collections import Counter
from math import comb, floor

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import quality_gbt, quality_rules, textstats


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="ab #é\n\t\x85\x1c|", max_size=120) | st.text(max_size=40))
def test_counts_equal_brute_force(text):
    assert textstats.statistics(text)[:5] == brute(text)


def test_counts_of_edges():
    for text in (None, "", "\n\n", "a b c d e f g h " * 5, "x\n" * 9, "word"):
        assert textstats.statistics(text)[:5] == brute(text)


def test_bound_is_the_exact_one():
    for k, n, e in ((0, 50, 0.05), (3, 40, 0.01), (20, 60, 0.2)):
        p = quality_rules.upper_bound(k, n, e)
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - e) < 1e-9


def test_cutoffs_need_evidence():
    assert quality_rules.cutoff([20, 0, 0], [0, 0, 9], 0.01, 0.02) is None  # too few good texts to be sure
    assert quality_rules.cutoff([2000, 0, 0], [0, 0, 9], 0.01, 0.02) == 2
    assert quality_rules.cutoff([1000, 1000, 0], [0, 0, 9], 0.01, 0.02) == 2
    assert quality_rules.cutoff([], [], 0.01, 0.02) is None


def test_rules_on_rows(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good + f" tail{i}", "en", 0) for i in range(1500)] + [(2000 + i, " ".join(f"w{i}{j}###" for j in range(40)), "en", 0) for i in range(50)] + [(None, None, None, 0), (9000, "short", "xx", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(i, int(i < 2000)) for i, *_ in rows if i is not None] + [(1, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert all(got[i].kept for i in range(1500)) and not any(got[2000 + i].kept or got[2000 + i].base_failed for i in range(50))
    assert got[None].base_failed and not got[9000].kept
    assert quality_rules.judge(docs, labels.limit(0)).where("kept").count() == 1550
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def plain_kept(texts, lang, quality):
    """Which texts stay, by a walk over plain lists."""
    at = {c: i for i, c in enumerate(textstats.COUNTS + textstats.MORE)}
    stats = {d: textstats.statistics(t) for d, t in texts.items()}
    base = {d: s[0] < 20 or 100 * s[4] > 30 * s[0] for d, s in stats.items()}
    bins = {}
    for d, s in stats.items():
        for rule, (part, whole, top) in quality_rules.RULES.items():
            n = s[at["n_words"]] - s[at["n_unique"]] if "-" in part else s[at[part]]
            bins[d, rule] = floor(min(n / s[at[whole]] / top, 1.0) * quality_rules.BINS) if s[at[whole]] else 0
    rows = [d for d in texts if d in quality and not base[d]]
    first = [d for d in rows if xxhash.xxh64_intdigest(d.to_bytes(8, "little", signed=True), 42) % 64 < quality_rules.DESIGN]
    good, bad = [d for d in first if quality[d] == 1], [d for d in first if quality[d] != 1]
    steps, step = [], {}
    for share in quality_rules.STEPS:
        for rule in quality_rules.RULES:
            hit = lambda ids, cut: sum(bins[d, rule] >= cut for d in ids)  # noqa: B023, E731
            fits = [c for c in range(1, quality_rules.BINS + 1) if any(bins[d, rule] == c for d in bad) and hit(good, c) <= share * len(good) and hit(bad, c) * len(good) > quality_rules.MIN_LIFT * hit(good, c) * len(bad)]
            if fits:
                step = step | {rule: min([*fits, step.get(rule, 99)])}
        steps.append(step)
    rejects = lambda d, s: any(bins[d, r] >= c for r, c in s.items())
    holdout = [d for d in rows if d not in first]
    strata = {lang[d] for d in holdout}
    chosen = dict.fromkeys(lang.values(), {})
    for one in strata:
        good, bad = ([d for d in holdout if lang[d] == one and (quality[d] == 1) == g] for g in (True, False))
        best = 0.0
        for s in steps:
            k, n = sum(rejects(d, s) for d in good), len(good)
            tail = sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1))
            if tail > quality_rules.DELTA / len(strata):  # k or fewer of n are too likely at a rate of 5 %
                break
            gain = sum(rejects(d, s) for d in bad) / max(1, len(bad)) - quality_rules.MIN_LIFT * k / max(1, n)
            if gain > best + 1e-12:
                best, chosen[one] = gain, s
    return {d: not base[d] and not rejects(d, chosen[lang[d]]) for d in texts}, chosen


def test_kept_equals_a_plain_walk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.collect()
    want, chosen = plain_kept({r.doc_id: r.text for r in rows}, {r.doc_id: r.lang for r in rows}, {r.doc_id: r.quality for r in labels.collect()})
    assert {r.doc_id: r.kept for r in quality_rules.judge(docs, labels).collect()} == want
    assert chosen["en"] and not all(want.values())
    # One language for all: a single stratum has enough labels, whatever it is called.
    one = docs.withColumn("lang", docs.source.isNull().cast("string"))
    want, chosen = plain_kept({r.doc_id: r.text for r in rows}, dict.fromkeys((r.doc_id for r in rows), "x"), {r.doc_id: r.quality for r in labels.collect()})
    assert chosen["x"] and {r.doc_id: r.kept for r in quality_rules.judge(one, labels).collect()} == want


def test_seventy_two_good_rows_suffice():
    error = quality_rules.DELTA / 4
    assert quality_rules.cutoff([71, 0], [0, 9], error, quality_rules.MAX_FALSE) is None
    assert quality_rules.cutoff([72, 0], [0, 9], error, quality_rules.MAX_FALSE) == 1


def test_the_guarantee_holds_in_simulation():
    rng = np.random.default_rng(1)
    error, steps = 0.1, np.array([0.94, 0.01, 0.01, 0.01, 0.015, 0.015])  # the last two steps reject 6 % and 4.5 % of the good, and so on
    missed = used = 0
    for _ in range(600):
        good = rng.multinomial(int(rng.integers(60, 900)), steps).tolist()
        at = quality_rules.cutoff(good, [5, 9, 9, 9, 9, 9], error, 0.05)
        used += at is not None
        missed += at is not None and steps[at:].sum() > 0.05
    assert used > 100 and missed <= 600 * error


def test_trees_learn_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    forest = quality_gbt.fit(x[:2000], y[:2000])
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    for row in x[2000:2020]:  # the vectorised walk equals a plain one
        b, total = forest.bins(row[None])[0], forest.base
        for f, c, v in zip(forest.feature, forest.cut, forest.leaf, strict=True):
            node = 0
            for _ in range(quality_gbt.DEPTH):
                node = 2 * node + 1 + int(b[f[node]] > c[node])
            total += v[node - len(f)]
        assert abs(forest.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_classifier_on_rows(spark):
    rows = [(i, f"plain words number {i} stand here in a row", 1) for i in range(200)] + [(1000 + i, f"JUNK!! {i}### $$$ ||| %%%", 0) for i in range(200)] + [(None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] is not None], "doc_id long, quality int")
    got = quality_gbt.score(docs, labels).collect()
    assert len(got) == 401 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out]
    assert held and all(r.predicted == int(r.doc_id < 1000) for r in held)
    assert len(quality_gbt.score(docs, labels.limit(0)).collect()) == 401
    assert quality_gbt.score(docs.limit(0), labels).count() == 0
    assert quality_gbt.score(docs, labels, train_rows=100).count() == 401
