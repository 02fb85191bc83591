"""Quality rules whose cutoffs are chosen under control of false rejections.

Every rule compares one measure of a text with a cutoff. Labelled rows are dealt into two parts by a hash of doc_id. The first part (``DESIGN``) only proposes:
a sequence of joint cutoffs, one per rule, from loose to strict, such that each step rejects all that the step before it rejects. The holdout then tests the steps in
this order in every stratum: a step is valid while the exact (Clopper-Pearson) upper bound on the share of good texts that *any* of its rules rejects stays within
``MAX_FALSE``; the first failure ends the stratum's tests (a fixed sequence, so the steps share one error rate). The error rate ``DELTA`` is divided among the strata
(Bonferroni). So with probability 1 - DELTA, in every stratum at once, the rules together reject at most ``MAX_FALSE`` of the good texts that pass the base rules.
Of the valid steps the one that best separates bad from good is used, if any separates. With four strata, 72 good holdout rows of which none is rejected
suffice; a stratum with fewer has no valid step and keeps its texts.

The base rules always reject: fewer than 20 words, or more than 30 % of the words in repeated windows.

Null and empty texts have no words and fail the base rules. A null stratum is a stratum of its own. Repeated labels of a document count
as bad if any is. Repeated rows and null doc_ids keep their own rows. Without labels only the base rules reject. Empty tables give an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .textstats import COUNTS, text_statistics

MAX_FALSE = 0.05
DELTA = 0.1
BINS = 50
#: A cutoff must reject this many times as large a share of the bad as of the good.
MIN_LIFT = 5.0
#: Share of labelled rows, in 64ths of a hash of doc_id, that propose the sequence of joint cutoffs; the others test it.
DESIGN = 20
#: Shares of the first part's good texts that a rule's cutoff may reject at each step of the sequence.
STEPS = (0.0, 0.002, 0.005, 0.01, 0.02)

#: rule: (count, of which total, largest value of the grid); high shares are bad. The grid has BINS even steps.
RULES: dict[str, tuple[str, str, float]] = {
    "symbols": ("n_symbols", "n_words", 2.0),
    "upper": ("n_upper", "word_chars", 1.0),
    "marked": ("n_marked", "n_words", 1.0),
    "piped": ("n_piped", "n_words", 1.0),
    "dup_lines": ("n_dup_lines", "n_lines", 1.0),
    "repeats": ("n_repeat_words", "n_words", 0.3),
    "sameness": ("n_words - n_unique", "n_words", 1.0),
}


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, by the continued fraction of the incomplete beta function: exact, and constant in k and n."""
    if k >= n or p <= 0:
        return 1.0
    if p >= 1:
        return 0.0

    def beta(x: float, a: float, b: float) -> float:
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(1 - x, b, a)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
        for i in range(2000):
            m = i // 2
            num = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
            if abs(1 - c * d) < 1e-13:
                break
        return front * (f - 1)

    return beta(1 - p, n - k, k + 1)


def upper_bound(k: int, n: int, error: float) -> float:
    """Clopper-Pearson: the largest rate under which k or fewer of n still has probability ``error``."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if binomial_cdf(k, n, p) > error else (low, p)
    return high


def cutoff(good: list[int], bad: list[int], error: float, limit: float) -> int | None:
    """The place in a sequence from which texts are rejected, given counts of good and bad texts by place; None: none is.

    Tests run from the last place, the loosest step, down. The bound only grows with the number rejected, so the last valid count is found once.
    """
    n, m, k, j, best, found = sum(good), sum(bad), 0, 0, 0.0, None
    if not n or not m:
        return None
    for at in range(len(good) - 1, 0, -1):
        k, j = k + good[at], j + bad[at]
        if k > limit * n or upper_bound(k, n, error) > limit:
            break
        gain = j / m - MIN_LIFT * k / n
        if gain > best + 1e-12:
            best, found = gain, at
    return found


def _bin(name: str) -> Column:
    part, whole, top = RULES[name]
    share = F.least(F.expr(f"try_divide({part}, {whole})") / top, F.lit(1.0))
    return F.coalesce(F.floor(share * BINS).cast("int"), F.lit(0))


def proposal(good: dict[str, list[int]], bad: dict[str, list[int]]) -> list[dict[str, int]]:
    """Joint cutoffs for every step, from loose to strict: a rule takes part from the first step on at which some cutoff of it rejects no larger share
    of the good than the step allows and MIN_LIFT times that share of the bad. Within a step the lowest such bin that holds bad texts is taken, and cutoffs never rise again.
    """
    out: list[dict[str, int]] = []
    for share in STEPS:
        step = dict(out[-1]) if out else {}
        for rule in RULES:
            n, m, k, j = sum(good[rule]), sum(bad[rule]), 0, 0
            for at in range(BINS, 0, -1):
                k, j = k + good[rule][at], j + bad[rule][at]
                if k > share * n:
                    break
                if bad[rule][at] and j * n > MIN_LIFT * k * m:
                    step[rule] = min(at, step.get(rule, at))
        out.append(step)
    return out


def cutoffs(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, one column per rule): the chosen bins, from rows with stratum, base_failed and a bin per rule.

    Only counts by rule and bin (``len(RULES)`` times BINS + 1 rows, whatever the input) pass through the driver.
    """
    truth = labels.select(F.col("doc_id").cast("long"), "quality").where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = measured.where("not base_failed").join(truth, "doc_id").select("stratum", "quality", in_design(F.col("doc_id")).alias("design"), *[f"bin_{r}" for r in RULES])
    rows = materialise(rows, "quality-labelled")
    counts = F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad")
    long = rows.where("design").select("quality", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"bin_{r}").alias("bin")) for r in RULES])))
    good, bad = ({r: [0] * (BINS + 1) for r in RULES} for _ in range(2))
    for rule, at, n, m in long.groupBy("rule", "bin").agg(*counts).collect():
        good[rule][at], bad[rule][at] = n, m
    steps = proposal(good, bad)

    # A row's place in the sequence: the number of steps that reject it. As steps are nested, these are the last ones.
    place = F.lit(0)
    for step in steps:
        place = place + F.when(_any_rejects({r: F.lit(at) for r, at in step.items()}), 1).otherwise(0)
    tested = materialise(rows.where("not design").groupBy("stratum", place.alias("place")).agg(*counts), "quality-counts")
    error = DELTA / max(1, tested.select("stratum").distinct().count())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        of = pdf.set_index("place")
        at = cutoff(*(of[c].reindex(range(len(steps) + 1), fill_value=0).tolist() for c in ("good", "bad")), error, MAX_FALSE)
        step = {} if at is None else steps[len(steps) - at]
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], **{r: [step.get(r)] for r in RULES}}).astype(dict.fromkeys(RULES, "Int32"))

    schema = "stratum string, " + ", ".join(f"{r} int" for r in RULES)
    return materialise(tested.groupBy("stratum").applyInPandas(choose, schema), "quality-cutoffs")


def in_design(doc_id: Column) -> Column:
    """Whether a labelled row proposes cutoffs; the others test them."""
    return F.pmod(F.xxhash64(doc_id), F.lit(64)) < DESIGN


def _any_rejects(bins: dict[str, Column]) -> Column:
    """Whether any rule rejects a row; a null cutoff rejects nothing."""
    out = F.lit(False)
    for rule, at in bins.items():
        out = out | F.coalesce(F.col(f"bin_{rule}") >= at, F.lit(False))
    return out


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, the contract's counts, base_failed and kept of every row."""
    rows = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("null")).alias("stratum"))
    stats = materialise(text_statistics(rows, "stratum"), "quality-stats")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    measured = stats.withColumns({"base_failed": failed, **{f"bin_{r}": _bin(r) for r in RULES}})
    chosen = cutoffs(measured, labels)
    out = measured.join(chosen, "stratum", "left")
    rejected = _any_rejects({r: F.col(r) for r in RULES})
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
