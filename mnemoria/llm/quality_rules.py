"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects a document when a ratio reaches a cutoff. Cutoffs are not
chosen by hand. One half of the labelled holdouts, by hash, designs a path for
each stratum: from no rule on, step by step, the cutoff is tightened that
catches most bad documents for the good ones it loses. The other half tests
the path: in its order, with an exact binomial bound on the share of good
documents that all cutoffs so far reject together, until the first step that
fails. The path is fixed before its test, so each test has the whole error
level of its stratum (fixed-sequence testing); the level is divided over
strata only. With probability 1 - ``delta``, no stratum loses more than
``alpha`` of those good documents that pass the base rules. Where labels are
too few to certify a step, no rule is on.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import docstats
from .common import drop_table, plain, replacing, write_table

#: Cutoffs are multiples of 1 / STEPS, up to TOP.
STEPS, TOP = 200, 400
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "capitals": ("n_upper", "n_letters"),
    "bangs": ("n_bangs", "n_words"),
    "pipes": ("n_pipes", "n_words"),
}
#: A place on the path that no document reaches.
NEVER = 1 << 30


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials of probability p: the regularised incomplete beta function I(1 - p; n - k, k + 1)."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    """The incomplete beta function by its continued fraction, evaluated from the front (Lentz)."""
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    value = d
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + term * d or 1e-300), 1 + term / c or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def design(good: np.ndarray, bad: np.ndarray) -> list[tuple[int, int]]:
    """The path [(rule, cutoff), ...] from (rules, bins) histograms: each step takes the rule and cutoff that catch most for what they lose."""
    lost, caught = (np.cumsum(x[:, ::-1], 1)[:, ::-1] for x in (good, bad))
    now, path = np.full(len(good), TOP + 1), []
    while True:
        best, step = 0.0, None
        for r, cut in enumerate(now):
            have = (lost[r, cut], caught[r, cut]) if cut <= TOP else (0, 0)
            gain = (caught[r, 1:cut] - have[1]) / (lost[r, 1:cut] - have[0] + 1.0)
            if len(gain) and gain.max() > best:
                at = len(gain) - 1 - int(np.argmax(gain[::-1]))  # the most lenient of equals
                best, step = float(gain[at]), (r, at + 1)
        if step is None:
            return path
        now[step[0]] = step[1]
        path.append(step)


def certified(lost: np.ndarray, n: int, alpha: float, level: float) -> int:
    """How many steps of a path hold: ``lost[i]`` of ``n`` good documents are rejected by the first i + 1 steps together."""
    for i, k in enumerate(lost):
        if k > alpha * n or binomial_cdf(int(k), n, alpha) > level:
            return i
    return len(lost)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bin(top: str, bottom: str) -> Column:
    return F.least(F.floor(F.col(top) * STEPS / F.greatest(F.col(bottom), F.lit(1))), F.lit(TOP)).cast("int")


def _reached(rule: str) -> Column:
    """The first place on the path whose cutoff for ``rule`` the row reaches."""
    return F.coalesce(F.get(F.col(f"__at_{rule}"), _bin(*RULES[rule])), F.lit(NEVER))


def fit_paths(stats: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, stratum: str = "stratum") -> DataFrame:
    """(stratum, steps, __at_<rule> ...) from labelled documents that pass the base rules; labels: doc_id, quality (1 good, 0 bad).

    ``steps`` of a stratum's path are certified; __at_<rule> has, for each bin
    of the rule's ratio, the first step that rejects it. What reaches a task is
    a stratum's histogram: rules * bins numbers.
    """
    held = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.filter(~base_failed()).join(held, "doc_id").withColumn("__tests", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 1)
    rows, row_path = write_table(rows.select("doc_id", stratum, "quality", "__tests", *{x for r in RULES.values() for x in r}), "rules-labelled")
    rules = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), _bin(*x).alias("bin")) for i, x in enumerate(RULES.values())])).alias("r")
    hist = rows.filter("not __tests").select(stratum, "quality", rules).groupBy(stratum, "r.rule", "r.bin").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))

    def paths(own: pd.DataFrame) -> pd.DataFrame:
        good, bad = np.zeros((len(RULES), TOP + 1), np.int64), np.zeros((len(RULES), TOP + 1), np.int64)
        np.add.at(good, (own["rule"], own["bin"]), own["good"])
        np.add.at(bad, (own["rule"], own["bin"]), own["bad"])
        at = np.full((len(RULES), TOP + 1), NEVER)
        path = design(good, bad)
        for i, (rule, cut) in enumerate(path):
            at[rule, cut:] = np.minimum(at[rule, cut:], i)
        return pd.DataFrame({stratum: own[stratum].iloc[:1], "length": [len(path)], **{f"__at_{r}": [at[i]] for i, r in enumerate(RULES)}})

    schema = f"{stratum} string, length int, " + ", ".join(f"__at_{r} array<int>" for r in RULES)
    found, path_path = write_table(hist.groupBy(stratum).applyInPandas(paths, schema), "rules-paths")
    good = rows.filter("__tests and quality = 1").join(found, stratum).select(stratum, "length", F.least(*map(_reached, RULES)).alias("step"))
    counts = good.groupBy(stratum, "length", "step").agg(F.count("*").alias("n"))
    strata = max(1, found.count())

    def tests(own: pd.DataFrame) -> pd.DataFrame:
        length = int(own["length"].iloc[0])
        lost = np.zeros(length, np.int64)
        some = own["step"] < length
        np.add.at(lost, own["step"][some], own["n"][some])
        return pd.DataFrame({stratum: own[stratum].iloc[:1], "steps": [certified(np.cumsum(lost), int(own["n"].sum()), alpha, delta / strata)]})

    steps, steps_path = write_table(counts.groupBy(stratum).applyInPandas(tests, f"{stratum} string, steps int"), "rules-steps")
    out, _ = write_table(found.drop("length").join(steps, stratum), "rules")
    for path in (row_path, path_path, steps_path):
        drop_table(stats.sparkSession, path)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.03, delta: float = 0.05, stratum: str = "lang") -> DataFrame:
    """The columns of ``docs`` but text, the counts of its text, base_failed, rejected_by (rule names) and kept.

    A document is kept unless it fails the base rules or a certified cutoff of
    its stratum. Null and empty texts have no words and so fail the base rules;
    texts of any length are counted whole; a null stratum is one of its own;
    strata without labels have no cutoffs; repeated rows are judged alike, and
    equal ratios too; a document labelled twice counts as bad if it is once; an
    empty table gives an empty one; input columns with the added names give
    way, others may have any name.
    """
    docs = replacing(docs, *docstats.NAMES, "base_failed", "rejected_by", "kept")
    inner, names = plain(docs, "doc_id", "text")
    of = next((c for c, n in names.items() if n == stratum), None)
    own = F.coalesce(F.col(of).cast("string"), F.lit("")) if of else F.lit("")
    stats, _ = write_table(docstats.with_stats(inner.withColumn("__stratum", own)), "quality-stats")
    cuts = fit_paths(stats, labels, alpha, delta, "__stratum")
    # a row for each stratum; by a shuffle where those are many
    out = stats.join(F.broadcast(cuts) if cuts.count() <= 1000 else cuts, "__stratum", "left").withColumn("base_failed", base_failed())
    hits = F.array(*[F.when(_reached(r) < F.coalesce("steps", F.lit(0)), F.lit(r)) for r in RULES])
    out = out.withColumn("rejected_by", F.array_compact(hits))
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return out.select(*[F.col(c).alias(n) for c, n in names.items() if c != "text"], *docstats.NAMES, "base_failed", "rejected_by", kept.alias("kept"))
