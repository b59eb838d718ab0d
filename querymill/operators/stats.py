"""Paired comparison of two outcomes over the same questions: discordant counts, McNemar, bootstrap.

Spark reduces any number of questions to four counts. A bootstrap of the difference of two accuracies depends on
nothing else, so the resamples are multinomial draws from those counts and no question is joined to a resample.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paired_outcomes(pool: DataFrame, a: str, b: str) -> DataFrame:
    """(idx, a, b): whether each of two sources has a correct original; questions that both have."""
    own = pool.filter((F.col("repaired") == 0) & F.col("source").isin(a, b))
    per = own.groupBy("idx").agg(*[F.max(F.when(F.col("source") == s, F.col("correct"))).alias(n) for s, n in ((a, "a"), (b, "b"))])
    return per.filter("a IS NOT NULL AND b IS NOT NULL")


def discordant(outcomes: DataFrame) -> DataFrame:
    """One row: n, both, only_a, only_b, neither and the corrected chi-square."""
    c = outcomes.agg(F.count("*").alias("n"), F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
                     F.count_if(~F.col("a") & F.col("b")).alias("only_b"), F.count_if(~F.col("a") & ~F.col("b")).alias("neither"))
    d = F.col("only_a") + F.col("only_b")
    gap = F.abs(F.col("only_a") - F.col("only_b")) - 1  # squared: equal counts give 1 / n
    return c.withColumn("chi2", F.round(F.coalesce(F.try_divide((gap * gap).cast("double"), d), F.lit(0.0)), 6))


def mcnemar_p(chi2: float) -> float:
    return math.erfc(math.sqrt(chi2 / 2))


def mcnemar_exact(only_a: int, only_b: int) -> float:
    """Two-sided binomial p, at most 1.

    Summed from the largest term down, each from the one above it, until terms no longer count; so some tens of
    standard deviations are gone through, whatever the counts.
    """
    n, k = only_a + only_b, min(only_a, only_b)
    if n == 0:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    total = 0.0
    while term > total * 1e-18 and k >= 0:
        total += term
        term *= k / (n - k + 1)
        k -= 1
    return min(1.0, 2 * total)


def bootstrap(n: int, only_a: int, only_b: int, resamples: int = 10_000, seed: int = 42) -> tuple[float, float]:
    """The 2.5 % and 97.5 % points of the resampled accuracy difference a - b."""
    if n == 0:
        return 0.0, 0.0
    draws = np.random.default_rng(seed).multinomial(n, [only_a / n, only_b / n, 1 - (only_a + only_b) / n], size=resamples)
    diffs = np.sort((draws[:, 0] - draws[:, 1]) / n)
    return float(diffs[int(0.025 * resamples)]), float(diffs[min(resamples - 1, int(0.975 * resamples))])


def paired_report(outcomes: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: accuracies, difference, chi-square, both p values and the bootstrap interval."""
    r = discordant(outcomes).first()
    low, high = bootstrap(r.n, r.only_a, r.only_b, resamples, seed)
    acc = lambda k: k / r.n if r.n else 0.0
    row = (r.n, acc(r.both + r.only_a), acc(r.both + r.only_b), acc(r.only_a - r.only_b), r.chi2, mcnemar_p(r.chi2), mcnemar_exact(r.only_a, r.only_b), low, high)
    return outcomes.sparkSession.createDataFrame(
        [row], "n bigint, acc_a double, acc_b double, diff double, chi2 double, p_chi2 double, p_exact double, low double, high double")


def matrix_report(outcomes: DataFrame, pairs: Sequence[tuple[str, str]], resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row for each pair of systems; ``outcomes`` has (idx, system, correct), one row for each question and system.

    All pairs are counted in one pass over the questions; each is four counts for the driver.
    """
    names = sorted({x for p in pairs for x in p})
    wide = outcomes.filter(F.col("system").isin(*names)).groupBy("idx").agg(*[F.max(F.when(F.col("system") == n, F.col("correct"))).alias(n) for n in names])
    both = lambda a, b: F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()
    counted = wide.agg(*[c for k, (a, b) in enumerate(pairs) for c in (
        F.count_if(both(a, b)).alias(f"n{k}"), F.count_if(both(a, b) & F.col(f"`{a}`") & ~F.col(f"`{b}`")).alias(f"a{k}"),
        F.count_if(both(a, b) & ~F.col(f"`{a}`") & F.col(f"`{b}`")).alias(f"b{k}"), F.count_if(both(a, b) & F.col(f"`{a}`") & F.col(f"`{b}`")).alias(f"c{k}"))]).first()
    rows = []
    for k, (a, b) in enumerate(pairs):
        n, only_a, only_b, both_right = (counted[f"{x}{k}"] for x in ("n", "a", "b", "c"))
        low, high = bootstrap(n, only_a, only_b, resamples, seed)
        chi2 = (abs(only_a - only_b) - 1) ** 2 / (only_a + only_b) if only_a + only_b else 0.0
        share = lambda x: round(x / n, 6) if n else 0.0  # noqa: E731, B023
        rows.append((a, b, n, share(both_right + only_a), share(both_right + only_b), share(only_a - only_b), only_a, only_b, round(chi2, 6), mcnemar_p(chi2), mcnemar_exact(only_a, only_b), low, high))
    return outcomes.sparkSession.createDataFrame(
        rows, "a string, b string, n bigint, acc_a double, acc_b double, diff double, only_a bigint, only_b bigint, chi2 double, p_chi2 double, p_exact double, low double, high double")
