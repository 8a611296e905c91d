"""Scoring of predictions: grouped confusion counts, exact paired test, cluster bootstrap, weighted rule scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import spread


def scores(df: DataFrame, by: list[str], truth: Column, said: Column) -> DataFrame:
    """tp, fp, fn, tn, precision and recall per group; groups are never pooled. A rate without cases is null."""
    t, s = F.coalesce(truth, F.lit(False)), F.coalesce(said, F.lit(False))
    g = df.groupBy(*by).agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    return g.withColumn("precision", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6))


def exact_mcnemar(only_a: int, only_b: int) -> float:
    """Two-sided exact p-value of discordant pairs, by a binomial tail in log space; 1 without any."""
    n, k = only_a + only_b, min(only_a, only_b)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in logs))


@F.pandas_udf(T.DoubleType())
def mcnemar_p(only_a: pd.Series, only_b: pd.Series) -> pd.Series:
    return pd.Series([exact_mcnemar(int(a), int(b)) for a, b in zip(only_a, only_b)])


def paired_comparison(df: DataFrame, by: list[str], a_right: Column, b_right: Column) -> DataFrame:
    """Discordant counts and exact p-value per group, for two systems judged on the same cases."""
    g = df.groupBy(*by).agg(F.count_if(a_right & ~b_right).alias("only_a"), F.count_if(~a_right & b_right).alias("only_b"))
    return g.withColumn("p_value", F.round(mcnemar_p("only_a", "only_b"), 8))


#: P(X <= k) of a Poisson variable of mean one.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def _poisson(hashes: np.ndarray, draws: int) -> np.ndarray:
    """A Poisson(1) weight per hash and draw, by a 64-bit mixing function of both, all at once."""
    x = hashes.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, draws + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(_POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def cluster_bootstrap(df: DataFrame, cluster: str, value: Column, draws: int = 400, seed: int = 11, level: float = 0.95) -> DataFrame:
    """(estimate, low, high): mean of ``value`` with bounds from resampled clusters.

    Each cluster is reduced to its sum and count, and gets a Poisson(1) weight per draw from its own hash, so that all draws
    are one aggregate over clusters and need no cluster list on the driver.
    """
    per = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n")).withColumn("h", F.xxhash64(F.lit(seed), F.col(cluster)))

    def resample(batches):
        total = np.zeros((2, draws + 1))
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.iloc[at : at + 2048]
                w = np.ones((len(part), draws + 1))
                w[:, 1:] = _poisson(part["h"].to_numpy(), draws)
                total += np.stack([part["s"].fillna(0).to_numpy(dtype=float), part["n"].to_numpy(dtype=float)]) @ w
        yield pd.DataFrame({"draw": np.arange(draws + 1), "s": total[0], "n": total[1]})

    sums = spread(per.select("s", "n", "h")).mapInPandas(resample, "draw int, s double, n double").groupBy("draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = sums.select("draw", F.try_divide("s", "n").alias("m"))
    tail = (1 - level) / 2
    q = lambda p: F.round(F.expr(f"percentile(CASE WHEN draw > 0 THEN m END, {p})"), 6)
    return means.agg(F.round(F.max(F.when(F.col("draw") == 0, F.col("m"))), 6).alias("estimate"), q(tail).alias("low"), q(1 - tail).alias("high"))


def weighted_rules(df: DataFrame, text: Column, rules: list[tuple[str, str, float]]) -> DataFrame:
    """Add one column per dimension: the sum of weights of the rules (dimension, pattern, weight) that match the text."""
    out = df
    for d in dict.fromkeys(r[0] for r in rules):
        score = F.lit(0.0)
        for _, pattern, weight in [r for r in rules if r[0] == d]:
            score = score + F.when(F.rlike(text, F.lit(pattern)), F.lit(weight)).otherwise(F.lit(0.0))
        out = out.withColumn(d, score)
    return out


def weighted_verdict(df: DataFrame, text: Column, rules: list[tuple[str, str, float]], thresholds: dict[str, float], learnt: dict[str, float] | None = None) -> DataFrame:
    """``df`` with a score per dimension and ``excluded_by``: the first dimension, in the order of the rules, whose score reaches its
    threshold. ``learnt`` adds to the weights of rules by pattern."""
    learnt = learnt or {}
    out = weighted_rules(df, text, [(d, p, w + learnt.get(p, 0.0)) for d, p, w in rules])
    reason = F.lit(None).cast("string")
    for d in reversed([d for d in dict.fromkeys(r[0] for r in rules) if d in thresholds]):
        reason = F.when(F.col(d) >= thresholds[d], d).otherwise(reason)
    return out.withColumn("excluded_by", reason)


def filter_list(df: DataFrame, name: Column, size: Column, extensions: Column, paths: Column, group: Column, allow: list[str] = (), least: int = 0, most: int = 0, blocked_extensions: list[str] = (), blocked_groups: list[str] = (), block: list[str] = ()) -> Column:
    """Why a list of rules excludes a row, null if it doesn't: an allowed name is never excluded; then size, extension, release group,
    name and path patterns, in this order. Zero sizes and empty lists switch a rule off."""
    any_of = lambda c, patterns: c.rlike("|".join(f"(?:{p})" for p in patterns))
    bare = [e.lower().lstrip(".") for e in blocked_extensions]
    tests = [
        (any_of(name, allow) if allow else None, None), ((size > 0) & (size < least) if least else None, "below_min_size"), (size > most if most else None, "above_max_size"),
        (F.exists(extensions, lambda e: F.regexp_replace(F.lower(F.trim(e)), r"^\.", "").isin(*bare)) if bare else None, "blocked_extension"), (F.lower(group).isin(*[g.strip().lower() for g in blocked_groups]) if blocked_groups else None, "blocked_release_group"),
        (any_of(name, block) if block else None, "block_pattern_matched"), (F.exists(paths, lambda p: any_of(p, block)) if block else None, "block_file_pattern_matched"),
    ]
    out = F.lit(None).cast("string")
    for test, reason in reversed([t for t in tests if t[0] is not None]):
        out = F.when(test, F.lit(reason)).otherwise(out)
    return out
