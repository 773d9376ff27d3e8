"""Intervals and tests on counts that Spark has added up."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z95 = 1.959963984540054
MIN_CLUSTERS = 20
MIN_DISCORDANT = 10
MAX_VERSIONS = 50


def wilson(k: Column, n: Column, z: float = Z95) -> Column:
    """struct(estimate, low, high) of k successes in n; NULL for n <= 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z), 2 * n)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n)) / scale
    return F.when(n > 0, F.struct(p.alias("estimate"), F.greatest(F.lit(0.0), centre - half).alias("low"), F.least(F.lit(1.0), centre + half).alias("high")))


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 10 on; to about 1e-12."""
    x = n.cast("double") + 1
    far = F.greatest(x, F.lit(10.0))
    series = (far - 0.5) * F.log(far) - far + 0.9189385332046727 + 1 / (12 * far) - 1 / (360 * F.pow(far, 3)) + 1 / (1260 * F.pow(far, 5)) - 1 / (1680 * F.pow(far, 7))
    return F.when(x < 10, F.log(F.factorial(F.least(n, F.lit(9)).cast("int")).cast("double"))).otherwise(series)


def binomial_two_sided(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c at one half; NULL without any.

    The smaller tail is summed from its largest term outwards, as far as terms
    matter: below e-40 of the first, nothing changes any more. The terms fall by
    k / (n - k + 1) and faster, so their number is at most some times the root of n.
    """
    n, m = (b + c).cast("double"), F.least(b, c).cast("double")
    first = log_factorial(n) - log_factorial(m) - log_factorial(n - m) - n * 0.6931471805599453
    terms = F.least(m, F.ceil(10 * F.sqrt(n)) + 10).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (m - i + 1) / (n - m + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.exp(first) * tail))


def mcnemar(pairs: DataFrame, a: str, b: str, *groups: str, at_least: int = MIN_DISCORDANT) -> DataFrame:
    """b (only the first right), c (only the second right), discordant, p_value and whether there are enough pairs to report it.

    ``p_value_ref`` is the p-value of the older formula, which sums the upper
    tail and so always is 1; it is kept for comparison. NULL without discordance.
    """
    left, right = F.col(a), F.col(b)
    out = pairs.filter(left.isNotNull() & right.isNotNull()).groupBy(*groups).agg(F.count("*").alias("n_pairs"), F.count_if(left & ~right).alias("b"), F.count_if(~left & right).alias("c"))
    out = out.withColumn("discordant", F.col("b") + F.col("c")).withColumn("p_value", binomial_two_sided(F.col("b"), F.col("c")))
    return out.withColumn("p_value_ref", F.when(F.col("discordant") > 0, F.lit(1.0))).withColumn("reported", F.col("discordant") >= at_least)


def holm(p: str, order: Sequence[str], *families: str):
    """A function that adds ``p_adjusted``: (m - rank) p, the running maximum in order of p, at most 1; NULL p are left out."""

    def run(df: DataFrame) -> DataFrame:
        known = F.col(p).isNotNull()
        by = Window.partitionBy(*families, known).orderBy(F.col(p), *order)
        rank = F.row_number().over(by)
        m = F.count(p).over(Window.partitionBy(*families, known))
        raised = df.withColumn("__raised", F.when(known, F.least(F.lit(1.0), (m - rank + 1) * F.col(p))))
        return raised.withColumn("p_adjusted", F.when(known, F.max("__raised").over(by.rowsBetween(Window.unboundedPreceding, 0)))).drop("__raised")

    return run


def version_pairs(scored: DataFrame, version: str, record: str, kind: str, correct: str) -> DataFrame:
    """Paired tests of all pairs of versions: overall (``kind`` NULL) and by kind, adjusted within a pair.

    Versions are few and become columns of one pivot by record, so that pairs of
    versions, not of records, are made. Only tests with enough discordant pairs
    have a p-value, and only these are the family of Holm's adjustment by kind.
    """
    names = sorted(r[0] for r in scored.select(version).distinct().limit(MAX_VERSIONS + 1).collect())
    if len(names) > MAX_VERSIONS:
        raise ValueError(f"more than {MAX_VERSIONS} versions")
    wide = scored.groupBy(record, kind).pivot(version, names).agg(F.bool_and(correct))
    pairs = [F.struct(F.lit(a).alias("version_a"), F.lit(b).alias("version_b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]]
    if not pairs:
        raise ValueError("two versions are needed")
    each = wide.select(kind, F.inline(F.array(*pairs)))
    overall = mcnemar(each, "x", "y", "version_a", "version_b").withColumn(kind, F.lit(None).cast(each.schema[kind].dataType))
    by_kind = mcnemar(each, "x", "y", "version_a", "version_b", kind)
    tests = overall.unionByName(by_kind).withColumn("p_value", F.when(F.col("reported"), F.col("p_value")))
    family = F.when(F.col(kind).isNotNull(), F.col("p_value"))
    adjusted = holm("__family", [kind], "version_a", "version_b")(tests.withColumn("__family", family))
    return adjusted.select("version_a", "version_b", kind, "n_pairs", "b", "c", "discordant", "p_value", "p_adjusted", "reported")


def cluster_bootstrap(df: DataFrame, group: str, cluster: str, correct: str, resamples: int = 2000) -> DataFrame:
    """95% percentile interval of accuracy by resampling whole clusters.

    Spark adds up each cluster first, so that a group's resampling works on one
    row a cluster. The seed comes from the group and its cluster names in string
    order, and draws follow each other, so that the ends are the reference's;
    rows without a cluster name don't count for anything, and fewer than
    ``MIN_CLUSTERS`` clusters give a NULL interval.
    """
    named = F.col(cluster).isNotNull() & (F.col(cluster).cast("string") != "")
    sums = df.filter(F.col(correct).isNotNull() & named).groupBy(group, cluster).agg(F.count("*").alias("n"), F.count_if(F.col(correct)).alias("k"))
    schema = f"{group} string, n_clusters long, estimate double, low double, high double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(cluster, key=lambda x: x.astype(str))
        name, m = str(rows[group].iloc[0]), len(rows)
        n, k = rows["n"].tolist(), rows["k"].tolist()
        estimate = sum(k) / sum(n)
        if m < MIN_CLUSTERS:
            return pd.DataFrame([[name, m, estimate, None, None]], columns=[group, "n_clusters", "estimate", "low", "high"])
        seed = int(hashlib.sha256(f"{name}|{'|'.join(map(str, rows[cluster]))}".encode()).hexdigest()[:16], 16)
        draw = random.Random(seed)
        means = []
        for _ in range(resamples):
            picks = [draw.randrange(m) for _ in range(m)]
            means.append(sum(k[i] for i in picks) / sum(n[i] for i in picks))
        means.sort()
        low, high = (means[int(q * (resamples - 1))] for q in (0.025, 0.975))
        return pd.DataFrame([[name, m, estimate, low, high]], columns=[group, "n_clusters", "estimate", "low", "high"])

    return sums.withColumn(group, F.col(group).cast("string")).groupBy(group).applyInPandas(run, schema)


@F.udf(T.DoubleType())
def python_round(value, digits):
    """Rounding of the exact binary value, half to even; for aggregated rows."""
    return None if value is None else round(value, digits)
