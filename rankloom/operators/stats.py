"""Resampling and multiple comparison on short series of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform

STATISTICS = {"mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max}


def _statistic(statistic) -> Column:
    return (STATISTICS[statistic] if isinstance(statistic, str) else statistic)("x")


def resampled(data: DataFrame, statistic="mean", n_bootstrap: int = 1000, seed: int = 42, stream: str = "boot") -> DataFrame:
    """(b, stat) of resamples with replacement. data: (idx from 0, x); it is a series of results, so n is small.

    statistic: a name in STATISTICS, or a function from a column to an aggregate (a grouped pandas UDF, say).
    """
    n = data.count()
    spark = data.sparkSession
    if n == 0:
        return spark.createDataFrame([], "b long, stat double")
    draws = spark.range(n_bootstrap).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    picked = draws.select("b", F.floor(uniform(seed, stream, "b", "i") * n).cast("int").alias("idx")).join(data, "idx")
    return picked.groupBy("b").agg(_statistic(statistic).alias("stat"))


def bootstrap_interval(data: DataFrame, statistic="mean", n_bootstrap: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """One row (estimate, low, high): percentile interval; zeros without data."""
    tail = (1 - ci) / 2
    ends = resampled(data, statistic, n_bootstrap, seed).agg(F.percentile("stat", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return data.agg(_statistic(statistic).alias("e")).crossJoin(ends).select(zero(F.col("e")).alias("estimate"), zero(F.get("p", F.lit(0))).alias("low"), zero(F.get("p", F.lit(1))).alias("high"))


def bootstrap_difference(a: DataFrame, b: DataFrame, statistic="mean", n_bootstrap: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """One row (difference, low, high, significant): of a's statistic less b's, resampled independently."""
    tail = (1 - ci) / 2
    both = resampled(a, statistic, n_bootstrap, seed).join(resampled(b, statistic, n_bootstrap, seed, "bootb").withColumnRenamed("stat", "other"), "b")
    ends = both.agg(F.percentile(F.col("stat") - F.col("other"), F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    seen = a.agg(_statistic(statistic).alias("sa")).crossJoin(b.agg(_statistic(statistic).alias("sb")))
    low, high = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return seen.crossJoin(ends).select((F.col("sa") - F.col("sb")).alias("difference"), low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("significant"))


def bonferroni(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds threshold and rejected to (idx, p)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return tests.withColumn("threshold", F.lit(alpha) / n).withColumn("rejected", F.col("p") < F.col("threshold"))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds rank (from 1), threshold and rejected: rejection stops at the first test that fails."""
    every = Window.partitionBy(F.lit(0))
    ranked = tests.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("p", "idx"))).withColumn("__n", F.count(F.lit(1)).over(every))
    ranked = ranked.withColumn("threshold", F.lit(alpha) / (F.col("__n") - F.col("rank") + 1))
    failed = F.min(F.when(F.col("p") >= F.col("threshold"), F.col("rank"))).over(every)
    return ranked.withColumn("rejected", F.col("rank") < F.coalesce(failed, F.col("__n") + 1)).drop("__n")


def paired_permutation(pairs: DataFrame, n_permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """One row (observed, p_value, effect) of a sign-flip test on (idx from 0, a, b); the effect is 0 without spread.

    A null in one of the two means series of unequal length, which is an error.
    """
    checked = pairs.select("idx", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("series of unequal length"))).otherwise(F.col("a") - F.col("b")).cast("double").alias("d"))
    flips = pairs.sparkSession.range(n_permutations).select(F.col("id").alias("k")).crossJoin(checked)
    signed = F.when(uniform(seed, "perm", "k", "idx") < 0.5, -F.col("d")).otherwise(F.col("d"))
    means = flips.groupBy("k").agg(F.avg(signed).alias("m"))
    seen = checked.agg(F.avg("d").alias("observed"), F.stddev_pop("d").alias("sd"))
    # Sums of doubles depend on their order, so equal means are told apart only beyond rounding.
    far = F.avg((F.abs("m") >= F.abs("observed") - 1e-12).cast("double"))
    return means.crossJoin(seen).groupBy("observed", "sd").agg(far.alias("p_value")).select("observed", "p_value", F.when(F.col("sd") == 0, 0.0).otherwise(F.col("observed") / F.when(F.col("sd") != 0, F.col("sd"))).alias("effect"))


def sample_efficiency(successes: DataFrame, total_rounds: int, threshold: float = 0.95) -> DataFrame:
    """One row: the first round (from 1) at which the share of successful rounds so far reaches the threshold, or null.

    successes: (round from 0), rounds beyond the total count for nothing.
    """
    from ..functions.running import running_sums

    rounds = successes.sparkSession.range(total_rounds).select(F.col("id").alias("round"))
    marks = rounds.join(successes.select("round").distinct().withColumn("hit", F.lit(1)), "round", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    sums = running_sums(marks, "round", {"hits": "hit"})
    return sums.agg(F.min(F.when(F.col("hits") >= F.lit(threshold) * (F.col("round") + 1), F.col("round") + 1)).alias("first_round"))
