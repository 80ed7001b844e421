"""Ranking arms as windows, pools of arms as data, and the table of precomputed rankings.

Every ranking orders a query's documents by a score, highest first, and ties by document. An arm is a name and a score
column over (query_id, doc, rel, features).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform

#: Grids of the boosted ranker's settings (fixed values): depths, trees, learning rates, row and column shares.
GRIDS = {
    "medium": ([3, 6, 10], [50, 100], [0.05, 0.1, 0.2], [1.0], [1.0]),
    "full": ([3, 5, 6, 8, 10], [50, 100], [0.05, 0.1, 0.2], [0.7, 1.0], [0.7, 1.0]),
}
BASE_ARMS = ("random", "single_feature", "linucb", "linear_ts")
SMALL_POOL = ("random", "single_feature", "xgboost", "linucb")


def by_feature(index: int = 0, descending: bool = True) -> Column:
    score = F.col("features")[index]
    return score if descending else -score


def by_relevance() -> Column:
    return F.col("rel").cast("double")


def by_chance(seed: int = 42) -> Column:
    return uniform(seed, "rand", "query_id", "doc")


def event_arms() -> dict[str, Column]:
    """Four arms over documents with features [value, k, doc, hour]."""
    return {"value": by_feature(0), "k": by_feature(1), "recent": by_feature(2), "oracle": by_relevance()}


def ranked(docs: DataFrame, arms: dict[str, Column]) -> DataFrame:
    """(query_id, arm, doc, rel, pos), positions from 1: one pass over the documents, one window for all arms."""
    scores = F.array(*[F.struct(F.lit(a).alias("arm"), s.cast("double").alias("score")) for a, s in arms.items()])
    rows = docs.select("query_id", "doc", "rel", F.inline(scores))
    place = Window.partitionBy("query_id", "arm").orderBy(F.desc("score"), "doc")
    return rows.select("query_id", "arm", "doc", "rel", F.row_number().over(place).alias("pos"))


def listed(rankings: DataFrame) -> DataFrame:
    """(query_id, arm, ranking array<int>)."""
    order = F.array_sort(F.collect_list(F.struct("pos", "doc")))
    return rankings.groupBy("query_id", "arm").agg(order.alias("o")).select("query_id", "arm", F.expr("transform(o, x -> cast(x.doc as int))").alias("ranking"))


def boosted_grid(spark: SparkSession, size: str) -> DataFrame:
    """(ord, arm, depth, trees, rate, rows_share, columns_share): the settings' product, in order."""
    rows = []
    for i, (depth, trees, rate, share, columns) in enumerate(product(*GRIDS[size])):
        name = f"xgb_d{depth}_n{trees}_lr{int(rate * 100)}" + (f"_ss{int(share * 100)}" if share != 1.0 else "") + (f"_cs{int(columns * 100)}" if columns != 1.0 else "")
        rows.append((i, name, depth, trees, rate, share, columns))
    return spark.createDataFrame(rows, "ord int, arm string, depth int, trees int, rate double, rows_share double, columns_share double")


def boosted_settings(name: str) -> dict:
    """What an arm of the grid is trained with, from its name."""
    found = re.fullmatch(r"xgb_d(\d+)_n(\d+)_lr(\d+)(?:_ss(\d+))?(?:_cs(\d+))?", name)
    if not found:
        raise ValueError(f"no boosted arm {name!r}")
    depth, trees, rate, rows, columns = found.groups()
    return {"depth": int(depth), "n_trees": int(trees), "rate": int(rate) / 100, "rows": int(rows or 100) / 100, "columns": int(columns or 100) / 100}


def arm_pool(spark: SparkSession, size: str, small: tuple[str, ...] = SMALL_POOL) -> DataFrame:
    """(ord, arm): small is the given list; medium has 22 arms, full 124."""
    if size == "small":
        return spark.createDataFrame(list(enumerate(small)), "ord int, arm string")
    base = spark.createDataFrame(list(enumerate(BASE_ARMS)), "ord int, arm string")
    return base.unionByName(boosted_grid(spark, size).select((F.col("ord") + len(BASE_ARMS)).alias("ord"), "arm"))


def arm_subset(pool: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(draw, arm): k arms without replacement, in the order of their draws; a pool is small, so one task orders it."""
    order = Window.orderBy(uniform(seed, "subset", "arm"), "arm")
    return pool.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= k).select("draw", "arm")


def arm_subsets(pool: DataFrame, queries: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(query_id, draw, arm): for every query k arms without replacement, drawn alone; all arms, if there are fewer.

    A pool is small: its draws are sorted in one array beside the query.
    """
    arms = pool.agg(F.sort_array(F.collect_list("arm")).alias("__arms"))
    draw = F.transform("__arms", lambda a: F.struct(uniform(seed, "subset", "query_id", a).alias("u"), a.alias("arm")))
    chosen = queries.crossJoin(F.broadcast(arms)).select("query_id", F.posexplode(F.slice(F.array_sort(draw), 1, k)).alias("at", "x"))
    return chosen.select("query_id", (F.col("at") + 1).cast("int").alias("draw"), "x.arm")


def ranked_pairs(docs: DataFrame, arms: dict[str, Column], pairs: DataFrame) -> DataFrame:
    """As ``ranked``, for the wanted (query_id, arm) pairs only: other queries' documents and other arms' scores aren't used."""
    score = F.lit(None).cast("double")
    for name, column in arms.items():
        score = F.when(F.col("arm") == name, column.cast("double")).otherwise(score)
    rows = docs.join(pairs.select("query_id", "arm").where(F.col("arm").isin(list(arms))), "query_id").withColumn("__score", score)
    place = Window.partitionBy("query_id", "arm").orderBy(F.desc("__score"), "doc")
    return rows.select("query_id", "arm", "doc", "rel", F.row_number().over(place).alias("pos"))


def looked_up(wanted: DataFrame, cache: DataFrame, rank: Callable[[DataFrame], DataFrame], told: Observation | None = None) -> DataFrame:
    """(query_id, arm, ranking, hit): from the cache where it has the pair; ``rank`` gets the missing pairs alone.

    wanted: different (query_id, arm); rank: from (query_id, arm) to (query_id, arm, ranking), which may lack pairs that can't
    be ranked: their ranking is null. told: counts the rankings made live (``ranked``) when the result is used.
    """
    cached = cache.select("query_id", "arm", "ranking")
    missing = wanted.select("query_id", "arm").join(cached.select("query_id", "arm"), ["query_id", "arm"], "left_anti")
    live = rank(missing).select("query_id", "arm", "ranking")
    if told is not None:
        live = live.observe(told, F.count(F.lit(1)).alias("ranked"))
    hits = wanted.select("query_id", "arm").join(cached, ["query_id", "arm"]).withColumn("hit", F.lit(True))
    return hits.unionByName(missing.join(live, ["query_id", "arm"], "left").withColumn("hit", F.lit(False)))


def save_rankings(rankings: DataFrame, path: str) -> None:
    """A table of precomputed rankings (query_id, arm, ranking), a folder an arm; documents take two bytes where they fit.

    Whether they do is asked first, so that no query group is too large to be saved.
    """
    largest = rankings.agg(F.max(F.array_max("ranking")).alias("m")).first()["m"]
    kind = "array<smallint>" if largest is None or largest < 1 << 15 else "array<int>"
    rankings.select("query_id", "arm", F.col("ranking").cast(kind).alias("ranking")).write.mode("overwrite").partitionBy("arm").parquet(path)


def load_rankings(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``save_rankings`` wrote; None where there is nothing or it can't be read as that."""
    try:
        return spark.read.parquet(path).select("query_id", F.col("arm").cast("string").alias("arm"), F.col("ranking").cast("array<int>").alias("ranking"))
    except AnalysisException:
        return None


def precomputed(docs: DataFrame, arms: dict[str, Column], path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rankings of all arms and their statistics; saved, and read again, where a path is given."""
    rankings = listed(ranked(docs, arms))
    if path is not None:
        save_rankings(rankings, path)
        rankings = load_rankings(docs.sparkSession, path)
    return rankings, cache_statistics(rankings)


def cache_statistics(cache: DataFrame) -> DataFrame:
    """(arm, n_queries, n_entries, bytes): two bytes an entry."""
    n = F.sum(F.size("ranking")).cast("long")
    return cache.groupBy("arm").agg(F.count(F.lit(1)).alias("n_queries"), n.alias("n_entries"), (n * 2).alias("bytes"))
