"""One experiment from a configuration to a result document, and its command line."""

from __future__ import annotations

import argparse
import json
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.running import running_sums
from .operators import adaptive, clustering, learners, ranking, reports, rounds, telemetry
from .scratch import scope, written
from .shipping import ship
from .sources import groups


@dataclass(frozen=True)
class Config:
    """Settings and their defaults (fixed values)."""

    n_rounds: int = 10_000
    seed: int = 42
    arm_pool: tuple[str, ...] = ranking.SMALL_POOL
    arm_pool_size: str = "small"
    arm_subset: int | None = None
    data_path: str = ""
    scenario: str = "standard"
    policy: str = "mdb"
    max_train_queries: int = 20_000
    alpha: float = 0.51
    beta: float = 1.0
    slate_size: int = 10
    grace_period: int = 500
    pca_dim: int = 20
    linucb_alpha: float = 1.0
    trees: int = 100
    depth: int = 6
    train_fraction: float = 0.1
    relative_m: int | None = None
    multileaving: str = "team_draft"
    attribution: str = "team_draft_legacy"
    tracker: str = "cumulative"
    discount: float = 0.995
    cluster_min_size: int = 5
    cluster_queries: int = 1000
    cluster_top_k: int = 10
    hierarchical: bool = False
    level1_rounds: int = 2000
    clustering: str = "output_based"
    warm_start: bool = True
    cache_arms: int = 10
    use_cache: bool = True


TRACKERS = ("cumulative", "discounted")
LINEAR = ("linucb", "linear_ts")

#: Arms that a program adds: by name, a function from the configuration to a score column over (query_id, doc, rel, features).
OWN_ARMS: dict[str, Callable[[Config], Column]] = {}


def trained_arms(train: DataFrame, names: list[str], config: Config) -> learners.Arms:
    """Everything that arms learn before the first round."""
    arms = learners.Arms()
    if any(n in LINEAR for n in names):
        arms.projection = learners.projection(train, config.pca_dim)
        arms.bandit = learners.LinearBandit(arms.projection.components.shape[1])
    for name in names:
        if name.startswith("xgb") and name not in OWN_ARMS:
            settings = {"n_trees": config.trees, "depth": config.depth, "rate": 0.1, "share": config.train_fraction} if name == "xgboost" else ranking.boosted_settings(name)
            arms.boosted[name] = learners.boosted(train, seed=config.seed, **settings)
    return arms


def arm_scores(docs: DataFrame, arms: learners.Arms, names: list[str], config: Config) -> tuple[DataFrame, dict[str, Column]]:
    """The documents with the columns that the arms' scores need, and the scores by arm; those of bandits are the ones that
    they begin with."""
    rows, scores = docs, {}
    if any(n in LINEAR for n in names):
        rows = rows.withColumn("__x", arms.projection.column())
    bandit = arms.bandit
    for name in names:
        if name in OWN_ARMS:
            scores[name] = OWN_ARMS[name](config)
            continue
        if name == "random":
            scores[name] = ranking.by_chance(config.seed)
        elif name == "single_feature":
            scores[name] = ranking.by_feature(0)
        elif name == "ground_truth":
            scores[name] = ranking.by_relevance()
        elif name == "linucb":
            scores[name] = bandit.optimistic("__x", config.linucb_alpha)
        elif name == "linear_ts":
            scores[name] = bandit.drawn(config.seed, "__x")
        elif name.startswith("xgb"):
            rows = arms.boosted[name].scored(rows).withColumnRenamed("score", f"__{name}")
            scores[name] = F.col(f"__{name}")
        elif name.startswith("feature_"):
            scores[name] = ranking.by_feature(int(name.removeprefix("feature_")))
        else:
            raise ValueError(f"unknown arm {name!r}")
    return rows, scores


def pool_names(spark: SparkSession, config: Config) -> list[str]:
    size = "full" if config.arm_subset else config.arm_pool_size
    pool = ranking.arm_pool(spark, size, config.arm_pool)
    if config.arm_subset:
        return [r.arm for r in ranking.arm_subset(pool, config.arm_subset, config.seed).orderBy("draw").collect()]
    return [r.arm for r in pool.orderBy("ord").collect()]


def two_level_settings(spark: SparkSession, ranked: DataFrame, names: list[str], config: Config) -> dict:
    """Clusters and representatives of the arms, by index."""
    arms = spark.createDataFrame(list(enumerate(names)), "ord int, arm string")
    sample = groups.sampled(ranked, config.cluster_queries, config.seed)
    own = ranked.join(sample, "query_id", "left_semi")
    if config.clustering == "random":
        found = clustering.shuffled_clusters(arms, max(len(names) // 10, 2), config.seed)
    else:
        found = clustering.fitted(spark, own, arms, config.cluster_min_size, config.cluster_top_k)
    clusters: dict[int, list[int]] = {}
    reps: dict[int, int] = {}
    for r in sorted(found.collect(), key=lambda r: (r.cluster, r.member)):
        clusters.setdefault(r.cluster, []).append(names.index(r.arm))
        if r.is_rep:
            reps[r.cluster] = names.index(r.arm)
    return {"clusters": clusters, "reps": reps, "level1_rounds": config.level1_rounds, "warm": config.warm_start}


def live_arms(arms: learners.Arms, names: list[str], config: Config) -> dict:
    """Functions from a run's seed to the arms that go on learning in it."""
    bandit, alpha = arms.bandit, config.linucb_alpha  # what the functions take along
    make = {"linucb": lambda seed: learners.LiveLinUCB(bandit, alpha), "linear_ts": lambda seed: learners.LiveThompson(bandit, seed)}
    return {n: make[n] for n in names if n in LINEAR and n not in OWN_ARMS}


def run_settings(spark: SparkSession, ranked: DataFrame, names: list[str], config: Config) -> tuple[str, dict]:
    """The policy's name and settings."""
    settings: dict = {}
    kind = "hierarchical" if config.hierarchical else config.policy
    if kind in ("mdb", "multi_rucb", "hierarchical"):
        settings |= {"alpha": config.alpha, "beta": config.beta, "n_min": config.grace_period}
    if kind == "multi_rucb":
        settings["m"] = config.relative_m
    if kind == "hierarchical":
        settings |= two_level_settings(spark, ranked, names, config)
    if config.tracker == "discounted":
        settings["discount"] = config.discount
    return kind, settings


def checked(config: Config) -> Config:
    rounds.scenario(config.scenario)
    adaptive.chosen(adaptive.DRAFTS, config.multileaving)
    adaptive.chosen(adaptive.CREDITS, config.attribution)
    if config.tracker not in TRACKERS:
        raise ValueError(f"unknown tracker {config.tracker!r}")
    return config


def run(spark: SparkSession, docs: DataFrame, config: Config, train: DataFrame | None = None, load_arms: str | None = None, save_arms: str | None = None) -> dict:
    """Ranks, replays and summarises. docs: (query_id, doc, rel, features); training takes them too unless given its own.

    load_arms: folder of trained arms, which are trained anew where it has none or not all; save_arms: folder to keep them.
    """
    return runs(spark, docs, [config], train, load_arms, save_arms)[0]


#: Settings that runs may differ in and still share arms, rankings and clusters.
PER_RUN = ("n_rounds", "scenario", "policy", "alpha", "beta", "grace_period", "relative_m", "tracker", "discount", "level1_rounds", "warm_start")


def runs(spark: SparkSession, docs: DataFrame, configs: list[Config], train: DataFrame | None = None, load_arms: str | None = None, save_arms: str | None = None) -> list[dict]:
    """Experiments that differ in PER_RUN settings only: arms are trained and rankings made once, and all runs of one length
    are groups of one plan."""
    began = time.time()
    ship(spark)
    config = checked(configs[0])
    if any(replace(checked(c), **{f: getattr(config, f) for f in (*PER_RUN, "hierarchical")}) != config for c in configs):
        raise ValueError("runs of one plan share their arms and their data")
    names = pool_names(spark, config)
    arms = learners.Arms.load(spark, load_arms) if load_arms else None
    needed = {n for n in names if n.startswith("xgb") and n not in OWN_ARMS}
    if arms is None or not needed <= set(arms.boosted) or (arms.bandit is None and any(n in LINEAR for n in names)):
        own = docs if train is None else train
        arms = trained_arms(own.join(groups.sampled(own, config.max_train_queries, config.seed), "query_id", "left_semi"), names, config)
    if save_arms:
        arms.save(spark, save_arms)
    rows, scores = arm_scores(docs, arms, names, config)
    ranked = ranking.ranked(rows, scores)
    cached = config.use_cache and len(names) >= config.cache_arms
    # Precomputed rankings don't change, so arms go on learning only where every ranking is made live.
    live = {} if cached else live_arms(arms, names, config)
    with scope():
        lists = written(ranking.listed(ranked), "rankings") if cached else ranking.listed(ranked)
        gains = written(telemetry.mean_gains(ranked), "gains")  # a row an arm
        plans = []
        for k, c in enumerate(configs):
            kind, settings = run_settings(spark, ranked, names, c)
            plans.append({"run_id": str(k), "policy": kind, "scenario": c.scenario, "seed": c.seed, "settings": settings})
        logs = []
        for n in sorted({c.n_rounds for c in configs}):
            some = [p for p, c in zip(plans, configs, strict=True) if c.n_rounds == n]
            logs.append(written(adaptive.adaptive_runs(lists, rows if live else docs, some, names, n, config.slate_size, live, draft=config.multileaving, credit=config.attribution), "log"))
        log = logs[0]
        for other in logs[1:]:
            log = log.unionByName(other)
        return [result_document(log.where(F.col("run_id") == p["run_id"]), c, names, p, cached, lists, gains, time.time() - began) for p, c in zip(plans, configs, strict=True)]


def result_document(log: DataFrame, config: Config, names: list[str], plan: dict, cached: bool, lists: DataFrame, arm_gains: DataFrame, seconds: float) -> dict:
    """Everything a run's log tells, with the names of the document's format; it holds a number for each round."""
    rows = log.orderBy("round").select("round", "arms", "winner", "n_clicks", "regret", "level", "live", "stats").collect()
    n, clicks = len(rows), sum(r.n_clicks > 0 for r in rows)
    looked, made = sum(len(r.arms) for r in rows), 0 if cached else sum(len(r.arms) for r in rows)
    picked, won = Counter(a for r in rows for a in r.arms), Counter(r.winner for r in rows if r.winner is not None)
    curve = list(accumulate(r.regret for r in rows))
    total = curve[-1] if curve else 0.0
    rate = lambda a, b: a / b if b else 0.0
    out = {
        "config": asdict(config)
        | {"arms": list(names), "attribution_scheme": config.attribution, "statistics_tracker": config.tracker, "discount_factor": config.discount, "multileaving_scheme": config.multileaving}
        | {"cluster_sample_queries": config.cluster_queries, "clustering_type": config.clustering},
        "metrics": {"iterations": n, "total_ndcg_regret": total, "avg_ndcg_regret": rate(total, n), "total_clicks": clicks, "click_rate": rate(clicks, n)},
        "selection_rates": {a: k / n for a, k in picked.items()},
        "win_rates": {a: k / clicks for a, k in won.items()},
        "policy_stats": json.loads(rows[-1].stats) if rows else {},
        "inference_stats": {"total_queries": n, "total_inferences": made, "avg_arms_per_query": rate(made, n), "arm_costs": {} if cached else dict(picked)},
        "history": {"cumulative_ndcg_regret": curve},
        "success_metrics": success_metrics(log, arm_gains),
        "logical_cost": {"total_evaluations": looked, "avg_arms_per_query": rate(looked, n), "total_queries": n},
        "runtime": seconds,
    }
    if plan["policy"] == "hierarchical":
        clusters = plan["settings"]["clusters"]
        levels = log.select("round", "level")
        cost = telemetry.cost_reduction(levels, len(names), len(plan["settings"]["reps"]), len(names) // max(len(clusters), 1)).first()
        out |= {"cost_metrics": cost.asDict(), "hierarchical": {"enabled": True}}
    if cached:
        known = lists.agg(F.count_distinct("query_id")).first()[0]
        out["cache_stats"] = {"enabled": True, "cache_hits": looked, "cache_misses": 0, "total_lookups": looked, "hit_rate": 1.0 if looked else 0.0, "cached_arms": list(names), "n_cached_queries": known}
    return out


#: Largest relative gap to the best arm's gain at which a round's winner counts as a success (fixed value).
SUCCESS_GAP = 0.01


def success_metrics(log: DataFrame, arm_gains: DataFrame) -> dict:
    """Of the rounds with a winner: their number, how many were won by an arm next to the best, from which round on the share
    reached 95 %, and the gap of the last one; the number alone where there are none."""
    won = log.where("winner is not null").select(F.col("round").cast("long").alias("round"), F.col("winner").alias("arm"), F.lit(True).alias("is_final"))
    seq = running_sums(won.withColumn("__one", F.lit(1)), "round", {"seq": "__one"})
    judged = telemetry.success(seq, arm_gains, SUCCESS_GAP)
    found = telemetry.success_summary(judged).first()
    if not found.n_evaluations:
        return {"n_evaluations": 0}
    since = telemetry.sample_complexity(judged).first()["sample_complexity"]
    return {"n_evaluations": found.n_evaluations, "success_rate": found.success_rate, "sample_complexity_95": since, "final_success": found.final_success, "final_gap_pct": found.final_gap}


def config_of(args: list[str]) -> tuple[Config, argparse.Namespace]:
    parser = argparse.ArgumentParser(description="Online evaluation of competing rankers")
    for name, value in asdict(Config()).items():
        flag = "--" + name.replace("_", "-")
        if isinstance(value, bool):
            parser.add_argument(flag, action=argparse.BooleanOptionalAction, default=value)
        elif isinstance(value, tuple):
            parser.add_argument(flag, nargs="+", default=list(value))
        else:
            parser.add_argument(flag, type=int if value is None else type(value), default=value)
    parser.add_argument("--quick", action="store_true", help="1000 rounds and 1000 training queries")
    parser.add_argument("--output", default=None)
    parser.add_argument("--load-arms", default=None, help="folder of trained arms")
    parser.add_argument("--save-arms", default=None, help="folder to keep trained arms in")
    given = parser.parse_args(args)
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in vars(given).items() if k in asdict(Config())}
    config = Config(**values)
    return (replace(config, n_rounds=1000, max_train_queries=1000) if given.quick else config), given


def main(args: list[str] | None = None) -> None:
    config, given = config_of(args)
    spark = SparkSession.builder.appName("rankloom").getOrCreate()
    docs = groups.flat(groups.read_groups(spark, f"{config.data_path}/test"))
    train = groups.flat(groups.read_groups(spark, f"{config.data_path}/train"))
    print(reports.save_result(run(spark, docs, config, train, given.load_arms, given.save_arms), given.output))


@dataclass
class Sweep:
    """Independent experiments; those that differ in PER_RUN settings only share arms, rankings and one plan."""

    configs: list[Config] = field(default_factory=list)

    def run(self, spark: SparkSession, docs: DataFrame, train: DataFrame | None = None) -> list[dict]:
        """Results in the order of the configurations."""
        shared: dict[Config, list[int]] = {}
        for i, c in enumerate(self.configs):
            shared.setdefault(replace(c, **{f: getattr(Config(), f) for f in PER_RUN}), []).append(i)
        out: dict[int, dict] = {}
        for places in shared.values():
            out |= dict(zip(places, runs(spark, docs, [self.configs[i] for i in places], train), strict=True))
        return [out[i] for i in range(len(self.configs))]


if __name__ == "__main__":
    main()
