"""Regret, rates, cost and success of runs, from their round logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.gains import array_dcg, dcg, ratio
from ..functions.running import running_sums


def slate_gains(slates: DataFrame, docs: DataFrame, slate_rows: DataFrame) -> DataFrame:
    """(round, query_id, ndcg, regret): the slate against the best order of all documents, cut at the slate's length."""
    shown = slate_rows.groupBy("round", "query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rel"))).alias("s"))
    shown = shown.select("round", "query_id", F.expr("transform(s, x -> x.rel)").alias("shown"))
    best = docs.groupBy("query_id").agg(F.sort_array(F.collect_list("rel"), asc=False).alias("best"))
    both = shown.join(best, "query_id").withColumn("best", F.expr("slice(best, 1, size(shown))"))
    both = both.withColumn("ndcg", ratio(array_dcg("shown", 1_000_000), array_dcg("best", 1_000_000)))
    return both.select("round", "query_id", "ndcg", F.greatest(F.lit(0.0), 1 - F.col("ndcg")).alias("regret"))


def regret_curve(gains: DataFrame) -> DataFrame:
    """Adds the cumulative regret."""
    return running_sums(gains, "round", {"cumulative": "regret"})


def selection_rates(rounds: DataFrame) -> DataFrame:
    """(arm, selected, rate) of arms selected at all. rounds: (round, participants)."""
    total = rounds.agg(F.count(F.lit(1)).alias("total"))
    picked = rounds.select(F.explode("participants").alias("arm")).groupBy("arm").agg(F.count(F.lit(1)).alias("selected"))
    return picked.crossJoin(F.broadcast(total)).select("arm", "selected", (F.col("selected") / F.col("total")).alias("rate"))


def winner_rates(winners: DataFrame) -> DataFrame:
    """(arm, wins, rate): share of all rounds with a click."""
    total = winners.agg(F.count(F.lit(1)).alias("total"))
    won = winners.groupBy(F.col("winner").alias("arm")).agg(F.count(F.lit(1)).alias("wins"))
    return won.crossJoin(F.broadcast(total)).select("arm", "wins", (F.col("wins") / F.col("total")).alias("rate"))


def run_summary(gains: DataFrame, winners: DataFrame) -> DataFrame:
    """One row: iterations, total and mean regret, rounds with clicks and their rate; zeros without rounds."""
    a = gains.agg(F.count(F.lit(1)).alias("iterations"), F.coalesce(F.sum("regret"), F.lit(0.0)).alias("total_regret"))
    b = winners.agg(F.count(F.lit(1)).alias("total_clicks"))
    one = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("iterations")), F.lit(0.0))
    return a.crossJoin(b).select("iterations", "total_regret", one("total_regret").alias("avg_regret"), "total_clicks", one("total_clicks").alias("click_rate"))


def inference_cost(rounds: DataFrame, cached: DataFrame) -> DataFrame:
    """(arm, inferences): rankings made live, i.e. those of selected arms that the cache doesn't hold."""
    asked = rounds.select("query_id", F.explode("participants").alias("arm"))
    live = asked.join(cached.select("query_id", "arm", F.lit(True).alias("hit")), ["query_id", "arm"], "left")
    return live.groupBy("arm").agg(F.sum(F.when(F.col("hit").isNull(), 1).otherwise(0)).cast("long").alias("inferences"))


def observed(rounds: DataFrame, name: str = "inference") -> tuple[DataFrame, Observation]:
    """The rounds, and counters that fill while whatever is made of them runs: rounds, rankings asked for, and the most in
    one round. ``get`` of the observation waits for the first action and returns them."""
    counters = Observation(name)
    n = F.size("participants")
    return rounds.observe(counters, F.count(F.lit(1)).alias("total_queries"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_inferences"), F.coalesce(F.max(n), F.lit(0)).alias("most_arms")), counters


def logical_cost(rounds: DataFrame) -> DataFrame:
    """One row: all rankings looked at, rounds, and the mean of a round."""
    n = F.sum(F.size("participants")).cast("long")
    return rounds.agg(F.coalesce(n, F.lit(0)).alias("total_evaluations"), F.count(F.lit(1)).alias("total_queries"), F.coalesce(F.try_divide(n, F.count(F.lit(1))), F.lit(0.0)).alias("avg_arms_per_query"))


def hit_rate(looked_up: DataFrame) -> DataFrame:
    hits = F.sum(F.col("hit").cast("long"))
    return looked_up.agg(hits.alias("hits"), (F.count(F.lit(1)) - hits).alias("misses"), F.coalesce(F.try_divide(hits, F.count(F.lit(1))), F.lit(0.0)).alias("hit_rate"))


def cost_reduction(levels: DataFrame, total_arms: int, level1_arms: int, level2_arms: int) -> DataFrame:
    """One row of two-level against flat cost. levels: (round, level); level 0 counts apart and costs nothing here.

    The ratio is 1 without rounds, and infinite if rounds cost nothing.
    """
    at = lambda k: F.sum(F.when(F.col("level") == k, 1).otherwise(0)).cast("long")
    rows = levels.agg(*[F.coalesce(at(k), F.lit(0)).alias(f"level{k}_rounds") for k in (0, 1, 2)])
    two = F.col("level1_rounds") * level1_arms + F.col("level2_rounds") * level2_arms
    flat = (F.col("level1_rounds") + F.col("level2_rounds")) * total_arms
    ratio_ = F.when(flat == 0, F.lit(1.0)).when(two == 0, F.lit(float("inf"))).otherwise(flat / F.when(two > 0, two))
    return rows.select("*", two.alias("two_level"), flat.alias("flat"), ratio_.alias("ratio"))


def success(evaluations: DataFrame, arm_gains: DataFrame, threshold: float) -> DataFrame:
    """Adds gap, valid and success to (seq, round, arm, is_final); an unknown arm fails with gap 1, and where the best
    gain is 0 every known arm succeeds with gap 0; neither counts as valid."""
    best = arm_gains.agg(F.max("gain").alias("best"))
    rows = evaluations.join(F.broadcast(arm_gains), "arm", "left").crossJoin(F.broadcast(best))
    gap = F.when(F.col("gain").isNull(), 1.0).when(F.col("best") == 0, 0.0).otherwise((F.col("best") - F.col("gain")) / F.when(F.col("best") != 0, F.col("best")))
    valid = F.coalesce(F.col("gain").isNotNull() & (F.col("best") != 0), F.lit(False))
    return rows.select(*evaluations.columns, gap.alias("gap"), valid.alias("valid")).withColumn("success", F.col("gap") <= threshold)


def mean_gains(rankings: DataFrame, k: int = 10) -> DataFrame:
    """(arm, gain): mean NDCG at k of whole rankings (query_id, arm, doc, rel, pos) over all queries."""
    best = rankings.groupBy("query_id", "doc").agg(F.max("rel").alias("rel"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc"))
    ideal = best.withColumn("__p", place).groupBy("query_id").agg(dcg("rel", "__p", k).alias("ideal"))
    own = rankings.groupBy("query_id", "arm").agg(dcg("rel", "pos", k).alias("g"))
    return own.join(ideal, "query_id").groupBy("arm").agg(F.avg(ratio(F.col("g"), F.col("ideal"))).alias("gain"))


def sample_complexity(judged: DataFrame, rate: float = 0.95) -> DataFrame:
    """One row: the round of the first evaluation at which the running success rate reaches ``rate``, or null."""
    with_sums = running_sums(judged.withColumn("__s", F.col("success").cast("long")).withColumn("__one", F.lit(1)), "seq", {"wins": "__s", "seen": "__one"})
    met = F.col("wins") >= F.lit(rate) * F.col("seen")
    return with_sums.agg(F.min_by(F.when(met, F.col("round")), F.when(met, F.col("seq"))).alias("sample_complexity"))


def success_summary(judged: DataFrame) -> DataFrame:
    """One row: evaluations, their success rate, and arm, gap and success of the last final one."""
    final = F.when(F.col("is_final"), F.col("seq"))
    return judged.agg(
        F.count(F.lit(1)).alias("n_evaluations"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.max_by("arm", final).alias("final_arm"),
        F.max_by("gap", final).alias("final_gap"),
        F.max_by("success", final).alias("final_success"),
    )


def lagged(gains: DataFrame, every: int) -> DataFrame:
    """Rounds at which progress is told."""
    return gains.where(F.col("round") % every == 0)
