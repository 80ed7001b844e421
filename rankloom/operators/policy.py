"""Pairwise win statistics and the selections made from them, as plans over (i, j) pairs of arms.

``outcomes``: (round, winner, loser, credit). ``arms``: (ord, arm), one row an arm, so products of it with itself are
small. Grids have one row for each ordered pair of different arms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import beta, uniform
from ..functions.running import at_every, discounted_intervals, running_sums, sum_intervals


def pair_stats(outcomes: DataFrame, discount: float | None = None, last_round: int | None = None) -> DataFrame:
    """(i, j, w, n): credit of i over j, discounted by its age where asked for, and undiscounted meetings of both."""
    if discount is not None and not 0 < discount < 1:
        raise ValueError("the discount lies between 0 and 1")
    won = F.col("credit") if discount is None else F.col("credit") * F.pow(F.lit(discount), F.lit(last_round) - F.col("round"))
    sides = outcomes.select(
        F.explode(F.array(F.struct(F.col("winner").alias("i"), F.col("loser").alias("j"), won.alias("w")), F.struct(F.col("loser").alias("i"), F.col("winner").alias("j"), F.lit(0.0).alias("w")))).alias("s")
    )
    return sides.groupBy("s.i", "s.j").agg(F.sum("s.w").alias("w"), F.count(F.lit(1)).alias("n"))


def running_pair_stats(outcomes: DataFrame) -> DataFrame:
    """(round, i, j, w): credit of i over j up to each round in which i beat j."""
    rows = outcomes.select("round", F.col("winner").alias("i"), F.col("loser").alias("j"), "credit")
    return running_sums(rows, "round", {"w": "credit"}, ("i", "j")).select("round", "i", "j", "w")


def _ordered_pairs(arms: DataFrame) -> DataFrame:
    return arms.select(F.col("arm").alias("i")).crossJoin(F.broadcast(arms.select(F.col("arm").alias("j")))).where("i <> j")


def _sides(outcomes: DataFrame) -> DataFrame:
    """(round, i, j, w, n) of both sides of each outcome."""
    won = F.struct(F.col("winner").alias("i"), F.col("loser").alias("j"), F.col("credit").alias("w"))
    lost = F.struct(F.col("loser").alias("i"), F.col("winner").alias("j"), F.lit(0.0).alias("w"))
    return outcomes.select("round", F.inline(F.array(won, lost))).withColumn("n", F.lit(1))


def pair_trajectory(outcomes: DataFrame, arms: DataFrame, last_round: int, discount: float | None = None, size: int = 10_000) -> DataFrame:
    """(round, i, j, w, n) of every pair after every round from 1 on; w is discounted where asked for, n never is.

    The cells' values hold for intervals of rounds, of which there are as many as meetings and blocks; a row for each round
    is made from them at the end.
    """
    keys, sides = _ordered_pairs(arms), _sides(outcomes)
    counts = sum_intervals(sides, keys, "round", last_round, {"w": "w", "n": "n"}, size)
    if discount is None:
        found = at_every(counts, "round")
    else:
        decayed = at_every(discounted_intervals(sides, keys, "round", last_round, "w", discount, size).withColumn("__since", F.col("since")), "round")
        decayed = decayed.select("i", "j", "round", (F.col("s") * F.pow(F.lit(discount), F.col("round") - F.col("__since"))).alias("w"))
        found = at_every(counts.drop("w"), "round").join(decayed, ["i", "j", "round"])
    return found.where("round > 0").select(F.col("round").cast("int").alias("round"), "i", "j", "w", F.col("n").cast("long").alias("n"))


def membership_trajectory(outcomes: DataFrame, arms: DataFrame, last_round: int, n_min: int, alpha: float = 0.51, beta: float = 1.0, size: int = 10_000) -> DataFrame:
    """(round, arm, in_e, in_f): the sets E and F after every round from 1 on, all at once; a single arm is in both."""
    cells = pair_trajectory(outcomes, arms, last_round, None, size)
    known = F.when(F.col("n") > 0, F.col("n"))
    bound = lambda b: F.coalesce(F.col("w") / known + F.sqrt(F.lit(b * alpha) * F.log(F.col("round").cast("double")) / known), F.lit(1.0))
    least = cells.groupBy("round", F.col("i").alias("arm")).agg(F.min(bound(1.0)).alias("e"), F.min(bound(beta)).alias("f"))
    every = arms.sparkSession.range(1, last_round + 1).select(F.col("id").cast("int").alias("round")).crossJoin(F.broadcast(arms.select("arm")))
    fit = lambda c: F.coalesce(F.col(c) >= 0.5, F.lit(True))
    return every.join(least, ["round", "arm"], "left").select("round", "arm", fit("e").alias("in_e"), ((F.col("round") < n_min) | fit("f")).alias("in_f"))


def grid(arms: DataFrame, stats: DataFrame) -> DataFrame:
    """(i, j, w, n) with zeros where two arms never met."""
    return _ordered_pairs(arms).join(stats, ["i", "j"], "left").select("i", "j", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("n", F.lit(0)).alias("n"))


def win_rates(cells: DataFrame) -> DataFrame:
    return cells.withColumn("rate", F.coalesce(F.try_divide(F.col("w"), F.col("n")), F.lit(0.5)))


def inherited(cells: DataFrame, source_of: DataFrame, arms: DataFrame) -> DataFrame:
    """Statistics after members took over those of their representative: cell (a, b) becomes that of (f(a), f(b)).

    source_of: (arm, source); arms that aren't in it keep their own. A cell whose two sources are one arm is empty.
    """
    f = arms.select("arm").join(source_of, "arm", "left").select("arm", F.coalesce("source", "arm").alias("s"))
    both = f.select(F.col("arm").alias("i"), F.col("s").alias("si")).crossJoin(F.broadcast(f.select(F.col("arm").alias("j"), F.col("s").alias("sj")))).where("i <> j")
    own = cells.select(F.col("i").alias("si"), F.col("j").alias("sj"), "w", "n")
    return both.join(own, ["si", "sj"], "left").select("i", "j", F.coalesce("w", F.lit(0.0)).alias("w"), F.coalesce("n", F.lit(0)).alias("n"))


def upper_bounds(cells: DataFrame, t: int, alpha: float = 0.51, beta: float = 1.0) -> DataFrame:
    """Adds ucb: w/n + sqrt(beta * alpha * ln(max(t, 1)) / n), and 1 where nothing is known."""
    width = F.sqrt(F.lit(beta * alpha) * F.log(F.lit(float(max(t, 1)))) / F.col("n"))
    return cells.withColumn("ucb", F.when(F.col("n") > 0, F.col("w") / F.when(F.col("n") > 0, F.col("n")) + F.when(F.col("n") > 0, width)).otherwise(F.lit(1.0)))


def qualified(bounds: DataFrame, arms: DataFrame) -> DataFrame:
    """(ord, arm, least): arms whose smallest bound against the others is at least a half; a single arm qualifies."""
    least = bounds.groupBy(F.col("i").alias("arm")).agg(F.min("ucb").alias("least"))
    return arms.join(least, "arm", "left").withColumn("least", F.coalesce("least", F.lit(float("inf")))).where("least >= 0.5")


def set_membership(cells: DataFrame, arms: DataFrame, t: int, n_min: int, alpha: float = 0.51, beta: float = 1.0) -> DataFrame:
    """(ord, arm, in_e, in_f): E with beta 1, F with beta, and everything in F while t < n_min."""
    e = qualified(upper_bounds(cells, t, alpha, 1.0), arms).select("arm", F.lit(True).alias("in_e"))
    f = qualified(upper_bounds(cells, t, alpha, beta), arms).select("arm", F.lit(True).alias("in_f"))
    in_f = F.lit(True) if t < n_min else F.coalesce("in_f", F.lit(False))
    return arms.join(e, "arm", "left").join(f, "arm", "left").select("ord", "arm", F.coalesce("in_e", F.lit(False)).alias("in_e"), in_f.alias("in_f"))


def _count(flag: Column) -> Column:
    return F.sum(flag.cast("int")).over(Window.partitionBy(F.lit(0)))


def dueling_selection(members: DataFrame, t: int, n_min: int) -> DataFrame:
    """(ord, arm): all in the grace period, else E if it is one arm, else F, else all. One row an arm: a small window."""
    if t < n_min:
        return members.select("ord", "arm")
    n_e, n_f = _count(F.col("in_e")), _count(F.col("in_f"))
    chosen = F.when(n_e == 1, F.col("in_e")).when(n_f > 0, F.col("in_f")).otherwise(F.lit(True))
    return members.withColumn("__c", chosen).where("__c").select("ord", "arm")


def check_dueling(alpha: float, beta: float, n_min: int) -> None:
    if alpha <= 0.5 or beta < 1 or n_min < 0:
        raise ValueError("alpha must be over 0.5, beta at least 1, n_min at least 0")


def relative_bounds(cells: DataFrame, t: int, alpha: float = 0.51) -> DataFrame:
    """(i, j, u): w_ij / (w_ij + w_ji) + sqrt(alpha * ln t / (w_ij + w_ji)), and 1 where the two never decided."""
    back = cells.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("w").alias("back"))
    both = cells.join(back, ["i", "j"]).withColumn("total", F.col("w") + F.col("back"))
    known = F.when(F.col("total") > 0, F.col("total"))
    u = F.when(F.col("total") > 0, F.col("w") / known + F.sqrt(F.lit(alpha) * F.log(F.lit(float(max(t, 1)))) / known)).otherwise(F.lit(1.0))
    return both.select("i", "j", u.alias("u"))


def candidates(bounds: DataFrame, arms: DataFrame) -> DataFrame:
    """(ord, arm, least) of arms whose smallest relative bound is at least a half."""
    return qualified(bounds.withColumnRenamed("u", "ucb"), arms)


def relative_selection(found: DataFrame, arms: DataFrame, t: int, n_min: int, m: int | None = None, best: str | None = None, seed: int = 42) -> DataFrame:
    """(ord, arm): the comparison set. No candidate: m of all by chance; one: that one; at most m: all candidates;
    more: m of them by chance, half of the time with ``best``, an earlier single candidate, and else without it."""
    m = m or arms.count()
    if t < n_min:
        return arms.select("ord", "arm")
    draw = uniform(seed, "rucb", F.lit(t), "arm")
    n = found.count()
    pool = found if n else arms
    if n and best is not None and n > m:
        with_best = uniform(seed, "rucb", F.lit(t), F.lit("best")) < 0.5
        first = F.when(with_best & (F.col("arm") == best), -1.0).when(~with_best & (F.col("arm") == best), 2.0).otherwise(draw)
    else:
        first = draw
    return pool.withColumn("__u", first).orderBy("__u", "arm").limit(m).select("ord", "arm")


def winning_cluster(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, arm, wins): the representative with most wins over the other representatives; ties to the first cluster.

    clusters: (cluster, arm, is_rep).
    """
    reps = clusters.where("is_rep").select("cluster", "arm")
    met = cells.join(F.broadcast(reps.select(F.col("arm").alias("i"))), "i").join(F.broadcast(reps.select(F.col("arm").alias("j"))), "j")
    wins = met.groupBy(F.col("i").alias("arm")).agg(F.sum("w").alias("wins"))
    scored = reps.join(wins, "arm", "left").withColumn("wins", F.coalesce("wins", F.lit(0.0)))
    return scored.orderBy(F.desc("wins"), "cluster").limit(1).select("cluster", "arm", "wins")


def among(cells: DataFrame, active: DataFrame) -> DataFrame:
    """Cells of pairs of active arms."""
    return cells.join(F.broadcast(active.select(F.col("arm").alias("i"))), "i", "left_semi").join(F.broadcast(active.select(F.col("arm").alias("j"))), "j", "left_semi")


def active_selection(cells: DataFrame, active: DataFrame, t: int, n_min: int, alpha: float = 0.51) -> DataFrame:
    """(ord, arm) in the active set: all in the grace period or when none qualifies, else those that qualify."""
    if t < n_min:
        return active.select("ord", "arm")
    fit = qualified(upper_bounds(among(cells, active), t, alpha), active).select("arm", F.lit(True).alias("fit"))
    marked = active.join(fit, "arm", "left").withColumn("fit", F.coalesce("fit", F.lit(False)))
    return marked.withColumn("__n", _count(F.col("fit"))).where("fit or __n = 0").select("ord", "arm")


def beta_posteriors(played: DataFrame, arms: DataFrame) -> DataFrame:
    """(arm, a, b, mean): Beta(1 + wins, 1 + losses) of arms played one at a time. played: (round, arm, won)."""
    sums = played.groupBy("arm").agg(F.sum(F.col("won").cast("long")).alias("wins"), F.sum((~F.col("won")).cast("long")).alias("losses"))
    a, b = F.coalesce("wins", F.lit(0)) + 1, F.coalesce("losses", F.lit(0)) + 1
    return arms.join(sums, "arm", "left").select("arm", a.cast("long").alias("a"), b.cast("long").alias("b"), (a / (a + b)).alias("mean"))


def _joined(rows: DataFrame, where: Column) -> Column:
    """Names of arms, in order, as one string; null if there are none."""
    found = F.array_sort(F.collect_list(F.when(where, F.struct("ord", "arm"))))
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, lambda v: v["arm"]), ","))


def dueling_statistics(membership: DataFrame, t: int, n_min: int = 500, alpha: float = 0.51, beta: float = 1.0) -> DataFrame:
    """One row of what a dueling policy knows. membership: (ord, arm, in_e, in_f)."""
    row = membership.agg(_joined(membership, F.col("in_e")).alias("set_e"), _joined(membership, F.col("in_f")).alias("set_f"))
    return row.select(F.lit(t).cast("long").alias("t"), "set_e", "set_f", F.lit(alpha).alias("alpha"), F.lit(beta).alias("beta"), F.lit(n_min).alias("n_min"), F.lit(n_min > 0 and t < n_min).alias("in_grace_period"))


def relative_statistics(found: DataFrame, t: int, n_min: int, m: int, alpha: float = 0.51) -> DataFrame:
    """One row of what a relative policy knows. found: its candidates (ord, arm)."""
    row = found.agg(_joined(found, F.lit(True)).alias("candidates"), F.count(F.lit(1)).alias("candidate_set_size"))
    return row.select(F.lit(t).cast("long").alias("t"), "candidates", "candidate_set_size", F.lit(alpha).alias("alpha"), F.lit(m).alias("m"), F.lit(n_min).alias("n_min"), F.lit(n_min > 0 and t < n_min).alias("in_grace_period"))


def two_level_statistics(cells: DataFrame, clusters: DataFrame, arms: DataFrame, t: int, level1_rounds: int) -> DataFrame:
    """One row of what a two-level policy knows: its level, the cluster that won (from level 2 on) and the active arms."""
    level = 1 if t < level1_rounds else 2
    best = winning_cluster(cells, clusters).select(F.col("cluster").alias("best"))
    members = clusters.join(arms, "arm").crossJoin(best)
    active = F.col("is_rep") if level == 1 else F.col("cluster") == F.col("best")
    row = members.groupBy("best").agg(_joined(members, active).alias("active_arms"), F.count_distinct("cluster").alias("n_clusters"))
    return row.select(F.lit(t).cast("long").alias("t"), F.lit(level).alias("current_level"), (F.lit(None) if level == 1 else F.col("best")).cast("int").alias("winning_cluster_id"), "active_arms", "n_clusters")


def posterior_trajectory(played: DataFrame, arms: DataFrame, last_round: int, size: int = 10_000) -> DataFrame:
    """(round, arm, a, b) before every round from 1 on, of (round, arm, won): 1 + wins and 1 + losses in earlier rounds."""
    rows = played.select("round", "arm", F.col("won").cast("int").alias("win"), (~F.col("won")).cast("int").alias("loss"))
    held = at_every(sum_intervals(rows, arms.select("arm"), "round", last_round - 1, {"a": "win", "b": "loss"}, size), "round")
    return held.select((F.col("round") + 1).cast("int").alias("round"), "arm", (F.col("a") + 1).cast("long").alias("a"), (F.col("b") + 1).cast("long").alias("b"))


def thompson_draws(posteriors: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``draw``, from Beta(a, b), and ``chosen``: whether it is its round's largest (the first arm's, if several are)."""
    drawn = posteriors.withColumn("draw", beta(F.col("a"), F.col("b"), seed, "round", "arm"))
    best = drawn.groupBy("round").agg(F.min_by("arm", F.struct(-F.col("draw"), F.col("arm"))).alias("__best"))
    return drawn.join(best, "round").withColumn("chosen", F.col("arm") == F.col("__best")).drop("__best")
