"""Trajectories, drafts of unequal lists, misses of the cache, forests, resampling and the global order."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rankloom import experiment
from rankloom.functions import rng
from rankloom.operators import clustering, learners, policy, ranking, reports, resampling, rounds, telemetry
from rankloom.sources import groups

ARMS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def arms(spark):
    return spark.createDataFrame(list(enumerate(ARMS)), "ord int, arm string")


def outcomes_of(n, seed=3):
    draw = random.Random(seed)
    return [(t, *draw.sample(ARMS, 2), 1.0) for t in range(1, n + 1) if t % 5]


@pytest.mark.parametrize(("size", "discount"), [(7, None), (7, 0.9), (1000, 0.995), (3, 0.001)])
def test_trajectories_follow_the_rounds(spark, arms, size, discount):
    """One round after the other, over many small blocks, with rounds and pairs without meetings."""
    rows = [r for r in outcomes_of(40) if r[1] != "c" and r[2] != "c"]
    table = spark.createDataFrame(rows, "round int, winner string, loser string, credit double")
    got = {(r.round, r.i, r.j): (r.w, r.n) for r in policy.pair_trajectory(table, arms, 43, discount, size).collect()}
    w, n = Counter(), Counter()
    for t in range(1, 44):
        if discount:
            w = Counter({k: v * discount for k, v in w.items()})
        for _, i, j, credit in (r for r in rows if r[0] == t):
            w[i, j] += credit
            n[i, j] += 1
            n[j, i] += 1
        for i in ARMS:
            for j in ARMS:
                if i != j:
                    assert got[t, i, j][1] == n[i, j] and got[t, i, j][0] == pytest.approx(w[i, j], rel=1e-9, abs=1e-15)
    assert len(got) == 43 * 6


def test_membership_trajectory_is_that_of_every_prefix(spark, arms):
    rows = outcomes_of(30)
    table = spark.createDataFrame(rows, "round int, winner string, loser string, credit double")
    got = {(r.round, r.arm): (r.in_e, r.in_f) for r in policy.membership_trajectory(table, arms, 30, 12, beta=1.3, size=8).collect()}
    for t in (1, 11, 12, 29, 30):
        cells = policy.grid(arms, policy.pair_stats(table.where(F.col("round") <= t)))
        for r in policy.set_membership(cells, arms, t, 12, beta=1.3).collect():
            assert got[t, r.arm] == (r.in_e, r.in_f)
    one = arms.where("ord = 0")
    assert {(r.in_e, r.in_f) for r in policy.membership_trajectory(table.limit(0), one, 3, 0).collect()} == {(True, True)}
    with pytest.raises(ValueError):
        policy.pair_trajectory(table, arms, 3, 1.0)


def test_unequal_lists_are_drafted_as_one_round_is(spark):
    draw = random.Random(5)
    lists, want = [], {}
    order = {}
    for t in range(60):
        own = {a: draw.sample(range(12), draw.randint(0, 12)) + draw.choices(range(4), k=draw.randint(0, 2)) for a in ARMS if draw.random() < 0.9}
        lists += [(f"q{t}", a, docs if docs else None) for a, docs in own.items()]
        order[t] = own
    rankings = spark.createDataFrame(lists, "query_id string, arm string, ranking array<int>")
    turns = spark.createDataFrame([(t, f"q{t}") for t in order], "round int, query_id string")
    drawn = rankings.join(turns, "query_id").select("round", "arm", rng.uniform(42, "draft", "round", "arm").alias("u")).collect()
    for size in (1, 4, 10):
        for t, own in order.items():
            turn = [a for _, a in sorted((r.u, r.arm) for r in drawn if r.round == t)]
            want[t] = rounds.drafted_any(own, turn, size)
        for r in rounds.drafted_lists(rankings, turns, size).collect():
            assert ([x.doc for x in r.slate], {x.doc: x.arm for x in r.slate}) == want[r.round], (size, r.round)


def test_misses_alone_are_ranked(spark):
    docs = spark.createDataFrame([(f"q{i // 5}", i % 5, i % 3, [float(i * 7 % 11), float(i)]) for i in range(50)], "query_id string, doc int, rel int, features array<double>")
    both = {"x": ranking.by_feature(0), "y": ranking.by_feature(1)}
    lists = ranking.listed(ranking.ranked(docs, both))
    wanted = lists.select("query_id", "arm").unionByName(spark.createDataFrame([("q0", "unknown")], "query_id string, arm string"))
    told = Observation()
    got = ranking.looked_up(wanted, lists.where("arm = 'x'"), lambda m: ranking.listed(ranking.ranked_pairs(docs, both, m)), told)
    rows = {(r.query_id, r.arm): (r.ranking, r.hit) for r in got.collect()}
    assert told.get["ranked"] == 10  # the arm y of ten queries
    assert all(rows[r.query_id, r.arm] == (r.ranking, r.arm == "x") for r in lists.collect()) and rows["q0", "unknown"] == (None, False)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan[plan.index("row_number") :]


def test_query_groups_of_any_size(spark, tmp_path):
    docs = spark.range(40_000).select(F.lit("q").alias("query_id"), F.col("id").cast("int").alias("doc"), F.lit(0).alias("rel"), F.array(F.col("id").cast("double")).alias("features"))
    rankings, told = ranking.precomputed(docs, {"x": ranking.by_feature(0)}, str(tmp_path / "cache"))
    assert rankings.first().ranking == list(range(39_999, -1, -1)) and told.first().n_entries == 40_000


def test_forest_walks_as_its_trees_do(spark):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((200, 3))
    rows = spark.createDataFrame([(i, v.tolist(), Vectors.dense(v.tolist()), float(np.sin(v[0]) + v[2])) for i, v in enumerate(x)], ["id", "features", "v", "y"])
    models = [DecisionTreeRegressor(featuresCol="v", labelCol="y", predictionCol="p", maxDepth=d, seed=d).fit(rows) for d in (1, 3, 5)]
    forest = learners.BoostedRanker([learners.Tree.of(m) for m in models], 0.5)
    want = {r.id: 0.5 * sum(m.predict(r.v) for m in models) for r in rows.collect()}
    got = {r.id: r.score for r in forest.scored(rows.select("id", "features")).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
    nodes = lambda f: f.scored(rows)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert nodes(forest) == nodes(learners.BoostedRanker(forest.trees * 30, 0.5))  # a plan of one size
    leaf = learners.Tree([-1], [0.0], [0], [0], [2.0])
    assert {r.score for r in learners.BoostedRanker([leaf], 0.1).scored(rows).collect()} == {0.2}
    assert learners.Tree.of(models[1], [2, 0, 1]).feature[0] == [2, 0, 1][learners.Tree.of(models[1]).feature[0]]


def weights_of(key, seed, b):
    h = int(resampling.drawn(np.array([key], "i8").view("u8"), seed, np.array([b], "u8"))[0, 0])
    return sum(h >= e for e in resampling.POISSON)


def test_resamples_are_weights_of_rows(spark):
    values = [(i, float(i * i % 17), float(i % 5)) for i in range(-20, 40)]
    rows = spark.createDataFrame([*values, (None, 1.0, 1.0), (77, None, None)], "id long, a double, b double")
    for parts in (1, 5):
        got = {r.b: r.stat for r in resampling.bootstrap_means(rows.repartition(parts), "id", "a", 20).collect()}
        for b in range(20):
            w = [weights_of(i, 42, b) for i, _, _ in values]
            assert got[b] == pytest.approx(sum(x * v for x, (_, v, _) in zip(w, values, strict=True)) / sum(w))
    flips = resampling.sign_flips(rows, "id", "a", "b", 70).first()
    d = np.array([a - b for _, a, b in values])
    keys = np.array([i for i, _, _ in values], "i8").view("u8")
    bits = resampling.drawn(keys, 42, np.arange(3, dtype="u8"))
    means = [np.mean(np.where((bits[:, k // 32] >> np.uint64(k % 32)) & np.uint64(1) == 1, -d, d)) for k in range(70)]
    assert flips.observed == pytest.approx(d.mean()) and flips.p_value == pytest.approx(np.mean(np.abs(means) >= abs(d.mean()) - 1e-12)) and flips.n == len(d)


def test_resampling_edges(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 2.0, 2.0), (2, 2.0, 2.0)], "id long, a double, b double")
    assert resampling.sign_flips(rows, "id", "a", "b", 40).first()[1:4] == (0.0, 1.0, 0.0)
    assert tuple(resampling.bootstrap_mean_interval(rows.limit(0), "id", "a", 10).first()) == (0.0, 0.0, 0.0)
    assert resampling.sign_flips(rows.limit(0), "id", "a", "b", 40).collect() == []
    with pytest.raises(Exception, match="unequal length"):
        resampling.sign_flips(spark.createDataFrame([(1, 2.0, None)], "id long, a double, b double"), "id", "a", "b", 40).collect()
    many = spark.range(3000).select("id", (F.col("id") % 10).cast("double").alias("a"))
    whole = resampling.bootstrap_mean_interval(many, "id", "a", 400).first()
    assert 4.5 == whole.estimate and whole.low == pytest.approx(4.5 - 1.96 * 2.872 / 3000**0.5, abs=0.03) and whole.high == pytest.approx(4.5 + 1.96 * 2.872 / 3000**0.5, abs=0.03)
    monkeypatch.setattr(resampling, "STEP", 64)  # steps of one row
    again = resampling.bootstrap_mean_interval(many.limit(100), "id", "a", 50).first()
    monkeypatch.undo()
    assert tuple(again) == pytest.approx(tuple(resampling.bootstrap_mean_interval(many.limit(100), "id", "a", 50).first()))


@pytest.mark.parametrize("size", [None, 300, 37])
def test_one_order_over_many_ranges(spark, size):
    rows = spark.range(2000).select((F.col("id") % 3).alias("a"), F.concat(F.lit("k"), (F.col("id") * 7919 % 2000).cast("string")).alias("b"), "id")
    got = groups.numbered(rows, "a", "b", size=size)
    want = [r.id for r in rows.orderBy("a", "b").collect()]
    assert [(r.place, r.id) for r in got.orderBy("place").collect()] == list(enumerate(want, 1))
    assert groups.numbered(rows.limit(0), "a", "b", size=size).collect() == []


def test_beta_draws_have_their_moments(spark):
    rows = spark.range(4000).select("id", F.lit(3).alias("a"), F.lit(5).alias("b"), F.lit(1).alias("one"))
    got = rows.select(rng.beta(F.col("a"), F.col("b"), 1, "id").alias("x"), rng.beta(F.col("one"), F.col("one"), 2, "id").alias("u"))
    r = got.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.avg("u").alias("um"), F.var_pop("u").alias("uv"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    assert r.m == pytest.approx(3 / 8, abs=0.01) and r.v == pytest.approx(15 / (64 * 9), rel=0.1) and 0 < r.low < r.high < 1
    assert r.um == pytest.approx(0.5, abs=0.02) and r.uv == pytest.approx(1 / 12, rel=0.1)


def test_overlaps_of_more_arms_than_a_word_has_bits(spark):
    names = [f"d{i:03d}" for i in range(70)]
    draw = random.Random(2)
    rows = [(q, a, d, p + 1) for q in ("x", "y") for a in names for p, d in enumerate(draw.sample(range(9), 6)) if not (q == "y" and a == "d069")]
    rankings = spark.createDataFrame(rows, "query_id string, arm string, doc int, pos int")
    got = {(r.a, r.b): r.s for r in clustering.top_overlap(rankings, spark.createDataFrame([(a,) for a in names], "arm string"), 4).collect()}
    tops = {}
    for q, a, d, p in rows:
        if p <= 4:
            tops.setdefault((q, a), set()).add(d)
    for a, b in (("d000", "d063"), ("d003", "d064"), ("d068", "d069")):
        own = [len(tops[q, a] & tops[q, b]) / len(tops[q, a] | tops[q, b]) for q in ("x", "y") if (q, a) in tops and (q, b) in tops]
        assert got[a, b] == pytest.approx(sum(own) / len(own))
    assert len(got) == 70 * 69 // 2


def test_splits_are_written_at_once_and_exchanged(spark, tmp_path, monkeypatch):
    rows = [(f"q{i}", [[float(i)]], [i % 5], "set 1" if i % 2 else "set+2", ("train", "test")[i % 3 == 0]) for i in range(30)]
    table = spark.createDataFrame(rows, "query_id string, features array<array<float>>, relevance array<int>, set string, split string")
    folder = str(tmp_path / "data")
    told = groups.write_splits(table, folder, 4)
    assert told == dict(Counter(f"{r[3]}/{r[4]}" for r in rows))
    assert {r.query_id for r in groups.read_groups(spark, f"{folder}/set 1/test").collect()} == {r[0] for r in rows if r[3:] == ("set 1", "test")}
    found = reports.profile_splits(spark, folder)
    assert {f"{s}/{p}": v["queries"] for s, own in found.items() for p, v in own.items()} == told
    with pytest.raises(Exception, match="killed"):  # a write that fails leaves what was there
        groups.write_splits(table.withColumn("query_id", F.when(F.col("query_id") == "q7", F.raise_error(F.lit("killed"))).otherwise(F.lit("new"))), folder, 4)
    assert reports.profile_splits(spark, folder) == found
    groups.write_splits(table.where("set = 'set 1' and split = 'test'").limit(1), folder)
    again = reports.profile_splits(spark, folder)
    assert again["set 1"]["test"]["queries"] == 1 and again["set 1"]["train"] == found["set 1"]["train"] and again["set+2"] == found["set+2"]
    assert sorted(p.name for p in (tmp_path / "data" / "set 1").iterdir()) == ["test", "train"]


def test_success_of_a_run_is_told_in_its_document(spark):
    docs = spark.createDataFrame([(f"q{i // 4}", i % 4, (i * 7) % 3, [float(i * 5 % 7)]) for i in range(40)], "query_id string, doc int, rel int, features array<double>")
    gains = telemetry.mean_gains(ranking.ranked(docs, {"best": ranking.by_relevance(), "one": ranking.by_feature(0)}))
    by_arm = {r.arm: r.gain for r in gains.collect()}
    assert by_arm["best"] == 1.0 > by_arm["one"] > 0
    log = spark.createDataFrame([(t, ("one", "best", None, "best", "best")[t]) for t in range(5)], "round int, winner string")
    told = experiment.success_metrics(log, gains)
    assert told == {"n_evaluations": 4, "success_rate": 0.75, "sample_complexity_95": None, "final_success": True, "final_gap_pct": 0.0}
    assert experiment.success_metrics(log.where("winner is null"), gains) == {"n_evaluations": 0}
