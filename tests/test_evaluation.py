"""Ranker evaluation: oracles on the smoke tables, traps on small inputs, and invariants."""

import itertools
import json
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom import experiment
from rankloom.functions.gains import array_dcg, ratio
from rankloom.functions.running import running_sums
from rankloom.operators import adaptive, clustering, learners, policy, ranking, reports, rounds, stats, telemetry, trees
from rankloom.plans import registry
from rankloom.sources import groups, letor
from rankloom.streaming import online

SMOKE = "/root/testdata/sf0.001"
TABLES = "events embeddings lineitem orders documents".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMOKE}/{t}.parquet')")
    return con


def _plain(rows):
    return sorted(tuple("N" if v is None else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_its_sql(spark, oracle, name):
    got = registry.QUERIES[name](spark, SMOKE)
    answer = oracle.execute(registry.SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(got.columns)
    rows = answer.fetchall()
    assert _plain([tuple(r[c] for c in sorted(columns)) for r in got.collect()]) == _plain([tuple(r[columns.index(c)] for c in sorted(columns)) for r in rows])


def test_dcg_of_a_list(spark):
    row = spark.createDataFrame([([3, 2, 0, 1],), ([],)], "r array<int>").select(array_dcg("r").alias("g")).collect()
    assert row[0].g == pytest.approx(4.692536, abs=1e-6) and row[1].g == 0
    assert spark.range(1).select(ratio(F.lit(0.0), F.lit(0.0)).alias("x")).first().x == 1.0


def test_snake_draft(spark):
    lists = spark.createDataFrame([("q", a, list(range(6))) for a in "ABC"], "query_id string, arm string, ranking array<int>")
    order = spark.createDataFrame([(1, "q")], "round int, query_id string")
    slate = rounds.drafted(lists, order, 6).first().slate
    arms = [x.arm for x in slate]
    assert [x.doc for x in slate] == list(range(6)) and arms[:3] == arms[:2:-1] and set(arms) == set("ABC")
    assert rounds.drafted_any({a: list(range(6)) for a in "ABC"}, list("ABC"), 6)[1] == dict(zip(range(6), "ABCCBA", strict=True))
    assert rounds.drafted_any({}, ["A"], 5) == ([], {}) and rounds.drafted_any({"A": [1]}, ["A", "B"], 5) == ([1], {1: "A"})


@given(st.integers(1, 12), st.integers(1, 5), st.integers(1, 12), st.integers(0, 1000))
@settings(max_examples=200, deadline=None)
def test_drafts_are_fair(n, k, size, seed):
    rng = np.random.default_rng(seed)
    lists = {f"a{i}": rng.permutation(n).tolist() for i in range(k)}
    slate, by = rounds.drafted_any(lists, list(lists), size)
    counts = [list(by.values()).count(a) for a in lists]
    assert len(slate) == len(set(slate)) == min(size, n) and max(counts) - min(counts) <= 1


def test_click_models(spark):
    rows = spark.createDataFrame([(1, p, r) for p, r in enumerate([1, 2, 3, 4])] + [(2, 0, 1)], "round int, pos int, rel int")
    assert [(r.round, r.pos) for r in rounds.cascade_clicks(rows).collect()] == [(1, 2)]
    chance = {(r.pos, r.rel): r.c for r in rows.select("pos", "rel", rounds.click_chance().alias("c")).collect()}
    assert chance[0, 1] == pytest.approx(0.1) and chance[3, 4] == pytest.approx(0.7 * 0.95)
    assert rounds.examination(12)[10:] == pytest.approx([0.09, 0.081]) and rounds.examination(3, []) == pytest.approx([1.0, 0.9, 0.81])
    with pytest.raises(KeyError):
        rounds.scenario("none")
    clicked = spark.createDataFrame([(1, 1, "b"), (1, 4, "a")], "round int, pos int, arm string")
    assert rounds.first_click_winners(clicked).first().winner == "b"


def test_click_rates_are_those_of_the_tables():
    rng, n = np.random.default_rng(1), 20_000
    rel = np.array([4, 0, 3])
    rates = np.bincount([p for _ in range(n) for p in adaptive.clicks_of(rel, "standard", rng, 10)], minlength=3) / n
    for rate, p in zip(rates, [0.95, 0.009, 0.48], strict=True):
        assert abs(rate - p) < 4 * np.sqrt(p * (1 - p) / n) + 1e-9


def test_discount_transfer_and_bounds(spark):
    outcomes = spark.createDataFrame([(1, "r", "x", 1.0)], "round int, winner string, loser string, credit double")
    assert policy.pair_stats(outcomes, 0.5, 3).where("i = 'r'").first().w == 0.25
    with pytest.raises(ValueError):
        policy.pair_stats(outcomes, 1.0, 3)
    arms = spark.createDataFrame([(0, "r"), (1, "a"), (2, "b"), (3, "x")], "ord int, arm string")
    cells = policy.grid(arms, policy.pair_stats(outcomes))
    source = spark.createDataFrame([("a", "r"), ("b", "r")], "arm string, source string")
    moved = {(r.i, r.j): (r.w, r.n) for r in policy.inherited(cells, source, arms).collect()}
    assert all(moved[i, j] == (0, 0) for i in "rab" for j in "rab" if i != j) and moved["a", "x"] == (1.0, 1) == moved["r", "x"]
    assert policy.upper_bounds(cells, 10).where("n = 0").select("ucb").distinct().first().ucb == 1.0
    with pytest.raises(ValueError):
        policy.check_dueling(0.5, 1.0, 0)


def test_kernel_and_plans_agree(spark):
    x = registry.Log(spark, SMOKE)
    wins = {r.round: r.winner for r in x.winners.collect()}
    tracker, faded = adaptive.Tracker(4), adaptive.Tracker(4, 0.995)
    for t in range(1, x.t + 1):
        for k in (tracker, faded):
            k.update(registry.ARMS.index(wins[t]) if t in wins else None, [0, 1, 2, 3])
    cells = {(r.i, r.j): r for r in x.cells.collect()}
    old = {(r.i, r.j): r for r in policy.pair_stats(x.outcomes, 0.995, x.t).collect()}
    for i, a in enumerate(registry.ARMS):
        for j, b in enumerate(registry.ARMS):
            if i != j:
                assert tracker.wins[i, j] == cells[a, b].w and tracker.met[i, j] == cells[a, b].n
                assert faded.wins[i, j] == pytest.approx(old[a, b].w if (a, b) in old else 0) and faded.wins[i, j] <= tracker.wins[i, j]
                assert cells[a, b].w + cells[b, a].w == cells[a, b].n == cells[b, a].n
    kernel = adaptive.Dueling(4, np.random.default_rng(0), n_min=0)
    kernel.tracker = tracker
    chosen = policy.dueling_selection(policy.set_membership(x.cells, x.arms, x.t, 0), x.t, 0)
    assert sorted(registry.ARMS[i] for i in kernel.select()) == sorted(r.arm for r in chosen.collect())


def test_policies():
    rng = np.random.default_rng(0)
    for bad in ({"alpha": 0.5}, {"beta": 0.5}, {"n_min": -1}):
        with pytest.raises(ValueError):
            adaptive.Dueling(2, rng, **bad)
    with pytest.raises(ValueError):
        adaptive.create_policy("fixed:z", ["a"], rng)
    with pytest.raises(ValueError):
        adaptive.create_policy("none", ["a"], rng)
    assert adaptive.create_policy("FIXED:b", ["a", "b"], rng).select() == [1]
    assert isinstance(adaptive.create_policy("ts", ["a", "b"], rng), adaptive.Thompson)
    two = adaptive.TwoLevel(4, rng, clusters={0: [0, 1], 1: [2, 3]}, reps={0: 0, 1: 2}, level1_rounds=3, n_min=100)
    for _ in range(3):
        assert two.select() == [0, 2]
        two.update(2, [0, 2])
    assert set(two.select()) == {2, 3} and two.level == 2 and two.tracker.wins[3, 0] == 3 and two.tracker.t == 3
    cold = adaptive.TwoLevel(4, rng, clusters={0: [0, 1], 1: [2, 3]}, reps={0: 0, 1: 2}, level1_rounds=1, n_min=5, warm=False)
    cold.update(0, [0, 2])
    assert cold.select() == [0, 1] and cold.tracker.t == 0


def test_runs_repeat_and_uniform_selects_all(spark):
    x = registry.Log(spark, SMOKE)
    runs = [{"run_id": "u", "policy": "uniform", "seed": 3}, {"run_id": "m", "policy": "mdb", "seed": 3, "settings": {"n_min": 10}}]
    first = sorted(adaptive.adaptive_runs(x.lists, x.docs, runs, list(registry.ARMS), 200).collect())
    assert first == sorted(adaptive.adaptive_runs(x.lists, x.docs, runs, list(registry.ARMS), 200).collect())
    assert all(len(r.arms) == 4 for r in first if r.run_id == "u") and all(r.regret >= 0 for r in first)


def test_runs_take_the_first_queries_of_many(spark):
    docs = spark.range(100_001).select(F.format_string("%06d", "id").alias("query_id"), F.lit(0).alias("doc"), F.lit(1).alias("rel"))
    lists = docs.select("query_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("arm"), F.array("doc").alias("ranking"))
    runs = [{"run_id": "u", "policy": "uniform", "seed": 3}, {"run_id": "m", "policy": "mdb", "seed": 3, "settings": {"n_min": 2}}]
    few = F.col("query_id") < "000007"
    got = sorted(adaptive.adaptive_runs(lists, docs, runs, ["a", "b"], 7).collect())
    assert [r.query_id for r in got if r.run_id == "u"] == [f"{i:06d}" for i in range(7)]
    assert got == sorted(adaptive.adaptive_runs(lists.where(few), docs.where(few), runs, ["a", "b"], 7).collect())


def test_runs_hold_a_batch_of_rounds(spark):
    """A run reads its rounds one by one, and queries that are replayed come as rows of their later rounds."""
    query = ("q", np.array([0, 3, 1]), {"a": [0, 1, 2], "b": [2, 1, 0]})
    endless = ((t, query) for t in itertools.count(1))
    rng = np.random.default_rng(1)
    some = list(itertools.islice(adaptive.played(endless, ["a", "b"], adaptive.Policy(2, rng), rng, "standard"), 50))
    assert [r[1] for r in some] == list(range(1, 51)) and next(endless)[0] == 52
    docs = spark.createDataFrame([(q, d, (3 * d) % 4) for q in "xyz" for d in range(3)], "query_id string, doc int, rel int")
    lists = spark.createDataFrame([(q, a, r) for q in "xyz" for a, r in (("a", [0, 1, 2]), ("b", [2, 1, 0]))], "query_id string, arm string, ranking array<int>")
    found = adaptive.adaptive_runs(lists, docs, [{"run_id": "u", "policy": "uniform", "seed": 3}], ["a", "b"], 7)
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(found.collect(), key=lambda r: r.round)
    assert [r.query_id for r in got] == list("xyzxyzx") and [r.stats is not None for r in got] == [False] * 6 + [True]
    rng = np.random.default_rng(3)
    queries = [(q, np.array([0, 3, 2]), {"a": [0, 1, 2], "b": [2, 1, 0]}) for q in "xyz"]
    assert [tuple(r) for r in got] == adaptive.simulate(queries, ["a", "b"], adaptive.Policy(2, rng), rng, 7, "standard", run_id="u")


def test_progress_has_many_intervals_a_batch(spark):
    from rankloom.streaming import online

    rows = [(r, "a", x, 1.0) for r in range(1, 301) if r % 10 for x in ("b", "c")]
    got = online.progress(spark.createDataFrame(rows, "round int, winner string, loser string, credit double"), every=2).collect()
    told = {}
    for r, *_ in rows:
        told.setdefault((r - 1) // 2, []).append(r)
    assert sorted(tuple(r)[1:] for r in got) == sorted((min(v), max(v), len(v), float(len(v))) for v in told.values())
    assert len({r.batch for r in got}) == 3


def test_sample_efficiency_counts_every_round(spark, monkeypatch):
    late = SimpleNamespace(winners=spark.range(500, 1000).select(F.col("id").alias("round"), F.lit("oracle").alias("winner")), t=1000)
    monkeypatch.setattr(registry, "Log", lambda *_: late)
    assert registry.QUERIES["sample_efficiency"](spark, "").first().first_round == 715


def test_boosted_rank_trains_the_whole_model(spark, monkeypatch):
    trained = []
    monkeypatch.setattr(learners.BoostedRanker, "scored", lambda self, docs: trained.append(self) or docs.withColumn("score", F.lit(0.0)))
    registry.QUERIES["boosted_rank"](spark, SMOKE)
    assert len(trained[-1].trees) == 100 and max(t.depth() for t in trained[-1].trees) == 6


def test_trees_raise_scores_where_documents_lie(spark):
    """In arrays of a query's documents as row by row, and without an exchange of rows."""
    docs = spark.createDataFrame([(str(i % 7), i // 7, i % 5, [float(i % 11), float(i % 3)]) for i in range(140)], "query_id string, doc int, rel int, features array<double>")
    model = learners.boosted(docs, 3, depth=2)
    assert len(model.trees) == 3
    one = F.struct("doc", "rel", "features", F.lit(0.0).alias("score"))
    groups = docs.groupBy("query_id").agg(F.collect_list(one).alias("d"))
    raised = model.raised(groups).selectExpr("query_id", "inline(d)").select("query_id", "doc", "score")
    got, expected = ({(r.query_id, r.doc): r.score for r in x.collect()} for x in (raised, model.scored(docs)))
    assert len(got) == 140 and len(set(got.values())) > 2 and got == pytest.approx(expected, abs=1e-12)
    assert str(model.raised(groups)._jdf.queryExecution().optimizedPlan()).count("Aggregate") == 1 and not spark.sparkContext._jsc.getPersistentRDDs()


def test_trees_take_few_jobs_and_any_dealing(spark):
    """Three jobs a tree of depth 6, and the same trees however documents are dealt to tasks."""
    rows = spark.range(12_000).select(F.expr("cast(id % 900 as string) as query_id"), F.expr("cast(id div 900 as int) as doc"), F.expr("cast(pmod(xxhash64(id), 5) as int) as rel"))
    docs = rows.withColumn("features", F.expr("array(pmod(xxhash64(query_id, doc), 7919) / 8 + rel, cast(doc as double), pmod(xxhash64(doc, query_id), 24) / 3D)"))
    sc = spark.sparkContext
    sc.setJobGroup("trees", "trees")
    one = learners.boosted(docs, 4)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("trees")) <= 4 * 3 + 8
    with_fewer = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = learners.boosted(docs.orderBy(F.xxhash64("doc", "query_id")).repartition(5), 4)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_fewer)
    assert other == one and [t.depth() for t in one.trees] == [6] * 4


@pytest.mark.parametrize("paired", [1 << 22, 0])
def test_trees_are_those_of_spark_ml(spark, monkeypatch, paired):
    """Where splits are few, with two levels a job and with one; missing features go right."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import DecisionTreeRegressor

    monkeypatch.setattr(trees, "PAIRED", paired)
    rng = np.random.default_rng(5)
    rows = [(f"{i % 40}", i // 40, int(rng.integers(4)), [float(rng.integers(20)), float(rng.integers(5)), float(rng.integers(9)) / 4]) for i in range(1000)]
    docs = spark.createDataFrame(rows, "query_id string, doc int, rel int, features array<double>")
    pushes = [(x, sum((r > s) - (r < s) for p, _, s, _ in rows if p == q) / 2) for q, _, r, x in rows]
    train = spark.createDataFrame(pushes, "features array<double>, label double").withColumn("v", array_to_vector("features"))
    told = DecisionTreeRegressor(featuresCol="v", maxDepth=5).fit(train).transform(train).select("prediction").collect()
    got = learners.boosted(docs, 1, depth=5, rate=1.0).scored(docs).select("score").collect()
    assert [r.score for r in got] == pytest.approx([r.prediction for r in told], abs=1e-6)


def test_gradients_of_a_block(monkeypatch):
    rng = np.random.default_rng(6)
    sizes, rel, scores = np.array([3, 1, 30, 3, 700]), rng.integers(0, 4, 737).astype(float), rng.normal(0, 300, 737)
    rel[5] = np.nan
    expected, at = [], 0
    for n in sizes.tolist():
        docs = range(at, at + n)
        expected += [sum(1 / (1 + np.exp(min(700, scores[i] - scores[j]))) if rel[i] > rel[j] else -1 / (1 + np.exp(min(700, scores[j] - scores[i]))) if rel[i] < rel[j] else 0 for j in docs) for i in docs]
        at += n
    assert trees.pushes(sizes, rel, scores) == pytest.approx(expected, abs=1e-6)
    monkeypatch.setattr(trees, "PAIRS", 1000)
    assert trees.pushes(sizes, rel, scores) == pytest.approx(expected, abs=1e-6)


def test_blocks_hold_whole_queries(monkeypatch):
    """Across Arrow batches and the size of a block, and that of a null query too."""
    monkeypatch.setattr(trees, "DOCUMENTS", 4)
    queries = [None] * 3 + ["a"] * 11 + ["b"] + ["c"] * 4 + ["d"] * 2
    table = pa.table({"query_id": queries, "rel": np.arange(21.0), "features": [[float(i), None] for i in range(21)], "key": np.arange(21)})
    for size in (1, 2, 5, 30):
        got = list(trees.blocks(iter(table.to_batches(size))))
        sizes = [np.frombuffer(b["sizes"][0].as_py(), np.int32).tolist() for b in got]
        features = [np.frombuffer(b["features"][0].as_py()).reshape(2, -1) for b in got]
        assert sum(sizes, []) == [3, 11, 1, 4, 2] and (size == 30 or len(sizes) > 1)
        assert np.concatenate([x[0] for x in features]).tolist() == list(range(21)) and all(np.isnan(x[1]).all() for x in features)


def test_splits_of_many_values(monkeypatch):
    few = trees.merged((np.array([1.0, 3.0]), np.array([2, 5])), (np.array([2.0, 3.0]), np.array([1, 1])))
    assert few[0].tolist() == [1, 2, 3] and few[1].tolist() == [2, 1, 6] and trees.splits(few).tolist() == [1.5, 2.5]
    even = trees.splits((np.arange(3200.0), np.ones(3200)))
    assert even.tolist() == [100 * i - 0.5 for i in range(1, 32)]
    monkeypatch.setattr(trees, "POINTS", 320)
    parts = [trees._fewer(np.arange(a, 32_000.0, 4), np.ones(8000)) for a in range(4)]
    many = trees.splits(trees.merged(trees.merged(parts[0], parts[1]), trees.merged(parts[2], parts[3])))
    assert len(many) == 31 and max(abs(x - 1000 * i) for i, x in enumerate(many, 1)) < 320


def test_density_clusters():
    near = np.full((9, 9), 0.9)
    for block in (range(0, 4), range(4, 8)):
        for i in block:
            for j in block:
                near[i, j] = 0.1 if i != j else 0.0
    near[8, 8] = 0
    labels = clustering.density_labels(near, 3)
    assert len(set(labels[:4])) == len(set(labels[4:8])) == 1 and labels[0] != labels[4] and labels[8] == -1
    rows = clustering.clustered(1 - near, [str(i) for i in range(9)], 3)
    assert len({c for c, _, _ in rows}) == 3
    assert len({c for c, _, _ in clustering.clustered(np.eye(2), ["a", "b"], 5)}) == 2


def test_tests_and_resampling(spark):
    p = spark.createDataFrame(list(enumerate([0.001, 0.02, 0.03])), "idx int, p double")
    got = stats.holm(p).orderBy("idx").collect()
    assert [r.threshold for r in got] == pytest.approx([0.0166667, 0.025, 0.05], abs=1e-6) and all(r.rejected for r in got)
    five = spark.createDataFrame(list(enumerate([0.01, 0.03, 0.05, 0.08, 0.15])), "idx int, p double")
    assert not any(r.rejected for r in stats.holm(five).collect() + stats.bonferroni(five).collect())
    none = spark.createDataFrame([], "idx int, x double")
    assert tuple(stats.bootstrap_interval(none, n_bootstrap=10).first()) == (0, 0, 0)
    unequal = spark.createDataFrame([(0, 1.0, None)], "idx int, a double, b double")
    with pytest.raises(Exception, match="unequal"):
        stats.paired_permutation(unequal, 5).collect()
    same = spark.createDataFrame([(i, 1.0, 0.0) for i in range(3)], "idx int, a double, b double")
    assert stats.paired_permutation(same, 50).first().effect == 0


def test_costs_and_success(spark):
    levels = spark.createDataFrame([(i, 1 if i < 2000 else 2) for i in range(10_000)], "round int, level int")
    assert telemetry.cost_reduction(levels, 100, 10, 5).first().ratio == pytest.approx(16.666667, abs=1e-6)
    assert telemetry.cost_reduction(levels.where("false"), 100, 10, 5).first().ratio == 1.0
    gains = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "arm string, gain double")
    asked = spark.createDataFrame([(1, 5, "a", False), (2, 6, "zz", True), (3, 7, "b", False)], "seq long, round int, arm string, is_final boolean")
    judged = telemetry.success(asked, gains, 0.1)
    assert [(r.success, r.gap, r.valid) for r in judged.orderBy("seq").collect()] == [(True, 0.0, True), (False, 1.0, False), (False, 0.5, True)]
    assert telemetry.sample_complexity(judged).first()[0] == 5
    zero = telemetry.success(asked, gains.withColumn("gain", F.lit(0.0)), 0.1).orderBy("seq").first()
    assert (zero.success, zero.gap, zero.valid) == (True, 0.0, False)


def test_running_sums_cross_blocks(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(50)], "i int, v int")
    got = {r.i: r.s for r in running_sums(rows, "i", {"s": "v"}, size=7).collect()}
    assert got == {i: sum(k % 3 for k in range(i + 1)) for i in range(50)}


def test_chunks_and_letor(spark, tmp_path):
    x = registry.Log(spark, SMOKE)
    nested = groups.nested(x.docs)
    folder = str(tmp_path / "set1" / "test")
    groups.write_groups(nested, folder, 20)
    spark.range(3).write.parquet(f"{folder}/other.parquet")  # only chunk files are read
    assert groups.read_groups(spark, folder).count() == nested.count() > groups.read_groups(spark, folder, 1).count() > 0
    assert groups.read_groups(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        groups.checked(nested.drop("relevance"))
    lines = spark.createDataFrame([(1, "2 qid:a 1:0.5 3:1 x 3:2 # 4:9"), (2, "0 qid:a"), (3, "bad"), (4, "1 qid:b 9:1"), (5, "3 qid:a 2:-1.5"), (6, "")], "line_no long, line string")
    got = letor.grouped(letor.dense(letor.parsed(lines), 3)).collect()
    assert sorted((r.query_id, [list(f) for f in r.features], list(r.relevance)) for r in got) == [
        ("a", [[0.0, -1.5, 0.0]], [3]), ("a", [[0.5, 0.0, 2.0], [0.0, 0.0, 0.0]], [2, 0]), ("b", [[0.0, 0.0, 0.0]], [1])
    ]
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "set1.train.txt").write_text("1 qid:1 1:2\n0 qid:1 2:1\n2 qid:2 1:1\n1 qid:1 1:1\n")
    assert letor.converted(spark, str(raw), str(tmp_path / "out"), 3) == {"set1/train": 3}


def test_learners(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 3))
    rows = spark.createDataFrame([(str(i // 10), i % 10, int(2 * v[0] > 0), v.tolist(), float(v[0] > 0)) for i, v in enumerate(x)], "query_id string, doc int, rel int, features array<double>, reward double")
    one = learners.LinearBandit(3).fit(rows.withColumnRenamed("features", "x"))
    two = learners.LinearBandit(3)
    for v in x:
        two.update(v, float(v[0] > 0))
    assert np.allclose(one.a, two.a) and np.allclose(one.b, two.b)
    inverse = np.linalg.inv(one.a)
    got = [r.s for r in rows.withColumnRenamed("features", "x").withColumn("s", one.optimistic()).orderBy("query_id", "doc").collect()]
    assert np.allclose(got, [v @ inverse @ one.b + np.sqrt(v @ inverse @ v) for v in x])
    shape = learners.projection(rows, 2)
    p = np.array([r.p for r in rows.withColumn("p", shape.column()).collect()])
    assert p.shape == (60, 2) and np.allclose(p.mean(axis=0), 0, atol=1e-9)
    model = learners.boosted(rows, n_trees=3, depth=2)
    ranks = ranking.ranked(model.scored(rows), {"b": F.col("score"), "bad": -F.col("score")})
    means = {r.arm: r.m for r in ranks.where("rel = 1").groupBy("arm").agg(F.avg("pos").alias("m")).collect()}
    assert means["b"] < means["bad"]
    assert [r.doc for r in ranking.ranked(learners.BoostedRanker().scored(rows), {"u": F.col("score")}).where("query_id = '0'").orderBy("pos").collect()] == list(range(10))


def test_results_round_trip(spark, tmp_path):
    x = registry.Log(spark, SMOKE)
    config = experiment.Config(n_rounds=120, arm_pool=("random", "single_feature", "linucb"), grace_period=50, max_train_queries=50)
    result = experiment.run(spark, x.docs, config)
    assert result["metrics"]["iterations"] == 120 and sum(result["win_rates"].values()) == pytest.approx(1)
    path = reports.save_result(result, folder=str(tmp_path))
    assert json.loads(open(path).read())["logical_cost"]["total_queries"] == 120
    back = reports.read_results(spark, str(tmp_path)).first()
    assert back.config.scenario == "standard" and back.selection_rates["random"] == result["selection_rates"]["random"]
    two = experiment.run(spark, x.docs, experiment.Config(n_rounds=60, arm_pool=("random", "single_feature", "linear_ts"), hierarchical=True, clustering="random", level1_rounds=20, grace_period=5))
    assert two["metrics"]["iterations"] == 60
    with pytest.raises(ValueError):
        adaptive.chosen(adaptive.DRAFTS, "none")
    config, given = experiment.config_of(["--quick", "--policy", "thompson", "--no-warm-start"])
    assert (config.n_rounds, config.policy, config.warm_start) == (1000, "thompson", False)


def test_stream_replay_equals_batch(spark, tmp_path):
    x = registry.Log(spark, SMOKE)
    rows = x.outcomes.withColumn("run_id", F.lit("u")).select("run_id", "round", "winner", "loser", "credit")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    got = online.replay(online.outcomes_from(spark, str(tmp_path / "in")), "pairs", str(tmp_path / "check"))
    batch = {(r.i, r.j): (r.w, r.n) for r in policy.pair_stats(x.outcomes).collect()}
    assert {(r.i, r.j): (r.w, r.n) for r in got.collect()} == batch
    assert online.selected_arms(got, x.arms, "u", n_min=0).count() >= 1


def learnable(rng, n=40):
    """Queries whose documents are relevant where the first feature is large."""
    out = []
    for i in range(n):
        x = rng.standard_normal((8, 3)) * [0.5, 1.0, 1.0]
        rel = (x[:, 0] > 0.4).astype(int) * 4
        out.append((f"q{i:02d}", rel, {"bad": np.argsort(x[:, 0]).tolist()}, x))
    return out


@pytest.mark.parametrize("make", [lambda b: learners.LiveLinUCB(b, 0.5), lambda b: learners.LiveThompson(b, 3)])
def test_arms_learn_from_clicks(make):
    rng = np.random.default_rng(2)
    queries, arm = learnable(rng), make(learners.LinearBandit(3))
    rows = adaptive.simulate(queries, ["bad", "linucb"], adaptive.Policy(2, rng), rng, 600, "standard", live={"linucb": arm})
    wins = [r[4] == "linucb" for r in rows if r[4] is not None]
    assert sum(wins[-100:]) > 80 > 70 > sum(wins[:20]) and all(r[8] == 1 for r in rows)
    weights = np.linalg.solve(arm.a, arm.b)
    assert weights[0] > 2 * np.abs(weights[1:]).max()
    assert np.allclose(arm.inverse, np.linalg.inv(arm.a))
    stats = json.loads(rows[-1][-1])
    assert stats["t"] == 600 and stats["W"][1][0] == sum(wins) and rows[0][-1] is None


def test_live_linear_arm_is_the_batch_one(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20, 3))
    live, batch = learners.LiveLinUCB(learners.LinearBandit(3)), learners.LinearBandit(3)
    for v in x[:12]:
        live.update(v, 1.0)
        batch.update(v, 1.0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc int, x array<double>")
    assert live.rank(x) == [r.doc for r in rows.withColumn("s", batch.optimistic()).orderBy(F.desc("s"), "doc").collect()]


def test_policies_tell_their_statistics():
    rng, arms = np.random.default_rng(0), list("abcd")
    mdb = adaptive.create_policy("mdb", arms, rng, n_min=2)
    for _ in range(400):
        mdb.update(0, [0, 1, 2, 3])
    told = mdb.statistics(arms)
    assert (told["set_E"], told["set_F"], told["in_grace_period"], told["t"]) == (["a"], ["a"], False, 400)
    rucb = adaptive.create_policy("multi_rucb", arms, rng, n_min=0, m=2, discount=0.99)
    for _ in range(400):
        rucb.update(1, [0, 1, 2, 3])
    assert rucb.select() == [1]
    told = rucb.statistics(arms)
    assert (told["candidate_set_C"], told["hypothesized_best_B"], told["m"], told["tracker_type"]) == (["b"], "b", 2, "discounted") and told["effective_t"] == pytest.approx(100)
    two = adaptive.create_policy("hierarchical", arms, rng, clusters={0: [0, 1], 1: [2, 3]}, reps={0: 0, 1: 2}, level1_rounds=1, n_min=100)
    assert two.statistics(arms) | {"W": 0, "N": 0} == {"t": 0, "effective_t": 0.0, "W": 0, "N": 0, "tracker_type": "cumulative", "current_level": 1, "level1_rounds": 1, "winning_cluster_id": None, "active_arms": ["a", "c"], "n_clusters": 2, "warm_start": True, "alpha": 0.51, "beta": 1.0, "n_min": 100, "in_grace_period": True}
    two.update(2, [0, 2])
    two.select()
    assert two.statistics(arms)["winning_cluster_id"] == 1 and two.statistics(arms)["active_arms"] == ["c", "d"]
    ts = adaptive.create_policy("ts", arms, rng)
    ts.update(2, [2])
    ts.update(None, [1])
    assert ts.statistics(arms)["posterior_a"]["c"] == 2 and ts.statistics(arms)["posterior_b"]["b"] == 2


def test_own_users_drafts_credit_and_arms(spark, monkeypatch):
    monkeypatch.setitem(rounds.SCENARIOS, "last", rounds.Scenario("last"))
    monkeypatch.setitem(adaptive.CLICK_MODELS, "last", lambda rel, told, rng, size: [len(rel) - 1])
    monkeypatch.setitem(adaptive.DRAFTS, "first_arm", lambda rankings, order, size: (rankings["a"][:size], dict.fromkeys(rankings["a"], "a")))
    monkeypatch.setitem(adaptive.CREDITS, "half", lambda clicked, slate, by, participants: (0, {(0, 1): 0.5}))
    queries = [("q", np.array([1, 2, 3]), {"a": [2, 1, 0], "b": [0, 1, 2]})]
    rng = np.random.default_rng(1)
    rows = adaptive.simulate(queries, ["a", "b"], adaptive.Policy(2, rng), rng, 4, "last", draft=adaptive.DRAFTS["first_arm"], credit=adaptive.CREDITS["half"])
    assert [r[4] for r in rows] == ["a"] * 4 and json.loads(rows[-1][-1])["W"] == [[0.0, 2.0], [0.0, 0.0]]
    monkeypatch.setitem(experiment.OWN_ARMS, "mine", lambda config: F.col("features")[1])
    x = registry.Log(spark, SMOKE)
    result = experiment.run(spark, x.docs, experiment.Config(n_rounds=30, arm_pool=("mine", "random"), grace_period=5))
    assert set(result["selection_rates"]) == {"mine", "random"}


def test_own_result_documents_feed_the_reports(spark, tmp_path):
    x = registry.Log(spark, SMOKE)
    small = dict(n_rounds=80, arm_pool=("single_feature", "linucb", "linear_ts"), grace_period=20, max_train_queries=40)
    configs = [experiment.Config(**small, policy="mdb", scenario=s) for s in ("standard", "cascade")] + [experiment.Config(**small, policy="uniform")]
    results = experiment.Sweep(configs).run(spark, x.docs)
    assert [(r["config"]["policy"], r["config"]["scenario"]) for r in results] == [("mdb", "standard"), ("mdb", "cascade"), ("uniform", "standard")]
    alone = experiment.run(spark, x.docs, configs[1])
    assert alone["history"] == results[1]["history"] and alone["policy_stats"] == results[1]["policy_stats"]
    for i, r in enumerate(results):
        assert r["history"]["cumulative_ndcg_regret"][-1] == r["metrics"]["total_ndcg_regret"] and len(r["history"]["cumulative_ndcg_regret"]) == 80
        assert r["inference_stats"]["total_inferences"] == r["logical_cost"]["total_evaluations"] == sum(r["inference_stats"]["arm_costs"].values())
        reports.save_result(r, str(tmp_path / f"phase1_{i}_run_seed-42.json"))
    told = reports.report(spark, str(tmp_path))
    assert {r["scenario"] for r in told["convergence"]} == {"standard", "cascade"} and all(r["set_e"] for r in told["convergence"])
    assert {r["arm"] for r in told["common_survivor"]} <= set(small["arm_pool"]) and told["cost_findings"][0]["policy"] == "mdb"
    (tmp_path / "empty").mkdir()
    assert reports.report(spark, str(tmp_path / "empty")) == reports.report(spark, str(tmp_path / "none")) == {}
    with pytest.raises(ValueError):
        experiment.runs(spark, x.docs, [configs[0], experiment.Config()])


def test_two_level_result_and_cached_rankings(spark):
    x = registry.Log(spark, SMOKE)
    config = experiment.Config(n_rounds=60, arm_pool=("random", "single_feature", "feature_1", "feature_2"), hierarchical=True, clustering="random", level1_rounds=20, grace_period=5, cache_arms=4)
    result = experiment.run(spark, x.docs, config)
    assert result["hierarchical"] == {"enabled": True} and result["cost_metrics"]["level1_rounds"] == 20 and result["policy_stats"]["current_level"] == 2
    assert result["cache_stats"]["cache_hits"] == result["logical_cost"]["total_evaluations"] and result["inference_stats"]["total_inferences"] == 0
    assert result["cache_stats"]["n_cached_queries"] == x.order.count()


def test_trained_arms_are_saved_and_loaded(spark, tmp_path):
    x = registry.Log(spark, SMOKE)
    config = experiment.Config(n_rounds=20, arm_pool=("xgb_d3_n2_lr20_ss70_cs70", "linucb", "linear_ts"), grace_period=5, max_train_queries=30, pca_dim=2)
    folder = str(tmp_path / "arms")
    first = experiment.run(spark, x.docs, config, save_arms=folder)
    arms = learners.Arms.load(spark, folder)
    ranker = arms.boosted["xgb_d3_n2_lr20_ss70_cs70"]
    assert len(ranker.trees) == 2 and ranker.rate == 0.2 and all(len(c) == 2 for c in ranker.columns) and arms.projection.components.shape == (4, 2)
    again = experiment.run(spark, x.docs, config, train=x.docs.where("false"), load_arms=folder)  # nothing to train on
    assert again["history"] == first["history"]
    assert learners.Arms.load(spark, str(tmp_path / "none")) is None
    assert ranking.boosted_settings("xgb_d10_n100_lr5_cs70") == {"depth": 10, "n_trees": 100, "rate": 0.05, "rows": 1.0, "columns": 0.7}
    with pytest.raises(ValueError):
        ranking.boosted_settings("xgb_10")


def test_rankings_and_profiles_are_kept(spark, tmp_path):
    x = registry.Log(spark, SMOKE)
    lists, told = ranking.precomputed(x.docs, ranking.event_arms(), str(tmp_path / "cache"))
    key = lambda rows: sorted((r.query_id, r.arm, list(r.ranking)) for r in rows.collect())
    assert key(lists) == key(x.lists) and told.count() == 4 and ranking.load_rankings(spark, str(tmp_path / "none")) is None
    groups.write_groups(groups.nested(x.docs), str(tmp_path / "data" / "set1" / "train"), 50)
    (tmp_path / "data" / "set1" / "valid").mkdir()
    found = reports.profile_splits(spark, str(tmp_path / "data"), str(tmp_path / "eda.json"))
    assert found["set1"]["train"]["queries"] == x.order.count() and found["set1"]["valid"] == {"error": "no chunks"}
    assert json.loads((tmp_path / "eda.json").read_text())["set1"]["train"]["documents"] == x.docs.count()
    assert len(reports.summary_lines(found)) == 2


def test_islands_cross_blocks(spark):
    qids = list("aabbbacca") + [None, None, "a", "a"]
    rows = spark.createDataFrame(list(enumerate(qids)), "line_no long, qid string")
    got = {r.line_no: r.island for r in letor.islands(rows, size=3).collect()}
    expected, n = {}, 0
    for i, q in enumerate(qids):
        n += i == 0 or q != qids[i - 1]
        expected[i] = n
    assert got == expected


def test_islands_of_lines_that_share_a_number(spark):
    """As in the SQL, a running sum is one for all lines of a number; which of them comes first is settled by qid."""
    rows = [(0, "a"), (1, "b"), (1, "a"), (2, "b"), (3, "c"), (3, "b"), (4, "b")]
    for some in (rows, rows[::-1]):
        got = sorted((r.line_no, r.qid, r.island) for r in letor.islands(spark.createDataFrame(some, "line_no long, qid string"), size=2).collect())
        assert got == [(0, "a", 1), (1, "a", 2), (1, "b", 2), (2, "b", 2), (3, "b", 3), (3, "c", 3), (4, "b", 4)]


def test_islands_of_shared_numbers_stand_in_the_order_of_rows(spark, monkeypatch):
    """Beyond 100,000 rounds, as in the SQL where its sort keeps the order of rows, which one thread's does."""
    sizes = {1: 3, 2: 1, 3: 2, 60: 2, 100_001: 2, 100_002: 3, 100_003: 2, 100_004: 1}
    order = spark.createDataFrame([(f"{'b' if r > 60 else 'a'}{r}", r) for r in sizes], "query_id string, round int")
    docs = order.select("query_id", F.explode(F.expr(f"sequence(0, map_from_entries(array({','.join(f'({r}, {n})' for r, n in sizes.items())}))[round] - 1)")).alias("doc"), F.lit(1).alias("rel"), F.expr("array(1D, 2D)").alias("features"))
    monkeypatch.setattr(registry, "Log", lambda *_: SimpleNamespace(docs=docs, order=order))
    lines = [(r * 1000 + d, f"{'b' if r > 60 else 'a'}{r}") for r, n in sizes.items() for d in range(n)]
    both = [(n, 0, n, q) for n, q in lines] + [(n + 100_000_000, 1, n, q) for n, q in lines if n < 50_000]
    both.sort(key=lambda x: x[0])
    new = [i == 0 or x[3] != both[i - 1][3] for i, x in enumerate(both)]
    told = {}
    for o, _, n, q in both:
        told.setdefault((sum(w for w, x in zip(new, both, strict=True) if x[0] <= o), q), []).append(n)
    got = registry.QUERIES["letor_group_islands"](spark, "").collect()
    assert sorted(map(tuple, got)) == sorted((*k, len(v), min(v)) for k, v in told.items())


def test_counters_fill_while_rounds_are_used(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, [])], "round int, participants array<string>")
    seen, counters = telemetry.observed(rows)
    assert seen.where("round < 3").count() == 2
    told = counters.get
    assert (told["total_queries"], told["total_inferences"], told["most_arms"]) == (3, 3, 2)


def test_command_lines(spark, tmp_path, capsys):
    """Text to chunks, an experiment on them, its document's report, and a profile of the chunks."""
    raw, data = tmp_path / "raw", tmp_path / "data"
    raw.mkdir()
    rng = np.random.default_rng(1)
    for split in ("train", "test"):
        lines = [f"{int(v > 0.5) * 3} qid:{q} 1:{v:.3f} 2:{w:.3f}" for q in range(30) for v, w in rng.random((6, 2))]
        (raw / f"set1.{split}.txt").write_text("\n".join(lines) + "\n")
    letor.main(["--raw-dir", str(raw), "--output-dir", str(data), "--num-features", "2", "--chunk-size", "10"])
    assert "set1/test: 30 queries" in capsys.readouterr().out
    out, arms = str(tmp_path / "phase1_1_run_seed-1.json"), str(tmp_path / "arms")
    flags = ["--data-path", str(data / "set1"), "--n-rounds", "50", "--arm-pool", "random", "linucb", "single_feature", "--grace-period", "10", "--output", out, "--seed", "1"]
    experiment.main([*flags, "--save-arms", arms])
    first = json.loads(open(out).read())
    experiment.main([*flags, "--load-arms", arms])
    assert json.loads(open(out).read())["history"] == first["history"] and first["metrics"]["iterations"] == 50
    capsys.readouterr()
    reports.main(["--results", str(tmp_path), "--data-dir", str(data), "--output", str(tmp_path / "eda" / "eda.json")])
    said = capsys.readouterr().out
    assert "set1/train: 30 queries, 180 documents" in said and '"policy_comparison"' in said
    assert json.loads((tmp_path / "eda" / "eda.json").read_text())["set1"]["test"]["max_docs"] == 6
