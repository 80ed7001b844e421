"""Queries of the ranker-evaluation engine, one for each operator, and their SQL.

Inputs are query groups made from ``events`` (four arms), wide ones from ``embeddings`` (an arm a dimension), and the log of
a run in which all four arms take part in every round. Ratios are rounded to six digits on both sides.
"""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.gains import dcg, ratio
from ..functions.rng import gamma_sql, normal_sql, uniform_sql
from ..operators import adaptive, clustering, learners, policy, ranking, reports, resampling, rounds, stats, telemetry
from ..scratch import shared_dir
from ..shipping import ship
from ..sources import groups, letor
from ..streaming import online

ARMS = ("value", "k", "recent", "oracle")
N_MIN, GAMMA = 500, 0.995
#: Dimensions of the embeddings, each of which is an arm of the wide queries.
DIMENSIONS = 64


def r6(c) -> F.Column:
    return F.round(c if not isinstance(c, str) else F.col(c), 6)


class Log:
    """Inputs and the uniform run's log for one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)

    @cached_property
    def docs(self) -> DataFrame:
        return groups.events_as_documents(self.spark, self.dir)

    @cached_property
    def order(self) -> DataFrame:
        return groups.query_order(self.docs)

    @cached_property
    def ranked(self) -> DataFrame:
        return ranking.ranked(self.docs, ranking.event_arms())

    @cached_property
    def lists(self) -> DataFrame:
        return ranking.listed(self.ranked)

    @cached_property
    def slates(self) -> DataFrame:
        return rounds.drafted(self.lists, self.order)

    @cached_property
    def shown(self) -> DataFrame:
        return rounds.slate_rows(self.slates, self.docs)

    @cached_property
    def winners(self) -> DataFrame:
        return rounds.first_click_winners(rounds.position_clicks(self.shown))

    @cached_property
    def outcomes(self) -> DataFrame:
        return rounds.credited(self.winners, self.slates)

    @cached_property
    def arms(self) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(ARMS)), "ord int, arm string")

    @cached_property
    def t(self) -> int:
        return self.order.count()

    @cached_property
    def cells(self) -> DataFrame:
        return policy.grid(self.arms, policy.pair_stats(self.outcomes))

    @cached_property
    def gains(self) -> DataFrame:
        return telemetry.slate_gains(self.slates, self.docs, self.shown)

    @cached_property
    def wide(self) -> DataFrame:
        return groups.embeddings_as_documents(self.spark, self.dir)

    @cached_property
    def wide_ranked(self) -> DataFrame:
        """Rankings by each dimension."""
        return ranking.ranked(self.wide, {f"d{i:02d}": ranking.by_feature(i) for i in range(DIMENSIONS)})

    @cached_property
    def wide_arms(self) -> DataFrame:
        """An arm for each dimension that the vectors have."""
        width = self.wide.agg(F.max(F.size("features")).alias("d"))
        return width.select(F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("ord")).select("ord", F.format_string("d%02d", "ord").alias("arm"))


# The same inputs in the oracle's dialect, as parts of one WITH clause.
_DOCS = """
ev AS (SELECT event_id, user_id, date_trunc('week', ts) AS week, event_type, value,
  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k, CAST(hour(ts) AS DOUBLE) AS hr FROM events),
docs AS (SELECT user_id || '-' || strftime(week, '%Y%m%d') AS query_id, week, user_id,
  CAST(row_number() OVER (PARTITION BY user_id, week ORDER BY event_id) - 1 AS INTEGER) AS doc,
  CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS rel, value, k, hr FROM ev),
rounds AS (SELECT query_id, week, CAST(row_number() OVER (ORDER BY week, user_id) AS INTEGER) AS round, CAST(count(*) AS INTEGER) AS n
  FROM docs GROUP BY query_id, week, user_id),
arms(ord, arm) AS (VALUES (0, 'value'), (1, 'k'), (2, 'recent'), (3, 'oracle'))"""
_RANKED = _DOCS + """,
scored AS (SELECT query_id, doc, rel, 'value' AS arm, value AS score FROM docs UNION ALL SELECT query_id, doc, rel, 'k', k FROM docs
  UNION ALL SELECT query_id, doc, rel, 'recent', doc FROM docs UNION ALL SELECT query_id, doc, rel, 'oracle', rel FROM docs),
ranked AS (SELECT query_id, arm, doc, rel, CAST(row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, doc) AS INTEGER) AS pos FROM scored)"""
_SLATES = _RANKED + f""",
lists AS (SELECT query_id, arm, list(doc ORDER BY pos) AS ranking FROM ranked GROUP BY query_id, arm),
teams AS (SELECT r.round, l.arm, l.ranking, row_number() OVER (PARTITION BY r.round ORDER BY {uniform_sql(42, 'draft', 'r.round', 'l.arm')}, l.arm) - 1 AS slot
  FROM rounds r JOIN lists l ON l.query_id = r.query_id),
draft(round, query_id, n, s, docs, arms) AS (
  SELECT round, query_id, n, 0, CAST([] AS INTEGER[]), CAST([] AS VARCHAR[]) FROM rounds
  UNION ALL
  SELECT d.round, d.query_id, d.n, d.s + 1, list_append(d.docs, list_filter(t.ranking, lambda x: NOT list_contains(d.docs, x))[1]), list_append(d.arms, t.arm)
  FROM draft d JOIN teams t ON t.round = d.round AND t.slot = CASE WHEN (d.s // 4) % 2 = 0 THEN d.s % 4 ELSE 3 - d.s % 4 END WHERE d.s < least(10, d.n)),
placed AS (SELECT round, query_id, unnest(docs) AS doc, unnest(arms) AS arm, unnest(range(len(docs))) AS pos FROM draft WHERE s = least(10, n)),
shown AS (SELECT p.round, p.query_id, CAST(p.pos AS INTEGER) AS pos, p.doc, p.arm, d.rel FROM placed p JOIN docs d ON d.query_id = p.query_id AND d.doc = p.doc)"""
_CHANCE = "[1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1][pos + 1]::DOUBLE * [0.01, 0.1, 0.3, 0.6, 0.95][least(rel, 4) + 1]::DOUBLE"
_WON = _SLATES + f""",
pbm AS (SELECT * FROM shown WHERE {uniform_sql(42, 'pbm', 'round', 'pos')} < {_CHANCE}),
winners AS (SELECT round, arg_min(arm, pos) AS winner FROM pbm GROUP BY round),
outcomes AS (SELECT round, winner, arm AS loser, CAST(1 AS DOUBLE) AS credit FROM winners, arms WHERE arm <> winner),
sides AS (SELECT round, winner AS i, loser AS j, credit AS w FROM outcomes UNION ALL SELECT round, loser, winner, 0 FROM outcomes),
stats AS (SELECT i, j, sum(w) AS w, count(*) AS n FROM sides GROUP BY i, j),
cells AS (SELECT a.arm AS i, b.arm AS j, coalesce(s.w, 0) AS w, coalesce(s.n, 0) AS n FROM arms a JOIN arms b ON a.arm <> b.arm LEFT JOIN stats s ON s.i = a.arm AND s.j = b.arm),
clock AS (SELECT count(*) AS t FROM rounds),
ucbs AS (SELECT i, j, CASE WHEN n > 0 THEN w / n + sqrt(0.51 * ln(greatest(t, 1)) / n) ELSE 1 END AS ucb FROM cells, clock),
members AS (SELECT ord, arm, coalesce(min(ucb), 1e9) >= 0.5 AS fit FROM arms LEFT JOIN ucbs ON i = arm GROUP BY ord, arm)"""
_GAINS = _SLATES + """,
best AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS p FROM docs),
slots AS (SELECT round, query_id, count(*) AS size, sum(rel / log2(pos + 2)) AS g FROM shown GROUP BY round, query_id),
gains AS (SELECT s.round, s.query_id, CASE WHEN sum(b.rel / log2(b.p + 1)) = 0 THEN 1 ELSE any_value(s.g) / sum(b.rel / log2(b.p + 1)) END AS ndcg
  FROM slots s JOIN best b ON b.query_id = s.query_id AND b.p <= s.size GROUP BY s.round, s.query_id),
regrets AS (SELECT round, query_id, ndcg, greatest(0, 1 - ndcg) AS regret FROM gains)"""
_WIDE = f"""
wide AS (SELECT CAST(vec_id // 25 AS VARCHAR) AS query_id, CAST(vec_id % 25 AS INTEGER) AS doc, CAST(label % 5 AS INTEGER) AS rel, embedding FROM embeddings),
wranked AS (SELECT query_id, doc, rel, 'd' || lpad(CAST(i AS VARCHAR), 2, '0') AS arm, CAST(row_number() OVER (PARTITION BY query_id, i ORDER BY embedding[i + 1] DESC, doc) AS INTEGER) AS pos
  FROM wide, unnest(range({DIMENSIONS})) AS r(i)),
wk AS (SELECT least(10, min(n)) AS k FROM (SELECT count(*) AS n FROM wide GROUP BY query_id))"""


def _sql(parts: str, body: str) -> str:
    return f"WITH RECURSIVE {parts}\n{body}"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, parts: str | None = None, body: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Log(spark, sf_dir))
        if body is not None:
            SQL[name] = _sql(parts, body) if parts else body
        return f

    return register


# Scans and orders of replay


@query("scan_query_groups", _DOCS, "SELECT query_id, CAST(count(*) AS INTEGER) AS num_items, string_agg(CAST(rel AS VARCHAR), ',' ORDER BY doc) AS rels FROM docs GROUP BY query_id")
def _(x):
    return groups.checked(groups.nested(x.docs)).select("query_id", F.size("relevance").alias("num_items"), F.array_join(F.expr("transform(relevance, r -> cast(r as string))"), ",").alias("rels"))


@query("nested_roundtrip", _DOCS, "SELECT query_id, doc, rel, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 6) AS f0 FROM docs")
def _(x):
    return groups.flat(groups.nested(x.docs)).select("query_id", "doc", "rel", r6(F.col("features")[0].cast("double")).alias("f0"))


@query("cycle_rounds", _DOCS, "SELECT CAST(t AS BIGINT) AS t, query_id FROM unnest(range((SELECT 5 * count(*) // 2 FROM rounds))) AS r(t) JOIN rounds ON t % (SELECT count(*) FROM rounds) + 1 = round")
def _(x):
    """Two and a half times through all queries."""
    return groups.cycled(x.spark, x.order, 5 * x.t // 2)


@query("epoch_shuffle", _DOCS, f"""SELECT CAST(e AS INTEGER) AS epoch, CAST(row_number() OVER (PARTITION BY e ORDER BY {uniform_sql(42, 'chunk', 'e', '(round - 1) // 100')}, (round - 1) // 100, round) - 1 AS BIGINT) AS place, query_id
FROM rounds, unnest(range(3)) AS x(e)""")
def _(x):
    return groups.shuffled_epochs(x.spark, x.order, 3, 100)


@query("reservoir_sample", _DOCS, f"SELECT query_id FROM rounds ORDER BY {uniform_sql(42, 'res', 'query_id')}, query_id LIMIT 100")
def _(x):
    return groups.sampled(x.order, 100)


_LINES = _DOCS + """,
lines AS (SELECT round * 1000 + doc AS line_no, rel || ' qid:' || query_id || ' 1:' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) || ' 3:' || CAST(CAST(k AS BIGINT) AS VARCHAR) || ' junk # note' AS line,
  rel, query_id AS qid, CAST(round(value * 100) AS BIGINT) AS v, CAST(k AS BIGINT) AS k FROM docs JOIN rounds USING (query_id))"""


def _lines(x) -> DataFrame:
    number = (F.col("round") * 1000 + F.col("doc")).cast("long").alias("line_no")
    whole = lambda c: F.round(c).cast("long").cast("string")
    line = F.concat(F.col("rel").cast("string"), F.lit(" qid:"), "query_id", F.lit(" 1:"), whole(F.col("features")[0] * 100), F.lit(" 3:"), whole(F.col("features")[1]), F.lit(" junk # note"))
    return x.docs.join(x.order.select("query_id", "round"), "query_id").select(number, line.alias("line"))


@query("letor_parse", _LINES, "SELECT CAST(line_no AS BIGINT) AS line_no, rel, qid, CAST(v AS DOUBLE) AS f1, CAST(k AS DOUBLE) AS f3, CAST(2 AS INTEGER) AS n_features FROM lines")
def _(x):
    return letor.parsed(_lines(x)).select("line_no", "rel", "qid", F.col("sparse")[1].alias("f1"), F.col("sparse")[3].alias("f3"), F.size("sparse").alias("n_features"))


@query("letor_densify", _LINES, "SELECT CAST(line_no AS BIGINT) AS line_no, CAST(v AS DOUBLE) || ',0.0,' || CAST(k AS DOUBLE) || ',0.0' AS features FROM lines")
def _(x):
    return letor.dense(letor.parsed(_lines(x)), 4).select("line_no", F.array_join(F.expr("transform(features, v -> cast(v as string))"), ",").alias("features"))


@query("letor_group_islands", _LINES, """
SELECT island, qid, CAST(count(*) AS BIGINT) AS n, CAST(min(line_no) AS BIGINT) AS first_line FROM (
  SELECT *, CAST(sum(new) OVER (ORDER BY o) AS BIGINT) AS island FROM (
    SELECT *, CASE WHEN qid = lag(qid) OVER (ORDER BY o) THEN 0 ELSE 1 END AS new FROM (
      SELECT line_no, line_no AS o, qid FROM lines UNION ALL SELECT line_no, line_no + 100000000, qid FROM lines WHERE line_no < 50000))) GROUP BY island, qid""")
def _(x):
    """Beyond 100,000 rounds numbers ``o`` are shared: lines come before those of the second part, as rows of the SQL do."""
    lines = letor.parsed(_lines(x)).select("*", F.col("line_no").alias("o"), F.lit(0).alias("part"))
    again = lines.where("line_no < 50000").withColumn("o", F.col("line_no") + 100_000_000).withColumn("part", F.lit(1))
    return letor.islands(lines.unionByName(again), "o", ties=("part",)).groupBy("island", "qid").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


# Ranking


@query("rank_single_feature", _RANKED, "SELECT query_id, doc, pos FROM ranked WHERE arm = 'value'")
def _(x):
    return ranking.ranked(x.docs, {"value": ranking.by_feature(0)}).select("query_id", "doc", "pos")


@query("rank_ascending_feature", _DOCS, "SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k, doc) AS INTEGER) AS pos FROM docs")
def _(x):
    return ranking.ranked(x.docs, {"k": ranking.by_feature(1, False)}).select("query_id", "doc", "pos")


@query("rank_random", _DOCS, f"SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {uniform_sql(42, 'rand', 'query_id', 'doc')} DESC, doc) AS INTEGER) AS pos FROM docs")
def _(x):
    return ranking.ranked(x.docs, {"random": ranking.by_chance()}).select("query_id", "doc", "pos")


@query("rank_ground_truth", _RANKED, "SELECT query_id, doc, pos FROM ranked WHERE arm = 'oracle'")
def _(x):
    return ranking.ranked(x.docs, {"oracle": ranking.by_relevance()}).select("query_id", "doc", "pos")


def _grid_sql(size: str) -> str:
    depths, trees, rates, shares, columns = ranking.GRIDS[size]
    v = lambda name, values: f"(SELECT unnest({values}) AS {name}, unnest(range({len(values)})) AS o_{name})"
    mark = lambda c, t: f"CASE WHEN {c} <> 1.0 THEN '_{t}' || CAST(CAST({c} * 100 AS INTEGER) AS VARCHAR) ELSE '' END"
    return f"""SELECT CAST(row_number() OVER (ORDER BY o_depth, o_trees, o_rate, o_share, o_columns) - 1 AS INTEGER) AS ord,
  'xgb_d' || depth || '_n' || trees || '_lr' || CAST(CAST(rate * 100 AS INTEGER) AS VARCHAR) || {mark('share', 'ss')} || {mark('columns', 'cs')} AS arm
FROM {v('depth', depths)}, {v('trees', trees)}, {v('rate', rates)}, {v('share', shares)}, {v('columns', columns)}"""


def _in_turn(x, arms: DataFrame, n: int) -> DataFrame:
    """(round, arm): the arms of a pool of n take turns over all rounds."""
    return x.order.select("round", (F.col("round") % n).alias("ord")).join(F.broadcast(arms), "ord").select("round", "arm")


@query("arm_grid", _DOCS + f",\ngrid AS ({_grid_sql('full')})", "SELECT round, arm FROM rounds JOIN grid ON round % 120 = ord")
def _(x):
    """The grid's 120 settings in turn over all rounds."""
    return _in_turn(x, ranking.boosted_grid(x.spark, "full").select("ord", "arm"), 120)


_POOL = f"pool AS (SELECT * FROM (VALUES {', '.join(str((i, a)) for i, a in enumerate(ranking.BASE_ARMS))}) b(ord, arm) UNION ALL SELECT ord + 4, arm FROM ({_grid_sql('medium')}) g)"


@query("arm_pool", _DOCS + ",\n" + _POOL, "SELECT round, arm FROM rounds JOIN pool ON round % 22 = ord")
def _(x):
    """The 22 arms of the medium pool in turn over all rounds."""
    return _in_turn(x, ranking.arm_pool(x.spark, "medium"), 22)


@query("arm_subset", _DOCS + ",\n" + _POOL, f"SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {uniform_sql(42, 'subset', 'query_id', 'arm')}, arm) AS INTEGER) AS draw, arm FROM rounds, pool QUALIFY draw <= 4")
def _(x):
    """Four arms of the medium pool for every query, each query's own draw."""
    return ranking.arm_subsets(ranking.arm_pool(x.spark, "medium"), x.order.select("query_id"), 4)


@query("score_cache_build", _WIDE, "SELECT arm, query_id, string_agg(CAST(doc AS VARCHAR), ',' ORDER BY pos) AS ranking FROM wranked GROUP BY arm, query_id")
def _(x):
    return ranking.listed(x.wide_ranked).select("arm", "query_id", F.array_join(F.expr("transform(ranking, d -> cast(d as string))"), ",").alias("ranking"))


def _lookups(x) -> DataFrame:
    arms = {f"d{i:02d}": ranking.by_feature(i) for i in range(DIMENSIONS)}
    wanted = x.wide.select("query_id").distinct().crossJoin(F.broadcast(x.wide_arms.select("arm")))
    cached = ranking.listed(ranking.ranked_pairs(x.wide, arms, wanted.where("arm <> 'd03' and cast(query_id as int) % 2 = 0")))
    return ranking.looked_up(wanted, cached, lambda missing: ranking.listed(ranking.ranked_pairs(x.wide, arms, missing)))


@query("score_cache_lookup", _WIDE, "SELECT arm, query_id, arg_min(doc, pos) AS top, arm <> 'd03' AND CAST(query_id AS INTEGER) % 2 = 0 AS hit FROM wranked GROUP BY arm, query_id")
def _(x):
    return _lookups(x).select("arm", "query_id", F.col("ranking")[0].cast("int").alias("top"), "hit")


@query("cache_stats", _WIDE, "SELECT arm, count(DISTINCT query_id) AS n_queries, count(*) AS n_entries, count(*) * 2 AS bytes FROM wranked GROUP BY arm")
def _(x):
    return ranking.cache_statistics(ranking.listed(x.wide_ranked))


@query("score_cache_saved", _WIDE, "SELECT arm, count(DISTINCT query_id) AS n_queries, count(*) AS n_entries, count(*) * 2 AS bytes FROM wranked GROUP BY arm")
def _(x):
    """The cache is saved and its statistics are those of what is read again."""
    path = f"{shared_dir(x.spark)}/{x.spark.sparkContext.applicationId}/score-cache-{uuid.uuid4().hex}"
    return ranking.precomputed(x.wide, {f"d{i:02d}": ranking.by_feature(i) for i in range(DIMENSIONS)}, path)[1]


@query("cache_hit_rate", _WIDE, """SELECT CAST(sum(hit) AS BIGINT) AS hits, CAST(count(*) - sum(hit) AS BIGINT) AS misses, round(sum(hit) / count(*), 6) AS hit_rate FROM (
  SELECT CASE WHEN arm <> 'd03' AND CAST(query_id AS INTEGER) % 2 = 0 THEN 1 ELSE 0 END AS hit FROM wranked GROUP BY arm, query_id)""")
def _(x):
    return telemetry.hit_rate(_lookups(x)).withColumn("hit_rate", r6("hit_rate"))


# Gains


@query("dcg_at_10", _RANKED, "SELECT query_id, arm, round(sum(CASE WHEN pos <= 10 THEN rel / log2(pos + 1) ELSE 0 END), 6) AS dcg FROM ranked GROUP BY query_id, arm")
def _(x):
    return x.ranked.groupBy("query_id", "arm").agg(r6(dcg("rel", "pos")).alias("dcg"))


def _ndcg(x) -> DataFrame:
    per = x.ranked.groupBy("query_id", "arm").agg(dcg("rel", "pos").alias("g"))
    ideal = per.where("arm = 'oracle'").select("query_id", F.col("g").alias("ideal"))
    return per.join(ideal, "query_id").select("query_id", "arm", ratio(F.col("g"), F.col("ideal")).alias("ndcg"))


_NDCG = _RANKED + """,
g AS (SELECT query_id, arm, sum(CASE WHEN pos <= 10 THEN rel / log2(pos + 1) ELSE 0 END) AS g FROM ranked GROUP BY query_id, arm),
ndcgs AS (SELECT a.query_id, a.arm, CASE WHEN b.g = 0 THEN 1 ELSE a.g / b.g END AS ndcg FROM g a JOIN g b ON a.query_id = b.query_id AND b.arm = 'oracle')"""


@query("ndcg_at_10", _NDCG, "SELECT query_id, arm, round(ndcg, 6) AS ndcg FROM ndcgs")
def _(x):
    return _ndcg(x).withColumn("ndcg", r6("ndcg"))


@query("arm_leaderboard", _NDCG, "SELECT arm, count(*) AS n, round(avg(ndcg), 6) AS mean_ndcg, round(sum(1 - ndcg), 4) AS total_regret FROM ndcgs GROUP BY arm")
def _(x):
    return _ndcg(x).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ndcg")).alias("mean_ndcg"), F.round(F.sum(1 - F.col("ndcg")), 4).alias("total_regret"))


@query("ndcg_slate", _GAINS, "SELECT round, query_id, round(ndcg, 6) AS ndcg, round(regret, 6) AS regret FROM regrets")
def _(x):
    return x.gains.select("round", "query_id", r6("ndcg").alias("ndcg"), r6("regret").alias("regret"))


@query("offline_score_at_5", _RANKED, """SELECT arm, round(avg(CASE WHEN i = 0 THEN 1 ELSE g / i END), 6) AS score FROM (
  SELECT query_id, arm, sum(CASE WHEN pos <= 5 THEN rel / log2(pos + 1) ELSE 0 END) AS g, sum(CASE WHEN doc < 5 THEN rel / log2(doc + 2) ELSE 0 END) AS i FROM ranked GROUP BY query_id, arm) GROUP BY arm""")
def _(x):
    return clustering.offline_scores(x.ranked).select("arm", r6("score").alias("score"))


# Slates, clicks, credit


@query("team_draft_slate", _SLATES, "SELECT round, query_id, pos, doc, arm, rel FROM shown")
def _(x):
    return x.shown


_CUT = "CASE arm WHEN 'value' THEN 2 WHEN 'k' THEN 5 WHEN 'oracle' THEN 1 ELSE 1000000 END"
_UNEQUAL = _RANKED + f""",
lists AS (SELECT query_id, arm, list(doc ORDER BY pos) AS ranking FROM ranked WHERE pos <= {_CUT} AND NOT (arm = 'recent' AND doc % 2 = 0) GROUP BY query_id, arm),
teams AS (SELECT r.round, l.arm, l.ranking, row_number() OVER (PARTITION BY r.round ORDER BY {uniform_sql(42, 'draft', 'r.round', 'l.arm')}, l.arm) - 1 AS slot,
  count(*) OVER (PARTITION BY r.round) AS a FROM rounds r JOIN lists l ON l.query_id = r.query_id),
draft(round, query_id, a, s, docs, arms) AS (
  SELECT DISTINCT t.round, r.query_id, a, CAST(0 AS BIGINT), CAST([] AS INTEGER[]), CAST([] AS VARCHAR[]) FROM teams t JOIN rounds r ON r.round = t.round
  UNION ALL
  SELECT round, query_id, a, s + 1, CASE WHEN len(free) > 0 THEN list_append(docs, free[1]) ELSE docs END, CASE WHEN len(free) > 0 THEN list_append(arms, arm) ELSE arms END FROM (
    SELECT d.*, t.arm, CASE WHEN len(d.docs) < 10 THEN list_filter(t.ranking, lambda x: NOT list_contains(d.docs, x)) ELSE [] END AS free
    FROM draft d JOIN teams t ON t.round = d.round AND t.slot = CASE WHEN (d.s // d.a) % 2 = 0 THEN d.s % d.a ELSE d.a - 1 - d.s % d.a END WHERE d.s < 10 * d.a))"""


@query("team_draft_unequal", _UNEQUAL, "SELECT round, query_id, CAST(pos AS INTEGER) AS pos, doc, arm FROM (SELECT round, query_id, unnest(range(len(docs))) AS pos, unnest(docs) AS doc, unnest(arms) AS arm FROM draft WHERE s = 10 * a)")
def _(x):
    """Lists that end at another place for each arm, one of them with half of the documents."""
    cut = F.when(F.col("arm") == "value", 2).when(F.col("arm") == "k", 5).when(F.col("arm") == "oracle", 1).otherwise(1_000_000)
    lists = ranking.listed(x.ranked.where((F.col("pos") <= cut) & ~((F.col("arm") == "recent") & (F.col("doc") % 2 == 0))))
    slates = rounds.drafted_lists(lists, x.order)
    return slates.select("round", "query_id", F.posexplode("slate").alias("pos", "x")).select("round", "query_id", "pos", "x.doc", "x.arm")


@query("pbm_expected", _SLATES, f"SELECT round, pos, round({_CHANCE}, 6) AS chance FROM shown")
def _(x):
    return x.shown.select("round", "pos", r6(rounds.click_chance()).alias("chance"))


@query("pbm_clicks", _WON, "SELECT round, pos, doc, arm FROM pbm")
def _(x):
    return rounds.position_clicks(x.shown).select("round", "pos", "doc", "arm")


@query("cascade_click", _SLATES, "SELECT round, min(pos) AS pos FROM shown WHERE rel >= 3 AND pos < 10 GROUP BY round")
def _(x):
    return rounds.cascade_clicks(x.shown)


@query("noisy_click", _SLATES, f"""SELECT round, CAST(CASE WHEN {uniform_sql(42, 'noise', 'round')} < 0.1 THEN floor({uniform_sql(42, 'noisepos', 'round')} * n) ELSE first END AS INTEGER) AS pos FROM (
  SELECT round, min(CASE WHEN rel >= 3 AND pos < 10 AND {uniform_sql(42, 'fn', 'round', 'pos')} >= 0.1 THEN pos END) AS first, least(max(pos) + 1, 10) AS n FROM shown GROUP BY round)
WHERE {uniform_sql(42, 'noise', 'round')} < 0.1 OR first IS NOT NULL""")
def _(x):
    return rounds.noisy_clicks(x.shown)


@query("first_click_credit", _WON, "SELECT round, winner, loser, credit FROM outcomes")
def _(x):
    return x.outcomes


# Pair statistics and selections


@query("pair_stats_cumulative", _WON, "SELECT i, j, CAST(w AS DOUBLE) AS w, CAST(n AS BIGINT) AS n FROM stats")
def _(x):
    return policy.pair_stats(x.outcomes)


@query("pair_stats_discounted", _WON, f"SELECT i, j, round(sum(w * pow({GAMMA}, t - round)), 6) AS w, count(*) AS n FROM sides, clock GROUP BY i, j")
def _(x):
    return policy.pair_stats(x.outcomes, GAMMA, x.t).select("i", "j", r6("w").alias("w"), "n")


@query("pair_stats_running", _WON, "SELECT round, winner AS i, loser AS j, sum(credit) OVER (PARTITION BY winner, loser ORDER BY round) AS w FROM outcomes")
def _(x):
    return policy.running_pair_stats(x.outcomes)


_STEPS = """SELECT r.round, c.i, c.j, CAST(coalesce(sum(s.w * pow(%s, r.round - s.round)), 0) AS DOUBLE) AS w, count(s.round) AS n
FROM rounds r CROSS JOIN (SELECT a.arm AS i, b.arm AS j FROM arms a JOIN arms b ON a.arm <> b.arm) c LEFT JOIN sides s ON s.i = c.i AND s.j = c.j AND s.round <= r.round GROUP BY r.round, c.i, c.j"""


@query("pair_trajectory", _WON, _STEPS % "1.0")
def _(x):
    return policy.pair_trajectory(x.outcomes, x.arms, x.t)


@query("pair_trajectory_discounted", _WON + f",\nsteps AS ({_STEPS % GAMMA})", "SELECT round, i, j, round(w, 6) AS w, n FROM steps")
def _(x):
    return policy.pair_trajectory(x.outcomes, x.arms, x.t, GAMMA).withColumn("w", r6("w"))


@query("set_e_f_trajectory", _WON + f""",\nsteps AS ({_STEPS % "1.0"}),
least AS (SELECT round, i AS arm, min(CASE WHEN n > 0 THEN w / n + sqrt(0.51 * ln(round) / n) ELSE 1 END) AS e, min(CASE WHEN n > 0 THEN w / n + sqrt(1.5 * 0.51 * ln(round) / n) ELSE 1 END) AS f FROM steps GROUP BY round, i)""",
f"SELECT round, arm, e >= 0.5 AS in_e, round < {N_MIN} OR f >= 0.5 AS in_f FROM least")
def _(x):
    return policy.membership_trajectory(x.outcomes, x.arms, x.t, N_MIN, beta=1.5)


@query("win_rate_matrix", _WON, "SELECT i, j, round(CASE WHEN n = 0 THEN 0.5 ELSE w / n END, 6) AS rate FROM cells")
def _(x):
    return policy.win_rates(x.cells).select("i", "j", r6("rate").alias("rate"))


_SOURCE = "src AS (SELECT arm, CASE WHEN arm IN ('k', 'recent') THEN 'value' ELSE arm END AS s FROM arms)"


@query("knowledge_transfer", _WON + ",\n" + _SOURCE, """SELECT a.arm AS i, b.arm AS j, CAST(coalesce(c.w, 0) AS DOUBLE) AS w, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM src a JOIN src b ON a.arm <> b.arm LEFT JOIN cells c ON c.i = a.s AND c.j = b.s""")
def _(x):
    source = x.spark.createDataFrame([("k", "value"), ("recent", "value")], "arm string, source string")
    return policy.inherited(x.cells, source, x.arms)


@query("tracker_reset", _WON, "SELECT i, j, CAST(sum(w) AS DOUBLE) AS w, count(*) AS n FROM sides WHERE round > 300 GROUP BY i, j")
def _(x):
    return policy.pair_stats(x.outcomes.where("round > 300"))


@query("tracker_statistics", _WON, f"""SELECT CAST(t AS BIGINT) AS t, round(1 / (1 - {GAMMA}), 6) AS effective_t, (SELECT string_agg(row_text, ';' ORDER BY i) FROM
  (SELECT i, string_agg(CAST(CAST(w AS BIGINT) AS VARCHAR), ',' ORDER BY j) AS row_text FROM cells GROUP BY i)) AS wins FROM clock""")
def _(x):
    ordered = lambda c: F.array_sort(F.collect_list(c))
    row = x.cells.groupBy("i").agg(ordered(F.struct("j", F.col("w").cast("long").cast("string").alias("v"))).alias("r")).select("i", F.expr("array_join(transform(r, x -> x.v), ',')").alias("v"))
    whole = row.agg(ordered(F.struct("i", "v")).alias("r")).select(F.expr("array_join(transform(r, x -> x.v), ';')").alias("wins"))
    return whole.select(F.lit(x.t).cast("long").alias("t"), F.lit(round(1 / (1 - GAMMA), 6)).alias("effective_t"), "wins")


@query("ucb_matrix", _WON, "SELECT i, j, round(ucb, 6) AS ucb FROM ucbs")
def _(x):
    return policy.upper_bounds(x.cells, x.t).select("i", "j", r6("ucb").alias("ucb"))


@query("set_e_f", _WON, f"SELECT ord, arm, fit AS in_e, t < {N_MIN} OR fit AS in_f FROM members, clock")
def _(x):
    return policy.set_membership(x.cells, x.arms, x.t, N_MIN)


@query("mdb_select", _WON, f"SELECT ord, arm FROM members, clock WHERE t < {N_MIN} OR fit OR (SELECT count(*) FROM members WHERE fit) = 0")
def _(x):
    return policy.dueling_selection(policy.set_membership(x.cells, x.arms, x.t, N_MIN), x.t, N_MIN)


_RUCB = _WON + """,
rel_u AS (SELECT a.i, a.j, CASE WHEN a.w + b.w > 0 THEN a.w / (a.w + b.w) + sqrt(0.51 * ln(greatest(t, 1)) / (a.w + b.w)) ELSE 1 END AS u
  FROM cells a JOIN cells b ON a.i = b.j AND a.j = b.i, clock),
cand AS (SELECT ord, arm FROM arms LEFT JOIN rel_u ON i = arm GROUP BY ord, arm HAVING coalesce(min(u), 1e9) >= 0.5)"""


@query("rucb_matrix", _RUCB, "SELECT i, j, round(u, 6) AS u FROM rel_u")
def _(x):
    return policy.relative_bounds(x.cells, x.t).select("i", "j", r6("u").alias("u"))


@query("rucb_candidates", _RUCB, "SELECT ord, arm FROM cand")
def _(x):
    return policy.candidates(policy.relative_bounds(x.cells, x.t), x.arms).select("ord", "arm")


@query("rucb_sample", _RUCB, f"""SELECT ord, arm FROM (SELECT ord, arm FROM cand UNION ALL SELECT ord, arm FROM arms WHERE (SELECT count(*) FROM cand) = 0), clock
ORDER BY {uniform_sql(42, 'rucb', 't', 'arm')}, arm LIMIT 2""")
def _(x):
    found = policy.candidates(policy.relative_bounds(x.cells, x.t), x.arms)
    return policy.relative_selection(found, x.arms, x.t, 0, m=2)


_ACTIVE = "('value', 'recent', 'oracle')"


def _active(x) -> DataFrame:
    return x.arms.where(f"arm in {_ACTIVE}")


@query("active_min_ucb", _WON, f"SELECT i AS arm, round(min(ucb), 6) AS least FROM ucbs WHERE i IN {_ACTIVE} AND j IN {_ACTIVE} GROUP BY i")
def _(x):
    return policy.upper_bounds(policy.among(x.cells, _active(x)), x.t).groupBy(F.col("i").alias("arm")).agg(r6(F.min("ucb")).alias("least"))


_CLUSTERS = [(0, "value", True), (0, "k", False), (1, "recent", True), (2, "oracle", True)]


@query("winning_cluster", _WON, """SELECT cluster, arm, CAST(coalesce(sum(w), 0) AS DOUBLE) AS wins FROM (VALUES (0, 'value'), (1, 'recent'), (2, 'oracle')) r(cluster, arm)
LEFT JOIN cells ON i = arm AND j IN ('value', 'recent', 'oracle') GROUP BY cluster, arm ORDER BY wins DESC, cluster LIMIT 1""")
def _(x):
    return policy.winning_cluster(x.cells, x.spark.createDataFrame(_CLUSTERS, "cluster int, arm string, is_rep boolean"))


@query("hier_select", _WON, f"""SELECT ord, arm FROM (SELECT ord, arm, min(ucb) >= 0.5 AS fit FROM arms JOIN ucbs ON i = arm AND j IN {_ACTIVE} WHERE arm IN {_ACTIVE} GROUP BY ord, arm) a
WHERE fit OR NOT EXISTS (SELECT 1 FROM ucbs u WHERE u.i IN {_ACTIVE} AND u.j IN {_ACTIVE} GROUP BY u.i HAVING min(u.ucb) >= 0.5)""")
def _(x):
    return policy.active_selection(x.cells, _active(x), x.t, 0)


_PLAYED = _WON + """,
played AS (SELECT r.round, (SELECT arm FROM arms WHERE ord = r.round % 4) AS arm, w.winner FROM rounds r LEFT JOIN winners w ON w.round = r.round)"""


@query("thompson_posterior", _PLAYED, """SELECT arm, CAST(1 + sum(CASE WHEN winner = arm THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(1 + sum(CASE WHEN winner = arm THEN 0 ELSE 1 END) AS BIGINT) AS b,
round((1 + sum(CASE WHEN winner = arm THEN 1 ELSE 0 END)) / (2 + count(*)), 6) AS mean FROM played GROUP BY arm""")
def _(x):
    return policy.beta_posteriors(_played(x), x.arms).withColumn("mean", r6("mean"))


_DRAWS = _PLAYED + f""",
posts AS (SELECT r.round, a.arm, 1 + count(*) FILTER (p.winner = p.arm) AS a, 1 + count(*) FILTER (p.arm IS NOT NULL AND p.winner IS DISTINCT FROM p.arm) AS b
  FROM rounds r CROSS JOIN arms a LEFT JOIN played p ON p.arm = a.arm AND p.round < r.round GROUP BY r.round, a.arm),
gammas AS (SELECT round, arm, a, b, {gamma_sql('a', 42, 'win', 'round', 'arm')} AS g, {gamma_sql('b', 42, 'loss', 'round', 'arm')} AS h FROM posts),
draws AS (SELECT round, arm, a, b, g / (g + h) AS draw FROM gammas)"""


def _played(x) -> DataFrame:
    played = x.order.select("round", (F.col("round") % 4).alias("ord")).join(F.broadcast(x.arms), "ord").join(x.winners, "round", "left")
    return played.select("round", "arm", F.coalesce(F.col("winner") == F.col("arm"), F.lit(False)).alias("won"))


@query("thompson_draws", _DRAWS, "SELECT round, arm, a, b, round(draw, 6) AS draw, row_number() OVER (PARTITION BY round ORDER BY draw DESC, arm) = 1 AS chosen FROM draws")
def _(x):
    """Posteriors before every round and a draw from each."""
    return policy.thompson_draws(policy.posterior_trajectory(_played(x), x.arms, x.t)).withColumn("draw", r6("draw"))


@query("mdb_statistics", _WON, f"""SELECT CAST(any_value(t) AS BIGINT) AS t, string_agg(arm, ',' ORDER BY ord) FILTER (fit) AS set_e, string_agg(arm, ',' ORDER BY ord) FILTER (t < {N_MIN} OR fit) AS set_f,
0.51::DOUBLE AS alpha, 1.0::DOUBLE AS beta, CAST({N_MIN} AS INTEGER) AS n_min, any_value(t) < {N_MIN} AS in_grace_period FROM members, clock""")
def _(x):
    return policy.dueling_statistics(policy.set_membership(x.cells, x.arms, x.t, N_MIN), x.t, N_MIN)


@query("rucb_statistics", _RUCB, f"""SELECT CAST(t AS BIGINT) AS t, (SELECT string_agg(arm, ',' ORDER BY ord) FROM cand) AS candidates, (SELECT count(*) FROM cand) AS candidate_set_size, 0.51::DOUBLE AS alpha,
CAST(2 AS INTEGER) AS m, CAST({N_MIN} AS INTEGER) AS n_min, t < {N_MIN} AS in_grace_period FROM clock""")
def _(x):
    return policy.relative_statistics(policy.candidates(policy.relative_bounds(x.cells, x.t), x.arms), x.t, N_MIN, m=2)


@query("hier_statistics", _WON, """SELECT CAST(t AS BIGINT) AS t, CASE WHEN t < 500 THEN 1 ELSE 2 END AS current_level, CASE WHEN t >= 500 THEN cluster END AS winning_cluster_id,
CASE WHEN t < 500 THEN 'value,recent,oracle' ELSE (SELECT string_agg(arm, ',' ORDER BY o) FROM (VALUES (0, 'value', 0), (0, 'k', 1), (1, 'recent', 2), (2, 'oracle', 3)) m(c, arm, o) WHERE c = cluster) END AS active_arms, CAST(3 AS BIGINT) AS n_clusters
FROM clock, (SELECT cluster, coalesce(sum(w), 0) AS won FROM (VALUES (0, 'value'), (1, 'recent'), (2, 'oracle')) r(cluster, arm) LEFT JOIN cells ON i = arm AND j IN ('value', 'recent', 'oracle') GROUP BY cluster ORDER BY won DESC, cluster LIMIT 1)""")
def _(x):
    return policy.two_level_statistics(x.cells, x.spark.createDataFrame(_CLUSTERS, "cluster int, arm string, is_rep boolean"), x.arms, x.t, 500)


# Clusters


@query("jaccard_matrix", _WIDE + """,
tops AS (SELECT query_id, arm, doc FROM wranked, wk WHERE pos <= k),
common AS (SELECT p.query_id, p.arm AS a, q.arm AS b, count(*) AS c FROM tops p JOIN tops q ON p.query_id = q.query_id AND p.doc = q.doc AND p.arm < q.arm GROUP BY p.query_id, p.arm, q.arm),
pairs AS (SELECT x.query_id, x.arm AS a, y.arm AS b FROM (SELECT DISTINCT query_id, arm FROM tops) x JOIN (SELECT DISTINCT query_id, arm FROM tops) y ON x.query_id = y.query_id AND x.arm < y.arm)""",
"SELECT a, b, round(avg(coalesce(c, 0) / (2.0::DOUBLE * k - coalesce(c, 0))), 6) AS s FROM pairs LEFT JOIN common USING (query_id, a, b), wk GROUP BY a, b")
def _(x):
    return clustering.top_overlap(x.wide_ranked, x.wide_arms).select("a", "b", r6("s").alias("s"))


@query("random_clusters", None, f"""SELECT CAST(p % 4 AS INTEGER) AS cluster, arm, CAST(p // 4 AS INTEGER) AS member, p < 4 AS is_rep FROM (
  SELECT arm, row_number() OVER (ORDER BY {uniform_sql(42, 'rc', 'arm')}, arm) - 1 AS p FROM (SELECT 'd' || lpad(CAST(i AS VARCHAR), 2, '0') AS arm FROM unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS r(i)))""")
def _(x):
    return clustering.shuffled_clusters(x.wide_arms, 4)


_CLUSTERED = _WIDE + f""",
wscores AS (SELECT arm, avg(CASE WHEN i = 0 THEN 1 ELSE g / i END) AS score FROM (SELECT query_id, arm, sum(CASE WHEN pos <= 5 THEN rel / log2(pos + 1) ELSE 0 END) AS g,
  sum(CASE WHEN doc < 5 THEN rel / log2(doc + 2) ELSE 0 END) AS i FROM wranked GROUP BY query_id, arm) GROUP BY arm),
wclusters AS (SELECT p % 4 AS cluster, arm, p // 4 AS member FROM (SELECT arm, row_number() OVER (ORDER BY {uniform_sql(42, 'rc', 'arm')}, arm) - 1 AS p FROM (SELECT DISTINCT arm FROM wranked)))"""


@query("representatives", _CLUSTERED, "SELECT CAST(cluster AS INTEGER) AS cluster, arm, round(score, 6) AS score FROM wclusters JOIN wscores USING (arm) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, member) = 1")
def _(x):
    scores = clustering.offline_scores(x.wide_ranked)
    return clustering.representatives(clustering.shuffled_clusters(x.wide_arms, 4), scores).withColumn("score", r6("score"))


@query("noise_singletons", """l AS (SELECT CAST(i AS INTEGER) AS ord, 'd' || lpad(CAST(i AS VARCHAR), 2, '0') AS arm, CAST(CASE WHEN avg(CAST(embedding[i + 1] AS DOUBLE)) < 0 THEN -1 ELSE i % 5 END AS INTEGER) AS label
  FROM embeddings, unnest(range(len(embedding))) AS r(i) GROUP BY i)""", "SELECT arm, CAST(CASE WHEN label < 0 THEN (SELECT max(label) FROM l) + row_number() OVER (PARTITION BY label < 0 ORDER BY ord) ELSE label END AS INTEGER) AS label FROM l")
def _(x):
    """Dimensions with a mean below 0 stand for noise, the others are in five clusters."""
    means = x.wide.select(F.posexplode("features").alias("ord", "v")).groupBy("ord").agg(F.avg("v").alias("m"))
    labels = means.select("ord", F.format_string("d%02d", "ord").alias("arm"), F.when(F.col("m") < 0, -1).otherwise(F.col("ord") % 5).cast("int").alias("label"))
    return clustering.noise_as_singletons(labels)


@query("hdbscan_clusters")
def _(x):
    return clustering.fitted(x.spark, x.wide_ranked, x.wide_arms, min_size=3)


# Telemetry and cost


@query("regret_curve", _GAINS, "SELECT round, round(regret, 6) AS regret, round(sum(regret) OVER (ORDER BY round), 6) AS cumulative FROM regrets")
def _(x):
    return telemetry.regret_curve(x.gains).select("round", r6("regret").alias("regret"), r6("cumulative").alias("cumulative"))


@query("selection_rates", _DOCS, "SELECT arm, count(*) AS selected, round(count(*) / (SELECT count(*) FROM rounds), 6) AS rate FROM rounds, arms GROUP BY arm")
def _(x):
    return telemetry.selection_rates(x.slates).withColumn("rate", r6("rate"))


@query("win_rates", _WON, "SELECT winner AS arm, count(*) AS wins, round(count(*) / (SELECT count(*) FROM winners), 6) AS rate FROM winners GROUP BY winner")
def _(x):
    return telemetry.winner_rates(x.winners).withColumn("rate", r6("rate"))


@query("run_summary", _WON + _GAINS[len(_SLATES):], """SELECT count(*) AS iterations, round(sum(regret), 4) AS total_regret, round(avg(regret), 6) AS avg_regret,
(SELECT count(*) FROM winners) AS total_clicks, round((SELECT count(*) FROM winners) / count(*), 6) AS click_rate FROM regrets""")
def _(x):
    return telemetry.run_summary(x.gains, x.winners).select("iterations", F.round("total_regret", 4).alias("total_regret"), r6("avg_regret").alias("avg_regret"), "total_clicks", r6("click_rate").alias("click_rate"))


@query("progress_log", _GAINS, "SELECT round, round(ndcg, 6) AS ndcg FROM regrets WHERE round % 100 = 0")
def _(x):
    return telemetry.lagged(x.gains, 100).select("round", r6("ndcg").alias("ndcg"))


@query("stream_progress", _WON, """SELECT min(round) AS first_round, max(round) AS last_round, count(*) AS outcomes, sum(credit) AS credit FROM outcomes GROUP BY (round - 1) // 100""")
def _(x):
    """What a listener is told while the log's outcomes go through the statistics as a stream."""
    return online.progress(x.outcomes).drop("batch")


@query("inference_cost", _DOCS, "SELECT arm, CAST(sum(CASE WHEN arm = 'oracle' THEN 0 ELSE 1 END) AS BIGINT) AS inferences FROM rounds, arms GROUP BY arm")
def _(x):
    return telemetry.inference_cost(x.slates, x.lists.where("arm = 'oracle'"))


@query("logical_cost", _DOCS, "SELECT CAST(count(*) * 4 AS BIGINT) AS total_evaluations, count(*) AS total_queries, CAST(4 AS DOUBLE) AS avg_arms_per_query FROM rounds")
def _(x):
    return telemetry.logical_cost(x.slates)


@query("cost_reduction", _DOCS, """SELECT CAST(0 AS BIGINT) AS level0_rounds, l1 AS level1_rounds, l2 AS level2_rounds, l1 * 10 + l2 * 5 AS two_level, (l1 + l2) * 100 AS flat, round((l1 + l2) * 100 / (l1 * 10 + l2 * 5), 6) AS ratio
FROM (SELECT CAST(sum(CASE WHEN round <= 200 THEN 1 ELSE 0 END) AS BIGINT) AS l1, CAST(sum(CASE WHEN round > 200 THEN 1 ELSE 0 END) AS BIGINT) AS l2 FROM rounds)""")
def _(x):
    levels = x.order.select("round", F.when(F.col("round") <= 200, 1).otherwise(2).alias("level"))
    return telemetry.cost_reduction(levels, 100, 10, 5).withColumn("ratio", r6("ratio"))


_EVALUATED = _NDCG + _WON[len(_RANKED):] + """,
arm_gain AS (SELECT arm, avg(ndcg) AS gain FROM ndcgs GROUP BY arm),
evals AS (SELECT row_number() OVER (ORDER BY round) AS seq, round, winner AS arm, round % 50 = 0 AS is_final FROM winners),
evaluated AS (SELECT seq, round, e.arm, is_final, (SELECT max(gain) FROM arm_gain) AS best, gain FROM evals e JOIN arm_gain g ON g.arm = e.arm),
judged AS (SELECT seq, round, arm, is_final, (best - gain) / best AS gap, (best - gain) / best <= 0.25 AS success FROM evaluated)"""


def _judged(x) -> DataFrame:
    numbered = groups.query_order(x.docs).select("round").join(x.winners, "round")
    seq = numbered.withColumn("one", F.lit(1))
    from ..functions.running import running_sums

    evals = running_sums(seq, "round", {"seq": "one"}).select(F.col("seq").cast("long").alias("seq"), "round", F.col("winner").alias("arm"), (F.col("round") % 50 == 0).alias("is_final"))
    return telemetry.success(evals, _ndcg(x).groupBy("arm").agg(F.avg("ndcg").alias("gain")), 0.25)


@query("success_eval", _EVALUATED, "SELECT seq, round, arm, round(gap, 6) AS gap, success FROM judged")
def _(x):
    return _judged(x).select("seq", "round", "arm", r6("gap").alias("gap"), "success")


@query("sample_complexity", _EVALUATED, """SELECT min_by(round, seq) AS sample_complexity FROM (SELECT seq, round, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) OVER (ORDER BY seq) AS rate FROM judged) WHERE rate >= 0.3""")
def _(x):
    return telemetry.sample_complexity(_judged(x), 0.3)


@query("success_summary", _EVALUATED, """SELECT count(*) AS n_evaluations, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, arg_max(arm, seq) FILTER (is_final) AS final_arm,
round(arg_max(gap, seq) FILTER (is_final), 6) AS final_gap, arg_max(success, seq) FILTER (is_final) AS final_success FROM judged""")
def _(x):
    return telemetry.success_summary(_judged(x)).withColumn("success_rate", r6("success_rate")).withColumn("final_gap", r6("final_gap"))


# Resampling and tests

_SERIES = _DOCS + """,
days AS (SELECT CAST(row_number() OVER (ORDER BY date_trunc('day', ts)) - 1 AS INTEGER) AS idx, avg(value) AS x, avg(CAST(regexp_extract(props, '[0-9]+') AS DOUBLE)) AS y FROM events GROUP BY date_trunc('day', ts))"""


def _days(x) -> DataFrame:
    """Daily means, a series of as many rows as days; one task numbers them."""
    from pyspark.sql import Window

    per = x.spark.read.parquet(f"{x.dir}/events.parquet").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.avg("value").alias("x"), F.avg(F.regexp_extract("props", "[0-9]+", 0).cast("double")).alias("y"))
    return per.select((F.row_number().over(Window.orderBy("day")) - 1).cast("int").alias("idx"), "x", "y")


def _boot(column: str, stream: str) -> str:
    return f"""(SELECT b, avg({column}) AS stat FROM (SELECT b, CAST(floor({uniform_sql(42, stream, 'b', 'i')} * (SELECT count(*) FROM days)) AS INTEGER) AS idx
  FROM unnest(range(1000)) AS r(b), (SELECT idx AS i FROM days)) JOIN days USING (idx) GROUP BY b)"""


@query("bootstrap_ci", _SERIES, f"SELECT round((SELECT avg(x) FROM days), 6) AS estimate, round(quantile_cont(stat, 0.025), 6) AS low, round(quantile_cont(stat, 0.975), 6) AS high FROM {_boot('x', 'boot')}")
def _(x):
    return stats.bootstrap_interval(_days(x)).select(*[r6(c).alias(c) for c in ("estimate", "low", "high")])


@query("bootstrap_diff", _SERIES, f"""SELECT round((SELECT avg(x) - avg(y) FROM days), 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS significant FROM (
  SELECT quantile_cont(p.stat - q.stat, 0.025) AS low, quantile_cont(p.stat - q.stat, 0.975) AS high FROM {_boot('x', 'boot')} p JOIN {_boot('y', 'bootb')} q USING (b))""")
def _(x):
    days = _days(x)
    return stats.bootstrap_difference(days.select("idx", "x"), days.select("idx", F.col("y").alias("x"))).select(*[r6(c).alias(c) for c in ("difference", "low", "high")], "significant")


@query("permutation_test", _SERIES, f"""SELECT round(any_value(o), 6) AS observed, round(avg(CASE WHEN abs(m) >= abs(o) - 1e-12 THEN 1.0 ELSE 0.0 END), 6) AS p_value, round(any_value(o / sd), 6) AS effect FROM (
  SELECT k, avg(CASE WHEN {uniform_sql(42, 'perm', 'k', 'idx')} < 0.5 THEN -(x - y / 5) ELSE x - y / 5 END) AS m FROM days, unnest(range(10000)) AS r(k) GROUP BY k),
(SELECT avg(x - y / 5) AS o, stddev_pop(x - y / 5) AS sd FROM days)""")
def _(x):
    pairs = _days(x).select("idx", F.col("x").alias("a"), (F.col("y") / 5).alias("b"))
    return stats.paired_permutation(pairs).select(*[r6(c).alias(c) for c in ("observed", "p_value", "effect")])


_VALUES = "vals AS (SELECT event_id AS id, event_type AS kind, value AS a, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 5 AS b FROM events)"
_WEIGHT = " + ".join(f"(u >= {e})::INTEGER" for e in resampling.POISSON)


def _values(x) -> DataFrame:
    """Two numbers of every event."""
    events = x.spark.read.parquet(f"{x.dir}/events.parquet")
    return events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("a"), (F.regexp_extract("props", "[0-9]+", 0).cast("double") / 5).alias("b"))


def _means(column: str, seed: int) -> str:
    return f"""(SELECT rep, sum(w * x) / sum(w) AS stat FROM (SELECT rep, x, {_WEIGHT} AS w FROM (SELECT rep, {column} AS x, {resampling.drawn_sql('id', seed, 'rep')} AS u FROM vals, unnest(range(300)) AS r(rep))) GROUP BY rep HAVING sum(w) > 0)"""


@query("bootstrap_events", _VALUES, f"SELECT round((SELECT avg(a) FROM vals), 6) AS estimate, round(quantile_cont(stat, 0.025), 6) AS low, round(quantile_cont(stat, 0.975), 6) AS high FROM {_means('a', 42)}")
def _(x):
    """The mean of all events, 300 resamples of them."""
    return resampling.bootstrap_mean_interval(_values(x), "id", "a", 300).select(*[r6(c).alias(c) for c in ("estimate", "low", "high")])


@query("bootstrap_events_diff", _VALUES, f"""SELECT round((SELECT avg(a) - avg(b) FROM vals), 6) AS difference, round(low, 6) AS low, round(high, 6) AS high, low > 0 OR high < 0 AS significant FROM (
  SELECT quantile_cont(p.stat - q.stat, 0.025) AS low, quantile_cont(p.stat - q.stat, 0.975) AS high FROM {_means('a', 42)} p JOIN {_means('b', 43)} q USING (rep))""")
def _(x):
    return resampling.bootstrap_mean_difference(_values(x), "id", "a", "b", 300).select(*[r6(c).alias(c) for c in ("difference", "low", "high")], "significant")


_FLIPS = _VALUES + f""",
signs AS (SELECT id, kind, a - b AS d, 32 * word AS at0, {resampling.drawn_sql('id', 42, 'word')} AS bits FROM vals, unnest(range(32)) AS r(word)),
flipped AS (SELECT kind, at0 + bit AS at, avg(CASE WHEN (bits >> bit) & 1 = 1 THEN -d ELSE d END) AS m FROM signs, unnest(range(32)) AS r(bit) WHERE at0 + bit < 1000 GROUP BY ALL),
seen AS (SELECT kind, avg(a - b) AS o, stddev_pop(a - b) AS sd, count(*) AS n FROM vals GROUP BY kind),
tested AS (SELECT kind AS g, any_value(o) AS observed, avg(CASE WHEN abs(m) >= abs(o) - 1e-12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p_value, any_value(CASE WHEN sd = 0 THEN 0 ELSE o / sd END) AS effect, any_value(n) AS n
  FROM flipped JOIN seen USING (kind) GROUP BY kind)"""


@query("sign_flip_events", _FLIPS, "SELECT g, round(observed, 6) AS observed, round(p_value, 6) AS p_value, round(effect, 6) AS effect, n FROM tested")
def _(x):
    """Both numbers of all events of each type, 1000 permutations."""
    return resampling.sign_flips(_values(x), "id", "a", "b", 1000, group="kind").select("g", *[r6(c).alias(c) for c in ("observed", "p_value", "effect")], "n")


_TESTS = _FLIPS + """,
tests AS (SELECT CAST(row_number() OVER (ORDER BY g) - 1 AS INTEGER) AS idx, p_value AS p, count(*) OVER () AS m FROM tested)"""


def _tests(x) -> DataFrame:
    """A p-value of each type of events, of which there are a few."""
    from pyspark.sql import Window

    found = resampling.sign_flips(_values(x), "id", "a", "b", 1000, group="kind")
    return found.select((F.row_number().over(Window.orderBy("g")) - 1).cast("int").alias("idx"), F.col("p_value").alias("p"))


@query("bonferroni", _TESTS, "SELECT idx, p, round(0.05 / m, 6) AS threshold, p < 0.05 / m AS rejected FROM tests")
def _(x):
    return stats.bonferroni(_tests(x)).withColumn("threshold", r6("threshold"))


@query("holm", _TESTS, """SELECT idx, p, CAST(rk AS INTEGER) AS rank, round(0.05 / (m + 1 - rk), 6) AS threshold, rk < coalesce(min(CASE WHEN p >= 0.05 / (m + 1 - rk) THEN rk END) OVER (), m + 1) AS rejected
FROM (SELECT *, row_number() OVER (ORDER BY p, idx) AS rk FROM tests)""")
def _(x):
    return stats.holm(_tests(x)).withColumn("threshold", r6("threshold"))


@query("sample_efficiency", _WON, """SELECT min(r + 1) AS first_round FROM (SELECT r, avg(CASE WHEN w.round IS NULL THEN 0.0 ELSE 1.0 END) OVER (ORDER BY r) AS rate
FROM (SELECT unnest(range(600)) AS r) LEFT JOIN winners w ON w.round = r AND winner = 'oracle') WHERE rate >= 0.3""")
def _(x):
    return stats.sample_efficiency(x.winners.where("winner = 'oracle'"), x.t, 0.3)


# Reports

_POOLS = {"base": list(reports.BASE_POOL), "learn": list(reports.LEARNING_POOL), "full": ["linear_ts", "linucb"]}


_SCENARIOS, _POLICIES = ("standard", "cascade", "noisy"), ("uniform", "mdb", "thompson")
_STEMS = {("standard", "mdb"): "phase1_1.1_HMDB_KT", ("standard", "uniform"): "phase2_2.1_K20_Flat_K20", ("standard", "thompson"): "phase2_2.2_K20_HMDB_K20"}


def _stem(a: int, b: int) -> str:
    scenario, name = _SCENARIOS[a], _POLICIES[b]
    return _STEMS.get((scenario, name), f"phase3_3.{a}_{name}_{scenario}")


def results_frame(x: Log) -> DataFrame:
    """Result documents of 27 runs (scenario, policy, seed), written as files and read again.

    Users are dealt to runs, and a run's numbers are sums over all events of its users; a run without any has no document.
    """
    part = F.pmod(F.col("event_id"), F.lit(4))
    share = lambda i, kind=F.lit(True): (F.sum(F.when((part == i) & kind, 1).otherwise(0)) / F.count(F.lit(1)))
    click = F.col("event_type") == "click"
    events = x.spark.read.parquet(f"{x.dir}/events.parquet")
    runs = events.groupBy(F.pmod(F.col("user_id"), F.lit(27)).cast("int").alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("regret"), F.sum(click.cast("long")).alias("clicks"), F.avg("value").alias("runtime"),
        *[share(i).alias(f"s{i}") for i in range(4)], *[share(i, click).alias(f"w{i}") for i in range(4)],
    )
    documents = {}
    for r in runs.collect():
        a, b, seed = r.g // 9, r.g // 3 % 3, r.g % 3
        arms = _POOLS[list(_POOLS)[(a + b) % 3]]
        final = arms[: 1 + r.n % 2]
        documents[f"{_stem(a, b)}_seed-{seed}.json"] = {
            "config": {"scenario": _SCENARIOS[a], "policy": _POLICIES[b], "arms": arms, "arm_pool_size": "small", "n_rounds": 100, "seed": seed, "hierarchical": False},
            "metrics": {"iterations": 100, "total_ndcg_regret": r.regret, "avg_ndcg_regret": r.regret / 100, "total_clicks": r.clicks, "click_rate": r.clicks / 100},
            "selection_rates": {arm: r[f"s{i}"] for i, arm in enumerate(arms)}, "win_rates": {arm: r[f"w{i}"] for i, arm in enumerate(arms) if i}, "policy_stats": {"set_E": final, "set_F": final, "t": 100}, "runtime": r.runtime,
            "inference_stats": {"total_inferences": r.n, "avg_arms_per_query": r.n / 100}, "logical_cost": {"total_evaluations": r.n, "avg_arms_per_query": r.n / 100, "total_queries": 100},
        }
    folder = f"{shared_dir(x.spark)}/{x.spark.sparkContext.applicationId}/results-{uuid.uuid4().hex}"
    reports.store_results(x.spark, documents, folder)
    return reports.read_results(x.spark, folder)


def _results_sql() -> str:
    text = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    pick = lambda values, at: f"[{', '.join(values)}][{at} + 1]"
    stems = pick([f"'{_stem(a, b)}'" for a in range(3) for b in range(3)], "g // 3")
    arms = pick([text(v) for v in _POOLS.values()], "(g // 9 + g // 3 % 3) % 3")
    shares = lambda name, kind: ", ".join(f"sum(CASE WHEN event_id % 4 = {i} AND {kind} THEN 1 ELSE 0 END) / count(*)::DOUBLE AS {name}{i}" for i in range(4))
    literal = lambda xs: text(sorted(xs))
    return f"""runs AS (SELECT CAST(user_id % 27 AS INTEGER) AS g, count(*) AS n, sum(value) AS regret, count(*) FILTER (event_type = 'click') AS clicks, avg(value) AS runtime,
  {shares('s', 'true')}, {shares('w', "event_type = 'click'")} FROM events GROUP BY user_id % 27),
res0 AS (SELECT {stems} || '_seed-' || (g % 3) || '.json' AS filename, {pick([repr(v) for v in _SCENARIOS], 'g // 9')} AS scenario, {pick([repr(v) for v in _POLICIES], 'g // 3 % 3')} AS policy, {arms} AS arms, g % 3 AS seed,
  regret, clicks, n AS evals, n / 100 AS apq, runtime, n % 2 AS odd, [s0, s1, s2, s3] AS s, [w0, w1, w2, w3] AS w FROM runs),
res AS (SELECT *, arms[1:1 + odd] AS final, map_from_entries(list_zip(arms, s[1:len(arms)])) AS sel, map_from_entries(list_zip(arms[2:], w[2:len(arms)])) AS win,
  CASE WHEN list_sort(arms) = {literal(reports.BASE_POOL)} THEN 'base_pool' WHEN list_sort(arms) = {literal(reports.LEARNING_POOL)} THEN 'learning_only' ELSE 'full_pool' END AS pool FROM res0)"""


_RES = _results_sql()


@query("policy_comparison", _RES, """SELECT scenario, pool, policy, count(*) AS runs, round(avg(regret), 6) AS total_regret, round(avg(regret / 100), 6) AS avg_regret, round(avg(clicks / 100), 6) AS click_rate,
round(avg(apq), 6) AS arms_per_query, round(avg(runtime), 6) AS runtime FROM res GROUP BY scenario, pool, policy""")
def _(x):
    names = ("total_regret", "avg_regret", "click_rate", "arms_per_query", "runtime")
    return reports.policy_comparison(results_frame(x)).select("scenario", "pool", "policy", "runs", *[r6(c).alias(c) for c in names])


@query("convergence", _RES, "SELECT filename, scenario, CAST(seed AS BIGINT) AS seed, array_to_string(final, ',') AS set_e, array_to_string(final, ',') AS set_f FROM res WHERE policy = 'mdb'")
def _(x):
    return reports.convergence(results_frame(x))


@query("arm_performance", _RES, """SELECT scenario, arm, round(avg(s), 6) AS selection_rate, round(avg(w), 6) AS win_rate FROM (
  SELECT scenario, arm, sel[arm] AS s, coalesce(win[arm], 0) AS w FROM res, unnest(map_keys(sel)) AS k(arm)) GROUP BY scenario, arm""")
def _(x):
    return reports.arm_performance(results_frame(x)).select("scenario", "arm", r6("selection_rate").alias("selection_rate"), r6("win_rate").alias("win_rate"))


@query("reproducibility", _RES, "SELECT scenario, policy, count(*) AS runs, round(avg(regret), 6) AS mean_regret, round(stddev_samp(regret), 6) AS sd_regret FROM res GROUP BY scenario, policy")
def _(x):
    return reports.reproducibility(results_frame(x)).select("scenario", "policy", "runs", r6("mean_regret").alias("mean_regret"), r6("sd_regret").alias("sd_regret"))


@query("key_findings", _RES, """SELECT f.scenario, f.policy, round((b.regret - f.regret) * 100 / b.regret, 6) AS reduction FROM (SELECT scenario, policy, arg_min(regret, filename) AS regret FROM res GROUP BY scenario, policy) f
JOIN (SELECT scenario, arg_min(regret, filename) AS regret FROM res WHERE policy = 'uniform' GROUP BY scenario) b ON b.scenario = f.scenario WHERE f.policy <> 'uniform'""")
def _(x):
    return reports.key_findings(results_frame(x)).withColumn("reduction", r6("reduction"))


@query("cost_findings", _RES, """SELECT f.scenario, f.policy, round((b.cost - f.cost) * 100.0 / b.cost, 6) AS reduction FROM (SELECT scenario, policy, arg_min(evals, filename) AS cost FROM res GROUP BY scenario, policy) f
JOIN (SELECT scenario, arg_min(evals, filename) AS cost FROM res WHERE policy = 'uniform' GROUP BY scenario) b ON b.scenario = f.scenario WHERE f.policy <> 'uniform'""")
def _(x):
    return reports.cost_findings(results_frame(x)).withColumn("reduction", r6("reduction"))


@query("learning_only", _RES, "SELECT count(*) AS runs, round(avg(regret), 6) AS mean_regret FROM res WHERE policy = 'mdb' AND list_sort(arms) = ['linear_ts', 'linucb']")
def _(x):
    return reports.learning_only(results_frame(x)).withColumn("mean_regret", r6("mean_regret"))


@query("common_survivor", _RES, """SELECT scenario, arm, n AS times FROM (SELECT scenario, arm, count(*) AS n FROM res, unnest(final) AS e(arm) GROUP BY scenario, arm)
QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY n DESC, arm) = 1""")
def _(x):
    return reports.common_survivor(results_frame(x))


_NAMED = _RES + """,
parts AS (SELECT *, string_split(regexp_replace(filename, '\\.json$', ''), '_') AS p FROM res),
named AS (SELECT *, array_to_string(p[3:len(p) - 1], '_') AS joined, CASE WHEN starts_with(p[3], 'K') THEN p[3] ELSE p[len(p) - 1] END AS kv FROM parts),
names AS (SELECT *, CASE WHEN p[1] = 'phase2' AND contains(joined, 'Flat') THEN 'Flat_' || kv WHEN p[1] = 'phase2' AND contains(joined, 'HMDB') THEN 'HMDB_' || kv ELSE joined END AS name FROM named),
phases AS (SELECT name, count(*) AS runs, avg(regret) AS regret, stddev_pop(regret) AS sd, avg(evals) AS inferences, avg(runtime) AS runtime FROM names GROUP BY name)"""


@query("result_names", _NAMED, "SELECT filename, p[1] AS phase, p[2] AS config_id, name FROM names")
def _(x):
    return reports.named_by_file(results_frame(x)).select("filename", "phase", "config_id", "name")


@query("phase_summary", _NAMED, "SELECT name, runs, round(regret, 6) AS regret, round(sd, 6) AS regret_sd, round(inferences, 6) AS inferences, round(runtime, 6) AS runtime FROM phases")
def _(x):
    return reports.phase_summary(results_frame(x)).select("name", "runs", *[r6(c).alias(c) for c in ("regret", "regret_sd", "inferences", "runtime")])


@query("scalability", _NAMED, """SELECT substr(f.name, 6) AS k, round((f.inferences - h.inferences) * 100 / f.inferences, 6) AS cost_reduction, round((f.regret - h.regret) * 100 / f.regret, 6) AS regret_reduction
FROM phases f JOIN phases h ON 'HMDB_' || substr(f.name, 6) = h.name WHERE starts_with(f.name, 'Flat_K')""")
def _(x):
    return reports.scalability(reports.phase_summary(results_frame(x))).select("k", r6("cost_reduction").alias("cost_reduction"), r6("regret_reduction").alias("regret_reduction"))


@query("eda_profile", _DOCS, """SELECT count(*) AS queries, CAST(sum(n) AS BIGINT) AS documents, min(n) AS min_docs, max(n) AS max_docs, round(avg(n), 6) AS mean_docs, round(median(n), 6) AS median_docs,
any_value(g0) AS grade_0, any_value(g1) AS grade_1, any_value(g2) AS grade_2, any_value(g3) AS grade_3, any_value(g4) AS grade_4, any_value(lo) AS feature_min, any_value(hi) AS feature_max, round(any_value(m), 6) AS feature_mean
FROM (SELECT count(*) AS n FROM docs GROUP BY query_id), (SELECT count(*) FILTER (rel = 0) AS g0, count(*) FILTER (rel = 1) AS g1, count(*) FILTER (rel = 2) AS g2, count(*) FILTER (rel = 3) AS g3, count(*) FILTER (rel = 4) AS g4,
  min(least(value, k, doc, hr)) AS lo, max(greatest(value, k, doc, hr)) AS hi, CAST(sum(CAST(value AS DECIMAL(24, 9)) + CAST(k AS DECIMAL(24, 9)) + doc + CAST(hr AS DECIMAL(24, 9))) AS DOUBLE) / (4 * count(*)) AS m FROM docs)""")
def _(x):
    return reports.profile(x.docs).withColumn("mean_docs", r6("mean_docs")).withColumn("median_docs", r6("median_docs")).withColumn("feature_mean", r6("feature_mean"))


_SPLIT = _DOCS + """,
placed AS (SELECT d.*, 'set' || (1 + round % 2) AS s, CASE WHEN round % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM docs d JOIN rounds USING (query_id)),
sizes AS (SELECT s, split, query_id, count(*) AS n FROM placed GROUP BY s, split, query_id)"""


@query("eda_splits", _SPLIT, """SELECT s AS "set", split, count(*) AS queries, CAST(sum(n) AS BIGINT) AS documents, min(n) AS min_docs, max(n) AS max_docs, round(avg(n), 6) AS mean_docs, round(median(n), 6) AS median_docs,
(SELECT count(*) FROM placed p WHERE p.s = z.s AND p.split = z.split AND rel = 4) AS grade_4 FROM sizes z GROUP BY s, split""")
def _(x):
    """Sets and splits are written as chunks and profiled where they lie."""
    folder = f"{shared_dir(x.spark)}/{x.spark.sparkContext.applicationId}/sets-{uuid.uuid4().hex}"
    placed = groups.nested(x.docs).join(x.order.select("query_id", "round"), "query_id")
    split = F.when(F.col("round") % 5 == 0, F.lit("test")).otherwise(F.lit("train"))
    groups.write_splits(placed.withColumn("set", F.concat(F.lit("set"), (F.col("round") % 2 + 1).cast("string"))).withColumn("split", split), folder, 200)
    names = ("queries", "documents", "min_docs", "max_docs", "mean_docs", "median_docs", "grade_4")
    found = reports.profile_splits(x.spark, folder)
    rows = [(s, p, *(v[n] for n in names)) for s, splits in found.items() for p, v in splits.items() if "error" not in v]
    frame = x.spark.createDataFrame(rows, "set string, split string, queries long, documents long, min_docs long, max_docs long, mean_docs double, median_docs double, grade_4 long")
    return frame.withColumn("mean_docs", r6("mean_docs")).withColumn("median_docs", r6("median_docs"))


# Adaptive runs and learners: no SQL


def _adaptive(x, runs: list[dict]) -> DataFrame:
    return adaptive.adaptive_runs(x.lists, x.docs, runs, list(ARMS), max(2000, x.t))


@query("adaptive_mdb")
def _(x):
    return _adaptive(x, [{"run_id": f"{s}-{seed}", "policy": "mdb", "scenario": s, "seed": seed, "settings": {"n_min": 200}} for s in rounds.SCENARIOS for seed in (1, 2)])


@query("adaptive_rucb")
def _(x):
    return _adaptive(x, [{"run_id": f"rucb-{seed}", "policy": "multi_rucb", "seed": seed, "settings": {"n_min": 200, "m": 2}} for seed in (1, 2)])


@query("adaptive_thompson")
def _(x):
    return _adaptive(x, [{"run_id": f"ts-{seed}", "policy": "thompson", "seed": seed} for seed in (1, 2)])


@query("adaptive_hier")
def _(x):
    settings = {"clusters": {0: [0, 1], 1: [2], 2: [3]}, "reps": {0: 0, 1: 2, 2: 3}, "level1_rounds": 800, "n_min": 100}
    return _adaptive(x, [{"run_id": f"{w}", "policy": "hierarchical", "seed": 1, "settings": settings | {"warm": w}} for w in (True, False)])


@query("adaptive_learning")
def _(x):
    """Runs whose linear arms go on learning from every click."""
    live = {"linucb": lambda seed: learners.LiveLinUCB(learners.LinearBandit(4)), "linear_ts": lambda seed: learners.LiveThompson(learners.LinearBandit(4), seed)}
    scaled = F.expr("transform(features, v -> v / 100D)")
    runs = [{"run_id": f"{p}-{seed}", "policy": p, "seed": seed, "settings": {"n_min": 200} if p == "mdb" else {}} for p in ("mdb", "uniform") for seed in (1, 2)]
    return adaptive.adaptive_runs(x.lists.where("arm in ('value', 'k')"), x.docs.withColumn("__x", scaled), runs, ["value", "k", "linucb", "linear_ts"], x.t, live=live)


def _bandit(x):
    shape = learners.projection(x.wide, 8)
    rows = x.wide.withColumn("x", shape.column()).withColumn("reward", (F.col("rel") >= 3).cast("double"))
    return rows, learners.LinearBandit(8).fit(rows)


@query("linucb_rank")
def _(x):
    rows, bandit = _bandit(x)
    return ranking.ranked(rows.withColumn("s", bandit.optimistic()), {"linucb": F.col("s")})


@query("linear_ts_rank")
def _(x):
    rows, bandit = _bandit(x)
    return ranking.ranked(rows.withColumn("s", bandit.drawn(42)), {"linear_ts": F.col("s")})


_BANDIT = _DOCS + f""",
two AS (SELECT query_id, doc, value / 100 AS x0, k / 100 AS x1, CASE WHEN rel >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM docs),
fitted AS (SELECT 1 + sum(x0 * x0) AS a, sum(x0 * x1) AS b, 1 + sum(x1 * x1) AS d, sum(x0 * r) AS p, sum(x1 * r) AS q FROM two),
inverse AS (SELECT d / (a * d - b * b) AS i00, -b / (a * d - b * b) AS i01, a / (a * d - b * b) AS i11, p, q FROM fitted),
means AS (SELECT *, i00 * p + i01 * q AS m0, i01 * p + i11 * q AS m1, sqrt(i00) AS l00, i01 / sqrt(i00) AS l10, sqrt(i11 - i01 * i01 / i00) AS l11 FROM inverse),
drawn AS (SELECT *, m0 + l00 * {normal_sql(42, 'ts', 0)} AS t0, m1 + l10 * {normal_sql(42, 'ts', 0)} + l11 * {normal_sql(42, 'ts', 1)} AS t1 FROM means),
scores AS (SELECT query_id, doc, x0 * m0 + x1 * m1 + sqrt(greatest(0, x0 * x0 * i00 + 2 * x0 * x1 * i01 + x1 * x1 * i11)) AS ucb, x0 * t0 + x1 * t1 AS ts FROM two, drawn)"""
_BANDIT_BODY = "SELECT query_id, doc, round({0}, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {0} DESC, doc) AS INTEGER) AS pos FROM scores"


def _two_features(x):
    """All documents by two features, which need no projection, and the bandit that saw them all."""
    rows = x.docs.withColumn("x", F.expr("transform(slice(features, 1, 2), v -> v / 100D)")).withColumn("reward", (F.col("rel") >= 3).cast("double"))
    return rows, learners.LinearBandit(2).fit(rows)


def _bandit_ranks(rows: DataFrame, score) -> DataFrame:
    scored = rows.withColumn("s", score)
    return ranking.ranked(scored, {"arm": F.col("s")}).join(scored.select("query_id", "doc", "s"), ["query_id", "doc"]).select("query_id", "doc", r6("s").alias("score"), "pos")


@query("linucb_events", _BANDIT, _BANDIT_BODY.format("ucb"))
def _(x):
    rows, bandit = _two_features(x)
    return _bandit_ranks(rows, bandit.optimistic())


@query("linear_ts_events", _BANDIT, _BANDIT_BODY.format("ts"))
def _(x):
    rows, bandit = _two_features(x)
    return _bandit_ranks(rows, bandit.drawn(42))


@query("boosted_rank")
def _(x):
    model = learners.boosted(x.docs)
    return ranking.ranked(model.scored(x.docs), {"xgboost": F.col("score")})


@query("flagship", _WON, f"SELECT i, j, CAST(w AS DOUBLE) AS w, CAST(n AS BIGINT) AS n, round(ucb, 6) AS ucb, fit AS in_e FROM cells JOIN ucbs USING (i, j) JOIN members ON arm = i")
def _(x):
    bounds = policy.upper_bounds(x.cells, x.t)
    fit = policy.set_membership(x.cells, x.arms, x.t, N_MIN).select(F.col("arm").alias("i"), "in_e")
    return bounds.join(F.broadcast(fit), "i").select("i", "j", "w", "n", r6("ucb").alias("ucb"), "in_e")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings, slates, clicks, credit, pair statistics and bounds of the uniform run."""
    return QUERIES["flagship"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
