"""Adaptive runs: every round's arms depend on all rounds before, so a run is one sequential loop.

Runs are independent of each other, and each is one partition, sorted by round, that passes through a loop in batches: the
loop owns the win matrices, the policy's state and the arms that learn, and emits a row a round. It holds a batch of rounds
at a time, however many the run has: a query that is replayed comes again as a row of its later round.

Arms that learn rank each query by what they know at that round, and all of them learn from the topmost clicked document
of every round, whether they took part or not. Users, drafts and credit are looked up by name, so that a program may add
its own: a click model is a function (relevance of the slate, scenario, rng, slate size) -> clicked positions, a draft is
one of (rankings by arm, order of arms, size) -> (slate, drafting arm by document), and credit is one of (clicked
positions, slate, drafting arm by document, participants) -> (winner or None, {(winner, loser): credit}).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written
from ..sources.groups import numbered
from .rounds import CLICK, Scenario, drafted_any, examination, scenario


@dataclass
class Tracker:
    """Wins W, meetings N and rounds t; wins fade by ``discount`` a round where it is set."""

    n: int
    discount: float | None = None
    t: int = 0
    wins: np.ndarray = field(init=False)
    met: np.ndarray = field(init=False)

    def __post_init__(self):
        if self.discount is not None and not 0 < self.discount < 1:
            raise ValueError("the discount lies between 0 and 1")
        self.reset()

    def reset(self) -> None:
        self.t, self.wins, self.met = 0, np.zeros((self.n, self.n)), np.zeros((self.n, self.n))

    def update(self, winner: int | None, participants: list[int], outcomes: dict[tuple[int, int], float] | None = None) -> None:
        """outcomes: credit by (winner, loser); by default the winner beats all other participants."""
        self.t += 1
        if self.discount is not None:
            self.wins *= self.discount
        if outcomes is None:
            outcomes = {(winner, loser): 1.0 for loser in participants if loser != winner} if winner is not None else {}
        for (i, j), credit in outcomes.items():
            self.wins[i, j] += credit
            self.met[i, j] += 1
            self.met[j, i] += 1

    def inherit(self, source: int, members: list[int]) -> None:
        """Members take over the rows and columns of the source."""
        f = np.arange(self.n)
        f[members] = source
        self.wins, self.met = self.wins[np.ix_(f, f)], self.met[np.ix_(f, f)]
        for i in range(self.n):
            self.wins[i, i] = self.met[i, i] = 0

    @property
    def horizon(self) -> float:
        return float(self.t) if self.discount is None else 1 / (1 - self.discount)

    def statistics(self) -> dict:
        out = {"t": self.t, "effective_t": self.horizon, "W": self.wins.tolist(), "N": self.met.tolist(), "tracker_type": "cumulative" if self.discount is None else "discounted"}
        return out if self.discount is None else out | {"discount_factor": self.discount, "effective_horizon": self.horizon}


class Policy:
    """All arms each round; others narrow that down."""

    def __init__(self, n: int, rng: np.random.Generator, discount: float | None = None):
        self.n, self.rng, self.tracker = n, rng, Tracker(n, discount)
        self.level = 0

    def select(self) -> list[int]:
        return list(range(self.n))

    def update(self, winner: int | None, participants: list[int], outcomes: dict[tuple[int, int], float] | None = None) -> None:
        self.tracker.update(winner, participants, outcomes)

    def statistics(self, arms: list[str]) -> dict:
        """What a result document says of the policy; arms by name."""
        return self.tracker.statistics()


class Fixed(Policy):
    def __init__(self, *args, arm: int = 0, **kw):
        super().__init__(*args, **kw)
        if not 0 <= arm < self.n:
            raise ValueError("no such arm")
        self.arm = arm

    def select(self):
        return [self.arm]


class Thompson(Policy):
    """One arm a round by draws from Beta posteriors of its winning."""

    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self.a, self.b = np.ones(self.n), np.ones(self.n)

    def select(self):
        return [int(np.argmax(self.rng.beta(self.a, self.b)))]

    def update(self, winner, participants, outcomes=None):
        super().update(winner, participants, outcomes)
        played = participants[0]
        (self.a if winner == played else self.b)[played] += 1

    def statistics(self, arms):
        return super().statistics(arms) | {"posterior_a": dict(zip(arms, self.a.tolist(), strict=True)), "posterior_b": dict(zip(arms, self.b.tolist(), strict=True))}


#: Arms up to which numbers one by one are faster than arrays.
FEW_ARMS = 8


class Dueling(Policy):
    """Arms whose optimistic win rates against all others are at least a half."""

    def __init__(self, *args, alpha: float = 0.51, beta: float = 1.0, n_min: int = 500, **kw):
        super().__init__(*args, **kw)
        if alpha <= 0.5 or beta < 1 or n_min < 0:
            raise ValueError("alpha must be over 0.5, beta at least 1, n_min at least 0")
        self.alpha, self.beta, self.n_min = alpha, beta, n_min

    def least_bounds(self, arms: list[int], beta: float) -> np.ndarray:
        if len(arms) <= FEW_ARMS:
            wins, met = self.tracker.wins.tolist(), self.tracker.met.tolist()
            reach = beta * self.alpha * float(np.log(max(self.tracker.t, 1)))
            bound = lambda w, n: w / n + math.sqrt(reach / n) if n > 0 else 1.0
            return np.array([min((bound(wins[i][j], met[i][j]) for j in arms if j != i), default=math.inf) for i in arms])
        w, n = (m[np.ix_(arms, arms)] for m in (self.tracker.wins, self.tracker.met))
        known = np.where(n > 0, n, 1)
        u = np.where(n > 0, w / known + np.sqrt(beta * self.alpha * np.log(max(self.tracker.t, 1)) / known), 1.0)
        np.fill_diagonal(u, np.inf)
        return u.min(axis=1, initial=np.inf)

    def qualified(self, arms: list[int], beta: float) -> list[int]:
        return [a for a, u in zip(arms, self.least_bounds(arms, beta), strict=True) if u >= 0.5]

    def select(self):
        arms = list(range(self.n))
        if self.tracker.t < self.n_min:
            return arms
        e = self.qualified(arms, 1.0)
        f = e if self.beta == 1.0 else self.qualified(arms, self.beta)
        return e if len(e) == 1 else f or arms

    def _grace(self) -> dict:
        return {"alpha": self.alpha, "beta": self.beta, "n_min": self.n_min, "in_grace_period": self.n_min > 0 and self.tracker.t < self.n_min}

    def statistics(self, arms):
        every = list(range(self.n))
        f = every if self.tracker.t < self.n_min else self.qualified(every, self.beta)
        return super().statistics(arms) | {"set_E": [arms[i] for i in self.qualified(every, 1.0)], "set_F": [arms[i] for i in f]} | self._grace()


class Relative(Dueling):
    """Candidates by relative win rates; of more than m, m are drawn with a preference for an earlier single one."""

    def __init__(self, *args, m: int | None = None, **kw):
        super().__init__(*args, **kw)
        self.m, self.best = m or self.n, None

    def candidates(self) -> list[int]:
        w, total = self.tracker.wins, self.tracker.wins + self.tracker.wins.T
        known = np.where(total > 0, total, 1)
        u = np.where(total > 0, w / known + np.sqrt(self.alpha * np.log(max(self.tracker.t, 1)) / known), 1.0)
        np.fill_diagonal(u, 0.5)
        return [int(i) for i in np.flatnonzero((u >= 0.5).all(axis=1))]

    def statistics(self, arms):
        found = self.candidates()
        own = {"policy_type": "multi_rucb", "m": self.m, "candidate_set_C": [arms[i] for i in found], "candidate_set_size": len(found), "hypothesized_best_B": None if self.best is None else arms[self.best]}
        grace = self._grace()
        grace.pop("beta")
        return Policy.statistics(self, arms) | own | grace

    def select(self):
        arms = list(range(self.n))
        if self.tracker.t < self.n_min:
            return arms
        found = self.candidates()
        draw = lambda pool, k: sorted(int(x) for x in self.rng.choice(pool, size=min(k, len(pool)), replace=False))
        if not found:
            return draw(arms, self.m)
        if len(found) == 1:
            self.best = found[0]
            return found
        if len(found) <= self.m:
            return found
        if self.best not in found:
            return draw(found, self.m)
        others = [x for x in found if x != self.best]
        return sorted([self.best, *draw(others, self.m - 1)]) if self.rng.random() < 0.5 else draw(others, self.m)


class TwoLevel(Dueling):
    """Screens the representatives of clusters first, then the members of the cluster whose representative won most.

    Warm start: members inherit their representative's statistics; otherwise everything starts anew.
    """

    def __init__(self, *args, clusters: dict[int, list[int]], reps: dict[int, int], level1_rounds: int = 2000, warm: bool = True, **kw):
        super().__init__(*args, **kw)
        self.clusters, self.reps, self.level1_rounds, self.warm = clusters, reps, level1_rounds, warm
        self.level, self.active, self.winner = 1, list(reps.values()), None

    def _descend(self) -> None:
        if not self.clusters:
            self.active = list(range(self.n))
        else:
            most = -1.0
            for cluster, rep in self.reps.items():
                won = sum(self.tracker.wins[rep, j] for j in self.active if j != rep)
                if won > most:
                    most, self.winner = won, cluster
            self.active = list(self.clusters[self.winner])
            if self.warm:
                rep = self.reps[self.winner]
                self.tracker.inherit(rep, [a for a in self.active if a != rep])
        if not self.warm:
            self.tracker.reset()
        self.level = 2

    def select(self):
        if self.level == 1 and self.tracker.t >= self.level1_rounds:
            self._descend()
        if not self.active:
            return list(range(self.n))
        if self.tracker.t < self.n_min:
            return list(self.active)
        return self.qualified(self.active, 1.0) or list(self.active)

    def statistics(self, arms):
        own = {"current_level": self.level, "level1_rounds": self.level1_rounds, "winning_cluster_id": self.winner, "active_arms": [arms[i] for i in self.active], "n_clusters": len(self.clusters), "warm_start": self.warm}
        return Policy.statistics(self, arms) | own | self._grace()


POLICIES = {"uniform": Policy, "fixed": Fixed, "thompson": Thompson, "ts": Thompson, "mdb": Dueling, "multi_rucb": Relative, "hierarchical": TwoLevel}


def create_policy(name: str, arms: list[str], rng: np.random.Generator, **settings) -> Policy:
    """By name, whatever its case; ``fixed:ARM`` plays one arm."""
    kind, _, arm = name.partition(":")
    if kind.lower() not in POLICIES:
        raise ValueError(f"unknown policy {name!r}")
    if kind.lower() == "fixed":
        if arm not in arms:
            raise ValueError(f"unknown arm {arm!r}")
        settings["arm"] = arms.index(arm)
    return POLICIES[kind.lower()](len(arms), rng, **settings)


@lru_cache(64)
def _examined(slate_size: int) -> np.ndarray:
    return np.array(examination(slate_size))


@lru_cache(4096)
def _discounts(n: int) -> np.ndarray:
    return np.log2(np.arange(n) + 2)


_CLICK = np.array(CLICK)


def _position_clicks(rel: np.ndarray, told: Scenario, rng: np.random.Generator, slate_size: int) -> list[int]:
    chance = _examined(slate_size)[: len(rel)] * _CLICK[np.minimum(rel, len(CLICK) - 1)]
    return np.flatnonzero(rng.random(len(rel)) < chance).tolist()


def _descending_clicks(rel: np.ndarray, told: Scenario, rng: np.random.Generator, slate_size: int) -> list[int]:
    depth = min(len(rel), told.depth)
    if told.noise and rng.random() < told.noise:
        return [int(rng.integers(depth))] if depth else []
    for pos in range(depth):
        if rel[pos] >= told.threshold and not (told.missed and rng.random() < told.missed):
            return [pos]
    return []


def first_click(clicked: list[int], slate: list[int], by: dict[int, int], participants: list[int]) -> tuple[int | None, dict[tuple[int, int], float]]:
    """The arm that drafted the topmost clicked document beats every other participant."""
    if not clicked:
        return None, {}
    winner = by[slate[clicked[0]]]
    return winner, {(winner, x): 1.0 for x in participants if x != winner}


CLICK_MODELS: dict[str, Callable] = {"position": _position_clicks, "cascade": _descending_clicks, "noisy": _descending_clicks}
DRAFTS: dict[str, Callable] = {"team_draft": drafted_any}
CREDITS: dict[str, Callable] = {"team_draft_legacy": first_click}


def chosen(registry: dict, name: str):
    """The entry of a registry; ValueError with the names it has otherwise."""
    if name not in registry:
        raise ValueError(f"unknown name {name!r}; there are {sorted(registry)}")
    return registry[name]


def clicks_of(rel: np.ndarray, told: str | Scenario, rng: np.random.Generator, slate_size: int) -> list[int]:
    """Clicked positions of a slate, ascending."""
    told = scenario(told) if isinstance(told, str) else told
    return chosen(CLICK_MODELS, told.model)(rel, told, rng, slate_size)


def gain(rel: np.ndarray) -> float:
    return float((rel / _discounts(len(rel))).sum())


ROUND_DDL = "run_id string, round int, query_id string, arms array<string>, winner string, n_clicks int, regret double, level int, live int, stats string"


def simulate(
    queries: list[tuple], arms: list[str], policy: Policy, rng: np.random.Generator, n_rounds: int, told: str | Scenario, slate_size: int = 10, run_id: str = "",
    live: dict | None = None, draft: Callable = drafted_any, credit: Callable = first_click,
) -> list[tuple]:
    """Rows of ROUND_DDL; queries are (id, relevance by document, ranking by arm) and, where arms learn, the documents'
    features; they are replayed in turn.

    live: the arms that learn, by name: objects with ``rank(features) -> documents`` and ``update(features, reward)``.
    The column ``live`` counts the rankings that they made; ``stats`` holds the policy's statistics on the last row.
    """
    rounds = ((t + 1, queries[t % len(queries)]) for t in range(n_rounds if queries else 0))
    return list(played(rounds, arms, policy, rng, told, slate_size, run_id, live, draft, credit))


def played(
    rounds: Iterable[tuple[int, tuple]], arms: list[str], policy: Policy, rng: np.random.Generator, told: str | Scenario, slate_size: int = 10, run_id: str = "",
    live: dict | None = None, draft: Callable = drafted_any, credit: Callable = first_click,
) -> Iterator[tuple]:
    """As ``simulate``, over rounds (number, query) that come one by one; the last row is held back for the statistics."""
    last, live, index = None, live or {}, {a: i for i, a in enumerate(arms)}
    for number, (query_id, rel, rankings, *x) in rounds:
        selected = policy.select()
        now = [arms[i] for i in selected if arms[i] in live]
        shown_by = {a: rankings[a] for a in (arms[i] for i in selected) if a in rankings} | {a: live[a].rank(x[0]) for a in now}
        order = [arms[i] for i in rng.permutation(selected)]
        slate, by = draft(shown_by, order, min(slate_size, len(rel)))
        if not slate:
            continue
        shown = rel[slate]
        clicked = clicks_of(shown, told, rng, slate_size)
        winner, outcomes = credit(clicked, slate, {d: index[a] for d, a in by.items()}, selected)
        policy.update(winner, selected, outcomes)
        if clicked:
            for arm in live.values():
                arm.update(x[0][slate[clicked[0]]], 1.0)
        best = gain(np.sort(rel)[::-1][: len(slate)])
        regret = max(0.0, 1 - gain(shown) / best) if best else 0.0
        if last is not None:
            yield last
        last = (run_id, number, query_id, [arms[i] for i in selected], None if winner is None else arms[winner], len(clicked), regret, policy.level, len(now), None)
    if last is not None:
        yield (*last[:-1], json.dumps(policy.statistics(arms)))


_ROUND = pa.schema([("run_id", pa.string()), ("round", pa.int32()), ("query_id", pa.string()), ("arms", pa.list_(pa.string())), ("winner", pa.string()), ("n_clicks", pa.int32()), ("regret", pa.float64()), ("level", pa.int32()), ("live", pa.int32()), ("stats", pa.string())])
#: Rounds that a run reads, and that it emits, at once.
READ_ROUNDS, SENT_ROUNDS = 256, 4096


def adaptive_runs(
    rankings: DataFrame, docs: DataFrame, runs: list[dict], arms: list[str], n_rounds: int, slate_size: int = 10, live: dict[str, Callable] | None = None, x: str = "__x", draft: str = "team_draft", credit: str = "team_draft_legacy"
) -> DataFrame:
    """Rounds of independent runs. runs: dicts of run_id, policy, scenario, seed and the policy's settings.

    rankings: (query_id, arm, ranking); every run gets its first ``n_rounds`` queries, by id, in turn. live: for each arm that
    learns, a function from the run's seed to a fresh arm; ``docs`` then have the features it takes in column ``x``.
    """
    drafts, credits_, own_live = chosen(DRAFTS, draft), chosen(CREDITS, credit), live or {}
    per_arm = F.map_from_entries(F.collect_list(F.struct("arm", F.expr("transform(ranking, x -> cast(x as int))").alias("r"))))
    fields = F.struct("doc", "rel", *([F.col(x).alias("x")] if own_live else []))
    rel = docs.groupBy("query_id").agg(F.array_sort(F.collect_list(fields)).alias("d"))
    rel = rel.select("query_id", F.expr("transform(d, x -> x.rel)").alias("rel"), *([F.expr("transform(d, y -> y.x)").alias("x")] if own_live else []))
    static = rankings.where(~F.col("arm").isin(list(own_live))) if own_live else rankings
    queries = rel.join(static.groupBy("query_id").agg(per_arm.alias("rankings")), "query_id", "left" if own_live else "inner")
    queries = written(queries, "queries")
    n, settings = queries.count(), {i: r for i, r in enumerate(runs)}
    own = numbered(queries.select("query_id"), "query_id").where(F.col("place") <= n_rounds)
    rounds = queries.join(own, "query_id").withColumn("round", F.explode(F.sequence("place", F.lit(max(n_rounds, 1)).cast("long"), F.lit(max(n, 1)).cast("long")))).drop("place")
    each = rounds.withColumn("run", F.explode(F.array(*[F.lit(i) for i in settings])))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, tuple]]:
        for batch in batches:
            for low in range(0, batch.num_rows, READ_ROUNDS):
                for r in batch.slice(low, READ_ROUNDS).to_pylist():
                    own = () if not own_live else (np.array([np.asarray(v, float) for v in r["x"]]),)
                    yield r["run"], r["round"], (r["query_id"], np.asarray(r["rel"], dtype=int), dict(r["rankings"] or ()), *own)

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = read(batches)
        first = next(told, None)
        if first is None:
            return
        run = settings[first[0]]
        rng = np.random.default_rng(run["seed"])
        policy = create_policy(run["policy"], arms, rng, **run.get("settings", {}))
        fresh = {a: make(run["seed"]) for a, make in own_live.items()}
        rounds = ((number, query) for part in ([first], told) for _, number, query in part)
        out: list[tuple] = []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ROUND, strict=True)], schema=_ROUND)
        for row in played(rounds, arms, policy, rng, run.get("scenario", "standard"), slate_size, run["run_id"], fresh, drafts, credits_):
            out.append(row)
            if len(out) == SENT_ROUNDS:
                yield packed()
                out = []
        if out:
            yield packed()

    # A partition a run.
    return each.repartitionById(len(runs), "run").sortWithinPartitions("round").mapInArrow(play, ROUND_DDL)
