"""One round of interleaved evaluation as column expressions: slates, clicks and credit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform

#: Chances of looking at a position, from the top, and of clicking by relevance (fixed values).
EXAMINE = [1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1]
CLICK = [0.01, 0.1, 0.3, 0.6, 0.95]



@dataclass(frozen=True)
class Scenario:
    """A kind of user, by the name of a click model, and what it is told: the least relevance that is clicked, how far down
    users look, how often they click anywhere, and how often they overlook a relevant document."""

    model: str
    threshold: int = 3
    depth: int = 10
    noise: float = 0.0
    missed: float = 0.0


SCENARIOS = {"standard": Scenario("position"), "cascade": Scenario("cascade"), "noisy": Scenario("noisy", noise=0.1, missed=0.1)}


def scenario(name: str) -> Scenario:
    if name not in SCENARIOS:
        raise KeyError(f"unknown scenario {name!r}; there are {sorted(SCENARIOS)}")
    return SCENARIOS[name]


def examination(positions: int, given: list[float] | None = None) -> list[float]:
    """Chances for ``positions`` places: beyond the given ones each is 0.9 of the one before, at least 0.01."""
    out = list(EXAMINE if given is None else given) or [1.0]
    while len(out) < positions:
        out.append(max(0.01, out[-1] * 0.9))
    return out


def drafted(rankings: DataFrame, rounds: DataFrame, slate_size: int = 10, seed: int = 42) -> DataFrame:
    """Team draft: (round, query_id, slate array<struct<doc, arm>>, participants).

    rankings: (query_id, arm, ranking), whole permutations; rounds: (round, query_id). Arms take turns in a random
    order that turns round after each pass; each drafts its best document that is not drafted yet. The first
    ``slate_size`` places of a ranking hold every document that its arm can draft, so only these are moved.
    """
    teams = rounds.select("round", "query_id").join(rankings.select("query_id", "arm", F.slice("ranking", 1, slate_size).alias("ranking")), "query_id")
    draw = uniform(seed, "draft", "round", "arm")
    arms = F.array_sort(F.collect_list(F.struct(draw.alias("u"), "arm", F.expr("transform(ranking, x -> cast(x as int))").alias("ranking"))))
    gathered = teams.groupBy("round", "query_id").agg(arms.alias("teams"))
    slots = f"least({slate_size}, size(teams[0].ranking))"
    team = "teams[if((s div size(teams)) % 2 = 0, s % size(teams), size(teams) - 1 - s % size(teams))]"
    pick = f"array_except({team}.ranking, transform(acc, x -> x.doc))[0]"
    fold = (
        f"if({slots} > 0, aggregate(sequence(0, {slots} - 1), cast(array() as array<struct<doc:int,arm:string>>), "
        f"(acc, s) -> concat(acc, array(named_struct('doc', {pick}, 'arm', {team}.arm)))), cast(array() as array<struct<doc:int,arm:string>>))"
    )
    return gathered.select("round", "query_id", F.expr(fold).alias("slate"), F.expr("array_sort(transform(teams, t -> t.arm))").alias("participants"))


def drafted_lists(rankings: DataFrame, rounds: DataFrame, slate_size: int = 10, seed: int = 42) -> DataFrame:
    """Team draft of lists of any length: (round, query_id, slate array<struct<doc, arm>>, participants).

    As ``drafted``, but an arm's list may be short, empty or null, lists may hold different documents, and an arm that has
    nothing new to offer is passed over. Each pass over the arms drafts a document or is the last, so ``slate_size`` passes
    are enough, and an arm never looks beyond the first ``slate_size`` different documents of its list.
    """
    own = F.expr(f"slice(array_distinct(coalesce(transform(ranking, x -> cast(x as int)), array())), 1, {slate_size})")
    teams = rounds.select("round", "query_id").join(rankings.select("query_id", "arm", own.alias("ranking")), "query_id")
    arms = F.array_sort(F.collect_list(F.struct(uniform(seed, "draft", "round", "arm").alias("u"), "arm", "ranking")))
    gathered = teams.groupBy("round", "query_id").agg(arms.alias("teams"))
    none = "cast(array() as array<struct<doc:int,arm:string>>)"
    turn = "if((s div size(teams)) % 2 = 0, s % size(teams), size(teams) - 1 - s % size(teams))"
    free = "filter(team.ranking, d -> not exists(acc, x -> x.doc = d))"
    take = f"transform(slice({free}, 1, 1), d -> named_struct('doc', d, 'arm', team.arm))"
    step = f"if(size(acc) >= {slate_size}, acc, aggregate(array(teams[{turn}]), acc, (a, team) -> concat(a, {take.replace('acc', 'a')})))"
    fold = f"aggregate(sequence(0, {slate_size} * size(teams) - 1), {none}, (acc, s) -> {step})"
    return gathered.select("round", "query_id", F.expr(fold).alias("slate"), F.expr("array_sort(transform(teams, t -> t.arm))").alias("participants"))


def drafted_any(rankings: dict[str, list[int]], order: list[str], slate_size: int = 10) -> tuple[list[int], dict[int, str]]:
    """Team draft of lists of any length, for one round: arms that have nothing new to offer are passed over."""
    slate: list[int] = []
    by: dict[int, str] = {}
    turn = [a for a in order if a in rankings]
    while turn and len(slate) < slate_size:
        before = len(slate)
        for arm in turn:
            new = next((d for d in rankings[arm] if d not in by), None)
            if new is not None and len(slate) < slate_size:
                slate.append(new)
                by[new] = arm
        if len(slate) == before:
            break
        turn = turn[::-1]
    return slate, by


def slate_rows(slates: DataFrame, docs: DataFrame) -> DataFrame:
    """(round, query_id, pos, doc, arm, rel), positions from 0."""
    rows = slates.select("round", "query_id", F.posexplode("slate").alias("pos", "x")).select("round", "query_id", "pos", "x.doc", "x.arm")
    return rows.join(docs.select("query_id", "doc", "rel"), ["query_id", "doc"]).select("round", "query_id", "pos", "doc", "arm", "rel")


def _table(values: list[float], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def click_chance(examine: list[float] | None = None, click: list[float] | None = None) -> Column:
    """Chance of a click from pos and rel; relevance beyond the table counts as its last, positions beyond it are unseen."""
    click = click or CLICK
    return F.coalesce(_table(examine or EXAMINE, F.col("pos")), F.lit(0.0)) * _table(click, F.least(F.col("rel"), F.lit(len(click) - 1)))


def position_clicks(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Rows of slates that are clicked under the position-based model; a round may have several clicks."""
    return rows.where(uniform(seed, "pbm", "round", "pos") < click_chance())


def cascade_clicks(rows: DataFrame, threshold: int = 3, depth: int = 10) -> DataFrame:
    """(round, pos): the first position within ``depth`` that is relevant enough."""
    return rows.where((F.col("rel") >= threshold) & (F.col("pos") < depth)).groupBy("round").agg(F.min("pos").alias("pos"))


def noisy_clicks(rows: DataFrame, threshold: int = 3, noise: float = 0.1, missed: float = 0.1, depth: int = 10, seed: int = 42) -> DataFrame:
    """(round, pos): by chance any position, else the first relevant one that isn't overlooked."""
    seen = (F.col("rel") >= threshold) & (F.col("pos") < depth) & (uniform(seed, "fn", "round", "pos") >= missed)
    per = rows.groupBy("round").agg(F.min(F.when(seen, F.col("pos"))).alias("first"), F.least(F.max("pos") + 1, F.lit(depth)).alias("n"))
    anywhere = F.floor(uniform(seed, "noisepos", "round") * F.col("n")).cast("int")
    return per.select("round", F.when(uniform(seed, "noise", "round") < noise, anywhere).otherwise(F.col("first")).alias("pos")).where("pos is not null")


def first_click_winners(clicked: DataFrame) -> DataFrame:
    """(round, winner): the arm that drafted the topmost clicked document."""
    return clicked.groupBy("round").agg(F.min_by("arm", "pos").alias("winner"))


def credited(winners: DataFrame, slates: DataFrame) -> DataFrame:
    """(round, winner, loser, credit): the winner beats every other participant of its round."""
    return (
        winners.join(slates.select("round", F.explode("participants").alias("loser")), "round").where("winner <> loser").select("round", "winner", "loser", F.lit(1.0).alias("credit"))
    )
