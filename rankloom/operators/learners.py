"""Rankers that learn: linear bandits on projected features, and boosted trees on pairs."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.rng import normals
from ..scratch import dropped, written
from ..shipping import ship
from . import trees

#: Trees after which scores are made anew from all trees; in between they are those kept by the executors and one tree more.
KEPT_TREES = 10
#: Documents that a projection is fitted on, at most.
PROJECTION_ROWS = 100_000


@dataclass
class Projection:
    """Centred features times components; none where they are few."""

    mean: np.ndarray
    components: np.ndarray  # features by dimensions

    def column(self, features: str = "features") -> Column:
        """The projected features, as an array column."""
        parts = []
        for k in range(self.components.shape[1]):
            weights = "array(" + ",".join(f"{float(v)!r}D" for v in self.components[:, k]) + ")"
            shift = float(self.mean @ self.components[:, k])
            parts.append(F.expr(f"aggregate(zip_with({features}, {weights}, (x, w) -> x * w), 0D, (a, x) -> a + x)") - F.lit(shift))
        return F.array(*parts)


def projection(docs: DataFrame, dimensions: int = 20) -> Projection:
    """Principal components of the first PROJECTION_ROWS documents in order; as many as there are, and none if features are few."""
    width = docs.select(F.size("features").alias("d")).first()["d"]
    if width <= dimensions:
        return Projection(np.zeros(width), np.eye(width))
    sample = docs.orderBy("query_id", "doc").limit(PROJECTION_ROWS).select(array_to_vector(F.col("features").cast("array<double>")).alias("v"))
    centre = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(sample)
    found = PCA(k=dimensions, inputCol="c", outputCol="p").fit(centre.transform(sample))
    return Projection(centre.mean.toArray(), found.pc.toArray())


@dataclass
class LinearBandit:
    """Ridge statistics of clicked documents: A = regularization * I + sum x x', b = sum reward * x."""

    dimensions: int
    regularization: float = 1.0
    a: np.ndarray = field(init=False)
    b: np.ndarray = field(init=False)

    def __post_init__(self):
        self.a, self.b = np.eye(self.dimensions) * self.regularization, np.zeros(self.dimensions)

    def update(self, x: np.ndarray, reward: float) -> None:
        self.a += np.outer(x, x)
        self.b += reward * x

    def fit(self, rows: DataFrame, x: str = "x", reward: str = "reward") -> LinearBandit:
        """Adds the sums over rows of (x array, reward): d * d sums, of which one row comes back."""
        d = self.dimensions
        outer = F.expr(f"flatten(transform({x}, p -> transform({x}, q -> p * q)))")
        per = rows.select(outer.alias("o"), F.expr(f"transform({x}, p -> p * {reward})").alias("r"))
        sums = per.agg(*[F.sum(F.col("o")[i]).alias(f"o{i}") for i in range(d * d)], *[F.sum(F.col("r")[i]).alias(f"r{i}") for i in range(d)]).first()
        if sums["r0"] is not None:
            self.a += np.array([sums[f"o{i}"] for i in range(d * d)]).reshape(d, d)
            self.b += np.array([sums[f"r{i}"] for i in range(d)])
        return self

    def optimistic(self, x: str = "x", alpha: float = 1.0) -> Column:
        """Mean reward plus alpha times its deviation."""
        inverse = np.linalg.inv(self.a)
        return _dot(x, inverse @ self.b) + F.lit(alpha) * F.sqrt(F.greatest(F.lit(0.0), _quadratic(x, inverse)))

    def drawn(self, seed: int, x: str = "x", noise: float = 1.0) -> Column:
        """Reward under weights drawn from their posterior, by hashed normal draws."""
        root = _root(noise * np.linalg.inv(self.a))
        theta = np.linalg.solve(self.a, self.b) + root @ np.array(normals(seed, "ts", self.dimensions))
        return _dot(x, theta)


def _weights(values: np.ndarray) -> str:
    return "array(" + ",".join(f"{float(v)!r}D" for v in values) + ")"


def _dot(x: str, weights: np.ndarray) -> Column:
    return F.expr(f"aggregate(zip_with({x}, {_weights(weights)}, (p, w) -> p * w), 0D, (a, v) -> a + v)")


def _quadratic(x: str, matrix: np.ndarray) -> Column:
    total = F.lit(0.0)
    for i, row in enumerate(matrix):
        total = total + F.col(x)[i] * _dot(x, row)
    return total


class LiveLinUCB:
    """A linear bandit that ranks and learns inside a run: mean reward plus alpha deviations."""

    def __init__(self, bandit: LinearBandit, alpha: float = 1.0):
        self.a, self.b, self.alpha = bandit.a.copy(), bandit.b.copy(), alpha
        self.inverse = np.linalg.inv(self.a)

    def rank(self, x: np.ndarray) -> list[int]:
        spread = np.sqrt(np.maximum(0, ((x @ self.inverse) * x).sum(axis=1)))
        return _descending(x @ (self.inverse @ self.b) + self.alpha * spread)

    def update(self, x: np.ndarray, reward: float) -> None:
        self.a += np.outer(x, x)
        self.b += reward * x
        ax = self.inverse @ x  # the inverse follows a change of rank one
        self.inverse -= np.outer(ax, ax) / (1 + x @ ax)


class LiveThompson(LiveLinUCB):
    """A linear bandit that ranks by weights drawn from their posterior at every query."""

    def __init__(self, bandit: LinearBandit, seed: int, noise: float = 1.0):
        super().__init__(bandit)
        self.noise, self.rng = noise, np.random.default_rng([seed, 7])

    def rank(self, x: np.ndarray) -> list[int]:
        root = _root(self.inverse * self.noise)
        return _descending(x @ (self.inverse @ self.b + root @ self.rng.standard_normal(len(self.b))))

    def update(self, x: np.ndarray, reward: float) -> None:
        super().update(x / np.sqrt(self.noise), reward / np.sqrt(self.noise))


def _descending(scores: np.ndarray) -> list[int]:
    return np.lexsort((np.arange(len(scores)), -scores)).tolist()


def _root(covariance: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky(covariance)
    except np.linalg.LinAlgError:
        least = np.linalg.eigvalsh(covariance)[0]
        return np.linalg.cholesky(covariance + (1e-9 - min(least, 0)) * np.eye(len(covariance)))


@dataclass
class Tree:
    """Nodes in arrays, the root first: the feature that a node asks for (-1: a leaf), and where documents go that have at
    most its threshold, or more; what a node predicts."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, model: DecisionTreeRegressionModel, columns: list[int] | None = None) -> Tree:
        """From a fitted model; ``columns``: the features that it was given, or None for all."""
        out, lines = cls(), iter(model.toDebugString.splitlines()[1:])

        def node() -> int:
            at = len(out.feature)
            for own, empty in ((out.feature, -1), (out.threshold, 0.0), (out.left, at), (out.right, at), (out.value, 0.0)):
                own.append(empty)
            line = next(lines).strip()
            if line.startswith("Predict: "):
                out.value[at] = float(line.removeprefix("Predict: "))
                return at
            feature, threshold = re.fullmatch(r"If \(feature (\d+) <= (.+)\)", line).groups()
            out.feature[at] = int(feature) if columns is None else columns[int(feature)]
            out.threshold[at] = float(threshold)
            out.left[at] = node()
            next(lines)  # Else
            out.right[at] = node()
            return at

        node()
        return out

    @classmethod
    def over(cls, grown: trees.Grown, thresholds: list[np.ndarray]) -> Tree:
        """From a tree over bins."""
        cut = [float(thresholds[f][b]) if f >= 0 else 0.0 for f, b in zip(grown.feature.tolist(), grown.bin.tolist(), strict=True)]
        return cls(grown.feature.tolist(), cut, grown.left.tolist(), grown.right.tolist(), grown.value.tolist())

    def depth(self, at: int = 0) -> int:
        return 0 if self.feature[at] < 0 else 1 + max(self.depth(self.left[at]), self.depth(self.right[at]))


_FOREST = "array<struct<feature:array<int>,threshold:array<double>,left:array<int>,right:array<int>,value:array<double>>>"


def _walked(x: str, steps: int) -> str:
    """The sum of what the trees of ``__forest`` predict for the features ``x``, an expression."""
    walk = f"if(t.feature[n] < 0, n, if({x}[t.feature[n]] <= t.threshold[n], t.left[n], t.right[n]))"
    leaf = f"aggregate(sequence(1, {steps}), 0, (n, i) -> {walk})" if steps else "0"
    return f"aggregate(__forest, 0D, (s, t) -> s + t.value[{leaf}])"


@dataclass
class BoostedRanker:
    """Trees fitted to pairwise gradients, summed with a rate; a tree may see some of the features only."""

    trees: list[Tree] = field(default_factory=list)
    rate: float = 0.1
    columns: list = field(default_factory=list)  # of each tree, the features it sees, or None for all

    def scored(self, docs: DataFrame) -> DataFrame:
        """Adds score; without trees it is 0 for all, which ranks documents as they are stored.

        Tasks walk the trees over whole batches of documents: the plan is the same for any number.
        """
        if not self.trees:
            return docs.withColumn("score", F.lit(0.0))
        ship(docs.sparkSession)
        kept = [F.col(f"`{c}`") for c in docs.columns if c != "score"]
        rows = docs.select(*kept, F.col("features").cast("array<double>").alias("__features"))
        forest = [(trees.Grown(*map(np.array, (t.feature, t.threshold, t.left, t.right, t.value))), t.depth()) for t in self.trees]
        schema = StructType([f for f in docs.schema if f.name != "score"]).add("score", "double")
        return rows.mapInArrow(trees.scores(forest, self.rate), schema)

    def _forest(self, spark: SparkSession) -> tuple[DataFrame, int]:
        rows = [([(t.feature, t.threshold, t.left, t.right, t.value) for t in self.trees],)]
        return spark.createDataFrame(rows, f"__forest {_FOREST}").coalesce(1), max(t.depth() for t in self.trees)

    def raised(self, groups: DataFrame) -> DataFrame:
        """Adds what the trees say to the score of each document in ``d``, the arrays of (doc, rel, features, score)."""
        forest, steps = self._forest(groups.sparkSession)
        score = f"p.score + {self.rate!r}D * {_walked('p.features', steps)}"
        raised = f"transform(d, p -> named_struct('doc', p.doc, 'rel', p.rel, 'features', p.features, 'score', {score}))"
        return groups.crossJoin(F.broadcast(forest)).select("query_id", F.expr(raised).alias("d"))


def boosted(docs: DataFrame, n_trees: int = 100, depth: int = 6, rate: float = 0.1, share: float = 1.0, seed: int = 42, rows: float = 1.0, columns: float = 1.0) -> BoostedRanker:
    """Pairwise logistic boosting: for every pair of a query with unequal relevance, the better document is pushed up.

    Queries are gathered to blocks of documents and features to bins once. Trees are grown by levels: tasks keep the scores and
    gradients of their blocks, and sums of gradients by node and bin are all that they send. share: of queries that
    train, by hash. rows, columns: shares of documents and of features that each tree is fitted on, drawn anew for every tree.
    """
    own = docs.where(F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(10_000)) < int(share * 10_000))
    own = own.select("query_id", F.col("rel").cast("double").alias("rel"), F.col("features").cast("array<double>").alias("features"), F.xxhash64("query_id", "doc", F.lit(seed)).alias("key"))
    # As many files as there are cores: each is read by a task of its own, however small it is.
    dealt = own.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, 1), "query_id").sortWithinPartitions("query_id")
    table = written(dealt.mapInArrow(trees.blocks, trees.BLOCK), "documents")
    model, rng, state = BoostedRanker(rate=rate), np.random.default_rng(seed), None
    try:
        read = table.rdd
        told = dict(read.flatMap(trees.values).reduceByKey(trees.merged).mapValues(trees.splits).collect())
        thresholds = [told[f] for f in range(len(told))]
        first, grown = read.map(trees.binned(thresholds)), []
        for k in range(n_trees if thresholds else 0):
            # Scores are those of the tree before and one more; at times they are made anew from all, which cuts lineage.
            before, again = state, k % KEPT_TREES == 0
            state = (first if again else before).map(trees.pushed(grown if again else grown[-1:], depth, rate)).persist(StorageLevel.MEMORY_AND_DISK)
            seen = None if columns >= 1 else sorted(rng.choice(len(thresholds), max(1, int(columns * len(thresholds))), replace=False).tolist())
            grown.append(_grown(state, depth, seen or list(range(len(thresholds))), rows, seed + 31 * k))
            if before is not None:
                before.unpersist()
            model.trees.append(Tree.over(grown[-1], thresholds))
            model.columns.append(seen)
    finally:
        if state is not None:
            state.unpersist()
        dropped(table)
    return model


def _grown(state: RDD, depth: int, features: list[int], rows: float, draw: int) -> trees.Grown:
    """A tree fitted to the gradients.

    Where features are few, a job brings sums by pairs of them, which tell a level's splits and the next one's. Else it is a
    job a level, of which the best split of each open node comes back.
    """
    tree, opened, level = trees.Grown(*([x] for x in (-1, 0, 0, 0, 0.0))), [0], 0
    pairs = list(combinations_with_replacement(features, 2))
    while opened and level < depth:
        slots = np.full(len(tree.feature), -1)
        slots[opened] = np.arange(len(opened))
        two = level + 1 < depth and len(pairs) * len(opened) * trees.BINS**2 * state.getNumPartitions() <= trees.PAIRED
        axes = pairs if two else [(f,) for f in features]
        sums = state.mapPartitions(trees.histograms(trees.Grown(*map(np.array, tree)), level, slots, axes, rows, draw))
        if two:
            total = sums.reduce(np.add)
            alone = {f: total[axes.index((f, f))].reshape(2, -1, trees.BINS, trees.BINS).sum(axis=3).reshape(2, -1) for f in features}
            found = reduce(trees.better, (trees.best(f, alone[f]) for f in features))
            opened = _split(tree, opened, found)
            if opened:
                opened = _split(tree, opened, reduce(trees.better, (trees.best(f, trees.of_children(total, axes, found, f)) for f in features)))
        else:
            summed = sums.flatMap(trees.by_axis(axes)).reduceByKey(np.add, min(len(axes), state.getNumPartitions()))
            opened = _split(tree, opened, summed.map(lambda x: trees.best(x[0][0], x[1])).reduce(trees.better))
        level += 1 + two
    return trees.Grown(*map(np.array, tree))


def _split(tree: trees.Grown, opened: list[int], found: np.ndarray) -> list[int]:
    """Gives open nodes their values, and children where a split gains; returns those."""
    out = []
    for node, (gain, feature, last, *sides) in zip(opened, found.tolist(), strict=True):
        tree.value[node] = (sides[0] + sides[2]) / max(1, sides[1] + sides[3])
        if gain <= 0:
            continue
        tree.feature[node], tree.bin[node], tree.left[node], tree.right[node] = int(feature), int(last), len(tree.feature), len(tree.feature) + 1
        for total, count in (sides[:2], sides[2:]):
            out.append(len(tree.feature))
            for own, value in zip(tree, (-1, 0, out[-1], out[-1], total / count), strict=True):
                own.append(value)
    return out


@dataclass
class Arms:
    """What training leaves: the projection of features and the bandits' first state, and boosted rankers by name."""

    projection: Projection | None = None
    bandit: LinearBandit | None = None
    boosted: dict[str, BoostedRanker] = field(default_factory=dict)

    def save(self, spark: SparkSession, folder: str) -> None:
        """As lines of JSON below ``folder``, which may be anywhere Spark writes: one for each ranker, and one for the rest."""
        told = {
            "projection": None if self.projection is None else {"mean": self.projection.mean.tolist(), "components": self.projection.components.tolist()},
            "bandit": None if self.bandit is None else {"a": self.bandit.a.tolist(), "b": self.bandit.b.tolist(), "regularization": self.bandit.regularization},
        }
        lines = [told] + [{"name": n, "trees": [asdict(t) for t in m.trees], "rate": m.rate, "columns": m.columns} for n, m in self.boosted.items()]
        spark.createDataFrame([(json.dumps(x),) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/arms")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Arms | None:
        """None where there are no arms or they can't be read."""
        try:
            lines = [json.loads(r["value"]) for r in spark.read.text(f"{folder}/arms").collect()]
            (told,) = (x for x in lines if "name" not in x)
            out = cls()
            if told["projection"]:
                out.projection = Projection(np.array(told["projection"]["mean"]), np.array(told["projection"]["components"]))
            if told["bandit"]:
                out.bandit = LinearBandit(len(told["bandit"]["b"]), told["bandit"]["regularization"])
                out.bandit.a, out.bandit.b = np.array(told["bandit"]["a"]), np.array(told["bandit"]["b"])
            out.boosted = {x["name"]: BoostedRanker([Tree(**t) for t in x["trees"]], x["rate"], x["columns"]) for x in lines if "name" in x}
            return out
        except (AnalysisException, TypeError, ValueError, KeyError):
            return None


def as_array(vector: str) -> Column:
    return vector_to_array(vector)
