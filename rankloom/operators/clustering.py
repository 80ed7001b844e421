"""Clusters of arms whose rankings agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.gains import dcg
from ..functions.rng import uniform
from ..shipping import ship


def top_overlap(rankings: DataFrame, arms: DataFrame, k: int = 10) -> DataFrame:
    """(a, b, s), a before b: mean Jaccard of the two arms' top documents over all queries.

    k is the same for all queries: at most that of the smallest query. For each document of a query there is a bitmap of the
    arms that have it on top; a task counts where two bits stand together, query by query, and adds the similarities up in one
    vector over pairs of arms. What is shuffled before is a bitmap a document, after it a vector a task. A pair of arms that no
    query ranks both ways has no row.
    """
    sizes = rankings.groupBy("query_id", "arm").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if sizes is None:
        return arms.sparkSession.createDataFrame([], "a string, b string, s double")
    ship(arms.sparkSession)
    k = min(k, int(sizes))
    names = sorted(r.arm for r in arms.select("arm").distinct().collect())  # a pool: some hundred arms
    number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("arm")) - 1
    top = rankings.where((F.col("pos") <= k) & F.col("arm").isin(names)).select("query_id", "doc", number.alias("at"))
    # 64 arms a word: words of a document's bitmap are rows of their own.
    words = top.groupBy("query_id", "doc", F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    queries = words.groupBy("query_id").agg(F.collect_list(F.struct("doc", "word", "bits")).alias("d"))
    n, wide = len(names), -(-len(names) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((n, n)), np.zeros((n, n))
        for batch in batches:
            for d in batch.column("d"):
                rows = d.values
                _, row = np.unique(rows.field("doc").to_numpy(), return_inverse=True)
                bits = np.zeros((row.max() + 1, wide), "<u8")
                bits[row, rows.field("word").to_numpy()] = rows.field("bits").to_numpy().view("u8")
                has = np.unpackbits(bits.view("u1").reshape(len(bits), -1), axis=1, bitorder="little")[:, :n].astype("f8")
                common = has.T @ has
                ranks = np.diag(common) > 0
                total += common / (2 * k - common)
                seen += np.outer(ranks, ranks)
        a, b = np.nonzero(np.triu(seen, 1))
        columns = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b]), pa.array(seen[a, b])]
        yield pa.RecordBatch.from_arrays(columns, names=["x", "y", "total", "seen"])

    sums = queries.select("d").mapInArrow(run, "x int, y int, total double, seen double").groupBy("x", "y").agg((F.sum("total") / F.sum("seen")).alias("s"))
    name = lambda c: F.element_at(F.array(*[F.lit(n) for n in names]), F.col(c) + 1)
    return sums.select(name("x").alias("a"), name("y").alias("b"), "s")


def matrix(similarities: DataFrame, names: list[str]) -> np.ndarray:
    """The dense matrix of at most a few hundred arms, with ones on the diagonal."""
    at = {n: i for i, n in enumerate(names)}
    out = np.eye(len(names))
    for r in similarities.collect():
        out[at[r.a], at[r.b]] = out[at[r.b], at[r.a]] = r.s
    return out


def density_labels(distance: np.ndarray, min_size: int) -> np.ndarray:
    """Labels of hierarchical density clustering of a small distance matrix; -1 is noise.

    Mutual reachability from core distances, its minimum spanning tree, the tree condensed to clusters of at least
    ``min_size`` members, and of those the ones of greatest excess of mass; the root itself is no cluster.
    """
    n = len(distance)
    if n == 0:
        return np.empty(0, int)
    core = np.sort(distance, axis=1)[:, min(min_size, n) - 1]
    reach = np.maximum(distance, np.maximum(core[:, None], core[None, :]))
    # Prim's tree.
    inside, best, source, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        closer = ~inside & (reach[at] < best)
        best[closer], source[closer] = reach[at][closer], at
        at = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((best[at], int(source[at]), at))
    # Single linkage: node n + k joins two earlier ones.
    node, members, merges = list(range(n)), {i: [i] for i in range(n)}, {}
    find = lambda i: i if node[i] == i else find(node[i])
    for k, (d, a, b) in enumerate(sorted(edges, key=lambda e: e[0])):
        a, b = find(a), find(b)
        node.append(n + k)
        node[a] = node[b] = n + k
        members[n + k] = members[a] + members[b]
        merges[n + k] = (a, b, d)
    if not merges:
        return np.full(n, -1)
    # Condense: a split into two large parts makes two clusters, else the large part goes on as the same cluster.
    birth, mass, children, held = {0: 0.0}, {0: 0.0}, {0: []}, {0: members[2 * n - 2]}
    stack = [(2 * n - 2, 0)]
    while stack:
        top, cluster = stack.pop()
        if top < n:
            continue
        a, b, d = merges[top]
        level = 1 / d if d > 0 else np.inf
        level = min(level, 1e12)
        large = [x for x in (a, b) if len(members[x]) >= min_size]
        if len(large) == 2:
            mass[cluster] += (level - birth[cluster]) * len(members[top])
            for x in (a, b):
                new = len(birth)
                birth[new], mass[new], children[new], held[new] = level, 0.0, [], members[x]
                children[cluster].append(new)
                stack.append((x, new))
        else:
            leaving = sum(len(members[x]) for x in (a, b) if x not in large)
            mass[cluster] += (level - birth[cluster]) * leaving
            for x in large:
                stack.append((x, cluster))
    chosen, worth = {}, {}
    for c in sorted(birth, reverse=True):
        below = sum(worth[x] for x in children[c])
        chosen[c] = c != 0 and (not children[c] or mass[c] >= below)
        worth[c] = mass[c] if chosen[c] else below
    labels, number, walk = np.full(n, -1), 0, [0]
    while walk:
        c = walk.pop(0)
        if chosen[c]:
            labels[held[c]] = number
            number += 1
        else:
            walk.extend(children[c])
    return labels


def clustered(similarity: np.ndarray, names: list[str], min_size: int = 5) -> list[tuple[int, str, int]]:
    """(cluster, arm, ord in its cluster): noise, or every arm where there are too few, becomes a cluster of its own."""
    labels = density_labels(1 - similarity, min_size) if len(names) >= min_size else np.full(len(names), -1)
    labels, fresh = labels.copy(), int(labels.max(initial=-1)) + 1
    for i in np.flatnonzero(labels < 0):
        labels[i], fresh = fresh, fresh + 1
    seen: dict[int, int] = {}
    out = []
    for name, label in zip(names, labels.tolist(), strict=True):
        out.append((label, name, seen.get(label, 0)))
        seen[label] = seen.get(label, 0) + 1
    return out


def noise_as_singletons(labels: DataFrame) -> DataFrame:
    """(arm, label) with noise (-1) renumbered after the last label, in the order of ``ord``; one row an arm."""
    order = Window.partitionBy((F.col("label") < 0)).orderBy("ord")
    top = F.max("label").over(Window.partitionBy(F.lit(0)))
    return labels.select("arm", F.when(F.col("label") < 0, top + F.row_number().over(order)).otherwise(F.col("label")).cast("int").alias("label"))


def shuffled_clusters(arms: DataFrame, n_clusters: int, seed: int = 42) -> DataFrame:
    """(cluster, arm, member, is_rep): a random order dealt round; the first of a cluster represents it. One row an arm."""
    place = F.row_number().over(Window.orderBy(uniform(seed, "rc", "arm"), "arm")) - 1
    rows = arms.withColumn("__p", place)
    return rows.select((F.col("__p") % n_clusters).cast("int").alias("cluster"), "arm", F.floor(F.col("__p") / n_clusters).cast("int").alias("member"), (F.col("__p") < n_clusters).alias("is_rep"))


def offline_scores(rankings: DataFrame, k: int = 5) -> DataFrame:
    """(arm, score): mean ratio of the ranking's gain to that of the first k documents as stored, 1 where that is 0.

    The stored order isn't sorted by relevance, so scores may exceed 1.
    """
    per = rankings.groupBy("query_id", "arm").agg(dcg("rel", "pos", k).alias("g"), dcg("rel", F.col("doc") + 1, k).alias("i"))
    return per.groupBy("arm").agg(F.avg(F.when(F.col("i") == 0, 1.0).otherwise(F.col("g") / F.when(F.col("i") != 0, F.col("i")))).alias("score"))


def representatives(clusters: DataFrame, scores: DataFrame) -> DataFrame:
    """(cluster, arm, score): the best member of each cluster; ties to the first member. clusters: (cluster, arm, member)."""
    best = Window.partitionBy("cluster").orderBy(F.desc("score"), "member")
    return clusters.join(scores, "arm").withColumn("__r", F.row_number().over(best)).where("__r = 1").select("cluster", "arm", "score")


def fitted(spark: SparkSession, rankings: DataFrame, arms: DataFrame, min_size: int = 5, k: int = 10) -> DataFrame:
    """(cluster, arm, member, is_rep) of arms clustered by the agreement of their rankings."""
    names = [r.arm for r in arms.orderBy("ord").collect()]
    if not names:
        return spark.createDataFrame([], "cluster int, arm string, member int, is_rep boolean")
    rows = clustered(matrix(top_overlap(rankings, arms, k), names), names, min_size)
    clusters = spark.createDataFrame(rows, "cluster int, arm string, member int")
    reps = representatives(clusters, offline_scores(rankings)).select("cluster", F.col("arm").alias("rep"))
    return clusters.join(reps, "cluster").select("cluster", "arm", "member", (F.col("arm") == F.col("rep")).alias("is_rep"))
