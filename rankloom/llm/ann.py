"""Approximate nearest neighbours by collision counting, with query-centred windows.

Vectors are projected on LINES lines (random orthonormal bases, as many as it takes) and the projections of each line are
kept as a sorted array. A query looks at windows of these arrays centred on its own projections. Widening the windows step
by step (virtual rehashing) needs no second index. A vector in a line's window collides once; one that collides on at
least ``threshold`` lines is verified by its true distance. A query ends when its windows reach REACH times the distance
of the k-th vector found: ``threshold`` is set so that a vector at that very distance then passes it but for a share of
MISS of all directions, and nearer ones pass more often.

The index is cut into blocks of bounded size. Vectors are dealt to cells by their nearest pivot, of at most CELLS, and
cells to blocks; the driver only knows each cell's size and, for each line, its least and largest projection. A query is
searched twice:

1. in one block of its own cell, where windows start narrow; this bounds the distance of its k-th neighbour;
2. in every other block of the cells that its windows at that bound meet on at least ``threshold`` lines, starting from
   the bound. Cells that are left out hold no vector that could collide often enough.

Queries travel to blocks by joins, in chunks of at most CHUNK; nothing of their number reaches the driver. Equal vectors
are one node of the index, known by its k + 1 smallest ids, so that a vector that very many rows hold costs no more than
any other. Pivots are fitted on at most SAMPLE vectors; all vectors are indexed.

Cost: in a block that a query visits, a vector is counted once for each line whose last window holds it, as the windows grow.
For clustered vectors these are few blocks and small windows; for vectors without any structure (random directions) a query
visits all blocks, and counting there costs about as much as all distances.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do those whose
length isn't the query's; a query isn't compared with rows of its own id; ties go to the smaller id; with fewer than k
candidates all are returned; repeated rows of an id are candidates each; repeated rows of a query (equal id and vector)
are one query; no queries give no rows.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keeps, lean, prepared, table, written

LINES = 128
#: Half width of the last windows, in units of the distance to be found; share of directions that then fail the threshold.
REACH, MISS = 1.25, 0.05
#: Half width of the first windows in units of the projections' spread, and the factor of each widening.
FIRST_WIDTH, WIDEN = 0.03, 1.25
#: Where a bound is known, windows start at this share of what it asks for.
START = 0.8
#: Vectors and bytes (of doubles) of a block, queries of a chunk.
BLOCK_ROWS, BLOCK_BYTES, CHUNK = 16_384, 16 << 20, 2048
#: Pivots at most, vectors that a cell should hold, vectors that pivots are fitted on, and rounds of fitting.
CELLS, CELL_ROWS, SAMPLE, ROUNDS = 1024, 16_384, 8192, 6
SEED = 20_240_611
#: The cell of vectors whose length the sample doesn't hold.
OTHER = -1

FOUND_DDL = "q long, query_id long, vec_id long, score double, verified long"


@functools.cache
def lines(dimension: int) -> np.ndarray:
    """One column a line: bases of the space one after another, scaled so that a projection spreads as a distance does."""
    rng, parts, width = np.random.default_rng([SEED, dimension]), [], 0
    while width < LINES:
        basis = np.linalg.qr(rng.standard_normal((dimension, min(dimension, LINES))))[0]
        parts.append(basis)
        width += basis.shape[1]
    return np.concatenate(parts, axis=1)[:, :LINES] * np.sqrt(dimension)


@functools.cache
def threshold(dimension: int) -> int:
    """Collisions that a vector at distance 1 has within windows of REACH, but for a share of MISS of all directions."""
    way = np.random.default_rng([SEED, dimension, 1]).standard_normal((2000, dimension))
    way /= np.linalg.norm(way, axis=1)[:, None]
    return max(1, int(np.quantile((np.abs(way @ lines(dimension)) <= REACH).sum(axis=1), MISS, method="lower")))


def _forget() -> None:
    lines.cache_clear()
    threshold.cache_clear()


keeps(__name__, _forget)


class Block:
    """Sorted projections of some vectors of one length."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, (n, dimension) = vectors, vectors.shape
        self.threshold, projected = threshold(dimension), vectors @ lines(dimension)
        self.spread = float(np.sqrt(np.mean(np.var(projected, axis=0)))) or 1.0
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)

    def entered(self, low: np.ndarray, high: np.ndarray, before_low: np.ndarray, before_high: np.ndarray) -> np.ndarray:
        """How many of the lines' windows [low, high) of the sorted arrays each vector enters, as these grow from those before."""
        rings = [self.order[j, a:b] for j, (a, b) in enumerate(zip(low.tolist(), before_low.tolist(), strict=True)) if b > a]
        rings += [self.order[j, a:b] for j, (a, b) in enumerate(zip(before_high.tolist(), high.tolist(), strict=True)) if b > a]
        return np.bincount(np.concatenate(rings), minlength=len(self.vectors)) if rings else np.zeros(len(self.vectors), np.int64)

    def search(self, queries: np.ndarray, skipped: list[np.ndarray], bounds: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query the places and distances of the k nearest found, nearest first, and how many were verified.

        skipped: places that don't count for a query; bounds: distances beyond which nothing is asked for, or infinity.
        """
        n, number = len(self.vectors), len(queries)
        at = queries @ lines(self.vectors.shape[1])
        found = [(np.empty(0, np.int64), np.empty(0))] * number
        checked, verified = np.zeros((number, n), bool), np.zeros(number, np.int64)
        for i, own in enumerate(skipped):
            checked[i, own] = True
        width = np.where(np.isfinite(bounds), START * REACH * bounds, FIRST_WIDTH * self.spread)
        goal, open_ = REACH * bounds, np.arange(number)
        # Windows only grow, so a vector's collisions are counted once a line, as it enters.
        counts = np.zeros((number, n), np.uint8)
        low = np.stack([np.searchsorted(self.sorted[j], at[:, j]) for j in range(LINES)], axis=1)
        high = low.copy()
        while len(open_):
            before_low, before_high = low.copy(), high.copy()
            for j in range(LINES):
                low[open_, j] = np.searchsorted(self.sorted[j], at[open_, j] - width[open_], "left")
                high[open_, j] = np.searchsorted(self.sorted[j], at[open_, j] + width[open_], "right")
            ended = np.zeros(len(open_), bool)
            for o, i in enumerate(open_.tolist()):
                counts[i] += self.entered(low[i], high[i], before_low[i], before_high[i]).astype(np.uint8)
                new = np.flatnonzero((counts[i] >= self.threshold) & ~checked[i])
                if len(new):
                    checked[i, new] = True
                    verified[i] += len(new)
                    apart = self.vectors[new] - queries[i]
                    place, distance = np.concatenate([found[i][0], new]), np.concatenate([found[i][1], np.sqrt(np.einsum("ij,ij->i", apart, apart))])
                    if len(place) > k:  # ties beyond the k-th stay: ids decide among them
                        near = distance <= np.partition(distance, k - 1)[k - 1]
                        place, distance = place[near], distance[near]
                        goal[i] = min(goal[i], REACH * float(distance.max()))
                    elif len(place) == k:
                        goal[i] = min(goal[i], REACH * float(distance.max()))
                    found[i] = place, distance
                ended[o] = width[i] >= goal[i] or bool((high[i] - low[i] == n).all())
            width[open_] = np.minimum(WIDEN * width[open_], np.maximum(goal[open_], 0))
            open_ = open_[~ended]
        return [(p, d, int(v)) for (p, d), v in zip(found, verified, strict=True)]


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id long, v array of the vector's own type) of the rows that take part."""
    v = F.col(vector)
    if dict(vectors.dtypes)[vector] not in ("array<float>", "array<double>"):
        v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0)
    )


def _nodes(base: DataFrame, k: int) -> DataFrame:
    """(v, ids array<struct<id, n>>, node): distinct vectors with their k + 1 smallest ids, how many rows hold each, and a hash.

    Only vectors whose hash occurs again are compared and shuffled; of equal ones each task keeps as many ids as needed.
    """
    hashed = base.withColumn("h", F.xxhash64("v"))
    again = written(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "again")
    one = lambda n: F.array(F.struct(F.col("id"), n.alias("n"))).alias("ids")
    alone = hashed.join(again, "h", "left_anti").select("v", one(F.lit(1).cast("long")))
    rows = hashed.join(again, "h", "left_semi").groupBy("v", "id").agg(F.count(F.lit(1)).alias("n"))
    least = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    many = least.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("ids"))
    return written(alone.unionByName(many), "vectors").withColumn("node", F.xxhash64("v"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors of these rows) for each length that the lists have."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values, starts = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        out.append((int(n), rows, values[(starts[rows][:, None] + np.arange(n))]))
    return out


def _pivots(sample: np.ndarray, number: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    pivots = sample[rng.choice(len(sample), min(number, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(sample, pivots)
        sums, counts = np.zeros_like(pivots), np.bincount(own, minlength=len(pivots))
        np.add.at(sums, own, sample)
        pivots = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], pivots)
    return pivots


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.argmin((pivots * pivots).sum(axis=1) - 2 * (vectors @ pivots.T), axis=1)


@dataclass
class Cells:
    """What the driver knows of the index: pivots by length, and of each (length, cell) its size and reach on all lines."""

    pivots: dict[int, np.ndarray]
    rows: dict[tuple[int, int], int]
    parts: dict[tuple[int, int], int]
    low: dict[tuple[int, int], np.ndarray]
    high: dict[tuple[int, int], np.ndarray]

    def of(self, length: int, vectors: np.ndarray, least: int = 0) -> np.ndarray:
        """The cell of each vector: of the nearest pivot, among cells with at least so many vectors."""
        pivots = self.pivots.get(length)
        if pivots is None:
            return np.full(len(vectors), OTHER)
        large = np.array([c for c in range(len(pivots)) if self.rows.get((length, c), 0) >= least] if least else range(len(pivots)), np.int64)
        if not len(large):
            large = np.arange(len(pivots))
        return large[_nearest(vectors, pivots[large])]

    def met(self, length: int, vector: np.ndarray, bound: float) -> list[tuple[int, int]]:
        """The cells in which windows at the bound could hold a vector often enough."""
        if length not in self.pivots:
            return [c for c in self.rows if c == (0, OTHER)]
        at, width = vector @ lines(length), REACH * bound * (1 + 1e-9)
        return [c for c in self.rows if c[0] == length and int(((at + width >= self.low[c]) & (at - width <= self.high[c])).sum()) >= threshold(length)]


def _key(length: int, cell: int) -> tuple[int, int]:
    return (0, OTHER) if cell == OTHER else (length, cell)


def _cells(nodes: DataFrame) -> Cells:
    n = nodes.count()
    drawn = nodes.select("v").orderBy(F.xxhash64("v", F.lit(SEED))).limit(SAMPLE).toArrow().column("v")
    pivots = {length: _pivots(vectors, max(1, min(CELLS, -(-n * len(rows) // (max(1, len(drawn)) * CELL_ROWS)), len(rows) // 8))) for length, rows, vectors in (_matrix(drawn) if len(drawn) else [])}
    cells = Cells(pivots, {}, {}, {}, {})

    def reach(batches):
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for length, _, vectors in _matrix(batch.column("v")):
                own, at = cells.of(length, vectors), None if length not in pivots else vectors @ lines(length)
                for c in np.unique(own).tolist():
                    inside = own == c
                    low, high = (np.full(LINES, -np.inf), np.full(LINES, np.inf)) if at is None else (at[inside].min(axis=0), at[inside].max(axis=0))
                    old = found.setdefault(_key(length, c), [0, 0, low, high])
                    found[_key(length, c)] = [old[0] + int(inside.sum()), old[1] + int(inside.sum()) * length, np.minimum(old[2], low), np.maximum(old[3], high)]
        if found:
            rows = [(a, b, *x[:2], x[2].tolist(), x[3].tolist()) for (a, b), x in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["length", "cell", "n", "size", "low", "high"])

    part = nodes.select("v").mapInArrow(lean(reach), "length long, cell long, n long, size long, low array<double>, high array<double>")
    ends = lambda f, name: F.array(*[f(F.col(name)[j]) for j in range(LINES)]).alias(name)
    for r in part.groupBy("length", "cell").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), ends(F.min, "low"), ends(F.max, "high")).collect():
        own = r.length, r.cell
        cells.rows[own], cells.low[own], cells.high[own] = r.n, np.array(r.low), np.array(r.high)
        cells.parts[own] = max(1, -(-r.n // BLOCK_ROWS), -(-8 * r.size // BLOCK_BYTES))
    return cells


def _dealt(nodes: DataFrame, cells: Cells, chunks: dict[tuple[int, int], int], first_only: bool) -> DataFrame:
    """Nodes with the (length, cell, part, chunk) of their block, once for each chunk of queries that comes to the cell."""

    def run(batches):
        for batch in batches:
            for length, rows, vectors in _matrix(batch.column("v")):
                own = cells.of(length, vectors)
                number = np.array([cells.parts.get(_key(length, c), 1) for c in own.tolist()])
                part = (batch.column("node").to_numpy()[rows] >> 16) % number  # not negative, as the divisor isn't
                times = np.array([chunks.get(_key(length, c), 0) for c in own.tolist()])
                if first_only:
                    times[part != 0] = 0
                keep = np.repeat(np.arange(len(rows)), times)
                if len(keep):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.where(own[keep] == OTHER, 0, length)), pa.array(own[keep]), pa.array(part[keep]), pa.array(np.arange(len(keep)) - np.repeat(np.cumsum(times) - times, times)), *(batch.column(c).take(pa.array(rows[keep])) for c in ("v", "ids"))],
                        names=["length", "cell", "part", "chunk", "v", "ids"],
                    )

    v = dict(nodes.dtypes)["v"]
    return nodes.mapInArrow(lean(run), f"length long, cell long, part long, chunk long, v {v}, ids array<struct<id:bigint,n:bigint>>")


def _searched(nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """FOUND_DDL: the k best rows of each block for the queries that come to it, and for each of both a row without vec_id
    that says how many vectors were verified."""

    def run(_, own: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if own.num_rows and queries.num_rows:
            blocks = {length: (rows, Block(vectors)) for length, rows, vectors in _matrix(own.column("v"))}
            every = own.column("ids").combine_chunks()
            starts = every.offsets.to_numpy()
            ids, n = (every.flatten().field(c).to_numpy() for c in ("id", "n"))
            single = np.where(np.diff(starts) == 1, ids[starts[:-1] - starts[0]], -1)
            single_known = np.diff(starts) == 1
            starts = starts - starts[0]
            for length, rows, vectors in _matrix(queries.column("v")):
                if length not in blocks:
                    continue
                places, block = blocks[length]
                name, key, bound = (queries.column(c).to_numpy()[rows] for c in ("query_id", "q", "bound"))
                skipped = [np.flatnonzero(single_known[places] & (single[places] == i)) for i in name.tolist()]
                for i, q, (place, apart, verified) in zip(name.tolist(), key.tolist(), block.search(vectors, skipped, bound, k), strict=True):
                    near = []
                    for p, d in zip(places[place].tolist(), apart.tolist(), strict=True):
                        near += [(d, int(ids[x])) for x in range(starts[p], starts[p + 1]) if ids[x] != i for _ in range(min(int(n[x]), k))]
                    best = sorted(near)[:k]
                    for c, values in zip(out, ([q] * (len(best) + 1), [i] * (len(best) + 1), [*(v for _, v in best), None], [*(d for d, _ in best), None], [*[0] * len(best), verified]), strict=True):
                        c += values
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names=[f.split(" ")[0] for f in FOUND_DDL.split(", ")])

    block = ["length", "cell", "part", "chunk"]
    return nodes.groupBy(*block).cogroup(asked.groupBy(*block)).applyInArrow(run, FOUND_DDL)


def _chunks(asked: DataFrame) -> dict[tuple[int, int], int]:
    """Of each cell, the chunks that its queries are cut into: at most as many rows as there are cells."""
    return {(r.length, r.cell): r.n for r in asked.groupBy("length", "cell").agg((F.max("chunk") + 1).alias("n")).collect()}


def _numbered(asked: DataFrame) -> Column:
    """Chunk of a query among those of its cell; cells' totals are counted first, so no task sees a cell's queries."""
    return F.pmod(F.xxhash64("q", F.lit(SEED)), F.ceil(F.col("total") / CHUNK))


def _with_chunks(asked: DataFrame) -> DataFrame:
    totals = asked.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("total"))
    return asked.join(F.broadcast(totals), ["length", "cell"]).withColumn("chunk", _numbered(asked)).drop("total")


def nearest(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): both frames are (id, v) as ``usable`` gives them. ``verified``: how many
    vectors' true distances were taken for the query."""
    spark = base.sparkSession
    prepared(spark)
    nodes = _nodes(base, k)
    cells = _cells(nodes)
    own = written(queries.select("id", "v").distinct(), "queries").select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "v")
    v = dict(own.dtypes)["v"]
    block = "length long, cell long, part long, q long, query_id long, bound double, v " + v

    def home(batches):
        for batch in batches:
            for length, rows, vectors in _matrix(batch.column("v")):
                cell, take = cells.of(length, vectors, 4 * k), pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.where(cell == OTHER, 0, length)), pa.array(cell), pa.array(np.zeros(len(rows), np.int64)), batch.column("q").take(take), batch.column("query_id").take(take), pa.array(np.full(len(rows), np.inf)), batch.column("v").take(take)],
                    names=[f.split(" ")[0] for f in block.split(", ")],
                )

    asked = written(_with_chunks(own.mapInArrow(lean(home), block)), "asked")
    first = written(_searched(_dealt(nodes, cells, _chunks(asked), True), asked, k), "first")
    # The k-th distance of a query so far, where there are k.
    kth = first.where("vec_id is not null").groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("d")).where(F.col("n") >= k).select("q", "d")
    bounded = asked.drop("chunk", "bound").join(kth, "q", "left").withColumn("bound", F.coalesce("d", F.lit(float("inf")))).drop("d")

    def route(batches):
        for batch in batches:
            q, name, bound, home_cell = (batch.column(c).to_numpy() for c in ("q", "query_id", "bound", "cell"))
            out, take = [], []
            for length, rows, vectors in _matrix(batch.column("v")):
                for r, vector in zip(rows.tolist(), vectors, strict=True):
                    for c in cells.met(length, vector, float(bound[r])):
                        for part in range(cells.parts[c]):
                            if part or c != _key(length, int(home_cell[r])):
                                out.append((*c, part, int(q[r]), int(name[r]), float(bound[r])))
                                take.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in zip(*out, strict=True)), batch.column("v").take(pa.array(take))], names=[f.split(" ")[0] for f in block.split(", ")])

    columns = [f.split(" ")[0] for f in block.split(", ")]
    asked = written(_with_chunks(bounded.select(*columns).mapInArrow(lean(route), block)), "asked")
    found = first.unionByName(_searched(_dealt(nodes, cells, _chunks(asked), False), asked, k))
    by_query = Window.partitionBy("q")
    ranked = found.withColumn("verified", F.sum("verified").over(by_query)).withColumn("rank", F.row_number().over(by_query.orderBy(F.asc_nulls_last("score"), "vec_id")))
    return ranked.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "verified")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(base, base.where("id % 100 = 0"))
