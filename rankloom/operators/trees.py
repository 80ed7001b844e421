"""Regression trees on binned features: what a task does with its blocks of documents. The plan of a fit is in ``learners``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Values that a feature's splits tell apart, at most.
BINS = 32
#: Points that stand for a feature's values while its splits are found; all of them, if they are no more.
POINTS = 1 << 15
#: Documents and features of documents in a block, about; a query is never cut.
DOCUMENTS, CELLS = 1 << 15, 1 << 20
#: Pairs that are held at once.
PAIRS = 1 << 20
#: Cells of pairs of features that come from all tasks at once, at most.
PAIRED = 1 << 22
#: What gradients are multiples of, so that their sums are exact, however documents are dealt to tasks.
UNIT = 2.0**-24

BLOCK = "sizes binary, rel binary, key binary, features binary, width int"


class Block(NamedTuple):
    """Whole queries: their sizes, and of each document the relevance, hash, bins (a row a feature), score and gradient."""

    sizes: np.ndarray
    rel: np.ndarray
    key: np.ndarray
    bins: np.ndarray
    scores: np.ndarray
    grads: np.ndarray


class Grown(NamedTuple):
    """A tree over bins: a node's feature (-1: a leaf), the last bin that goes left, its children and what it predicts.
    One over features has thresholds in place of bins."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray, steps: int) -> np.ndarray:
        """The node that each document is in after so many steps."""
        at, each = np.zeros(bins.shape[1], np.int32), np.arange(bins.shape[1])
        for _ in range(steps):
            f = self.feature[at]
            low = bins[np.maximum(f, 0), each] <= self.bin[at]
            at = np.where(f < 0, at, np.where(low, self.left[at], self.right[at]))
        return at


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, rel, features, key) in the order of their queries, as blocks of whole queries."""
    held, n, limit = [], 0, 1
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        limit = max(limit, min(DOCUMENTS, CELLS // max(1, len(batch.column("features")[0] or ()))))
        if n < limit:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(rows)
        whole = int(starts[-1])
        if whole:
            yield _block(rows.slice(0, whole), np.diff(starts))
        held = rows.slice(whole).to_batches()
        n -= whole
        limit = 1 if whole else 2 * n
    if n:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield _block(rows, np.diff(np.append(_starts(rows), n)))


def _starts(rows: pa.Table) -> np.ndarray:
    codes = pa.concat_arrays(rows.column("query_id").chunks).dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])


def _block(rows: pa.Table, sizes: np.ndarray) -> pa.RecordBatch:
    features = _matrix(pa.concat_arrays(rows.column("features").chunks))
    told = [sizes.astype(np.int32), rows.column("rel").to_numpy(), rows.column("key").to_numpy(), np.ascontiguousarray(features.T)]
    return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in told), pa.array([features.shape[1]], pa.int32())], ["sizes", "rel", "key", "features", "width"])


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """A row a document; missing features are NaN."""
    widths = set(lists.value_lengths().unique().to_pylist())
    if len(widths) > 1 or None in widths:
        raise ValueError("features of unequal numbers")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), *widths)


def scores(forest: list[tuple[Grown, int]], rate: float) -> Callable:
    """Puts what trees (each with its depth) say of the features ``__features`` in their place. Documents without any go right."""
    width = 1 + max(int(tree.feature.max()) for tree, _ in forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("__features")
            known, features = lists.is_valid().to_numpy(zero_copy_only=False), np.full((max(1, width), len(lists)), np.nan)
            if known.any():
                features[:, known] = _matrix(lists.drop_null())[:, : len(features)].T
            total = np.zeros(len(lists))
            for tree, depth in forest:
                total = total + tree.value[tree.leaves(features, depth)]
            names = [n for n in batch.schema.names if n != "__features"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(rate * total)], [*names, "score"])

    return run


def values(row) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Of each feature of a block, its values in order and how many documents have them."""
    for f, x in enumerate(_features(row)):
        yield f, _fewer(*np.unique(x[~np.isnan(x)], return_counts=True))


def _features(row) -> np.ndarray:
    return np.frombuffer(row.features).reshape(row.width, -1)


def merged(a: tuple, b: tuple) -> tuple:
    found, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return _fewer(found, np.bincount(at, np.concatenate([a[1], b[1]]), len(found)))


def _fewer(found: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most POINTS of the values, each of which stands for as many documents as the next."""
    if len(found) <= POINTS:
        return found, counts
    upto = np.cumsum(counts)
    kept = np.unique(np.searchsorted(upto, np.linspace(0, upto[-1], POINTS + 1)[1:]))
    return found[kept], np.diff(upto[kept], prepend=0)


def splits(told: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Thresholds half-way between neighbours: between all of them, or those nearest to even shares of the documents."""
    found, counts = told
    between = found[:-1] / 2 + found[1:] / 2
    between = np.where(np.isfinite(between), between, found[:-1])
    if len(between) < BINS:
        return between
    upto = np.cumsum(counts)[:-1]
    wanted = np.arange(1, BINS) * (counts.sum() / BINS)
    after = np.clip(np.searchsorted(upto, wanted), 1, len(upto) - 1)
    return between[np.unique(np.where(wanted - upto[after - 1] <= upto[after] - wanted, after - 1, after))]


def binned(thresholds: list[np.ndarray]) -> Callable:
    def one(row) -> Block:
        bins = np.stack([np.searchsorted(t, x).astype(np.uint8) for t, x in zip(thresholds, _features(row), strict=True)])
        rel = np.frombuffer(row.rel)
        return Block(np.frombuffer(row.sizes, np.int32), rel, np.frombuffer(row.key, np.int64), bins, np.zeros(len(rel)), np.zeros(len(rel)))

    return one


def pushed(trees: list[Grown], depth: int, rate: float) -> Callable:
    """Raises scores by the trees, and has the gradients of what they are then."""

    def one(block: Block) -> Block:
        scores = block.scores
        for tree in trees:
            scores = scores + rate * tree.value[tree.leaves(block.bins, depth)]
        return block._replace(scores=scores, grads=pushes(block.sizes, block.rel, scores))

    return one


def pushes(sizes: np.ndarray, rel: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """What the pairs of a query with unequal relevance push each document up or down by. Queries of one size go together."""
    starts, out = np.cumsum(sizes) - sizes, np.zeros(len(rel))
    for n in np.unique(sizes).tolist():
        of, step = starts[sizes == n], max(1, PAIRS // (n * n))
        for at in range(0, len(of), step):
            docs = of[at : at + step, None] + np.arange(n)
            r, s, wide = rel[docs], scores[docs], max(1, PAIRS // (len(docs) * n))
            for a in range(0, n, wide):
                with np.errstate(over="ignore", invalid="ignore"):
                    better = np.nan_to_num(np.sign(r[:, a : a + wide, None] - r[:, None, :]))
                    out[docs[:, a : a + wide]] = (better / (1 + np.exp(better * (s[:, a : a + wide, None] - s[:, None, :])))).sum(axis=2)
    return np.round(out / UNIT) * UNIT


def histograms(tree: Grown, level: int, slots: np.ndarray, axes: list[tuple[int, ...]], share: float, draw: int) -> Callable:
    """Sums and counts of gradients by open node and bin, of each feature or pair of features in ``axes``. slots: a node's
    place among the open ones, or -1."""
    cells = (int(slots.max()) + 1) * BINS ** len(axes[0])

    def run(part: Iterator[Block]) -> Iterator[np.ndarray]:
        total = np.zeros((len(axes), 2, cells))
        for block in part:
            at = slots[tree.leaves(block.bins, level)]
            taken = at >= 0
            if share < 1:
                taken &= drawn(block.key, draw) < int(share * 10_000)
            at, grads, bins = at[taken], block.grads[taken], block.bins[:, taken]
            for own, axis in zip(total, axes, strict=True):
                cell = at
                for f in axis:
                    cell = cell * BINS + bins[f]
                own[0] += np.bincount(cell, grads, cells)
                own[1] += np.bincount(cell, minlength=cells)
        yield total

    return run


def by_axis(axes: list[tuple[int, ...]]) -> Callable:
    return lambda total: zip(axes, total, strict=True)


def of_children(total: np.ndarray, axes: list[tuple[int, int]], found: np.ndarray, feature: int) -> np.ndarray:
    """Sums and counts by bins of a feature in the children of split nodes, out of those of pairs of features."""
    both = []
    for node, (gain, own, last) in enumerate(found[:, :3].tolist()):
        if gain > 0:
            pair = tuple(sorted((int(own), feature)))
            by = total[axes.index(pair)].reshape(2, -1, BINS, BINS)[:, node]
            by = by if pair[0] == own else by.swapaxes(1, 2)
            both += [by[:, : int(last) + 1].sum(axis=1), by[:, int(last) + 1 :].sum(axis=1)]
    return np.stack(both, axis=1).reshape(2, -1)


def drawn(key: np.ndarray, draw: int) -> np.ndarray:
    """A number below 10,000 from each hash, another one for each draw."""
    x = key.view(np.uint64) + np.uint64((draw * 0x9E3779B97F4A7C15) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) % np.uint64(10_000)


def best(feature: int, total: np.ndarray) -> np.ndarray:
    """Of each open node a row (gain, feature, bin, sum and count to the left, and to the right) of the feature's best split."""
    sums, counts = total.reshape(2, -1, BINS)
    ls, ln = np.cumsum(sums, axis=1)[:, :-1], np.cumsum(counts, axis=1)[:, :-1]
    s, n = sums.sum(axis=1)[:, None], counts.sum(axis=1)[:, None]
    rs, rn = s - ls, n - ln
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = s * s / n
        gain = ls * ls / ln + rs * rs / rn - whole
        gain = np.where((ln > 0) & (rn > 0) & (gain > 1e-12 * whole), gain, 0)
    at = gain.argmax(axis=1)
    each = np.arange(len(at))
    return np.stack([gain[each, at], np.full(len(at), feature), at, ls[each, at], ln[each, at], rs[each, at], rn[each, at]], axis=1)


def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The higher gain of each node; of equal ones that of the smaller feature."""
    first = (a[:, 0] > b[:, 0]) | ((a[:, 0] == b[:, 0]) & (a[:, 1] <= b[:, 1]))
    return np.where(first[:, None], a, b)
