"""Discounted gains of rankings. The gain is linear, and a group without relevant documents counts as perfectly ranked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dcg(relevance: str | Column, position: str | Column, k: int = 10) -> Column:
    """Aggregate: sum of rel / log2(pos + 1) over 1-based positions up to ``k``."""
    rel, pos = (x if isinstance(x, Column) else F.col(x) for x in (relevance, position))
    return F.coalesce(F.sum(F.when(pos <= k, rel.cast("double") / F.log2(pos.cast("double") + 1))), F.lit(0.0))


def ratio(gained: Column, ideal: Column) -> Column:
    """NDCG from both sums; 1 where nothing could be gained."""
    return F.when(ideal == 0, F.lit(1.0)).otherwise(gained / F.when(ideal == 0, F.lit(1.0)).otherwise(ideal))


def array_dcg(relevance: str, k: int = 10) -> Column:
    """DCG of an array of relevances in ranked order."""
    return F.expr(f"aggregate(transform(slice({relevance}, 1, {k}), (r, i) -> cast(r as double) / log2(cast(i as double) + 2D)), 0D, (a, x) -> a + x)")
