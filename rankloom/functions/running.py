"""Running totals over one global order without a window over all rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, order: str, sums: dict[str, str], partition: tuple[str, ...] = (), size: int = 10_000) -> DataFrame:
    """Adds running sums of columns up to and with each row and those that share its number, in the order of a whole number.

    Rows are summed inside blocks of ``size`` numbers, and blocks are offset by the totals of those before, of which
    there is one row each.
    """
    blocked = rows.withColumn("__block", F.floor(F.col(order) / size))
    totals = blocked.groupBy(*partition, "__block").agg(*[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()])
    earlier = Window.partitionBy(*partition).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*partition, "__block", *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in sums])
    inner = Window.partitionBy(*partition, "__block").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    joined = blocked.join(offsets, [*partition, "__block"])
    return joined.select(*rows.columns, *[(F.sum(v).over(inner) + F.col(f"__o_{k}")).alias(k) for k, v in sums.items()])


def _filled(rows: DataFrame, keys: DataFrame, order: str, last: int, columns: dict[str, str], size: int) -> DataFrame:
    """keys x blocks, each block's first number with zeros, and the rows themselves: (keys, __block, order, columns)."""
    by = keys.columns
    blocks = rows.sparkSession.range(0, last // size + 1).select(F.col("id").alias("__block"))
    starts = keys.crossJoin(F.broadcast(blocks) if last // size < 10_000 else blocks)
    starts = starts.select(*by, "__block", (F.col("__block") * size).alias(order), *[F.lit(0.0).alias(k) for k in columns])
    own = rows.where((F.col(order) >= 0) & (F.col(order) <= last)).select(*by, F.floor(F.col(order) / size).alias("__block"), F.col(order).cast("long").alias(order), *[F.expr(v).cast("double").alias(k) for k, v in columns.items()])
    return starts.unionByName(own).groupBy(*by, "__block", order).agg(*[F.sum(k).alias(k) for k in columns])


def sum_intervals(rows: DataFrame, keys: DataFrame, order: str, last: int, sums: dict[str, str], size: int = 10_000) -> DataFrame:
    """Running sums as intervals on which they don't change: (keys, since, until, sums), ``until`` included.

    ``keys``: every combination that gets intervals, also those without rows; numbers go from 0 to ``last``. Intervals
    are cut where a block of ``size`` numbers ends, so that each is found inside its block, and blocks are offset by the
    totals of those before.
    """
    by = keys.columns
    filled = _filled(rows, keys, order, last, sums, size)
    totals = filled.groupBy(*by, "__block").agg(*[F.sum(k).alias(f"__t_{k}") for k in sums])
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "__block", *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0.0)).alias(f"__o_{k}") for k in sums])
    inner = Window.partitionBy(*by, "__block").orderBy(order)
    until = F.coalesce(F.lead(order).over(inner) - 1, F.least((F.col("__block") + 1) * size - 1, F.lit(last)))
    return filled.join(offsets, [*by, "__block"]).select(*by, F.col(order).alias("since"), until.alias("until"), *[(F.sum(k).over(inner) + F.col(f"__o_{k}")).alias(k) for k in sums])


def at_every(intervals: DataFrame, order: str) -> DataFrame:
    """A row for every number of every interval, in place of since and until."""
    return intervals.withColumn(order, F.explode(F.sequence("since", "until"))).drop("since", "until")


#: The least weight that a block's end may have at its start, and what the weights of forgotten blocks stay below.
_LEAST, _FORGOTTEN = 1e-6, 2.0**-80


def discounted_intervals(rows: DataFrame, keys: DataFrame, order: str, last: int, value: str, discount: float, size: int = 10_000) -> DataFrame:
    """Discounted running sums, S(t) = sum over rows up to t of value * discount^(t - number), as intervals.

    (keys, since, until, s): S(t) is s * discount^(t - since). Decay and sum form a monoid (a block maps the S before it to
    decay * S + its own sum), so blocks are summed alone and joined. Blocks are so short that weights inside them are no
    smaller than 1e-6, and a block's sum is carried over as many blocks as it takes for its weight to fall below 2^-80:
    that bounds the work, and what is left out is smaller than the rounding of what is summed.
    """
    if not 0 < discount < 1:
        raise ValueError("the discount lies between 0 and 1")
    by, rate = keys.columns, math.log(discount)
    size = max(1, min(size, int(math.log(_LEAST) / rate)))
    filled = _filled(rows, keys, order, last, {"v": value}, size)
    weighed = filled.withColumn("__at", F.col(order) - F.col("__block") * size).withColumn("__v", F.col("v") * F.exp(F.col("__at") * -rate))
    ends = weighed.where("v != 0").groupBy(*by, "__block").agg(F.sum("__v").alias("__s"))
    reach = int(math.log(_FORGOTTEN) / rate / size) + 1
    carried = ends.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(reach)))).select(*by, (F.col("__block") + F.col("__k")).alias("__block"), (F.col("__s") * F.exp(F.col("__k") * (rate * size))).alias("__c"))
    offsets = carried.groupBy(*by, "__block").agg(F.sum("__c").alias("__c"))
    inner = Window.partitionBy(*by, "__block").orderBy(order)
    until = F.coalesce(F.lead(order).over(inner) - 1, F.least((F.col("__block") + 1) * size - 1, F.lit(last)))
    found = weighed.join(offsets, [*by, "__block"], "left")
    s = (F.sum("__v").over(inner) + F.coalesce(F.col("__c"), F.lit(0.0))) * F.exp(F.col("__at") * rate)
    return found.select(*by, F.col(order).alias("since"), until.alias("until"), s.alias("s"))
