"""Resampling of whole tables: every task folds its rows into one vector of partial sums, and the vectors are added.

Random numbers are a hash of the row's key and the replicate, so a result depends neither on partitions nor on the order of
rows, and another engine can follow. No row is repeated for a replicate; a task holds its rows by steps and one vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows times replicates that a task works on at once.
STEP = 1 << 22

#: Chances of a Poisson count of at most 0, 1, ... of mean 1, as shares of 2^32: a weight is the number of them not above a draw.
POISSON = [math.floor(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def _finish(h: np.ndarray) -> np.ndarray:
    """Shifts and odd multipliers (fixed values of a public mixing function)."""
    low = np.uint64(0xFFFFFFFF)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & low
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & low
    return h ^ (h >> np.uint64(16))


def drawn(keys: np.ndarray, seed: int, streams: np.ndarray) -> np.ndarray:
    """32 well mixed bits for each key (both halves of it) and stream, as unsigned 64-bit integers."""
    h = _finish((keys & np.uint64(0xFFFFFFFF)) ^ np.uint64(seed & 0xFFFFFFFF))
    h = _finish(h ^ (keys >> np.uint64(32)))
    return _finish(h[:, None] ^ streams[None, :])


def drawn_sql(key: str, seed: int, stream: str) -> str:
    """The same bits in the oracle's dialect."""

    def finish(h: str) -> str:
        return (
            f"list_transform(list_transform([{h}], lambda h: (xor(h, h >> 16) * 2246822507::UBIGINT) & 4294967295::UBIGINT), "
            "lambda h: (xor(h, h >> 13) * 3266489909::UBIGINT) & 4294967295::UBIGINT)"
        )

    step = lambda h: f"list_transform({finish(h)}, lambda h: xor(h, h >> 16))[1]"
    first = step(f"xor(({key})::UBIGINT & 4294967295::UBIGINT, {seed}::UBIGINT)")
    return step(f"xor({step(f'xor({first}, ({key})::UBIGINT >> 32)')}, ({stream})::UBIGINT)")


def _vectors(rows: DataFrame, fold, width: int, more: int) -> DataFrame:
    """(g, at, s0, s1, ...) by group: sums over tasks of the vectors that ``fold`` makes of arrays (keys, values) of a group."""
    ship(rows.sparkSession)
    names = [f"s{i}" for i in range(more)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            groups = np.array(batch.column("g").to_pylist(), dtype=object)
            keys = batch.column("key").to_numpy().astype("i8").view("u8")
            values = batch.column("v").to_numpy(zero_copy_only=False)
            for g in sorted(set(groups.tolist())):
                own = groups == g
                k, v = keys[own], values[own]
                total = held.setdefault(g, np.zeros((more, width)))
                step = max(1, STEP // width)
                for low in range(0, len(k), step):
                    total += fold(k[low : low + step], v[low : low + step])
        for g, total in held.items():
            columns = [pa.array([g] * width, pa.string()), pa.array(np.arange(width, dtype="i4"))] + [pa.array(x) for x in total]
            yield pa.RecordBatch.from_arrays(columns, names=["g", "at", *names])

    found = rows.mapInArrow(run, "g string, at int, " + ", ".join(f"{n} double" for n in names))
    return found.groupBy("g", "at").agg(*[F.sum(n).alias(n) for n in names])


def _named(rows: DataFrame, key: str, value, group: str | None) -> DataFrame:
    return rows.select((F.lit("") if group is None else F.col(group).cast("string")).alias("g"), F.col(key).cast("long").alias("key"), value.cast("double").alias("v"))


def bootstrap_means(rows: DataFrame, key: str, value: str, n_bootstrap: int = 1000, seed: int = 42, group: str | None = None) -> DataFrame:
    """(g, b, stat): means of resamples of all rows, in which each row occurs a Poisson number of times of mean 1.

    ``key`` tells rows apart (equal keys occur equally often); rows without key or value are left out. A resample that drew no
    row, which only very few rows can make, has no mean and no row.
    """
    edges = np.array(POISSON, "u8")
    replicates = np.arange(n_bootstrap, dtype="u8")

    def fold(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        weights = np.searchsorted(edges, drawn(keys, seed, replicates), "right").astype("f8")
        return np.stack([values @ weights, weights.sum(axis=0)])

    usable = _named(rows, key, F.col(value), group).where("key is not null and v is not null")
    sums = _vectors(usable, fold, n_bootstrap, 2)
    return sums.where("s1 > 0").select("g", F.col("at").alias("b"), (F.col("s0") / F.col("s1")).alias("stat"))


def bootstrap_mean_interval(rows: DataFrame, key: str, value: str, n_bootstrap: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """One row (estimate, low, high): percentile interval of the mean of all rows; zeros without data."""
    tail = (1 - ci) / 2
    ends = bootstrap_means(rows, key, value, n_bootstrap, seed).agg(F.percentile("stat", F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    seen = rows.where(F.col(key).isNotNull()).agg(F.avg(F.col(value).cast("double")).alias("e"))
    return seen.crossJoin(ends).select(zero(F.col("e")).alias("estimate"), zero(F.get("p", F.lit(0))).alias("low"), zero(F.get("p", F.lit(1))).alias("high"))


def bootstrap_mean_difference(rows: DataFrame, key: str, a: str, b: str, n_bootstrap: int = 1000, ci: float = 0.95, seed: int = 42) -> DataFrame:
    """One row (difference, low, high, significant): of a's mean less b's, resampled independently (b by the next seed)."""
    tail = (1 - ci) / 2
    both = bootstrap_means(rows, key, a, n_bootstrap, seed).join(bootstrap_means(rows, key, b, n_bootstrap, seed + 1).withColumnRenamed("stat", "other"), "b")
    ends = both.agg(F.percentile(F.col("stat") - F.col("other"), F.array(F.lit(tail), F.lit(1 - tail))).alias("p"))
    seen = rows.where(F.col(key).isNotNull()).agg(F.avg(F.col(a).cast("double")).alias("ea"), F.avg(F.col(b).cast("double")).alias("eb"))
    low, high = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return seen.crossJoin(ends).select((F.col("ea") - F.col("eb")).alias("difference"), low.alias("low"), high.alias("high"), ((low > 0) | (high < 0)).alias("significant"))


def sign_flips(rows: DataFrame, key: str, a: str, b: str, n_permutations: int = 10_000, seed: int = 42, group: str | None = None) -> DataFrame:
    """(g, observed, p_value, effect, n) of a sign-flip test over all pairs (of each group, if asked for).

    Signs are the bits of words of 32, one word for 32 permutations of a row. p is the share of permutations whose mean is at
    least as far from 0 as the observed one; the effect is the mean over the population's deviation, 0 without spread. A null
    on one side alone means series of unequal length, which is an error; rows with nulls on both are left out.
    """
    words = -(-n_permutations // 32)
    streams = np.arange(words, dtype="u8")

    def fold(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
        bits = drawn(keys, seed, streams).astype("<u4").view("u1").reshape(len(keys), -1)
        minus = np.unpackbits(bits, axis=1, bitorder="little")[:, :n_permutations]
        return (values.sum() - 2.0 * (values @ minus))[None, :]

    unequal = F.col(a).isNull() != F.col(b).isNull()
    difference = F.when(unequal, F.raise_error(F.lit("series of unequal length"))).otherwise(F.col(a).cast("double") - F.col(b).cast("double"))
    usable = _named(rows, key, difference, group).where("key is not null and v is not null")
    sums = _vectors(usable, fold, n_permutations, 1)
    seen = usable.groupBy("g").agg(F.avg("v").alias("observed"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("n"))
    # Sums of doubles depend on their order, so equal means are told apart only beyond rounding.
    far = (F.abs(F.col("s0") / F.col("n")) >= F.abs("observed") - 1e-12).cast("double")
    tested = sums.join(seen, "g").groupBy("g", "observed", "sd", "n").agg(F.avg(far).alias("p_value"))
    effect = F.when(F.col("sd") == 0, 0.0).otherwise(F.col("observed") / F.when(F.col("sd") != 0, F.col("sd")))
    return tested.select("g", "observed", "p_value", effect.alias("effect"), "n")
