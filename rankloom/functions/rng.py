"""Stateless random numbers: a uniform draw is a hash of a seed, a stream's name and keys.

A draw depends on nothing else, so plans may be split, replayed and checked by another engine. Streams in use: res,
chunk, rand, subset, draft, pbm, noise, noisepos, fn, rucb, rc, boot, bootb, perm, and ts, win and loss with their parts.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *keys) -> Column:
    """Uniform double in [0, 1)."""
    parts = [F.lit(str(seed)), F.lit(stream), *(k if isinstance(k, Column) else F.col(k) for k in keys)]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(seed: int, stream: str, *keys: str) -> str:
    """The same draw in the oracle's dialect."""
    text = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', '{stream}', {text})), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


def normals(seed: int, stream: str, n: int) -> list[float]:
    """n standard normal draws of a stream, numbered from 0, as plain numbers; they are those that ``normal_sql`` gives."""
    u = lambda i, part: int(hashlib.md5(f"{seed}|{stream}|{i}|{part}".encode()).hexdigest()[:8], 16) / 2**32
    return [math.sqrt(-2 * math.log(1 - u(i, "r"))) * math.cos(2 * math.pi * u(i, "a")) for i in range(n)]


def normal_sql(seed: int, stream: str, i: int) -> str:
    """The i-th of ``normals`` in the oracle's dialect."""
    r, a = (uniform_sql(seed, stream, str(i), f"'{part}'") for part in ("r", "a"))
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {r})) * cos({2 * math.pi!r}::DOUBLE * {a}))"


#: Tries of a rejection draw: each succeeds with a chance of over 0.95, so that all fail about once in 10^20.
TRIES = 16


def gamma(shape: Column, seed: int, stream: str, *keys) -> Column:
    """A gamma draw of a shape of at least 1: squeezed cubes of normal draws, rejected and drawn anew from the next streams.

    The first try that is accepted counts; later ones aren't computed. Should all fail, which they don't, the draw is the mean.
    """
    d = shape.cast("double") - F.lit(1 / 3)

    def fits(x: Column, v: Column, u: Column) -> Column:
        return (v > 0) & (F.log(F.lit(1.0) - u) < F.lit(0.5) * x * x + d - d * v + d * F.log(F.greatest(v, F.lit(1e-300))))

    def attempt(k: Column) -> Column:
        r, a, u = (uniform(seed, stream, k, F.lit(part), *keys) for part in ("r", "a", "u"))
        normal = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - r)) * F.cos(F.lit(2 * math.pi) * a)
        cube = lambda x: F.pow(F.lit(1.0) + x / F.sqrt(F.lit(9.0) * d), F.lit(3.0))
        return F.transform(F.array(normal), lambda x: F.transform(F.array(cube(x)), lambda v: F.when(fits(x, v, u), d * v))[0])[0]

    tries = F.sequence(F.lit(0), F.lit(TRIES - 1))
    return F.coalesce(F.aggregate(tries, F.lit(None).cast("double"), lambda acc, k: F.when(acc.isNotNull(), acc).otherwise(attempt(k))), d)


def beta(a: Column, b: Column, seed: int, *keys) -> Column:
    """A beta draw of parameters of at least 1, from two gamma draws of streams of their own."""
    both = F.struct(gamma(a, seed, "win", *keys).alias("won"), gamma(b, seed, "loss", *keys).alias("lost"))
    return F.transform(F.array(both), lambda g: g["won"] / (g["won"] + g["lost"]))[0]


def gamma_sql(shape: str, seed: int, stream: str, *keys: str) -> str:
    """The same draw in the oracle's dialect."""
    d = f"(CAST({shape} AS DOUBLE) - {1 / 3!r}::DOUBLE)"
    r, a, u = (uniform_sql(seed, stream, "k", f"'{part}'", *keys) for part in ("r", "a", "u"))
    normal = f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {r})) * cos({2 * math.pi!r}::DOUBLE * {a})"
    found = f"CASE WHEN v > 0 AND ln(1.0::DOUBLE - {u}) < 0.5::DOUBLE * x * x + {d} - {d} * v + {d} * ln(greatest(v, 1e-300)) THEN {d} * v END"
    cube = f"list_transform([pow(1.0::DOUBLE + x / sqrt(9.0::DOUBLE * {d}), 3)], lambda v: {found})[1]"
    return f"coalesce(list_filter(list_transform(range({TRIES}), lambda k: list_transform([{normal}], lambda x: {cube})[1]), lambda z: z IS NOT NULL)[1], {d})"
