"""Random columns that depend on the entry and a seed alone: any partitioning gives the same values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(entry: Column, seed: int = 0, stream: int = 0) -> Column:
    """In (0, 1)."""
    bits = F.shiftrightunsigned(F.xxhash64(entry, F.lit(seed), F.lit(stream)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def gaussian(entry: Column, mean: float = 0.0, sigma: float = 1.0, seed: int = 0) -> Column:
    r = F.sqrt(-2.0 * F.ln(uniform(entry, seed, 1)))
    return mean + sigma * r * F.cos(2 * math.pi * uniform(entry, seed, 2))


def exponential(entry: Column, tau: float = 1.0, seed: int = 0) -> Column:
    return -tau * F.ln(uniform(entry, seed, 3))


def integer(entry: Column, n: int, seed: int = 0) -> Column:
    return F.floor(uniform(entry, seed, 4) * n).cast("int")


def breit_wigner(entry: Column, mean: float = 0.0, gamma: float = 1.0, seed: int = 0) -> Column:
    return mean + 0.5 * gamma * F.tan(math.pi * (uniform(entry, seed, 5) - 0.5))


def poisson(entry: Column, mean: float, seed: int = 0) -> Column:
    """By inversion of the running sum, for means up to 60; normal beyond."""
    if mean > 60:
        return F.greatest(F.lit(0), F.rint(gaussian(entry, mean, math.sqrt(mean), seed))).cast("long")
    u, term, total, bounds = uniform(entry, seed, 6), math.exp(-mean), 0.0, []
    for k in range(int(mean + 12 * math.sqrt(mean) + 20)):
        total += term
        bounds.append(total)
        term *= mean / (k + 1)
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= u)).cast("long")


def binomial(entry: Column, n: int, p: float, seed: int = 0) -> Column:
    trials = F.sequence(F.lit(1), F.lit(n))
    return F.size(F.filter(trials, lambda k: uniform(F.struct(entry, k), seed, 7) < p)).cast("long")


KINDS = {"uniform": uniform, "gaussian": gaussian, "exponential": exponential, "integer": integer, "breit_wigner": breit_wigner, "poisson": poisson, "binomial": binomial}
