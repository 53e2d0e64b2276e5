"""Synthetic keys, uniform or by a power law, for load tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import murmur2

LETTERS = 26
FILLERS = 10_000


def _letter(number: Column) -> Column:
    return F.char(F.lit(97) + number.cast("int"))


def _zipf(u: Column, n: int, alpha: float) -> Column:
    """0 .. n-1 by inverse distribution."""
    weights = [1 / i**alpha for i in range(1, n + 1)]
    sums, total = [], 0.0
    for w in weights:
        total += w / sum(weights)
        sums.append(total)
    steps = F.array(*map(F.lit, sums[:-1])) if n > 1 else F.array().cast("array<double>")
    return F.size(F.filter(steps, lambda x: x < u))


def generate(spark: SparkSession, rows: int, unique: int, length: int, power: float | None = None, seed: int = 0, slices: int = 8) -> DataFrame:
    """(key, count): ``rows`` records with at most about ``unique`` keys of ``length`` letters.

    A key is as many random letters as 26 goes into ``unique`` as a power, one
    more from as many letters as are still needed, and a filler that is a
    function of those.  ``power`` is the exponent of the letters' distribution,
    None for uniform.  The result does not depend on the cluster: partitions
    are fixed by ``slices``.
    """
    full = int(math.floor(math.log(unique, LETTERS) + 1e-9))
    part = min(LETTERS, math.ceil(unique / LETTERS**full))
    if length <= full:
        raise ValueError(f"keys of {length} letters are too short for {unique} of them")
    ids = spark.range(0, rows, 1, slices)
    draw = lambda k, n: F.floor(F.rand(seed * 101 + k) * n) if power is None else _zipf(F.rand(seed * 101 + k), n, power)
    prefix = ids.select(F.concat(*(_letter(draw(k, LETTERS)) for k in range(full)), _letter(draw(full, part))).alias("prefix"))
    filler = (murmur2(F.col("prefix"), 42) % FILLERS).alias("f")
    filled = prefix.select("prefix", filler)
    rest = [_letter(F.pmod(F.xxhash64(F.col("f"), F.lit(k)), F.lit(LETTERS))) for k in range(length - full - 1)]
    return filled.select(F.concat("prefix", *rest).alias("key"), F.lit(1).cast("long").alias("count"))
